"""Streams of poses: windows, sessions and the newest update of each polygon; the same calls serve tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windows(poses: DataFrame, width: str, late: str = "1 hour") -> DataFrame:
    """Poses and mean altitude by vehicle and even window of time. As a stream, windows end `late` after their time."""
    p = poses.withWatermark("ts", late) if poses.isStreaming else poses
    w = p.groupBy(F.window("ts", width), "user_id").agg(F.count(F.lit(1)).alias("poses"), F.avg("alt").alias("alt"))
    return w.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "user_id", "poses", "alt")


def sessions(poses: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """Flights: poses of a vehicle with less than `gap` from one to the next."""
    p = poses.withWatermark("ts", late) if poses.isStreaming else poses
    s = p.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("poses"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return s.select("user_id", "first", "last", "poses")


def newest(updates: DataFrame, keys: list[str], generation: list[str]) -> DataFrame:
    """The update of the highest generation by key: results that arrive late and are older change nothing."""
    rest = [c for c in updates.columns if c not in keys]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*generation)).alias("u")).select(*keys, "u.*")


def once(updates: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Each update once, though a source repeats it within the watermark."""
    return updates.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if updates.isStreaming else updates.dropDuplicates(keys)


def applied(state: DataFrame, snapshots: DataFrame, affected: DataFrame, key: str) -> DataFrame:
    """The state after a transaction: affected rows go, and their snapshots, where there are any, come."""
    return state.join(affected.select(key), key, "left_anti").unionByName(snapshots.join(affected.select(key).distinct(), key, "left_semi"))


def history(log: DataFrame, keys: list[str], order: list[str], most: int = 50) -> DataFrame:
    """The last `most` transactions of each log."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(*[F.col(o).desc() for o in order])
    return log.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= most).drop("__n")


def undo_state(log: DataFrame, keys: list[str], order: list[str], most: int = 50) -> DataFrame:
    """(keys, undo, redo): what can be undone and redone after a log (action, id) of push, undo and redo, the last at the end.

    A push forgets what could be redone, and the oldest beyond `most`. A log is folded in order, once, as an array of its steps.
    """
    steps = F.transform(F.array_sort(F.collect_list(F.struct(*order, "action", "id"))), lambda s: F.struct(s["action"].alias("action"), s["id"].alias("id")))
    laid = log.groupBy(*keys).agg(steps.alias("steps"))
    none = F.transform(F.slice("steps", 1, 0), lambda s: s["id"])
    state = lambda u, r: F.struct(u.alias("undo"), r.alias("redo"))
    top = lambda x: F.slice(x, F.greatest(F.size(x), F.lit(1)), 1)
    rest = lambda x: F.slice(x, F.lit(1), F.greatest(F.size(x) - 1, F.lit(0)))

    def fold(s, step):
        pushed = F.concat(s["undo"], F.array(step["id"]))
        pushed = F.slice(pushed, F.greatest(F.size(pushed) - most + 1, F.lit(1)), most)
        return F.when(step["action"] == "push", state(pushed, F.slice(s["redo"], 1, 0))).when(step["action"] == "undo", state(rest(s["undo"]), F.concat(s["redo"], top(s["undo"])))).otherwise(state(F.concat(s["undo"], top(s["redo"])), rest(s["redo"])))

    return laid.select(*keys, F.aggregate("steps", state(none, none), fold).alias("s")).select(*keys, "s.undo", "s.redo")


def affected(transactions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id): every polygon that a transaction had before or has after (arrays of ids), once."""
    return transactions.select(*keys, F.explode(F.array_union("before", "after")).alias("id"))


def profile_requests(log: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, snapshot, overview, detail): of every client the last snapshot, and the last request of either kind after it.

    log: keys, kind (snapshot, overview, detail), order. Requests before the last snapshot are about what is no longer there, and of
    several of a kind only the last is answered; as a stream this is one call a micro-batch over the log so far.
    """
    last = log.groupBy(*keys).agg(F.max(F.when(F.col("kind") == "snapshot", F.col(order))).alias("snapshot")).filter("snapshot IS NOT NULL")
    of = lambda kind: F.max(F.when((F.col("kind") == kind) & (F.col(order) > F.col("snapshot")), F.col(order))).alias(kind)
    return log.join(last, keys).groupBy(*keys, "snapshot").agg(of("overview"), of("detail"))
