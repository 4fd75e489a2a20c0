"""Requests for partitions: what is wrong with one, as an expression of its columns, and its defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What payloads, altitudes and terrain a request may ask for; defaults of overlaps and clearance, and the most overlap.
PAYLOADS, ALTITUDES, SOURCES, OVERLAP, CLEARANCE, MOST_OVERLAP = ("camera", "lidar"), ("legacy", "min-clearance"), ("mapbox", "blended"), 70.0, 60.0, 95.0


def problems() -> Column:
    """array of the names of a request's columns (ring, payload, altitude, front, side, clearance, tradeoff, mode, source, dataset) that aren't valid.

    What is null has its default, but for the ring, the payload and the altitude, which have none.
    """
    within = lambda c, lo, hi: F.col(c).isNull() | F.col(c).between(lo, hi)
    good = {
        "ring": F.coalesce(F.size("ring") >= 3, F.lit(False)), "payload": F.coalesce(F.col("payload").isin(*PAYLOADS), F.lit(False)), "altitude": F.coalesce(F.col("altitude") > 0, F.lit(False)),
        "front": within("front", 0, MOST_OVERLAP), "side": within("side", 0, MOST_OVERLAP), "clearance": F.col("clearance").isNull() | (F.col("clearance") >= 0), "tradeoff": within("tradeoff", 0, 1),
        "mode": F.col("mode").isNull() | F.col("mode").isin(*ALTITUDES), "source": F.col("source").isNull() | F.col("source").isin(*SOURCES), "dataset": ~F.coalesce(F.col("source") == "blended", F.lit(False)) | F.coalesce(F.trim("dataset") != "", F.lit(False)),
    }
    return F.filter(F.array(*[F.when(~ok, F.lit(name)) for name, ok in good.items()]), lambda n: n.isNotNull())


def validated(requests: DataFrame) -> DataFrame:
    """requests with defaults in place of nulls, and their `problems`; those without any can be solved."""
    r = requests.withColumn("problems", problems())
    return r.fillna({"front": OVERLAP, "side": OVERLAP, "clearance": CLEARANCE, "mode": ALTITUDES[0], "source": SOURCES[0]})
