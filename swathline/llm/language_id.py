"""Language identification by cross-parsing: the language whose text needs the fewest normalised phrases wins."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._segments import release, slices

#: Symbols before the letters. A separator stands between training texts and is in no parsed text.
SPACE, OTHER, SEPARATOR = 0, 1, 2
#: Symbols that are parsed as one run: lanes of this length advance together, and are mended where a phrase goes on.
LANE = 256
#: UTF-8 bytes of text that are parsed at once; what a parse holds is some thirty times as much.
SLICE = 1 << 20
#: Languages that a worker can hold, at 3 MB each at most; more labels are refused, never dropped.
MAX_LANGUAGES = 400


def sample(
    docs: DataFrame, where: Column, per_language: int = 64, total: int = 32_768, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", longest: int = 2048
) -> dict[str, list[str]]:
    """The training texts by language: a bounded sample of the labelled rows, each row whole.

    Of every label at most `per_language` rows, as long as they have `total` characters together, and one row in any
    case: first those of at most `longest` characters in the order of a hash of id and text, then the others from the
    shortest on. Rows without a letter or a label teach nothing; null ids are ids like others; repeated rows count
    each. No label is left out: more than MAX_LANGUAGES raise an error. An empty table gives an empty dict.
    """
    labelled = docs.filter(where & F.col(lang_col).isNotNull())
    flat = labelled.filter(F.col(text_col).rlike(r"\p{L}"))
    flat = flat.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.length(text_col).alias("n"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"))
    labels = labelled.select(F.col(lang_col)).distinct().limit(MAX_LANGUAGES + 1).count()
    if labels > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} labels: more automata than a worker may hold")
    order = [F.greatest(F.col("n"), F.lit(longest)), F.col("h"), F.col("text")]
    own = Window.partitionBy("lang").orderBy(*order)
    first = flat.withColumn("r", F.row_number().over(own)).filter(F.col("r") <= per_language)  # cut before the shuffle
    picked = first.withColumn("sum", F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, 0))).filter((F.col("r") == 1) | (F.col("sum") <= total))
    found: dict[str, list[str]] = {}
    for r in picked.select("lang", "r", "text").orderBy("lang", "r").collect():
        found.setdefault(r["lang"], []).append(r["text"])
    return found


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """The suffix automaton of a sequence: every path from state 0 spells a substring, and all are there."""
    steps: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        state = len(steps)
        steps.append({}), link.append(0), length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in steps[p]:
            steps[p][c] = state
            p = link[p]
        if p >= 0:
            q = steps[p][c]
            if length[q] == length[p] + 1:
                link[state] = q
            else:
                copy = len(steps)
                steps.append(dict(steps[q])), link.append(link[q]), length.append(length[p] + 1)
                while p >= 0 and steps[p].get(c) == q:
                    steps[p][c] = copy
                    p = link[p]
                link[q] = link[state] = copy
        last = state
    return steps


class Edges:
    """An automaton's transitions in an open hash table: some 12 bytes for each of at most 6 n slots, whatever the alphabet."""

    def __init__(self, steps: list[dict[int, int]], symbols: int):
        self.symbols = symbols
        flat = [(s * symbols + c, t) for s, to in enumerate(steps) for c, t in to.items() if c != SEPARATOR]
        keys, to = np.array(flat, np.int64).reshape(-1, 2).T
        self.shift = np.uint64(64 - max(4, (2 * len(keys)).bit_length()))
        self.mask = (1 << (64 - int(self.shift))) - 1
        self.keys = np.full(self.mask + 1, -1, np.int64)
        self.to = np.full(self.mask + 1, -1, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[slot[left]] < 0
            at, who = np.unique(slot[left[free]], return_index=True)
            taken = left[free][who]
            self.keys[at], self.to[at] = keys[taken], to[taken]
            left = np.setdiff1d(left, taken, assume_unique=True)
            left_slots = slot[left]
            slot[left] = np.where(self.keys[left_slots] >= 0, (left_slots + 1) & self.mask, left_slots)
        self.root = self.follow(np.zeros(symbols, np.int32), np.arange(symbols, dtype=np.int64))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def follow(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Where each symbol leads from each state; -1: nowhere."""
        keys = state * np.int64(self.symbols) + symbol
        slot = self._slot(keys)
        found = self.keys[slot]
        to = np.where(found == keys, self.to[slot], np.int32(-1))
        other = np.flatnonzero((found != keys) & (found >= 0))
        while len(other):
            slot[other] = (slot[other] + 1) & self.mask
            found = self.keys[slot[other]]
            hit = found == keys[other]
            to[other[hit]] = self.to[slot[other[hit]]]
            other = other[~hit & (found >= 0)]
        return to

    def step(self, state: int, symbol: int) -> int:
        key = state * self.symbols + symbol
        slot = ((key * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) >> int(self.shift)
        while (found := self.keys.item(slot)) != key:
            if found < 0:
                return -1
            slot = (slot + 1) & self.mask
        return self.to.item(slot)


class Languages:
    """The automata of all languages, over every letter that stands in any training text."""

    def __init__(self, texts: dict[str, list[str]]):
        self.names = sorted(texts)
        letter = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
        self.symbol = np.where(letter, np.int32(OTHER), np.int32(SPACE))
        known = sorted({ord(c) for parts in texts.values() for t in parts for c in t.lower() if c.isalpha()})
        self.symbol[known] = np.arange(3, 3 + len(known))
        self.size = 3 + len(known)
        self.edges, self.bits = [], []
        for name in self.names:
            symbols: list[int] = []
            for s in self.symbols(texts[name]):
                symbols += [SEPARATOR, *s.tolist()]
            self.edges.append(Edges(automaton(symbols), self.size))
            self.bits.append(np.log2(max(2, len(symbols))))

    def symbols(self, texts: list[str]) -> list[np.ndarray]:
        """Letters in lower case as symbols, and one space for everything between them."""
        out = []
        for t in texts:
            s = self.symbol[np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), "<u4")]
            space = s == SPACE
            space[1:] &= space[:-1]
            out.append(s[~space])
        return out

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases of each text in each language: text by language.

        A phrase is the longest match from where the last one ended; a letter that doesn't occur is a phrase by itself.
        Runs of LANE symbols are first parsed side by side, one symbol a step, as if a phrase began with each. A run is
        then parsed anew from the phrase that was open before it, up to where both parses are in the same state, from
        where on they agree; so the counts are those of the whole text's parse.
        """
        coded = self.symbols(texts)
        lanes = np.array([-(-len(s) // LANE) for s in coded], np.int64)
        first = np.concatenate([[0], np.cumsum(lanes)])
        board = np.full((first[-1], LANE), SEPARATOR, np.int32)
        flat = board.ravel()
        for s, f in zip(coded, first[:-1].tolist(), strict=True):
            flat[f * LANE : f * LANE + len(s)] = s
        sizes = (board != SEPARATOR).sum(axis=1)
        # Longer runs first, so that those still going are the front ones.
        order = np.argsort(-sizes, kind="stable")
        going = np.searchsorted(-sizes[order], -np.arange(LANE), side="left")
        steps = np.ascontiguousarray(board[order].T)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        head = np.zeros(len(order) + 1, bool)
        head[first[:-1]] = True
        out = np.zeros((len(texts), len(self.names)), np.int64)
        for k, edges in enumerate(self.edges):
            state = np.zeros(len(order), np.int32)
            count = np.zeros(len(order), np.int64)
            states, begins = np.zeros((LANE, len(order)), np.int32), np.zeros((LANE, len(order)), bool)
            for i in range(LANE):
                n = int(going[i])
                if not n:
                    break
                state[:n], began = _advance(edges, state[:n], steps[i, :n])
                count[:n] += began
                states[i, :n], begins[i, :n] = state[:n], began
            count, state = count[place], state[place]
            self._mend(edges, coded, first, head[:-1], sizes, place, states, begins, state, count)
            sums = np.concatenate([[0], np.cumsum(count)])
            out[:, k] = sums[first[1:]] - sums[first[:-1]]
        return out

    def _mend(self, edges: Edges, coded: list, first: np.ndarray, head: np.ndarray, sizes: np.ndarray, place: np.ndarray, states: np.ndarray, begins: np.ndarray, state: np.ndarray, count: np.ndarray) -> None:
        """Parses each lane anew from the state in which the lane before it ended, until it meets its first parse.

        All lanes at once from their neighbours' first parses, which nearly always were met; what follows a lane that
        met its own nowhere is done once more, lane by lane, from the state now known.
        """
        came = np.zeros(len(state), np.int32)
        came[1:] = np.where(head[1:], 0, state[:-1])
        todo = np.flatnonzero(came)
        now, lost = came[todo], np.zeros(len(state), bool)
        ended = state.copy()
        flat = np.concatenate([np.concatenate(coded), np.zeros(1, np.int32)]) if coded else np.zeros(1, np.int32)
        # Symbols of a text are consecutive in flat, so lane k starts at its text's start and LANE a lane.
        text_of = np.repeat(np.arange(len(coded)), np.diff(first))
        starts = np.concatenate([[0], np.cumsum([len(s) for s in coded])])[text_of] + (np.arange(len(state)) - first[text_of]) * LANE
        for i in range(LANE):
            if not len(todo):
                break
            past = sizes[todo] <= i
            if past.any():
                lost[todo[past]] = True
                ended[todo[past]] = now[past]
                todo, now = todo[~past], now[~past]
            after, began = _advance(edges, now, flat[starts[todo] + i])
            count[todo] += began.astype(np.int64) - begins[i, place[todo]]
            met = after == states[i, place[todo]]
            todo, now = todo[~met], after[~met]
        lost[todo] = True
        ended[todo] = now
        # A lane that follows a lost one was parsed from a state that no longer holds.
        for k in np.flatnonzero(lost).tolist():
            if k + 1 >= len(state) or head[k + 1]:
                continue
            self._redo(edges, flat, starts, head, sizes, ended, came, count, k + 1)

    def _redo(self, edges: Edges, flat: np.ndarray, starts: np.ndarray, head: np.ndarray, sizes: np.ndarray, ended: np.ndarray, came: np.ndarray, count: np.ndarray, k: int) -> None:
        """From lane k on, as long as the state before it is another than the one it was parsed from."""
        while k < len(head) and not head[k] and came[k] != ended[k - 1]:
            now, was, met = int(ended[k - 1]), int(came[k]), False
            symbols = flat[starts[k] : starts[k] + int(sizes[k])].tolist()
            came[k] = now
            for c in symbols:
                now, a = self._one(edges, now, c)
                was, b = self._one(edges, was, c)
                count[k] += a - b
                if now == was:
                    met = True
                    break
            if met:
                return  # from here on nothing differs from what was found before
            ended[k] = now
            k += 1

    @staticmethod
    def _one(edges: Edges, state: int, symbol: int) -> tuple[int, int]:
        to = edges.step(state, symbol)
        if to >= 0:
            return to, int(state == 0)
        again = int(edges.root[symbol])
        return max(again, 0), 1

    def judge(self, texts: list[str]) -> tuple[list[str | None], list[float]]:
        """The language of each text, ties to the first by name, and the runner-up's share of both their costs.

        `und` is a text without letters; None is one with letters where no language was learnt.
        """
        if not self.names:
            return [None if any(map(str.isalpha, t)) else "und" for t in texts], [0.0] * len(texts)
        cost = self.phrases(texts) * np.array(self.bits)
        best = cost.argmin(axis=1)
        names, scores = [], []
        for i, t in enumerate(texts):
            if not any(map(str.isalpha, t)):
                names.append("und"), scores.append(0.0)
                continue
            rest = np.delete(cost[i], best[i])
            names.append(self.names[best[i]])
            scores.append(float(rest.min() / (rest.min() + cost[i, best[i]])) if len(rest) else 1.0)
        return names, scores


def _advance(edges: Edges, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The states after a symbol, and whether a phrase began with it."""
    to = edges.follow(state, symbol)
    miss = to < 0
    began = miss | (state == 0)
    to = np.where(miss, np.maximum(edges.root[symbol], 0), to)
    return to, began


_judges: dict[tuple, Languages] = {}


def _judge(parts: tuple) -> Languages:
    """A worker's own automata, built once and kept for its later tasks."""
    if parts not in _judges:
        _judges.clear()
        _judges[parts] = Languages({k: list(v) for k, v in parts})
    return _judges[parts]


def _parts(training: dict[str, list[str]]) -> tuple:
    return tuple((k, tuple(v)) for k, v in sorted(training.items()))


def identify(docs: DataFrame, training: dict[str, list[str]], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) for each row, from its whole text alone, and the columns named in `keep`.

    A null text and one without letters give `und` with score 0, a training without languages null with score 0 for the
    others. Null and repeated ids are as good as others: rows are judged one by one, and none moves between tasks. An
    empty table gives no rows.
    """
    parts = _parts(training)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in slices(batch.column("__text"), SLICE):
                names, scores = _judge(parts).judge(part.to_pylist())
                rest = [batch.column(c).slice(first, len(part)) for c in schema_in]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*schema_in, "lang_pred", "score"])
        release()

    flat = docs.select(F.col(id_col).alias("doc_id"), *keep, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    schema_in = [c for c in flat.columns if c != "__text"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in flat.schema if f.name != "__text")
    return flat.mapInArrow(run, f"{fields}, lang_pred string, score double")


def keep_known(docs: DataFrame, training: dict[str, list[str]], text_col: str = "text") -> DataFrame:
    """docs without the rows whose language can't be told (`und`); every column as it was, whatever its name.

    Each row is judged by itself where it is read: nothing is shuffled, and null or repeated ids don't matter. A training
    without languages takes no text with a letter away. An empty table stays empty.
    """
    parts = _parts(training)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            names: list[str | None] = []
            for _, part in slices(pc.fill_null(texts, ""), SLICE):
                names += _judge(parts).judge(part.to_pylist())[0]
            yield pa.array(names, pa.string())
        release()

    # Only the text goes to the kernel and only the language comes back; the rows wait where they are.
    language = F.arrow_udf(run, "string")
    return docs.filter(F.coalesce(language(F.col(text_col)), F.lit("")) != "und")
