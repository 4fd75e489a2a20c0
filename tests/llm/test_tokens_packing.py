import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("swathline.llm")
import public_tokenizers
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from swathline.llm import packing, token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "", " ", "  ", "a", "a b", "a  b", " a", "a ", "a\nb  c\t d", "it's 12,5 kg!  ", "x<|endoftext|>y  <|endoftext|> z", "<s>hi</s> there",
    "né ünd ①ﬁ 日本語 text", "▁a ▁", " x 　y \u0085z", "word " * 3000, "nospace" * 9000, "a\n\n b \n c", " \x1c a", "é́ don't I'LL we've", "0" * 5000,
]
ROWS = [(i, t) for i, t in enumerate(TEXTS)] + [(100, None), (None, "null id"), (3, "a"), (3, "a")]


def docs(spark, rows=ROWS):
    # other columns with names that the operators use inside
    return spark.createDataFrame([(a, b, "x", 1, 2) for a, b in rows], "doc_id long, text string, rank string, length int, n_tokens int")


def test_counts_are_the_library_s(spark):
    model = SentencePieceProcessor(model_file=MODEL)
    got = token_counts.count_tokens(docs(spark), MODEL, chunk=1 << 16).collect()
    want = [(i, len((t or "").encode()), len(model.encode(t or ""))) for i, t in ROWS]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


ODD = ["▁", " ", "  ", "a", "b", "the", "é", "\U00020000", "\U00020001", "\x00", "\x01", "\t", "\n", "\r", "　", "\u00a0", "日", "<s>", "<unk>", "<0x0A>", ".", "1", "\u0301", "\ufeff", "\u200b"]


def test_random_texts_count_as_the_library():
    """Markers, characters without a piece, control characters and mixed white space, on both paths."""
    rng = np.random.default_rng(8)
    counter = token_counts.PieceCounter(MODEL)
    texts = ["".join(rng.choice(ODD, size=int(n))) for n in rng.integers(0, 14, 10_000)]
    want = [len(x) for x in counter.model.encode(texts, num_threads=1)]
    assert counter.short(pa.array(texts)).tolist() == want
    for chunk, overlap in ((30, 1), (47, 7), (300, 64)):
        for n in rng.integers(0, 400, 80):
            text = "".join(rng.choice(ODD, size=int(n)))
            assert counter.long(text, chunk, overlap) == len(counter.model.encode(text)), repr(text)


def test_huge_documents(spark):
    """Texts beyond a chunk of 65,536 characters, one that ends its chunks in characters without a piece."""
    rng = np.random.default_rng(9)
    texts = ["\U00020000\U00020001 " * 50_000, "".join(rng.choice(ODD, size=150_000)), "▁ " * 40_000, "x" * 70_000, "word by word " * 9000]
    model = SentencePieceProcessor(model_file=MODEL)
    got = token_counts.count_tokens(docs(spark, list(enumerate(texts))), MODEL).collect()
    assert sorted(map(tuple, got)) == [(i, len(t.encode()), len(model.encode(t))) for i, t in enumerate(texts)]


@pytest.mark.parametrize("overlap", [1, 7, 64])
def test_chunks_splice_to_the_whole(overlap):
    rng = np.random.default_rng(overlap)
    counter = token_counts.PieceCounter(MODEL)
    for case in range(30):
        alphabet = list("ab the né.\n") if case % 2 else list("abc  ")
        text = "".join(rng.choice(alphabet, size=int(rng.integers(0, 700))))
        assert counter.long(text, 40, overlap) == len(counter.model.encode(text))
    for text in TEXTS:
        text = text.replace("▁", " ")
        assert counter.long(text, 1000, overlap) == len(counter.model.encode(text))


def test_segments_encode_as_the_library():
    full = Tokenizer.from_file(BYTES)
    encoder = packing.ByteEncoder(BYTES)
    assert encoder.ranked is not None
    rng = np.random.default_rng(1)
    texts = TEXTS + ["".join(rng.choice(list("ab'st 1,\n é日"), size=int(rng.integers(0, 60)))) for _ in range(2000)]
    for _ in range(2):  # from memory the second time
        for text, ids in zip(texts, encoder(pa.array(texts)), strict=True):
            assert ids.tolist() == full.encode(text, add_special_tokens=False).ids, repr(text)


def test_packing_round_trip(spark):
    rows = ROWS + [(1000 + i, "some words " * (i * 7 % 900)) for i in range(300)]
    got = packing.pack_documents(docs(spark, rows), BYTES).collect()
    full = Tokenizer.from_file(BYTES)
    want = [(i, np.array([*full.encode(t or "", add_special_tokens=False).ids, 1], "<u4")) for i, t in rows]
    pieces = sorted((str(r["doc_id"]), r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got)
    assert pieces == sorted((str(i), s, len(x[s : s + 2048]), zlib.crc32(x[s : s + 2048].tobytes()), len(x)) for i, x in want for s in range(0, len(x), 2048))
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert sorted(sequences) == list(range(len(sequences)))
    tokens = sum(len(x) for _, x in want)
    assert len(sequences) <= -(-tokens // 2048) * 1.02 + 1


def test_histogram_placements_are_whole():
    rng = np.random.default_rng(3)
    for _ in range(50):
        counts = {int(k): int(n) for k, n in zip(rng.integers(1, 65, 20), rng.integers(1, 500, 20), strict=True)}
        ranks, fill = defaultdict(list), defaultdict(list)
        for length, a, b, first, offset in packing.pack_histogram(counts, 64):
            ranks[length] += range(a, b)
            for k in range(b - a):
                fill[first + k].append((offset, length))
        assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
        for spans in fill.values():
            ends = np.cumsum([n for _, n in sorted(spans)])
            assert ends[-1] <= 64 and [o for o, _ in sorted(spans)] == [0, *ends[:-1]]


def test_empty_table(spark):
    assert packing.pack_documents(docs(spark, []), BYTES).count() == 0
    assert token_counts.count_tokens(docs(spark, []), MODEL).count() == 0
