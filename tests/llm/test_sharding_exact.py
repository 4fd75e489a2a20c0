import re
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest

pytest.importorskip("swathline.llm")
from swathline.llm import exact_dedup, sharding

ROWS = [(5, "a  b"), (3, "a\t\nb"), (9, "a b"), (1, None), (2, ""), (7, "x" * 300 + "1"), (8, "x" * 300 + "2"), (None, "a b"), (None, "lone"), (4, "lone2"), (4, "lone2"), (6, "é" * 70000), (10, " "), (11, "\v\f ")]


def docs(spark, rows):
    return spark.createDataFrame([(a, b, 1, "s") for a, b in rows], "doc_id long, text string, len int, sha string")


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


@pytest.mark.parametrize("all_", [True, False])
def test_exact_groups(spark, all_):
    got = exact_dedup.exact_groups(docs(spark, ROWS), digest_all=all_).collect()
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[norm(t)].append(i)
    assert len(got) == len(ROWS)
    want = sorted((str(i), str(min((x for x in groups[norm(t)] if x is not None), default=None)), len(groups[norm(t)])) for i, t in ROWS)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    digests = {sha256(norm(t).encode()).hexdigest() for _, t in ROWS}
    assert {r.text_sha256 for r in got} <= digests | (set() if all_ else {None})


def test_drop_copies_keeps_columns(spark):
    left = exact_dedup.drop_copies(docs(spark, ROWS))
    assert left.columns == ["doc_id", "text", "len", "sha"]
    assert len({norm(r.text) for r in left.collect()}) == left.count() == len({norm(t) for _, t in ROWS})


def test_shards(spark):
    rows = ROWS + [(1000 + i, f"t{i}") for i in range(5000)]
    got = sharding.shard_documents(docs(spark, rows), 24).collect()
    assert len(got) == len(rows)
    slots, sizes = defaultdict(list), sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t in rows)
    assert sorted((r["size"], r.text_crc32) for r in got) == sizes
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 24) and r.law == "key"
    assert sorted(slots) == list(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) < 1.4 * 5000 / 24
    moved = sum(r.grown_shard == 24 for r in got)
    assert 0.5 * 5000 / 25 < moved < 1.6 * 5000 / 25


def test_slots_over_many_buckets(spark):
    from swathline.llm._common import with_rank

    df = spark.range(1000).selectExpr("id", "id % 3 as g", "'x' as __n")
    got = with_rank(df, ["g"], ["id"], 1000, "slot", target=50).collect()
    for g in range(3):
        assert sorted(r.slot for r in got if r.g == g) == list(range(sum(r.g == g for r in got)))


def test_empty(spark):
    assert exact_dedup.exact_groups(docs(spark, []), digest_all=True).count() == 0
    assert sharding.shard_documents(docs(spark, []), 24).count() == 0
