"""Shards against a search over all contiguous cuts."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from rillmark.llm import sharding as S


def checked(df, shards):
    """The rows of a result, after its promises: whole groups, gapless slots, sizes and checksums."""
    rows, texts = S.shard(df, shards=shards).collect(), df.select("doc_id", "text").collect()
    assert sorted((str(r.id), r.size, r.text_crc32) for r in rows) == sorted((str(d.doc_id), len((d.text or "").encode()) + 1, zlib.crc32((d.text or "").encode())) for d in texts)
    for k in range(shards):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))
    assert all(r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards for r in rows)
    return rows


def groups_in_order(df):
    """(digest, bytes) of all groups in the order of the operator."""
    sizes = {}
    for r in df.select("text").collect():
        text = (r.text or "").encode()
        key = hashlib.sha256(text).digest()
        sizes[key] = sizes.get(key, 0) + len(text) + 1
    total = sum(sizes.values())
    return sorted(sizes.items(), key=lambda g: (-g[1] if g[1] * S.LARGE >= total else 0, g[0]))


def least_largest(sizes, shards):
    """The least possible largest shard, by dynamic programming over all contiguous cuts."""
    n, upto = len(sizes), [0]
    for s in sizes:
        upto.append(upto[-1] + s)
    best = [0] + [10**18] * n
    for _ in range(shards):
        best = [min(max(best[j], upto[i] - upto[j]) for j in range(i + 1)) for i in range(n + 1)]
    return best[n]


@pytest.fixture(scope="module")
def many(spark):
    r = random.Random(8)
    texts = ["x" * int(2 ** r.uniform(0, 9)) + str(i) for i in range(150)]
    rows = [(i, texts[i % 150] if i < 200 else texts[3]) for i in range(230)]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("blocks,pieces,large", [(4096, 64, 1 << 16), (7, 3, 1 << 16), (2, 2, 20), (50, 4, 1)])
@pytest.mark.parametrize("shards", [1, 3, 8])
def test_largest_shard_is_as_small_as_can_be(many, monkeypatch, blocks, pieces, large, shards):
    """Also where the driver sees few blocks of ends and must look closer again and again."""
    monkeypatch.setattr(S, "BLOCKS", blocks)
    monkeypatch.setattr(S, "PIECES", pieces)
    monkeypatch.setattr(S, "LARGE", large)
    rows = checked(many, shards)
    sizes = [0] * shards
    for r in rows:
        sizes[r.shard] += r.size
    ordered = groups_in_order(many)
    assert max(sizes) == least_largest([b for _, b in ordered], shards)
    text = {r.doc_id: (r.text or "") for r in many.collect()}
    shard_of = {}
    for r in rows:
        shard_of.setdefault(hashlib.sha256(text[r.id].encode()).digest(), set()).add(r.shard)
    assert all(len(s) == 1 for s in shard_of.values())
    along = [min(shard_of[d]) for d, _ in ordered]
    assert along == sorted(along) and (shards == 1 or min(sizes) > 0)


def test_a_group_of_a_third_of_all_bytes(spark):
    rows = [(i, "hot text " * 3 if i % 3 == 0 else f"{i} " + "y" * 20) for i in range(6000)]
    out = checked(spark.createDataFrame(rows, "doc_id long, text string"), 8)
    sizes = [sum(r.size for r in out if r.shard == k) for k in range(8)]
    hot = sum(r.size for r in out if r.id % 3 == 0)
    assert max(sizes) == hot and sizes[0] == hot  # alone in its shard
    rest = sizes[1:]
    assert max(rest) - min(rest) <= 60


def test_shards_of_odd_rows(odd, none):
    rows = checked(odd, 8)
    assert len(rows) == odd.count()
    assert S.shard(none).collect() == []
    one = checked(odd.filter("doc_id = 7"), 8)
    assert {r.shard for r in one} == {0} and sorted(r.slot for r in one) == [0, 1]
    assert checked(odd.filter("text IS NULL OR text = ''").withColumn("doc_id", F.lit(None).cast("long")), 4)


def test_no_python_on_the_way(many):
    plan = S.shard(many)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
