import hashlib
import itertools
import zlib

import numpy as np

from wardline.llm import sharding

from .conftest import HARD


def brute(sizes, shards):
    """The smallest largest part over all contiguous partitions."""
    best = sum(sizes)
    for cuts in itertools.combinations(range(len(sizes) + 1), shards - 1):
        at = [0, *cuts, len(sizes)]
        best = min(best, max(sum(sizes[a:b]) for a, b in itertools.pairwise(at)))
    return best


def test_capacity_equals_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(60):
        sizes = rng.integers(1, 50, rng.integers(1, 9))
        assert sharding.minimax_capacity(sizes, 3) == brute(list(sizes), 3)


def test_even_cuts_keep_the_capacity():
    rng = np.random.default_rng(9)
    for n in (1, 3, 40, 500):
        for _ in range(20):
            sizes = rng.integers(1, 100, n) * rng.choice([1, 1, 1, 30], n)
            for shards in (1, 4, 40):
                capacity = sharding.minimax_capacity(sizes, shards)
                ends = sharding.even_cuts(sizes, shards, capacity)
                parts = [sizes[a:b].sum() for a, b in itertools.pairwise([0, *ends])]
                assert ends[-1] == n and max(parts) == capacity
    ends = sharding.even_cuts(np.ones(4000, np.int64), 40, 110)
    assert set(np.diff([0, *ends])) == {100}


def test_cuts_lie_in_the_open_segments():
    rng = np.random.default_rng(4)
    for _ in range(50):
        sizes = rng.integers(1, 1000, 2000)
        coarse = np.add.reduceat(sizes, np.arange(0, 2000, 10))
        low, high = max(sizes.max(), -(-sizes.sum() // 7)), sharding.minimax_capacity(coarse, 7)
        hit = sharding.may_cut(coarse, low, high, 7)
        for capacity in range(low, high + 1, max(1, (high - low) // 20)):
            ends = sharding.greedy_cuts(sizes, 7, capacity)
            assert ends is None or all(e % 10 == 0 or hit[e // 10] for e in ends)


def check(got, texts, shards):
    sizes = sorted(got["size"])
    assert sizes == sorted(len((t or "").encode()) + 16 for t in texts)
    for _, s in got.groupby("shard"):
        assert sorted(s["slot"]) == list(range(len(s)))
    groups = {}
    for t in texts:
        raw = (t or "").encode()
        k = int(hashlib.sha256(raw).hexdigest()[:15], 16)
        groups[k] = groups.get(k, 0) + len(raw) + 16
    ordered = np.array([groups[k] for k in sorted(groups)])
    assert got.groupby("shard")["size"].sum().max() <= sharding.minimax_capacity(ordered, shards)


def test_op10(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()
    got = sharding.op10_minimax_shards(spark, sf_dir).toPandas()
    check(got, docs["text"], 40)
    assert got["shard"].between(0, 39).all() and (got["law"] == "bytes").all() and got["grown_shard"].isna().all()
    both = got.merge(docs, on="doc_id")
    assert (both["text_crc32"] == [zlib.crc32(t.encode()) for t in both["text"]]).all()
    assert both.groupby("text")["shard"].nunique().max() == 1


def test_refining_gives_the_same(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    monkeypatch.setattr(sharding, "MOST_SEGMENTS", 256)
    check(sharding.shards_by_bytes(docs, 5).toPandas(), docs.toPandas()["text"], 5)


def test_hard_rows(spark, hard):
    check(sharding.shards_by_bytes(hard, 3).toPandas(), [t for _, t in HARD], 3)
    assert sharding.shards_by_bytes(hard.limit(0)).count() == 0
