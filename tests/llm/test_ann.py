import math

import numpy as np
from pyspark.sql import functions as F

from wardline.llm import ann


def brute(rows, k):
    """rows: (id, vector) fit to take part, each once."""
    x = np.array([v for _, v in rows], np.float64)
    ids = np.array([i for i, _ in rows])
    out = {}
    for q in range(len(rows)):
        if ids[q] % 20 == 0:
            s = (x * x[q]).sum(axis=1)
            out[int(ids[q])] = [(int(ids[i]), s[i]) for i in np.lexsort((ids, -s)) if ids[i] != ids[q]][:k]
    return out


def result(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_op1_on_a_whole_table(spark, sf_dir):
    """No table is small enough to be searched whole: recall is that of the trees; what is returned has its exact score and place."""
    vectors = {r["vec_id"]: np.array(r["embedding"], np.float64) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    got, want = result(ann.op1_projection_forest(spark, sf_dir)), brute(list(vectors.items()), 20)
    assert got.keys() == want.keys()
    assert recall_of(got, want) >= 0.9
    for q, hits in got.items():
        assert len(hits) == 20 and q not in [i for i, _ in hits]
        assert hits == sorted(hits, key=lambda h: (-h[1], h[0]))
        assert all(math.isclose(s, (vectors[q] * vectors[i]).sum(), rel_tol=1e-12, abs_tol=1e-15) for i, s in hits)


def recall_of(got, want):
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / max(1, len(want[q])) for q in want])


def test_recall(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 24)) * rng.uniform(0.5, 2, (6000, 1))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    got, want = result(ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0)), brute(rows, 20)
    assert all(len(v) == 20 for v in got.values()) and got.keys() == want.keys()
    assert recall_of(got, want) >= 0.9


def test_levels_below_the_sample_and_a_hot_vector(spark, monkeypatch):
    """Deeper trees than the sample fits, many parts in pieces, a third of all rows one vector, many ties."""
    rng = np.random.default_rng(7)
    monkeypatch.setattr(ann, "SAMPLE", 512)
    monkeypatch.setattr(ann, "PART_ROWS", 2000)
    centre = rng.normal(size=(150, 16))
    x = (centre[rng.integers(0, 150, 4000)] + 0.6 * rng.normal(size=(4000, 16))).round(1)
    x[::3] = x[0]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got, want = result(ann.search(df, F.col("vec_id") % 20 == 0)), brute(rows, 20)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert recall_of(got, want) >= 0.85
    # copies of the hot vector are answered by the ones with the smallest ids
    copies = [i for i in range(0, 4000, 3)][:21]
    for q in (q for q in want if q % 3 == 0):
        mine = [i for i, _ in got[q] if i % 3 == 0]
        assert mine == [i for i in copies if i != q][: len(mine)]


def test_the_queue_hands_out_leaves_by_their_sum_of_margins():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(600, 8))
    f = ann.fit(x[:100], float(np.sqrt((x * x).sum(axis=1).max())), len(x), trees=3, leaf=8)
    assert f.low_normals.shape[1] > 0
    q = rng.normal(size=(4, 8))
    for vec, order in zip(np.hstack([q, np.zeros((4, 1))]), f.queue(q), strict=True):
        sums = {}
        for t in range(3):
            for leaf in range(2**f.depth):
                node, total, fitted = leaf + 2**f.depth - 1, 0.0, f.depth - f.low_normals.shape[1]
                while node:
                    up = (node - 1) // 2
                    level = (up + 1).bit_length() - 1
                    n, o = (f.normals[t, up], f.offsets[t, up]) if level < fitted else (f.low_normals[t, level - fitted], f.low_offsets[t, level - fitted])
                    total += (vec @ n - o) * (1 if node % 2 == 0 else -1)
                    node = up
                sums[leaf + (t << f.depth)] = total
        order = list(order)
        assert sorted(order) == sorted(sums)
        got = [sums[x] for x in order]
        assert all(a >= b - 1e-4 for a, b in zip(got[:-1], got[1:], strict=True))


def test_ties_and_copies(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(5, 4)).round(1)
    rows = [(i, [float(c) for c in base[i % 5]]) for i in range(300)]
    got, want = result(ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0)), brute(rows, 20)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}


def test_unfit_and_repeated_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (1, [2.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, None]), (None, [1.0, 1.0]), (20, [1.0]), (40, [3.0, 3.0]), (7, [])]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<double>, rank int, score string")
    got = result(ann.search(df, F.col("vec_id") % 20 == 0))
    assert got == {0: [(40, 9.0), (1, 4.0)], 40: [(0, 9.0), (1, 9.0)]}
    assert ann.search(df.limit(0), F.lit(True)).count() == 0
