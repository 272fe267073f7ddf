import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from wardline.llm import neardup as n

from .conftest import HARD


def bag(text):
    w = re.findall(r"\w+", text.lower())
    return Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def test_shingles_equal_their_definition():
    texts = ["", "one two", "A b c d e. a B c d, e a b c d e", "word " * 40, "é è ü ö ä é è ü ö ä!", "x"]
    h, before, bounds = n.shingles(texts)
    for t, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True):
        want = bag(t)
        own = Counter(h[a:b].tolist())
        assert sorted(own.values()) == sorted(want.values())
        assert sorted(before[a:b]) == sorted(k for c in want.values() for k in range(c))
    e = n.elements(h, before)
    assert all(len(set(e[a:b])) == b - a for a, b in zip(bounds[:-1], bounds[1:], strict=True))


def test_draws_agree_as_often_as_the_similarity():
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(4000)]
    a = list(rng.choice(words, 3000))
    b = a.copy()
    for k in rng.choice(3000, 60, replace=False):
        b[k] = "other"
    h, before, bounds = n.shingles([" ".join(a), " ".join(b)])
    e = n.elements(h, before)
    level = (h >> np.uint64(61)).astype(np.uint8)
    weights = 1 - np.arange(n.LEVELS) / (n.LEVELS - 1) * (1 - n.LEAST_WEIGHT)
    sets = [e[x:y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
    own = [weights[level[x:y]] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
    weighted = n.jaccard(sets[0], own[0], sets[1], own[1])
    weight = dict(zip(sets[0], own[0], strict=True)) | dict(zip(sets[1], own[1], strict=True))
    assert np.isclose(weighted, sum(weight[x] for x in set(sets[0]) & set(sets[1])) / sum(weight.values()))
    table = n.sampling_table(weights)
    low, same = e & np.uint64(0xFFFFFFFF), 0
    for k in range(120):
        entry = ((e * n._ODD[64 + k]) >> np.uint64(48)).astype(np.int64) + (level.astype(np.int64) << 16)
        drawn = np.minimum.reduceat(table[entry] | low, bounds[:-1])
        same += drawn[0] == drawn[1]
    assert abs(same / 120 - weighted) < 0.13


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (102, 101), (7, 3)]
    got = {r["node"]: r["comp"] for r in n.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 102: 100}


def classes(rows, links=None):
    """Components over weighted similarity of at least the threshold, by brute force; weights by the documents that hold a shingle."""
    bags = [bag(t or "") for _, t in rows]
    seen = Counter(x for b in bags for x in b)
    # the mean number of documents of a bucket of the hash: nearly all hold at most one shingle here
    usual = np.log1p(len(rows) / max(1.0, sum(seen.values()) / 2**n.DF_BITS))

    def weight(shingle):
        w = n.LEAST_WEIGHT + (1 - n.LEAST_WEIGHT) * min(1.0, np.log1p(len(rows) / seen[shingle]) / usual)
        step = round((1 - w) / (1 - n.LEAST_WEIGHT) * (n.LEVELS - 1))
        return 1 - step / (n.LEVELS - 1) * (1 - n.LEAST_WEIGHT)

    w = {x: weight(x) for x in seen}
    total = [sum(w[x] * c for x, c in b.items()) for b in bags]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            same = (rows[i][1] or "") == (rows[j][1] or "")
            if not same and min(total[i], total[j]) < n.THRESHOLD * max(total[i], total[j]):
                continue
            both = sum(w[x] * min(c, bags[j][x]) for x, c in bags[i].items() if x in bags[j])
            if same or (both and both / (total[i] + total[j] - both) >= n.THRESHOLD):
                if links is not None:
                    links.append((i, j))
                comp = [comp[j] if c == comp[i] else c for c in comp]
    return comp


def test_op8_equals_brute_force(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]
    got = {r["doc_id"]: r["class_id"] for r in n.op8_weighted_minhash(spark, sf_dir).collect()}
    comp = classes(rows)
    first = {}
    for (i, _), c in zip(rows, comp, strict=True):
        first.setdefault(c, i)
    assert got == {i: first[c] for (i, _), c in zip(rows, comp, strict=True)}


def test_a_chain_is_one_class(spark):
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(12):  # each is near the one before it, but the last is far from the first
        rows.append((k, " ".join(words)))
        for j in rng.choice(300, 4, replace=False):
            words[j] = f"v{k}x{j}"
    rows += [(50 + k, " ".join(f"u{k}y{j}" for j in range(60))) for k in range(5)]
    got = {r["doc_id"]: r["class_id"] for r in n.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {**{k: 0 for k in range(12)}, **{50 + k: 50 + k for k in range(5)}}


def family():
    """Edits round one template: most pairs just below the threshold, some of two edits of the same place above it."""
    rng = np.random.default_rng(5)
    words, rows = [f"w{k}" for k in range(400)], []
    for k in range(160):
        own = words.copy()
        for j in rng.choice(80, 5, replace=False):
            own[5 * j + 2] = f"x{k}y{j}"
        rows.append((k, " ".join(own)))
    return rows


def test_near_members_far_from_the_centre_are_one_class(spark):
    rows = family()
    want = classes(rows)
    got = {r["doc_id"]: r["class_id"] for r in n.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    first = {}
    for (i, _), c in zip(rows, want, strict=True):
        first.setdefault(c, i)
    assert len(first) < len(rows) / 2
    assert all(got[i] == got[first[c]] for (i, _), c in zip(rows, want, strict=True))


def edited_families():
    """Six families of 60 texts with 3 or 4 of 300 words changed: many pairs lie next to the threshold."""
    rng, rows = np.random.default_rng(11), []
    for f in range(6):
        words = [f"f{f}w{k}" for k in range(300)]
        for k in range(60):
            own = words.copy()
            for j in rng.choice(300, 3 if f % 2 else 4, replace=False):
                own[j] = f"x{f}y{k}z{j}"
            rows.append((100 * f + k, " ".join(own)))
    return rows


def test_no_link_of_families_next_to_the_threshold_is_lost(spark):
    rows, links = edited_families(), []
    classes(rows, links)
    got = {r["doc_id"]: r["class_id"] for r in n.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    together = np.mean([got[rows[i][0]] == got[rows[j][0]] for i, j in links])
    print(len(links), "links, recall", together)
    assert len(links) > 300 and together >= 0.99
    comp = classes(rows)
    for i in range(len(rows)):  # and none is made up
        for j in range(i):
            assert got[rows[i][0]] != got[rows[j][0]] or comp[i] == comp[j]


def test_hot_joins_equal_joins(spark, monkeypatch):
    from wardline.llm import common

    left = spark.createDataFrame([(None if k % 7 == 0 else 5 if k % 3 else k, k) for k in range(900)], "a long, x long")
    right = spark.createDataFrame([(k, 2 * k) for k in range(0, 900, 2)] + [(5, 1)], "a long, y long")
    for how in ("inner", "left"):
        want = sorted(left.join(right, ["a"], how).collect(), key=str)
        monkeypatch.setattr(common, "HOT_ROWS", 100)
        assert sorted(common.hot_join(left, right, ["a"], how).collect(), key=str) == want


def test_a_bucket_of_many_chunks_is_compared_whole(spark, monkeypatch):
    docs = spark.createDataFrame(family(), "doc_id long, text string")
    whole = sorted(n.near_duplicates(docs).select("doc_id", "class_id").collect())
    monkeypatch.setattr(n, "CHUNK", 16)
    assert sorted(n.near_duplicates(docs).select("doc_id", "class_id").collect()) == whole


def test_many_pairs_are_counted_as_one_by_one():
    h, before, bounds = n.shingles([t for _, t in family()[:40]])
    e, w = n.elements(h, before), np.where(h % np.uint64(3) == 0, 0.8, 1.0)
    pairs = np.array([(u, v) for u in range(40) for v in range(u)])
    one = [n.jaccard(e[bounds[u] : bounds[u + 1]], w[bounds[u] : bounds[u + 1]], e[bounds[v] : bounds[v + 1]], w[bounds[v] : bounds[v + 1]]) for u, v in pairs]
    for threshold in (0.7, 0.75, 0.8):
        assert n.similar((e, w, bounds), pairs, threshold).tolist() == [x >= threshold for x in one]


def test_hard_rows(spark, hard):
    found = n.near_duplicates(hard)
    rows = sorted(((r["doc_id"], r["class_id"]) for r in found.collect()), key=str)
    assert len(rows) == len(HARD)
    of = dict(rows)
    assert of[2] == 1 and of[4] == 3 and of[9] == 9 and of[None] is None
    kept = n.keep_one(hard)
    assert kept.columns == hard.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "None", "3", "5", "6", "7", "8", "9", "10"])
    assert n.near_duplicates(hard.limit(0)).count() == 0
    assert n.keep_one(hard.filter(F.lit(False))).count() == 0
