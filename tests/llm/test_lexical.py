import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex

from wardline.llm import lexical

PATTERN = regex.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return PATTERN.findall("".join(c.lower() if c < "\x80" else c for c in text or ""))


def brute(docs, items, k):
    """The contract, document by document."""
    found = [(i, Counter(terms(t))) for i, t in docs]
    found = [(i, c) for i, c in found if c]
    n_docs, n_terms = len(found), sum(c.total() for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item_id, text in items:
        rows = []
        for i, c in found:
            m = 25 + (75 * c.total() * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if score > 0:
                rows.append((-score, -math.inf if i is None else i))
        out += [(item_id, r, None if i == -math.inf else i, -s) for r, (s, i) in enumerate(sorted(rows)[:k], 1)]
    return sorted(out, key=repr)


def collected(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=repr)


def test_terms():
    text = "Ab_c9 Éa b x\U0001f600Y\n--ÀB@[`{\x7f" * 3
    assert lexical.term_counts(text) == Counter(t.encode() for t in terms(text))
    assert lexical.term_counts("aB " * 700_000) == {b"ab": 700_000}


def some_block(rng, n, n_terms):
    rows = [sorted(rng.sample(range(n_terms), rng.randint(1, n_terms))) for _ in range(n)]
    return np.arange(n), np.array([rng.randint(25, 400) for _ in rows]), [np.array(r, np.int32) for r in rows], [np.array([rng.choice([1, 1, 2, 9]) for _ in r], np.int32) for r in rows]


@pytest.mark.parametrize("leaf", [1, 3, 48])
def test_bounds_hold_below_every_node(leaf):
    rng = random.Random(leaf)
    for n in (1, 2, 60, 300):
        tree = lexical.Tree(*some_block(rng, n, 7), leaf=leaf)
        weight = np.array([rng.choice([0, 1, 50, 4000]) for _ in range(7)])
        exact, bounds = tree.documents.scores(weight, 0, n), tree.nodes.scores(weight, 0, len(tree.first))

        def below(k):
            if tree.leaf[k]:
                return list(range(tree.first[k], tree.last[k]))
            return [d for c in range(tree.first[k], tree.last[k]) for d in below(c)]

        assert below(0) == list(range(n))
        assert all(exact[below(k)].max() <= bounds[k] for k in range(len(bounds)))
        best, order = lexical.Best(5), np.lexsort([tree.ids, -exact])[:5]
        tree.search(weight, best)
        order = order[exact[order] > 0]
        assert best.ids.tolist() == tree.ids[order].tolist() and best.score.tolist() == exact[order].tolist()


def test_branches_are_left_out():
    """Documents with an item's rare terms end the search of the others."""
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 200, 20)).astype(np.int32) for _ in range(4000)]
    for k in range(12):
        rows[37 * k] = np.unique(np.concatenate([rows[37 * k], np.arange(200, 212)])).astype(np.int32)
    tree, best, weight = lexical.Tree(np.arange(4000), np.full(4000, 100), rows, [np.ones(len(r), np.int32) for r in rows]), lexical.Best(10), np.zeros(212, np.int64)
    weight[[0, 1, 2, *range(200, 212)]] = [500, 500, 500, *[6000] * 12]
    assert tree.search(weight, best) < 1000


def test_search_equals_brute_force(spark, hard, monkeypatch):
    rng, words = random.Random(4), ["the", "idea", "of", "Ä", "ä", "test", "x1", "word", *[f"t{k}" for k in range(40)]]
    rows = [(r["doc_id"], r["text"]) for r in hard.collect()]
    rows += [(i, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(300)]
    rows += [(i, "The idea of a test.") for i in range(900, 1500)]
    items = [(1, "the idea of a test, The test"), (2, None), (3, ""), (4, "zzz unknown"), (5, "t1 t2 t3 t3 Ä"), (5, "x1"), (None, "word x 日本語"), (6, " ".join(words))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    asked = spark.createDataFrame(items, "item_id long, text string")
    want = brute(rows, items, 10)
    assert collected(lexical.ranked_search(docs, asked)) == want
    assert collected(lexical.ranked_search(docs, asked, item_bytes=40)) == want
    monkeypatch.setattr(lexical, "LEAF", 2)
    assert collected(lexical.ranked_search(docs, asked, k=3)) == brute(rows, items, 3)


def test_empty_tables(spark, hard):
    items = spark.createDataFrame([(1, "the test")], "item_id long, text string")
    assert lexical.ranked_search(hard.limit(0), items).count() == 0
    assert lexical.ranked_search(hard, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
    assert lexical.ranked_search(hard, items.limit(0)).count() == 0
