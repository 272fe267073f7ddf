import random
import zlib
from collections import Counter

import pandas as pd
import pytest
import regex

from wardline.llm import spelling


def near(a, b):
    if len(a) == len(b):
        return sum(p != q for p, q in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def some_words(rng, letters, longest, n):
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, longest))) for _ in range(n)})


def test_search_finds_every_word_one_edit_away():
    rng = random.Random(3)
    for _ in range(60):
        words = some_words(rng, "abcÿ"[: rng.randint(1, 4)], 9, rng.choice([1, 3, 80]))
        index = spelling.Bidirectional(words)
        for first in (True, False):
            query, found = spelling.search(index, words, first)
            own = {(a, b) for a in words for b in words if near(a, b) and (b.startswith(a[: len(a) // 2]) if first else b.endswith(a[len(a) // 2 :]))}
            assert {(words[i], words[j]) for i, j in zip(query, found, strict=True)} == own


def test_intervals_of_text_and_reverse_agree():
    rng = random.Random(5)
    words = some_words(rng, "abc", 6, 50)
    text = "\0" + "\0".join(words) + "\0"
    index, suffixes = spelling.Bidirectional(words), sorted(text[i:] for i in range(len(text)))
    backwards = sorted(text[::-1][i:] for i in range(len(text)))
    for _ in range(200):
        pattern, at = "", index.whole(1)
        for _ in range(4):
            left, c = rng.random() < 0.5, rng.choice("abc")
            pattern = c + pattern if left else pattern + c
            at = index.extend(left, index.symbols(pd.Series([ord(c)]).to_numpy()), *at)
        size = sum(s.startswith(pattern) for s in suffixes)
        assert at[2][0] == size
        if size:
            assert suffixes[at[0][0]].startswith(pattern) and (at[0][0] == 0 or not suffixes[at[0][0] - 1].startswith(pattern))
            assert backwards[at[1][0]].startswith(pattern[::-1]) and (at[1][0] == 0 or not backwards[at[1][0] - 1].startswith(pattern[::-1]))


def brute_counts(rows, least, drop):
    found = Counter()
    for doc_id, text in rows:
        for run in regex.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            word = run if h % drop else run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(word) >= least:
                found[word] += 1
    return found


def brute_forms(counts, ratio):
    near_of = {a: [b for b in counts if near(a, b)] for a in counts}
    best = {a: min(v, key=lambda b: (-counts[b], b)) for a, v in near_of.items() if v}
    form = {a: b for a, b in best.items() if counts[b] >= ratio * counts[a]}
    out = set()
    for a in counts:
        root = a
        while root in form:
            root = form[root]
        out.add((a, counts[a], len(near_of[a]), form.get(a), counts.get(form.get(a)), root))
    return out


def collected(df):
    return {(r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect()}


@pytest.mark.parametrize("block_chars", [1 << 18, 60])
def test_forms_equal_brute_force(spark, block_chars):
    """Small blocks part the halves that many words share."""
    rng = random.Random(11)
    words = {w: rng.choice([5, 5, 6, 30, 200, 2000, 20_000]) for w in some_words(rng, "abé", 5, 250)}
    words |= {"same" + w: n for w, n in list(words.items())[:60]}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = spelling.spelling_forms(df, block_chars=block_chars)
    assert got.count() == len(words)
    assert collected(got) == brute_forms(words, spelling.RATIO)


def test_counts_and_variants_of_hard_texts(spark, hard):
    rows = [(r["doc_id"], r["text"]) for r in hard.collect()]
    rows += [(i, f"Straße STRASSE naïveté {'house' * (i % 3)} wörterbuch× ÷{'Ab' * 4} x{chr(0x100)}y {chr(0x1F600)}") for i in range(100, 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for drop in (spelling.DROP, 3):
        counts = brute_counts(rows, 6, drop)
        assert dict(spelling.word_counts(df, 6, drop).toPandas().itertuples(index=False)) == counts
        got = spelling.spelling_variants(df, drop=drop)
        assert collected(got) == brute_forms({w: n for w, n in counts.items() if n >= 5}, 5)


def test_empty_table(spark, hard):
    got = spelling.spelling_variants(hard.limit(0))
    assert got.columns == ["word", "n", "n_near", "form", "form_n", "root"] and got.count() == 0
