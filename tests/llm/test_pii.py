import hashlib
import re

import numpy as np
import pytest

from wardline.llm import pii

from .conftest import HARD

#: The patterns as they are given.
PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def brute(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m.group())
            double = sum(int(c) if j % 2 == 0 else sum(map(int, str(2 * int(c)))) for j, c in enumerate(reversed(d)))
            good = [True, all(int(x) <= 255 for x in m.group().split(".")) if k == 1 else False, 14 <= len(d) <= 19 and double % 10 == 0, 10 <= len(d) <= 15][k]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_patterns_equal_brute_force():
    rng = np.random.default_rng(1)
    for n in rng.integers(0, 40, 5000):
        text = "".join(rng.choice(list("a@.1 2+-()b9\n%é"), n))
        assert pii.base_spans(text) == brute(text)
    assert pii.base_spans("9" * 5000 + "@") == brute("9" * 5000 + "@")


@pytest.fixture(scope="module")
def field(spark):
    return pii.learn(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_messages_are_exact_on_a_tree():
    rng = np.random.default_rng(2)
    n = len(pii.LABELS)
    a, b = rng.normal(size=(2, n, n))
    f = pii.Field(rng.normal(size=(n, pii.FEATURES)), a + a.T, b + b.T)
    x, chain, skip = rng.normal(size=(3, pii.FEATURES)), np.array([[0, 1]]), np.array([[0, 2]])
    local = x @ f.unary.T
    joint = np.exp(local[0][:, None, None] + local[1][None, :, None] + local[2][None, None] + f.chain[:, :, None] + f.skip[:, None])
    joint /= joint.sum()
    settled, pii.SETTLED = pii.SETTLED, 1e-12
    got = f.marginals(x, chain, skip)
    pii.SETTLED = settled
    assert np.allclose(got, [joint.sum(axis=(1, 2)), joint.sum(axis=(0, 2)), joint.sum(axis=(0, 1))], atol=1e-6)


def test_repetitions_share_their_label(field):
    text = "Call +1 (407) 555-7710 now; later 1 407 555 7710, or not. At 161.17.88.162 and 12345678."
    (base, spans), = pii.find([text], field)
    assert [text[a:b] for a, _, b in base] == ["+1 (407) 555-7710", "161.17.88.162"]
    assert "1 407 555 7710" in [text[a:b] for a, k, b in spans if k == 3]
    assert set(base) <= set(spans) and "12345678" not in [text[a:b] for a, _, b in spans]
    alone, = pii.find(["later 1 407 555 7710, or not"], field)
    assert alone == ([], [])


def test_fifty_repetitions_share_their_label(field):
    filler = " It was a long day and nothing else was said about it." * 20
    text = "Call +1 (407) 555-7710 now." + (filler + " Later 1 407 555 7710, or not.") * 50
    (base, spans), = pii.find([text], field)
    assert len(base) == 1
    assert [text[a:b] for a, k, b in spans if k == 3] == ["+1 (407) 555-7710"] + ["1 407 555 7710"] * 50
    # where a repetition by itself looks like none, only what is certain makes it a phone number
    n = len(pii.LABELS)
    wary = pii.Field(np.zeros((n, pii.FEATURES)), np.zeros((n, n)), 6 * np.eye(n))
    wary.unary[0, 0] = 2
    (_, spans), = pii.find([text], wary)
    assert len(spans) == 51
    assert pii.find([text.replace("+1 (407) 555-7710", "me")], wary) == [([], [])]


@pytest.mark.parametrize("n", [2, 5, 9, 12, 20, 40])
def test_every_repetition_has_the_label_of_the_whole_one(field, n):
    text = "+1 (407) 555-7710 is here." + " And 1 407 555 7710 is there." * n
    (base, spans), = pii.find([text], field)
    assert len(base) == 1 and len(spans) == n + 1


def held_out():
    """Texts that the field wasn't trained on, each with a broken repetition of what it holds, and with a broken number of its own."""
    import duckdb

    texts = [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.1/documents.parquet' WHERE doc_id >= 1000 AND regexp_matches(text, '[0-9@]') ORDER BY doc_id").fetchall()]
    rng = np.random.default_rng(4)
    for text in texts:
        for a, kind, b in pii.base_spans(text):
            whole = text[a:b]
            other = "".join(rng.choice(list("0123456789")) if c.isdigit() else c for c in whole)
            for shape in range(pii.SHAPES):
                yield kind, whole, text, pii.weaken(whole, shape), pii.weaken(other, shape)


def test_broken_repetitions_are_found_and_broken_numbers_alone_are_not(field):
    found, wrong, n, alone = np.zeros(4), 0, np.zeros(4), 0
    for kind, _, text, again, other in held_out():
        if not pii.base_spans(f"Or {again} it"):  # else the patterns find it by themselves
            own = f"{text} Or {again} it"
            n[kind] += 1
            (base, spans), = pii.find([own], field)
            assert base == pii.base_spans(own) and set(base) <= set(spans)
            place = len(text) + 4
            found[kind] += any(k == kind and a < place + len(again) and place < b for a, k, b in spans)
        if kind and not pii.luhn(pii.digits_of(pii.key(other))) and not pii.base_spans(f"Or {other} it"):  # a number with a right check digit is one
            own = f"{text} Or {other} it"
            alone += 1
            (base, spans), = pii.find([own], field)
            wrong += len(spans) > len(base)
    print("recall by kind", found / n, "of", n, "false", wrong, "of", alone)
    assert (found / n).min() > 0.8 and found.sum() / n.sum() > 0.85 and wrong / alone < 0.03


def test_long_texts_take_time_in_proportion():
    text = " ".join(f"+1 407 555 {k:04d} and 10.0.{k % 256}.7" for k in range(4000))
    spans, places = pii.base_spans(text), pii.candidates(text)
    assert len(spans) == 8000 and all(pii.pattern_labels(spans, places))


def test_edges_are_linear_and_reach_a_last_sign():
    tokens = ["1 407 555 7710"] * 20 + ["+1 (407) 555-7710"] + ["1 407 555 7710"] * 20 + ["1 407 555 7711"]
    edges = pii.skip_edges(tokens, [0] * 20 + [4] + [0] * 21)
    assert edges == [(k, 20) for k in range(20)] + [(20, k) for k in range(21, 42)]


def test_masking():
    assert pii.masked("mail a@b.c or +1 234", [(5, 0, 10), (14, 3, 20)]) == "mail [EMAIL] or [PHONE]"


def test_op7(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = pii.op7_skip_chain_crf(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = brute(docs[r["doc_id"]])
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x == j for _, x, _ in want) for j in range(4)]
        assert set(filter(None, text.split(","))) <= set(r["spans"].split(","))


def test_hard_rows(spark, hard, field):
    rows = pii.detect(hard, field).collect()
    assert len(rows) == len(HARD) and all(r["spans"] == "" for r in rows)
    masked = pii.mask(hard, field)
    assert masked.columns == hard.columns and sorted(str(r["text"]) for r in masked.collect()) == sorted(str(t) for _, t in HARD)
    assert pii.detect(hard.limit(0), field).count() == 0
    assert pii.learn(hard.limit(0)).unary[0, 0] > 0
