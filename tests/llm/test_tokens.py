import array
import bisect
import hashlib
import unicodedata
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wardline.llm import bytebpe, idstream, packing, wordtok

from .conftest import HARD

WORDS, RANKS = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(WORDS)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def test_word_ids_equal_the_library(docs, library):
    w = wordtok.WordIds(WORDS)
    odd = ["", "a.b, c.,  d .. e", "Σας ΑΣ, É.\nÎ", "«mot», mot.", "it's 12,5.\n3.", "_, _.", "K Å ǅ.", "á x, \x1c, y"]
    for t in [*docs["text"][:60], *odd, *(t for _, t in HARD)]:
        assert w.encode(t or "") == packed(library(t))


def test_block_code_round_trip():
    rng = np.random.default_rng(1)
    for ids in (np.array([5]), rng.zipf(1.3, 5000) % 49_000, rng.integers(0, 200_000, 100_001), np.arange(70_000)):
        assert (idstream.decode_ids(*idstream.encode_ids(ids), len(ids)) == ids).all()
    assert len(idstream.encode_ids(np.zeros(8, np.int64))[1]) == 2


def test_words_of_letters_and_signs_equal_the_library(library):
    w, rng = wordtok.WordIds(WORDS), np.random.default_rng(8)
    letters = [chr(k) for k in [*range(33, 127), *range(0xC0, 0x250), 0xAA, 0xB5, 0xBA, 0xD7, 0xF7, 0x3A3, 0x130]]
    for n in rng.integers(1, 12, 4000):
        t = "".join(rng.choice(letters, n))
        assert w.encode(t) == packed(library(t)), t


def test_every_character_equals_the_library(library):
    """Before and after signs, white space and letters, those included that become a letter and a mark or join the mark after them."""
    w = wordtok.WordIds(WORDS)
    assigned = [c for c in map(chr, range(0x110000)) if unicodedata.category(c) not in ("Cs", "Co", "Cn")]
    bad = [hex(ord(c)) for c in assigned if w.encode(t := f"A{c}, {c}. H{c}b,\n.{c}. J{c}.\n{c}X, 'S") != packed(library(t))]
    assert bad == []
    for t in ("Tarih: 1923, MECLİSİ, ANKARA", "Otel KADİ, İSTANBULİ, ve EVİ. Geldi", "J\u030c, H\u0331. T\u0308\n \u0301x, .\u0301"):
        assert w.encode(t) == packed(library(t))


def test_held_words_are_bounded(docs):
    w = wordtok.WordIds(WORDS, most_bytes=20_000)
    for t in [*docs["text"][:50], "x" * 100_000, "日本語" * 30_000]:
        w.encode(t or "")
        assert w.bytes < 20_000 + 250 * 1 + 400 * len((t or "").split())
    assert all(len(k) <= wordtok.MOST_WORD for k in w)


def test_ids_files(spark, hard, library, tmp_path):
    idstream.write_ids(hard, WORDS, f"file://{tmp_path}/f", block_ids=1000)
    got = idstream.read_ids(spark, f"file://{tmp_path}/f").toPandas().sort_values("start")
    want = sorted(((-1 if i is None else i, [*library(t), 1]) for i, t in HARD), key=lambda x: x[0])
    assert [-1 if pd.isna(x) else int(x) for x in got["doc_id"]] == [i for i, _ in want]
    assert [list(x) for x in got["ids"]] == [x for _, x in want]
    assert list(got["start"]) == list(np.cumsum([0] + [len(x) for _, x in want[:-1]]))


def test_files_stand_in_the_order_of_ids(spark, tmp_path, monkeypatch):
    """A third of the rows have no id, a third the same one, and each file holds the ids after those of the one before."""
    monkeypatch.setattr(idstream, "BUCKET_DOCS", 100)
    rows = [(None if k % 3 == 0 else 77_000 if k % 3 == 1 else 40 * k, f"text {k} of many") for k in range(3000)]
    idstream.write_ids(spark.createDataFrame(rows, "doc_id long, text string"), WORDS, f"file://{tmp_path}/f")
    seen, sizes = [], []
    for path in sorted((tmp_path / "f").glob("part-*")):
        blocks = pd.read_parquet(path)
        assert blocks[["bucket", "block"]].apply(tuple, axis=1).is_monotonic_increasing
        heads = np.concatenate([np.frombuffer(x, "<i8").reshape(-1, 3) for x in blocks["docs"]])
        seen += [-1 if not known else int(i) for i, known, _ in heads]
        sizes.append(len(heads))
    assert seen == sorted(seen) and len(seen) == 3000 and max(sizes) < 250
    got = idstream.read_ids(spark, f"file://{tmp_path}/f").toPandas().sort_values("start")
    assert [-1 if pd.isna(i) else int(i) for i in got["doc_id"]] == seen


def test_ids_files_of_nothing(spark, hard, tmp_path):
    idstream.write_ids(hard.limit(0), WORDS, f"file://{tmp_path}/f")
    assert idstream.read_ids(spark, f"file://{tmp_path}/f").count() == 0


def test_op4(spark, sf_dir, docs, library):
    got = idstream.op4_ranked_varint_ids(spark, sf_dir).toPandas().sort_values("doc_id")
    ids = [packed([*library(t), 1]) for t in docs.sort_values("doc_id")["text"]]
    assert list(got["n_tokens"]) == [len(x) // 4 for x in ids]
    assert list(got["ids_crc32"]) == [zlib.crc32(x) for x in ids]
    assert list(got["start"]) == list(np.cumsum([0, *got["n_tokens"][:-1]]))


def test_tree_bpe_equals_tiktoken(docs):
    b = bytebpe.tree_bpe(RANKS, public_tokenizers.PATTERN)
    k = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=b.ranks, special_tokens={})
    rng = np.random.default_rng(3)
    made = ["".join(rng.choice(list("ab c\n\t!?1\x1c　é'ts,."), n)) for n in rng.integers(0, 60, 2000)]
    made += ["".join(rng.choice(list("theingonaw"), n)) for n in rng.integers(20, 300, 200)]
    for t in [*docs["text"][:60], *made, *(t or "" for _, t in HARD)]:
        ids = b.encode(t)
        assert ids == array.array("I", k.encode_ordinary(t)).tobytes()
        assert b.decode(ids) == t.encode()


def test_join_is_the_monoid_product():
    b = bytebpe.tree_bpe(RANKS, public_tokenizers.PATTERN)
    for word in ("thintertionable", "zzzzzzzzzzzz", "überraschungen"):
        raw = word.encode()
        assert all(b.join(b.merge(raw[:k]), b.merge(raw[k:])) == b.merge(raw) for k in range(len(raw) + 1))


def test_op5(spark, sf_dir, docs, hard):
    got = bytebpe.op5_tree_bpe(spark, sf_dir).toPandas().set_index("doc_id")
    assert list(got.loc[docs["doc_id"], "decoded_sha256"]) == [hashlib.sha256(t.encode()).hexdigest() for t in docs["text"]]
    rows = bytebpe.encode_documents(hard, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted(bytes(r["decoded"]) for r in rows) == sorted((t or "").encode() for _, t in HARD)
    assert bytebpe.encode_documents(hard.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_op5_equals_tiktoken_on_every_row(spark, sf_dir, docs):
    b = bytebpe.tree_bpe(RANKS, public_tokenizers.PATTERN)
    k = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=b.ranks, special_tokens={})
    got = bytebpe.op5_tree_bpe(spark, sf_dir).toPandas().set_index("doc_id").loc[docs["doc_id"]]
    ids = [packed(k.encode_ordinary(t or "")) for t in docs["text"]]
    assert list(got["n_tokens"]) == [len(x) // 4 for x in ids]
    assert list(got["ids_sha256"]) == [hashlib.sha256(x).hexdigest() for x in ids]


def test_decoding_goes_up_the_tree():
    b = bytebpe.tree_bpe(RANKS, public_tokenizers.PATTERN)
    rng = np.random.default_rng(6)
    for n in (0, 1, 255, 256, 257, 1000, 5000):
        ids = rng.integers(0, 50_256, n)
        assert b.decode(packed(ids)) == b"".join(b.bytes_of[i] for i in ids.tolist())


def best_fit_decreasing(lengths, capacity):
    """Sequences that a second packer needs, piece by piece."""
    free, sequences = [], 0
    for n in sorted(lengths, reverse=True):
        k = bisect.bisect_left(free, n)
        if k == len(free):
            sequences += 1
            left = capacity - n
        else:
            left = free.pop(k) - n
        bisect.insort(free, left)
    return sequences


def test_patterns_need_no_more_sequences_than_best_fit():
    rng = np.random.default_rng(5)
    for k in range(14):
        many = int(rng.integers(20, 3000))
        kind = [rng.integers(1, 4097, many), np.minimum(4096, rng.lognormal(6, 1.2, many).astype(int) + 1), rng.choice([700, 1300, 2049, 1365, 4000], many), np.minimum(4096, (rng.pareto(1.1, many) * 200).astype(int) + 1)][k % 4]
        n, c = np.unique(kind, return_counts=True)
        _, sequences = packing.plan_sequences(dict(zip(n.tolist(), c.tolist(), strict=True)))
        assert sequences <= best_fit_decreasing(kind.tolist(), 4096), (k, many, sequences)


def whole(rows, capacity):
    """Every sequence is filled from 0 without gaps or overlaps, up to the capacity."""
    for _, s in rows.sort_values("offset").groupby("sequence_id"):
        assert list(s["offset"]) == [0, *np.cumsum(s["length"])[:-1]]
        assert s["length"].sum() <= capacity
    assert sorted(rows["sequence_id"].unique()) == list(range(rows["sequence_id"].nunique()))


def test_patterns_fill_the_capacity():
    found = packing.patterns(12, 3)
    assert all(sum(p) == 12 and len(p) <= 3 for p in found) and len(found) == len(set(found)) == 1 + 6 + 12


def test_fit_meets_a_feasible_histogram():
    options = packing.patterns(16, 3)
    truth = np.zeros(len(options))
    truth[[3, 9, 20]] = (50, 70, 10)
    counts = np.zeros(16)
    for x, p in zip(truth, options, strict=True):
        for b in p:
            counts[b - 1] += x
    x = packing.fit_counts(counts, options)
    made = np.zeros(16)
    for y, p in zip(x, options, strict=True):
        for b in p:
            made[b - 1] += y
    assert np.abs(made - counts).max() < 1


@pytest.mark.parametrize("lengths", [[], [4096], [1] * 5000, [2048] * 3, [3000, 1096] * 40, list(range(1, 4097))])
def test_plan_is_near_the_bound(lengths):
    n, c = np.unique(lengths, return_counts=True)
    runs, sequences = packing.plan_sequences({int(a): int(b) for a, b in zip(n, c, strict=True)})
    assert runs["n"].sum() == len(lengths)
    assert sequences <= -(-sum(lengths) // 4096) * 1.02 + 2


def test_op9(spark, sf_dir, docs, library):
    got = packing.op9_pattern_packing(spark, sf_dir).toPandas()
    whole(got, 4096)
    ids = {i: [*library(t), 1] for i, t in zip(docs["doc_id"], docs["text"], strict=True)}
    for r in got.itertuples():
        assert r.ids_crc32 == zlib.crc32(packed(ids[r.doc_id][r.start : r.start + r.length]))
    assert got["length"].sum() == sum(map(len, ids.values()))
    assert (got["start"] == 4096 * got["piece"]).all()


def test_plan_of_a_given_table_is_as_short_as_can_be(spark, sf_dir):
    pieces = packing.token_pieces(spark.read.parquet(f"{sf_dir}/../sf0.1/documents.parquet"), WORDS)
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    least = -(-sum(n * c for n, c in histogram.items()) // packing.CAPACITY)
    assert packing.plan_sequences(histogram)[1] == least
    assert packing.Plan(histogram, packing.CAPACITY, {}, packing.BINS).next >= least


def test_packing_hard_rows(spark, hard):
    got = packing.pack_documents(hard, WORDS, 512).toPandas()
    whole(got, 512)
    assert len(got.drop_duplicates(["doc_id", "piece"])) < len(got)  # repeated rows are packed as often as they stand
    assert packing.pack_documents(hard.limit(0), WORDS).count() == 0
