import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from wardline.llm import packing, pii, toxicity

from .test_neardup import classes
from .test_pii import brute


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [k for k, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "personal_data", "packing"]
    kept = corpus_pipeline.drop_toxic(spark, docs, sf_dir)
    one = corpus_pipeline.drop_near_duplicates(spark, kept, sf_dir)
    clean = corpus_pipeline.mask_personal_data(spark, one, sf_dir)
    assert docs.columns == kept.columns == one.columns == clean.columns
    assert docs.count() >= kept.count() > one.count() == clean.count() > 100
    assert one.count() == one.select("text").distinct().count()
    assert clean.filter("n_chars <> length(text)").count() == 0
    assert clean.filter("text rlike '[a-z0-9]@[a-z]'").count() == 0


def test_run(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert got.groupby("sequence_id")["length"].sum().max() <= packing.CAPACITY
    assert list(got.columns)[:2] == ["doc_id", "piece"]


def test_run_equals_brute_force(spark, sf_dir):
    """Each decision by itself on the driver: scores, classes of the texts that are left, masked spans, ids of the library."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    rows = [r for r, s in zip(rows, model.score([t or "" for _, t in rows]), strict=True) if s < 0.5]
    first = {}
    for (i, t), c in zip(rows, classes(rows), strict=True):
        first.setdefault(c, (i, t))
    kept = sorted(first.values())
    field = pii.learn(spark.createDataFrame(kept, "doc_id long, text string"))
    tokenizer, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), set()
    for i, t in kept:
        (base, spans), = pii.find([t or ""], field)
        assert base == brute(t or "") and set(base) <= set(spans)
        masked, at = "", 0
        for a, k, b in spans:
            if a >= at:
                masked += (t or "")[at:a] + f"[{pii.KINDS[k].upper()}]"
            at = max(at, b)
        ids = np.array([*tokenizer.encode(masked + (t or "")[at:], add_special_tokens=False).ids, 1], "<u4")
        want |= {(i, k, k * 4096, len(x), zlib.crc32(x.tobytes())) for k in range(-(-len(ids) // 4096)) for x in [ids[4096 * k : 4096 * (k + 1)]]}
    got = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert set(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want and len(got) == len(want)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert list(s["offset"]) == [0, *np.cumsum(s["length"])[:-1]] and s["length"].sum() <= 4096


def test_run_on_hard_rows_and_on_none(spark, hard, tmp_path):
    for name, docs in (("hard", hard), ("none", hard.limit(0))):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
        got = corpus_pipeline.run(spark, str(tmp_path / name)).toPandas()
        kept = set(got["doc_id"].astype("Int64").dropna())
        assert kept == ({1, 3, 5, 6, 7, 8, 9, 10} if name == "hard" else set())
