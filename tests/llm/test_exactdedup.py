import hashlib
import string
import uuid

from pyspark.sql import functions as F

from wardline.llm import exactdedup
from wardline.llm.common import shared_dir

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def folder(spark):
    return f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"


def run(spark, source, store=None, **how):
    store = store or folder(spark)
    exactdedup.ingest(spark, source, store, **how)
    return exactdedup.resolve(spark, source, store).toPandas()


def check(got, rows):
    """Each group of equal texts keeps one row, that of the largest id; sizes count rows."""
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    largest = {k: max((i for i in v if i is not None), default=None) for k, v in groups.items()}
    want = sorted(((i, largest[k], len(v)) for k, v in groups.items() for i in v), key=repr)
    ids = [None if x != x else int(x) for x in got["doc_id"].astype(float)]
    keep = [None if x != x else int(x) for x in got["keep_id"].astype(float)]
    assert sorted(zip(ids, keep, map(int, got["group_size"]), strict=True), key=repr) == want
    assert all(i == k for i, k, kept in zip(ids, keep, got["kept"], strict=True) if kept)
    assert int(got["kept"].sum()) == len(groups)


def test_only_ascii_letters_are_lowered(spark):
    rows = [(c, "A" + chr(c)) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    got = spark.createDataFrame(rows, "c int, t string").select("c", exactdedup.lowered(F.col("t")).alias("l")).toPandas()
    assert [hex(c) for c, x in got.itertuples(index=False) if x != "a" + chr(c).translate(LOWER)] == []


def test_hard_rows(spark, hard):
    path = folder(spark)
    hard.write.parquet(path)
    got = run(spark, path)
    check(got, [(r["doc_id"], r["text"]) for r in hard.collect()])
    digest = {bytes(d) for d in got["digest"]}
    assert hashlib.sha256(b"").digest() in digest


def test_empty_table(spark, hard):
    path = folder(spark)
    hard.limit(0).coalesce(1).write.parquet(path)
    assert len(run(spark, path)) == 0


def test_state_is_kept_between_calls(spark):
    path, store = folder(spark), folder(spark)
    first = [(1, "One"), (5, "one"), (2, "two"), (3, "Ünd"), (4, "ünd")]
    later = [(9, "ONE"), (1, "two"), (7, "three")]
    spark.createDataFrame(first, "doc_id long, text string").write.parquet(path)
    check(run(spark, path, store), first)
    spark.createDataFrame(later, "doc_id long, text string").write.mode("append").parquet(path)
    check(run(spark, path, store), first + later)
    check(run(spark, path, store), first + later)


def test_bytes_are_compared_where_digests_agree(spark):
    """With a digest of one of three values, texts are told apart by their bytes alone."""
    path = folder(spark)
    rows = [(i, f"text {i % 20}{' long' * (i % 3)}") for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(7).write.parquet(path)
    check(run(spark, path, digest=lambda t: F.unhex(F.concat(F.lit("0"), (F.crc32(t) % 3).cast("string")))), rows)


def test_main_path_has_no_python(spark, sf_dir):
    plan = exactdedup.op13_streaming_dedup(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "MapPartitions"))
