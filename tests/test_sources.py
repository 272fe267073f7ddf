import random

import pytest
from pyspark.sql import functions as F

from wardline.sources import numbered, publish


def records(rng, n):
    """Rows with quoted separators, quotes and line ends."""
    out = []
    for k in range(n):
        note = rng.choice(["plain", "a, b", 'say ""so""', "two\nlines", "three\n\nlines, and\nmore", "x\r\ny", ""])
        out.append((str(k), note))
    return out


def write(path, rows, end, blank=False, closing=True):
    text = f"id,note{end}"
    for k, (i, note) in enumerate(rows):
        text += f'{i},"{note}"{end}' if any(c in note for c in ',"\n\r') else f"{i},{note}{end}"
        if blank and k % 5 == 0:
            text += end
    path.write_bytes((text if closing else text[: -len(end)]).encode())


@pytest.mark.parametrize("size", ["128m", "97", "1k"])
def test_rows_have_the_numbers_of_their_file(spark, tmp_path, size):
    """However the files are split, inside quotes too."""
    rng = random.Random(size)
    folder, want = tmp_path / "in", []
    folder.mkdir()
    for name, end in (("a.csv", "\n"), ("b.csv", "\r\n")):
        rows = records(rng, 120)
        write(folder / name, rows, end, blank=name == "a.csv", closing=name == "a.csv")
        want += [(name, k, i, note.replace('""', '"') or None) for k, (i, note) in enumerate(rows, 1)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        df = numbered.read_numbered_csv(spark, str(folder), ["id", "note"], "n", file="file")
        got = [(r["file"], r["n"], r["id"], r["note"]) for r in df.collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(got, key=str) == sorted(want, key=str)


def test_short_long_and_open_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b,c\n1,2\n4,5,6,7\n8,9,10\n")
    path = str(tmp_path / "a.csv")
    got = numbered.read_numbered_csv(spark, path, ["a", "b", "c"], tolerant=True).orderBy("source_row").collect()
    assert [tuple(r) for r in got] == [("1", "2", None, 1), ("8", "9", "10", 3)]
    with pytest.raises(Exception, match="more fields"):
        numbered.read_numbered_csv(spark, path, ["a", "b", "c"]).collect()
    (tmp_path / "b.csv").write_text('a,b\n1,"x\n2,y\n')
    with pytest.raises(ValueError, match="isn't closed"):
        numbered.read_numbered_csv(spark, str(tmp_path / "b.csv"), ["a", "b"])
    (tmp_path / "c.csv").write_text("a,b\n")
    assert numbered.read_numbered_csv(spark, str(tmp_path / "c.csv"), ["a", "b"]).count() == 0


BY = ["y", "q"]


def build(spark, root, source, prints, fail=False, lose=False):
    required = spark.createDataFrame(prints, "y int, q int, fingerprint string")
    measures = {"kept": F.col("kind") == 2}

    def made(rows):
        out = rows.filter("kind = 2").withColumn("twice", F.col("v") * 2)
        if fail:
            out = out.withColumn("twice", F.when(F.col("q") == 2, F.raise_error(F.lit("half-way"))).otherwise(F.col("twice")))
        return out.filter("NOT (q = 1 AND v = 1)") if lose else out

    return publish.publish(spark, root, BY, required, lambda todo: source.join(todo.select(*BY), BY, "left_semi"), made, measures, {"large": F.col("v") > 3}, ("kept", "rows"))


def test_a_failed_build_leaves_the_old_partitions(spark, tmp_path):
    root = f"file://{tmp_path}/fact"
    rows = [(2010 + k % 2, k % 3, k, 1 + k % 4 // 2) for k in range(48)]
    source = spark.createDataFrame(rows, "y int, q int, v int, kind int")
    kept = sorted(r for r in rows if r[3] == 2)
    with pytest.raises(ValueError, match="nothing"):
        publish.read_published(spark, root, BY)
    first = build(spark, root, source, [(y, q, "one") for y in (2010, 2011) for q in range(3)]).collect()
    assert all(r["passed"] for r in first) and sum(r["rows"] for r in first) == len(kept) and sum(r["source_rows"] for r in first) == 48
    assert {(r["y"], r["q"]): (r["kept"], r["large"]) for r in first} == {(y, q): (len(p := [r for r in kept if r[:2] == (y, q)]), sum(r[2] > 3 for r in p)) for y in (2010, 2011) for q in range(3)}

    def read(**wanted):
        return sorted((r["y"], r["q"], r["v"], r["kind"]) for r in publish.read_published(spark, root, BY, **wanted).collect())

    assert read() == kept and read(y=2010, q=2) == [r for r in kept if r[:2] == (2010, 2)]
    assert build(spark, root, source, [(2010, 1, "one")]).count() == 0  # nothing to do
    changed = source.withColumn("v", F.col("v") + 100)
    with pytest.raises(Exception, match="half-way"):
        build(spark, root, changed, [(2010, 1, "two"), (2010, 2, "two")], fail=True)
    assert read() == kept and publish.manifest_of(spark, root, BY).count() == 6
    lost = build(spark, root, source.withColumn("v", F.lit(1)), [(2010, 1, "two")], lose=True).collect()
    assert not lost[0]["passed"] and lost[0]["rows"] == 0 and read() == kept
    assert build(spark, root, changed, [(2010, 1, "two"), (2010, 2, "one")]).count() == 1
    assert read() == sorted((y, q, v + 100 if (y, q) == (2010, 1) else v, k) for y, q, v, k in kept)
    assert build(spark, root, changed, [(2010, 1, "two")]).count() == 0
