"""Queries of readers, sinks, the raw-to-fact plan, the cohort's tables and the small end-to-end job."""

from __future__ import annotations

import uuid

from pyspark.errors import PySparkException as SparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions import decode
from wardline.operators import link, metrics, models
from wardline.operators.tables import written
from wardline.plans import cohort, layouts, quarter
from wardline.plans.frames import ENCOUNTERS_SQL, encounters, occurrences, table
from wardline.plans.registry import query
from wardline.sources import manifest, numbered, publish, readers

ENC = f"WITH {ENCOUNTERS_SQL}"


def shared(spark: SparkSession, name: str) -> str:
    """A new folder below the one that all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


# ---- sources and sinks ----


def _orders_text(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").selectExpr("CAST(o_orderkey AS string) AS id", "concat('a, \"b\" ', o_orderstatus) AS note", "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS priority", "CAST(o_orderkey * 2 AS string) AS line")


@query("csv_scan", """SELECT CAST(o_orderkey AS string) AS id, 'a, "b" ' || o_orderstatus AS note, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS priority, o_orderkey * 2 AS line, 'three_columns' AS layout FROM orders""")
def _csv(spark, sf):
    path = shared(spark, "orders-csv")
    _orders_text(spark, sf).write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    names = ["id", "note", "priority", "line"]
    header = readers.header_of(spark, path)
    layout = readers.classify_layout(header, {"three_columns": (4, ["id", "line"]), "other": (5, ["id"])})
    return readers.read_csv(spark, path, names, line_column="line").withColumn("layout", F.lit(layout))


@query(
    "numbered_scan",
    """SELECT CAST(o_orderkey AS string) AS id, CASE o_orderkey % 3 WHEN 0 THEN 'one, "' || o_orderstatus || '"' WHEN 1 THEN 'two' || chr(10) || 'lines' || chr(10) || chr(10) || o_orderstatus ELSE o_orderpriority END AS note, row_number() OVER (PARTITION BY o_orderkey % 7 ORDER BY o_orderkey) AS source_row FROM orders""",
)
def _numbered(spark, sf):
    """Seven files whose rows hold quoted line ends; each row gets the number it has in its file."""
    path = shared(spark, "orders-numbered")
    o = table(spark, sf, "orders").selectExpr("o_orderkey", "CAST(o_orderkey AS string) AS id", "CASE o_orderkey % 3 WHEN 0 THEN concat('one, \"', o_orderstatus, '\"') WHEN 1 THEN concat('two', chr(10), 'lines', chr(10), chr(10), o_orderstatus) ELSE o_orderpriority END AS note", "o_orderkey % 7 AS part")
    o.repartition("part").sortWithinPartitions("part", "o_orderkey").drop("o_orderkey").write.partitionBy("part").option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return numbered.read_numbered_csv(spark, path, ["id", "note"])


@query("tolerant_scan", "SELECT CAST(o_orderkey AS string) AS id, CAST(o_custkey AS string) AS customer FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderkey % 5 <> 0")
def _tolerant(spark, sf):
    """Every fourth line has a field too many, every fifth no key of digits."""
    path = shared(spark, "orders-rough")
    table(spark, sf, "orders").selectExpr("concat(CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE '' END, o_orderkey, ',', o_custkey, CASE WHEN o_orderkey % 4 = 0 THEN ',more' ELSE '' END) AS value").write.text(path)
    return readers.read_csv(spark, path, ["id", "customer"], header=False, tolerant=True, key="id", key_pattern="[0-9]+")


@query("piped_scan", "SELECT CAST(s_suppkey AS string) AS k, s_name AS name, CAST(NULL AS string) AS balance FROM supplier UNION ALL SELECT CAST(c_custkey AS string), NULL, CAST(CAST(floor(c_acctbal) AS BIGINT) AS string) FROM customer")
def _piped(spark, sf):
    """Two sets of files whose columns differ, found by a pattern."""
    root = shared(spark, "piped")
    for name, df in (("suppliers", table(spark, sf, "supplier").selectExpr("s_suppkey AS k", "s_name AS name")), ("customers", table(spark, sf, "customer").selectExpr("c_custkey AS k", "CAST(floor(c_acctbal) AS string) AS balance"))):
        df.write.option("header", True).option("sep", "|").csv(f"{root}/{name}")
    return readers.read_piped(spark, [f"{root}/*"]).select("k", "name", "balance")


@query("counts_scan", "SELECT CAST(year(o_orderdate) AS BIGINT) AS year, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1, 2")
def _counts(spark, sf):
    path = shared(spark, "counts")
    table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("y"), "o_orderstatus").count().write.csv(path)
    return readers.read_counts(spark, path, "year int, status string, n long")


@query("json_places", "SELECT CAST(n_nationkey AS string) AS code, n_name AS name FROM nation")
def _json(spark, sf):
    """An array of arrays, its first row the header; a file that isn't one falls back to a given table."""
    path, broken = shared(spark, "places"), shared(spark, "broken")
    rows = table(spark, sf, "nation").select(F.to_json(F.array(F.col("n_nationkey").cast("string"), "n_name")).alias("r"))
    whole = rows.agg(F.concat(F.lit('[["code","name"],'), F.array_join(F.sort_array(F.collect_list("r")), ","), F.lit("]")).alias("value"))  # a nation a row: 25
    whole.write.text(path)
    table(spark, sf, "region").select(F.lit("no json").alias("value")).limit(1).write.text(broken)
    return readers.read_rows_of_arrays(spark, broken, readers.read_rows_of_arrays(spark, path))


@query("named_views", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def _views(spark, sf):
    readers.register(spark, {"ref_nation": f"{sf}/nation.parquet", "ref_region": f"{sf}/region.parquet"})
    return spark.sql("SELECT n_name, r_name FROM ref_nation JOIN ref_region ON n_regionkey = r_regionkey")


@query("partitioned_build", f"{ENC}, m AS (SELECT visit_year, visit_quarter, count(*) AS rows, round(sum(total), 2) AS charges FROM encounters GROUP BY 1, 2) SELECT * FROM m WHERE visit_year = 2008")
def _build(spark, sf):
    """Partitions without a valid manifest row are built, the others stay; one year is read back and pruned to."""
    e, path, by = encounters(spark, sf).select("visit_id", "visit_year", "visit_quarter", "total"), shared(spark, "fact"), ["visit_year", "visit_quarter"]
    manifest.write_partitioned(e.filter("visit_quarter < 3"), path, by, ["visit_id"])
    required = e.select(*by).distinct().withColumn("fingerprint", F.lit("v1"))
    done = manifest.manifest(readers.read_partitions(spark, path), by, {}, F.lit(True), "v1")
    manifest.build_missing(spark, required, done, by, lambda todo: e.join(todo.select(*by), by, "left_semi"), path)
    return readers.read_partitions(spark, path, visit_year=2008).groupBy(*by).agg(F.count("*").alias("rows"), F.round(F.sum("total"), 2).alias("charges"))


@query(
    "published_build",
    f"""{ENC} SELECT visit_year, visit_quarter, count(*) AS source_rows, count(*) FILTER (days > 0) AS kept, count(*) FILTER (days > 0) AS rows, count(*) FILTER (days > 0 AND total > 100000) AS large, CASE WHEN visit_quarter < 3 THEN 'v1' ELSE 'v2' END AS fingerprint, round(sum(total) FILTER (days > 0), 2) AS charges FROM encounters GROUP BY 1, 2""",
)
def _published(spark, sf):
    """Two quarters of each year are published, a build of the rest fails half-way and leaves them readable, another one succeeds."""
    root, by = shared(spark, "published"), ["visit_year", "visit_quarter"]
    e = encounters(spark, sf).select("visit_id", "visit_year", "visit_quarter", "total", "days")

    def build(some: str, fingerprint: str, fail: bool = False):
        required = e.filter(some).select(*by).distinct().withColumn("fingerprint", F.lit(fingerprint))
        total = F.when(F.col("visit_id") % 2 == 0, F.raise_error(F.lit("half-way"))).otherwise(F.col("total")) if fail else F.col("total")
        return publish.publish(spark, root, by, required, lambda todo: e.join(todo.select(*by), by, "left_semi"), lambda rows: rows.filter("days > 0").withColumn("total", total), {"kept": F.col("days") > 0}, {"large": F.col("total") > 100_000}, ("kept", "rows"))

    build("visit_quarter < 3", "v1")
    try:
        build("visit_quarter >= 3", "v2", fail=True)
        raise AssertionError("the build should have failed")
    except SparkException:
        pass
    build("visit_quarter >= 3", "v2")
    rows = publish.read_published(spark, root, by).groupBy(*by).agg(F.round(F.sum("total"), 2).alias("charges"))
    return publish.current(spark, root, by).select(*by, "source_rows", "kept", "rows", "large", "fingerprint").join(rows, by)


@query(
    "file_fingerprints",
    """WITH f AS (SELECT s_nationkey AS k, sha256(string_agg(s_suppkey || '|' || s_name || chr(10), '' ORDER BY s_suppkey)) AS sha256, sum(octet_length((s_suppkey || '|' || s_name || chr(10))::BLOB)) AS bytes FROM supplier GROUP BY 1)
SELECT CAST(k AS BIGINT) AS k, CAST(bytes AS BIGINT) AS bytes, sha256, CASE WHEN k % 5 = 0 THEN 'changed' WHEN k % 7 = 0 THEN 'new' ELSE 'same' END AS status FROM f""",
)
def _files(spark, sf):
    """A file for each nation is read as bytes; some differ from what a manifest has of them, some it lacks."""
    path = shared(spark, "files")
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"), "s_suppkey", F.concat_ws("|", "s_suppkey", "s_name").alias("value"))
    s.repartition("k").sortWithinPartitions("k", "s_suppkey").select("k", "value").write.partitionBy("k").text(path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    now = files.select(F.col("k").cast("long").alias("k"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    known = now.filter("k % 7 <> 0 OR k % 5 = 0").select("k", F.when(F.col("k") % 5 == 0, "other").otherwise(F.col("sha256")).alias("known"))
    status = F.when(F.col("known").isNull(), "new").when(F.col("known") == F.col("sha256"), "same").otherwise("changed")
    return now.join(known, "k", "left").select("k", "bytes", "sha256", status.alias("status"))


@query("fan_out_tables", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _fan(spark, sf):
    path = shared(spark, "tables")
    manifest.fan_out(table(spark, sf, "orders"), path, {"core": ["o_custkey"], "charges": ["o_totalprice"]}, ["o_orderkey"])
    return cohort.sidecar(spark.read.parquet(f"{path}/core"), spark.read.parquet(f"{path}/charges"), ["o_orderkey"])


@query("csv_sink", f"{ENC} SELECT segment, count(*) AS n FROM encounters GROUP BY 1")
def _sink(spark, sf):
    path = shared(spark, "result")
    manifest.write_csv(encounters(spark, sf).groupBy("segment").agg(F.count("*").alias("n")), path)
    return readers.read_csv(spark, path, ["segment", "n"]).withColumn("n", F.col("n").cast("long"))


# ---- raw quarters to the fact ----

SLOTS = "slots AS (SELECT l_orderkey, max(CASE WHEN l_linenumber = 1 THEN l_partkey END) AS c1, max(CASE WHEN l_linenumber = 2 THEN l_partkey END) AS c2, max(CASE WHEN l_linenumber = 3 THEN l_partkey END) AS c3, max(CASE WHEN l_linenumber = 4 THEN l_suppkey END) AS c4 FROM lineitem GROUP BY l_orderkey)"
RAW = {
    "visit_year": "year(o_orderdate) + 13", "visit_quarter": "quarter(o_orderdate)", "line": "o_orderkey", "SYS_RECID": "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE ' ' || CAST(o_custkey AS string) END", "TYPE_SERV": "CASE o_orderkey % 10 WHEN 3 THEN '1' WHEN 4 THEN ' 2 ' ELSE '2' END",
    "PRO_CODE": "CASE o_orderkey % 3 WHEN 0 THEN '23' WHEN 1 THEN '14' END", "FACLNBR": "CAST(c_nationkey AS string)", "FAC_NAME": "CASE WHEN c_nationkey % 4 = 0 THEN ' ' ELSE 'Hospital ' || CAST(c_nationkey AS string) END", "FAC_COUNTY_NAME": "nullif(c_mktsegment, 'BUILDING')",
    "SERV_LOC": "CASE o_orderkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN '1' END", "ETHNICITY": "CASE o_orderkey % 4 WHEN 0 THEN 'E1' WHEN 1 THEN 'E2' WHEN 2 THEN 'E9' END", "RACE": "CAST(o_orderkey % 9 AS string)", "SEX": "CASE o_orderkey % 5 WHEN 0 THEN 'M' WHEN 1 THEN 'F' WHEN 2 THEN '1' WHEN 3 THEN '2' END",
    "AGE": "CASE WHEN o_orderkey % 31 = 0 THEN 'x' WHEN o_orderkey % 37 = 0 THEN '888' ELSE ' ' || CAST(o_orderkey % 120 AS string) END", "ZIPCODE": "CASE WHEN o_orderkey % 6 = 0 THEN '3210' ELSE CAST(32100 + o_orderkey % 40 AS string) END", "LOSDAYS": "CAST(o_orderkey % 3 AS string)",
    "WEEKDAY": "CAST(o_orderkey % 9 AS string)", "ADMSRC": "CASE o_orderkey % 3 WHEN 0 THEN '01' WHEN 1 THEN '07' END", "HR_ARRIVAL": "CAST(o_orderkey % 26 AS string)", "EDHR_DISCH": "CAST(o_orderkey % 25 AS string)", "PT_STATUS": "lpad(CAST(o_orderkey % 52 AS string), 2, '0')",
    "PAYER": "substr('ABCDEFGHIJKLMNOPQR', CAST(o_orderkey % 18 + 1 AS int), 1)", "PRINDIAG": "' d' || CAST(c1 % 40 AS string) || '.1'", "OTHDIAG1": "'D' || CAST(c2 % 40 AS string)", "OTHDIAG2": "'d-' || CAST(c3 % 40 AS string)", "ECODE1": "'E' || CAST(c4 AS string)",
    "PRINCPT": "CASE WHEN c1 % 3 = 0 THEN '99291' ELSE 'S' || CAST(c1 % 20 AS string) END", "EVALCODE1": "CASE c2 % 6 WHEN 0 THEN '99281' WHEN 1 THEN '99283' WHEN 2 THEN 'g0384' WHEN 3 THEN '99291' END", "OTHCPT1": "'S' || CAST(c3 % 20 AS string)", "PRINPROC": "CASE WHEN c4 % 2 = 0 THEN 'P' || CAST(c4 % 20 AS string) END",
    "ATTENPHYID": "CASE WHEN o_orderkey % 3 = 0 THEN 'ME' || CAST(o_custkey % 50 AS string) END", "ATTEN_PHYID": "CASE WHEN o_orderkey % 2 = 0 THEN ' OS' || CAST(o_custkey % 50 AS string) END", "ATTEN_PHYNPI": "CASE o_orderkey % 5 WHEN 0 THEN '1234567893' WHEN 1 THEN '1234567890' END", "OPER_PHYID": "CASE WHEN o_orderkey % 7 = 0 THEN 'ME7' END",
    "PHARMCHGS": "CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE CAST(o_orderkey % 1000 AS string) END", "LABCHGS": "CASE WHEN o_orderkey % 8 < 2 THEN NULL ELSE '10.5' END", "TCHGS": "CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '-1' ELSE CAST(o_orderkey % 1000 + o_orderkey % 27 AS string) END",
}
RAW_SQL = f"WITH {SLOTS}, raw AS (SELECT {', '.join(f'{e} AS {n}' for n, e in RAW.items())} FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN slots ON l_orderkey = o_orderkey)"
#: (system, key, description, category, mappings) and the other small code tables.
CODES = [(s, f"D{k}{end}", f"{s[:6]} {k}", f"C{k % 7}", k % 3 + 1) for s in ("ICD-9-CM", "ICD-10-CM") for k in range(0, 40, 1 if s == "ICD-9-CM" else 2) for end in ("", "1") if k or end]
CATEGORIES = [(s, key, f"{c}{n}", n) for s, key, _, c, m in CODES for n in range(1, m + 1)]
CONDITIONS = [("ICD-9-CM", f"D{k}", "diabetes" if k % 2 else "anemia") for k in range(0, 20)] + [("ICD-10-CM", f"D{k}", "obesity" if k % 3 else "anemia") for k in range(10, 30)]
GROUPS = [("CPT_HCPCS", f"S{k}", f"service {k}", f"G{k % 4}") for k in range(0, 15)] + [("ICD-9-CM", f"P{k}", f"old {k}", f"G{k % 3}") for k in range(0, 12)] + [("ICD-10-PCS", f"P{k}", f"new {k}", None) for k in range(4, 18)]
CROSSWALK = [("ME1", "1000000001"), ("ME7", "1000000007"), ("ME7", "1000000008"), ("OS2", "1000000002"), ("OS4", "1000000004")]


def values(rows) -> str:
    return ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in r) + ")" for r in rows)


CORE_SQL = f"""{RAW_SQL}, two AS (SELECT *, nullif(trim(SYS_RECID), '') AS rec FROM raw WHERE trim(TYPE_SERV) = '2'),
core AS (SELECT CAST(visit_year AS string) || 'Q' || CAST(visit_quarter AS string) || '|' || coalesce(rec, 'MISSING') || '|' || CAST(row_number() OVER (PARTITION BY visit_year, visit_quarter, rec ORDER BY line) AS string) AS visit_key,
  count(*) OVER (PARTITION BY visit_year, visit_quarter, rec) > 1 AS duplicate_flag, visit_year * 10 + visit_quarter >= 20154 AS ten, CASE WHEN visit_year * 10 + visit_quarter >= 20154 THEN 'ICD-10-CM' ELSE 'ICD-9-CM' END AS dsys, * FROM two),
dx AS (SELECT visit_key, dsys AS system, 'principal' AS role, 'PRINDIAG' AS source_field, 0 AS position, trim(PRINDIAG) AS raw FROM core WHERE PRINDIAG IS NOT NULL UNION ALL SELECT visit_key, dsys, 'secondary', 'OTHDIAG1', 1, OTHDIAG1 FROM core WHERE OTHDIAG1 IS NOT NULL
  UNION ALL SELECT visit_key, dsys, 'secondary', 'OTHDIAG2', 2, OTHDIAG2 FROM core WHERE OTHDIAG2 IS NOT NULL UNION ALL SELECT visit_key, dsys, 'external_cause', 'ECODE1', 1, ECODE1 FROM core WHERE ECODE1 IS NOT NULL),
dn AS (SELECT *, regexp_replace(upper(raw), '[^A-Z0-9]', '', 'g') AS code FROM dx), codes(s, k, d, c, m) AS (VALUES {values(CODES)}), cats(s, k, c, n) AS (VALUES {values(CATEGORIES)}), cond(s, k, c) AS (VALUES {values(CONDITIONS)}), groups_(s, k, d, g) AS (VALUES {values(GROUPS)}),
px AS (SELECT visit_key, 'CPT_HCPCS' AS system, 'principal_service' AS role, 'PRINCPT' AS source_field, 0 AS position, PRINCPT AS raw FROM core WHERE PRINCPT IS NOT NULL UNION ALL SELECT visit_key, 'CPT_HCPCS', 'evaluation_management', 'EVALCODE1', 1, EVALCODE1 FROM core WHERE EVALCODE1 IS NOT NULL
  UNION ALL SELECT visit_key, 'CPT_HCPCS', 'other_service', 'OTHCPT1', 1, OTHCPT1 FROM core WHERE OTHCPT1 IS NOT NULL UNION ALL SELECT visit_key, CASE WHEN ten THEN 'ICD-10-PCS' ELSE 'ICD-9-CM' END, 'principal_icd_procedure', 'PRINPROC', 0, PRINPROC FROM core WHERE PRINPROC IS NOT NULL AND visit_year <= 2017),
pn AS (SELECT *, upper(raw) AS code FROM px)"""


def _frames(spark, sf, often: bool = False) -> dict[str, DataFrame]:
    """often: rows that are read more than once are written, so that what they are made of is read, joined and numbered once."""
    for name in ("orders", "customer", "lineitem"):
        table(spark, sf, name).createOrReplaceTempView(f"raw_{name}")
    slots = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(*[F.max(F.when(F.col("l_linenumber") == k, F.col(c))).alias(f"c{k}") for k, c in ((1, "l_partkey"), (2, "l_partkey"), (3, "l_partkey"), (4, "l_suppkey"))])
    joined = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(slots, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    raw = joined.select(*[F.expr(e).alias(n) for n, e in RAW.items()])
    rows = quarter.core(written(quarter.service_rows(raw)) if often else raw, [F.col("line")])
    return {
        "rows": written(rows) if often else rows, "codes": spark.createDataFrame(CODES, "system string, key string, description string, category string, mappings int"), "categories": spark.createDataFrame(CATEGORIES, "system string, key string, category string, sequence int"),
        "conditions": spark.createDataFrame(CONDITIONS, "system string, key string, condition string"), "groups": spark.createDataFrame(GROUPS, "system string, key string, description string, group string"),
        "crosswalk": link.unique_crosswalk(spark.createDataFrame(CROSSWALK, "licence_key string, npi string"), "licence_key", "npi"),
    }


@query("quarter_keys", f"{CORE_SQL} SELECT visit_key, duplicate_flag, dsys AS diagnosis_system, CASE WHEN visit_year > 2017 THEN NULL WHEN ten THEN 'ICD-10-PCS' ELSE 'ICD-9-CM' END AS procedure_system, coalesce(nullif(trim(ATTEN_PHYID), ''), ATTENPHYID) AS attending_licence, CAST(TCHGS AS double) AS tchgs FROM core")
def _quarter_keys(spark, sf):
    return _frames(spark, sf)["rows"].select("visit_key", "duplicate_flag", "diagnosis_system", "procedure_system", "attending_licence", "tchgs")


@query("quarter_diagnoses", f"{CORE_SQL} SELECT visit_key, system, role, source_field, CAST(position AS BIGINT) AS position, raw, code, d AS description, c AS category, CAST(coalesce(m, 0) AS BIGINT) AS mapping_count, k IS NOT NULL AS mapped_flag FROM dn LEFT JOIN codes ON s = system AND k = code")
def _quarter_diagnoses(spark, sf):
    f = _frames(spark, sf)
    return quarter.diagnoses(f["rows"], f["codes"]).drop("visit_year", "visit_quarter")


@query("quarter_categories", f"{CORE_SQL} SELECT visit_key, role, code, c AS category, CAST(n AS BIGINT) AS sequence FROM dn JOIN cats ON s = system AND k = code")
def _quarter_categories(spark, sf):
    f = _frames(spark, sf)
    return quarter.diagnosis_categories(f["rows"], f["categories"]).select("visit_key", "role", "code", "category", "sequence")


@query("quarter_comorbidities", f"{CORE_SQL} SELECT visit_key, c AS condition, count(*) AS n_hits, string_agg(DISTINCT code, '|' ORDER BY code) AS codes, string_agg(DISTINCT source_field, '|' ORDER BY source_field) AS fields FROM dn JOIN cond ON s = system AND k = code WHERE role = 'secondary' GROUP BY 1, 2")
def _quarter_comorbidities(spark, sf):
    f = _frames(spark, sf)
    return quarter.comorbidities(f["rows"], f["conditions"])


@query("quarter_procedures", f"{CORE_SQL} SELECT visit_key, system, role, source_field, CAST(position AS BIGINT) AS position, raw, code, d AS description, g AS group, k IS NOT NULL AS mapped_flag, g IS NOT NULL AS group_mapped_flag FROM pn LEFT JOIN groups_ ON s = system AND k = code".replace("g AS group", 'g AS "group"'))
def _quarter_procedures(spark, sf):
    f = _frames(spark, sf)
    return quarter.procedures(f["rows"], f["groups"]).drop("visit_year", "visit_quarter")


@query(
    "quarter_practitioners",
    f"""{CORE_SQL}, x(k, n) AS (VALUES ('ME1', '1000000001'), ('OS2', '1000000002'), ('OS4', '1000000004')), p AS (SELECT visit_key, 'attending' AS role, coalesce(trim(ATTEN_PHYID), ATTENPHYID) AS licence, ATTEN_PHYNPI AS npi FROM core UNION ALL SELECT visit_key, 'operating', OPER_PHYID, NULL FROM core)
SELECT visit_key, role, licence, npi, CASE WHEN npi = '1234567893' THEN npi ELSE n END AS selected_npi, CASE WHEN npi = '1234567893' THEN 'direct_validated_npi' WHEN n IS NOT NULL THEN 'unique_licence_crosswalk' WHEN npi IS NOT NULL THEN 'invalid_direct_npi_unresolved' ELSE 'licence_unresolved' END AS selection_method
FROM p LEFT JOIN x ON k = licence WHERE licence IS NOT NULL OR npi IS NOT NULL""",
)
def _quarter_practitioners(spark, sf):
    f = _frames(spark, sf)
    return quarter.practitioners(f["rows"], f["crosswalk"]).drop("visit_year", "visit_quarter")


@query(
    "quarter_fact",
    f"""{CORE_SQL}, dd AS (SELECT dn.*, d, c FROM dn LEFT JOIN codes ON s = system AND k = code), dm AS (SELECT visit_key, count(*) AS n, count(*) FILTER (role = 'secondary') AS n2, count(*) FILTER (role = 'external_cause') AS ne, count(DISTINCT c) FILTER (role IN ('principal', 'secondary')) AS nc, max(CASE WHEN role = 'principal' THEN code END) AS pcode, max(CASE WHEN role = 'principal' THEN c END) AS pcat FROM dd GROUP BY 1),
cm AS (SELECT visit_key, count(DISTINCT c) AS nk FROM dn JOIN cond ON s = system AND k = code WHERE role = 'secondary' GROUP BY 1),
pm AS (SELECT visit_key, count(*) FILTER (system = 'CPT_HCPCS') AS n_cpt, count(*) FILTER (role = 'evaluation_management') AS n_em, count(*) FILTER (system <> 'CPT_HCPCS') AS n_icd, max(CASE code WHEN '99281' THEN 1 WHEN '99283' THEN 3 WHEN 'G0384' THEN 5 END) AS em FROM pn GROUP BY 1),
j AS (SELECT core.*, coalesce(n, 0) AS n, coalesce(n2, 0) AS n2, coalesce(ne, 0) AS ne, coalesce(nc, 0) AS nc, pcode, pcat, coalesce(nk, 0) AS nk, coalesce(n_cpt, 0) - coalesce(n_em, 0) + coalesce(n_icd, 0) AS np, em, CAST(PHARMCHGS AS double) AS ph, CAST(LABCHGS AS double) AS lab, CAST(TCHGS AS double) AS t, try_cast(trim(AGE) AS double) AS a, CAST(HR_ARRIVAL AS int) AS h, CAST(EDHR_DISCH AS int) AS dh
  FROM core LEFT JOIN dm USING (visit_key) LEFT JOIN cm USING (visit_key) LEFT JOIN pm USING (visit_key)), lim AS (SELECT visit_year, visit_quarter, quantile_cont(np, 0.9) AS lim FROM j GROUP BY 1, 2)
SELECT visit_key, coalesce(nullif(trim(FAC_NAME), ''), n_name) AS facility_name, CASE WHEN nullif(trim(FAC_NAME), '') IS NOT NULL THEN 'encounter file' WHEN n_name IS NOT NULL THEN 'facility companion' END AS facility_name_source, CASE WHEN ZIPCODE LIKE '_____' THEN ZIPCODE END AS zip5,
CASE WHEN length(ZIPCODE) = 5 AND CAST(ZIPCODE AS int) % 2 = 0 THEN CASE WHEN CAST(ZIPCODE AS int) % 12 BETWEEN 1 AND 3 THEN 'Metropolitan' WHEN CAST(ZIPCODE AS int) % 12 BETWEEN 4 AND 6 THEN 'Micropolitan' WHEN CAST(ZIPCODE AS int) % 12 BETWEEN 7 AND 10 THEN 'Small town/rural' END END AS rurality,
CASE WHEN visit_year >= 2018 AND a IN (777, 888, 999) THEN NULL WHEN a BETWEEN 0 AND 115 THEN a END AS age_years, CASE WHEN visit_year >= 2018 AND a = 888 THEN '100 years and older' WHEN visit_year >= 2018 AND a = 0 THEN '0-28 days' WHEN a BETWEEN 0 AND 17 THEN '0-17' WHEN a BETWEEN 18 AND 44 THEN '18-44'
 WHEN a BETWEEN 45 AND 64 THEN '45-64' WHEN a BETWEEN 65 AND 84 THEN '65-84' WHEN a BETWEEN 85 AND 115 THEN '85+' WHEN a IS NULL THEN 'Missing' ELSE 'Invalid/unmapped' END AS age_band, CASE WHEN h <= 23 THEN h NOT BETWEEN 7 AND 17 END AS off_hours, round(CASE WHEN h <= 23 AND dh <= 23 THEN 24 * CAST(LOSDAYS AS int) + dh - h END, 6) AS los_raw,
CASE WHEN PT_STATUS = '20' THEN TRUE ELSE FALSE END AS mortality_flag, n AS diagnosis_count, n2 AS secondary_count, ne AS external_cause_count, nc AS distinct_group_count, pcode AS principal_code, pcat AS principal_category, nk AS n_conditions, np AS procedure_count, np > 0 AND np >= lim AS high_procedure_flag, CASE WHEN visit_year >= 2010 THEN CAST(em AS BIGINT) END AS em_level,
round(CASE WHEN ph IS NOT NULL OR lab IS NOT NULL THEN coalesce(ph, 0) + coalesce(lab, 0) END, 2) AS component_charge_sum, round(CASE WHEN t >= 0 THEN t WHEN ph IS NOT NULL OR lab IS NOT NULL THEN coalesce(ph, 0) + coalesce(lab, 0) END, 2) AS total_charge,
abs(t - CASE WHEN ph IS NOT NULL OR lab IS NOT NULL THEN coalesce(ph, 0) + coalesce(lab, 0) END) > CASE WHEN visit_year <= 2008 THEN 10 ELSE 13 END AS charge_exception_flag FROM j JOIN lim USING (visit_year, visit_quarter) LEFT JOIN nation ON CAST(n_nationkey AS string) = FACLNBR AND n_nationkey % 8 = 0""",
)
def _quarter_fact(spark, sf):
    f = _frames(spark, sf, often=True)
    periods = f["rows"].select("visit_year", "visit_quarter").distinct()
    companion = table(spark, sf, "nation").filter("n_nationkey % 8 = 0").select(F.col("n_nationkey").cast("string").alias("facility"), F.col("n_name").alias("facility_name"), F.lit(None).cast("string").alias("county")).join(F.broadcast(periods))
    ruca = spark.range(32100, 32140, 2).select(F.col("id").cast("string").alias("zip5"), (F.col("id") % 12).cast("string").alias("primaryruca"))
    out = quarter.fact(f["rows"], quarter.diagnoses(f["rows"], f["codes"]), quarter.comorbidities(f["rows"], f["conditions"]), quarter.procedures(f["rows"], f["groups"]), companion, ruca)
    return out.select(
        "visit_key", "facility_name", "facility_name_source", "zip5", "rurality", "age_years", "age_band", "off_hours", "los_raw", "mortality_flag", "diagnosis_count", "secondary_count", "external_cause_count", "distinct_group_count", "principal_code", "principal_category",
        "n_conditions", "procedure_count", "high_procedure_flag", "em_level", F.round("component_charge_sum", 2).alias("component_charge_sum"), F.round("total_charge", 2).alias("total_charge"), "charge_exception_flag",
    )


# ---- cohort ----


@query(
    "historical_enrichment",
    f"""{ENC}, q AS (SELECT visit_year, visit_quarter, avg(total) AS v FROM encounters GROUP BY 1, 2), r AS (SELECT avg(v) AS r FROM q WHERE visit_year = 2012) SELECT visit_id, s_name, n_name, large, round(total * r / v, 4) AS real_total FROM encounters e LEFT JOIN supplier ON s_suppkey = provider AND s_suppkey % 3 <> 0
LEFT JOIN nation ON n_nationkey = facility LEFT JOIN (SELECT o_orderkey, TRUE AS large FROM orders WHERE o_totalprice > 300000) ON o_orderkey = visit_id JOIN q USING (visit_year, visit_quarter), r""",
)
def _historical(spark, sf):
    e = encounters(spark, sf)
    prices = metrics.cpi_factors(e.select(F.col("visit_year").alias("year"), F.col("visit_quarter").alias("quarter"), "total"), "total", 2012).withColumn("series", F.lit("all"))
    providers = table(spark, sf, "supplier").filter("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("provider"), "s_name")
    flags = table(spark, sf, "orders").filter("o_totalprice > 300000").select(F.col("o_orderkey").alias("visit_id"), F.lit(True).alias("large"))
    out = cohort.enrich(e, providers, flags, table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("facility"), "n_name"), prices, ["all"], keep_all=True)
    return out.select("visit_id", "s_name", "n_name", "large", F.round(decode.real_dollars(F.col("total"), F.col("factor_all")), 4).alias("real_total"))


@query(
    "discretion_by_visit",
    f"""{ENC}, m AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'higher_discretion_candidate' WHEN 1 THEN 'lower_discretion_candidate' ELSE 'ambiguous_or_unclassified' END AS kind FROM part WHERE p_partkey % 5 <> 0), c AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (kind LIKE 'higher%') AS hi, count(*) FILTER (kind LIKE 'lower%') AS lo FROM lineitem LEFT JOIN m ON p_partkey = l_partkey WHERE l_linenumber > 2 GROUP BY 1)
SELECT visit_id, coalesce(n, 0) AS n_procedures, coalesce(hi, 0) AS n_higher, coalesce(lo, 0) AS n_lower FROM encounters LEFT JOIN c ON l_orderkey = visit_id""",
)
def _discretion(spark, sf):
    mapping = table(spark, sf, "part").filter("p_partkey % 5 <> 0").selectExpr("'x' AS system", "p_partkey AS group", "CASE p_partkey % 3 WHEN 0 THEN 'higher_discretion_candidate' WHEN 1 THEN 'lower_discretion_candidate' ELSE 'ambiguous_or_unclassified' END AS kind")
    o = occurrences(spark, sf).filter("position > 2").select("visit_id", F.lit("x").alias("system"), F.col("code").alias("group"))
    return cohort.discretion_shares(o, mapping, encounters(spark, sf))


@query("cohort_counts_agree", f"{ENC}, a AS (SELECT visit_year, count(*) AS built FROM encounters WHERE total > 1000 GROUP BY 1), b AS (SELECT visit_year, count(*) AS source FROM encounters GROUP BY 1) SELECT visit_year, coalesce(built, 0) AS built, coalesce(source, 0) AS source, coalesce(built, 0) - coalesce(source, 0) AS difference FROM a FULL JOIN b USING (visit_year)")
def _agree(spark, sf):
    e = encounters(spark, sf)
    return cohort.agree(e.filter("total > 1000").groupBy("visit_year").agg(F.count("*").alias("n")), e.groupBy("visit_year").agg(F.count("*").alias("n")), ["visit_year"], "n")


@query("row_volumes", f"{ENC} SELECT visit_id, count(*) OVER (PARTITION BY facility, visit_year) AS volume FROM encounters")
def _row_volumes(spark, sf):
    return models.row_count_over(encounters(spark, sf), ["facility", "visit_year"]).select("visit_id", "volume")


@query(
    "licence_best_candidate",
    """WITH l AS (SELECT c_custkey AS id, 'ME' || lpad(CAST(100 + c_custkey % 60 AS string), 6, '0') AS lic FROM customer), r AS (SELECT s_suppkey AS npi, 'ME' || CAST(100 + s_suppkey % 60 AS string) AS reg, s_suppkey % 2 AS active, s_suppkey % 3 AS physician, s_suppkey % 5 AS slot FROM supplier),
j AS (SELECT id, npi, row_number() OVER (PARTITION BY id ORDER BY active DESC, physician DESC, slot, npi) AS rn FROM l JOIN r ON 'ME' || CAST(100 + id % 60 AS string) = reg) SELECT id, npi FROM j WHERE rn = 1""",
)
def _licences(spark, sf):
    df = table(spark, sf, "customer").selectExpr("c_custkey AS id", "'ME' || lpad(CAST(100 + c_custkey % 60 AS string), 6, '0') AS lic")
    registry = table(spark, sf, "supplier").selectExpr("s_suppkey AS npi", "'ME' || CAST(100 + s_suppkey % 60 AS string) AS registry_licence", "s_suppkey % 2 AS active", "s_suppkey % 3 AS physician", "s_suppkey % 5 AS slot")
    return cohort.licence_candidates(df, registry, "lic").select("id", "npi")


# ---- the small end-to-end job ----


def _layout_frames(spark, sf) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    fields = {
        "record": "CAST(o_orderkey AS string)", "year": "CAST(year(o_orderdate) + 12 AS string)", "quarter": "CAST(quarter(o_orderdate) AS string)", "age": "CAST(o_orderkey % 90 AS string)", "sex": "'F'", "race": "'1'", "ethnicity": "'E1'", "diagnosis": "'D1'", "procedure": "'P1'",
        "provider": "CASE WHEN o_orderkey % 5 = 0 THEN 'L' ELSE 'P' END || CAST(o_custkey % 30 AS string)", "facility": "CAST(c_nationkey AS string)", "charge": "CAST(o_totalprice AS string)", "los_days": "CAST(o_orderkey % 4 AS string)", "los_hours": "CAST(o_orderkey % 50 AS string)", "arrival_hour": "CAST(o_orderkey % 26 AS string)", "weekday": "CAST(o_orderkey % 7 + 1 AS string)",
    }
    frames = {}
    for k, (name, columns) in enumerate(layouts.LAYOUTS.items()):
        own = o.filter(F.col("o_orderkey") % 5 == k)
        frames[name] = own.select(*[F.expr(fields[f]).alias(c) for f, c in zip(layouts.FIELDS, columns, strict=True) if c])
    providers = spark.range(25).selectExpr("concat('P', id) AS synthetic_provider_id", "concat('L', id) AS synthetic_license_id", "CASE WHEN id % 4 = 0 THEN 'Organization' ELSE 'Individual' END AS entity_type", "CASE WHEN id % 3 = 0 THEN 'MD' ELSE 'NP' END AS clinician_type")
    facilities = table(spark, sf, "nation").selectExpr("CAST(n_nationkey AS string) AS synthetic_facility_id", "CASE WHEN n_nationkey % 2 = 0 THEN 'rural' ELSE 'urban' END AS rurality")
    return frames, providers, facilities


DEMO = f"""{ENC}, d AS (SELECT visit_id, 'schema_' || CAST(visit_id % 5 + 1 AS string) AS layout, provider_key, CASE WHEN provider_key < 25 THEN 'P' || CAST(provider_key AS string) END AS known, facility, visit_year, visit_quarter FROM (SELECT *, o_custkey % 30 AS provider_key FROM encounters JOIN orders ON o_orderkey = visit_id)),
e AS (SELECT *, CASE WHEN layout = 'schema_1' THEN known ELSE 'P' || CAST(provider_key AS string) END AS resolved, CASE WHEN known IS NOT NULL THEN CASE WHEN provider_key % 4 = 0 THEN 'Organization' ELSE 'Individual' END END AS entity_type FROM d)"""


@query(
    "layouts_enriched",
    f"""{DEMO} SELECT CAST(visit_id AS string) AS record, layout, resolved AS resolved_provider, entity_type, CASE WHEN facility % 2 = 0 THEN 'rural' ELSE 'urban' END AS rurality, CAST(CASE WHEN layout = 'schema_1' THEN visit_id % 4 * 24 ELSE visit_id % 50 END AS double) AS los_hours_any, coalesce(entity_type = 'Individual' AND provider_key % 3 = 0, FALSE) AS physician_flag,
CASE WHEN visit_year * 10 + visit_quarter >= 20154 THEN 'ICD-10-CM' ELSE 'ICD-9-CM' END AS code_system, CASE WHEN visit_id % 26 <= 23 THEN visit_id % 26 NOT BETWEEN 7 AND 18 END AS off_hours, visit_id % 7 >= 5 AS weekend FROM e""",
)
def _layouts(spark, sf):
    frames, providers, facilities = _layout_frames(spark, sf)
    return layouts.enriched(layouts.united(frames), providers, facilities).select("record", "layout", "resolved_provider", "entity_type", "rurality", "los_hours_any", "physician_flag", "code_system", "off_hours", "weekend")


@query("layouts_reconciled", f"{DEMO} SELECT layout, count(*) AS source_rows, count(*) AS output_rows, TRUE AS passed FROM e GROUP BY 1")
def _layouts_reconciled(spark, sf):
    frames, _, _ = _layout_frames(spark, sf)
    return layouts.reconciliation(frames, layouts.united(frames))


@query("layouts_quality", f"{DEMO} SELECT count(*) AS rows, count(*) FILTER (entity_type IS NULL) AS unresolved_providers, CAST(0 AS BIGINT) AS organisation_physicians, count(*) FILTER (visit_id % 26 > 23) AS bad_hours, CAST(0 AS BIGINT) AS repeated_ids FROM e")
def _layouts_quality(spark, sf):
    frames, providers, facilities = _layout_frames(spark, sf)
    return layouts.quality(layouts.enriched(layouts.united(frames), providers, facilities))
