"""The supplied tables in the roles of encounters, occurrences, providers and facilities.

Raw codes are made from the keys by expressions that Spark and any SQL engine read alike, so that every era and every edge of the
code books is met.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: name -> expression over orders joined with customer.
ENCOUNTER = {
    "visit_id": "o_orderkey",
    "provider": "o_custkey % 50",
    "facility": "CAST(c_nationkey AS BIGINT)",
    "visit_year": "CAST(year(o_orderdate) + 12 AS BIGINT)",
    "visit_quarter": "CAST(quarter(o_orderdate) AS BIGINT)",
    "sex_raw": "CASE o_orderkey % 7 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN '3' WHEN 3 THEN 'M' WHEN 4 THEN 'F' WHEN 5 THEN 'U' END",
    "race_raw": "nullif(CAST(o_orderkey % 10 AS string), '0')",
    "origin_raw": "CASE o_orderkey % 5 WHEN 0 THEN 'E1' WHEN 1 THEN 'E2' WHEN 2 THEN 'E7' WHEN 3 THEN 'ZZ' END",
    "age": "CAST(CASE WHEN o_orderkey % 37 = 0 THEN 777 WHEN o_orderkey % 41 = 0 THEN 888 WHEN o_orderkey % 43 = 0 THEN 999 WHEN o_orderkey % 47 = 0 THEN NULL ELSE (o_orderkey * 7) % 121 END AS double)",
    "weekday_raw": "CAST(o_orderkey % 9 AS string)",
    "hour_raw": "CASE WHEN o_orderkey % 29 = 28 THEN 'x' ELSE CAST(o_orderkey % 27 AS string) END",
    "payer_raw": "CASE WHEN o_orderkey % 19 = 18 THEN NULL ELSE substr('ABCDEFGHIJKLMNOPQR', CAST(o_orderkey % 19 + 1 AS int), 1) END",
    "status_raw": "lpad(CAST(o_orderkey % 72 AS string), 2, '0')",
    "admission_raw": "CASE WHEN o_orderkey % 13 = 12 THEN 'D' ELSE lpad(CAST(o_orderkey % 11 AS string), 2, '0') END",
    "location_raw": "CASE o_orderkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN '1' WHEN 3 THEN 'bb' END",
    "days": "CAST(o_orderkey % 3 AS double)",
    "discharge_hour": "CAST((o_orderkey * 5) % 25 AS double)",
    "segment": "c_mktsegment",
    "order_status": "o_orderstatus",
    "priority": "o_orderpriority",
    "total": "o_totalprice",
}
ENCOUNTERS_SQL = f"encounters AS (SELECT {', '.join(f'{e} AS {n}' for n, e in ENCOUNTER.items())} FROM orders JOIN customer ON o_custkey = c_custkey)"
OCCURRENCE = {
    "visit_id": "l_orderkey",
    "position": "CAST(l_linenumber AS BIGINT)",
    "role": "CASE WHEN l_linenumber = 1 THEN 'principal' WHEN l_returnflag = 'R' THEN 'external' ELSE 'secondary' END",
    "system": "l_linestatus",
    "code": "l_partkey",
    "supplier": "l_suppkey",
    "amount": "l_extendedprice",
    "quantity": "l_quantity",
}
OCCURRENCES_SQL = f"occurrences AS (SELECT {', '.join(f'{e} AS {n}' for n, e in OCCURRENCE.items())} FROM lineitem)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(*[F.expr(e).alias(n) for n, e in ENCOUNTER.items()])


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*[F.expr(e).alias(n) for n, e in OCCURRENCE.items()])


def plain(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, whole numbers as long: for comparing with another engine."""
    out = []
    for f in df.schema:
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        out.append((F.round(c, places) if kind in ("double", "float") else c.cast("long") if kind in ("integer", "short", "byte") else c).alias(f.name))
    return df.select(*out)
