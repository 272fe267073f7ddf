"""Probabilities of classes from names: dictionary, cleaning cascade, best match, log scores, posterior.

The result is an algorithmic proxy with its uncertainty, not a recorded attribute; publish it through labels.suppressed.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import link
from .tables import written

CLASSES = ("white", "black", "hispanic", "asian", "other")
PARTS = ("last", "first", "middle")
#: Class shares of the population, and counts of physicians from which the second prior is normed.
POPULATION_PRIOR = {"white": 0.5783619, "black": 0.1205021, "hispanic": 0.1872988, "asian": 0.06106737, "other": 0.05276981}
PHYSICIAN_COUNTS = {"white": 29_395, "black": 3_451, "hispanic": 9_309, "asian": 8_524, "other": 1_959}
PHYSICIAN_PRIOR = {k: v / sum(PHYSICIAN_COUNTS.values()) for k, v in PHYSICIAN_COUNTS.items()}
#: Suffixes of surnames.
SUFFIXES = "JUNIOR|SENIOR|THIRD|III|JR|II|IV"
LEAST = 1e-300


def dictionary(tables: dict[str, DataFrame], name: str = "name", classes: Sequence[str] = CLASSES) -> DataFrame:
    """name_type, name, one likelihood for each class; one row for each name (ties to the largest values)."""
    out = None
    for kind, df in tables.items():
        one = link.unique_on(df.filter(F.col(name).isNotNull()), [name], [F.desc(c) for c in classes]).select(F.lit(kind).alias("name_type"), F.col(name).alias("name"), *[F.col(c).cast("double") for c in classes])
        out = one if out is None else out.unionByName(one)
    return out


def out_of_bounds(d: DataFrame, classes: Sequence[str] = CLASSES) -> DataFrame:
    """How many rows have a likelihood outside 0 to 1, and the extremes, by name type."""
    low, high = F.least(*classes), F.greatest(*classes)
    return d.groupBy("name_type").agg(F.count("*").alias("n"), F.count_if((low < 0) | (high > 1)).alias("bad"), F.min(low).alias("least"), F.max(high).alias("most"))


def name_parts(df: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """key, name_type, raw: upper-case, known names only."""
    items = F.array(*[F.struct(F.lit(kind).alias("name_type"), F.nullif(F.upper(F.trim(c)), F.lit("")).alias("raw")) for kind, c in columns.items()])
    return df.select(key, F.explode(items).alias("p")).select(key, "p.name_type", "p.raw").filter("raw is not null")


def candidates(parts: DataFrame, key: str) -> DataFrame:
    """Six candidates of each name in one pass, by priority: as it is, without signs, without spaces, without suffix, first and second part."""
    raw = F.col("raw")
    plain = F.trim(F.regexp_replace(raw, "[^A-Z0-9 ]", ""))
    joined = F.replace(plain, F.lit(" "), F.lit(""))
    senior = (F.length(joined) >= 7) & joined.endswith("SR")
    bare = F.when(F.col("name_type") == "last", F.when(senior, F.expr("left(j, length(j) - 2)")).otherwise(F.regexp_replace("j", f"({SUFFIXES})$", "")))
    token = F.regexp_replace(raw, "[- ]+", " ")
    rows = parts.withColumn("j", joined)
    made = [("raw uppercase", raw), ("punctuation removed", plain), ("spaces removed", F.col("j")), ("surname suffix removed", bare), ("first compound-name token", F.split_part(token, F.lit(" "), F.lit(1))), ("second compound-name token", F.split_part(token, F.lit(" "), F.lit(2)))]
    items = F.array(*[F.struct(F.lit(k + 1).alias("priority"), F.lit(m).alias("method"), F.nullif(c, F.lit("")).alias("candidate")) for k, (m, c) in enumerate(made)])
    return rows.select(key, "name_type", F.explode(items).alias("c")).select(key, "name_type", "c.*").filter("candidate is not null")


def best_names(cands: DataFrame, d: DataFrame, key: str) -> DataFrame:
    """The candidate of the highest priority that stands in the dictionary, for each key and name type: an aggregate, no ordered window."""
    named = d.withColumnRenamed("name", "candidate")
    found = cands.join(named, ["name_type", "candidate"])
    rest = [c for c in found.columns if c not in (key, "name_type", "priority")]
    best = found.groupBy(key, "name_type").agg(F.min(F.struct("priority", *rest)).alias("b"))
    return best.select(key, "name_type", "b.priority", *[f"b.{c}" for c in rest])


def wide_names(best: DataFrame, key: str, classes: Sequence[str] = CLASSES, parts: Sequence[str] = PARTS) -> DataFrame:
    """One row for each key: a match flag and likelihoods for each part."""
    values = F.struct(*[F.col(c) for c in classes])
    wide = best.groupBy(key).agg(*[F.max(F.when(F.col("name_type") == p, values)).alias(f"_{p}") for p in parts])
    return wide.select(key, *[F.col(f"_{p}").isNotNull().alias(f"{p}_match") for p in parts], *[F.col(f"_{p}.{c}").alias(f"{p}_{c}") for p in parts for c in classes])


def log_score(prior: float, c: str, parts: Sequence[str] = PARTS) -> Column:
    out = F.lit(float(np.log(prior)))
    for p in parts:
        out = out + F.when(F.col(f"{p}_match"), F.log(F.greatest(F.coalesce(F.col(f"{p}_{c}"), F.lit(0.0)), F.lit(LEAST)))).otherwise(0.0)
    return out


def posterior(df: DataFrame, prior: dict[str, float], prefix: str, applicable: Column, parts: Sequence[str] = PARTS) -> DataFrame:
    """prefix_class for each class: the softmax of the log scores; null where the model doesn't apply. Scores are one array, made once."""
    scores = F.array(*[log_score(p, c, parts) for c, p in prior.items()])
    powers = F.transform(F.array_compact(F.array("_s")), lambda s: F.transform(s, lambda x: F.exp(x - F.array_max(s))))
    df = df.withColumn("_s", F.when(applicable, scores)).withColumn("_e", F.get(powers, F.lit(0)))
    df = df.withColumn("_d", F.aggregate("_e", F.lit(0.0), lambda a, x: a + x))
    return df.withColumns({f"{prefix}_{c}": F.get("_e", F.lit(k)) / F.col("_d") for k, c in enumerate(prior)}).drop("_s", "_e", "_d")


def derived(prefix: str, classes: Sequence[str] = CLASSES, two: tuple[str, str] = ("black", "white")) -> dict[str, Column]:
    """Label, largest probability, mass of two classes, conditional probability of the first of them, entropy normed to 1."""
    from wardline.functions.labels import arg_max_label

    p = {c: F.col(f"{prefix}_{c}") for c in classes}
    terms = [F.when(x > 0, -x * F.log(x)).otherwise(0.0) for x in p.values()]
    mass = p[two[0]] + p[two[1]]
    return {
        f"{prefix}_label": arg_max_label(p),
        f"{prefix}_max": F.greatest(*p.values()),
        f"{prefix}_mass": mass,
        f"{prefix}_conditional": F.try_divide(p[two[0]], mass),
        f"{prefix}_entropy": F.when(p[two[0]].isNotNull(), sum(terms[1:], terms[0]) / F.log(F.lit(float(len(classes))))),
    }


def model(df: DataFrame, d: DataFrame, key: str, columns: dict[str, str], priors: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """Posteriors under each prior for each row; the model applies where last and first name are in the dictionary.

    The cascade runs on distinct names. Those that were found are written, and joined to the rows by part.
    """
    parts = name_parts(df, key, columns).select(F.col("raw").alias("_raw"), "name_type", "raw").distinct()
    found = written(best_names(candidates(parts, "_raw"), d, "_raw").select("_raw", "name_type", *CLASSES))
    out = df
    for p in PARTS:
        own = found.filter(F.col("name_type") == p).select(F.col("_raw").alias(f"_{p}"), F.struct(*CLASSES).alias(f"_s{p}"))
        out = out.withColumn(f"_{p}", F.nullif(F.upper(F.trim(columns[p])), F.lit("")) if p in columns else F.lit(None).cast("string")).join(own, f"_{p}", "left")
    values = {f"{p}_match": F.col(f"_s{p}").isNotNull() for p in PARTS} | {f"{p}_{c}": F.col(f"_s{p}.{c}") for p in PARTS for c in CLASSES}
    out = out.select(*df.columns, *[c.alias(n) for n, c in values.items()])
    for prefix, prior in (priors or {"population": POPULATION_PRIOR, "physician": PHYSICIAN_PRIOR}).items():
        out = posterior(out, prior, prefix, F.col("last_match") & F.col("first_match"))
        out = out.withColumns(derived(prefix))
    return out


def surname_model(census: DataFrame, columns: dict[str, str], total: str = "total") -> DataFrame:
    """Shares by surname from percentages in which suppressed cells are written (S)."""
    return census.select("name", *[(F.nullif(F.col(c), F.lit("(S)")).try_cast("double") / 100).alias(k) for k, c in columns.items()])


def pattern(parts: Sequence[str] = PARTS) -> Column:
    return F.concat_ws("+", *[F.when(F.col(f"{p}_match"), p) for p in parts])


def prior_sensitivity(df: DataFrame, a: str, b: str, classes: Sequence[str] = CLASSES) -> DataFrame:
    """Rows, agreeing labels, largest and mean difference of any class's probability between two priors; and probabilities that don't sum to 1."""
    gap = F.greatest(*[F.abs(F.col(f"{a}_{c}") - F.col(f"{b}_{c}")) for c in classes])
    total = sum((F.col(f"{a}_{c}") for c in classes), F.lit(0.0))
    return df.filter(F.col(f"{a}_max").isNotNull()).agg(F.count("*").alias("n"), F.count_if(F.col(f"{a}_label") == F.col(f"{b}_label")).alias("same_label"), F.max(gap).alias("max_gap"), F.avg(gap).alias("mean_gap"), F.count_if(F.abs(total - 1) > 1e-6).alias("bad_sums"))
