"""Least squares with many fixed effects and clustered errors.

Data stay distributed: effects are taken out on combinations of levels (`effects.demean`), and only k x k cross-products (`gram`) and
one score for each cluster and coefficient are aggregated. Iterations are written to the shared folder that spark.checkpoint.dir
names, so that a lost executor costs one round and the lineage stays short.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .effects import demean
from .gram import gram, grams
from .tables import stored as _cut, written
from .quantiles import exact_quantiles

__all__ = ["demean"]


# ---- design ----


def spline(c: Column, knots: Sequence[float]) -> dict[str, Column]:
    """Linear term and hinges."""
    return {"lin": c.cast("double")} | {f"k{k:g}": F.greatest(c.cast("double") - k, F.lit(0.0)) for k in knots}


def one_hot(c: Column, levels: Sequence, reference) -> dict[str, Column]:
    """0/1 for each level but the reference; null counts as no level."""
    return {str(v): F.coalesce((c == v).cast("double"), F.lit(0.0)) for v in levels if v != reference}


def imputed(c: Column, value: float) -> tuple[Column, Column]:
    """The column with a stated value for null, and the flag of where."""
    return F.coalesce(c.cast("double"), F.lit(float(value))), c.isNull().cast("double")


def interactions(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    return {f"{x}:{y}": p * q for x, p in a.items() for y, q in b.items()}


def complete(columns: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull()
    return out


def winsorized(df: DataFrame, value: str, limits: DataFrame, by: Sequence[str], limit: str, out: str) -> DataFrame:
    """min(value, limit of its partition)."""
    return df.join(limits.select(*by, limit), list(by), "left").withColumn(out, F.least(value, limit)).drop(limit)


POLICIES = {
    "common_primary": lambda outcomes: complete(outcomes),
    "los_outcome": lambda outcomes: F.col(outcomes[0]).isNotNull(),
    "charge_outcome": lambda outcomes: F.col(outcomes[1]).isNotNull(),
}


def sample(df: DataFrame, policy: str, outcomes: Sequence[str], eligible: str | None = None) -> DataFrame:
    out = df.filter(POLICIES[policy](outcomes))
    return out.filter(F.col(eligible)) if eligible else out


def drop_singletons(df: DataFrame, effects: Sequence[str], most: int = 50, weight: str | None = None) -> DataFrame:
    """Without rows that are alone in a level of any effect, until there are none. weight: how many rows a row stands for."""
    size = F.sum(weight) if weight else F.count("*")
    before = df.agg(size).first()[0]
    for _ in range(most):
        for e in effects:
            levels = df.groupBy(e).agg(size.alias("_size")).filter("_size > 1").select(F.col(e).alias("_e"))
            df = df.join(levels, F.col(e) == F.col("_e"), "left_semi")
        df = _cut(df)
        after = df.agg(size).first()[0]
        if after == before:
            return df
        before = after
    raise RuntimeError("singletons remain")


# ---- least squares ----

#: Up to so many columns rows that agree in all of them are summed before a fit; a wider design has next to no such rows.
ALIKE = 16


def alike(df: DataFrame, y: str, keys: Sequence[str], weight: str | None = None) -> DataFrame:
    """keys, y and _n: rows that agree in all keys as one, with their number (or sum of weights) and their mean of y. Rows without y go.

    Coefficients and clustered errors depend on rows through these sums alone, if the keys are the design, the effects and the clusters.
    The result is written, so that the rows are read once for all that follows.
    """
    own = df.filter(F.col(y).isNotNull()).select(*keys, F.col(y).cast("double").alias(y), (F.col(weight) if weight else F.lit(1)).cast("long").alias("_n"))
    if len(keys) > ALIKE or y in keys:
        return own
    return written(own.groupBy(*keys).agg((F.sum(F.col("_n") * F.col(y)) / F.sum("_n")).alias(y), F.sum("_n").alias("_n")))


def cross_products(df: DataFrame, x: Sequence[str], y: Sequence[str] = (), weight: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """X'X, X'y for all outcomes y, y'y and the number of rows, in one pass over rows without nulls."""
    total, n = gram(df, [*x, *y], weight)
    k = len(x)
    return total[:k, :k], total[:k, k:], np.diag(total)[k:].copy(), n


def independent(xx: np.ndarray, tolerance: float = 1e-9) -> list[int]:
    """Columns that earlier ones don't span, by a Cholesky factorisation in order: a pivot that falls below the tolerance is dropped."""
    kept: list[int] = []
    for j in range(len(xx)):
        if xx[j, j] <= 0:
            continue
        rest = xx[j, j]
        if kept:
            rest = xx[j, j] - xx[np.ix_([j], kept)] @ np.linalg.solve(xx[np.ix_(kept, kept)], xx[np.ix_(kept, [j])])
            rest = float(rest[0, 0])
        if rest > tolerance * xx[j, j]:
            kept.append(j)
    return kept


@dataclass
class Fit:
    names: list[str]
    dropped: list[str]
    beta: np.ndarray
    covariance: np.ndarray
    n: int
    clusters: dict[str, int]
    df: int
    sse: float
    condition: float

    def rows(self) -> list[tuple]:
        """(term, estimate, se, t, p, ci_low, ci_high, df, n); an error of a negative variance is missing."""
        out = []
        for k, name in enumerate(self.names):
            v, b = self.covariance[k, k], float(self.beta[k])
            se = float(np.sqrt(v)) if v >= 0 else float("nan")
            t = b / se if se > 0 else float("nan")
            q = t_quantile(0.975, self.df)
            out.append((name, b, se, t, t_two_sided(t, self.df), b - q * se, b + q * se, self.df, self.n))
        return out


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised, by the continued fraction."""
    from math import exp, lgamma, log

    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(b, a, 1 - x)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        step = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + step * d if abs(1 + step * d) > 1e-300 else 1e-300)
        c = 1 + step / c if abs(1 + step / c) > 1e-300 else 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def t_two_sided(t: float, df: float) -> float:
    return float("nan") if t != t else _incomplete_beta(df / 2, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    """By bisection; p over one half."""
    low, high = 0.0, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - t_two_sided(mid, df) / 2 < p else (low, mid)
    return (low + high) / 2


def scores(df: DataFrame, x: Sequence[str], residual: Column, cluster: Sequence[str]) -> DataFrame:
    """The sum of x_j times the residual in each cluster: no larger than clusters times k."""
    return df.groupBy(*cluster).agg(*[F.sum(F.col(c) * residual).alias(f"s{k}") for k, c in enumerate(x)])


def _meat(s: DataFrame, k: int) -> tuple[np.ndarray, int]:
    """The sum of the clusters' outer products, and the number of clusters."""
    return gram(s, [f"s{j}" for j in range(k)])


def cluster_sets(clusters: Sequence[str]) -> list[list[str]]:
    """Each cluster alone, and of two also their intersection, which is taken off."""
    return [[c] for c in clusters] + ([list(clusters)] if len(clusters) == 2 else [])


def covariance_of(bread: np.ndarray, scored: DataFrame, names: Sequence[str], residual: Column, clusters: Sequence[str], n: int, rank: int) -> tuple[np.ndarray, dict[str, int]]:
    """CRV1 by one cluster, or by two less that of their intersection: the covariance and the numbers of clusters."""
    covariance, counts = np.zeros((len(names), len(names))), {}
    for j, own in enumerate(cluster_sets(clusters)):
        meat, g = _meat(scores(scored, names, residual, own), len(names))
        counts["*".join(own)] = g
        factor = g / (g - 1) * (n - 1) / max(n - rank, 1) if g > 1 else float("nan")
        covariance += (-1 if j == 2 else 1) * factor * bread @ meat @ bread
    return (covariance + covariance.T) / 2, counts


def ols(df: DataFrame, y: str, x: Sequence[str], clusters: Sequence[str] = ()) -> Fit:
    """Coefficients and covariance: classical without clusters, CRV1 with one, and for two their sum less that of the intersection.

    Collinear columns are dropped. Rows whose design is zero throughout don't count towards n or the clusters.
    """
    df = df.filter(complete([y, *x, *clusters]))
    xx, xy, yy, _ = cross_products(df, x, [y])
    kept = independent(xx)
    names = [x[j] for j in kept]
    if not names:
        raise ValueError("no column can be estimated")
    xx, xy = xx[np.ix_(kept, kept)], xy[kept, 0]
    bread = np.linalg.inv(xx)
    beta = bread @ xy
    residual = F.col(y) - sum((float(b) * F.col(c) for b, c in zip(beta, names, strict=True)), F.lit(0.0))
    active = df.filter(F.greatest(*[F.abs(c) for c in names]) > 1e-12 if len(names) > 1 else F.abs(names[0]) > 1e-12)
    n, k = active.count(), len(names)
    sse = float(yy[0] - beta @ xy)
    counts: dict[str, int] = {}
    if not clusters:
        dof = max(n - k, 1)
        covariance = bread * sse / dof
    else:
        covariance, counts = covariance_of(bread, active, names, residual, clusters, n, k)
        dof = max(min(counts[c] for c in clusters) - 1, 1)
    return Fit(names, [c for c in x if c not in names], beta, covariance, n, counts, dof, sse, float(np.linalg.cond(xx)))


def fixed_effects(df: DataFrame, y: str, x: Sequence[str], effects: Sequence[str], clusters: Sequence[str]) -> tuple[Fit, dict]:
    """OLS on columns without the means of the effects."""
    keep = list(dict.fromkeys([y, *x, *effects, *clusters]))
    own = df.filter(complete(keep)).select(*[F.col(c) for c in keep])
    # an effect may also be a cluster: both keep their own column
    flat, how = demean(own, [y, *x], effects) if effects else (own.withColumns({c: F.col(c).cast("double") for c in (y, *x)}), {"converged": True, "rounds": 0})
    return ols(_cut(flat), y, x, clusters), how


def sequence(df: DataFrame, y: str, exposure: Sequence[str], controls: Sequence[str], specs: dict[str, Sequence[str]], clusters: Sequence[str]) -> DataFrame:
    """model_id, term, estimate, ... for each set of fixed effects; terms that the effects absorb drop out as collinear. No effects: an intercept."""
    out, spark = [], df.sparkSession
    for name, effects in specs.items():
        x = [*exposure, *controls]
        fit, how = fixed_effects(df if effects else df.withColumn("_one", F.lit(1.0)), y, x if effects else ["_one", *x], effects, clusters)
        out += [(name, *r, how["converged"]) for r in fit.rows() if r[0] in exposure]
    return spark.createDataFrame(out, "model_id string, term string, estimate double, se double, t double, p double, ci_low double, ci_high double, df int, n long, converged boolean")


FIT_SCHEMA = "estimate double, se double, t double, p double, ci_low double, ci_high double, df int, n long, converged boolean, note string"


def grouped_fits(df: DataFrame, group: str, y: str, x: Sequence[str], effects: Sequence[str], clusters: Sequence[str], expected: Sequence = (), weight: str | None = None) -> DataFrame:
    """group, term, estimate, ...: one fit for each group (a subset, a draw, a year left out), all of them in the same few jobs.

    Effects are those of each group; cross-products and scores are summed by group, so that only k x k numbers for each of them reach
    the driver. Collinear terms of a group are rows with a note, as is a group in which nothing can be estimated and an expected one
    without rows. Rows with a null in any of the columns go; errors as in ols(). weight: how many rows a row stands for, with y their mean.
    """
    keep = list(dict.fromkeys([group, y, *x, *effects, *clusters]))
    own, how = alike(df.filter(complete(keep)), y, [c for c in keep if c != y], weight), {"converged": True}
    if effects:
        names = [f"_g{k}" for k in range(len(effects))]
        own = own.withColumns({n: F.struct(F.col(group).alias("g"), F.col(e).alias("e")) for n, e in zip(names, effects, strict=True)})
        own, how = demean(own, [y, *x], names, "_n")
        own = own.drop(*names)
    else:
        own = own.withColumns({"_one": F.lit(1.0)} | {c: F.col(c).cast("double") for c in (y, *x)})
        x = ["_one", *x]
    own, k = _cut(own), len(x)
    active = F.greatest(*[F.abs(c) for c in x]) if k > 1 else F.abs(x[0])
    counts = dict(own.groupBy(group).agg(F.sum(F.when(active > 1e-12, F.col("_n")).otherwise(0))).collect())
    solved, betas = {}, []
    for g, (total, _) in grams(own, [*x, y], group, "_n").items():
        xx, xy = total[:k, :k], total[:k, k]
        kept, beta, bread = independent(xx), np.zeros(k), np.zeros((k, k))
        if kept:
            bread[np.ix_(kept, kept)] = np.linalg.inv(xx[np.ix_(kept, kept)])
            beta = bread @ xy
        solved[g] = (int(counts[g]), kept, beta, bread)
        betas.append((g, beta.tolist()))
    spark = df.sparkSession
    kind = df.select(group).schema[0].dataType.simpleString()
    fitted = own.join(spark.createDataFrame(betas, f"{group} {kind}, _b array<double>"), group)
    residual = F.col(y) - sum((F.get("_b", F.lit(j)) * F.col(c) for j, c in enumerate(x)), F.lit(0.0))
    fitted = fitted.filter(active > 1e-12).withColumn("_u", F.col("_n") * residual)
    meats = []
    for own_set in cluster_sets(clusters):
        meats.append(grams(scores(fitted, x, F.col("_u"), [group, *own_set]), [f"s{j}" for j in range(k)], group))
    out = []
    for g, (n, kept, beta, bread) in solved.items():
        if not kept or not n:
            out.append((g, None, *[None] * 7, 0, how["converged"], "no column can be estimated"))
            continue
        covariance, least = np.zeros((k, k)), None
        for j, m in enumerate(meats):
            meat, clusters_n = m[g]
            factor = clusters_n / (clusters_n - 1) * (n - 1) / max(n - len(kept), 1) if clusters_n > 1 else float("nan")
            covariance += (-1 if j == 2 else 1) * factor * bread @ meat @ bread
            least = clusters_n if least is None else min(least, clusters_n) if j < 2 else least
        fit = Fit([x[j] for j in kept], [x[j] for j in range(k) if j not in kept], beta[kept], covariance[np.ix_(kept, kept)], n, {}, max((least or n) - 1, 1), 0.0, 0.0)
        out += [(g, *r, how["converged"], None) for r in fit.rows() if r[0] != "_one"]
        out += [(g, c, *[None] * 7, n, how["converged"], "collinear") for c in fit.dropped]
    out += [(g, None, *[None] * 7, 0, False, "no row") for g in expected if g not in solved]
    return spark.createDataFrame(out, f"{group} {kind}, term string, {FIT_SCHEMA}")


def stacked(df: DataFrame, subsets: dict[str, Column], name: str = "subset") -> DataFrame:
    """Each row once for every subset whose condition it meets, in one scan."""
    items = F.array(*[F.struct(F.lit(k).alias("k"), F.coalesce(c, F.lit(False)).alias("c")) for k, c in subsets.items()])
    return df.withColumn(name, F.explode(F.transform(F.filter(items, lambda s: s["c"]), lambda s: s["k"])))


def refits(df: DataFrame, subsets: dict[str, Column], y: str, x: Sequence[str], effects: Sequence[str], clusters: Sequence[str]) -> DataFrame:
    """The same model on each subset: years left out, complete cases, volumes, exact subsets, influential units left out. An empty subset is a row with a note."""
    return grouped_fits(stacked(df, subsets), "subset", y, x, effects, clusters, list(subsets))


def refit_summary(refitted: DataFrame) -> DataFrame:
    return refitted.filter(F.col("estimate").isNotNull()).groupBy("term").agg(F.count("*").alias("refits"), F.min("estimate").alias("least"), F.percentile("estimate", F.lit(0.5)).alias("median"), F.max("estimate").alias("most"))


def influence(cluster_scores: DataFrame, cluster: str, score: str, k: int = 10) -> DataFrame:
    """The k clusters whose score shifts a coefficient most when left out, to first order."""
    return cluster_scores.select(cluster, (-F.col(score)).alias("shift"), F.abs(F.col(score)).alias("size")).orderBy(F.desc("size"), cluster).limit(k)


def influence_summary(cluster_scores: DataFrame, score: str) -> DataFrame:
    """clusters, and the exact 99th percentile and the largest of the shifts that leaving one of them out makes, to first order."""
    sizes = cluster_scores.select(F.abs(F.col(score)).alias("size"))
    return sizes.agg(F.count("size").alias("clusters"), F.max("size").alias("largest")).join(exact_quantiles(sizes, [], "size", {"p99": 0.99}))


def influence_scores(df: DataFrame, fit: Fit, y: str, term: str, cluster: str) -> DataFrame:
    """cluster, score: each cluster's part in one coefficient."""
    return influences(df, fit, y, [term], cluster).withColumnRenamed("s0", "score")


def influences(df: DataFrame, fit: Fit, y: str, terms: Sequence[str], cluster: str) -> DataFrame:
    """cluster, s0, s1, ...: each cluster's part in the coefficients of terms, in one pass."""
    own = df.filter(complete([y, *fit.names]))
    bread = np.linalg.inv(cross_products(own, fit.names)[0])
    residual = F.col(y) - sum((float(b) * F.col(c) for b, c in zip(fit.beta, fit.names, strict=True)), F.lit(0.0))
    directions = [sum((float(b) * F.col(c) for b, c in zip(bread[fit.names.index(t)], fit.names, strict=True)), F.lit(0.0)) for t in terms]
    return own.groupBy(cluster).agg(*[F.sum(d * residual).alias(f"s{j}") for j, d in enumerate(directions)])


def influential(df: DataFrame, outcomes: Sequence[str], x: Sequence[str], term: str, effects: Sequence[str], cluster: str, k: int = 10) -> DataFrame:
    """outcome, cluster, rank, shift: for each outcome the k clusters whose leaving out moves a coefficient most, to first order (ties
    by cluster). All outcomes are taken through the effects together."""
    keep = list(dict.fromkeys([*outcomes, *x, *effects, cluster]))
    flat, _ = demean(df.filter(complete(keep)).select(*keep, F.col(cluster).alias("_c")), [*outcomes, *x], effects)
    flat, out = _cut(flat), None
    for y in outcomes:
        s = influence_scores(flat, ols(flat, y, x), y, term, "_c")
        own = influence(s, "_c", "score", k).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("size"), "_c")))  # k rows
        own = own.select(F.lit(y).alias("outcome"), F.col("_c").alias(cluster), "rank", "shift")
        out = own if out is None else out.unionByName(own)
    return out


def without_influential(df: DataFrame, outcomes: Sequence[str], x: Sequence[str], term: str, effects: Sequence[str], cluster: str, k: int = 10) -> DataFrame:
    """outcome, left_out, n, estimate, shift: every outcome's coefficient without each cluster that `influential` names for any outcome.

    Where the effects are nested in the cluster (each level is seen in one cluster only), what the effects take out of the other rows
    doesn't change, so that an exact refit is the full fit's cross-products less the cluster's own. They are summed for the named
    clusters alone, k times the outcomes at most. Otherwise each is refitted. left_out null: the full fit.
    """
    named = [r[0] for r in influential(df, outcomes, x, term, effects, cluster, k).select(cluster).distinct().orderBy(cluster).collect()]
    keep = list(dict.fromkeys([*outcomes, *x, *effects, cluster]))
    own = df.filter(complete(keep)).select(*keep)
    kind = df.select(cluster).schema[0].dataType.simpleString()
    nested = all(own.groupBy(e).agg((F.min(cluster) < F.max(cluster)).alias("_more")).filter("_more").isEmpty() for e in effects)
    if nested:
        flat = _cut(demean(own.withColumn("_c", F.col(cluster)), [*outcomes, *x], effects)[0])
        total, n = gram(flat, [*x, *outcomes])
        parts = grams(flat.filter(F.col("_c").isin(named)), [*x, *outcomes], "_c")
        fits = {None: (total, n)} | {c: (total - parts[c][0], n - parts[c][1]) for c in named}
        p, j, rows = len(x), list(x).index(term), []
        for c, (zz, rest) in fits.items():
            kept = independent(zz[:p, :p])
            beta = np.linalg.solve(zz[np.ix_(kept, kept)], zz[np.ix_(kept, range(p, p + len(outcomes)))]) if j in kept else None
            rows += [(y, c, rest, None if beta is None else float(beta[kept.index(j), m])) for m, y in enumerate(outcomes)]
    else:
        rows = []
        for y in outcomes:
            for c in (None, *named):
                fit, _ = fixed_effects(own if c is None else own.filter(F.col(cluster) != c), y, x, effects, [])
                rows.append((y, c, fit.n, float(fit.beta[fit.names.index(term)]) if term in fit.names else None))
    full = {y: e for y, c, _, e in rows if c is None}
    return df.sparkSession.createDataFrame([(*r, None if r[3] is None or full[r[0]] is None else r[3] - full[r[0]]) for r in rows], f"outcome string, left_out {kind}, n long, estimate double, shift double")


def row_count_over(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Volumes of partitions without an aggregate and join, for frames that are grouped by these keys anyway."""
    return df.withColumn("volume", F.count("*").over(Window.partitionBy(*by)))
