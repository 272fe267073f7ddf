"""Generalised linear models with fixed effects: reweighted least squares, two-way clustered errors, average marginal contrasts."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .effects import demean
from .gram import gram
from .tables import stored, written
from .models import ALIKE, Fit, complete, covariance_of, cross_products, drop_singletons, independent

#: Bounds of the linear predictor, by the link.
MOST_ETA = {"binomial_logit": 25.0, "poisson_log": 20.0, "gamma_log": 20.0}
#: Until the deviance moves by less than this share, effects are taken out less exactly.
EXACT_FROM, LOOSE = 1e-3, ((1e-4, 200),)
#: What a row of `summed` tells of the rows it stands for: their number, the squares of the outcome round its mean, what their deviance
#: has beside that of the mean, and the least and the largest outcome.
SUMS = ["_n", "_squares", "_within", "_least", "_most"]
#: The normal quantile of 95 % intervals, as published.
Z95 = 1.96


@dataclass
class Glm:
    """A fitted model. fitted: its rows (outcome, design, clusters), those that are alike as one with their number _n and their mean
    outcome, with _eta, the linear predictor including the effects."""

    kind: str
    y: str
    fit: Fit
    fitted: DataFrame
    deviance: float
    dispersion: float
    rounds: int
    converged: bool

    def rows(self) -> list[tuple]:
        """(term, estimate, se, z, p, ci_low, ci_high, n)"""
        return [(name, *_normal(float(b), float(v)), self.fit.n) for name, b, v in zip(self.fit.names, self.fit.beta, np.diag(self.fit.covariance), strict=True)]


def _normal(estimate: float, variance: float) -> tuple[float, float, float, float, float, float]:
    se = math.sqrt(variance) if variance >= 0 else float("nan")
    z = estimate / se if se > 0 else float("nan")
    return estimate, se, z, math.erfc(abs(z) / math.sqrt(2)), estimate - Z95 * se, estimate + Z95 * se


def inverse_link(kind: str, eta: Column) -> tuple[Column, Column]:
    """The mean and its derivative."""
    e = F.greatest(F.least(eta, F.lit(MOST_ETA[kind])), F.lit(-MOST_ETA[kind]))
    if kind == "binomial_logit":
        mu = 1 / (1 + F.exp(-e))
        return mu, mu * (1 - mu)
    return F.exp(e), F.exp(e)


def variance_of(kind: str, mu: Column) -> Column:
    return {"binomial_logit": mu * (1 - mu), "poisson_log": mu, "gamma_log": mu * mu}[kind]


def _family(kind: str, eta: Column, y: Column) -> tuple[Column, Column, Column, Column]:
    """mean, weight, working response, deviance."""
    mu, slope = inverse_link(kind, eta)
    e = F.greatest(F.least(eta, F.lit(MOST_ETA[kind])), F.lit(-MOST_ETA[kind]))
    z = e + (y - mu) / F.greatest(slope, F.lit(1e-10))
    if kind == "binomial_logit":
        return mu, F.greatest(slope, F.lit(1e-10)), z, -2 * (y * F.log(mu) + (1 - y) * F.log(1 - mu))
    if kind == "poisson_log":
        return mu, mu, z, 2 * F.when(y > 0, y * F.log(y / mu) - (y - mu)).otherwise(mu)
    return mu, F.lit(1.0), z, 2 * ((y - mu) / mu - F.log(F.greatest(y / mu, F.lit(1e-12))))


def summed(df: DataFrame, outcomes: dict[str, tuple[str, str | None]], keys: Sequence[str]) -> dict[str, DataFrame]:
    """For each outcome {name: (family, restriction or None)} keys, its mean and SUMS: rows that agree in all keys as one, from one scan.

    With keys that are the design, the effects and the clusters, coefficients, errors and deviance depend on the rows through these
    alone: the deviance is that of the mean, as often as there are rows, and a rest without the fitted mean. Outcomes that are not
    positive, for which a logarithm has bounds, are summed apart. With more than ALIKE keys the rows stay as they are. Nulls go.
    """
    df = df.filter(complete(keys))
    if len(keys) > ALIKE or set(outcomes) & set(keys):
        own = {y: df.filter(F.coalesce(F.expr(where or "true"), F.lit(False)) & F.col(y).isNotNull()) for y, (_, where) in outcomes.items()}
        return {y: stored(d.select(*[k for k in keys if k != y], F.col(y).cast("double").alias(y), F.lit(1).alias("_n"), F.lit(0.0).alias("_squares"), F.lit(0.0).alias("_within"), *[F.col(y).cast("double").alias(c) for c in SUMS[3:]])) for y, d in own.items()}
    items = []
    for y, (kind, where) in outcomes.items():
        v = F.col(y).cast("double")
        rest = {"binomial_logit": F.lit(0.0), "poisson_log": v * F.log(v), "gamma_log": -F.log(v)}[kind]
        items.append(F.struct(F.lit(y).alias("o"), v.alias("y"), (v > 0).alias("up"), F.when(v > 0, rest).alias("rest"), (F.coalesce(F.expr(where or "true"), F.lit(False)) & v.isNotNull()).alias("c")))
    rows = df.select(*keys, F.explode(F.filter(F.array(*items), lambda s: s["c"])).alias("s")).select(*keys, F.col("s.o").alias("_o"), F.col("s.y").alias("_y"), F.col("s.up").alias("_up"), F.col("s.rest").alias("_rest"))
    v = F.col("_y")
    cells = written(rows.groupBy(*keys, "_o", "_up").agg(F.count("*").alias("_n"), F.avg(v).alias("_mean"), (F.var_pop(v) * F.count("*")).alias("_squares"), F.sum("_rest").alias("_rest"), F.min(v).alias("_least"), F.max(v).alias("_most")))
    out = {}
    for y, (kind, _) in outcomes.items():
        m, n = F.col("_mean"), F.col("_n")
        within = {"binomial_logit": F.lit(0.0), "poisson_log": 2 * (F.col("_rest") - n * m * F.log(m)), "gamma_log": 2 * (F.col("_rest") + n * F.log(m))}[kind]
        out[y] = cells.filter(F.col("_o") == y).withColumn("_within", F.when(F.col("_up"), within).otherwise(0.0)).select(*keys, m.alias(y), *SUMS)
    return out


def glm(df: DataFrame, y: str, x: Sequence[str], effects: Sequence[str], kind: str, clusters: Sequence[str] = (), most: int = 40, tolerance: float = 1e-8) -> Glm:
    """Iteratively reweighted least squares; effects are taken out by weighted least squares in every step, and a step that raises the
    deviance is halved, seven times at most. The first steps take them out roughly.

    Rows that are alike are summed first (`summed`). Rows with a null in any of the columns go, as do, with effects, rows that are
    alone in a level; without effects there is an intercept, "_one". Collinear columns drop out. It has converged when neither the
    deviance nor a coefficient moves by more than the tolerance. Errors are clustered by one or two columns, with the small-sample
    factor g / (g - 1) * (n - 1) / (n - k) of each set of clusters. dispersion is Pearson's, over n less columns and levels.
    """
    if kind not in MOST_ETA:
        raise ValueError(f"no family {kind}")
    return fitted(summed(df, {y: (kind, None)}, list(dict.fromkeys([*x, *effects, *clusters])))[y], y, x, effects, kind, clusters, most, tolerance)


def fitted(df: DataFrame, y: str, x: Sequence[str], effects: Sequence[str], kind: str, clusters: Sequence[str] = (), most: int = 40, tolerance: float = 1e-8) -> Glm:
    """glm() of the rows that `summed` gives."""
    df = drop_singletons(df, effects, weight="_n") if effects else df.withColumn("_one", F.lit(1.0))
    x = list(x) if effects else ["_one", *x]
    keep = list(dict.fromkeys([y, *x, *effects, *clusters, *SUMS]))
    outcome = F.col(y).cast("double")
    rows = F.col("_n")
    n, mean, distinct = df.agg(F.sum(rows), F.sum(rows * outcome) / F.sum(rows), F.min("_least") < F.max("_most")).first()
    if not n:
        raise ValueError("no row")
    if kind == "binomial_logit" and not distinct:
        raise ValueError("the outcome has one value")
    mean = min(max(mean, 1e-4), 1 - 1e-4) if kind == "binomial_logit" else max(mean, 1e-4)
    df = df.withColumn("_eta", F.lit(math.log(mean / (1 - mean)) if kind == "binomial_logit" else math.log(mean)))
    deviance = df.agg(F.sum(rows * _family(kind, F.col("_eta"), outcome)[3] + F.col("_within"))).first()[0]
    cols, beta, moved = ["_r", *[f"_x{j}" for j in range(len(x))]], np.zeros(len(x)), math.inf
    for k in range(most):
        _, w, z, _ = _family(kind, F.col("_eta"), outcome)
        step = df.withColumns({"_w": rows * w, "_z": z}).withColumns({"_r": F.col("_z")} | {f"_x{j}": F.col(c).cast("double") for j, c in enumerate(x)})
        exact = moved < EXACT_FROM
        flat = stored(demean(step, cols, effects, "_w", *([] if exact else [LOOSE]))[0] if effects else step)
        xx, xy, _, _ = cross_products(flat, cols[1:], ["_r"], "_w")
        kept, before, beta = independent(xx), beta, np.zeros(len(x))
        if not kept:
            raise ValueError("no column can be estimated")
        beta[kept] = np.linalg.solve(xx[np.ix_(kept, kept)], xy[kept, 0])
        explained = sum((float(b) * F.col(f"_x{j}") for j, b in enumerate(beta)), F.lit(0.0))
        target = F.col("_z") - (F.col("_r") - explained)  # what the effects and the model explain of the working response
        sizes = [0.5**m for m in range(8)]
        after = flat.agg(*[F.sum(rows * _family(kind, F.col("_eta") + s * (target - F.col("_eta")), outcome)[3] + F.col("_within")) for s in sizes]).first()
        size, now = next(((s, d) for s, d in zip(sizes, after, strict=True) if d <= deviance * (1 + 1e-10) + 1e-12 or not k), (sizes[-1], after[-1]))
        beta = before + size * (beta - before)
        df = flat.select(*keep, (F.col("_eta") + size * (target - F.col("_eta"))).alias("_eta"), *[F.col(c).alias(f"_d{c}") for c in cols])
        moved = abs(deviance - now) / max(abs(now), 1.0)
        done = exact and moved <= tolerance and float(np.abs(beta - before).max()) <= max(tolerance, 1e-7)
        deviance, df = now, stored(df)
        if done:
            break
    names = [x[j] for j in kept]
    bread = np.linalg.inv(xx[np.ix_(kept, kept)])
    mu = inverse_link(kind, F.col("_eta"))[0]
    error = rows * ((outcome - mu) / F.greatest(mu, F.lit(1e-10)) if kind == "gamma_log" else outcome - mu)
    covariance, counts = (bread, {})
    if clusters:
        covariance, counts = covariance_of(bread, df, [f"_d_x{j}" for j in kept], error, clusters, n, len(kept))
    levels = df.agg(F.sum((F.col("_squares") + rows * (outcome - mu) ** 2) / variance_of(kind, mu)), *[F.count_distinct(e) for e in effects]).first()
    free = n - len(kept) - sum(levels[1:]) + max(len(effects) - 1, 0)
    dof = max(min(counts[c] for c in clusters) - 1, 1) if clusters else max(n - len(kept), 1)
    fit = Fit(names, [c for c in x if c not in names], beta[kept], covariance, n, counts, dof, float(deviance), float(np.linalg.cond(xx[np.ix_(kept, kept)])))
    return Glm(kind, y, fit, df.select(*keep, "_eta"), float(deviance), float(levels[0]) / max(free, 1), k + 1, bool(done))


def marginal_contrast(model: Glm, a: str, b: str, product: str) -> dict[str, float]:
    """The average over all fitted rows of mu(1, 1) - mu(1, 0) - mu(0, 1) + mu(0, 0), where a row's a, b and product are set and all
    else, its effects included, stays; with the error of the delta method, and the four means.

    The means and their gradients are cross-products of one aggregate.
    """
    fit, settings = model.fit, {"11": (1, 1, 1), "10": (1, 0, -1), "01": (0, 1, -1), "00": (0, 0, 1)}
    if missing := {a, b, product} - set(fit.names):
        raise ValueError(f"{sorted(missing)} can't be estimated")
    coefficient = dict(zip(fit.names, map(float, fit.beta), strict=True))
    df, others = model.fitted, [c for c in fit.names if c not in (a, b, product)]
    columns = {f"_o{j}": F.col(c).cast("double") for j, c in enumerate(others)} | {"_1": F.lit(1.0)}
    for name, (p, q, _) in settings.items():
        set_ = {a: p, b: q, product: p * q}
        eta = F.col("_eta") + sum((coefficient[c] * (F.lit(float(v)) - F.col(c)) for c, v in set_.items()), F.lit(0.0))
        mu, slope = inverse_link(model.kind, eta)
        columns |= {f"_m{name}": mu, f"_s{name}": slope}
    total, _ = gram(df.select("_n", *[c.alias(k) for k, c in columns.items()]), list(columns), "_n")
    at = {c: k for k, c in enumerate(columns)}
    n = total[at["_1"], at["_1"]]
    mean = {name: total[at[f"_m{name}"], at["_1"]] / n for name in settings}
    gradient = np.zeros(len(fit.names))
    for name, (p, q, sign) in settings.items():
        slopes = total[at[f"_s{name}"]] / n
        own = {a: p, b: q, product: p * q}
        gradient += sign * np.array([own[c] * slopes[at["_1"]] if c in own else slopes[at[f"_o{others.index(c)}"]] for c in fit.names])
    estimate = sum(sign * mean[name] for name, (_, _, sign) in settings.items())
    out = dict(zip(("estimate", "se", "z", "p", "ci_low", "ci_high"), _normal(float(estimate), max(float(gradient @ fit.covariance @ gradient), 0.0)), strict=True))
    return out | {f"mean_{name}": float(m) for name, m in mean.items()}


CONTRAST_SCHEMA = "outcome string, family string, term string, link_estimate double, link_se double, link_p double, contrast double, contrast_se double, contrast_p double, percent_of_mean double, mean_11 double, mean_10 double, mean_01 double, mean_00 double, outcome_mean double, dispersion double, n long, converged boolean, note string"


def pair_models(df: DataFrame, outcomes: dict[str, tuple[str, str | None]], a: str, b: str, product: str, controls: Sequence[str], effects: Sequence[str], clusters: Sequence[str]) -> DataFrame:
    """For each outcome {name: (family, restriction or None)} the interaction on the link's scale and the average marginal contrast.

    restriction: a SQL condition on the rows (a gamma model has the positive outcomes). What can't be fitted is a row with a note.
    The rows are read once for all outcomes.
    """
    out, x = [], [a, b, product, *controls]
    own = summed(df, outcomes, list(dict.fromkeys([*x, *effects, *clusters])))
    for y, (kind, _) in outcomes.items():
        try:
            model = fitted(own[y], y, x, effects, kind, clusters)
            pair = marginal_contrast(model, a, b, product)
        except (ValueError, np.linalg.LinAlgError) as e:
            out.append((y, kind, product, *[None] * 13, 0, False, str(e)[:100]))
            continue
        row = next(r for r in model.rows() if r[0] == product)
        mean = float(model.fitted.agg(F.sum(F.col("_n") * F.col(y)) / F.sum("_n")).first()[0])
        out.append((y, kind, product, row[1], row[2], row[4], pair["estimate"], pair["se"], pair["p"], 100 * pair["estimate"] / mean if mean else None, *[pair[f"mean_{k}"] for k in ("11", "10", "01", "00")], mean, model.dispersion, model.fit.n, model.converged, None))
    return df.sparkSession.createDataFrame(out, CONTRAST_SCHEMA)
