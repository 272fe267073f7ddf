"""Cell models: cell weights that sum to 1, fitted by a pseudo-inverse; predictions and contrasts where data and support allow them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .effects import demean
from .gram import grams
from .tables import written
from .models import alike, cluster_sets, complete, scores, t_quantile, t_two_sided

#: What a functional may lack of the row space, relative to its size; how negative a variance may be by rounding.
IDENTIFIED, NEGATIVE = 1e-8, -1e-12


@dataclass
class CellFit:
    """names: cells, then controls. flat: what was fitted, rows that are alike as one of _n, without the effects' means."""

    names: list[str]
    cells: list[str]
    beta: np.ndarray
    covariance: np.ndarray
    bread: np.ndarray
    projector: np.ndarray
    rank: int
    n: int
    df: int
    counts: dict[str, int]
    mean: float
    composition: np.ndarray
    flat: DataFrame
    y: str

    def functional(self, target: np.ndarray, anchor: float = 0.0) -> dict:
        """anchor + target'beta with its error, and whether the data identify it: what the target lacks of the row space, by length."""
        off = float(np.linalg.norm(target - self.projector @ target) / max(np.linalg.norm(target), 1.0))
        variance = float(target @ self.covariance @ target)
        estimate, valid = anchor + float(target @ self.beta), bool(np.isfinite(variance) and variance >= NEGATIVE)
        se = float(np.sqrt(max(variance, 0.0))) if valid else None
        t = estimate / se if off <= IDENTIFIED and se else None
        width = t_quantile(0.975, self.df) * se if se is not None else None
        return {
            "estimate": estimate, "se": se, "t": t, "p": t_two_sided(t, self.df) if t is not None else None, "ci_low": None if width is None else estimate - width, "ci_high": None if width is None else estimate + width,
            "identified": off <= IDENTIFIED, "row_space_error": off, "variance_valid": valid, "df": self.df, "n": self.n,
        }

    def prediction(self, cell: str, adjusted: bool) -> dict:
        """A cell's mean; adjusted: what the outcome's mean becomes if every row's cell weights are this cell's alone."""
        target = np.zeros(len(self.names))
        if adjusted:
            target[: len(self.cells)] = -self.composition
        target[self.cells.index(cell)] += 1.0
        return self.functional(target, self.mean if adjusted else 0.0)

    def contrast(self, weights: dict[str, float]) -> dict:
        return self.functional(np.array([float(weights.get(c, 0.0)) for c in self.names]))


def pseudo_inverse(xx: np.ndarray, terms: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """Inverse on the row space, the projector onto it, and the rank, by eigenvalues above k epsilon times the number of terms that
    were summed (10 at least) for columns of length 1: what the rounding of the sums can leave of a column that others span."""
    size = np.sqrt(np.diag(xx))
    size[size == 0] = 1.0
    values, vectors = np.linalg.eigh((xx + xx.T) / 2 / np.outer(size, size))
    some = values > len(xx) * np.finfo(float).eps * max(terms, 10)
    v = np.linalg.qr(vectors[:, some] * size[:, None])[0]
    return v @ np.linalg.inv(v.T @ xx @ v) @ v.T, v @ v.T, int(some.sum())


def fit_cells(df: DataFrame, y: str, cells: Sequence[str], controls: Sequence[str], effects: Sequence[str], clusters: Sequence[str]) -> CellFit:
    """Least squares on cell weights and controls after the effects; rows with a null in any of the columns go."""
    fits = fit_groups(df.withColumn("_all", F.lit(0)), "_all", y, cells, controls, effects, clusters)
    if 0 not in fits:
        raise ValueError("no row")
    return fits[0]


def fit_groups(df: DataFrame, group: str, y: str, cells: Sequence[str], controls: Sequence[str], effects: Sequence[str], clusters: Sequence[str], weight: str | None = None) -> dict[object, CellFit]:
    """fit_cells for every group (a draw, a subset), all in the same few jobs; effects are those of each group.

    weight: how many rows a row stands for, all of the same design, with y their mean.
    """
    names = [*cells, *controls]
    keep = list(dict.fromkeys([group, y, *names, *effects, *clusters]))
    own = alike(df.filter(complete(keep)), y, [c for c in keep if c != y], weight)
    levels = {r[0]: r for r in own.groupBy(group).agg(*[F.sum(F.col("_n") * F.col(c).cast("double")) / F.sum("_n") for c in (y, *cells)], F.sum("_n")).collect()}
    if effects:
        within = {f"_g{k}": F.struct(F.col(group).alias("g"), F.col(e).alias("e")) for k, e in enumerate(effects)}
        own = demean(own.withColumns(within), [y, *names], list(within), "_n")[0].drop(*within)
    flat = written(own.withColumns({c: F.col(c).cast("double") for c in (y, *names)}))
    solved = {}
    for g, (total, terms) in grams(flat, [*names, y], group, "_n").items():
        bread, projector, rank = pseudo_inverse(total[:-1, :-1], terms)
        solved[g] = (bread, projector, rank, int(levels[g][-1]), bread @ total[:-1, -1])
    kind = df.select(group).schema[0].dataType.simpleString()
    betas = df.sparkSession.createDataFrame([(g, s[-1].tolist()) for g, s in solved.items()], f"`{group}` {kind}, _b array<double>")
    residual = F.col(y) - sum((F.get("_b", F.lit(j)) * F.col(c) for j, c in enumerate(names)), F.lit(0.0))
    fitted = flat.join(betas, group)  # a row for each group: broadcast by its size
    meats = [grams(scores(fitted, names, F.col("_n") * residual, [group, *s]), [f"s{j}" for j in range(len(names))], group) for s in cluster_sets(clusters)]
    out = {}
    for g, (bread, projector, rank, n, beta) in solved.items():
        covariance, counts = np.zeros_like(bread), {}
        for j, (s, m) in enumerate(zip(cluster_sets(clusters), meats, strict=True)):
            meat, many = m[g]
            counts["*".join(s)] = many
            factor = many / (many - 1) * (n - 1) / max(n - rank, 1) if many > 1 else float("nan")
            covariance += (-1 if j == 2 else 1) * factor * bread @ meat @ bread
        level = np.array(levels[g][1:-1], float)
        out[g] = CellFit(names, list(cells), beta, (covariance + covariance.T) / 2, bread, projector, rank, n, max(min(counts[c] for c in clusters) - 1, 1), counts, float(level[0]), level[1:], flat.filter(F.col(group) == g), y)
    return out


def residual_of(names: Sequence[str], beta: np.ndarray, y: str) -> Column:
    return F.col(y) - sum((float(b) * F.col(c) for b, c in zip(beta, names, strict=True)), F.lit(0.0))


def status_of(result: dict, support: dict[str, tuple[bool, bool]], cells: Sequence[str]) -> str:
    """Identification comes before variance, and both before support (passed, limited) of all cells that are involved."""
    if not result["identified"]:
        return "NON_ESTIMABLE_IDENTIFICATION"
    if not result["variance_valid"]:
        return "NON_ESTIMABLE_VARIANCE"
    known = [support.get(c, (False, False)) for c in cells]
    if not all(p for p, _ in known):
        return "NON_ESTIMABLE_SUPPORT"
    return "LIMITED_SUPPORT" if any(x for _, x in known) else "PASS"


RESULT_SCHEMA = "model_id string, kind string, name string, estimate double, se double, t double, p double, ci_low double, ci_high double, identified boolean, row_space_error double, variance_valid boolean, df int, n long, status string"


def directional_models(df: DataFrame, y: str, cells: Sequence[str], controls: Sequence[str], specs: dict[str, Sequence[str]], clusters: Sequence[str], contrasts: dict[str, dict[str, float]], support: DataFrame, predicted: Sequence[str] = ("U0", "M2")) -> tuple[DataFrame, dict[str, CellFit]]:
    """Predictions of all cells and all contrasts, with their status, for each model {id: effects}; and the fits.

    A model without effects has the cells alone and predicts their means; one with effects has the controls and predicts the
    outcome's mean with every row in that cell. support: cell, passed, limited (a row for each cell; a few dozen). Models not in
    `predicted` have contrasts only.
    """
    known = {r["cell"]: (bool(r["passed"]), bool(r["limited"])) for r in support.select("cell", "passed", "limited").collect()}
    out, fits = [], {}
    for model, effects in specs.items():
        fit = fits[model] = fit_cells(df, y, cells, controls if effects else [], effects, clusters)
        found = [("prediction", c, fit.prediction(c, bool(effects)), [c]) for c in cells] if model in predicted else []
        found += [("contrast", name, fit.contrast(w), [c for c, v in w.items() if v]) for name, w in contrasts.items()]
        out += [(model, kind, name, r["estimate"], r["se"], r["t"], r["p"], r["ci_low"], r["ci_high"], r["identified"], r["row_space_error"], r["variance_valid"], r["df"], r["n"], status_of(r, known, own)) for kind, name, r, own in found]
    return df.sparkSession.createDataFrame(out, RESULT_SCHEMA), fits


def cell_model(df: DataFrame, y: str, cells: Sequence[str], controls: Sequence[str], effects: Sequence[str], clusters: Sequence[str], contrasts: dict[str, dict[str, float]]) -> DataFrame:
    """contrast, estimate, se, identified, n, df; nulls where the data don't identify a contrast."""
    fit, out = fit_cells(df, y, cells, controls, effects, clusters), []
    for name, weights in contrasts.items():
        r = fit.contrast(weights)
        out.append((name, r["estimate"] if r["identified"] else None, r["se"] if r["identified"] else None, r["identified"], r["n"], r["df"]))
    return df.sparkSession.createDataFrame(out, "contrast string, estimate double, se double, identified boolean, n long, df int")


# ---- bootstrap ----

#: Clusters whose signs a task holds at a time.
BLOCK_CLUSTERS = 500


def signs_of(seed: int, cluster: str, draws: int) -> np.ndarray:
    """A cluster's signs in all draws: draw d has bit d of the SHA-256 of seed, cluster and block, 256 draws a block, highest bit first.
    They are the same in every task and for every contrast."""
    raw = b"".join(hashlib.sha256(f"{seed}|{cluster}|{k}".encode()).digest() for k in range(-(-draws // 256)))
    return 1.0 - 2.0 * np.unpackbits(np.frombuffer(raw, np.uint8))[:draws]


def score_bootstrap(cluster_scores: DataFrame, cluster: str, names: Sequence[str], estimates: Sequence[float], draws: int = 9999, seed: int = 1) -> DataFrame:
    """contrast, draws, estimate, sd, q025, q975, ci_low, ci_high, p: sign flips of the clusters' scores, one draw's signs for all contrasts.

    cluster_scores: a row for each cluster with columns s0, s1, ... in the order of names. A task multiplies a matrix of signs (draws x
    its clusters) with one of scores, batch by batch; its sums, draws x contrasts, are added up over tasks by draw. Nothing has a row
    for each cluster and draw.
    """
    k = len(names)

    def flipped(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros((draws, k))
        for b in batches:
            s = np.column_stack([b.column(j + 1).to_numpy(zero_copy_only=False) for j in range(k)])
            for a in range(0, len(s), BLOCK_CLUSTERS):
                own = np.column_stack([signs_of(seed, c, draws) for c in b.column(0).slice(a, BLOCK_CLUSTERS).to_pylist()])
                total += own @ s[a : a + BLOCK_CLUSTERS]
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, draws + 1, dtype=np.int32)), *[pa.array(total[:, j].copy()) for j in range(k)]], ["draw", *[f"d{j}" for j in range(k)]])

    rows = cluster_scores.select(F.col(cluster).cast("string").alias("c"), *[F.coalesce(F.col(f"s{j}").cast("double"), F.lit(0.0)).alias(f"s{j}") for j in range(k)])
    sums = rows.mapInArrow(flipped, "draw int, " + ", ".join(f"d{j} double" for j in range(k))).groupBy("draw").agg(*[F.sum(f"d{j}").alias(f"d{j}") for j in range(k)])
    long_ = sums.select("draw", F.explode(F.array(*[F.struct(F.lit(n).alias("contrast"), F.lit(float(e)).alias("estimate"), F.col(f"d{j}").alias("delta")) for j, (n, e) in enumerate(zip(names, estimates, strict=True))])).alias("x")).select("x.*")
    q = long_.groupBy("contrast", "estimate").agg(F.count("*").alias("draws"), F.stddev_samp("delta").alias("sd"), F.percentile("delta", F.lit(0.025)).alias("q025"), F.percentile("delta", F.lit(0.975)).alias("q975"), F.count_if(F.abs("delta") >= F.abs("estimate")).alias("beyond"))
    return q.select("contrast", "draws", "estimate", "sd", "q025", "q975", (F.col("estimate") - F.col("q975")).alias("ci_low"), (F.col("estimate") - F.col("q025")).alias("ci_high"), ((F.col("beyond") + 1) / (F.col("draws") + 1)).alias("p"))


def bootstrap_contrasts(fit: CellFit, cluster: str, contrasts: dict[str, dict[str, float]], draws: int = 9999, seed: int = 1) -> DataFrame:
    """score_bootstrap of a fit's contrasts, all those that the data identify, with the clusters' influence on each."""
    known = {n: w for n, w in contrasts.items() if fit.contrast(w)["identified"]}
    targets = np.column_stack([[float(w.get(c, 0.0)) for c in fit.names] for w in known.values()])
    pull = fit.bread @ targets
    s = scores(fit.flat, fit.names, F.col("_n") * residual_of(fit.names, fit.beta, fit.y), [cluster])
    own = s.select(cluster, *[sum((float(pull[i, j]) * F.col(f"s{i}") for i in range(len(fit.names))), F.lit(0.0)).alias(f"_s{j}") for j in range(len(known))])
    own = own.withColumnsRenamed({f"_s{j}": f"s{j}" for j in range(len(known))})
    return score_bootstrap(own, cluster, list(known), [fit.contrast(w)["estimate"] for w in known.values()], draws, seed)


# ---- pooling ----


def pool_fits(fits: Sequence[tuple[np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rubin's rules for vectors: of (beta, covariance, df) of each draw the mean, and within, between and total covariance matrices."""
    betas = np.array([b for b, _, _ in fits])
    within = np.mean([c for _, c, _ in fits], axis=0)
    between = np.atleast_2d(np.cov(betas, rowvar=False, ddof=1)) if len(fits) > 1 else np.zeros_like(within)
    return betas.mean(axis=0), within, between, within + (1 + 1 / len(fits)) * between


def pooled_contrast(weights: np.ndarray, fits: Sequence[tuple[np.ndarray, np.ndarray, int]]) -> dict:
    """A contrast of the pooled vector: estimate, se, df (Rubin's, not above the smallest df of a fit) and missing information."""
    beta, within, between, total = pool_fits(fits)
    w, b, t = (float(weights @ m @ weights) for m in (within, between, total))
    m, least = len(fits), min(d for _, _, d in fits)
    share = (1 + 1 / m) * b
    df = min((m - 1) * (1 + w / share) ** 2, least) if share > 0 and m > 1 else float(least)
    estimate, se = float(weights @ beta), float(np.sqrt(max(t, 0.0)))
    z = estimate / se if se > 0 else None
    return {"estimate": estimate, "within": w, "between": b, "se": se, "df": float(df), "p": t_two_sided(z, df) if z is not None else None, "missing_information": share / t if t > 0 else None, "m": m}
