"""Sensitivity analyses as sweeps over one estimation engine."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.operators import cells, glm, inference, models


def swept(df: DataFrame, specs: dict[str, dict], y: str, effects: Sequence[str], clusters: Sequence[str]) -> DataFrame:
    """One fit for each specification {x: columns, where: filter, y: outcome, effects: ...}; what it doesn't name is the default.

    Probability exposures, thresholds, modifiers, subsets, negative controls and interactions differ only in these. A specification
    that can't be estimated is a row with a note.
    """
    together: dict[tuple, dict[str, dict]] = {}
    for name, s in specs.items():
        together.setdefault((len(s["x"]), tuple(s.get("effects", effects))), {})[name] = s
    out = None
    for (k, own), some in together.items():  # with equally many columns and the same effects: fitted together, from one scan
        xs = [f"_x{j}" for j in range(k)]
        items = [F.struct(F.lit(n).alias("spec"), F.col(s.get("y", y)).cast("double").alias("_y"), *[F.col(c).cast("double").alias(f"_x{j}") for j, c in enumerate(s["x"])], F.coalesce(s.get("where", F.lit(True)), F.lit(False)).alias("c")) for n, s in some.items()]
        keys = list(dict.fromkeys([*own, *clusters]))
        rows = df.select(*keys, F.explode(F.filter(F.array(*items), lambda s: s["c"])).alias("s")).select(*keys, *[f"s.{c}" for c in ("spec", "_y", *xs)])
        names = df.sparkSession.createDataFrame([(n, s.get("y", y), list(s["x"])) for n, s in some.items()], "spec string, outcome string, _terms array<string>")
        part = models.grouped_fits(rows, "spec", "_y", xs, own, clusters, list(some)).join(names, "spec")
        part = part.withColumn("term", F.get("_terms", F.substring("term", 3, 9).cast("int"))).drop("_terms")
        out = part if out is None else out.unionByName(part)
    return out


def modified(df: DataFrame, exposure: Sequence[str], modifier: str, levels: Sequence, reference) -> tuple[DataFrame, list[str]]:
    """Exposure times each level of a modifier but the reference: three-way terms where the exposure holds a product."""
    hot = models.one_hot(F.col(modifier), levels, reference)
    terms = {f"m_{k}": c for k, c in hot.items()} | {f"{e}_m_{k}": F.col(e) * c for e in exposure for k, c in hot.items()}
    return df.withColumns(terms), [*exposure, *terms]


def without_each(df: DataFrame, column: str, values: Sequence, y: str, x: Sequence[str], effects: Sequence[str], clusters: Sequence[str]) -> DataFrame:
    """Refits that leave out one value at a time: years, or the facilities that influence() names; with the shift from the full fit."""
    every = {"full": F.lit(True)} | {str(v): F.coalesce(F.col(column) != v, F.lit(True)) for v in values}
    fits = models.refits(df, every, y, x, effects, clusters)
    base = fits.filter("subset = 'full'").select("term", F.col("estimate").alias("full"))
    return fits.filter("subset <> 'full'").join(base, "term", "left").withColumn("shift", F.col("estimate") - F.col("full"))


def multiple_imputation(df: DataFrame, unit: str, probability: str, exposure: str, product: tuple[str, str] | None, y: str, x: Sequence[str], effects: Sequence[str], clusters: Sequence[str], draws: int = 20, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """An exposure drawn for each unit from its probability, refitted, and pooled: estimates of each draw, and Rubin's pooling by term.

    product: (name, other column) of an interaction made anew in every draw.
    """
    own = [c for c in (*x, *(product or ())) if c not in (exposure, *(product or ())[:1])]
    base = models.alike(df, y, list(dict.fromkeys([unit, probability, *own, *effects, *clusters])))  # rows that no draw tells apart are drawn as one
    drawn = inference.bernoulli_draws(base, unit, probability, draws, seed).select(unit, "draw", F.col("value").cast("double").alias(exposure))
    own = base.join(drawn, unit)  # every draw of every row, fitted together
    if product:
        own = own.withColumn(product[0], F.col(exposure) * F.col(product[1]))
    fits = models.grouped_fits(own, "draw", y, x, effects, clusters, weight="_n").filter("note is null")
    estimates = fits.select("draw", "term", "estimate", F.pow("se", 2).alias("variance"))
    return estimates, inference.rubin(estimates, ["term"], "estimate", "variance")


def drawn_cells(df: DataFrame, unit: str, classes: Sequence[str], right: dict[str, Column], draw: int, seed: int) -> DataFrame:
    """0/1 cells of one categorical draw for each unit, with the indicators of the other side."""
    picked = inference.categorical_draws(df, unit, classes, draw, seed).filter(F.col("draw") == draw).select(unit, "value")
    return df.join(picked, unit).withColumns({f"{c}_{n}": (F.col("value") == c).cast("double") * r for c in classes for n, r in right.items()}).drop("value")


#: What is fitted together is at most so many copies of the rows.
COPIES = 5


def measured_cells(df: DataFrame, unit: str, priors: dict[str, dict[str, str]], right: dict[str, Column], y: str, controls: Sequence[str], specs: dict[str, Sequence[str]], clusters: Sequence[str], contrasts: dict[str, dict[str, float]], draws: int = 20, seed: int = 1, thresholds: Sequence[float] = (0.5, 0.8)) -> DataFrame:
    """How contrasts of cells depend on what a unit's class is taken to be: specification, model_id, contrast, estimate, se, df, p, n, m.

    priors: {name: {class: column of its probability}}, the main one first. Specifications: probabilities as weights and classes of
    the largest probability at or above each threshold under every prior, and `draws` drawn classes under the main one, whose
    coefficient vectors and covariance matrices are pooled before a contrast is taken. right: indicators of the other side that sum
    to 1. Contrasts that the data don't identify, in any draw, are null.
    """
    main, out = next(iter(priors)), []
    classes = list(priors[main])
    names = [f"{c}_{r}" for c in classes for r in right]
    every = list(dict.fromkeys(e for effects in specs.values() for e in effects))
    df = df.withColumns({f"_p{k}_{j}": F.col(columns[c]).cast("double") for k, columns in enumerate(priors.values()) for j, c in enumerate(classes)} | {f"_r{j}": c.cast("double") for j, c in enumerate(right.values())})
    keys = list(dict.fromkeys([unit, *[f"_p{k}_{j}" for k in range(len(priors)) for j in range(len(classes))], *[f"_r{j}" for j in range(len(right))], *controls, *every, *clusters]))
    base = models.alike(df, y, keys)
    n, rows = base.agg(F.sum("_n"), F.count("*")).first()
    some = max(COPIES, COPIES * n // rows) if n else COPIES
    weights = {}  # each class's weight, and which rows there are, by specification
    for k, prior in enumerate(priors):
        p = [F.col(f"_p{k}_{j}") for j in range(len(classes))]
        largest = F.greatest(*p) if len(p) > 1 else p[0]
        label = F.coalesce(*[F.when(c == largest, j) for j, c in enumerate(p)])
        weights[f"{prior}_probability"] = (F.lit(True), p)
        weights |= {f"{prior}_hard_{t:g}": (largest >= t, [(label == j).cast("double") for j in range(len(classes))]) for t in thresholds}

    def fitted(source: DataFrame, effects: Sequence[str]) -> dict:
        crossed = source.withColumns({f"{c}_{r}": F.get("_w", F.lit(i)) * F.col(f"_r{j}") for i, c in enumerate(classes) for j, r in enumerate(right)})
        return cells.fit_groups(crossed, "_g", y, names, controls if effects else [], effects, clusters, "_n")

    def parts(keys_: list) -> list[list]:
        return [keys_[k : k + some] for k in range(0, len(keys_), some)]

    drawn = inference.categorical_draws(base.withColumns({c: F.col(f"_p0_{j}") for j, c in enumerate(classes)}), unit, classes, draws, seed)
    for model, effects in specs.items():
        fits: dict = {}
        for own in parts(list(weights)):
            items = F.array(*[F.struct(F.lit(g).alias("g"), F.coalesce(weights[g][0], F.lit(False)).alias("c"), F.array(*weights[g][1]).alias("w")) for g in own])
            fits |= fitted(base.withColumn("_s", F.explode(F.filter(items, lambda s: s["c"]))).withColumns({"_g": F.col("_s.g"), "_w": F.col("_s.w")}), effects)
        for spec in weights:
            for name, w in contrasts.items():
                r = fits[spec].contrast(w) if spec in fits else {"identified": False, "n": 0}
                out.append((spec, model, name, *([r["estimate"], r["se"], float(r["df"]), r["p"]] if r["identified"] else [None] * 4), r["n"], 1))
        fits = {}
        for own in parts(list(range(1, draws + 1))):
            picked = drawn.filter(F.col("draw").isin(own)).select(unit, F.col("draw").alias("_g"), F.array(*[(F.col("value") == c).cast("double") for c in classes]).alias("_w"))
            fits |= fitted(base.join(picked, unit), effects)
        fits = [fits[d] for d in sorted(fits)]
        for name, w in contrasts.items():
            ok, n = bool(fits) and all(f.contrast(w)["identified"] for f in fits), fits[0].n if fits else 0
            r = cells.pooled_contrast(np.array([float(w.get(c, 0.0)) for c in fits[0].names]), [(f.beta, f.covariance, f.df) for f in fits]) if ok else {}
            out.append((f"{main}_drawn", model, name, *[r.get(k) for k in ("estimate", "se", "df", "p")], n, len(fits)))
    return df.sparkSession.createDataFrame(out, "specification string, model_id string, contrast string, estimate double, se double, df double, p double, n long, m int")


def outcome_models(df: DataFrame, outcomes: dict[str, str], x: Sequence[str], effects: Sequence[str], cluster: str, least_events: int = 100) -> DataFrame:
    """A model of its own family for each outcome; a binary one with too few events is a row with a note, as is one that fails."""
    out = []
    for y, kind in outcomes.items():
        if kind == "binomial_logit":
            n, events = df.filter(F.col(y).isNotNull()).agg(F.count("*"), F.sum(y)).first()
            if min(events or 0, n - (events or 0)) < least_events:
                out.append((y, kind, None, *[None] * 7, n, False, f"{int(events or 0)} events"))
                continue
        try:
            model = glm.glm(df, y, x, effects, kind, [cluster])
            out += [(y, kind, *r[:7], model.fit.df, r[7], model.converged, None) for r in model.rows()]
        except (ValueError, IndexError, RuntimeError, np.linalg.LinAlgError) as e:
            out.append((y, kind, None, *[None] * 7, 0, False, str(e)[:100]))
    return df.sparkSession.createDataFrame(out, "outcome string, family string, term string, estimate double, se double, t double, p double, ci_low double, ci_high double, df int, n long, converged boolean, note string")


def recomputed(df: DataFrame, y: str, x: Sequence[str], reported: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Coefficients from cross-products summed another way (in Arrow batches), against reported ones: term, reported, recomputed, passed."""
    names = [y, *x]

    def products(frames):
        import pandas as pd

        total = np.zeros((len(names), len(names)))
        for f in frames:
            a = f[names].to_numpy(float)
            a = a[~np.isnan(a).any(axis=1)]
            total += a.T @ a
        yield pd.DataFrame({"i": np.repeat(range(len(names)), len(names)), "j": list(range(len(names))) * len(names), "v": total.ravel()})

    cells = df.select(*[F.col(c).cast("double") for c in names]).mapInPandas(products, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    m = np.zeros((len(names), len(names)))
    for r in cells:
        m[r["i"], r["j"]] = r["v"]
    kept = models.independent(m[1:, 1:])
    beta = np.linalg.solve(m[1:, 1:][np.ix_(kept, kept)], m[1:, 0][kept])
    own = df.sparkSession.createDataFrame([(x[j], float(b)) for j, b in zip(kept, beta, strict=True)], "term string, recomputed double")
    joined = reported.select("term", F.col("estimate").alias("reported")).join(own, "term", "full_outer")
    return joined.withColumn("passed", F.coalesce(F.abs(F.col("reported") - F.col("recomputed")) <= tolerance * F.greatest(F.abs("reported"), F.lit(1.0)), F.lit(False)))


def recomputed_covariance(df: DataFrame, y: str, x: Sequence[str], clusters: Sequence[str], reported: np.ndarray, tolerance: float = 1e-6) -> DataFrame:
    """row, column, reported, recomputed, passed of every covariance, by other steps: a QR factor of stacked triangles instead of an
    inverse of cross-products, and cluster sums of sorted segments of Arrow batches instead of grouped sums of expressions.

    df: the fitted rows, after their effects. A segment's sums are added up over batches by cluster, so that a cluster of any size is
    one row for each batch at most.
    """
    names, k = [y, *x], len(x)
    active = F.greatest(*[F.abs(F.col(c)) for c in x]) if k > 1 else F.abs(F.col(x[0]))
    own = df.filter(models.complete([*names, *clusters])).filter(active > 1e-12)

    def triangles(batches):
        import pyarrow as pa

        held = np.zeros((0, k + 1))
        for b in batches:
            z = np.column_stack([b.column(j).to_numpy(zero_copy_only=False) for j in [*range(1, k + 1), 0]])
            held = np.linalg.qr(np.vstack([held, z]), mode="r")
        yield pa.RecordBatch.from_arrays([pa.array(list(map(list, held)), pa.list_(pa.float64()))], ["r"])

    rows = own.select(*[F.col(c).cast("double") for c in names]).mapInArrow(triangles, "r array<double>").collect()  # k + 1 rows of each task
    triangle = np.linalg.qr(np.array([r["r"] for r in rows], float).reshape(-1, k + 1), mode="r")
    inverse = np.linalg.inv(triangle[:k, :k])
    beta, bread, n = inverse @ triangle[:k, k], inverse @ inverse.T, own.count()
    total = np.zeros((k, k))
    for at, keys in enumerate(models.cluster_sets(clusters)):

        def segments(batches, kk=len(keys)):
            import pyarrow as pa
            import pyarrow.compute as pc

            for b in batches:
                if not b.num_rows:
                    continue
                z = np.column_stack([b.column(kk + j).to_numpy(zero_copy_only=False) for j in range(k + 1)])
                part = z[:, 1:] * (z[:, 0] - z[:, 1:] @ beta)[:, None]
                order = pc.sort_indices(b.select(list(range(kk))), [(c, "ascending") for c in b.schema.names[:kk]]).to_numpy()
                sorted_ = [b.column(j).take(pa.array(order)) for j in range(kk)]
                change = np.zeros(len(order), bool)
                change[0] = True
                for c in sorted_:
                    change[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
                starts = np.flatnonzero(change)
                sums = np.add.reduceat(part[order], starts)
                yield pa.RecordBatch.from_arrays([*[c.take(pa.array(starts)) for c in sorted_], pa.array(list(map(list, sums)), pa.list_(pa.float64()))], [*b.schema.names[:kk], "s"])

        source = own.select(*keys, *[F.col(c).cast("double") for c in names])
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*keys).schema)
        summed = source.select(*[F.col(c).alias(f"_{j}" if j >= len(keys) else c) for j, c in enumerate(source.columns)]) if len(set(source.columns)) < len(source.columns) else source
        found = summed.mapInArrow(segments, f"{kinds}, s array<double>").groupBy(*keys).agg(*[F.sum(F.get("s", F.lit(j))).alias(f"s{j}") for j in range(k)])
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        cells_ = found.select(F.posexplode(F.array(F.lit(1.0), *[F.col(f"s{i}") * F.col(f"s{j}") for i, j in pairs]))).groupBy("pos").agg(F.sum("col").alias("v")).collect()
        v = {r["pos"]: r["v"] for r in cells_}
        meat, g = np.zeros((k, k)), v[0]
        for p, (i, j) in enumerate(pairs, 1):
            meat[i, j] = meat[j, i] = v[p]
        total += (-1 if at == 2 else 1) * g / (g - 1) * (n - 1) / max(n - k, 1) * bread @ meat @ bread
    scale = np.sqrt(np.abs(np.outer(np.diag(reported), np.diag(reported))))
    out = [(x[i], x[j], float(reported[i, j]), float(total[i, j]), bool(abs(reported[i, j] - total[i, j]) <= tolerance * max(scale[i, j], 1e-300))) for i in range(k) for j in range(i, k)]
    return df.sparkSession.createDataFrame(out, "row string, column string, reported double, recomputed double, passed boolean")


def readjusted(df: DataFrame, family: Sequence[str], p: str, key: Sequence[str], adjusted: str, method: str = "bh", tolerance: float = 1e-9) -> DataFrame:
    """family, key, recomputed, passed: adjusted p-values by their definition, family by family in Python, compared with reported ones.

    A family of results has thousands of rows at most; each is one task's group. Null p-values have no row.
    """
    columns = [*family, *key]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*columns).schema)

    def again(g):
        g = g.sort_values([p, *key])
        v, m = g[p].to_numpy(float), len(g)
        rank = np.arange(1, m + 1)
        a = np.minimum.accumulate((m * v / rank)[::-1])[::-1] if method == "bh" else np.maximum.accumulate((m - rank + 1) * v)
        a = np.minimum(a, 1.0)
        return g[columns].assign(recomputed=a, passed=np.abs(a - g[adjusted].to_numpy(float)) <= tolerance)

    return df.filter(F.col(p).isNotNull()).select(*columns, p, adjusted).groupBy(*family).applyInPandas(again, f"{schema}, recomputed double, passed boolean")
