"""Fixed effects taken out of columns: conjugate gradients on the effects' normal equations, over combinations of levels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import written

TOLERANCES = ((1e-8, 200), (1e-6, 200))


def demean(df: DataFrame, columns: Sequence[str], effects: Sequence[str], weight: str | None = None, tolerances: Sequence[tuple[float, int]] = TOLERANCES) -> tuple[DataFrame, dict]:
    """Columns without all effects (the residuals on the effects' dummies), until the largest mean of a level that is left, in units
    of the column's own size, is below the tolerance; then below its fallback.

    What is taken out depends only on the combination of effects a row has. So rows are first summed to combinations, the rounds work
    on these, and the rows are joined with the outcome once. One effect needs no round: its combinations are its levels. With more,
    each round multiplies a direction by the normal matrix: the levels' values are joined to the combinations, summed, and grouped by
    level again, first within tasks, so that a level that holds a third of all combinations is one row of each task. A connected
    design of L levels needs L rounds at most, and in practice about the root of what turns of means need.
    Returns the frame and {converged, tolerance, rounds, change}. Rows with a null effect go.
    """
    df = df.filter(F.expr(" AND ".join(f"`{e}` IS NOT NULL" for e in effects))).withColumns({c: F.col(c).cast("double") for c in columns})
    w = F.col(weight) if weight else F.lit(1.0)
    keys, values = [f"_e{k}" for k in range(len(effects))], [f"_v{k}" for k in range(len(columns))]
    cells = written(df.groupBy(*[F.col(e).alias(k) for e, k in zip(effects, keys, strict=True)]).agg(F.sum(w).alias("_w"), *[(F.sum(w * F.col(c)) / F.sum(w)).alias(v) for c, v in zip(columns, values, strict=True)]))
    state = {"converged": True, "tolerance": tolerances[0][0], "rounds": 0, "change": 0.0}
    if len(effects) == 1:
        taken = cells.select(*keys, *values)
    else:
        scale = df.agg(*[F.sqrt(F.sum(w * F.col(c) * F.col(c)) / F.sum(w)) for c in columns]).first()
        taken, state = _solved(cells, keys, values, [s or 1.0 for s in scale], tolerances)
    out = df.join(taken, [F.col(e) == F.col(k) for e, k in zip(effects, keys, strict=True)])
    return out.withColumns({c: F.col(c) - F.col(v) for c, v in zip(columns, values, strict=True)}).drop(*keys, *values), state


def _text(df: DataFrame, key: str) -> Column:
    nested = df.schema[key].dataType.typeName() in ("struct", "array", "map")
    return F.to_json(F.struct(key)) if nested else F.col(key).cast("string")


def _solved(cells: DataFrame, keys: Sequence[str], values: Sequence[str], scale: Sequence[float], tolerances: Sequence[tuple[float, int]]) -> tuple[DataFrame, dict]:
    """keys and, in place of the values, the sum of the effects' solutions."""
    js = range(len(values))
    levels = F.explode(F.array(*[F.struct(F.lit(k).alias("e"), _text(cells, key).alias("level")) for k, key in enumerate(keys)])).alias("x")
    sums = cells.select(levels, "_w", *[(F.col("_w") * F.col(v)).alias(v) for v in values]).groupBy("x").agg(F.sum("_w").alias("d"), *[F.sum(v).alias(f"r{j}") for j, v in enumerate(values)])
    # every level of every effect is numbered; written, so that the numbers stay
    now = written(sums.select(F.monotonically_increasing_id().alias("id"), "x.e", "x.level", "d", *[F.lit(0.0).alias(f"a{j}") for j in js], *[f"r{j}" for j in js], *[(F.col(f"r{j}") / F.col("d")).alias(f"p{j}") for j in js]))
    placed = cells.select(*keys, "_w", *[_text(cells, key).alias(f"_t{k}") for k, key in enumerate(keys)])
    for k in range(len(keys)):
        own = now.filter(F.col("e") == k).select(F.col("level").alias(f"_t{k}"), F.col("id").alias(f"_i{k}"))
        placed = placed.join(own, f"_t{k}").drop(f"_t{k}")
    placed = written(placed)
    places = [f"_i{k}" for k in range(len(keys))]
    now = now.drop("e", "level")

    def spread(what: str, table: DataFrame, to: DataFrame) -> DataFrame:
        """_s0, _s1, ...: the sum over a combination's levels."""
        for k, place in enumerate(places):
            to = to.join(table.select(F.col("id").alias(place), *[F.col(f"{what}{j}").alias(f"_q{k}_{j}") for j in js]), place)
        total = {f"_s{j}": sum((F.col(f"_q{k}_{j}") for k in range(1, len(keys))), F.col(f"_q0_{j}")) for j in js}
        return to.withColumns(total).drop(*[f"_q{k}_{j}" for k in range(len(keys)) for j in js])

    state, most = {"converged": False, "tolerance": tolerances[-1][0], "rounds": 0, "change": float("inf")}, sum(n for _, n in tolerances)
    while True:
        moved = spread("p", now, placed.select("_w", *places)).select(F.explode(F.array(*places)).alias("id"), *[(F.col("_w") * F.col(f"_s{j}")).alias(f"_s{j}") for j in js])
        after = written(now.join(moved.groupBy("id").agg(*[F.sum(f"_s{j}").alias(f"m{j}") for j in js]), "id"))
        found = [F.max(F.abs(F.col(f"r{j}") / F.col("d"))) for j in js]
        for a, b in (("r", "r"), ("r", "m"), ("m", "m")):
            found += [F.sum(F.col(f"{a}{j}") * F.col(f"{b}{j}") / F.col("d")) for j in js]
        got = after.agg(*found, *[F.sum(F.col(f"p{j}") * F.col(f"m{j}")) for j in js]).first()
        largest, rr, rm, mm, pm = ([float(got[k * len(values) + j] or 0) for j in js] for k in range(5))
        state["change"] = max((x / s for x, s in zip(largest, scale, strict=True)), default=0.0)
        tolerance = next((t for k, (t, _) in enumerate(tolerances) if state["change"] <= t and state["rounds"] >= sum(n for _, n in tolerances[:k])), None)
        if tolerance is not None or state["rounds"] >= most:
            state |= {"converged": tolerance is not None, "tolerance": tolerance or tolerances[-1][0]}
            break
        step = [rr[j] / pm[j] if pm[j] > 0 else 0.0 for j in js]
        left = [max(rr[j] - 2 * step[j] * rm[j] + step[j] ** 2 * mm[j], 0.0) for j in js]
        turn = [left[j] / rr[j] if rr[j] > 0 else 0.0 for j in js]
        rest = {f"r{j}": F.col(f"r{j}") - step[j] * F.col(f"m{j}") for j in js}
        now = after.select("id", "d", *[(F.col(f"a{j}") + step[j] * F.col(f"p{j}")).alias(f"a{j}") for j in js], *[c.alias(n) for n, c in rest.items()], *[(rest[f"r{j}"] / F.col("d") + turn[j] * F.col(f"p{j}")).alias(f"p{j}") for j in js])
        state["rounds"] += 1
    taken = spread("a", after, placed)
    return taken.select(*keys, *[F.col(f"_s{j}").alias(v) for j, v in enumerate(values)]), state
