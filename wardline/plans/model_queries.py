"""Queries of designs, models, draws and multiplicity. The SQL solves the normal equations of two or three columns by determinants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.operators import cells, glm, inference, models, nameprob, reshape
from wardline.plans import sensitivity
from wardline.plans.frames import ENCOUNTERS_SQL, encounters, table
from wardline.plans.queries import SHARES, _name_parts, _name_sql
from wardline.plans.registry import query

ENC = f"WITH {ENCOUNTERS_SQL}"
PROB = "((provider * 17) % 100) / 100.0"
A, B = "CAST(order_status = 'F' AS int)", "CAST(segment = 'BUILDING' AS int)"
REG = f"reg AS (SELECT provider AS c1, facility AS c2, visit_year, total AS y, {A} AS x1, {B} AS x2, {A} * {B} AS x3 FROM encounters)"


def _regression(spark, sf) -> DataFrame:
    e = encounters(spark, sf)
    return e.select("provider", "facility", "visit_year", (F.col("visit_year") * 10 + F.col("visit_quarter")).alias("period"), "segment", F.col("total").alias("y"), (F.col("order_status") == "F").cast("double").alias("a"), (F.col("segment") == "BUILDING").cast("double").alias("b")).withColumn("ab", F.col("a") * F.col("b"))


def demeaned(name: str, source: str, by: str, k: int = 3) -> str:
    """A CTE of g, c1, c2, y and x1 ... xk without the means of a level, within each group g."""
    cells = ", ".join(f"{c} - avg({c}) OVER (PARTITION BY {by}) AS {c}" for c in ("y", *(f"x{j}" for j in range(1, k + 1))))
    return f"{name} AS (SELECT g, c1, c2, {cells} FROM {source})"


def solved(source: str, k: int, clusters: int, lost: int = 0) -> str:
    """CTEs after which `fit` holds g, j (the column's number), estimate, se and n. lost: coefficients that are not among the columns."""
    xs = range(1, k + 1)
    active = f"greatest({', '.join(f'abs(x{i})' for i in xs)}) > 1e-12"  # rows without any variation count neither towards n nor clusters
    sums = ", ".join(f"sum(x{i} * x{j}) AS a{i}{j}" for i in xs for j in xs) + ", " + ", ".join(f"sum(x{i} * y) AS b{i}" for i in xs)
    if k == 2:
        det = "(a11 * a22 - a12 * a12)"
        inverse = {(1, 1): "a22", (1, 2): "-a12", (2, 2): "a11"}
    else:
        det = "(a11 * (a22 * a33 - a23 * a23) - a12 * (a12 * a33 - a23 * a13) + a13 * (a12 * a23 - a22 * a13))"
        inverse = {(1, 1): "a22 * a33 - a23 * a23", (1, 2): "a13 * a23 - a12 * a33", (1, 3): "a12 * a23 - a13 * a22", (2, 2): "a11 * a33 - a13 * a13", (2, 3): "a12 * a13 - a11 * a23", (3, 3): "a11 * a22 - a12 * a12"}
    inv = ", ".join(f"({e}) / {det} AS i{i}{j}" + (f", ({e}) / {det} AS i{j}{i}" if i != j else "") for (i, j), e in inverse.items())
    betas = ", ".join(f"{' + '.join(f'i{i}{j} * b{j}' for j in xs)} AS beta{i}" for i in xs)
    rows = " UNION ALL ".join(f"SELECT g, {i} AS j, c1, c2, ({' + '.join(f'i{i}{j} * x{j}' for j in xs)}) * (y - {' - '.join(f'beta{j} * x{j}' for j in xs)}) AS s FROM {source} JOIN beta USING (g) WHERE {active}" for i in xs)
    sets = [("c1",), ("c2",), ("c1", "c2")][: 1 if clusters == 1 else 3]
    parts = ", ".join(f"v{m} AS (SELECT g, j, count(*) AS n{m}, sum(s * s) AS v{m} FROM (SELECT g, j, {', '.join(own)}, sum(s) AS s FROM part GROUP BY g, j, {', '.join(own)}) GROUP BY g, j)" for m, own in enumerate(sets))
    total = " + ".join(f"{'-' if m == 2 else ''}v{m} * n{m} / (n{m} - 1)" for m in range(len(sets)))
    estimate = "CASE j " + " ".join(f"WHEN {i} THEN beta{i}" for i in xs) + " END"
    return f"""sums AS (SELECT g, count(*) FILTER ({active}) AS n, {sums} FROM {source} GROUP BY g), inv AS (SELECT *, {inv} FROM sums), beta AS (SELECT *, {betas} FROM inv), part AS ({rows}), {parts},
fit AS (SELECT g, j, {estimate} AS estimate, sqrt(({total}) * (n - 1) / (n - {k + lost})) AS se, n FROM beta JOIN v0 USING (g) {' '.join(f'JOIN v{m} USING (g, j)' for m in range(1, len(sets)))})"""


TERM = "CASE j WHEN 1 THEN 'a' WHEN 2 THEN 'b' ELSE 'ab' END"


@query(
    "model_sequence",
    f"""WITH RECURSIVE {ENCOUNTERS_SQL}, {REG}, cells AS (SELECT c1, c2, count(*) AS w, avg(y) AS y, avg(x1) AS x1, avg(x2) AS x2, avg(x3) AS x3 FROM reg GROUP BY 1, 2),
turns AS (SELECT 0 AS k, c1, c2, w, y, x1, x2, x3 FROM cells UNION ALL SELECT k + 1, c1, c2, w, {', '.join(f'{c} - sum(w * {c}) OVER (PARTITION BY k, c1) / sum(w) OVER (PARTITION BY k, c1) AS {c}' for c in ('y', 'x1', 'x2', 'x3'))}
  FROM (SELECT k, c1, c2, w, {', '.join(f'{c} - sum(w * {c}) OVER (PARTITION BY k, c2) / sum(w) OVER (PARTITION BY k, c2) AS {c}' for c in ('y', 'x1', 'x2', 'x3'))} FROM turns WHERE k < 60)),
flat AS (SELECT c1, c2, {', '.join(f'cells.{c} - turns.{c} AS m_{c}' for c in ('y', 'x1', 'x2', 'x3'))} FROM turns JOIN cells USING (c1, c2) WHERE k = 60),
one AS (SELECT 'm1' AS g, * FROM reg), two AS (SELECT 'm2' AS g, * FROM reg), {demeaned('d1', 'one', 'g')}, {demeaned('d2', 'two', 'c2')},
d3 AS (SELECT 'm3' AS g, c1, c2, {', '.join(f'{c} - m_{c} AS {c}' for c in ('y', 'x1', 'x2', 'x3'))} FROM reg JOIN flat USING (c1, c2)), every AS (SELECT * FROM d1 UNION ALL SELECT * FROM d2 UNION ALL SELECT * FROM d3), {solved('every', 3, 2)}
SELECT g AS model_id, {TERM} AS term, round(estimate, 3) AS estimate, round(CASE WHEN g = 'm1' THEN se * sqrt((n - 3.0) / (n - 4)) ELSE se END, 3) AS se, n, TRUE AS converged FROM fit""",
)
def _sequence(spark, sf):
    out = models.sequence(_regression(spark, sf), "y", ["a", "b", "ab"], [], {"m1": [], "m2": ["facility"], "m3": ["facility", "provider"]}, ["provider", "facility"])
    return out.select("model_id", "term", F.round("estimate", 3).alias("estimate"), F.round("se", 3).alias("se"), "n", "converged")


LOYO = f"{ENC}, {REG}, y AS (SELECT DISTINCT visit_year AS g FROM encounters), src AS (SELECT y.g, reg.* FROM reg JOIN y ON visit_year <> y.g), {demeaned('d', 'src', 'g, c2')}, {solved('d', 3, 1)}"


@query("leave_one_year_out", f"{LOYO} SELECT {TERM} AS term, count(*) AS refits, round(min(estimate), 4) AS least, round(quantile_cont(estimate, 0.5), 4) AS median, round(max(estimate), 4) AS most FROM fit GROUP BY 1")
def _loyo(spark, sf):
    out = models.refit_summary(_years_left_out(spark, sf))
    return out.select("term", "refits", *[F.round(c, 4).alias(c) for c in ("least", "median", "most")])


@query("year_refits", f"{LOYO} SELECT 'without_' || CAST(g AS string) AS subset, {TERM} AS term, round(estimate, 4) AS estimate, round(se, 4) AS se, round(estimate / se, 4) AS t, n FROM fit")
def _year_refits(spark, sf):
    return _years_left_out(spark, sf).select("subset", "term", F.round("estimate", 4).alias("estimate"), F.round("se", 4).alias("se"), F.round("t", 4).alias("t"), "n")


def _years_left_out(spark, sf):
    df = _regression(spark, sf)
    years = [r[0] for r in df.select("visit_year").distinct().orderBy("visit_year").collect()]
    return models.refits(df, {f"without_{y}": F.col("visit_year") != y for y in years}, "y", ["a", "b", "ab"], ["facility"], ["provider"])


@query(
    "without_facilities",
    f"""{ENC}, {REG}, y AS (SELECT unnest([0, 1, 2, -1]) AS g), src AS (SELECT y.g, reg.* FROM reg JOIN y ON c2 <> y.g), {demeaned('d', 'src', 'g, c2')}, {solved('d', 3, 1)}
SELECT CAST(f.g AS string) AS subset, {TERM.replace('CASE j', 'CASE f.j')} AS term, round(f.estimate, 4) AS estimate, round(f.estimate - full_.estimate, 4) AS shift FROM fit f JOIN fit full_ ON full_.g = -1 AND full_.j = f.j WHERE f.g <> -1""",
)
def _without(spark, sf):
    out = sensitivity.without_each(_regression(spark, sf), "facility", [0, 1, 2], "y", ["a", "b", "ab"], ["facility"], ["provider"])
    return out.select("subset", "term", F.round("estimate", 4).alias("estimate"), F.round("shift", 4).alias("shift"))


SCORES = f"""{ENC}, {REG}, one AS (SELECT 1 AS g, * FROM reg), {demeaned('d', 'one', 'c2')}, {solved('d', 3, 2)}, est AS (SELECT estimate FROM fit WHERE j = 3), sc AS (SELECT c2 AS facility, sum(s) AS score FROM part WHERE j = 3 GROUP BY 1)"""


def _flat(spark, sf):
    df, _ = models.demean(_regression(spark, sf), ["y", "a", "b", "ab"], ["facility"])
    return df, models.ols(df, "y", ["a", "b", "ab"], ["provider", "facility"])


def _scores(spark, sf):
    return models.influence_scores(*_flat(spark, sf), "y", "ab", "facility")


BIT = "(instr('0123456789abcdef', substr(sha256({seed} || '|' || CAST({unit} AS string) || '|' || CAST((draw - 1) // 256 AS string)), CAST((draw - 1) % 256 // 4 + 1 AS int), 1)) - 1 >> CAST(3 - (draw - 1) % 4 AS int)) & 1"


@query(
    "wild_bootstrap",
    f"""{SCORES.replace("est AS (SELECT estimate FROM fit WHERE j = 3), sc AS (SELECT c2 AS facility, sum(s) AS score FROM part WHERE j = 3 GROUP BY 1)", "sc AS (SELECT j, c2 AS facility, sum(s) AS score FROM part GROUP BY 1, 2)")}, sign AS (SELECT facility, draw, 1 - 2 * ({BIT.format(seed="'1'", unit="facility")}) AS sign FROM (SELECT DISTINCT facility FROM sc), range(1, 10000) t(draw)),
f AS (SELECT j, draw, sum(sign * score) AS delta FROM sc JOIN sign USING (facility) GROUP BY 1, 2)
SELECT {TERM.replace('CASE j', 'CASE f.j')} AS contrast, count(*) AS draws, round(any_value(estimate), 3) AS estimate, round(stddev_samp(delta), 3) AS sd, round(any_value(estimate) - quantile_cont(delta, 0.975), 3) AS ci_low, round(any_value(estimate) - quantile_cont(delta, 0.025), 3) AS ci_high,
round((count(*) FILTER (abs(delta) >= abs(estimate)) + 1) / 10000.0, 6) AS p FROM f JOIN fit ON fit.j = f.j GROUP BY f.j""",
)
def _wild(spark, sf):
    """Three coefficients with the same signs in every draw."""
    df, fit = _flat(spark, sf)
    out = cells.score_bootstrap(models.influences(df, fit, "y", fit.names, "facility"), "facility", fit.names, fit.beta)
    return out.select("contrast", "draws", *[F.round(c, 3).alias(c) for c in ("estimate", "sd", "ci_low", "ci_high")], "p")


@query("top_influence", f"{SCORES} SELECT facility, round(-score, 4) AS shift, round(abs(score), 4) AS size FROM sc ORDER BY abs(score) DESC, facility LIMIT 10")
def _influence(spark, sf):
    s = _scores(spark, sf)
    return models.influence(s, "facility", "score").select("facility", F.round("shift", 4).alias("shift"), F.round("size", 4).alias("size"))


@query("influence_summary", f"{SCORES} SELECT count(*) AS clusters, round(max(abs(score)), 4) AS largest, round(quantile_cont(abs(score), 0.99), 4) AS p99 FROM sc")
def _influence_summary(spark, sf):
    s = _scores(spark, sf)
    return models.influence_summary(s, "score").select("clusters", F.round("largest", 4).alias("largest"), F.round("p99", 4).alias("p99"))


@query(
    "collinear_columns",
    f"""{ENC}, {REG}, m AS (SELECT avg(y) FILTER (x1 = 0) AS m0, avg(y) FILTER (x1 = 1) AS m1 FROM reg) SELECT 'one' AS term, TRUE AS kept, round(m0, 4) AS estimate FROM m UNION ALL SELECT 'a', TRUE, round(m1 - m0, 4) FROM m UNION ALL SELECT 'twice', FALSE, NULL UNION ALL SELECT 'rest', FALSE, NULL""",
)
def _collinear(spark, sf):
    df = _regression(spark, sf).withColumns({"one": F.lit(1.0), "twice": 2 * F.col("a"), "rest": 3 - F.col("a")})
    fit = models.ols(df, "y", ["one", "a", "twice", "rest"])
    return spark.createDataFrame([(n, True, round(float(b), 4)) for n, b in zip(fit.names, fit.beta, strict=True)] + [(n, False, None) for n in fit.dropped], "term string, kept boolean, estimate double")


@query(
    "singletons_dropped",
    f"WITH r0 AS (SELECT o_orderkey, o_custkey AS e1, CAST(floor(o_totalprice) AS BIGINT) % 3000 AS e2 FROM orders), {', '.join(f'r{k} AS (SELECT * FROM r{k - 1} QUALIFY count(*) OVER (PARTITION BY e{2 - k % 2}) > 1)' for k in range(1, 31))} SELECT o_orderkey FROM r30",
)
def _singletons(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("e1"), F.expr("floor(o_totalprice) % 3000").alias("e2"))
    return models.drop_singletons(o, ["e1", "e2"]).select("o_orderkey")


@query(
    "subset_sweep",
    f"""{ENC}, {REG}, src AS (SELECT 'main' AS g, * FROM reg UNION ALL SELECT 'large', * FROM reg WHERE y > 100000), {demeaned('d', 'src', 'g, c2')}, {solved('d', 3, 1)}, first_ AS (SELECT g, {TERM} AS term, estimate, se, n FROM fit)
SELECT g AS spec, 'y' AS outcome, term, round(estimate, 4) AS estimate, round(se, 4) AS se, n FROM first_ UNION ALL SELECT g, 'y', term, round(estimate, 4), round(se, 4), n FROM (WITH src2 AS (SELECT 'no_product' AS g, * FROM reg), {demeaned('e', 'src2', 'g, c2', 2)}, {solved('e', 2, 1)} SELECT g, CASE j WHEN 1 THEN 'a' ELSE 'b' END AS term, estimate, se, n FROM fit)""",
)
def _sweep(spark, sf):
    df = _regression(spark, sf)
    out = sensitivity.swept(df, {"main": {"x": ["a", "b", "ab"]}, "large": {"x": ["a", "b", "ab"], "where": F.col("y") > 100_000}, "no_product": {"x": ["a", "b"]}}, "y", ["facility"], ["provider"])
    return out.select("spec", "outcome", "term", F.round("estimate", 4).alias("estimate"), F.round("se", 4).alias("se"), "n")


UNIFORM = "(CAST(CAST('0x' || substr(sha256('{seed}|' || CAST(draw AS string) || '|' || CAST({unit} AS string)), 1, 16) AS UBIGINT) AS DOUBLE) + 0.5) / 18446744073709551616.0"


@query(
    "imputed_exposure",
    f"""{ENC}, u AS (SELECT DISTINCT provider, {PROB} AS p, draw FROM encounters, range(1, 21) t(draw)), dr AS (SELECT provider, draw, CAST({UNIFORM.format(seed=1, unit='provider')} < p AS int) AS v FROM u),
src AS (SELECT draw AS g, facility AS c1, facility AS c2, total AS y, v AS x1, {B} AS x2, v * {B} AS x3 FROM encounters JOIN dr USING (provider)), {demeaned('d', 'src', 'g, c2')}, {solved('d', 3, 1)},
p AS (SELECT {TERM} AS term, count(*) AS m, avg(estimate) AS b, avg(se * se) AS within, var_samp(estimate) AS between_ FROM fit GROUP BY 1)
SELECT term, m, round(b, 3) AS estimate, round(sqrt(within), 3) AS within_root, round(sqrt(between_), 3) AS between_root, round(sqrt(within + (1 + 1.0 / m) * between_), 3) AS se, round((m - 1) * pow(1 + within / ((1 + 1.0 / m) * between_), 2), 1) AS df, round((1 + 1.0 / m) * between_ / (within + (1 + 1.0 / m) * between_), 5) AS missing_information FROM p""",
)
def _imputed(spark, sf):
    df = _regression(spark, sf).withColumn("pa", F.expr(PROB).cast("double"))
    out = sensitivity.multiple_imputation(df, "provider", "pa", "a", ("ab", "b"), "y", ["a", "b", "ab"], ["facility"], ["facility"])[1]
    return out.select("term", "m", F.round("estimate", 3).alias("estimate"), F.round(F.sqrt("within"), 3).alias("within_root"), F.round(F.sqrt("between"), 3).alias("between_root"), F.round("se", 3).alias("se"), F.round("df", 1).alias("df"), F.round("missing_information", 5).alias("missing_information"))


@query(
    "recomputed_coefficients",
    f"""{ENC}, {REG}, m AS (SELECT avg(y) FILTER (x1 = 0 AND x2 = 0) AS m00, avg(y) FILTER (x1 = 1 AND x2 = 0) AS m10, avg(y) FILTER (x1 = 0 AND x2 = 1) AS m01, avg(y) FILTER (x1 = 1 AND x2 = 1) AS m11 FROM reg), r AS (SELECT 'one' AS term, m00 AS e FROM m UNION ALL SELECT 'a', m10 - m00 FROM m UNION ALL SELECT 'b', m01 - m00 FROM m UNION ALL SELECT 'ab', m11 - m10 - m01 + m00 FROM m)
SELECT term, round(e, 4) AS reported, round(e, 4) AS recomputed, TRUE AS passed FROM r""",
)
def _recomputed(spark, sf):
    df = _regression(spark, sf).withColumn("one", F.lit(1.0))
    fit = models.ols(df, "y", ["one", "a", "b", "ab"])
    out = sensitivity.recomputed(df, "y", ["one", "a", "b", "ab"], spark.createDataFrame([(r[0], r[1]) for r in fit.rows()], "term string, estimate double"))
    return out.select("term", F.round("reported", 4).alias("reported"), F.round("recomputed", 4).alias("recomputed"), "passed")


def newton(rounds: int = 12) -> str:
    """CTEs b0, b1, ...: the slope of a Poisson model with a level for each facility, which drop out of the likelihood."""
    p = "(n1 * exp(b) / (n0 + n1 * exp(b)))"
    return ", ".join(["b0 AS (SELECT 0.0::DOUBLE AS b)"] + [f"b{k} AS (SELECT any_value(b) + sum(s1 - sy * {p}) / sum(sy * {p} * (1 - {p})) AS b FROM fac, b{k - 1})" for k in range(1, rounds + 1)])


@query(
    "poisson_glm",
    f"""{ENC}, p AS (SELECT facility, provider, days AS y, {A} AS x FROM encounters), fac AS (SELECT facility, sum(y) AS sy, count(*) FILTER (x = 0) AS n0, count(*) FILTER (x = 1) AS n1, sum(y * x) AS s1 FROM p GROUP BY 1), {newton()},
mu AS (SELECT provider, facility, y, x, sy * exp(b * x) / (n0 + n1 * exp(b)) AS m, n1 * exp(b) / (n0 + n1 * exp(b)) AS xbar FROM p JOIN fac USING (facility), b12), h AS (SELECT sum(m * (x - xbar) * (x - xbar)) AS h, count(*) AS n, sum((y - m) * (y - m) / m) AS pearson, count(DISTINCT facility) AS levels FROM mu),
c1 AS (SELECT sum(s * s) AS v, count(*) AS g FROM (SELECT sum((x - xbar) * (y - m)) AS s FROM mu GROUP BY provider)), c2 AS (SELECT sum(s * s) AS v, count(*) AS g FROM (SELECT sum((x - xbar) * (y - m)) AS s FROM mu GROUP BY facility)), c12 AS (SELECT sum(s * s) AS v, count(*) AS g FROM (SELECT sum((x - xbar) * (y - m)) AS s FROM mu GROUP BY provider, facility))
SELECT 'a' AS term, round(b, 4) AS estimate, round(sqrt((n - 1.0) / (n - 1) * (c1.v * c1.g / (c1.g - 1) + c2.v * c2.g / (c2.g - 1) - c12.v * c12.g / (c12.g - 1))) / h, 4) AS se, round(pearson / (n - 1 - levels), 4) AS dispersion, least(c1.g, c2.g) - 1 AS df, n, TRUE AS converged FROM b12, h, c1, c2, c12""",
)
def _glm(spark, sf):
    df = encounters(spark, sf).select("facility", "provider", F.col("days").alias("y"), (F.col("order_status") == "F").cast("double").alias("a"))
    m = glm.glm(df, "y", ["a"], ["facility"], "poisson_log", ["provider", "facility"])
    return spark.createDataFrame([(r[0], round(r[1], 4), round(r[2], 4), round(m.dispersion, 4), m.fit.df, r[7], m.converged) for r in m.rows()], "term string, estimate double, se double, dispersion double, df int, n long, converged boolean")


GLM_OUTCOMES = {"days": ("poisson_log", "days", "TRUE"), "late": ("binomial_logit", "CAST(days > 1 AS double)", "TRUE"), "charge": ("gamma_log", "total", "total > 100000")}
PAIRS = ("11", "10", "01", "00")


def _saturated(name: str, kind: str, y: str, where: str) -> str:
    """Without effects and controls a model of a, b and ab fits the four means exactly. Whatever the link, the contrast of its fitted
    means is then that of the means, and its delta-method error that of the mean errors summed by cluster."""
    link = {"poisson_log": "ln(m{c})", "gamma_log": "ln(m{c})", "binomial_logit": "ln(m{c} / (1 - m{c}))"}[kind]
    slope = {"poisson_log": "m{c}", "gamma_log": "m{c}", "binomial_logit": "(m{c} * (1 - m{c}))"}[kind]
    spread = {"poisson_log": "m", "gamma_log": "m * m", "binomial_logit": "m * (1 - m)"}[kind]
    sign = {"11": 1, "10": -1, "01": -1, "00": 1}
    own = f"r AS (SELECT provider AS c1, facility AS c2, CAST({A} AS string) || CAST({B} AS string) AS c, CAST({y} AS double) AS y FROM encounters WHERE {where}), w AS (SELECT c, avg(y) AS m, count(*) AS k FROM r GROUP BY 1)"
    means = "t AS (SELECT " + ", ".join(f"max(m) FILTER (c = '{c}') AS m{c}" for c in PAIRS) + ", sum(k) AS n, sum(k * m) / sum(k) AS mean FROM w)"
    parts = "e AS (SELECT c1, c2, " + f"(y - m) / k * CASE c {' '.join(f'WHEN {chr(39)}{c}{chr(39)} THEN {v}' for c, v in sign.items())} END AS d, (y - m) / k * CASE c {' '.join(f'WHEN {chr(39)}{c}{chr(39)} THEN {v} / ' + slope.format(c=c) for c, v in sign.items())} END AS l, (y - m) * (y - m) / ({spread}) AS chi FROM r JOIN w USING (c), t)"
    sums = ", ".join(f"v{j} AS (SELECT count(*) AS g, sum(d * d) AS d, sum(l * l) AS l FROM (SELECT sum(d) AS d, sum(l) AS l FROM e GROUP BY {by}))" for j, by in enumerate(("c1", "c2", "c1, c2")))
    v = {c: f"sqrt((n - 1.0) / (n - 4) * (v0.{c} * v0.g / (v0.g - 1) + v1.{c} * v1.g / (v1.g - 1) - v2.{c} * v2.g / (v2.g - 1)))" for c in "dl"}
    total = {"d": " + ".join(f"({s}) * m{c}" for c, s in sign.items()), "l": " + ".join(f"({s}) * {link.format(c=c)}" for c, s in sign.items())}
    return f"""SELECT * FROM (WITH {own}, {means}, {parts}, {sums} SELECT '{name}' AS outcome, '{kind}' AS family, 'ab' AS term, round({total['l']}, 5) AS link_estimate, round({v['l']}, 5) AS link_se, round(({total['d']}) / mean, 6) AS contrast, round({v['d']} / mean, 6) AS contrast_se,
{', '.join(f'round(m{c} / mean, 6) AS mean_{c}' for c in PAIRS)}, round((SELECT sum(chi) FROM e) / (n - 4), 5) AS dispersion, CAST(n AS BIGINT) AS n, TRUE AS converged FROM t, v0, v1, v2)"""


@query("marginal_contrasts", f"{ENC} {' UNION ALL '.join(_saturated(n, *spec) for n, spec in GLM_OUTCOMES.items())}")
def _marginal(spark, sf):
    """Interactions on the link's scale and average marginal contrasts, in units of the outcome's mean, of three families."""
    e = encounters(spark, sf)
    df = e.select("provider", "facility", *[F.expr(y).cast("double").alias(n) for n, (_, y, _) in GLM_OUTCOMES.items()], "total", (F.col("order_status") == "F").cast("double").alias("a"), (F.col("segment") == "BUILDING").cast("double").alias("b")).withColumn("ab", F.col("a") * F.col("b"))
    out = glm.pair_models(df, {n: (kind, where) for n, (kind, _, where) in GLM_OUTCOMES.items()}, "a", "b", "ab", [], [], ["provider", "facility"])
    share = [F.round(F.col(c) / F.col("outcome_mean"), 6).alias(c) for c in ("contrast", "contrast_se", *[f"mean_{c}" for c in PAIRS])]
    return out.select("outcome", "family", "term", F.round("link_estimate", 5).alias("link_estimate"), F.round("link_se", 5).alias("link_se"), *share, F.round("dispersion", 5).alias("dispersion"), "n", "converged")


@query(
    "outcome_models",
    f"""{ENC}, p AS (SELECT facility, provider, days AS y, {A} AS x FROM encounters), fac AS (SELECT facility, sum(y) AS sy, count(*) FILTER (x = 0) AS n0, count(*) FILTER (x = 1) AS n1, sum(y * x) AS s1 FROM p GROUP BY 1), {newton()}
SELECT 'days' AS outcome, 'poisson_log' AS family, 'a' AS term, round(b, 4) AS estimate, (SELECT count(*) FROM p) AS n, CAST(NULL AS string) AS note FROM b12 UNION ALL SELECT 'rare', 'binomial_logit', NULL, NULL, count(*), CAST(count(*) FILTER (visit_id <= 40) AS string) || ' events' FROM encounters""",
)
def _outcomes(spark, sf):
    df = encounters(spark, sf).select("facility", "provider", "days", (F.col("visit_id") <= 40).cast("double").alias("rare"), (F.col("order_status") == "F").cast("double").alias("a"))
    out = sensitivity.outcome_models(df, {"days": "poisson_log", "rare": "binomial_logit"}, ["a"], ["facility"], "provider")
    return out.select("outcome", "family", "term", F.round("estimate", 4).alias("estimate"), "n", "note")


@query(
    "directed_cells",
    f"""{ENC}, {REG}, one AS (SELECT 1 AS g, * FROM reg), {demeaned('d', 'one', 'c2')}, {solved('d', 3, 2)}, g AS (SELECT least(count(DISTINCT c1), count(DISTINCT c2)) - 1 AS df FROM reg)
SELECT 'did' AS contrast, round(estimate, 3) AS estimate, round(se, 3) AS se, TRUE AS identified, n, df FROM fit, g WHERE j = 3 UNION ALL SELECT 'level', NULL, NULL, FALSE, (SELECT count(*) FROM reg), df FROM g""",
)
def _cells(spark, sf):
    df = _regression(spark, sf)
    left = {"f": F.col("a"), "n": 1 - F.col("a")}
    right = {"b": F.col("b"), "o": 1 - F.col("b")}
    df = df.withColumns(reshape.cell_basis((left, right)))
    out = cells.cell_model(df, "y", ["f_b", "f_o", "n_b", "n_o"], [], ["facility"], ["provider", "facility"], {"did": {"f_b": 1, "f_o": -1, "n_b": -1, "n_o": 1}, "level": {"f_b": 1}})
    return out.withColumn("estimate", F.round("estimate", 3)).withColumn("se", F.round("se", 3))


CELLS = ("f_b", "f_o", "n_b", "n_o")
DID = {"f_b": 1.0, "f_o": -1.0, "n_b": -1.0, "n_o": 1.0}


def _celled(spark, sf):
    df = _regression(spark, sf)
    return df.withColumns(reshape.cell_basis(({"f": F.col("a"), "n": 1 - F.col("a")}, {"b": F.col("b"), "o": 1 - F.col("b")})))


def _functionals(source: str, g: str) -> str:
    """CTEs: the error of each functional t (name, j, coefficient) of the columns of `part`, clustered two ways."""
    own = f"{g}p AS (SELECT t.name, c1, c2, sum(t.k * s) AS s FROM {source} p JOIN {g}t t ON t.j = p.j GROUP BY t.name, c1, c2)"
    sums = ", ".join(f"{g}v{m} AS (SELECT name, sum(s * s) AS v{m} FROM (SELECT name, sum(s) AS s FROM {g}p GROUP BY name, {by}) GROUP BY name)" for m, by in enumerate(("c1", "c2", "c1, c2")))
    return f"{own}, {sums}"


TOTAL = "v0 * g0 / (g0 - 1) + v1 * g1 / (g1 - 1) - v2 * g2 / (g2 - 1)"


@query(
    "cell_predictions",
    f"""{ENC}, {REG}, named AS (SELECT *, CASE WHEN x1 = 1 THEN 'f_' ELSE 'n_' END || CASE WHEN x2 = 1 THEN 'b' ELSE 'o' END AS cell FROM reg), w AS (SELECT cell, count(*) AS k, avg(y) AS m, any_value(x1) AS x1, any_value(x2) AS x2, any_value(x3) AS x3 FROM named GROUP BY 1),
o AS (SELECT count(*) AS n, avg(y) AS y, avg(x1) AS x1, avg(x2) AS x2, avg(x3) AS x3, count(DISTINCT c1) AS g0, count(DISTINCT c2) AS g1, count(DISTINCT {{'a': c1, 'b': c2}}) AS g2, least(count(DISTINCT c1), count(DISTINCT c2)) - 1 AS df FROM reg),
u_part AS (SELECT cell AS j, c1, c2, (y - m) / k AS s FROM named JOIN w USING (cell)), u_t AS (SELECT cell AS name, cell AS j, 1.0 AS k FROM w UNION ALL SELECT 'did', cell, CASE WHEN cell IN ('f_b', 'n_o') THEN 1.0 ELSE -1.0 END FROM w), {_functionals('u_part', 'u_')},
one AS (SELECT 1 AS g, * FROM reg), {demeaned('d', 'one', 'c2')}, {solved('d', 3, 2)}, est AS (SELECT max(estimate) FILTER (j = 1) AS b1, max(estimate) FILTER (j = 2) AS b2, max(estimate) FILTER (j = 3) AS b3 FROM fit),
m_t AS (SELECT cell AS name, j, CASE j WHEN 1 THEN w.x1 - o.x1 WHEN 2 THEN w.x2 - o.x2 ELSE w.x3 - o.x3 END AS k FROM w, o, (SELECT unnest([1, 2, 3]) AS j) UNION ALL SELECT 'did', 3, 1.0), {_functionals('part', 'm_')},
status AS (SELECT cell AS name, CASE WHEN k < 10 THEN 'NON_ESTIMABLE_SUPPORT' WHEN k < 0.2 * n THEN 'LIMITED_SUPPORT' ELSE 'PASS' END AS status FROM w, o UNION ALL SELECT 'did', CASE WHEN min(k) < 10 THEN 'NON_ESTIMABLE_SUPPORT' WHEN min(k) < 0.2 * any_value(n) THEN 'LIMITED_SUPPORT' ELSE 'PASS' END FROM w, o),
found AS (
  SELECT 'U0' AS model_id, CASE WHEN name = 'did' THEN 'contrast' ELSE 'prediction' END AS kind, name, CASE WHEN name = 'did' THEN (SELECT sum(m * CASE WHEN cell IN ('f_b', 'n_o') THEN 1 ELSE -1 END) FROM w) ELSE (SELECT m FROM w WHERE cell = name) END AS estimate, sqrt((n - 1.0) / (n - 4) * ({TOTAL})) AS se FROM u_v0 JOIN u_v1 USING (name) JOIN u_v2 USING (name), o
  UNION ALL SELECT 'M2', CASE WHEN name = 'did' THEN 'contrast' ELSE 'prediction' END, name, CASE WHEN name = 'did' THEN b3 ELSE y + (SELECT (w.x1 - o.x1) * b1 + (w.x2 - o.x2) * b2 + (w.x3 - o.x3) * b3 FROM w WHERE cell = name) END, sqrt((n - 1.0) / (n - 3) * ({TOTAL})) FROM m_v0 JOIN m_v1 USING (name) JOIN m_v2 USING (name), o, est
)
SELECT model_id, kind, name, round(estimate, 3) AS estimate, round(se, 3) AS se, TRUE AS identified, CAST(df AS BIGINT) AS df, n, status FROM found JOIN status USING (name), o
UNION ALL SELECT 'U0', 'contrast', 'level', round(estimate, 3), round(se, 3), TRUE, df, n, status FROM found JOIN status USING (name), o WHERE model_id = 'U0' AND name = 'f_b'
UNION ALL SELECT 'M2', 'contrast', 'level', NULL, NULL, FALSE, df, n, 'NON_ESTIMABLE_IDENTIFICATION' FROM o""",
)
def _predictions(spark, sf):
    df = _celled(spark, sf)
    counts = reshape.melt(df, [], list(CELLS)).groupBy(F.col("variable").alias("cell")).agg(F.sum("value").alias("k"), F.count("*").alias("n"))
    support = counts.select("cell", (F.col("k") >= 10).alias("passed"), (F.col("k") < 0.2 * F.col("n")).alias("limited"))
    out, _ = cells.directional_models(df, "y", CELLS, [], {"U0": [], "M2": ["facility"]}, ["provider", "facility"], {"did": DID, "level": {"f_b": 1.0}}, support)
    shown = [F.when(F.col("identified"), F.round(c, 3)).alias(c) for c in ("estimate", "se")]
    return out.select("model_id", "kind", "name", *shown, "identified", "df", "n", "status")


def _slopes(source: str) -> str:
    """Within each specification g, the slope of y on v where b is 1 less that where it is 0, with errors clustered by c1: fit."""
    return f"""sl AS (SELECT g, b, avg(v) AS vm, avg(y) AS ym, covar_pop(v, y) / var_pop(v) AS k, var_pop(v) * count(*) AS ss FROM {source} GROUP BY 1, 2),
inf AS (SELECT g, c1, sum(CASE b WHEN 1 THEN 1 ELSE -1 END * (v - vm) / ss * (y - ym - k * (v - vm))) AS s, count(*) AS n FROM {source} JOIN sl USING (g, b) GROUP BY 1, 2),
var_ AS (SELECT g, sum(s * s) * count(*) / (count(*) - 1) * (sum(n) - 1) / (sum(n) - 4) AS v, sum(n)::BIGINT AS n, count(*) - 1 AS df FROM inf GROUP BY 1),
fit AS (SELECT g, sum(CASE b WHEN 1 THEN k ELSE -k END) AS e, any_value(var_.v) AS v, any_value(n) AS n, any_value(df) AS df FROM sl JOIN var_ USING (g) GROUP BY g)"""


SECOND = f"(0.2 + 0.5 * {PROB})"


@query(
    "measured_cells",
    f"""{ENC}, r AS (SELECT provider AS c1, {B} AS b, total AS y, CAST({PROB} AS double) AS p, CAST({SECOND} AS double) AS p2 FROM encounters),
u AS (SELECT DISTINCT provider AS c1, draw, {UNIFORM.format(seed=5, unit='provider')} AS u FROM encounters, range(1, 21) t(draw)),
src AS (SELECT 'population_probability' AS g, c1, b, y, p AS v FROM r UNION ALL SELECT 'national_probability', c1, b, y, p2 FROM r
  UNION ALL SELECT 'population_hard_0.6', c1, b, y, CASE WHEN p >= 1 - p THEN 1.0 ELSE 0 END FROM r WHERE greatest(p, 1 - p) >= 0.6 UNION ALL SELECT 'national_hard_0.6', c1, b, y, CASE WHEN p2 >= 1 - p2 THEN 1.0 ELSE 0 END FROM r WHERE greatest(p2, 1 - p2) >= 0.6
  UNION ALL SELECT 'draw' || CAST(draw AS string), c1, b, y, CASE WHEN u < p THEN 1.0 ELSE 0 END FROM r JOIN u USING (c1)), {_slopes('src')},
pool AS (SELECT avg(e) AS e, avg(v) AS w, var_samp(e) * (1 + 1.0 / count(*)) AS share, min(n) AS n, min(df) AS least, count(*) AS m FROM fit WHERE g LIKE 'draw%')
SELECT g AS specification, 'did' AS contrast, round(e, 3) AS estimate, round(sqrt(v), 3) AS se, CAST(df AS DOUBLE) AS df, n, CAST(1 AS BIGINT) AS m FROM fit WHERE g NOT LIKE 'draw%'
UNION ALL SELECT 'population_drawn', 'did', round(e, 3), round(sqrt(w + share), 3), round(least((m - 1) * pow(1 + w / share, 2), least), 3), n, m FROM pool""",
)
def _measured(spark, sf):
    """The difference in differences with a class known by probability, by threshold and by 20 draws, under two priors."""
    df = _regression(spark, sf).withColumns({"p": F.expr(PROB).cast("double"), "p2": F.expr(SECOND).cast("double")}).withColumns({"q": 1 - F.col("p"), "q2": 1 - F.col("p2")})
    out = sensitivity.measured_cells(df, "provider", {"population": {"x": "p", "z": "q"}, "national": {"x": "p2", "z": "q2"}}, {"b": F.col("b"), "o": 1 - F.col("b")}, "y", [], {"U0": []}, ["provider"], {"did": {"x_b": 1.0, "x_o": -1.0, "z_b": -1.0, "z_o": 1.0}}, 20, 5, [0.6])
    return out.select("specification", "contrast", F.round("estimate", 3).alias("estimate"), F.round("se", 3).alias("se"), F.round("df", 3).alias("df"), "n", "m")


#: specification: (outcome, exposure, partner, rows), as expressions; each is fitted with the product of exposure and partner.
SPECIFICATIONS = {
    "probability_population": ("total", f"CAST({PROB} AS double)", B, "TRUE"),
    "probability_national": ("total", f"CAST({SECOND} AS double)", B, "TRUE"),
    "threshold_0.6": ("total", "CAST((provider * 17) % 100 >= 50 AS int)", B, "abs((provider * 17) % 100 - 50) >= 10"),
    "classified_subset": ("total", A, B, "weekday_raw < '5'"),
    "intersection": ("total", f"{A} * {B}", "CAST(priority = '1-URGENT' AS int)", "TRUE"),
    "modifier": ("total", A, "CAST(priority = '2-HIGH' AS int)", "TRUE"),
    "negative_control": ("discharge_hour", A, B, "TRUE"),
    "historical": ("ln(1 + total)", A, B, "visit_year < 2008"),
}


@query(
    "specification_sweep",
    f"""{ENC}, s0 AS ({' UNION ALL '.join(f"SELECT '{n}' AS g, provider AS c1, facility AS c2, CAST({y} AS double) AS y, CAST({x} AS double) AS x1, CAST({z} AS double) AS x2, CAST(({x}) * ({z}) AS double) AS x3 FROM encounters WHERE {where}" for n, (y, x, z, where) in SPECIFICATIONS.items())}), {demeaned('d', 's0', 'g, c2')}, {solved('d', 3, 2)}
SELECT g AS spec, CASE j WHEN 1 THEN 'exposure' WHEN 2 THEN 'partner' ELSE 'product' END AS term, round(estimate, 4) AS estimate, round(se, 4) AS se, n FROM fit""",
)
def _specifications(spark, sf):
    """Probability and threshold exposures, a subset by class, an intersection, a modifier, a negative control and a historical model."""
    df, specs = encounters(spark, sf), {}
    for k, (name, (y, x, z, where)) in enumerate(SPECIFICATIONS.items()):
        df = df.withColumns({f"y{k}": F.expr(y).cast("double"), f"x{k}": F.expr(x).cast("double"), f"z{k}": F.expr(z).cast("double"), f"w{k}": F.expr(where)}).withColumn(f"p{k}", F.col(f"x{k}") * F.col(f"z{k}"))
        specs[name] = {"y": f"y{k}", "x": [f"x{k}", f"z{k}", f"p{k}"], "where": F.col(f"w{k}")}
    out = sensitivity.swept(df, specs, "total", ["facility"], ["provider", "facility"])
    term = F.when(F.col("term").startswith("x"), "exposure").when(F.col("term").startswith("z"), "partner").otherwise("product")
    return out.select("spec", term.alias("term"), F.round("estimate", 4).alias("estimate"), F.round("se", 4).alias("se"), "n")


#: cohort definitions: the rows of each.
DEFINITIONS = {"principal": "status_raw < '40'", "any_listed": "status_raw < '60'", "strict": "status_raw < '20' AND priority < '4'"}


@query("definition_models", f"{ENC} {' UNION ALL '.join(_saturated(f'{d}_{n}', k, y, where) for d, where in DEFINITIONS.items() for n, (k, y, _) in GLM_OUTCOMES.items() if n != 'charge')} UNION ALL SELECT 'rare_late', 'binomial_logit', 'ab', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 0, FALSE")
def _definitions(spark, sf):
    """Length of stay and a yes-or-no outcome under three definitions of a cohort; a cohort without both outcomes is a row without estimates."""
    e = encounters(spark, sf).withColumns({"a": (F.col("order_status") == "F").cast("double"), "b": (F.col("segment") == "BUILDING").cast("double")}).withColumn("ab", F.col("a") * F.col("b"))
    outcomes = {f"{d}_{n}": (k, y, where) for d, where in DEFINITIONS.items() for n, (k, y, _) in GLM_OUTCOMES.items() if n != "charge"} | {"rare_late": ("binomial_logit", GLM_OUTCOMES["late"][1], "days < 1")}
    df = e.withColumns({n: F.expr(y).cast("double") for n, (_, y, _) in outcomes.items()})
    out = glm.pair_models(df, {n: (k, where) for n, (k, _, where) in outcomes.items()}, "a", "b", "ab", [], [], ["provider", "facility"])
    share = [F.round(F.col(c) / F.col("outcome_mean"), 6).alias(c) for c in ("contrast", "contrast_se", *[f"mean_{c}" for c in PAIRS])]
    return out.select("outcome", "family", "term", F.round("link_estimate", 5).alias("link_estimate"), F.round("link_se", 5).alias("link_se"), *share, F.round("dispersion", 5).alias("dispersion"), "n", "converged")


@query("audited_covariance", f"{ENC}, {REG}, one AS (SELECT 1 AS g, * FROM reg), {demeaned('d', 'one', 'c2')}, {solved('d', 3, 2)} SELECT {TERM} AS term, round(se, 3) AS reported, round(se, 3) AS recomputed, TRUE AS passed FROM fit")
def _audited(spark, sf):
    df, fit = _flat(spark, sf)
    out = sensitivity.recomputed_covariance(df, "y", fit.names, ["provider", "facility"], fit.covariance)
    return out.filter("row = column").select(F.col("row").alias("term"), F.round(F.sqrt("reported"), 3).alias("reported"), F.round(F.sqrt("recomputed"), 3).alias("recomputed"), "passed")


@query(
    "influential_refits",
    f"""WITH s0 AS ({ENC}, {REG} SELECT 'y' AS o, c1, c2, y, x1, x2, x3 FROM reg UNION ALL SELECT 'days', provider, facility, days, {A}, {B}, {A} * {B} FROM encounters),
top AS (SELECT * FROM (WITH src AS (SELECT o AS g, * FROM s0), {demeaned('d', 'src', 'g, c2')}, {solved('d', 3, 1)} SELECT g, c2, abs(sum(s)) AS size FROM part WHERE j = 3 GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY g ORDER BY size DESC, c2) <= 3),
named AS (SELECT DISTINCT c2 AS f FROM top UNION ALL SELECT -1),
fits AS (SELECT * FROM (WITH src AS (SELECT {{'o': o, 'f': f}} AS g, s0.* FROM s0 JOIN named ON c2 <> f), {demeaned('d', 'src', 'g, c2')}, {solved('d', 3, 1)} SELECT g.o AS outcome, g.f AS f, count_ AS n, estimate FROM fit JOIN (SELECT g, count(*) AS count_ FROM src GROUP BY 1) USING (g) WHERE j = 3))
SELECT a.outcome, nullif(a.f, -1) AS left_out, a.n, round(a.estimate, 5) AS estimate, round(a.estimate - b.estimate, 5) AS shift FROM fits a JOIN fits b ON b.outcome = a.outcome AND b.f = -1""",
)
def _influential(spark, sf):
    """Two outcomes, each without every facility that is among the three most influential of either."""
    e = encounters(spark, sf)
    df = e.select("provider", "facility", F.col("total").alias("y"), "days", (F.col("order_status") == "F").cast("double").alias("a"), (F.col("segment") == "BUILDING").cast("double").alias("b")).withColumn("ab", F.col("a") * F.col("b"))
    out = models.without_influential(df, ["y", "days"], ["a", "b", "ab"], "ab", ["facility"], "facility", 3)
    return out.select("outcome", "left_out", "n", F.round("estimate", 5).alias("estimate"), F.round("shift", 5).alias("shift"))


@query("cell_basis", f"{ENC} SELECT visit_id, {PROB} * {B} AS p_b, {PROB} * (1 - {B}) AS p_o, (1 - {PROB}) * {B} AS q_b, (1 - {PROB}) * (1 - {B}) AS q_o FROM encounters".replace(" AS p_b", " AS p_b"))
def _basis(spark, sf):
    e = encounters(spark, sf).withColumn("p", F.expr(PROB).cast("double")).withColumn("b", (F.col("segment") == "BUILDING").cast("double"))
    basis = reshape.cell_basis(({"p": F.col("p"), "q": 1 - F.col("p")}, {"b": F.col("b"), "o": 1 - F.col("b")}))
    return e.select("visit_id", *[c.alias(n) for n, c in basis.items()])


@query(
    "design_frame",
    f"""{ENC} SELECT visit_id, age AS lin, greatest(age - 18, 0) AS k18, greatest(age - 65, 0) AS k65, CASE WHEN segment = 'AUTOMOBILE' THEN 1.0 ELSE 0 END AS AUTOMOBILE, CASE WHEN segment = 'MACHINERY' THEN 1.0 ELSE 0 END AS MACHINERY, coalesce(age, 40) AS age_filled, CASE WHEN age IS NULL THEN 1.0 ELSE 0 END AS age_missing,
CASE WHEN segment = 'AUTOMOBILE' THEN 1.0 ELSE 0 END * age AS auto_lin, CASE WHEN segment = 'MACHINERY' THEN 1.0 ELSE 0 END * greatest(age - 65, 0) AS machinery_k65, age IS NOT NULL AND sex_raw IS NOT NULL AS complete FROM encounters""",
)
def _design(spark, sf):
    e = encounters(spark, sf)
    bends, levels = models.spline(F.col("age"), [18, 65]), models.one_hot(F.col("segment"), ["BUILDING", "AUTOMOBILE", "MACHINERY"], "BUILDING")
    filled, missing = models.imputed(F.col("age"), 40)
    products = models.interactions(levels, bends)
    zero = {n: F.when(F.col("age").isNotNull(), c) for n, c in bends.items()}  # greatest() passes over nulls
    return e.select(
        "visit_id", zero["lin"].alias("lin"), *[F.coalesce(bends[k], F.lit(0.0)).alias(k) for k in ("k18", "k65")], *[c.alias(n) for n, c in levels.items()], filled.alias("age_filled"), missing.alias("age_missing"),
        products["AUTOMOBILE:lin"].alias("auto_lin"), products["MACHINERY:k65"].alias("machinery_k65"), models.complete(["age", "sex_raw"]).alias("complete"),
    )


@query(
    "sample_policies",
    f"""{ENC}, d AS (SELECT visit_id, age AS los, CASE WHEN visit_id % 5 = 0 THEN NULL ELSE total END AS charge, visit_id % 3 > 0 AS ok FROM encounters) SELECT 'common_primary' AS policy, count(*) AS n, count(*) FILTER (ok) AS eligible FROM d WHERE los IS NOT NULL AND charge IS NOT NULL UNION ALL SELECT 'los_outcome', count(*), count(*) FILTER (ok) FROM d WHERE los IS NOT NULL UNION ALL SELECT 'charge_outcome', count(*), count(*) FILTER (ok) FROM d WHERE charge IS NOT NULL""",
)
def _policies(spark, sf):
    d = encounters(spark, sf).select("visit_id", F.col("age").alias("los"), F.when(F.col("visit_id") % 5 != 0, F.col("total")).alias("charge"), (F.col("visit_id") % 3 > 0).alias("ok"))
    out = None
    for policy in models.POLICIES:
        every = models.sample(d, policy, ["los", "charge"]).agg(F.count("*").alias("n"))
        own = models.sample(d, policy, ["los", "charge"], "ok").agg(F.count("*").alias("eligible"))
        one = every.join(own).select(F.lit(policy).alias("policy"), "n", "eligible")
        out = one if out is None else out.unionByName(one)
    return out


FAMILY = {"cohort": "CASE c_custkey % 2 WHEN 0 THEN 'race' ELSE 'gender' END", "model": "CASE c_custkey % 3 WHEN 0 THEN 'm2_facility' WHEN 1 THEN 'm1_plain' ELSE 'm3_physician' END", "outcome": "CASE c_custkey % 5 WHEN 0 THEN 'los_hours' WHEN 1 THEN 'total_charge' WHEN 2 THEN 'died' WHEN 3 THEN 'n_codes' ELSE 'else' END", "policy": "CASE c_custkey % 4 WHEN 0 THEN 'los_outcome' WHEN 1 THEN 'charge_outcome' ELSE 'common_primary' END", "p": "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE ((c_custkey * 7919) % 1009) / CAST(1009 AS double) END"}
FAMILY_SQL = f"""f AS (SELECT c_custkey, {', '.join(f'{e} AS {n}' for n, e in FAMILY.items())} FROM customer), n AS (SELECT *, policy IN ('los_outcome', 'charge_outcome') AS own, outcome IN ('los_hours', 'total_charge') AS head FROM f),
a AS (SELECT c_custkey, p, CASE WHEN cohort = 'race' AND model LIKE 'm2@_%' ESCAPE '@' AND head AND own THEN 'confirmatory_race_primary' ELSE 'secondary_' || cohort || '_' || model || CASE WHEN own THEN '_outcome_specific_robustness' WHEN head THEN '_common_sample_primary_robustness' WHEN outcome = 'died' THEN '_disposition' WHEN outcome = 'n_codes' THEN '_intensity' ELSE '_other' END END AS family FROM n)"""


def _families(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", *[F.expr(e).alias(n) for n, e in FAMILY.items()]).withColumn("p", F.col("p").cast("double"))
    family, method = inference.family_of(F.col("cohort"), F.col("model"), F.col("outcome"), F.col("policy"), {"disposition": ["died"], "intensity": ["n_codes"]})
    return df.withColumn("family", family).withColumn("method", method)


@query("family_assignment", f"WITH {FAMILY_SQL} SELECT c_custkey, family, CASE WHEN family LIKE 'confirm%' THEN 'holm' ELSE 'fdr_bh' END AS method FROM a")
def _assignment(spark, sf):
    return _families(spark, sf).select("c_custkey", "family", "method")


@query("family_counts", f"WITH {FAMILY_SQL} SELECT family, count(*) AS rows, count(p) AS estimable FROM a GROUP BY 1")
def _family_counts(spark, sf):
    return inference.family_counts(_families(spark, sf), ["family"], "p")


@query(
    "readjusted",
    f"""WITH {FAMILY_SQL}, r AS (SELECT *, count(*) OVER (PARTITION BY family) AS m, row_number() OVER (PARTITION BY family ORDER BY p, c_custkey) AS r FROM a WHERE p IS NOT NULL) SELECT family, c_custkey, round(least(1.0, min(m * p / r) OVER (PARTITION BY family ORDER BY p, c_custkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS recomputed, TRUE AS passed FROM r""",
)
def _readjusted(spark, sf):
    return sensitivity.readjusted(inference.adjust(_families(spark, sf).select("family", "c_custkey", "p"), ["family"], "p", ["c_custkey"]), ["family"], "p", ["c_custkey"], "bh")


@query("cluster_sample", f"{ENC}, s AS (SELECT DISTINCT provider FROM encounters WHERE (CAST(CAST('0x' || substr(sha256('7|' || CAST(provider AS string)), 1, 16) AS UBIGINT) AS DOUBLE) + 0.5) / 18446744073709551616.0 < 0.3) SELECT visit_id FROM encounters WHERE provider IN (SELECT provider FROM s)")
def _cluster_sample(spark, sf):
    return inference.whole_cluster_sample(encounters(spark, sf), "provider", 0.3, 7).select("visit_id")


CLASSES = {"a": f"0.5 * {PROB}", "b": f"0.5 - 0.25 * {PROB}", "c": f"0.5 - 0.25 * {PROB}"}
DRAWS = f"cd AS (SELECT provider, draw, CASE WHEN u < 0.5 * p THEN 'a' WHEN u < 0.5 * p + (0.5 - 0.25 * p) THEN 'b' ELSE 'c' END AS value FROM (SELECT provider, p, draw, {UNIFORM.format(seed=5, unit='provider')} AS u FROM (SELECT DISTINCT provider, {PROB} AS p FROM encounters), range(1, 21) t(draw)))"


def _classed(spark, sf):
    return encounters(spark, sf).withColumns({n: F.expr(e).cast("double") for n, e in CLASSES.items()})


@query(
    "categorical_imputation",
    f"""{ENC}, {DRAWS}, m AS (SELECT draw, value, avg(total) AS e, var_samp(total) / count(*) AS v FROM encounters JOIN cd USING (provider) GROUP BY 1, 2), p AS (SELECT value, count(*) AS m, avg(e) AS e, avg(v) AS w, var_samp(e) AS b FROM m GROUP BY 1) SELECT value, m, round(e, 3) AS estimate, round(sqrt(w + (1 + 1.0 / m) * b), 3) AS se FROM p""",
)
def _categorical(spark, sf):
    """Twenty draws of a class for each provider, the mean in each class, pooled."""
    df = _classed(spark, sf)
    drawn = inference.categorical_draws(df, "provider", list(CLASSES), 20, 5)
    e = df.select("provider", "total").join(drawn, "provider").groupBy("draw", "value").agg(F.avg("total").alias("e"), (F.var_samp("total") / F.count("*")).alias("v"))
    return inference.rubin(e, ["value"], "e", "v").select("value", "m", F.round("estimate", 3).alias("estimate"), F.round("se", 3).alias("se"))


@query(
    "drawn_cells",
    f"""{ENC}, {DRAWS} SELECT visit_id, {', '.join(f"CASE WHEN value = '{c}' AND segment {op} 'BUILDING' THEN 1.0 ELSE 0 END AS {c}_{n}" for c in CLASSES for n, op in (('in', '='), ('out', '<>')))} FROM encounters JOIN cd USING (provider) WHERE draw = 3""",
)
def _drawn(spark, sf):
    right = {"in": (F.col("segment") == "BUILDING").cast("double"), "out": (F.col("segment") != "BUILDING").cast("double")}
    out = sensitivity.drawn_cells(_classed(spark, sf), "provider", list(CLASSES), right, 3, 5)
    return out.select("visit_id", *[f"{c}_{n}" for c in CLASSES for n in right])


@query(
    "modifier_terms",
    f"""{ENC}, d AS (SELECT visit_id, {A} AS a, {B} AS b, priority FROM encounters) SELECT visit_id, a, b, {', '.join(f"CASE WHEN priority = '{p}' THEN 1.0 ELSE 0 END AS m{k}, a * CASE WHEN priority = '{p}' THEN 1.0 ELSE 0 END AS a{k}, b * CASE WHEN priority = '{p}' THEN 1.0 ELSE 0 END AS b{k}" for k, p in enumerate(('2-HIGH', '3-MEDIUM')))} FROM d""",
)
def _modifiers(spark, sf):
    df = encounters(spark, sf).select("visit_id", (F.col("order_status") == "F").cast("double").alias("a"), (F.col("segment") == "BUILDING").cast("double").alias("b"), "priority")
    out, _ = sensitivity.modified(df, ["a", "b"], "priority", ["1-URGENT", "2-HIGH", "3-MEDIUM"], "1-URGENT")
    return out.select("visit_id", "a", "b", *[F.col(f"`{x}`").alias(f"{n}{k}") for k, p in enumerate(("2-HIGH", "3-MEDIUM")) for n, x in (("m", f"m_{p}"), ("a", f"a_m_{p}"), ("b", f"b_m_{p}"))])


@query("name_prior_sensitivity", f"""WITH a AS ({_name_sql(nameprob.POPULATION_PRIOR, 12)}), b AS ({_name_sql(nameprob.PHYSICIAN_PRIOR, 12)}), l AS (SELECT *, greatest({', '.join(f'abs(a.{c} - b.{c})' for c in SHARES)}) AS gap,
{' , '.join(f"CASE {' '.join(f'WHEN {t}.{c} = greatest(' + ', '.join(f'{t}.{k}' for k in SHARES) + f') THEN {chr(39)}{c}{chr(39)}' for c in SHARES)} END AS label_{t}" for t in 'ab')} FROM a JOIN b ON a.id = b.id)
SELECT count(*) AS n, count(*) FILTER (label_a = label_b) AS same_label, round(max(gap), 6) AS max_gap, round(avg(gap), 6) AS mean_gap, CAST(0 AS BIGINT) AS bad_sums FROM l""")
def _sensitivity(spark, sf):
    names, d = _name_parts(spark, sf)
    return nameprob.prior_sensitivity(nameprob.model(names, d, "id", {"last": "ln", "first": "fn", "middle": "mn"}), "population", "physician")
