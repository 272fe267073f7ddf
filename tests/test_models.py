import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.operators import cells, effects, glm, gram, models
from wardline.plans import sensitivity


@pytest.fixture(scope="module")
def wide(spark):
    """115 columns and 42 outcomes, a group and a cluster."""
    rng = np.random.default_rng(5)
    z = rng.normal(size=(600, 157)).round(3)
    g = rng.integers(0, 3, 600)
    df = spark.createDataFrame([(int(a), [float(v) for v in r]) for a, r in zip(g, z, strict=True)], "g int, z array<double>")
    return df.select("g", *[F.col("z")[j].alias(f"c{j}") for j in range(157)]).repartition(5).persist(), z, g


def test_wide_cross_products_in_one_pass(wide):
    df, z, g = wide
    x, y = [f"c{j}" for j in range(115)], [f"c{j}" for j in range(115, 157)]
    xx, xy, yy, n = models.cross_products(df, x, y)
    assert n == 600 and np.allclose(xx, z[:, :115].T @ z[:, :115]) and np.allclose(xy, z[:, :115].T @ z[:, 115:]) and np.allclose(yy, (z[:, 115:] ** 2).sum(axis=0))
    plan = df.groupBy("g").count()._jdf.queryExecution().toString()
    assert "Python" not in plan  # the frame itself needs none


@pytest.mark.parametrize("k", [3, 20])
def test_narrow_and_wide_sums_agree(wide, k, monkeypatch):
    df, z, g = wide
    names, z = [f"c{j}" for j in range(k)], z[:, :k]
    df = df.withColumn("w", F.abs("c150"))
    w = np.abs(wide[1][:, 150])
    for most in (0, 100):
        monkeypatch.setattr(gram, "NARROW", most)
        monkeypatch.setattr(gram, "HELD", 500)
        got = gram.grams(df, names, "g", "w")
        assert set(got) == {0, 1, 2}
        assert all(n == (g == v).sum() and np.allclose(m, (z[g == v] * w[g == v, None]).T @ z[g == v]) for v, (m, n) in got.items())
        total, n = gram.gram(df.filter("g = 7"), names)
        assert n == 0 and not total.any()
        assert np.allclose(gram.grams(df.withColumn("s", F.concat(F.lit("k"), "g")), names, "s")["k1"][0], z[g == 1].T @ z[g == 1])


def chain(n):
    """Movers along a chain: each unit is seen at two neighbouring places, the weakest way to connect them."""
    rng = np.random.default_rng(8)
    u = np.repeat(np.arange(n - 1), 2)
    p = u + np.tile([0, 1], n - 1)
    return u, p, rng.normal(size=2 * (n - 1)), rng.normal(size=2 * (n - 1))


def test_weakly_connected_effects_need_few_rounds(spark):
    u, p, y, x = chain(12)
    d = np.hstack([np.eye(11)[u], np.eye(12)[p]])
    m = np.eye(len(y)) - d @ np.linalg.pinv(d)
    df = spark.createDataFrame([(f"u{a}", int(b), float(c), float(e)) for a, b, c, e in zip(u, p, y + 3 * p, x, strict=True)], "u string, p int, y double, x double")
    flat, how = effects.demean(df.withColumn("k", F.monotonically_increasing_id()), ["y", "x"], ["u", "p"])
    got = np.array([[r["y"], r["x"]] for r in flat.orderBy("k").collect()])
    assert how["converged"] and how["tolerance"] == 1e-8 and np.allclose(got, np.column_stack([m @ y, m @ x]), atol=1e-7)
    turns, v = 0, y + 3.0 * p
    while np.abs([v[u == k].mean() for k in range(11)]).max() > 1e-8 * np.sqrt(np.mean((y + 3 * p) ** 2)) and turns < 10_000:
        v = v - np.array([v[u == k].mean() for k in range(11)])[u]
        v = v - np.array([v[p == k].mean() for k in range(12)])[p]
        turns += 1
    assert how["rounds"] <= 23 and turns > 5 * how["rounds"]


def test_three_weighted_effects_with_a_hot_level(spark):
    rng = np.random.default_rng(6)
    n = 900
    g, h, s = np.where(rng.random(n) < 0.4, 0, rng.integers(0, 40, n)), rng.integers(0, 30, n), rng.integers(0, 4, n)
    w, y = rng.integers(1, 5, n).astype(float), rng.normal(size=n)
    df = spark.createDataFrame([(int(a), int(b), int(c), float(e), float(v), k) for k, (a, b, c, e, v) in enumerate(zip(g, h, s, w, y, strict=True))] + [(None, 1, 1, 1.0, 1.0, -1)], "g int, h int, s int, w double, y double, k int")
    df = df.withColumn("gs", F.struct("s", F.col("g").cast("string").alias("t")))
    flat, how = effects.demean(df.drop("g").withColumnRenamed("gs", "g").filter("k >= 0"), ["y"], ["g", "h", "s"], "w")
    key = g * 10 + s
    d = np.hstack([(key[:, None] == np.unique(key)).astype(float), np.eye(30)[h], np.eye(4)[s]])
    q = np.sqrt(w)[:, None]
    want = y - d @ np.linalg.lstsq(d * q, y * q[:, 0], rcond=None)[0]
    assert how["converged"] and np.allclose([r["y"] for r in flat.orderBy("k").collect()], want, atol=1e-6)
    one, how = effects.demean(df, ["y"], ["g"], "w")
    assert how["rounds"] == 0 and one.count() == n and abs(one.filter("g = 1").agg(F.sum(F.col("w") * F.col("y"))).first()[0]) < 1e-9


def test_empty_and_constant(spark):
    df = spark.createDataFrame([(1, 2, 5.0), (1, 3, 5.0), (2, 2, 5.0)], "g int, h int, y double")
    flat, how = effects.demean(df, ["y"], ["g", "h"])
    assert how["converged"] and all(abs(r["y"]) < 1e-9 for r in flat.collect())
    assert effects.demean(df.limit(0), ["y"], ["g", "h"])[0].count() == 0


# ---- models ----


@pytest.fixture(scope="module")
def visits(spark):
    """Two effects, two clusters, a pair of exposures with their product, a covariate, and outcomes of three families."""
    rng = np.random.default_rng(20)
    n = 700
    f, c, d = rng.integers(0, 8, n), rng.integers(0, 5, n), rng.integers(0, 30, n)
    a, b, z = (rng.random(n) < 0.4).astype(float), (rng.random(n) < 0.3).astype(float), rng.normal(size=n)
    eta = 0.3 + 0.2 * a - 0.1 * b + 0.3 * a * b + 0.2 * z + 0.1 * f - 0.1 * c
    out = {"poisson_log": rng.poisson(np.exp(eta)), "binomial_logit": (rng.random(n) < 1 / (1 + np.exp(-eta))), "gamma_log": rng.gamma(3, np.exp(eta) / 3)}
    out = {k: v.astype(float) for k, v in out.items()}
    rows = [tuple(float(x) for x in r) for r in zip(f, c, d, a, b, a * b, z, *out.values(), strict=True)]
    df = spark.createDataFrame(rows, "f double, c double, d double, a double, b double, ab double, z double, poisson_log double, binomial_logit double, gamma_log double")
    return df.withColumns({k: F.col(k).cast("int") for k in "fcd"}).repartition(3).persist(), f, c, d, np.column_stack([a, b, a * b, z]), out


def by_dummies(x, y, f, c, kind):
    """Newton's steps with every level as a column."""
    full = np.hstack([x, np.eye(8)[f], np.eye(5)[c][:, 1 : c.max() + 1]])
    beta = np.linalg.lstsq(full, np.full(len(y), np.log(y.mean()) if kind != "binomial_logit" else 0.0), rcond=None)[0]
    for _ in range(60):
        e = full @ beta
        mu = 1 / (1 + np.exp(-e)) if kind == "binomial_logit" else np.exp(e)
        w = {"binomial_logit": mu * (1 - mu), "poisson_log": mu, "gamma_log": np.ones(len(y))}[kind]
        slope = mu if kind != "binomial_logit" else w
        beta = np.linalg.solve((full * w[:, None]).T @ full, full.T @ (w * (e + (y - mu) / slope)))
    return full, beta, mu, w


@pytest.mark.parametrize("kind", ["poisson_log", "binomial_logit", "gamma_log"])
def test_glm_errors_and_marginal_contrasts_equal_dummies(visits, kind):
    df, f, c, d, x, out = visits
    y, n = out[kind], len(x)
    both = kind == "binomial_logit"  # the others with one effect, which needs no rounds
    full, beta, mu, w = by_dummies(x, y, f, c if both else np.zeros(n, int), kind)
    model = glm.glm(df, kind, ["a", "b", "ab", "z"], ["f", "c"] if both else ["f"], kind, ["d", "f"])
    assert model.converged and np.allclose(model.fit.beta, beta[:4], atol=1e-5)
    other = full[:, 4:]
    flat = x - other @ np.linalg.solve((other * w[:, None]).T @ other, (other * w[:, None]).T @ x)
    s = flat * ((y - mu) / (mu if kind == "gamma_log" else 1))[:, None]
    bread, meat = np.linalg.inv((flat * w[:, None]).T @ flat), 0
    for sign, keys in ((1, d), (1, f), (-1, d * 100 + f)):
        sums = np.array([s[keys == k].sum(axis=0) for k in np.unique(keys)])
        g = len(sums)
        meat = meat + sign * g / (g - 1) * (n - 1) / (n - 4) * sums.T @ sums
    covariance = bread @ meat @ bread
    assert np.allclose(model.fit.covariance, covariance, rtol=2e-3, atol=1e-8)
    spread = {"poisson_log": mu, "binomial_logit": mu * (1 - mu), "gamma_log": mu**2}[kind]
    assert np.isclose(model.dispersion, ((y - mu) ** 2 / spread).sum() / (n - 4 - 8 - (4 if both else 0)), rtol=1e-4)
    got, eta = glm.marginal_contrast(model, "a", "b", "ab"), full @ beta
    estimate, gradient = 0.0, np.zeros(4)
    for p, q, sign in ((1, 1, 1), (1, 0, -1), (0, 1, -1), (0, 0, 1)):
        e = eta + (np.array([p, q, p * q]) - x[:, :3]) @ beta[:3]
        m = 1 / (1 + np.exp(-e)) if kind == "binomial_logit" else np.exp(e)
        slope = m * (1 - m) if kind == "binomial_logit" else m
        assert np.isclose(got[f"mean_{p}{q}"], m.mean(), rtol=1e-5)
        estimate += sign * m.mean()
        gradient += sign * np.array([p * slope.mean(), q * slope.mean(), p * q * slope.mean(), (slope * x[:, 3]).mean()])
    assert np.isclose(got["estimate"], estimate, rtol=1e-3, atol=1e-6) and np.isclose(got["se"], np.sqrt(max(gradient @ covariance @ gradient, 0)), rtol=5e-3)  # two-way errors of few clusters may be negative


def test_models_that_cannot_be_fitted_are_rows(visits):
    df, *_ = visits
    one = df.withColumn("never", F.lit(0.0))
    rows = {r["outcome"]: r for r in glm.pair_models(one, {"never": ("binomial_logit", None), "poisson_log": ("poisson_log", "z > 99")}, "a", "b", "ab", ["z"], ["f"], ["d"]).collect()}
    assert all(r["note"] and r["contrast"] is None for r in rows.values())
    with pytest.raises(ValueError, match="no family"):
        glm.glm(df, "z", ["a"], [], "normal")


def test_predictions_and_status_by_definition(spark, visits):
    df, f, c, d, x, out = visits
    y, n = out["gamma_log"], len(x)
    a, b, z = x[:, 0], x[:, 1], x[:, 3]
    w = np.column_stack([a * b, a * (1 - b), (1 - a) * b, (1 - a) * (1 - b)])
    own = df.select("f", "c", "d", "z", F.col("gamma_log").alias("y"), *[e.alias(k) for k, e in (("p", F.col("ab")), ("q", F.col("a") - F.col("ab")), ("r", F.col("b") - F.col("ab")), ("s", 1 - F.col("a") - F.col("b") + F.col("ab")))])
    support = spark.createDataFrame([("p", True, False), ("q", True, True), ("r", False, False), ("s", True, False)], "cell string, passed boolean, limited boolean")
    did = {"p": 1.0, "q": -1.0, "r": -1.0, "s": 1.0}
    table, fits = cells.directional_models(own, "y", ["p", "q", "r", "s"], ["z"], {"U0": [], "M2": ["f"], "M3": ["f", "d"]}, ["d", "f"], {"did": did, "level": {"p": 1.0}, "pq": {"p": 1.0, "q": -1.0}}, support)
    got = {(r["model_id"], r["kind"], r["name"]): r for r in table.collect()}
    assert len(got) == 2 * 4 + 3 * 3
    full = np.hstack([w[:, :3], z[:, None], np.eye(8)[f]])  # s is the reference
    beta = np.linalg.lstsq(full, y, rcond=None)[0]
    own_beta = np.append(beta[:3], 0.0)
    for k, name in enumerate("pqrs"):
        assert np.isclose(got["U0", "prediction", name]["estimate"], y[w[:, k] == 1].mean())
        assert np.isclose(got["M2", "prediction", name]["estimate"], y.mean() + own_beta[k] - w.mean(axis=0) @ own_beta)
        assert got["M2", "prediction", name]["identified"]
    assert [got["M2", "prediction", k]["status"] for k in "pqrs"] == ["PASS", "LIMITED_SUPPORT", "NON_ESTIMABLE_SUPPORT", "PASS"]
    assert got["M2", "contrast", "level"]["status"] == "NON_ESTIMABLE_IDENTIFICATION" and got["U0", "contrast", "level"]["status"] == "PASS"
    assert got["M3", "contrast", "did"]["status"] == "NON_ESTIMABLE_SUPPORT" and got["M2", "contrast", "pq"]["status"] == "LIMITED_SUPPORT"
    third = np.hstack([w[:, :3], z[:, None], np.eye(8)[f], np.eye(30)[d][:, 1:]])
    assert np.isclose(got["M3", "contrast", "did"]["estimate"], np.linalg.lstsq(third, y, rcond=None)[0][:3] @ [1, -1, -1], atol=1e-6)
    # errors of a saturated mean, by clusters
    e = np.where(w[:, 0] == 1, y - y[w[:, 0] == 1].mean(), 0.0) / w[:, 0].sum()
    v = 0.0
    for sign, keys in ((1, d), (1, f), (-1, d * 100 + f)):
        sums = np.array([e[keys == k].sum() for k in np.unique(keys)])
        v += sign * len(sums) / (len(sums) - 1) * (n - 1) / (n - 4) * (sums**2).sum()
    assert np.isclose(got["U0", "prediction", "p"]["se"], np.sqrt(v))
    # all contrasts of a draw have the same signs
    boot = {r["contrast"]: r for r in cells.bootstrap_contrasts(fits["M2"], "f", {"did": did, "twice": {k: 2 * v for k, v in did.items()}, "level": {"p": 1.0}}, 300, 9).collect()}
    assert set(boot) == {"did", "twice"} and np.isclose(boot["twice"]["sd"], 2 * boot["did"]["sd"]) and boot["twice"]["p"] == boot["did"]["p"]


def test_signs_in_tasks_equal_one_matrix(spark):
    rng = np.random.default_rng(2)
    s = rng.normal(size=(40, 2))
    df = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(s)], "g int, s0 double, s1 double").repartition(6)
    got = {r["contrast"]: r for r in cells.score_bootstrap(df, "g", ["u", "v"], [0.5, 9.0], 600, 4).collect()}
    delta = np.column_stack([cells.signs_of(4, str(k), 600) for k in range(40)]) @ s
    for j, (name, e) in enumerate((("u", 0.5), ("v", 9.0))):
        r = got[name]
        assert r["draws"] == 600 and np.isclose(r["sd"], delta[:, j].std(ddof=1)) and np.isclose(r["ci_low"], e - np.quantile(delta[:, j], 0.975))
        assert np.isclose(r["p"], (1 + (np.abs(delta[:, j]) >= e).sum()) / 601)
    assert abs(delta.mean()) < 0.5 and len({tuple(cells.signs_of(4, str(k), 600)) for k in range(40)}) == 40


def test_vectors_are_pooled_like_their_contrasts():
    rng = np.random.default_rng(3)
    fits = [(rng.normal(size=3), np.cov(rng.normal(size=(3, 9))), 40) for _ in range(6)]
    w = np.array([1.0, -2.0, 0.5])
    got, e, v = cells.pooled_contrast(w, fits), [w @ b for b, _, _ in fits], [w @ c @ w for _, c, _ in fits]
    total = np.mean(v) + 7 / 6 * np.var(e, ddof=1)
    assert np.isclose(got["estimate"], np.mean(e)) and np.isclose(got["se"] ** 2, total) and got["df"] <= 40
    one = cells.pooled_contrast(w, fits[:1])
    assert one["df"] == 40 and np.isclose(one["se"] ** 2, v[0])


@pytest.mark.parametrize("effects_", [["f"], ["f", "c"]])
def test_downdated_refits_equal_full_refits(visits, effects_):
    df, *_ = visits
    outcomes, x, k = ["poisson_log", "gamma_log"][: 3 - len(effects_)], ["a", "b", "ab", "z"], 3 - len(effects_)
    named = models.influential(df, outcomes, x, "ab", effects_, "f", k).collect()
    assert sorted((r["outcome"], r["rank"]) for r in named) == [(y, j + 1) for y in sorted(outcomes) for j in range(k)]
    got = models.without_influential(df, outcomes, x, "ab", effects_, "f", k).collect()
    assert {r["left_out"] for r in got} == {None} | {r["f"] for r in named}
    for r in got:
        own = df if r["left_out"] is None else df.filter(F.col("f") != r["left_out"])
        fit, _ = models.fixed_effects(own, r["outcome"], x, effects_, [])
        assert np.isclose(r["estimate"], fit.beta[fit.names.index("ab")], atol=1e-7)


def test_covariance_by_other_steps(visits):
    df, *_ = visits
    flat, _ = effects.demean(df.withColumn("f2", F.col("f")), ["gamma_log", "a", "b", "ab", "z"], ["f2"])
    fit = models.ols(flat, "gamma_log", ["a", "b", "ab", "z"], ["d", "f"])
    good = sensitivity.recomputed_covariance(flat, "gamma_log", fit.names, ["d", "f"], fit.covariance)
    assert good.count() == 10 and good.filter("NOT passed").isEmpty()
    wrong = fit.covariance.copy()
    wrong[1, 1] *= 1.01
    assert [(r["row"], r["column"]) for r in sensitivity.recomputed_covariance(flat, "gamma_log", fit.names, ["d", "f"], wrong).filter("NOT passed").collect()] == [("b", "b")]


def test_what_cells_do_not_identify_stays_so_over_many_rows():
    """Four weights that sum to 1 less their means span three directions; the rounding of long sums is no fourth one."""
    share, n = np.array([0.1, 0.4, 0.1, 0.4]), 900_000
    xx = n * (np.diag(share) - np.outer(share, share))
    rounded = xx + 1e-12 * n * np.ones((4, 4))  # below n epsilon, which sums of n terms may be off by
    _, projector, rank = cells.pseudo_inverse(rounded, n)
    assert rank == 3 and np.allclose(projector, np.eye(4) - 0.25, atol=1e-9)


def test_a_small_column_is_no_rounding_of_a_large_one():
    x = np.column_stack([np.array([1e9, 2e9, 4e9, 3e9]), np.array([1e-3, 0.0, 2e-3, 1e-3]), np.zeros(4)])
    bread, projector, rank = cells.pseudo_inverse(x.T @ x, 1_000_000)
    assert rank == 2 and np.allclose(projector, np.diag([1.0, 1.0, 0.0])) and np.allclose(x @ bread @ x.T, x @ np.linalg.pinv(x))


def test_rows_that_are_alike_are_fitted_as_one(spark):
    rows = [(i % 2, float(i % 3), i % 4, i % 5, float(i * i % 17)) for i in range(120)]
    df = spark.createDataFrame(rows, "s int, a double, f int, g int, y double")
    summed = models.alike(df, "y", ["s", "a", "f", "g"])
    assert summed.count() < 120 and summed.agg(F.sum("_n")).first()[0] == 120
    whole, short = ({r["s"]: r for r in models.grouped_fits(d, "s", "y", ["a"], ["f"], ["g"], weight=w).collect()} for d, w in ((df, None), (summed, "_n")))
    full = models.fixed_effects(df.filter("s = 1"), "y", ["a"], ["f"], ["g"])[0].rows()[0]
    for fits in (whole, short):
        assert fits[1]["n"] == full[8] and np.allclose([fits[1]["estimate"], fits[1]["se"]], full[1:3])


def test_specifications_and_draws_share_their_fits(spark, monkeypatch):
    df = spark.createDataFrame([(i % 9, float(i % 2), float(i % 3 == 0), i % 5, float(i * i % 17), 0.1 * (i % 9)) for i in range(180)], "u long, a double, b double, f int, y double, p double")
    calls = []
    for module, name in ((models, "grouped_fits"), (cells, "fit_groups")):
        monkeypatch.setattr(module, name, lambda *a, f=getattr(module, name), n=name, **k: (calls.append(n), f(*a, **k))[1])
    out = {(r["spec"], r["outcome"]): r for r in sensitivity.swept(df, {"one": {"x": ["a"]}, "two": {"x": ["b"], "where": F.col("f") > 0}, "none": {"x": ["a"], "where": F.col("f") > 9}}, "y", ["f"], ["u"]).collect()}
    assert calls == ["grouped_fits"] and out["one", "y"]["term"] == "a" and out["two", "y"]["term"] == "b" and out["none", "y"]["note"] == "no row"
    calls.clear()
    sensitivity.measured_cells(df.withColumn("q", 1 - F.col("p")), "u", {"main": {"x": "p", "z": "q"}}, {"b": F.col("b"), "o": 1 - F.col("b")}, "y", [], {"U0": []}, ["u"], {"did": {"x_b": 1.0, "x_o": -1.0, "z_b": -1.0, "z_o": 1.0}}, 7, 1, [0.6]).collect()
    assert calls == ["fit_groups"] * 2  # the two specifications, the seven draws


@pytest.mark.parametrize("effects_", [[], ["f"]])
def test_glms_read_rows_once_and_sum_those_alike(spark, effects_):
    read = spark.sparkContext.accumulator(0)

    def passed(key):
        read.add(1)
        return True

    rows = [(i % 2, i // 2 % 2, i % 4 // 3, i % 5, i % 7, float(i * i % 11 % 4), float(i * i % 11 > 4), 0.1 + i * i % 13) for i in range(560)]
    df = spark.createDataFrame(rows, "a int, b int, ab int, f int, d int, days double, late double, charge double")
    outcomes = {"days": ("poisson_log", None), "late": ("binomial_logit", "days < 3"), "charge": ("gamma_log", "charge > 1")}
    alone = df.withColumn("z", F.rand(1) * 1e-9).withColumns({f"z{k}": F.col("z") for k in range(glm.ALIKE)})  # too many columns to be summed
    got = {r["outcome"]: r for r in glm.pair_models(df.filter(F.udf(passed, "boolean")("a")), outcomes, "a", "b", "ab", [], effects_, ["d", "f"]).collect()}
    assert read.value == len(rows)
    for y, (kind, where) in outcomes.items():
        own = df.filter(where or "true")
        model = glm.glm(own, y, ["a", "b", "ab"], effects_, kind, ["d", "f"])
        whole = glm.fitted(glm.summed(alone.filter(where or "true"), {y: (kind, None)}, ["a", "b", "ab", "d", "f", *[f"z{k}" for k in range(glm.ALIKE)]])[y], y, ["a", "b", "ab"], effects_, kind, ["d", "f"])
        assert model.fitted.count() < model.fit.n == own.count() == whole.fitted.count() == got[y]["n"]
        assert np.allclose(model.fit.beta, whole.fit.beta) and np.allclose(model.fit.covariance, whole.fit.covariance) and np.isclose(model.dispersion, whole.dispersion) and np.isclose(model.deviance, whole.deviance)
        assert np.isclose(got[y]["link_estimate"], whole.fit.beta[-1]) and np.isclose(got[y]["contrast"], glm.marginal_contrast(whole, "a", "b", "ab")["estimate"])
