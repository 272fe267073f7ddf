"""Readers, linkage, names, models and checks against small brute-force versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.operators import cells, describe, glm, inference, link, metrics, models, nameprob, reconcile, reshape
from wardline.plans import layouts, sensitivity
from wardline.sources import manifest, readers


def test_csv_pads_short_rows_and_refuses_long_ones(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('a,b,c\n1,2,3\n4,5\n"x,y",6,7\n')
    names = readers.header_of(spark, str(path))
    assert names == ["a", "b", "c"] and readers.classify_layout(names, {"one": (3, ["a"]), "two": (4, ["a"])}) == "one"
    assert sorted(map(tuple, readers.read_csv(spark, str(path), names).collect()), key=str) == sorted([("1", "2", "3"), ("4", "5", None), ("x,y", "6", "7")], key=str)
    path.write_text("a,b,c\n1,2,3\n4,5,6,7\n")
    assert readers.read_csv(spark, str(path), names, tolerant=True).count() == 1
    with pytest.raises(Exception, match="more fields"):
        readers.read_csv(spark, str(path), names).collect()
    with pytest.raises(ValueError, match="no layout"):
        readers.classify_layout(["a"], {"one": (3, ["a"])})


def test_other_readers(spark, tmp_path):
    (tmp_path / "p1.txt").write_text("a|b\n1|2\n")
    (tmp_path / "p2.txt").write_text("a|c\n3|4\n")
    rows = readers.read_piped(spark, [str(tmp_path / "p1.txt"), str(tmp_path / "p2.txt")]).orderBy("a").collect()
    assert [(r["a"], r["b"], r["c"], r["source_file"]) for r in rows] == [("1", "2", None, "p1.txt"), ("3", None, "4", "p2.txt")]
    (tmp_path / "j.json").write_text('[["NAME","state"],["Alachua","12"],["Baker","12"]]')
    assert [tuple(r) for r in readers.read_rows_of_arrays(spark, str(tmp_path / "j.json")).collect()] == [("Alachua", "12"), ("Baker", "12")]
    (tmp_path / "n.csv").write_text("Ann,F,10\n")
    assert readers.read_counts(spark, str(tmp_path / "n.csv"), "name string, sex string, n int").first()["n"] == 10
    found = readers.fingerprints(spark, str(tmp_path))
    recorded = found.withColumn("sha256", F.when(F.col("file") == "n.csv", "other").otherwise(F.col("sha256"))).filter("file <> 'j.json'").unionByName(spark.createDataFrame([("gone", 1, "x")], "file string, bytes long, sha256 string"))
    assert {r["file"]: r["status"] for r in reconcile.fingerprints_match(found, recorded).collect()} == {"n.csv": "changed", "j.json": "new", "p1.txt": "same", "p2.txt": "same", "gone": "missing"}


def test_incremental_build(spark, tmp_path):
    path, by = str(tmp_path / "t"), ["visit_year", "visit_quarter"]
    source = spark.createDataFrame([(2010, 1, 5.0), (2010, 2, 6.0), (2010, 2, 7.0)], "visit_year int, visit_quarter int, x double")
    required = source.select(*by).distinct().withColumn("fingerprint", F.lit("a"))
    none = manifest.manifest(source.limit(0), by, {}, F.lit(True), "a")
    todo = manifest.build_missing(spark, required, none, by, lambda p: source.join(p.select(*by), by), path)
    assert todo.count() == 2 and readers.read_partitions(spark, path, visit_year=2010, visit_quarter=2).count() == 2
    done = manifest.manifest(readers.read_partitions(spark, path), by, {"total": F.sum("x")}, F.col("total") > 5.5, "a")
    assert [tuple(r)[:2] for r in manifest.missing_partitions(required, done, by).collect()] == [(2010, 1)]
    assert manifest.missing_partitions(required.withColumn("fingerprint", F.lit("b")), done, by).count() == 2
    assert manifest.fan_out(source.withColumn("k", F.monotonically_increasing_id()), str(tmp_path / "f"), {"core": ["x"], "period": by}, ["k"]) == {"core": 3, "period": 3}


def test_layouts_to_one_table(spark):
    a = spark.createDataFrame([("r1", "2008", "1", "40", "1", "4", "4280", "", "LIC1", "F1", "10", "2", "6", "7")], ", ".join(f"{c} string" for c in layouts.LAYOUTS["schema_1"] if c))
    b = spark.createDataFrame([("r2", "2016", "1", "40", "M", "5", "E2", "I219", None, "N2", "F2", "10", "5", "18", "3")], ", ".join(f"{c} string" for c in layouts.LAYOUTS["schema_3"] if c))
    frames = {"schema_1": a, "schema_3": b}
    rows = layouts.united(frames)
    providers = spark.createDataFrame([("N1", "LIC1", "Individual", "MD"), ("N2", "LIC2", "Organization", "MD")], "synthetic_provider_id string, synthetic_license_id string, entity_type string, clinician_type string")
    out = layouts.enriched(rows, providers, spark.createDataFrame([("F1", "rural")], "synthetic_facility_id string, rurality string"))
    got = {r["record"]: r for r in out.collect()}
    assert (got["r1"]["resolved_provider"], got["r1"]["physician_flag"], got["r1"]["los_hours_any"], got["r1"]["off_hours"], got["r1"]["weekend"], got["r1"]["rurality"], got["r1"]["procedure"]) == ("N1", True, 48.0, True, True, "rural", None)
    assert (got["r2"]["physician_flag"], got["r2"]["code_system"], got["r2"]["off_hours"]) == (False, "ICD-10-CM", False)
    assert all(r["passed"] for r in layouts.reconciliation(frames, rows).collect())
    q = layouts.quality(out).first()
    assert (q["rows"], q["unresolved_providers"], q["organisation_physicians"], q["repeated_ids"]) == (2, 0, 0, 0)


def test_latest_known_value_and_mode(spark):
    df = spark.createDataFrame([(1, "b", 1, "x"), (1, "a", 2, None), (1, "a", 3, None), (1, "b", 0, "w"), (2, None, 1, None)], "k int, v string, d int, s string")
    got = {r["k"]: r for r in metrics.collapse(df, "k", modes=["v"], lists=["v"], latest={"s": "d"}).collect()}
    assert (got[1]["v_mode"], got[1]["v_list"], got[1]["s_latest"]) == ("a", "a | b", "x")
    assert (got[2]["v_list"], got[2]["s_latest"]) == (None, None)


def test_range_join_by_prefix(spark):
    ranges = spark.createDataFrame([("A10", "A19", 1), ("B00", "B05", 2)], "lo string, hi string, g int")
    codes = spark.createDataFrame([("A15",), ("B05",), ("B06",), ("C00",)], "c string")
    assert sorted((r["c"], r["g"]) for r in link.range_join(codes, ranges, F.col("c"), "lo", "hi", 1).collect()) == [("A15", 1), ("B05", 2)]
    with pytest.raises(ValueError, match="crosses"):
        link.range_join(codes, ranges.unionByName(spark.createDataFrame([("A0", "B9", 3)], "lo string, hi string, g int")), F.col("c"), "lo", "hi", 1)


def test_name_cascade(spark):
    parts = nameprob.name_parts(spark.createDataFrame([(1, "O'Neil Jr", "Mary-Ann"), (2, "SMITHSR", None)], "id int, l string, f string"), "id", {"last": "l", "first": "f"})
    got = {(r["id"], r["name_type"], r["priority"]): r["candidate"] for r in nameprob.candidates(parts, "id").collect()}
    assert [got.get((1, "last", k)) for k in range(1, 7)] == ["O'NEIL JR", "ONEIL JR", "ONEILJR", "ONEIL", "O'NEIL", "JR"]
    assert got[2, "last", 4] == "SMITH" and got[1, "first", 5] == "MARY" and got[1, "first", 6] == "ANN" and (1, "first", 4) not in got
    bad = nameprob.dictionary({"last": spark.createDataFrame([("A", 1.5, 0.1, 0.0, 0.0, 0.0), ("A", 0.2, 0.1, 0.0, 0.0, 0.0)], "name string, white double, black double, hispanic double, asian double, other double")})
    assert nameprob.out_of_bounds(bad).first()["bad"] == 1 and bad.count() == 1
    census = spark.createDataFrame([("X", "(S)", "12.5")], "name string, a string, b string")
    assert tuple(nameprob.surname_model(census, {"white": "a", "black": "b"}).first()) == ("X", None, 0.125)


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(12)
    n = 600
    g, h = rng.integers(0, 12, n), rng.integers(0, 9, n)
    a = rng.normal(size=n) + 0.1 * g
    b = (rng.random(n) < 0.4).astype(float)
    y = 1.5 * a - 0.7 * b + 0.3 * g - 0.2 * h + rng.normal(size=n) * 0.5
    rows = [(int(p), int(q), float(r), float(s), float(t)) for p, q, r, s, t in zip(g, h, a, b, y, strict=True)]
    return spark.createDataFrame(rows, "g int, h int, a double, b double, y double").persist(), (g, h, a, b, y)


def crv(x, e, groups, extra=0):
    bread = np.linalg.inv(x.T @ x)
    meat = sum(np.outer(s, s) for s in (x[groups == k].T @ e[groups == k] for k in np.unique(groups)))
    m, n, k = len(np.unique(groups)), len(x), x.shape[1]
    return m / (m - 1) * (n - 1) / (n - k) * bread @ meat @ bread


def test_two_effects_equal_dummies(panel):
    df, (g, h, a, b, y) = panel
    fit, how = models.fixed_effects(df, "y", ["a", "b"], ["g", "h"], ["g", "h"])
    dummies = np.hstack([np.eye(12)[g], np.eye(9)[h][:, 1:]])
    x = np.column_stack([a, b])
    beta = np.linalg.lstsq(np.hstack([x, dummies]), y, rcond=None)[0][:2]
    assert how["converged"] and np.allclose(fit.beta, beta, atol=1e-7)
    flat = x - dummies @ np.linalg.lstsq(dummies, x, rcond=None)[0]
    e = (y - dummies @ np.linalg.lstsq(dummies, y, rcond=None)[0]) - flat @ beta
    both = crv(flat, e, g) + crv(flat, e, h) - crv(flat, e, g * 100 + h)
    assert np.allclose(fit.covariance, both, rtol=1e-5) and fit.df == 8


def test_collinear_columns_drop(panel):
    df, (g, h, a, b, y) = panel
    fit = models.ols(df.withColumn("one", F.lit(1.0)).withColumn("a2", 2 * F.col("a")), "y", ["one", "a", "a2", "b"])
    assert fit.dropped == ["a2"]
    x = np.column_stack([np.ones(len(a)), a, b])
    beta, sse = np.linalg.lstsq(x, y, rcond=None)[:2]
    assert np.allclose(fit.beta, beta) and np.allclose(np.diag(fit.covariance), np.diag(np.linalg.inv(x.T @ x)) * sse[0] / (len(y) - 3))


def test_t_distribution():
    assert abs(models.t_two_sided(2.0, 10) - 0.07338803) < 1e-7 and abs(models.t_quantile(0.975, 10) - 2.22813885) < 1e-6 and abs(models.t_quantile(0.975, 1e6) - 1.959966) < 1e-5


def test_normal_p(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (-1.959963985,), (5.0,)], "z double")
    got = [r[0] for r in df.select(describe.two_sided_p(F.col("z"))).collect()]
    assert np.allclose(got, [1, 0.31731051, 0.05, 5.7330314e-7], rtol=3e-7)


def test_singletons(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (3, 9), (1, 1)], "g int, h int")
    assert sorted(map(tuple, models.drop_singletons(df, ["g", "h"]).collect())) == [(1, 1), (1, 1)]


@pytest.mark.parametrize("kind", ["poisson_log", "binomial_logit", "gamma_log"])
def test_glm_equals_dummies(spark, kind):
    rng = np.random.default_rng(4)
    n = 500
    g, x = rng.integers(0, 5, n), rng.normal(size=n)
    eta = 0.3 * x + 0.2 * g - 0.5
    y = {"poisson_log": rng.poisson(np.exp(eta)), "binomial_logit": (rng.random(n) < 1 / (1 + np.exp(-eta))), "gamma_log": rng.gamma(2, np.exp(eta) / 2)}[kind].astype(float)
    df = spark.createDataFrame([(int(a), float(b), float(c)) for a, b, c in zip(g, x, y, strict=True)], "g int, x double, y double")
    model = glm.glm(df, "y", ["x"], ["g"], kind, ["g"])
    d, beta = np.column_stack([x, np.eye(5)[g]]), np.zeros(6)
    for _ in range(50):
        e = d @ beta
        mu = 1 / (1 + np.exp(-e)) if kind == "binomial_logit" else np.exp(e)
        w = mu * (1 - mu) if kind == "binomial_logit" else mu if kind == "poisson_log" else np.ones(n)
        z = e + (y - mu) / (w if kind != "gamma_log" else mu)
        beta = np.linalg.solve((d * w[:, None]).T @ d, d.T @ (w * z))
    assert model.converged and abs(model.fit.beta[0] - beta[0]) < 2e-5


def test_bootstrap_and_influence(spark, panel):
    df, _ = panel
    flat, _ = models.demean(df, ["y", "a", "b"], ["h"])
    fit = models.ols(flat, "y", ["a", "b"], ["g"])
    s = models.influence_scores(flat, fit, "y", "a", "g")
    total = s.agg(F.sum(F.col("score") * F.col("score"))).first()[0]
    n, k, m = fit.n, 2, fit.clusters["g"]
    assert np.isclose(total * m / (m - 1) * (n - 1) / (n - k), fit.covariance[0, 0], rtol=1e-6)
    w = cells.score_bootstrap(s.withColumnRenamed("score", "s0"), "g", ["a"], [float(fit.beta[0])], 400, 3).first()
    assert w["draws"] == 400 and np.isclose(w["sd"], total**0.5, rtol=0.2) and w["p"] < 0.05
    assert models.influence(s, "g", "score", 3).count() == 3


def test_cells_identify_contrasts_only(panel):
    df, (g, h, a, b, y) = panel
    one = df.withColumns(reshape.cell_basis(({"x": F.col("b"), "z": 1 - F.col("b")}, {"p": (F.col("h") > 4).cast("double"), "q": (F.col("h") <= 4).cast("double")})))
    got = {r["contrast"]: r for r in cells.cell_model(one, "y", ["x_p", "x_q", "z_p", "z_q"], ["a"], ["g"], ["g", "h"], {"did": {"x_p": 1, "x_q": -1, "z_p": -1, "z_q": 1}, "level": {"x_p": 1}}).collect()}
    d = np.column_stack([b * (h > 4), b * (h <= 4), (1 - b) * (h > 4), a, np.eye(12)[g]])
    beta = np.linalg.lstsq(d, y, rcond=None)[0]
    assert got["did"]["identified"] and abs(got["did"]["estimate"] - (beta[0] - beta[1] - beta[2])) < 1e-6
    assert not got["level"]["identified"] and got["level"]["estimate"] is None


def test_sweeps(spark, panel):
    df, _ = panel
    rows = sensitivity.swept(df, {"all": {"x": ["a", "b"]}, "none": {"x": ["a"], "where": F.col("g") > 99}}, "y", ["h"], ["g"]).collect()
    assert {r["spec"] for r in rows} == {"all", "none"} and all(r["note"] for r in rows if r["spec"] == "none")
    shift = sensitivity.without_each(df, "g", [1, 2], "y", ["a"], ["h"], ["h"]).filter("estimate is not null").collect()
    assert len(shift) == 2 and all(abs(r["estimate"] - r["full"] - r["shift"]) < 1e-12 for r in shift)
    m, x = sensitivity.modified(df, ["b"], "h", [0, 1, 2], 0)
    assert x == ["b", "m_1", "m_2", "b_m_1", "b_m_2"] and m.agg(F.sum("b_m_1")).first()[0] == df.filter("h = 1").agg(F.sum("b")).first()[0]


def test_draws_are_shares(spark):
    df = spark.range(4000).select(F.col("id").alias("u"), F.lit(0.2).alias("a"), F.lit(0.5).alias("b"), F.lit(0.3).alias("c"))
    got = {r["value"]: r["count"] for r in inference.categorical_draws(df, "u", ["a", "b", "c"], 1, 5).groupBy("value").count().collect()}
    assert abs(got["a"] / 4000 - 0.2) < 0.03 and abs(got["b"] / 4000 - 0.5) < 0.03
    assert abs(inference.whole_cluster_sample(df, "u", 0.25, 1).count() / 4000 - 0.25) < 0.03


def test_multiplicity_recomputed(spark):
    df = spark.createDataFrame([("x", k, p) for k, p in enumerate([0.01, 0.03, 0.04, 0.5])] + [("x", 9, None)], "f string, k int, p double")
    a = inference.adjust(df, ["f"], "p", ["k"])
    assert [round(r["bh"], 4) for r in a.filter("p is not null").orderBy("k").collect()] == [0.04, 0.0533, 0.0533, 0.5]
    assert all(r["passed"] for m in ("bh", "holm") for r in sensitivity.readjusted(a, ["f"], "p", ["k"], m, m).collect())


def test_checks(spark):
    df = spark.createDataFrame([(1, "a", 0.5), (2, "b", None), (2, "z", 2.0)], "k int, v string, p double")
    assert {r["check"]: r["passed"] for r in reconcile.vocabulary(df, {"v": ["a", "b"]}).collect()} == {"v_vocabulary": False}
    assert reconcile.key_unique(df, ["k"]).first()["observed"] == 1 and reconcile.repeated_keys(df, ["k"]).count() == 1
    assert not reconcile.all_null(df, ["p"]).first()["passed"]
    grid = reconcile.grid_complete(df, spark.createDataFrame([(1,), (2,), (3,)], "k int"), ["k"]).collect()
    assert {r["check"]: r["observed"] for r in grid} == {"missing": 1.0, "unexpected": 0.0, "repeated": 1.0}
    res = spark.createDataFrame([(1.0, 0.5, 0.0, 2.0, 0.05), (3.0, -1.0, 0.0, 2.0, 1.2)], "e double, s double, l double, h double, p double")
    assert {r["check"]: r["observed"] for r in reconcile.sane_results(res, "e", "s", "l", "h", "p").collect()} == {"estimate_finite": 0.0, "se_not_negative": 1.0, "interval_holds_estimate": 1.0, "p_in_0_1": 1.0}
    assert reconcile.sums_match(res, res, ["e"]).first()["passed"]
    assert link.disagreements(df, df.withColumn("v", F.lit("a")).filter("k = 1"), ["k"], ["v", "p"]).filter("disagreements > 0").count() == 0
    assert link.absent(df, df.filter("k = 1"), ["k"]).count() == 2


def test_hot_keys_are_numbered_by_ranges(spark, monkeypatch):
    rows = [(None if k % 3 == 0 else k % 50, (k * 7919) % 1009, k) for k in range(1000)]
    df = spark.createDataFrame(rows, "key long, o long, id long")
    want = sorted(metrics.duplicates(df, "key", [F.col("o"), F.col("id")]).collect(), key=str)
    monkeypatch.setattr(metrics, "NUMBERED_ROWS", 100)
    assert sorted(metrics.duplicates(df, "key", [F.col("o"), F.col("id")]).collect(), key=str) == want


def test_exact_quantiles(spark, monkeypatch):
    from wardline.operators import quantiles

    rng = np.random.default_rng(2)
    rows = [(None if g == 0 else g, float(v)) for g in range(4) for v in np.round(rng.lognormal(3, 1, 700), 1)] + [(9, None), (8, 1.5), (7, 1.0), (7, 2.0)] + [(6, 5.0)] * 300
    shares = {"a": 0.0, "b": 0.013, "c": 0.5, "d": 0.9, "e": 0.995, "f": 1.0}
    df = spark.createDataFrame(rows, "g int, v double")
    for slack, held in ((0.0005, 100_000), (0.0005, 0), (0.05, 0)):
        monkeypatch.setattr(quantiles, "SLACK", slack)
        monkeypatch.setattr(quantiles, "HELD_VALUES", held)
        got = {r["g"]: [r[k] for k in shares] for r in quantiles.exact_quantiles(df, ["g"], "v", shares).collect()}
        assert got.pop(9) == [None] * 6
        assert all(np.allclose(x, np.quantile([v for k, v in rows if k == g and v is not None], list(shares.values()))) for g, x in got.items()) and len(got) == 7
    whole = quantiles.exact_quantiles(df, [], "v", {"m": 0.5}).first()["m"]
    assert np.isclose(whole, np.median([v for _, v in rows if v is not None]))


def test_the_name_cascade_runs_on_distinct_names(spark, monkeypatch):
    seen, whole = [], nameprob.candidates
    monkeypatch.setattr(nameprob, "candidates", lambda parts, key: (seen.append(parts.count()), whole(parts, key))[1])
    words = spark.createDataFrame([("A", 0.5, 0.1, 0.2, 0.1, 0.1), ("B", 0.1, 0.5, 0.2, 0.1, 0.1)], "name string, white double, black double, hispanic double, asian double, other double")
    df = spark.createDataFrame([(k, "A" if k % 2 else " b", "A" if k < 9 else "X", None) for k in range(10)], "id int, l string, f string, m string")
    out = {r["id"]: r for r in nameprob.model(df, nameprob.dictionary({"last": words, "first": words}), "id", {"last": "l", "first": "f", "middle": "m"}).collect()}
    assert seen == [4] and len(out) == 10 and out[9]["population_max"] is None and out[0]["last_match"] and not out[0]["middle_match"] and out[0]["last_black"] == 0.5


def test_each_licence_meets_its_best_entry_alone(spark):
    from wardline.plans import cohort

    df = spark.createDataFrame([(k, f"ME{100 + k % 2:06d}") for k in range(6)], "id int, lic string")
    registry = spark.createDataFrame([(n, f"ME{100 + n % 3}", n % 2, 1, n % 5) for n in range(30)], "npi int, registry_licence string, active int, physician int, slot int")
    out = cohort.licence_candidates(df, registry, "lic")
    assert {r["id"]: r["npi"] for r in out.collect()} == {k: 15 if k % 2 == 0 else 25 for k in range(6)}
    lines = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert next(k for k, s in enumerate(lines) if "Join" in s) < next(k for k, s in enumerate(lines) if "Window" in s)


def test_long_keys_and_exact_totals(spark, tmp_path):
    from wardline.plans import registry as library

    spark.createDataFrame([(1_234_567, "n", "b", 1), (12, "n", "b", 1)], "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    assert sorted(r["padded"] for r in library.queries()["text_cleaning"](spark, str(tmp_path)).collect()) == ["000012", "123456"]
    spark.createDataFrame([(k, k % 2 * 1e14 + 0.01, "FP"[k % 2]) for k in range(6)], "o_custkey long, o_totalprice double, o_orderstatus string").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(1, 1.0, "BUILDING", 1)], "c_custkey long, c_acctbal double, c_mktsegment string, c_nationkey int").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(1,)], "n_nationkey int").write.parquet(str(tmp_path / "nation.parquet"))
    total = library.queries()["dimension_checks"](spark, str(tmp_path)).filter("check = 'total'").first()
    assert total["expected"] == total["observed"] == 300000000000000.06 and total["passed"]


def test_the_fact_reads_its_sources_once(spark, sf_dir, monkeypatch):
    from wardline.plans import build_queries

    read, plain_table = spark.sparkContext.accumulator(0), build_queries.table

    def counted(session, sf, name):
        def passed(key):
            read.add(1)
            return True

        df = plain_table(session, sf, name)
        return df.filter(F.udf(passed, "boolean")("l_orderkey")) if name == "lineitem" else df

    n = plain_table(spark, sf_dir, "lineitem").count()
    monkeypatch.setattr(build_queries, "table", counted)
    rows = build_queries._quarter_fact(spark, sf_dir).collect()
    assert rows and 0 < read.value <= n  # orders of another service are left out before
