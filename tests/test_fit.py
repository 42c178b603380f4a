"""Fits recover what generated the data, and agree with closed forms."""

import numpy as np
import pandas as pd
import pytest

from shapecast.functions.families import list_families, resolve
from shapecast.operators import capability, diagnose, predict, regularize, resample, score, select, stats
from shapecast.operators.fit import fit_groups, fit_local, gamlss
from shapecast.sources.models import ModelRegistry, load_model, save_model, validate_model


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(42)
    n = 1500
    x = rng.uniform(0, 1, n)
    pdf = pd.DataFrame({"i": np.arange(n), "x": x, "x2": rng.normal(size=n), "y": 2 + 3 * x + rng.normal(0, 0.5, n), "ga": rng.gamma(4, np.exp(0.5 + x) / 4), "k": rng.poisson(np.exp(0.5 + x)).astype(float), "s": rng.choice(["a", "b", "c"], n), "wave": np.sin(6 * x) + rng.normal(0, 0.3, n), "b": rng.beta(2, 3, n), "z": np.where(rng.random(n) < 0.3, 0, rng.gamma(3, 1, n)), "n5": rng.binomial(5, 0.4, n).astype(float), "five": 5.0})
    return spark.createDataFrame(pdf).persist()


@pytest.fixture(scope="module")
def model(data):
    return gamlss("y ~ x", data)


def test_no_is_least_squares(data, model):
    pdf = data.toPandas()
    b = np.polyfit(pdf.x, pdf.y, 1)
    assert model.coef()["x"] == pytest.approx(b[0], rel=1e-6) and model.coef()["(Intercept)"] == pytest.approx(b[1], rel=1e-6)
    assert np.exp(model.coefficients["sigma"][0]) == pytest.approx((pdf.y - np.polyval(b, pdf.x)).std(ddof=0), rel=1e-5)
    assert model.converged and model.df_fit == 3


@pytest.mark.parametrize("method", ["RS", "CG", "MIXED", "LBFGS"])
def test_methods_agree(data, model, method):
    assert gamlss("y ~ x", data, method=method).deviance == pytest.approx(model.deviance, rel=1e-6)


def test_gamma_and_poisson(data):
    m = gamlss("ga ~ x", data, "GA", sigma_formula="~ x")
    assert m.coefficients["mu"] == pytest.approx([0.5, 1.0], abs=0.12) and np.exp(m.coefficients["sigma"][0]) == pytest.approx(0.5, abs=0.08)
    assert gamlss("k ~ x", data, "PO").coefficients["mu"] == pytest.approx([0.5, 1.0], abs=0.12)


def test_binomial_denominator(data):
    m = gamlss("n5 ~ 1", data.where("n5 > 1"), "BI", fixed={"bd": "five"})
    assert m.converged
    assert 1 / (1 + np.exp(-m.coefficients["mu"][0])) == pytest.approx(data.where("n5 > 1").agg({"n5": "avg"}).first()[0] / 5, abs=1e-6)


@pytest.mark.parametrize(("y", "family"), [("b", "BE"), ("z", "ZAGA"), ("k", "PIG"), ("k", "NBI"), ("ga", "BCCG"), ("ga", "WEI"), ("y", "LO"), ("y", "TF"), ("k", "ZIP")])
def test_families_converge_to_a_maximum(data, y, family):
    m = gamlss(f"{y} ~ x", data, family)
    assert np.isfinite(m.deviance)
    worse = gamlss(f"{y} ~ 1", data, family)
    assert m.deviance <= worse.deviance + 1e-4


@pytest.mark.parametrize("term", ["pb(x)", "ps(x)", "cs(x)", "tps(x)", "s(x, method='REML')"])
def test_smooth_terms_follow_a_curve(data, term):
    m = gamlss(f"wave ~ {term}", data)
    line = gamlss("wave ~ x", data)
    assert m.method == "RS" and m.deviance < line.deviance - 100 and 4 < m.df_fit < 16


def test_df_option_fixes_the_effective_df(data):
    m = gamlss("wave ~ pb(x, df=5)", data)
    assert m.edf["mu"]["pb(x)"] == pytest.approx(7, abs=1.2)


def test_nulls_are_left_out_and_empty_tables_fail(spark, data, model):
    more = data.unionByName(data.limit(5).selectExpr("i", "cast(null as double) x", *[c for c in data.columns if c not in ("i", "x")]))
    assert gamlss("y ~ x", more).deviance == pytest.approx(model.deviance, rel=1e-9)
    with pytest.raises(ValueError):
        gamlss("y ~ x", data.limit(0))
    with pytest.raises(ValueError):
        gamlss("y ~ x", data, "PO", sigma_formula="~ x")


def test_prediction(data, model):
    new = data.sparkSession.createDataFrame([(0.0,), (1.0,)], "x double")
    rows = predict.predict_params(model, new).orderBy("x").collect()
    assert rows[1]["mu"] - rows[0]["mu"] == pytest.approx(model.coef()["x"])
    q = predict.predict_quantiles(model, new, (0.05, 0.5)).first()
    assert q["q50"] > q["q5"]
    with pytest.raises(predict.PredictionSchemaError) as e:
        predict.check_schema(model, new.withColumnRenamed("x", "w"))
    assert e.value.code == "missing_column"
    f = gamlss("y ~ factor(s)", data)
    with pytest.raises(predict.PredictionSchemaError) as e:
        predict.check_schema(f, data.sparkSession.createDataFrame([("q",)], "s string"))
    assert e.value.code == "unseen_level"
    assert predict.centiles(model, "x", [0.1, 0.9]).count() == 2


def test_scores(data, model):
    s = score.scoring_summary(model, data)
    assert s["coverage_0.9"] == pytest.approx(0.9, abs=0.03) and s["log_score"] == pytest.approx(model.deviance / 2 / model.n, rel=1e-6)
    assert s["crps"] == pytest.approx(score.crps(model, data, "gaussian"), rel=0.05)
    assert score.pit_histogram(model, data).agg({"n": "sum"}).first()[0] == 1500


def test_diagnostics(data, model):
    m = diagnose.moments(model)
    assert abs(m["mean"]) < 0.05 and m["variance"] == pytest.approx(1, abs=0.05)
    q = diagnose.qq_data(model).toPandas().sort_values("rank")
    assert q.z.is_monotonic_increasing and np.corrcoef(q.z, q.theoretical)[0, 1] > 0.99
    assert diagnose.q_stats(model, "x").count() == 10
    pdf = data.toPandas().sort_values("i")
    v = pdf.x2 - pdf.x2.mean()
    got = diagnose.acf(data, "x2", "i", 3).orderBy("lag").toPandas().acf
    assert got.tolist() == pytest.approx([(v.values[k:] * v.values[:-k]).sum() / (v**2).sum() for k in (1, 2, 3)], abs=1e-10)
    assert diagnose.cooks_distance(model).agg({"leverage": "sum"}).first()[0] == pytest.approx(2, abs=0.05)
    assert diagnose.centile_check(model).count() == 5


def test_tests_and_selection(data, model):
    null = gamlss("y ~ 1", data)
    assert stats.likelihood_ratio_test(null, model)["p"] < 1e-6
    assert stats.vuong_clarke_test(model, null)["vuong_z"] > 2
    assert sum(stats.gaic_weights(model, null)) == pytest.approx(1)
    assert stats.summary(model)[1]["se"] == pytest.approx(0.5 / np.sqrt(1500 / 12), rel=0.1)
    best, trace = select.step_gaic(null, ["x", "x2"])
    assert [t.label for t in best.designs["mu"].formula.terms][0] == "x" and trace[1]["change"] == "+ x"
    assert select.fit_dist(data, "k", "counts")[0]["criterion"] < np.inf
    assert select.gamlss_cv("y ~ x", data, folds=3)["cv"] == pytest.approx(model.deviance, rel=0.02)


def test_resampling_groups_and_penalties(data):
    assert fit_groups(data, "s", "ga ~ x", "GA").count() == 9
    beta, _, ok = fit_local("EXP", np.array([1.0, 3.0]))
    assert ok and np.exp(beta["mu"][0]) == pytest.approx(2)
    b = resample.nonparametric_bootstrap("y ~ x", data, boots=4)
    assert b["estimates"].shape == (4, 3)
    r = regularize.fit_ridge(data, "y", ["x", "x2"], 1e-9)
    assert r["coef"][0] == pytest.approx(3, abs=0.15)
    assert regularize.fit_lasso(data, "y", ["x", "x2"], 10.0)["coef"].tolist() == [0, 0]
    assert regularize.soft_threshold(np.array([-3.0, 0.5]), 1).tolist() == [-2, 0]
    assert regularize.cross_validate_lambda(data, "y", ["x", "x2"])["lambda"] < 0.1


def test_models_are_stored_and_checked(spark, data, tmp_path):
    m = gamlss("wave ~ pb(x, df=4) + factor(s)", data, sigma_formula="~ x")
    save_model(m, spark, f"file://{tmp_path}/m")
    again = load_model(spark, f"file://{tmp_path}/m")
    a, b = (predict.predict_params(x, data).agg({"mu": "sum"}).first()[0] for x in (m, again))
    assert a == pytest.approx(b) and validate_model(spark, f"file://{tmp_path}/m") == []
    assert validate_model(spark, f"file://{tmp_path}/none")[0]["code"] == "metadata"
    reg = ModelRegistry(spark, f"file://{tmp_path}/reg")
    reg.put("one", m)
    assert [r["name"] for r in reg.list().collect()] == ["one"]


def test_capabilities(spark):
    assert capability.capability_matrix(spark).count() == len(list_families())
    assert capability.family_capability("NO")["quantile"] == "native" and resolve("no").name == "NO"
    with pytest.raises(ValueError):
        capability.require_family_capability("ST5", "density")
