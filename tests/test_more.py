"""Constraints, safe functions, ranks, leverages, penalties, selection by validation, resampling, replay."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shapecast.functions import constraints, dist, safe
from shapecast.functions.families import hurdle, resolve, zero_inflated
from shapecast.operators import capability, diagnose, fit, predict, resample, select, stats, trace
from shapecast.plans import formula
from shapecast.sources import replay
from shapecast.sources.models import ModelRegistry


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = rng.random(400)
    y = rng.poisson(np.exp(0.5 + 1.5 * x))
    return spark.createDataFrame([(i, float(a), int(b), "abc"[i % 3], 1 + i % 2) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id long, x double, y long, g string, part int").persist()


def test_constraints_name_what_is_wrong(spark):
    df = spark.createDataFrame([(1.0,), (-1.0,), (None,), (float("nan"),), (float("inf"),), (0.0,)], "y double")
    assert constraints.invalid_responses(df, "GA", F.col("y")) == {"rows": 6, "missing": 2, "infinite": 1, "outside": 2}
    assert constraints.invalid_responses(df, "ZAGA", F.col("y"))["outside"] == 1
    with pytest.raises(constraints.ValidationError) as e:
        constraints.require_valid_responses(df.where("y < 2"), "PO", F.col("y"))
    assert e.value.code == "support"
    with pytest.raises(constraints.ValidationError) as e:
        constraints.require_valid_parameters("GA", {"sigma": [1.0, -1.0]})
    assert e.value.code == "parameter"
    specs = {s.name: s for s in constraints.family_specs("BCT")}
    assert specs["tau"].constraint.low == 2 and specs["nu"].constraint is constraints.REAL
    assert constraints.validate_vector("y", [1, 2], 2).tolist() == [1, 2]
    for bad in ([[1.0]], [math.nan]):
        with pytest.raises(constraints.ValidationError):
            constraints.validate_vector("y", bad)


def test_safe_functions_are_finite(spark):
    df = spark.createDataFrame([(v,) for v in (-1e300, -5.0, 0.0, 1e-320, 5.0, 1e300)], "x double")
    x = F.col("x")
    fs = [safe.safe_exp(x), safe.safe_log(x), safe.safe_log1p(x), safe.safe_softplus(x), safe.safe_sigmoid(x), safe.safe_divide(F.lit(1.0), x), safe.safe_sqrt(x), safe.bounded_transform(x, 1.0, 2.0)]
    got = df.select(*[f.alias(f"f{i}") for i, f in enumerate(fs)]).collect()
    assert all(math.isfinite(v) for r in got for v in r) and all(1 <= r["f7"] <= 2 for r in got)
    o = df.select(safe.ordered_transform(F.array(F.lit(3.0), F.lit(-2.0), F.lit(0.0))).alias("o")).first()["o"]
    assert o[0] == 3 and o[0] < o[1] < o[2]


def test_large_counts_have_exact_quantiles():
    assert float(dist.q("PO", 0.5, mu=5e5)) == 500000 and float(dist.q("PO", 0.5, mu=3e6)) == 3e6
    k = float(dist.q("NBI", 0.9, mu=1e6, sigma=0.5))
    assert dist.p("NBI", k, mu=1e6, sigma=0.5) >= 0.9 > dist.p("NBI", k - 1, mu=1e6, sigma=0.5)
    assert float(dist.p("DPO1", 250_000.0, mu=2e5, sigma=1.0)) == pytest.approx(1, abs=1e-6)


def test_numeric_bases_can_be_inflated():
    for f, q in ((zero_inflated("SICHEL"), {"nu": 0.5}), (hurdle("PIG"), {})):
        assert dist.d(f, np.arange(300.0), mu=4.0, sigma=0.8, pi=0.2, **q).sum() == pytest.approx(1, abs=1e-8)


def test_unseen_levels_raise_in_the_plan(spark, rows):
    m = fit.gamlss("y ~ factor(g)", rows, "PO")
    new = spark.createDataFrame([("a",), ("zz",)], "g string")
    assert predict.predict_params(m, new.where("g = 'a'")).count() == 1
    with pytest.raises(Exception, match="unseen_level"):
        predict.predict_params(m, new).collect()
    with pytest.raises(predict.PredictionSchemaError):
        predict.check_schema(m, new)
    with pytest.raises(formula.FormulaError, match="levels"):
        fit.gamlss("y ~ factor(id)", spark.range(30_000).selectExpr("id", "cast(id % 3 as double) y"), "PO")


def test_leverages_are_those_of_the_working_weights(rows):
    m = fit.gamlss("y ~ x", rows, "PO")
    pdf = rows.orderBy("id").toPandas()
    x = np.stack([np.ones(len(pdf)), pdf.x], axis=1)
    w = np.exp(x @ m.coefficients["mu"])
    want = w * np.einsum("ij,jk,ik->i", x, np.linalg.inv((x * w[:, None]).T @ x), x)
    got = diagnose.leverages(m).orderBy("id").toPandas().leverage
    assert np.allclose(got, want, rtol=1e-6) and got.sum() == pytest.approx(2)
    assert diagnose.cooks_distance(m).where("cooks is null or cooks < 0").count() == 0


def test_ranks(spark):
    rng = np.random.default_rng(1)
    v = np.round(rng.standard_normal(3000), 1)
    df = spark.createDataFrame([(int(i), float(a), int(i % 3)) for i, a in enumerate(v)], "id long, v double, g int").repartition(7)
    r, n = diagnose.ranked(df, ["v", "id"])
    got = {x["id"]: x["rank"] for x in r.collect()}
    want = {int(i): k + 1 for k, i in enumerate(np.lexsort((np.arange(3000), v)))}
    assert n == 3000 and got == want and r.columns == ["id", "v", "g", "rank"]
    r, n = diagnose.ranked(df, ["v", "id"], within="g")
    assert n == {0: 1000, 1: 1000, 2: 1000} and r.groupBy("g").agg(F.countDistinct("rank").alias("k"), F.max("rank").alias("m")).where("k <> 1000 or m <> 1000").count() == 0
    assert diagnose.ranked(df.limit(0), "v")[0].count() == 0


def test_worms_within_intervals(rows):
    m = fit.gamlss("y ~ x", rows, "PO")
    w = diagnose.worm_by(m, "x", 3)
    assert w.count() == 400 and w.select("interval").distinct().count() == 3


def test_smooth_bases_leave_out_what_others_have(spark):
    rng = np.random.default_rng(2)
    pdf = [(float(a), float(b), 0.0) for a, b in rng.random((500, 2))]
    df = spark.createDataFrame(pdf, "a double, b double, y double")

    def block(text):
        f = formula.parse(f"y ~ {text} - 1")
        d = formula.design(f, *formula.learn(df, [f]))
        return np.array(df.select(*[c.alias(f"c{i}") for i, c in enumerate(d.columns)]).collect()), d.blocks[0].penalties

    means = formula.spline_means(6)
    assert means.sum() == pytest.approx(1) and np.abs(formula.null_space(means[None]).T @ means).max() < 1e-12
    x, pens = block("ti(a, b)")
    assert x.shape[1] == 16 and len(pens) == 2
    grid = spark.range(10_000).selectExpr("(cast(id % 100 as double) + 0.5) / 100 a", "(floor(id / 100) + 0.5) / 100 b", "0.0 y")
    f = formula.parse("y ~ ti(a, b) - 1")
    cols = formula.design(f, {}, {"a": (0.0, 1.0), "b": (0.0, 1.0)}).columns
    by = grid.groupBy("a").agg(*[F.avg(c).alias(f"c{i}") for i, c in enumerate(cols)])
    assert max(abs(v) for r in by.drop("a").collect() for v in r) < 0.02  # no main effect of a in it
    for text, dims in (("tps(a)", 1), ("tps(a, b)", 2)):
        x, (pen,) = block(text)
        values = np.linalg.eigvalsh(pen)
        assert values.min() > -1e-8 and (values < 1e-9).sum() == dims
    x, (pen,) = block("cs(a, k=8)")
    values = np.linalg.eigvalsh(pen)
    assert (values < 1e-9).sum() == 1 and values.min() > -1e-9
    a = np.array([r[0] for r in pdf])
    y = a**2  # a natural spline's bending: the penalty is the integral of its squared second derivative
    beta = np.linalg.lstsq(np.column_stack([np.ones(len(a)), x]), y, rcond=None)[0]
    assert np.abs(np.column_stack([np.ones(len(a)), x]) @ beta - y).max() < 0.02


def test_smooth_fits_follow_a_curve(spark):
    rng = np.random.default_rng(3)
    x = rng.random(800)
    df = spark.createDataFrame([(float(a), float(np.sin(6 * a) + 0.1 * e)) for a, e in zip(x, rng.standard_normal(800), strict=True)], "x double, y double")
    for text in ("cs(x)", "tps(x)", "pb(x)"):
        m = fit.gamlss(f"y ~ {text}", df, "NO")
        err = stats.fitted(m).select((F.col("fitted") - F.sin(6 * F.col("x"))).alias("e")).agg(F.sqrt(F.avg(F.col("e") * F.col("e")))).first()[0]
        assert err < 0.05


def test_selection_by_validation(rows):
    r = select.fit_dist_pred(rows, "y", "counts", rand="part")
    assert [x["validation"] for x in r] == sorted(x["validation"] for x in r) and r[0]["family"] != "GEOM"
    m = fit.gamlss("y ~ x", rows, "PO")
    c = select.choose_dist_pred(m, "counts", newdata=rows.where("part = 2"))
    assert c[0]["validation"] < r[0]["validation"]
    s = select.stepwise_distribution_selection("y ~ x", rows, {"count": ["PO", "NBI"], "over": ["GEOM", "WARING"]})
    assert s["group"] == "count" and s["best"].family.name in ("PO", "NBI")
    a, b = select.gamlss_vgd("y ~ x", rows, "PO", "part"), select.gamlss_ml_pred(rows, "y", "PO", "part")
    assert [x["index"] for x in select.vgd(b, a)] == [1, 0]
    with pytest.raises(ValueError):
        select.fit_dist_pred(rows, "y", "counts")
    assert select.dropterm_all(m)[0]["change"] == "- x" and {x["parameter"] for x in select.add1_tgd_all(fit.gamlss("y ~ 1", rows, "NBI"), rows, ["x"])} == {"mu", "sigma"}


def test_resampling(spark, rows):
    w = [resample.poisson_weights(rows.repartition(k), 4, key=["id"]).select("id", "__w") for k in (1, 6)]
    assert w[0].join(w[1].withColumnRenamed("__w", "v"), "id").where("__w <> v").count() == 0
    big = spark.range(200_000).select("id")
    mean, var = resample.poisson_weights(big, 1, key=["id"]).agg(F.avg("__w"), F.var_pop("__w")).first()
    assert mean == pytest.approx(1, abs=0.02) and var == pytest.approx(1, abs=0.03)
    m = fit.gamlss("z ~ x", rows.withColumn("z", 1 + 2 * F.col("x") + F.sin("id")), "NO")
    b = resample.residual_bootstrap(m, "id", 12)
    assert b["mean"][1] == pytest.approx(m.coefficients["mu"][1], abs=0.2) and 0 < b["se"][1] < 0.5


def test_centile_fans_and_comparisons(rows):
    one, two = fit.gamlss("z ~ x", rows.withColumn("z", F.col("y") + 0.5), "GA"), fit.gamlss("z ~ x", rows.withColumn("z", F.col("y") + 0.5), "NO")
    f = diagnose.centile_fan(one, "x", (5, 25, 50, 75, 95), 7)
    assert f.count() == 14 and f.where("lower >= upper").count() == 0
    c = diagnose.centile_comparison({"ga": one, "no": two}, "x", (10, 50, 90), 5)
    assert c.count() == 30
    assert diagnose.centile_comparison_coverage({"ga": one, "no": two}, None, (10, 50, 90)).columns == ["centile", "ga", "no"]
    with pytest.raises(ValueError):
        diagnose.centile_fan(one, "x", (5, 50))
    t = diagnose.two_way_data(fit.gamlss("y ~ x + factor(g)", rows, "PO"), ("x", "factor(g)"))
    assert t.count() == 400
    assert diagnose.numerical_warnings(one) == []


def test_capabilities():
    assert capability.family_supports("PIG", "streaming") and capability.family_supports("NO", "density")
    assert capability.method_route_report("PIG", "cg", strict=True)["admitted"] is False
    capability.require_method_route("NO", "RS")
    with pytest.raises(ValueError):
        capability.require_method_route("SEP", "RS")


def test_capability_differences(spark):
    saved = [capability.family_capability(n) for n in ("NO", "GA")]
    saved[0]["cdf"] = "numeric"
    found = {(r["family"], r["feature"]) for r in capability.capability_differences(spark, saved).where("saved is not null").collect()}
    assert found == {("NO", "cdf")}


def test_registry_evicts_and_checks_names(spark, rows, tmp_path):
    reg = ModelRegistry(spark, str(tmp_path / "models"), 2)
    m = fit.gamlss("y ~ x", rows, "PO")
    with pytest.raises(ValueError):
        reg.put("it's", m)
    for name in ("one", "two", "three"):
        reg.put(name, m)
    assert [r["name"] for r in reg.list().collect()] == ["three", "two"] and not (tmp_path / "models/one").exists()
    assert reg.get("three").coefficients["mu"].tolist() == m.coefficients["mu"].tolist()


def test_replay_and_traces(spark, tmp_path, rows):
    data = replay.default_datasets()
    df = data.build(spark, "poisson", 500, 3)
    assert df.repartition(3).agg(F.sum("y")).first() == df.agg(F.sum("y")).first() and data.names()[0] == "gamma"

    def run(inputs):
        return {"coef": fit.gamlss("y ~ x", data.build(spark, inputs["name"], inputs["n"], inputs["seed"]), inputs["family"]).coefficients["mu"].tolist()}

    inputs = {"name": "poisson", "n": 500, "seed": 3, "family": "PO"}
    art = {"inputs": inputs, "result": run(inputs), "lock": replay.artifact_lock({"a": 1}, {"tol": 1}, "1")}
    replay.write_artifact(spark, str(tmp_path / "art"), art)
    back = replay.read_artifact(spark, str(tmp_path / "art"))
    assert back == json.loads(json.dumps(art)) and replay.replay(back, run, 1e-6)["same"]
    back["result"]["coef"][0] += 1
    assert replay.replay(back, run, 1e-6)["differences"] == [".coef[0]"]
    m = fit.gamlss("y ~ x", df, "PO")
    t = trace.optimizer_trace(m, spark).collect()
    assert t[0]["change"] is None and all(r["change"] > -1e-6 for r in t[1:])
    rank = trace.compare_algorithms("y ~ x", df, "PO", ("RS", "CG"))
    assert abs(rank[0]["deviance"] - rank[1]["deviance"]) < 1e-2
    p = trace.Profiler()
    with p.section("a"), p.section("b"):
        pass
    assert [r["section"] for r in p.rows()] == ["a", "a/b"] and p.collapsed().splitlines()[1].startswith("run;a;b ")
    log = trace.EventLog(spark, str(tmp_path / "log"))
    log.add("fit", deviance=m.deviance)
    log.flush()
    assert log.read().first()["event"] == "fit"


def test_q_totals(rows):
    m = fit.gamlss("y ~ x", rows, "PO")
    t = {r["statistic"]: r for r in diagnose.q_totals(diagnose.q_stats(m, "x", 4)).collect()}
    assert set(t) == {"Q1", "Q2", "Q3", "Q4"} and all(0 <= r["p"] <= 1 and r["df"] == 3 for r in t.values())


def test_q_stats_of_many_rows(spark):
    n = 100_000  # 3 n^4 is beyond a long
    df = spark.range(2 * n).select("id", (F.pmod(F.xxhash64("id"), F.lit(1000)) / 100).alias("y"))
    m = fit.gamlss("y ~ 1", df, "NO")
    got = {r["interval"]: r for r in diagnose.q_stats(m, "id", 2).collect()}
    assert sum(r["n"] for r in got.values()) == 2 * n
    y = np.array([r[0] for r in df.orderBy("id").select("y").collect()])
    z = (y - y.mean()) / y.std()
    for i, part in ((1, z[:n]), (2, z[n:])):
        d = part - part.mean()
        g1 = (d**3).mean() / (d**2).mean() ** 1.5
        b2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
        w2 = math.sqrt(2 * (b2 - 1)) - 1
        z3 = math.asinh(g1 * math.sqrt((n + 1) * (n + 3) / (6 * (n - 2))) / math.sqrt(2 / (w2 - 1))) / math.sqrt(math.log(math.sqrt(w2)))
        assert got[i]["n"] == n and abs(got[i]["z1"] - math.sqrt(n) * part.mean()) < 1e-6 and abs(got[i]["z3"] - z3) < 1e-9
        assert got[i]["z4"] < -100 and abs(got[i]["k2"] - got[i]["z3"] ** 2 - got[i]["z4"] ** 2) < 1e-6  # a uniform's tails
    assert all(r["q"] >= 0 for r in diagnose.q_totals(diagnose.q_stats(m, "id", 2)).collect())


def test_support_of_families():
    assert resolve("zipf").support == "count1" and constraints.response_constraint("PARETO").low == 1
