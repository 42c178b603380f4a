"""Queries over fitted models whose estimates SQL can write down: fits, predictions, scores, diagnostics, selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import constraints, dist, safe
from .functions.expr import to_column, var
from .functions.links import LINKS, get_link
from .operators import diagnose, fit, predict, regularize, resample, score, select, stats
from .plans.formula import design, learn, parse


def _t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _row(spark, **values):
    return spark.createDataFrame([tuple(v if isinstance(v, int) else float(v) for v in values.values())], ", ".join(f"{k} {'bigint' if isinstance(v, int) else 'double'}" for k, v in values.items()))


def _logno(spark, sf):
    return fit.gamlss("o_totalprice ~ 1", _t(spark, sf, "orders"), "LOGNO")


def _exp(spark, sf):
    return fit.gamlss("o_totalprice ~ 1", _t(spark, sf, "orders"), "EXP")


def _no(spark, sf):
    return fit.gamlss("l_extendedprice ~ l_quantity", _t(spark, sf, "lineitem"), "NO")


def _bal(spark, sf):
    return fit.gamlss("c_acctbal ~ 1", _t(spark, sf, "customer"), "NO")


def _po(spark, sf):
    return fit.gamlss("l_quantity ~ factor(l_returnflag)", _t(spark, sf, "lineitem"), "PO")


def score_interval_logno(spark, sf):
    m, o = _logno(spark, sf), _t(spark, sf, "orders")
    return _row(spark, score=round(score.interval_score(m, o, 0.2) / 1000, 4), coverage=round(score.coverage(m, o, 0.2), 6), pinball=round(score.pinball(m, o, 0.5) / 1000, 4))


def pit_histogram_exp(spark, sf):
    return score.pit_histogram(_exp(spark, sf), _t(spark, sf, "orders"), 10)


def calibration_exp(spark, sf):
    return diagnose.calibration(_exp(spark, sf), None, 10).select("bin", "n", F.round("mean", 6).alias("mean"))


def q_stats_no(spark, sf):
    """Z1 to Z4 and K2 of standardised balances, in four ranges of the key."""
    q = diagnose.q_stats(_bal(spark, sf), "c_custkey", 4)
    return q.select("interval", "n", *[F.round(c, 3).alias(c) for c in ("z1", "z2", "z3", "z4", "k2")])


def q_totals_no(spark, sf):
    t = diagnose.q_totals(diagnose.q_stats(_bal(spark, sf), "c_custkey", 4).select("interval", "n", *[F.round(f"z{k}", 3).alias(f"z{k}") for k in range(1, 5)]))
    return t.select("statistic", F.round("q", 3).alias("q"), "df")


def worm_ranks_no(spark, sf):
    """Residual, rank, and the normal distribution function at the theoretical quantile that the deviation goes back to."""
    w = diagnose.worm_data(_bal(spark, sf))
    return w.select(F.col("rank").cast("bigint").alias("rank"), F.round("z", 5).alias("z"), F.round(dist.normal_cdf(F.col("z") - F.col("deviation")), 6).alias("p"), F.round(F.col("theoretical") - F.col("z") + F.col("deviation"), 9).alias("zero"))


def worm_by_no(spark, sf):
    """Ranks within four ranges of the key between given points."""
    df, _ = diagnose.cut(diagnose.with_residuals(_bal(spark, sf)), "c_custkey", 4, points=[300.5, 700.5, 1100.5])
    r, _ = diagnose.ranked(df.select("interval", "z"), "z", within="interval")
    return r.select("interval", F.col("rank").cast("bigint").alias("rank"), F.round("z", 5).alias("z"))


def summary_lines(spark, sf):
    rows = [(r["parameter"], r["term"], round(r["estimate"], 4), round(r["se"], 6), round(r["z"] / 10, 3)) for r in stats.summary(_no(spark, sf))]
    return spark.createDataFrame(rows, "parameter string, term string, estimate double, se double, z10 double")


def confint_lines(spark, sf):
    rows = [(r["parameter"], r["term"], round(r["lower"], 3), round(r["upper"], 3)) for r in stats.confint(_no(spark, sf))]
    return spark.createDataFrame(rows, "parameter string, term string, lower double, upper double")


def vuong_exp_logno(spark, sf):
    r = stats.vuong_clarke_test(_exp(spark, sf), _logno(spark, sf))
    return _row(spark, vuong_z=round(r["vuong_z"], 4), clarke_b=int(r["clarke_b"]), n=int(r["n"]))


def centiles_logno(spark, sf):
    c = diagnose.centile_check(_logno(spark, sf))
    return c.select("centile", F.round("below", 4).alias("below"))


def leverage_po(spark, sf):
    return diagnose.leverages(_po(spark, sf)).select("l_orderkey", "l_linenumber", F.round("leverage", 8).alias("leverage"))


def leverage_no(spark, sf):
    return diagnose.leverages(_no(spark, sf)).select("l_orderkey", "l_linenumber", F.round("leverage", 8).alias("leverage"))


def cooks_no(spark, sf):
    return diagnose.cooks_distance(_no(spark, sf)).select("l_orderkey", "l_linenumber", F.round(F.col("cooks") * 1000, 4).alias("cooks"))


def residuals_no(spark, sf):
    m = _no(spark, sf)
    r = diagnose.with_residuals(m, diagnose.with_residuals(m), "simple", "simple")
    return r.select("l_orderkey", "l_linenumber", F.round("z", 3).alias("z"), F.round("simple", 3).alias("simple"))


def residuals_po(spark, sf):
    """Middle of the jump: the distribution function there is the mean of those at y - 1 and y."""
    m = fit.gamlss("more ~ 1", _t(spark, sf, "lineitem").groupBy("l_orderkey").agg((F.count("*") - 1).cast("double").alias("more")), "GEOM")
    return diagnose.with_residuals(m).select("l_orderkey", F.round(dist.normal_cdf(F.col("z")), 6).alias("u"))


def term_effect(spark, sf):
    """The contribution of a factor."""
    li = _t(spark, sf, "lineitem").withColumn("half", F.when(F.col("l_quantity") > 25, "b").otherwise("a"))
    m = fit.gamlss("l_extendedprice ~ factor(half)", li, "NO")
    return diagnose.term_data(m).select("l_orderkey", "l_linenumber", F.round("`term_factor(half)`", 2).alias("effect"))


def fits_closed(spark, sf):
    """Estimates on the response scale of families with closed maximum likelihood."""
    o, p, ln = _t(spark, sf, "orders"), _t(spark, sf, "part"), _t(spark, sf, "lineitem")
    out = []

    def add(name, formula, data, scale=1.0, digits=4, **more):
        m = fit.gamlss(formula, data, name, **more)
        out.extend((name, q, round(float(v) / scale if q == "mu" else float(v), digits)) for q, v in m.data.limit(1).select(*[c.alias(q) for q, c in predict.parameter_columns(m).items()]).first().asDict().items())

    add("LOGNO2", "o_totalprice ~ 1", o, 1000.0)
    add("LNO", "o_totalprice ~ 1", o)
    add("IG", "o_totalprice ~ 1", o, 1000.0, 5)
    add("PARETO", "p_retailprice ~ 1", p, digits=5)
    add("PARETO1", "p_retailprice ~ 1", p, digits=5)
    add("NO2", "p_size ~ 1", p, digits=2)
    add("GEOMO", "l_linenumber ~ 1", ln, digits=5)
    add("LOGITNO", "u ~ 1", p.withColumn("u", F.col("p_size") / 51.0))
    return spark.createDataFrame(out, "family string, parameter string, value double")


def predict_exp(spark, sf):
    """Mean, interval and quantile of an exponential model with a factor."""
    m = fit.gamlss("l_extendedprice ~ factor(l_returnflag)", _t(spark, sf, "lineitem"), "EXP")
    df = predict.predict_quantile(m, predict.predict_interval(m, predict.predict_mean(m, _t(spark, sf, "lineitem")), 0.1), 0.5)
    return df.select("l_orderkey", "l_linenumber", *[F.round(c, 2).alias(c) for c in ("mean", "lower", "upper", "quantile")])


def predict_se_no(spark, sf):
    m = _no(spark, sf)
    return predict.standard_error(m, _t(spark, sf, "lineitem")).select("l_orderkey", "l_linenumber", F.round("fit", 2).alias("fit"), F.round("se_fit", 4).alias("se_fit"))


def predict_response_no(spark, sf):
    m, li = _no(spark, sf), _t(spark, sf, "lineitem")
    t = predict.predict_response(m, predict.predict_response(m, li), "terms")
    d = predict.predict_distribution(m, t)
    return d.select("l_orderkey", "l_linenumber", "family", F.round("fit", 2).alias("fit"), F.round("params.sigma", 2).alias("sigma"))


def fitted_lp(spark, sf):
    m = _po(spark, sf)
    out = stats.linear_predictor(m, "mu", stats.fitted(m))
    return out.select("l_orderkey", "l_linenumber", F.round("fitted", 5).alias("fitted"), F.round("lp", 5).alias("lp"))


def deviance_rows(spark, sf):
    return stats.deviance_increment(_po(spark, sf)).select("l_orderkey", "l_linenumber", F.round("deviance", 5).alias("deviance"))


def model_matrix_lines(spark, sf):
    f = parse("l_extendedprice ~ log(l_quantity) + I(l_quantity^2) + l_discount:l_tax + factor(l_returnflag) - 1")
    li = _t(spark, sf, "lineitem")
    d = design(f, *learn(li, [f]))
    names = ["log_q", "q2", "dt", "flag_2", "flag_3"]
    return li.select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(n) for c, n in zip(d.columns, names, strict=True)])


def bspline_lines(spark, sf):
    """The first and tenth cubic B-spline of quantity, and the sum of all 20."""
    f = parse("l_extendedprice ~ pb(l_quantity) - 1")
    li = _t(spark, sf, "lineitem")
    cols = design(f, *learn(li, [f])).columns
    return li.select("l_orderkey", "l_linenumber", F.round(cols[0], 8).alias("b1"), F.round(cols[9], 8).alias("b10"), F.round(sum(cols[1:], cols[0]), 8).alias("total"))


def tensor_lines(spark, sf):
    """A tensor product's first column, and the sum of all, which is 1."""
    f = parse("l_extendedprice ~ te(l_quantity, l_discount) - 1")
    li = _t(spark, sf, "lineitem")
    cols = design(f, *learn(li, [f])).columns
    return li.select("l_orderkey", "l_linenumber", F.round(cols[12], 7).alias("b13"), F.round(sum(cols[1:], cols[0]), 7).alias("total"))


def loglik_table(spark, sf):
    m = _exp(spark, sf)
    ll = stats.log_likelihood(m)
    t = stats.gaic_table(m, _logno(spark, sf), k=[2.0, 3.84])
    s = stats.gaic_scaled(m, _logno(spark, sf))
    return spark.createDataFrame([(i, round(ll["loglik"] / 1000, 4), round(r["df"], 6), round(r["k=2"] / 1000, 4), round(r["k=3.84"] / 1000, 4), round(w, 6)) for i, (r, w) in enumerate(zip(t, s, strict=True))], "model int, loglik_first double, df double, aic_k double, gaic_k double, scaled double")


def rsq_lines(spark, sf):
    return _row(spark, cox_snell=round(stats.rsq(_no(spark, sf), "Cox Snell"), 6))


def compare_lines(spark, sf):
    a, b = fit.gamlss("l_extendedprice ~ 1", _t(spark, sf, "lineitem"), vcov=False), _no(spark, sf)
    rows = stats.compare_models(a, b)
    return _row(spark, d_deviance=round(rows[1]["d_deviance"], 3), sbc_k=round(rows[1]["sbc"] / 1000, 4))


def refit_lines(spark, sf):
    m = stats.refit(_no(spark, sf), _t(spark, sf, "lineitem").where("l_quantity <= 25"))
    b = m.coef()
    return _row(spark, intercept=round(b["(Intercept)"], 2), slope=round(b["l_quantity"], 3))


def mixed_lbfgs(spark, sf):
    li = _t(spark, sf, "lineitem")
    out = []
    for method in ("MIXED", "LBFGS", "CG"):
        b = fit.gamlss("l_extendedprice ~ l_quantity", li, "NO", method=method, control=fit.Control(tol=1e-12, cycles=200)).coef()
        out.append((method, round(b["(Intercept)"], 0), round(b["l_quantity"], 1)))
    return spark.createDataFrame(out, "method string, intercept double, slope double")


def weighted_lines(spark, sf):
    m = fit.gamlss("l_extendedprice ~ l_quantity", _t(spark, sf, "lineitem"), "NO", weights="l_linenumber")
    b = m.coef()
    return _row(spark, intercept=round(b["(Intercept)"], 2), slope=round(b["l_quantity"], 3))


def terms_lines(spark, sf):
    """Adding and dropping a term by AIC."""
    a = fit.gamlss("l_extendedprice ~ 1", _t(spark, sf, "lineitem"), vcov=False)
    up = select.addterm(a, ["l_quantity"])[0]
    down = select.dropterm(up["model"])[0]
    best, trace = select.step_gaic(a, ["l_quantity"])
    return _row(spark, added_k=round(up["value"] / 1000, 4), dropped_k=round(down["value"] / 1000, 4), stepped_k=round(best.gaic(2.0) / 1000, 4), steps=len(trace) - 1)


def validation_orders(spark, sf):
    o = _t(spark, sf, "orders").withColumn("part", F.pmod("o_orderkey", F.lit(2)).cast("int") + 1)
    rows = select.compare_by_validation("o_totalprice ~ 1", o.where("part = 1"), o.where("part = 2"), ["NO", "EXP", "LOGNO"])
    one = select.gamlss_vgd("o_totalprice ~ 1", o, "EXP", "part")
    ml = select.gamlss_ml_pred(o, "o_totalprice", "EXP", "part")
    order = select.vgd(one, ml)
    return spark.createDataFrame([(r["family"], i, round(r["validation"] / 1000, 4), round(order[0]["validation"] / 1000, 4), one["n"]) for i, r in enumerate(rows, 1)], "family string, rank int, deviance_k double, exp_k double, n bigint")


def groups_orders(spark, sf):
    """The best family of the first members of groups, and of its group."""
    r = select.stepwise_distribution_selection("o_totalprice ~ 1", _t(spark, sf, "orders"), {"real": ["NO", "LOGNO"], "positive": ["EXP", "LNO"]})
    return spark.createDataFrame([(x["family"], round(x["criterion"] / 1000, 4), r["group"]) for x in r["families"]], "family string, aic_k double, best_group string")


def kinds_of_columns(spark, sf):
    kinds = [("lineitem", "l_quantity"), ("customer", "c_acctbal"), ("part", "p_retailprice"), ("lineitem", "l_discount")]
    return spark.createDataFrame([(c, select.data_type(_t(spark, sf, t), c)) for t, c in kinds], "name string, kind string")


def lasso_part(spark, sf):
    p = _t(spark, sf, "part")
    return _row(spark, lasso=round(float(regularize.fit_lasso(p, "p_retailprice", ["p_size"], 50.0)["coef"][0]), 5))


def bootstrap_weights(spark, sf):
    """Weights of a key: the same whatever the partitions, and indices one row per draw."""
    s = _t(spark, sf, "supplier").select("s_suppkey")
    a = resample.poisson_weights(s.repartition(5), 3, "a", ["s_suppkey"]).join(resample.poisson_weights(s.coalesce(1), 3, "b", ["s_suppkey"]), "s_suppkey")
    i = resample.bootstrap_indices(spark, 100, 20, 1)
    r = a.agg(F.count("*").alias("n"), F.sum((F.col("a") != F.col("b")).cast("long")).alias("differ")).first()
    k = i.agg(F.count("*").alias("rows"), F.countDistinct("boot").alias("boots"), F.min("index").alias("lo"), F.max((F.col("index") < 100).cast("int")).alias("inside")).first()
    return _row(spark, n=r["n"], differ=r["differ"], rows=k["rows"], boots=k["boots"], lowest=k["lo"], inside=k["inside"])


def safe_balances(spark, sf):
    c, x = _t(spark, sf, "customer"), F.col("c_acctbal")
    out = {"log": safe.safe_log(x), "log1p": safe.safe_log1p(x), "exp": F.log10(safe.safe_exp(x / 100, 50.0)), "sqrt": safe.safe_sqrt(x), "sigmoid": safe.safe_sigmoid(x / 1000), "softplus": safe.safe_softplus(x / 1000), "ratio": safe.safe_divide(F.lit(1.0), F.floor(x / 5000), 0.5), "positive": safe.positive_transform(x / 1000), "bounded": safe.bounded_transform(x / 1000, -2.0, 3.0), "last": F.element_at(safe.ordered_transform(F.array(x / 1000, F.lit(0.0), x / 1000)), -1)}
    return c.select("c_custkey", *[F.round(v, 5).alias(f"s_{k}") for k, v in out.items()])


def invalid_balances(spark, sf):
    n = constraints.invalid_responses(_t(spark, sf, "customer"), "GA", F.col("c_acctbal"))
    held = _t(spark, sf, "customer").agg(F.sum(constraints.range_constraint("r", 0.0, 5000.0).holds(F.col("c_acctbal")).cast("long")).alias("n"), F.sum(constraints.POSITIVE.clip(F.col("c_acctbal"), 0.01)).alias("s")).first()
    return _row(spark, rows=n["rows"], missing=n["missing"], infinite=n["infinite"], outside=n["outside"], in_range=held["n"], clipped=round(held["s"], 2))


def links_more(spark, sf):
    """Further links and derivatives of inverses, of m = p_size + 3."""
    p = _t(spark, sf, "part").select("p_partkey", (F.col("p_size") + 3).cast("double").alias("m"))
    e = lambda n: to_column(get_link(n).link(var("m")), {"m": F.col("m")})
    d = lambda n: to_column(get_link(n).derivative(var("e")), {"e": e(n)})
    links = ["logshift1", "logshift2", "softplus", "1/mu^2", "log", "inverse", "sqrt", "identity"]
    named = lambda n: n.replace("1/mu^2", "mu2")
    back = F.round(to_column(LINKS["softplus"].inverse(var("e")), {"e": e("softplus")}), 6).alias("mu_softplus")
    small = F.col("m") / 60
    unit = [F.round(to_column(get_link(n).derivative(var("e")), {"e": to_column(get_link(n).link(var("m")), {"m": small})}), 6).alias(f"d_{n}") for n in ("logit", "cloglog")]
    return p.select("p_partkey", *[F.round(e(n), 6).alias(f"eta_{named(n)}") for n in links[:4]], back, *[F.round(d(n), 6).alias(f"d_{named(n)}") for n in links], *unit)


def probit_part(spark, sf):
    """Normal distribution function of the probit of m is m."""
    p = _t(spark, sf, "part").select("p_partkey", (F.col("p_size") / 51.0).cast("double").alias("m"))
    eta = to_column(get_link("probit").link(var("m")), {"m": F.col("m")})
    return p.select("p_partkey", F.round(to_column(get_link("probit").inverse(var("e")), {"e": eta}), 7).alias("m"), F.round(eta + dist.normal_quantile(1 - F.col("m")), 7).alias("zero"))


def acf_exp(spark, sf):
    """Autocorrelation of standardised values in the order of a key."""
    c = _t(spark, sf, "customer")
    m = fit.gamlss("c_acctbal ~ 1", c, "NO")
    return diagnose.acf_residuals(m, "c_custkey", 5).select("lag", F.round("acf", 5).alias("acf"), F.round("acf_squared", 5).alias("acf_squared"))


def histogram_part(spark, sf):
    h = diagnose.histogram(_t(spark, sf, "part"), "p_size", "EXP", 7)
    return h.select("bin", F.round("low", 6).alias("low"), "n", F.round("density", 8).alias("density"), F.round("fitted", 6).alias("fitted"))


def centile_curves(spark, sf):
    """Fans and comparisons of an exponential model of a factor's levels at given prices."""
    m = fit.gamlss("l_extendedprice ~ 0 + l_quantity", _t(spark, sf, "lineitem").where("l_quantity > 0"), "NO")
    f = diagnose.centile_fan(m, "l_quantity", (25, 50, 75), 5)
    return f.select(F.round("x", 6).alias("x"), "band", "coverage", F.round((F.col("lower") + F.col("upper")) / 2, 1).alias("middle"))


QUERIES = {
    f.__name__: f
    for f in (
        score_interval_logno, pit_histogram_exp, calibration_exp, q_stats_no, q_totals_no, worm_ranks_no, worm_by_no, summary_lines, confint_lines, vuong_exp_logno, centiles_logno, leverage_po, leverage_no, cooks_no, residuals_no, residuals_po, term_effect, fits_closed, predict_exp, predict_se_no, predict_response_no,
        fitted_lp, deviance_rows, model_matrix_lines, bspline_lines, tensor_lines, loglik_table, rsq_lines, compare_lines, refit_lines, mixed_lbfgs, weighted_lines, terms_lines, validation_orders, groups_orders, kinds_of_columns, lasso_part, bootstrap_weights, safe_balances, invalid_balances, links_more, probit_part, acf_exp, histogram_part, centile_curves,
    )
}

_OLS = "select avg(l_extendedprice) ym, avg(l_quantity) xm, var_pop(l_quantity) * count(*) sxx, count(*) n, regr_slope(l_extendedprice, l_quantity) b, regr_intercept(l_extendedprice, l_quantity) a from lineitem"
_FIT = f"select o.*, sqrt((select avg((l_extendedprice - o.a - o.b * l_quantity) ^ 2) from lineitem)) s from ({_OLS}) o"
_LN = "select avg(ln(o_totalprice)) mu, stddev_pop(ln(o_totalprice)) s, avg(o_totalprice) m, count(*) n from orders"
_Z = "with m as (select avg(c_acctbal) m, stddev_pop(c_acctbal) s, min(c_custkey) lo, max(c_custkey) hi from customer), z as (select (c_acctbal - m) / s z, (1 + (c_custkey >= lo + (hi - lo) * 0.25)::int + (c_custkey >= lo + (hi - lo) * 0.5)::int + (c_custkey >= lo + (hi - lo) * 0.75)::int)::int g from customer, m), a as (select g, count(*)::double n, avg(z) m, var_samp(z) v, (avg(z ^ 3) - 3 * avg(z) * avg(z ^ 2) + 2 * avg(z) ^ 3) / var_pop(z) ^ 1.5 s, (avg(z ^ 4) - 4 * avg(z) * avg(z ^ 3) + 6 * avg(z) ^ 2 * avg(z ^ 2) - 3 * avg(z) ^ 4) / var_pop(z) ^ 2 k from z group by g)"
_Q = (
    _Z
    + ", b as (select *, sqrt(n) * m z1, (v ^ (1 / 3.0) - (1 - 2 / (9 * n - 9))) / sqrt(2 / (9 * n - 9)) z2, s * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) y, 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) b2, 3 * (n - 1) / (n + 1) e, 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5)) vv, 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) sb from a)"
    + ", c as (select *, -1 + sqrt(2 * (b2 - 1)) w2, 6 + 8 / sb * (2 / sb + sqrt(1 + 4 / (sb * sb))) aa, (k - e) / sqrt(vv) x from b)"
    + ", d as (select g as interval, n::bigint n, z1, z2, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(ln(sqrt(w2))) z3, (1 - 2 / (9 * aa) - sign((1 - 2 / aa) / (1 + x * sqrt(2 / (aa - 4)))) * abs((1 - 2 / aa) / (1 + x * sqrt(2 / (aa - 4)))) ^ (1 / 3.0)) / sqrt(2 / (9 * aa)) z4 from c)"
)
_P = "(p_size + 3)::double"
ORACLES = {
    "score_interval_logno": f"with m as ({_LN}), q as (select exp(mu - 1.2815515655446004 * s) lo, exp(mu + 1.2815515655446004 * s) hi, exp(mu) med from m) select round(avg(hi - lo + 10 * (greatest(lo - o_totalprice, 0) + greatest(o_totalprice - hi, 0))) / 1000, 4) score, round(avg((o_totalprice between lo and hi)::int), 6) coverage, round(avg(abs(o_totalprice - med)) / 2000, 4) pinball from orders, q",
    "pit_histogram_exp": f"with m as ({_LN}), h as (select least(floor(10 * (1 - exp(-o_totalprice / m))), 9)::int bin, count(*) n from orders, m group by 1) select k.bin, coalesce(n, 0)::bigint n from (select unnest(range(0, 10))::int bin) k left join h using (bin)",
    "calibration_exp": f"with m as ({_LN}) select least(floor(10 * (1 - exp(-o_totalprice / m))), 9)::int bin, count(*) n, round(avg(1 - exp(-o_totalprice / m)), 6) mean from orders, m group by 1",
    "q_stats_no": _Q + " select interval, n, round(z1, 3) z1, round(z2, 3) z2, round(z3, 3) z3, round(z4, 3) z4, round(z3 * z3 + z4 * z4, 3) k2 from d",
    "q_totals_no": _Q + ", r as (select round(z1, 3) z1, round(z2, 3) z2, round(z3, 3) z3, round(z4, 3) z4 from d) select 'Q1' as statistic, round(sum(z1 * z1), 3) q, 3.0::double df from r union all select 'Q2', round(sum(z2 * z2), 3), 3.0 from r union all select 'Q3', round(sum(z3 * z3), 3), 3.0 from r union all select 'Q4', round(sum(z4 * z4), 3), 3.0 from r",
    "worm_ranks_no": "with m as (select avg(c_acctbal) m, stddev_pop(c_acctbal) s, count(*) n from customer), r as (select (c_acctbal - m) / s z, n, row_number() over (order by c_acctbal) k from customer, m) select k as rank, round(z, 5) z, round((k - 0.375::double) / (n + 0.25::double), 6) p, 0.0::double zero from r",
    "worm_by_no": "with m as (select avg(c_acctbal) m, stddev_pop(c_acctbal) s from customer), r as (select (1 + (c_custkey > 300)::int + (c_custkey > 700)::int + (c_custkey > 1100)::int)::int g, (c_acctbal - m) / s z from customer, m) select g as interval, row_number() over (partition by g order by z) as rank, round(z, 5) z from r",
    "summary_lines": f"with f as ({_FIT}), r as (select 'mu' parameter, '(Intercept)' term, a e, s * sqrt(1.0 / n + xm * xm / sxx) se from f union all select 'mu', 'l_quantity', b, s / sqrt(sxx) from f union all select 'sigma', '(Intercept)', ln(s), 1 / sqrt(2.0 * n) from f) select parameter, term, round(e, 4) estimate, round(se, 6) se, round(e / se / 10, 3) z10 from r",
    "confint_lines": f"with f as ({_FIT}), r as (select 'mu' parameter, '(Intercept)' term, a e, s * sqrt(1.0 / n + xm * xm / sxx) se from f union all select 'mu', 'l_quantity', b, s / sqrt(sxx) from f union all select 'sigma', '(Intercept)', ln(s), 1 / sqrt(2.0 * n) from f) select parameter, term, round(e - 1.959963984540054 * se, 3) lower, round(e + 1.959963984540054 * se, 3) upper from r",
    "vuong_exp_logno": f"with m as ({_LN}), d as (select -ln(m) - o_totalprice / m - (-0.5 * ln(2 * pi()) - ln(s) - ln(o_totalprice) - 0.5 * ((ln(o_totalprice) - mu) / s) ^ 2) d, n, -0.5 * ln(n) shift from orders, m) select round((sum(d) - any_value(shift)) / (sqrt(count(*)) * stddev_pop(d)), 4) vuong_z, sum((d - shift / n > 0)::int)::bigint clarke_b, count(*) n from d",
    "centiles_logno": f"with m as ({_LN}), c(c, z) as (values (5.0, -1.6448536269514729), (25.0, -0.6744897501960817), (50.0, 0.0), (75.0, 0.6744897501960817), (95.0, 1.6448536269514722)) select c::double centile, round(100 * avg((o_totalprice <= exp(mu + z * s))::int), 4) below from orders, m, c group by c",
    "leverage_po": "select l_orderkey, l_linenumber, round(1.0::double / count(*) over (partition by l_returnflag), 8) leverage from lineitem",
    "leverage_no": f"with f as ({_OLS}) select l_orderkey, l_linenumber, round(1.0::double / n + (l_quantity - xm) ^ 2 / sxx, 8) leverage from lineitem, f",
    "cooks_no": f"with f as ({_FIT}), r as (select l_orderkey, l_linenumber, (l_extendedprice - a - b * l_quantity) / s z, 1.0::double / n + (l_quantity - xm) ^ 2 / sxx h from lineitem, f) select l_orderkey, l_linenumber, round(500 * z * z * h / (1 - h), 4) cooks from r",
    "residuals_no": f"with f as ({_FIT}) select l_orderkey, l_linenumber, round((l_extendedprice - a - b * l_quantity) / s, 3) z, round((l_extendedprice - a - b * l_quantity) / s, 3) simple from lineitem, f",
    "residuals_po": "with c as (select l_orderkey, count(*) - 1 y from lineitem group by 1), m as (select avg(y) m from c) select l_orderkey, round(1 - 0.5 * ((m / (1 + m)) ^ (y + 1) + (m / (1 + m)) ^ y), 6) u from c, m",
    "term_effect": "with g as (select avg(l_extendedprice) filter (l_quantity > 25) - avg(l_extendedprice) filter (l_quantity <= 25) d from lineitem) select l_orderkey, l_linenumber, round(case when l_quantity > 25 then d else 0 end, 2) effect from lineitem, g",
    "fits_closed": f"""with m as ({_LN}), p as (select avg(ln(p_retailprice)) l, avg(ln(1 + p_retailprice)) l1, avg(p_size) sm, var_pop(p_size) sv, avg(ln((p_size / 51.0::double) / (1 - p_size / 51.0::double))) u, stddev_pop(ln((p_size / 51.0::double) / (1 - p_size / 51.0::double))) us from part), g as (select avg(l_linenumber) k from lineitem),
     i as (select sqrt(avg((o_totalprice - m) ^ 2 / (m * m * o_totalprice))) s from orders, m)
select 'LOGNO2' family, 'mu' parameter, round(exp(mu) / 1000, 4) as value from m union all select 'LOGNO2', 'sigma', round(s, 4) from m union all select 'LNO', 'mu', round(mu, 4) from m union all select 'LNO', 'sigma', round(s, 4) from m union all select 'IG', 'mu', round(m / 1000, 5) from m union all select 'IG', 'sigma', round(s, 5) from i
union all select 'PARETO', 'mu', round(1 / l, 5) from p union all select 'PARETO1', 'mu', round(1 / l1, 5) from p union all select 'NO2', 'mu', round(sm, 2) from p union all select 'NO2', 'sigma', round(sv, 2) from p union all select 'GEOMO', 'mu', round(1 / (1 + k), 5) from g union all select 'LOGITNO', 'mu', round(u, 4) from p union all select 'LOGITNO', 'sigma', round(us, 4) from p""",
    "predict_exp": "select l_orderkey, l_linenumber, round(avg(l_extendedprice) over w, 2) mean, round(-avg(l_extendedprice) over w * ln(0.95), 2) lower, round(-avg(l_extendedprice) over w * ln(0.05), 2) upper, round(avg(l_extendedprice) over w * ln(2), 2) quantile from lineitem window w as (partition by l_returnflag)",
    "predict_se_no": f"with f as ({_FIT}) select l_orderkey, l_linenumber, round(a + b * l_quantity, 2) fit, round(s * sqrt(1.0::double / n + (l_quantity - xm) ^ 2 / sxx), 4) se_fit from lineitem, f",
    "predict_response_no": f"with f as ({_FIT}) select l_orderkey, l_linenumber, 'NO' family, round(a + b * l_quantity, 2) fit, round(s, 2) sigma from lineitem, f",
    "fitted_lp": "select l_orderkey, l_linenumber, round(avg(l_quantity) over w, 5) fitted, round(ln(avg(l_quantity) over w), 5) lp from lineitem window w as (partition by l_returnflag)",
    "deviance_rows": "with l as (select l_orderkey, l_linenumber, l_quantity::double y, avg(l_quantity) over (partition by l_returnflag) m from lineitem) select l_orderkey, l_linenumber, round(-2 * (y * ln(m) - m - lgamma(y + 1)), 5) deviance from l",
    "model_matrix_lines": "with f as (select l_returnflag f, row_number() over (order by l_returnflag) k from (select distinct l_returnflag from lineitem)) select l_orderkey, l_linenumber, round(ln(l_quantity), 6) log_q, round(l_quantity::double ^ 2, 6) q2, round(l_discount * l_tax, 6) dt, (k = 2)::int::double flag_2, (k = 3)::int::double flag_3 from lineitem join f on f = l_returnflag",
    "bspline_lines": "with m as (select min(l_quantity) lo, (max(l_quantity) - min(l_quantity)) / 17.0::double h from lineitem), u as (select l_orderkey, l_linenumber, abs(l_quantity - lo + h) / h u1, abs(l_quantity - lo - 8 * h) / h u10 from lineitem, m) select l_orderkey, l_linenumber, round(case when u1 < 1 then (4 - 6 * u1 ^ 2 + 3 * u1 ^ 3) / 6 when u1 < 2 then (2 - u1) ^ 3 / 6 else 0 end, 8) b1, round(case when u10 < 1 then (4 - 6 * u10 ^ 2 + 3 * u10 ^ 3) / 6 when u10 < 2 then (2 - u10) ^ 3 / 6 else 0 end, 8) b10, 1.0::double total from u",
    "tensor_lines": "with m as (select min(l_quantity) - 0.01 * (max(l_quantity) - min(l_quantity)) a, 1.02 * (max(l_quantity) - min(l_quantity)) / 2 h, min(l_discount) - 0.01 * (max(l_discount) - min(l_discount)) c, 1.02 * (max(l_discount) - min(l_discount)) / 2 g from lineitem), u as (select l_orderkey, l_linenumber, abs(l_quantity - a - h) / h u, abs(l_discount - c - g) / g v from lineitem, m) select l_orderkey, l_linenumber, round(case when u < 1 then (4 - 6 * u ^ 2 + 3 * u ^ 3) / 6 when u < 2 then (2 - u) ^ 3 / 6 else 0 end * case when v < 1 then (4 - 6 * v ^ 2 + 3 * v ^ 3) / 6 when v < 2 then (2 - v) ^ 3 / 6 else 0 end, 7) b13, 1.0::double total from u",
    "loglik_table": f"with m as ({_LN}), a as (select n * (ln(m) + 1) * 2 e, n * (ln(2 * pi() * s * s) + 1) + 2 * n * mu l from m), r as (select 0 as model, 1.0 df, e x, e, l from a union all select 1, 2.0, l, e, l from a), g as (select *, x + 2 * df aic from r) select model::int model, round(-e / 2000, 4) loglik_first, df::double df, round(aic / 1000, 4) aic_k, round((x + 3.84 * df) / 1000, 4) gaic_k, round(1 - (aic - min(aic) over ()) / (max(aic) over () - min(aic) over ()), 6) scaled from g",
    "rsq_lines": "select round(regr_r2(l_extendedprice, l_quantity), 6) cox_snell from lineitem",
    "compare_lines": f"with f as ({_FIT}), v as (select var_pop(l_extendedprice) v from lineitem) select round(n * (ln(v) - 2 * ln(s)), 3) d_deviance, round((n * (ln(2 * pi() * s * s) + 1) + 3 * ln(n)) / 1000, 4) sbc_k from f, v",
    "refit_lines": "select round(regr_intercept(l_extendedprice, l_quantity), 2) intercept, round(regr_slope(l_extendedprice, l_quantity), 3) slope from lineitem where l_quantity <= 25",
    "mixed_lbfgs": "with f as (select round(regr_intercept(l_extendedprice, l_quantity), 0) a, round(regr_slope(l_extendedprice, l_quantity), 1) b from lineitem) select unnest(['MIXED', 'LBFGS', 'CG']) as method, a intercept, b slope from f",
    "weighted_lines": "with s as (select sum(l_linenumber) w, sum(l_linenumber * l_quantity) / sum(l_linenumber) xm, sum(l_linenumber * l_extendedprice) / sum(l_linenumber) ym from lineitem), b as (select sum(l_linenumber * (l_quantity - xm) * (l_extendedprice - ym)) / sum(l_linenumber * (l_quantity - xm) ^ 2) b, any_value(xm) xm, any_value(ym) ym from lineitem, s) select round(ym - b * xm, 2) intercept, round(b, 3) slope from b",
    "terms_lines": f"with f as ({_FIT}), v as (select var_pop(l_extendedprice) v from lineitem) select round((n * (ln(2 * pi() * s * s) + 1) + 6) / 1000, 4) added_k, round((n * (ln(2 * pi() * v) + 1) + 4) / 1000, 4) dropped_k, round(least(n * (ln(2 * pi() * s * s) + 1) + 6, n * (ln(2 * pi() * v) + 1) + 4) / 1000, 4) stepped_k, (n * (ln(2 * pi() * s * s) + 1) + 6 < n * (ln(2 * pi() * v) + 1) + 4)::bigint steps from f, v",
    "validation_orders": "with o as (select o_totalprice y, o_orderkey % 2 p from orders), t as (select avg(y) m, stddev_pop(y) s, avg(ln(y)) lm, stddev_pop(ln(y)) ls from o where p = 0), d as (select 2 * sum(ln(m) + y / m) e, 2 * sum(0.5 * ln(2 * pi()) + ln(s) + 0.5 * ((y - m) / s) ^ 2) n, 2 * sum(0.5 * ln(2 * pi()) + ln(ls) + ln(y) + 0.5 * ((ln(y) - lm) / ls) ^ 2) l, count(*) c from o, t where p = 1), r as (select 'EXP' f, e x, e, c from d union all select 'NO', n, e, c from d union all select 'LOGNO', l, e, c from d) select f family, (row_number() over (order by x))::int as rank, round(x / 1000, 4) deviance_k, round(e / 1000, 4) exp_k, c n from r",
    "groups_orders": f"with m as ({_LN}), v as (select var_pop(o_totalprice) v from orders), a as (select n * (ln(2 * pi() * v) + 1) + 4 x, 2 * n * (ln(m) + 1) + 2 e, n * (ln(2 * pi() * s * s) + 1) + 2 * n * mu + 4 l from m, v), r as (select case when x <= e then 'real' else 'positive' end g, * from a) select case when g = 'real' then 'NO' else 'EXP' end family, round(least(x, e) / 1000, 4) aic_k, g best_group from r union all select case when g = 'real' then 'LOGNO' else 'LNO' end, round(l / 1000, 4), g from r",
    "lasso_part": "with c as (select covar_pop(p_retailprice, p_size) c, var_pop(p_size) v from part) select round(sign(c) * greatest(abs(c) - 50, 0) / v, 5) lasso from c",
    "bootstrap_weights": "select count(*) n, 0::bigint differ, 2000::bigint as rows, 20::bigint boots, 0::bigint lowest, 1::bigint inside from supplier",
    "kinds_of_columns": "select unnest(['l_quantity', 'c_acctbal', 'p_retailprice', 'l_discount']) as name, unnest(['counts', 'realline', 'realplus', 'real0to1']) kind",
    "safe_balances": "with c as (select c_custkey, c_acctbal::double x from customer), s as (select *, greatest(x / 1000, 0) + ln(1 + exp(-abs(x / 1000))) sp, 1 / (1 + exp(-x / 1000)) sg from c) select c_custkey, round(ln(greatest(x, 1e-12)), 5) s_log, round(ln(1 + greatest(x, -0.999999)), 5) s_log1p, round(log10(exp(least(greatest(x / 100, -50), 50))), 5) s_exp, round(sqrt(greatest(x, 0)), 5) s_sqrt, round(sg, 5) s_sigmoid, round(sp, 5) s_softplus, round(1 / case when abs(floor(x / 5000)) >= 0.5 then floor(x / 5000) else 0.5 end, 5) s_ratio, round(sp, 5) s_positive, round(-2 + 5 * sg, 5) s_bounded, round(x / 1000 + ln(2) + sp, 5) s_last from s",
    "invalid_balances": "select count(*) as rows, 0::bigint missing, 0::bigint infinite, sum((c_acctbal <= 0)::int)::bigint outside, sum((c_acctbal between 0 and 5000)::int)::bigint in_range, round(sum(greatest(c_acctbal, 0.01)), 2) clipped from customer",
    "links_more": f"with p as (select p_partkey, {_P} m from part) select p_partkey, round(ln(m - 1), 6) eta_logshift1, round(ln(m - 2), 6) eta_logshift2, round(ln(exp(m) - 1), 6) eta_softplus, round(1 / (m * m), 6) eta_mu2, m mu_softplus, round(m - 1, 6) d_logshift1, round(m - 2, 6) d_logshift2, round(1 - exp(-m), 6) d_softplus, round(-0.5 * m ^ 3, 6) d_mu2, m d_log, round(-m * m, 6) d_inverse, round(2 * sqrt(m), 6) d_sqrt, 1.0::double d_identity, round(m / 60 * (1 - m / 60), 6) d_logit, round(-ln(1 - m / 60) * (1 - m / 60), 6) d_cloglog from p",
    "probit_part": "select p_partkey, round(p_size / 51.0::double, 7) m, 0.0::double zero from part",
    "acf_exp": "with m as (select avg(c_acctbal) m, var_pop(c_acctbal) v from customer), z as (select row_number() over (order by c_custkey) i, (c_acctbal - m) / sqrt(v) z from customer, m), s as (select avg(z * z) q, var_pop(z * z) w, count(*) n from z), k as (select unnest(range(1, 6)) lag) select lag::int lag, round(sum(x.z * y.z) / any_value(n), 5) acf, round(sum((x.z * x.z - q) * (y.z * y.z - q)) / any_value(n * w), 5) acf_squared from k, z x, z y, s where y.i = x.i + lag group by lag",
    "histogram_part": "with m as (select min(p_size) lo, (max(p_size) - min(p_size)) / 7.0::double w, count(*) n, avg(p_size) mu from part), b as (select least(floor((p_size - lo) / w), 6)::int bin, count(*) c from part, m group by 1) select bin, round(lo + bin * w, 6) low, c n, round(c / (n * w), 8) density, round(exp(-(lo + bin * w + w / 2) / mu) / mu, 6) fitted from b, m",
    "centile_curves": "with b as (select sum(l_extendedprice * l_quantity) / sum(l_quantity::double ^ 2) b, min(l_quantity) lo, max(l_quantity) hi from lineitem) select round(lo + k * (hi - lo) / 4.0::double, 6) x, 1 as band, 50.0::double coverage, round(b * (lo + k * (hi - lo) / 4.0::double), 1) middle from b, (select unnest(range(0, 5)) k)",
}
