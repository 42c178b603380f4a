"""Registered queries over the supplied tables, with the SQL that gives the same rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dist
from .functions.expr import to_column, var
from .functions.links import LINKS
from .operators import diagnose, fit, predict, regularize, score, select, stats


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _coefs(spark: SparkSession, model: fit.Model, digits: int = 4) -> DataFrame:
    rows = [(p, n, round(float(b), digits)) for p in model.parameters for n, b in zip(model.designs[p].names, model.coefficients[p], strict=True)]
    return spark.createDataFrame(rows, "parameter string, term string, estimate double")


def _one(spark: SparkSession, **values) -> DataFrame:
    return spark.createDataFrame([tuple(v if isinstance(v, int) else float(v) for v in values.values())], ", ".join(f"{k} {'bigint' if isinstance(v, int) else 'double'}" for k, v in values.items()))


def _no(spark, sf):
    return fit.gamlss("l_extendedprice ~ l_quantity", _t(spark, sf, "lineitem"), "NO")


def fit_no_price(spark, sf):
    m = _no(spark, sf)
    b = m.coef()
    return _one(spark, intercept=round(b["(Intercept)"], 3), slope=round(b["l_quantity"], 4), sigma=round(math.exp(m.coefficients["sigma"][0]), 3))


def fit_no_rs(spark, sf):
    m = fit.gamlss("l_extendedprice ~ l_quantity", _t(spark, sf, "lineitem"), "NO", method="RS")
    b = m.coef()
    return _one(spark, intercept=round(b["(Intercept)"], 2), slope=round(b["l_quantity"], 3))


def fit_no_factor(spark, sf):
    return _coefs(spark, fit.gamlss("l_extendedprice ~ factor(l_returnflag)", _t(spark, sf, "lineitem"), "NO")).where("parameter = 'mu'").select("term", F.round("estimate", 2).alias("estimate"))


def fit_exp_value(spark, sf):
    m = fit.gamlss("value ~ 1", _t(spark, sf, "events").where("value > 0"), "EXP")
    return _one(spark, mu=round(math.exp(m.coefficients["mu"][0]), 4))


def fit_po_quantity(spark, sf):
    return _coefs(spark, fit.gamlss("l_quantity ~ factor(l_returnflag)", _t(spark, sf, "lineitem"), "PO"), 5)


def fit_logno_total(spark, sf):
    m = fit.gamlss("o_totalprice ~ 1", _t(spark, sf, "orders"), "LOGNO")
    return _one(spark, mu=round(m.coefficients["mu"][0], 5), sigma=round(math.exp(m.coefficients["sigma"][0]), 5))


def _lines(spark, sf):
    return _t(spark, sf, "lineitem").groupBy("l_orderkey").agg((F.count("*") - 1).cast("double").alias("more"))


def fit_geom_lines(spark, sf):
    m = fit.gamlss("more ~ 1", _lines(spark, sf), "GEOM")
    return _one(spark, mu=round(math.exp(m.coefficients["mu"][0]), 5))


def fit_bi_quality(spark, sf):
    m = fit.gamlss("quality ~ 1", _t(spark, sf, "labels"), "BI")
    return _one(spark, p=round(1 / (1 + math.exp(-m.coefficients["mu"][0])), 6))


def gaic_rank(spark, sf):
    rows = select.compare_distributions("o_totalprice ~ 1", _t(spark, sf, "orders"), ["NO", "EXP", "LOGNO"])
    return spark.createDataFrame([(r["family"], i, round(r["criterion"] / 1000, 4)) for i, r in enumerate(rows, 1)], "family string, rank int, aic_k double")


def lr_nested(spark, sf):
    li = _t(spark, sf, "lineitem")
    a, b = fit.gamlss("l_extendedprice ~ 1", li, vcov=False), _no(spark, sf)
    return _one(spark, chi2=round(stats.likelihood_ratio_test(a, b)["chi2"], 3))


def predict_params_no(spark, sf):
    out = predict.predict_params(_no(spark, sf), _t(spark, sf, "lineitem"))
    return out.select("l_orderkey", "l_linenumber", F.round("mu", 2).alias("mu"), F.round("sigma", 2).alias("sigma"))


def predict_quantiles_logno(spark, sf):
    m = fit.gamlss("o_totalprice ~ 1", _t(spark, sf, "orders"), "LOGNO")
    return predict.predict_quantiles(m, _t(spark, sf, "orders"), (0.5,)).select(F.round(F.log("q50"), 5).alias("log_median")).distinct()


def score_no(spark, sf):
    m, li = _no(spark, sf), _t(spark, sf, "lineitem")
    return _one(spark, log_score=round(score.log_score(m, li), 5), dss=round(score.dss(m, li), 5))


def qq_ranks(spark, sf):
    c = _t(spark, sf, "customer").select("c_custkey", "c_acctbal")
    r, _ = diagnose.ranked(c, ["c_acctbal", "c_custkey"])
    return r.select("c_custkey", F.col("rank").cast("bigint").alias("rank"))


def acf_events(spark, sf):
    e = _t(spark, sf, "events")
    return diagnose.acf(e, "value", "event_id", 10).select("lag", F.round("acf", 6).alias("acf"))


def q_stats_intervals(spark, sf):
    li, _ = diagnose.cut(_t(spark, sf, "lineitem"), "l_quantity", 4)
    return li.groupBy("interval").agg(F.count("*").alias("n"), F.round(F.avg("l_extendedprice"), 2).alias("mean"), F.round(F.skewness("l_discount"), 5).alias("skew"))


def cv_folds(spark, sf):
    r = select.gamlss_cv("o_totalprice ~ 1", _t(spark, sf, "orders").withColumn("f", F.pmod("o_orderkey", F.lit(4)).cast("int")).select("o_totalprice", "f"), "EXP", fold="f")
    return spark.createDataFrame([(int(k), round(v / 1000, 4)) for k, v in r["folds"].items()], "fold int, deviance_k double")


def ridge_price(spark, sf):
    r = regularize.fit_ridge(_t(spark, sf, "part"), "p_retailprice", ["p_size"], 100.0)
    return _one(spark, coef=round(float(r["coef"][0]), 6))


def gram_part(spark, sf):
    g = regularize.gram(_t(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"])
    m = g["full"]
    return _one(spark, n=int(g["n"]), qq=round(m[0, 0], 2), qd=round(m[0, 1], 3), dd=round(m[1, 1], 5))


def links_part(spark, sf):
    """All links of p_size / 60 and back."""
    p = _t(spark, sf, "part").select("p_partkey", ((F.col("p_size") + 1) / 60.0).alias("m"))
    names = ["identity", "log", "logit", "cloglog", "inverse", "sqrt"]
    eta = [F.round(to_column(LINKS[n].link(var("m")), {"m": F.col("m")}), 6).alias(f"eta_{n}") for n in names]
    back = [F.round(to_column(LINKS[n].inverse(var("e")), {"e": to_column(LINKS[n].link(var("m")), {"m": F.col("m")})}), 6).alias(f"mu_{n}") for n in names]
    return p.select("p_partkey", *eta, *back)


_DENSITIES = {
    "no": ("NO", {"mu": 1500.0, "sigma": 300.0}), "exp": ("EXP", {"mu": 1500.0}), "lo": ("LO", {"mu": 1500.0, "sigma": 200.0}), "gu": ("GU", {"mu": 1500.0, "sigma": 300.0}), "rg": ("RG", {"mu": 1500.0, "sigma": 300.0}),
    "pareto2": ("PARETO2", {"mu": 1500.0, "sigma": 0.5}), "logno": ("LOGNO", {"mu": 7.0, "sigma": 0.3}), "wei": ("WEI", {"mu": 1500.0, "sigma": 2.0}), "ig": ("IG", {"mu": 1500.0, "sigma": 0.01}),
}
_COUNTS = {"po": ("PO", {"mu": 20.0}), "geom": ("GEOM", {"mu": 20.0}), "nbi": ("NBI", {"mu": 20.0, "sigma": 0.5}), "nbii": ("NBII", {"mu": 20.0, "sigma": 2.0}), "zip": ("ZIP", {"mu": 20.0, "sigma": 0.2})}


def densities_part(spark, sf):
    p = _t(spark, sf, "part")
    return p.select("p_partkey", *[F.round(dist.density_column(f, F.col("p_retailprice"), {k: F.lit(v) for k, v in q.items()}), 6).alias(f"d_{n}") for n, (f, q) in _DENSITIES.items()])


def cdfs_part(spark, sf):
    p = _t(spark, sf, "part")
    return p.select("p_partkey", *[F.round(dist.cdf_column(f, F.col("p_retailprice"), {k: F.lit(v) for k, v in q.items()}), 6).alias(f"p_{n}") for n, (f, q) in _DENSITIES.items() if n not in ("no", "logno", "ig")])


def densities_gamma(spark, sf):
    li = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("y"))
    out = li
    for n, (f, q) in {**_COUNTS, "ga": ("GA", {"mu": 20.0, "sigma": 0.7})}.items():
        out = out.withColumn(f"d_{n}", F.round(dist.density_column(f, F.col("y"), {k: F.lit(v) for k, v in q.items()}), 6))
    return out.drop("y")


def gaic_weights_orders(spark, sf):
    o = _t(spark, sf, "orders")
    a, b = fit.gamlss("o_totalprice ~ 1", o, "EXP", vcov=False), fit.gamlss("o_totalprice ~ 1", o, "LOGNO", vcov=False)
    w = stats.gaic_weights(a, b)
    return _one(spark, w_exp=round(w[0], 6), w_logno=round(w[1], 6))


def bootstrap_counts(spark, sf):
    """A resample by given indices: supplier (7 k) mod n."""
    s = _t(spark, sf, "supplier")
    from .operators.resample import resample

    n = s.count()
    idx = s.select((F.pmod(F.col("s_suppkey") * 7, F.lit(n)) + 1).cast("bigint").alias("index"))
    return resample(s, idx, "s_suppkey").groupBy("s_nationkey").agg(F.count("*").alias("n"), F.round(F.sum("s_acctbal"), 2).alias("total"))


def fit_groups_price(spark, sf):
    g = fit.fit_groups(_t(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice ~ l_quantity", "NO", task_rows=20_000).where("parameter = 'mu'")
    return g.select("l_returnflag", "term", F.round("estimate", 2).alias("estimate"))


def fit_smooth_price(spark, sf):
    m = fit.gamlss("l_extendedprice ~ pb(l_quantity)", _t(spark, sf, "lineitem"), "NO")
    return _one(spark, deviance=m.deviance, edf=m.df_fit)


def fit_ga_total(spark, sf):
    m = fit.gamlss("o_totalprice ~ 1", _t(spark, sf, "orders"), "GA")
    return _one(spark, mu=round(math.exp(m.coefficients["mu"][0]), 2))


def fit_dist_acctbal(spark, sf):
    rows = select.fit_dist(_t(spark, sf, "supplier"), "s_acctbal", "realline")
    return spark.createDataFrame([(r["family"], float(r["criterion"]) if math.isfinite(r["criterion"]) else None) for r in rows], "family string, gaic double")


def bootstrap_exp(spark, sf):
    from .operators.resample import nonparametric_bootstrap

    est = nonparametric_bootstrap("s_acctbal ~ 1", _t(spark, sf, "supplier").where("s_acctbal > 0"), "EXP", 200)["estimates"]
    return spark.createDataFrame([(b, "mu", float(x[0])) for b, x in enumerate(est)], "boot long, parameter string, estimate double")


QUERIES = {f.__name__: f for f in (fit_no_price, fit_no_rs, fit_no_factor, fit_exp_value, fit_po_quantity, fit_logno_total, fit_geom_lines, fit_bi_quality, gaic_rank, lr_nested, predict_params_no, predict_quantiles_logno, score_no, qq_ranks, acf_events, q_stats_intervals, cv_folds, ridge_price, gram_part, links_part, densities_part, cdfs_part, densities_gamma, gaic_weights_orders, bootstrap_counts, fit_groups_price, fit_smooth_price, fit_ga_total, fit_dist_acctbal, bootstrap_exp)}

_NO = "select regr_slope(l_extendedprice, l_quantity) b, regr_intercept(l_extendedprice, l_quantity) a from lineitem"
_SD = f"select a, b, sqrt(avg((l_extendedprice - a - b * l_quantity) ^ 2)) s from lineitem, ({_NO}) group by a, b"
ORACLES = {
    "fit_no_price": f"select round(a, 3) intercept, round(b, 4) slope, round(s, 3) sigma from ({_SD})",
    "fit_no_rs": f"select round(a, 2) intercept, round(b, 3) slope from ({_NO})",
    "fit_no_factor": "with g as (select l_returnflag f, avg(l_extendedprice) m from lineitem group by 1), b as (select m from g order by f limit 1) select case when g.f = (select min(f) from g) then '(Intercept)' else 'factor(l_returnflag)' || g.f end term, round(case when g.f = (select min(f) from g) then g.m else g.m - b.m end, 2) estimate from g, b",
    "fit_exp_value": "select round(avg(value), 4) mu from events where value > 0",
    "fit_po_quantity": "with g as (select l_returnflag f, ln(avg(l_quantity)) m from lineitem group by 1), b as (select m from g order by f limit 1) select 'mu' parameter, case when g.f = (select min(f) from g) then '(Intercept)' else 'factor(l_returnflag)' || g.f end term, round(case when g.f = (select min(f) from g) then g.m else g.m - b.m end, 5) estimate from g, b",
    "fit_logno_total": "select round(avg(ln(o_totalprice)), 5) mu, round(stddev_pop(ln(o_totalprice)), 5) sigma from orders",
    "fit_geom_lines": "select round(avg(n - 1), 5) mu from (select count(*) n from lineitem group by l_orderkey)",
    "fit_bi_quality": "select round(avg(quality), 6) p from labels",
    "gaic_rank": "with s as (select count(*) n, avg(o_totalprice) m, var_pop(o_totalprice) v, avg(ln(o_totalprice)) lm, var_pop(ln(o_totalprice)) lv from orders), a as (select 'NO' family, n * (ln(2 * pi() * v) + 1) + 4 x from s union all select 'EXP', 2 * n * (ln(m) + 1) + 2 from s union all select 'LOGNO', n * (ln(2 * pi() * lv) + 1) + 2 * n * lm + 4 from s) select family, row_number() over (order by x, family)::int as rank, round(x / 1000, 4) aic_k from a",
    "lr_nested": f"select round(count(*) * (ln(var_pop(l_extendedprice)) - 2 * ln(any_value(s))), 3) chi2 from lineitem, ({_SD})",
    "predict_params_no": f"select l_orderkey, l_linenumber, round(a + b * l_quantity, 2) mu, round(s, 2) sigma from lineitem, ({_SD})",
    "predict_quantiles_logno": "select round(avg(ln(o_totalprice)), 5) log_median from orders",
    "score_no": f"select round(avg(0.5 * ln(2 * pi()) + ln(s) + (l_extendedprice - a - b * l_quantity) ^ 2 / (2 * s * s)), 5) log_score, round(avg(((l_extendedprice - a - b * l_quantity) / s) ^ 2 + 2 * ln(s)), 5) dss from lineitem, ({_SD})",
    "qq_ranks": "select c_custkey, row_number() over (order by c_acctbal, c_custkey) as rank from customer",
    "acf_events": "with m as (select avg(value) m, var_pop(value) v, count(*) n from events), e as (select row_number() over (order by event_id) i, value - m d from events, m), k as (select unnest(range(1, 11)) lag) select lag::int lag, round(sum(x.d * y.d) / any_value(n * v), 6) acf from k, e x, e y, m where y.i = x.i + lag group by lag",
    "q_stats_intervals": "with m as (select min(l_quantity) lo, max(l_quantity) hi from lineitem) select (1 + (l_quantity >= lo + (hi - lo) / 4)::int + (l_quantity >= lo + (hi - lo) / 2)::int + (l_quantity >= lo + (hi - lo) * 3 / 4)::int)::int as interval, count(*) n, round(avg(l_extendedprice), 2) mean, round((avg(l_discount ^ 3) - 3 * avg(l_discount) * avg(l_discount ^ 2) + 2 * avg(l_discount) ^ 3) / var_pop(l_discount) ^ 1.5, 5) skew from lineitem, m group by 1",
    "cv_folds": "with o as (select o_totalprice y, (o_orderkey % 4)::int f from orders), t as (select a.f, (select avg(y) from o b where b.f <> a.f) m from (select distinct f from o) a) select f fold, round(2 * sum(ln(m) + y / m) / 1000, 4) deviance_k from o join t using (f) group by f",
    "ridge_price": "select round(covar_pop(p_retailprice, p_size) * count(*) / (var_pop(p_size) * count(*) + 100), 6) coef from part",
    "gram_part": "select count(*) n, round(var_pop(l_quantity) * count(*), 2) qq, round(covar_pop(l_quantity, l_discount) * count(*), 3) qd, round(var_pop(l_discount) * count(*), 5) dd from lineitem",
    "links_part": "with p as (select p_partkey, (p_size + 1) / 60.0::double m from part) select p_partkey, round(m, 6) eta_identity, round(ln(m), 6) eta_log, round(ln(m / (1 - m)), 6) eta_logit, round(ln(-ln(1 - m)), 6) eta_cloglog, round(1 / m, 6) eta_inverse, round(sqrt(m), 6) eta_sqrt, round(m, 6) mu_identity, round(m, 6) mu_log, round(m, 6) mu_logit, round(m, 6) mu_cloglog, round(m, 6) mu_inverse, round(m, 6) mu_sqrt from p",
    "densities_part": "with p as (select p_partkey, p_retailprice::double y from part) select p_partkey, round(-0.5 * ln(2 * pi()) - ln(300) - ((y - 1500) / 300) ^ 2 / 2, 6) d_no, round(-ln(1500) - y / 1500, 6) d_exp, round(-(y - 1500) / 200 - ln(200) - 2 * ln(1 + exp(-(y - 1500) / 200)), 6) d_lo, round((y - 1500) / 300 - exp((y - 1500) / 300) - ln(300), 6) d_gu, round(-(y - 1500) / 300 - exp(-(y - 1500) / 300) - ln(300), 6) d_rg, round(-ln(0.5) + 2 * ln(1500) - 3 * ln(y + 1500), 6) d_pareto2, round(-ln(y) - 0.5 * ln(2 * pi()) - ln(0.3) - ((ln(y) - 7) / 0.3) ^ 2 / 2, 6) d_logno, round(ln(2) - 2 * ln(1500) + ln(y) - (y / 1500) ^ 2, 6) d_wei, round(-0.5 * ln(2 * pi()) - ln(0.01) - 1.5 * ln(y) - (y - 1500) ^ 2 / (2 * 1500.0 ^ 2 * 0.0001 * y), 6) d_ig from p",
    "cdfs_part": "with p as (select p_partkey, p_retailprice::double y from part) select p_partkey, round(1 - exp(-y / 1500), 6) p_exp, round(1 / (1 + exp(-(y - 1500) / 200)), 6) p_lo, round(1 - exp(-exp((y - 1500) / 300)), 6) p_gu, round(exp(-exp(-(y - 1500) / 300)), 6) p_rg, round(1 - (1500 / (y + 1500)) ^ 2, 6) p_pareto2, round(1 - exp(-((y / 1500) ^ 2)), 6) p_wei from p",
    "densities_gamma": "with l as (select l_orderkey, l_linenumber, l_quantity::double y from lineitem) select l_orderkey, l_linenumber, round(y * ln(20) - 20 - lgamma(y + 1), 6) d_po, round(y * ln(20) - (y + 1) * ln(21), 6) d_geom, round(lgamma(y + 2) - lgamma(2) - lgamma(y + 1) + 2 * ln(2 / 22.0) + y * ln(20 / 22.0), 6) d_nbi, round(lgamma(y + 10) - lgamma(10) - lgamma(y + 1) + 10 * ln(10 / 30.0) + y * ln(20 / 30.0), 6) d_nbii, round(ln(0.8) + y * ln(20) - 20 - lgamma(y + 1), 6) d_zip, round((1 / 0.49 - 1) * ln(y) - y / (20 * 0.49) - lgamma(1 / 0.49) - ln(20 * 0.49) / 0.49, 6) d_ga from l",
    "gaic_weights_orders": "with s as (select count(*) n, avg(o_totalprice) m, avg(ln(o_totalprice)) lm, var_pop(ln(o_totalprice)) lv from orders), a as (select 2 * n * (ln(m) + 1) + 2 e, n * (ln(2 * pi() * lv) + 1) + 2 * n * lm + 4 l from s) select round(exp(-(e - least(e, l)) / 2) / (exp(-(e - least(e, l)) / 2) + exp(-(l - least(e, l)) / 2)), 6) w_exp, round(exp(-(l - least(e, l)) / 2) / (exp(-(e - least(e, l)) / 2) + exp(-(l - least(e, l)) / 2)), 6) w_logno from a",
    "bootstrap_counts": "with n as (select count(*) n from supplier), i as (select (s_suppkey * 7) % n + 1 idx from supplier, n) select s_nationkey, count(*) n, round(sum(s_acctbal), 2) total from i join supplier on s_suppkey = idx group by 1",
    "fit_groups_price": "with g as (select l_returnflag, regr_slope(l_extendedprice, l_quantity) b, regr_intercept(l_extendedprice, l_quantity) a from lineitem group by 1) select l_returnflag, '(Intercept)' term, round(a, 2) estimate from g union all select l_returnflag, 'l_quantity', round(b, 2) from g",
    "fit_ga_total": "select round(avg(o_totalprice), 2) mu from orders",
}

from . import queries_families as _families  # noqa: E402
from . import queries_models as _models  # noqa: E402

QUERIES |= _families.QUERIES | _models.QUERIES
ORACLES |= _families.ORACLES | _models.ORACLES
