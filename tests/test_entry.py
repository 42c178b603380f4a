import __spark_entry__ as entry


def test_the_flagship_query_runs(spark):
    assert entry.entry(spark).count() == 1


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_quantiles_and_bootstrap_use_every_row(spark, monkeypatch):
    import numpy as np

    from shapecast import queries
    from shapecast.operators import predict, resample

    seen, whole = {}, predict.predict_quantiles
    monkeypatch.setattr(predict, "predict_quantiles", lambda m, df, p: seen.update(orders=df.count()) or whole(m, df, p))
    monkeypatch.setattr(resample, "nonparametric_bootstrap", lambda formula, df, family, boots: seen.update(boots=boots) or {"estimates": np.zeros((boots, 1))})
    sf = "/root/testdata/sf0.001"
    assert queries.predict_quantiles_logno(spark, sf).count() == 1 and queries.bootstrap_exp(spark, sf).count() == 200
    assert seen == {"orders": spark.read.parquet(f"{sf}/orders.parquet").count(), "boots": 200}
