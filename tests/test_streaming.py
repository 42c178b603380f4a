import numpy as np
import pandas as pd

from shapecast.operators.fit import gamlss
from shapecast.streaming.scoring import score_stream, windowed_gram, windowed_scores


def test_a_stream_is_scored_in_windows(spark, tmp_path):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"ts": pd.date_range("2024-01-01", periods=400, freq="1min"), "x": rng.uniform(size=400)})
    pdf["y"] = 1 + pdf.x + rng.normal(0, 0.1, 400)
    df = spark.createDataFrame(pdf)
    df.write.parquet(f"{tmp_path}/in")
    m = gamlss("y ~ x", df)
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = windowed_scores(m, stream, "ts").writeStream.outputMode("append").format("memory").queryName("scores").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.sql("select * from scores").collect()
    assert sum(r["n"] for r in rows) >= 300 and all(0.3 < r["cdf"] < 0.7 for r in rows)
    assert score_stream(m, df).count() == 400
    assert windowed_gram(df, "y", ["x"], "ts").agg({"n": "sum"}).first()[0] == 400
