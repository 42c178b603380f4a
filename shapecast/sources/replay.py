"""Runs that can be repeated: locks over what a run depends on, stored artifacts, comparison, and named data sets."""

from __future__ import annotations

import hashlib
import json
import math
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dist


def _digest(part) -> str:
    return hashlib.sha256(json.dumps(part, sort_keys=True, default=str).encode()).hexdigest()


def artifact_lock(runtime: dict, solver: dict, family_version: str) -> dict[str, str]:
    """A hash each of runtime settings, solver settings and the family's version."""
    return {"runtime": _digest(runtime), "solver": _digest(solver), "family": _digest(family_version)}


def write_artifact(spark: SparkSession, path: str, artifact: dict) -> None:
    """One JSON line, wherever Spark can write."""
    spark.createDataFrame([(json.dumps(artifact, sort_keys=True),)], "artifact string").coalesce(1).write.mode("overwrite").text(path)


def read_artifact(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def differences(a, b, atol: float = 1e-12, at: str = "") -> list[str]:
    """Paths at which two nested values differ by more than atol."""
    if isinstance(a, dict) and isinstance(b, dict):
        return [d for k in sorted(set(a) | set(b)) for d in (differences(a[k], b[k], atol, f"{at}.{k}") if k in a and k in b else [f"{at}.{k}"])]
    if isinstance(a, (list, tuple)) and isinstance(b, (list, tuple)):
        return [f"{at}.length"] if len(a) != len(b) else [d for i, (x, y) in enumerate(zip(a, b, strict=True)) for d in differences(x, y, atol, f"{at}[{i}]")]
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool):
        return [] if a == b or math.isnan(a) and math.isnan(b) or abs(a - b) <= atol else [at]
    return [] if a == b else [at]


def replay(artifact: dict, runner: Callable[[dict], object], atol: float = 1e-12) -> dict:
    """Runs artifact["inputs"] again and compares with artifact["result"]: {"same", "differences", "result"}."""
    result = runner(artifact["inputs"])
    found = differences(artifact["result"], result, atol)
    return {"same": not found, "differences": found, "result": result}


class Datasets:
    """Builders of DataFrames by name."""

    def __init__(self):
        self._builders: dict[str, Callable[..., DataFrame]] = {}

    def register(self, name: str, builder: Callable[..., DataFrame]) -> None:
        if name in self._builders:
            raise ValueError(f"{name!r} is taken")
        self._builders[name] = builder

    def names(self) -> list[str]:
        return sorted(self._builders)

    def build(self, spark: SparkSession, name: str, n: int = 1000, seed: int = 0) -> DataFrame:
        if name not in self._builders:
            raise ValueError(f"unknown data set {name!r}; known: {self.names()}")
        return self._builders[name](spark, n, seed)


def uniform(seed: int, salt: int):
    """A uniform number in (0, 1) from the row's id: the same whatever the partitions."""
    return (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def _drawn(family: str, params: dict):
    """Rows (id, x, y): y by inversion with mu = exp(0.5 + x) or 1 + 2 x."""
    def build(spark, n, seed):
        x = uniform(seed, 1)
        mu = 1 + 2 * F.col("x") if family == "NO" else F.exp(0.5 + F.col("x"))
        df = spark.range(n).withColumn("x", x).withColumn("__u", uniform(seed, 2)).withColumn("__mu", mu)
        for k, v in params.items():
            df = df.withColumn(f"__{k}", F.lit(v))
        return dist.with_values(df, family, "q", "__u", "y", {"mu": "__mu", **{k: f"__{k}" for k in params}}).select("id", "x", "y")

    return build


def default_datasets() -> Datasets:
    out = Datasets()
    for name, family, params in (("normal", "NO", {"sigma": 0.5}), ("gamma", "GA", {"sigma": 0.4}), ("poisson", "PO", {}), ("negative_binomial", "NBI", {"sigma": 0.5}), ("weibull", "WEI", {"sigma": 2.0}), ("zero_inflated", "ZIP", {"sigma": 0.2})):
        out.register(name, _drawn(family, params))
    return out
