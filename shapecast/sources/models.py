"""Models as tables: coefficients in Parquet and one JSON row of metadata, checked on reading; nothing executable is stored."""

from __future__ import annotations

import json
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..functions.families import resolve
from ..operators.fit import Model
from ..plans.formula import design, parse

VERSION = 1
COEFFICIENTS = "parameter string, position int, term string, estimate double"


def save_model(model: Model, spark: SparkSession, path: str) -> None:
    """Writes path/coefficients and path/metadata, wherever Spark can write."""
    rows = [(p, i, n, float(b)) for p in model.parameters for i, (n, b) in enumerate(zip(model.designs[p].names, model.coefficients[p], strict=True))]
    spark.createDataFrame(rows, COEFFICIENTS).coalesce(1).write.mode("overwrite").parquet(f"{path}/coefficients")
    meta = {
        "version": VERSION, "family": model.family.name, "links": model.family.links, "deviance": model.deviance, "df": model.penalised_df, "n": model.n, "iterations": model.iterations, "converged": model.converged, "method": model.method,
        "designs": {p: d.schema() | {"response": d.formula.response, "text": _text(d)} for p, d in model.designs.items()}, "lambdas": model.lambdas, "edf": model.edf, "fixed": model.fixed, "weights": model.weights, "vcov": None if model.vcov is None else model.vcov.tolist(),
    }
    spark.createDataFrame([(json.dumps(meta),)], "metadata string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def _text(d) -> str:
    """The formula with its smoothers' options."""
    def one(t):
        if t.options:
            return f"{t.kind}({', '.join([*t.args, *(f'{k}={v!r}' for k, v in t.options.items())])})"
        return t.label

    f = d.formula
    return f"{f.response or ''} ~ {' + '.join(map(one, f.terms)) or '1'}{'' if f.intercept else ' - 1'}"


def _metadata(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/metadata").first()[0])


def validate_model(spark: SparkSession, path: str) -> list[dict]:
    """Issues of a stored model: (level, code, message); an empty list is a good one."""
    issues = []

    def say(level: str, code: str, message: str) -> None:
        issues.append({"level": level, "code": code, "message": message})

    try:
        meta = _metadata(spark, path)
    except Exception as e:  # noqa: BLE001  whatever can't be read is an issue
        return [{"level": "error", "code": "metadata", "message": str(e)[:200]}]
    if meta.get("version") != VERSION:
        say("error", "version", f"version {meta.get('version')}, not {VERSION}")
    missing = {"family", "links", "designs", "deviance", "n"} - set(meta)
    if missing:
        say("error", "keys", f"missing: {sorted(missing)}")
        return issues
    try:
        fam = resolve(meta["family"]).with_links(**meta["links"])
        rows = spark.read.schema(COEFFICIENTS).parquet(f"{path}/coefficients").collect()
        for p in fam.parameters:
            want = meta["designs"][p]["columns"]
            have = [r["term"] for r in sorted((r for r in rows if r["parameter"] == p), key=lambda r: r["position"])]
            if want != have:
                say("error", "coefficients", f"{p}: {have} for {want}")
        if any(r["estimate"] is None or not np.isfinite(r["estimate"]) for r in rows):
            say("error", "finite", "a coefficient isn't finite")
    except Exception as e:  # noqa: BLE001
        say("error", "unreadable", str(e)[:200])
    if not meta.get("converged"):
        say("warning", "converged", "the fit did not converge")
    return issues


def load_model(spark: SparkSession, path: str) -> Model:
    errors = [x for x in validate_model(spark, path) if x["level"] == "error"]
    if errors:
        raise ValueError("; ".join(x["message"] for x in errors))
    meta = _metadata(spark, path)
    fam = resolve(meta["family"]).with_links(**meta["links"])
    designs = {p: design(parse(x["text"]), x["levels"], {k: tuple(v) for k, v in x["ranges"].items()}) for p, x in meta["designs"].items()}
    rows = spark.read.schema(COEFFICIENTS).parquet(f"{path}/coefficients").collect()
    beta = {p: np.array([r["estimate"] for r in sorted((r for r in rows if r["parameter"] == p), key=lambda r: r["position"])]) for p in fam.parameters}
    return Model(fam, designs, beta, meta["deviance"], meta["df"], meta["n"], meta["iterations"], meta["converged"], meta["method"], [], meta["lambdas"], meta["edf"], None if meta["vcov"] is None else np.array(meta["vcov"]), meta["fixed"], meta["weights"])


class ModelRegistry:
    """Models under names in one folder, in a table partitioned by model: the newest `most` stay."""

    def __init__(self, spark: SparkSession, folder: str, most: int = 200):
        self.spark, self.folder, self.most = spark, folder.rstrip("/"), most

    def _index(self) -> DataFrame:
        schema = "name string, at timestamp, family string, deviance double"
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/index")
        except Exception:  # noqa: BLE001  no model yet
            return self.spark.createDataFrame([], schema)

    def put(self, name: str, model: Model) -> None:
        if not re.fullmatch(r"[\w.-]+", name):
            raise ValueError(f"{name!r}: letters, digits, _ . and - only")
        save_model(model, self.spark, f"{self.folder}/{name}")
        self.spark.createDataFrame([(name, model.family.name, float(model.deviance))], "name string, family string, deviance double").selectExpr("name", "current_timestamp() at", "family", "deviance").write.mode("append").parquet(f"{self.folder}/index")
        for old in self._index().groupBy("name").agg({"at": "max"}).withColumnRenamed("max(at)", "at").orderBy("at", ascending=False).offset(self.most).collect():
            self._delete(old["name"])

    def _delete(self, name: str) -> None:
        """Deletes a model's folder; the index keeps its rows, and list() leaves out what is gone."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def list(self) -> DataFrame:
        return self._index().groupBy("name").agg({"at": "max"}).withColumnRenamed("max(at)", "at").orderBy("at", ascending=False).limit(self.most)

    def get(self, name: str) -> Model:
        return load_model(self.spark, f"{self.folder}/{name}")
