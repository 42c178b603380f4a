"""What a run did: optimizer traces as tables, timed sections, and events as JSON lines."""

from __future__ import annotations

import json
import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from .fit import Control, Model, gamlss


def optimizer_trace(model: Model, spark: SparkSession) -> DataFrame:
    """(iteration, deviance, change) of a fit."""
    rows, last = [], None
    for it, dev in model.trace:
        rows.append((int(it), float(dev), None if last is None else float(last - dev)))
        last = dev
    return spark.createDataFrame(rows, "iteration int, deviance double, change double")


def compare_algorithms(formula: str, data: DataFrame, family="NO", methods=("RS", "CG", "MIXED", "LBFGS"), control: Control | None = None, **options) -> list[dict]:
    """A row per method: deviance, iterations, seconds and whether it converged; the smallest deviance first."""
    rows = []
    for method in methods:
        began = time.perf_counter()
        m = gamlss(formula, data, family, method=method, control=control, vcov=False, **options)
        rows.append({"method": method, "deviance": m.deviance, "iterations": m.iterations, "converged": m.converged, "seconds": time.perf_counter() - began})
    return sorted(rows, key=lambda r: (r["deviance"], r["method"]))


class Profiler:
    """Seconds and calls of nested sections."""

    def __init__(self):
        self.seconds: dict[tuple[str, ...], float] = {}
        self.calls: dict[tuple[str, ...], int] = {}
        self._open: tuple[str, ...] = ()

    @contextmanager
    def section(self, name: str):
        before, self._open = self._open, (*self._open, name)
        at, began = self._open, time.perf_counter()
        try:
            yield
        finally:
            self.seconds[at] = self.seconds.get(at, 0.0) + time.perf_counter() - began
            self.calls[at] = self.calls.get(at, 0) + 1
            self._open = before

    def rows(self) -> list[dict]:
        return [{"section": "/".join(k), "calls": self.calls[k], "seconds": v} for k, v in sorted(self.seconds.items())]

    def collapsed(self, root: str = "run") -> str:
        """A line per section, with the microseconds spent in it and not in its sections, as flame graphs take them."""
        own = {k: v - sum(x for j, x in self.seconds.items() if j[:-1] == k) for k, v in self.seconds.items()}
        return "\n".join(f"{';'.join((root, *k))} {max(int(v * 1e6), 0)}" for k, v in sorted(own.items()))


class EventLog:
    """Events (at, event, fields as JSON), appended to a folder as JSON lines, one file per flush."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._rows = spark, path, []

    def add(self, event: str, **fields) -> None:
        self._rows.append((time.time(), event, json.dumps(fields, sort_keys=True, default=str)))

    def flush(self) -> None:
        if self._rows:
            self.spark.createDataFrame(self._rows, "at double, event string, fields string").coalesce(1).write.mode("append").json(self.path)
            self._rows = []

    def read(self) -> DataFrame:
        return self.spark.read.schema("at double, event string, fields string").json(self.path)
