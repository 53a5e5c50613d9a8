"""Timed sections, memory peaks and query timings, and their JSON sinks."""

from __future__ import annotations

import json
import resource
import time
from collections.abc import Callable
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _rss_mb() -> float:
    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024


class Sections:
    """Seconds by named section, and the driver's memory peak over that at construction."""

    def __init__(self) -> None:
        self.base, self.seconds, self.queries = _rss_mb(), {}, {}
        self.began = time.perf_counter()

    @contextmanager
    def section(self, name: str):
        at = time.perf_counter()
        try:
            yield self
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - at

    def time_queries(self, query: Callable[[float, float], object], width: float, height: float, count: int = 100, seed: int = 0) -> dict[str, float]:
        """Mean, greatest, least and total seconds of ``query`` on points of [0, width] x [0, height]."""
        took = []
        with self.section("queries"):
            for x, y in (np.random.default_rng(seed).random((count, 2)) * (width, height)).tolist():
                at = time.perf_counter()
                query(x, y)
                took.append(time.perf_counter() - at)
        self.queries = {"average_query_time": sum(took) / len(took), "max_query_time": max(took), "min_query_time": min(took), "total_query_time": sum(took)} if took else {}
        return self.queries

    def results(self) -> dict:
        return {"total_time": time.perf_counter() - self.began, "peak_memory_mb": max(0.0, _rss_mb() - self.base), "component_breakdown": dict(self.seconds), "query_performance": self.queries}


def write_json(metrics: dict, path: str) -> None:
    """A nested metrics dict as a JSON file, indented by two; not-finite numbers as the standard module writes them."""
    with open(path, "w") as f:
        json.dump(metrics, f, indent=2)


def metrics_json(metrics: DataFrame) -> DataFrame:
    """One JSON text by row of a metrics frame, for ``write.text``."""
    return metrics.select(F.to_json(F.struct(*metrics.columns)).alias("value"))


def frame(spark: SparkSession, results: dict) -> DataFrame:
    """section, seconds of a result's breakdown."""
    return spark.createDataFrame(sorted(results["component_breakdown"].items()), "section string, seconds double")
