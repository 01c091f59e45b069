"""Spans of driver-side work as trace events that browsers' trace viewers read."""

from __future__ import annotations

import json
import os
import threading
import time
from contextlib import contextmanager

from pyspark.sql import SparkSession


class Profiler:
    def __init__(self):
        self.events: list[dict] = []
        self._began = time.perf_counter()

    @contextmanager
    def span(self, name: str, category: str = "function"):
        start = time.perf_counter()
        try:
            yield
        finally:
            self.events.append({"cat": category, "dur": round(1e6 * (time.perf_counter() - start)), "name": name, "ph": "X", "pid": os.getpid(), "tid": threading.get_ident(), "ts": round(1e6 * (start - self._began))})

    def write(self, path: str) -> None:
        with open(path, "w") as f:
            json.dump({"otherData": {}, "traceEvents": self.events}, f)


def environment(spark: SparkSession) -> dict[str, str]:
    """The session's settings that decide how work is spread."""
    keys = ("spark.master", "spark.executor.instances", "spark.executor.cores", "spark.executor.memory", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")
    return {k: spark.conf.get(k, None) or "" for k in keys} | {"version": spark.version, "parallelism": str(spark.sparkContext.defaultParallelism)}
