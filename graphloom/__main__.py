"""python -m graphloom FILE [--benchmark | --scaling | --cc | --sssp | --triangles] [--runs N]: without an option, breadth-first search from 0."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from .operators import components, pagerank, scheduler, traversal, triangles
from .sources.edges import read_edgelist


#: Numbers of partitions that --scaling goes through, one run each.
SCALES = (1, 2, 4, 8, 16, 24)


def timed(job) -> float:
    began = time.perf_counter()
    job().write.format("noop").mode("overwrite").save()
    return 1000 * (time.perf_counter() - began)


def main() -> None:
    p = argparse.ArgumentParser(prog="graphloom")
    p.add_argument("file")
    for flag in ("benchmark", "scaling", "cc", "sssp", "triangles"):
        p.add_argument(f"--{flag}", action="store_true")
    p.add_argument("--runs", type=int, default=4)
    a = p.parse_args()
    spark = SparkSession.builder.appName("graphloom").getOrCreate()
    g = read_edgelist(spark, a.file)
    scheduler.scheduler_decision(g).show(truncate=False)
    if a.scaling:
        for n in SCALES:
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            print(f"{n} partitions: {timed(lambda: pagerank.pagerank(g, 20)):.1f} ms")
        return
    job = {
        "benchmark": lambda: pagerank.pagerank(g, 20), "cc": lambda: components.connected_components(g), "sssp": lambda: traversal.sssp(g, 0), "triangles": lambda: triangles.triangle_count(g),
    }.get(next((f for f in ("benchmark", "cc", "sssp", "triangles") if getattr(a, f)), ""), lambda: traversal.bfs(g, 0))
    took = [timed(job) for _ in range(a.runs if a.benchmark else 1)]
    # The first run warms up.
    rest = took[1:] or took
    print(f"{sum(rest) / len(rest):.1f} ms")


if __name__ == "__main__":
    main()
