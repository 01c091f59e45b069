"""Triangle counting."""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.graph import Graph
from ..plans.store import folder, freed

#: Edges of one bucket, about; a task holds three. Pairs of edges that are looked at together.
BUCKET, PAIRS = 1 << 20, 1 << 21


def triangle_count(graph: Graph, canonicalize: bool = False, bucket: int = BUCKET) -> DataFrame:
    """One row (triangles).

    By default edges count as stored: u < v < w with edges u-v, u-w and v-w that ascend; of parallel ones, as many as
    the rarer of u-w and v-w for each u-v. canonicalize takes edges as undirected and simple.

    Vertices have colours by a hash, and the edges between two colours are one bucket of files in the shared folder. A
    task takes three colours and reads their buckets, so the pairs of edges to close are never shuffled nor stored; the
    number of colours grows with the root of the edges, and a task's memory doesn't grow. An edge is led from its end
    of lower degree, so that no vertex has more than the root of twice the edges to pair up, hot ones included. Each
    pair is looked at in one task, each triangle is found once.
    """
    spark, edges = graph.spark, graph.edges.where("src != dst" if canonicalize else "src < dst")
    k = isqrt(2 * edges.count() // bucket) + 1
    colour = lambda c: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    pairs = edges.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).withColumn("i", colour("u")).withColumn("j", colour("v"))
    swap = lambda a, b: F.when(F.col("i") <= F.col("j"), F.col(a)).otherwise(F.col(b))
    pairs = pairs.select(swap("i", "j").alias("i"), swap("j", "i").alias("j"), swap("u", "v").alias("u"), swap("v", "u").alias("v"))
    # The buckets of a partition are there whole, so merging parallel edges needs no second shuffle.
    merged = pairs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "i", "j").groupBy("i", "j", "u", "v").agg(*([F.count("*").alias("m")] if not canonicalize else [F.lit(1).cast("long").alias("m")]))
    at, degrees = folder(spark, "buckets"), folder(spark, "degrees")
    small = {"compression": "zstd", "parquet.writer.version": "PARQUET_2_0"}
    with freed(spark):
        merged.select("i", "j", "u", "v", *([] if canonicalize else ["m"])).sortWithinPartitions("i", "j", "u", "v").write.options(**small).partitionBy("i", "j").parquet(at)
        if not edges.isEmpty():
            ends = spark.read.parquet(at).select(F.explode(F.array("u", "v")).alias("id"))
            ends.groupBy("id").agg(F.count("*").alias("d")).withColumn("c", colour("id")).repartition("c").sortWithinPartitions("c", "id").write.options(**small).partitionBy("c").parquet(degrees)
    ids = spark.range(k**3).select((F.col("id") % k).cast("int").alias("a"), F.expr(f"cast(id div {k} % {k} as int)").alias("b"), F.expr(f"cast(id div {k * k} as int)").alias("c")).where("a <= b and b <= c")
    tasks = min(k * (k + 1) * (k + 2) // 6, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for triple in zip(*(c.to_pylist() for c in b.columns), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([closed(at, degrees, triple, not canonicalize)], pa.int64())], names=["n"])

    return ids.repartition(tasks).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("triangles"))


def columns(path: str, names: list[str]) -> list[np.ndarray]:
    """The columns of a folder of Parquet files; without rows where there is no such folder."""
    system, name = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    if system.get_file_info(name).type != fs.FileType.Directory:
        return [np.zeros(0, np.int64) for _ in names]
    files = [f.path for f in system.get_file_info(fs.FileSelector(name)) if f.path.endswith(".parquet")]
    table = ds.dataset(files, filesystem=system, format="parquet").to_table(columns=names, use_threads=False)
    return [table[n].to_numpy() for n in names]


def closed(at: str, degrees: str, triple: tuple[int, int, int], parallel: bool) -> int:
    """The triangles of three vertices of these colours (ascending, some may be one)."""
    ids, degree = {}, {}
    for c in set(triple):
        found, d = columns(f"{degrees}/c={c}", ["id", "d"])
        order = np.argsort(found, kind="stable")
        ids[c], degree[c] = found[order], d[order]
    buckets = {}
    for i, j in {(triple[x], triple[y]) for x, y in ((0, 1), (0, 2), (1, 2))}:
        u, v, *m = columns(f"{at}/i={i}/j={j}", ["u", "v"] + ["m"] * parallel)
        pos_u, pos_v = np.searchsorted(ids[i], u), np.searchsorted(ids[j], v)
        first = (degree[i][pos_u] < degree[j][pos_v]) | ((degree[i][pos_u] == degree[j][pos_v]) & (u < v))
        buckets[i, j] = pos_u, pos_v, first, m[0] if parallel else None

    def led(c: int, a: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """The edges led from colour c to colour a, in order of both ends."""
        x, y, first, m = buckets[min(a, c), max(a, c)]
        if c == a:
            ends, keep = (np.where(first, x, y), np.where(first, y, x)), slice(None)
        else:
            ends, keep = ((x, y), first) if c < a else ((y, x), ~first)
        p, q = ends[0][keep], ends[1][keep]
        order = np.argsort(p * max(1, len(ids[a])) + q)
        return p[order], q[order], m[keep][order] if parallel else None

    total = 0
    for c in set(triple):
        rest = list(triple)
        rest.remove(c)
        a, b = rest
        left = led(c, a)
        right = left if a == b else led(c, b)
        x, y, _, m3 = buckets[a, b]
        # Places follow ids, and in a bucket of one colour u < v, so these are the keys of the pairs below.
        keys = x * max(1, len(ids[b])) + y
        order = np.argsort(keys)
        for e, f, at3 in pairs_closed(left, right, a == b, keys[order], (len(ids[c]), len(ids[a]), len(ids[b]))):
            if not parallel:
                total += len(e)
                continue
            p, q, r = ids[c][left[0][e]], ids[a][left[1][e]], ids[b][right[1][f]]
            m1, m2, m = left[2][e], right[2][f], m3[order][at3]
            # The edge between the two smaller ids is the one opposite to the largest.
            top = np.maximum(np.maximum(p, q), r)
            total += int(np.where(top == r, m1 * np.minimum(m2, m), np.where(top == q, m2 * np.minimum(m1, m), m * np.minimum(m1, m2))).sum())
    return total


def pairs_closed(left: tuple, right: tuple, same: bool, keys: np.ndarray, sizes: tuple[int, int, int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in left, right and keys of the pairs of edges from one vertex whose other ends are a key; same: left is right, each pair once."""
    (p, x, _), (q, y, _), (n, nx, ny) = left, right, sizes
    if not len(p) or not len(q) or not len(keys):
        return
    start = np.concatenate([[0], np.bincount(q, minlength=n).cumsum()])
    lo = np.arange(len(p)) + 1 if same else start[p]
    count = start[p + 1] - lo
    # Most pairs aren't edges: nearly all of them go by a table of hashes.
    bits = min(25, max(10, int(16 * len(keys)).bit_length()))
    rng = np.random.default_rng(len(keys))
    hx, hy = (rng.integers(0, 1 << bits, s, dtype=np.uint32) for s in (nx, ny))
    seen = np.zeros(1 << bits, bool)
    seen[hx[keys // ny] ^ hy[keys % ny]] = True
    ex, ey, upto = hx[x], hy[y], count.cumsum()
    i = 0
    while i < len(p):
        before = int(upto[i - 1]) if i else 0
        j = max(i + 1, int(np.searchsorted(upto, before + PAIRS, "right")))
        own = count[i:j]
        shift = lo[i:j] - (upto[i:j] - own - before)
        f = np.arange(int(upto[j - 1]) - before) + np.repeat(shift, own)
        hit = np.flatnonzero(seen[np.repeat(ex[i:j], own) ^ ey[f]])
        if len(hit):
            e, f = i + np.searchsorted(upto[i:j], before + hit, "right"), f[hit]
            key = x[e] * ny + y[f]
            place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            real = keys[place] == key
            yield e[real], f[real], place[real]
        i = j
