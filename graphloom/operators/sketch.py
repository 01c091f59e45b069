"""HyperLogLog and Count-Min sketches as tables of registers and counters."""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import fnv1a, fnv1a_int, leading_zeros, modulo, signed
from ..plans.graph import Graph


def hll_registers(items: DataFrame, key: str, item: str, precision: int = 10) -> DataFrame:
    """(key, idx, rho): the top bits of an item's hash name a register, which keeps the most leading zeros of the rest, plus one."""
    seen = items.select(F.col(key).alias("key"), F.col(item).cast("long").alias("_item")).distinct().select("key", fnv1a(F.col("_item")).alias("_h"))
    rho = leading_zeros(F.shiftleft("_h", precision)) + 1
    return seen.groupBy("key", F.shiftrightunsigned("_h", 64 - precision).cast("int").alias("idx")).agg(F.max(rho).cast("int").alias("rho"))


def hll_merge(*registers: DataFrame) -> DataFrame:
    """The union of sketches: the larger of each register."""
    both = registers[0]
    for r in registers[1:]:
        both = both.unionByName(r)
    return both.groupBy("key", "idx").agg(F.max("rho").alias("rho"))


def hll_estimate(registers: DataFrame, precision: int = 10) -> DataFrame:
    """(key, estimate). Small counts are taken from the empty registers; there is no correction for very large ones."""
    m = 1 << precision
    alpha = {16: 0.673, 32: 0.697, 64: 0.709}.get(m, 0.7213 / (1 + 1.079 / m))
    sums = registers.groupBy("key").agg((F.sum(F.pow(F.lit(2.0), -F.col("rho"))) + (m - F.count("*"))).alias("z"), (m - F.count("*")).alias("zeros"))
    raw = F.lit(alpha * m * m) / F.col("z")
    linear = F.lit(float(m)) * F.ln(F.lit(float(m)) / F.col("zeros"))
    return sums.select("key", F.when((raw <= 2.5 * m) & (F.col("zeros") > 0), linear).otherwise(raw).alias("estimate"))


def estimate_degrees(graph: Graph, precision: int = 10, method: str = "fnv") -> DataFrame:
    """(id, degree): about how many different out-neighbours; 0.0 without any. fnv keeps the registers above, builtin uses Spark's own sketch."""
    if method == "builtin":
        found = graph.edges.groupBy(F.col("src").alias("id")).agg(F.hll_sketch_estimate(F.hll_sketch_agg("dst", precision)).cast("double").alias("degree"))
    else:
        found = hll_estimate(hll_registers(graph.edges, "src", "dst", precision), precision).select(F.col("key").alias("id"), F.col("estimate").alias("degree"))
    return graph.vertices.select("id").join(found, "id", "left").select("id", F.coalesce("degree", F.lit(0.0)).alias("degree"))


#: Fixed value: what the seeds begin from; each is the hash of the one before plus its row.
START = 0xCAFEBABEDEADBEEF


def seeds(depth: int) -> list[int]:
    return list(accumulate(range(depth), lambda seed, row: fnv1a_int(seed + row), initial=START))[1:]


def cms_cells(items: DataFrame, item: str, width: int, depth: int) -> DataFrame:
    """items once for each row of the sketch, with that row and the item's col in it."""
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("row"), F.lit(signed(s)).alias("seed")) for i, s in enumerate(seeds(depth)))))
    mixed = items.withColumn("_each", each).select(*items.columns, "_each.row", F.col(item).bitwiseXOR(F.col("_each.seed")).alias("_mixed"))
    return mixed.withColumn("_hash", fnv1a(F.col("_mixed"))).select(*items.columns, "row", modulo(F.col("_hash"), width).alias("col"))


def cms_build(items: DataFrame, item: str, count: Column | None = None, width: int = 2048, depth: int = 5) -> DataFrame:
    """(row, col, cnt): equal items are added up first, so each is hashed once a task, and the table has width * depth rows at most."""
    n = F.lit(1) if count is None else count
    merged = items.groupBy(F.col(item).cast("long").alias("_item")).agg(F.sum(n).alias("_n"))
    return cms_cells(merged, "_item", width, depth).groupBy("row", "col").agg(F.sum("_n").cast("long").alias("cnt"))


def cms_query(sketch: DataFrame, items: DataFrame, item: str, width: int = 2048, depth: int = 5) -> DataFrame:
    """(item, estimate): never less than the true count."""
    keys = items.select(F.col(item).cast("long").alias("item")).distinct()
    cells = cms_cells(keys, "item", width, depth)
    # The sketch has width * depth rows at most.
    joined = cells.join(F.broadcast(sketch) if width * depth <= 1 << 20 else sketch, ["row", "col"], "left")
    return joined.groupBy("item").agg(F.min(F.coalesce("cnt", F.lit(0))).cast("long").alias("estimate"))


def edge_key(src: Column, dst: Column) -> Column:
    return F.shiftleft(src, 32).bitwiseOR(dst)


EDGE_WIDTH, EDGE_DEPTH = 4096, 7


class CountMinSketch:
    """A sketch to be filled item by item on the driver, with the same counters as the tables above; `rows` makes it one."""

    def __init__(self, width: int = 2048, depth: int = 5):
        self.width, self.seeds, self.counters = width, seeds(depth), [[0] * width for _ in range(depth)]

    def _places(self, item: int) -> list[int]:
        return [fnv1a_int(item ^ s) % self.width for s in self.seeds]

    def update(self, item: int, count: int = 1) -> None:
        for row, col in zip(self.counters, self._places(item), strict=True):
            row[col] += count

    def query(self, item: int) -> int:
        return min(row[col] for row, col in zip(self.counters, self._places(item), strict=True))

    def rows(self, spark: SparkSession) -> DataFrame:
        found = [(i, j, n) for i, row in enumerate(self.counters) for j, n in enumerate(row) if n]
        return spark.createDataFrame(found, "row int, col long, cnt long")


def build_edge_sketch(graph: Graph) -> DataFrame:
    return cms_build(graph.edges.select(edge_key(F.col("src"), F.col("dst")).alias("k")), "k", width=EDGE_WIDTH, depth=EDGE_DEPTH)


def query_edge_frequency(sketch: DataFrame, pairs: DataFrame) -> DataFrame:
    """(src, dst, estimate) for pairs (src, dst) whose ids are below 2^32."""
    keyed = pairs.select("src", "dst", edge_key(F.col("src"), F.col("dst")).alias("item")).distinct()
    return keyed.join(cms_query(sketch, keyed, "item", EDGE_WIDTH, EDGE_DEPTH), "item").select("src", "dst", "estimate")
