"""Mixing sources to target weights by systematic sampling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, col, cut, fresh, partitions, row_hash

#: A source's weight is the one at its place in code-point order (null last), the list repeating.
WEIGHTS, SHARE, CAP, SEED = (3, 1, 2), 1.5, 2, "mix-1"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def offset(source: Column, seed: str) -> Column:
    """A number in [0, 1) fixed by the seed and the source's name."""
    digest = F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size) with each source's weight and target.

    The sources share `share` times all sizes by weight, none above `cap` times its own. Reshared excess ends where
    every source below its cap has the same level (target / weight), so sources meet their caps in the order of
    cap / weight, and the first that doesn't gives the level. The order is over all sources, so one task holds a row
    for each: some millions of them are fine.
    """
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), ((F.row_number().over(everything) - 1) % len(weights) + 1).cast("int"))
    own = F.col("source_size").cast("double")
    filled = Window.orderBy(own / F.col("weight"), F.col("source").asc_nulls_last())
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    t = sizes.withColumn("weight", w).withColumns({
        "_full": F.coalesce(F.sum("source_size").over(before), F.lit(0)).cast("double") * F.lit(float(cap)),
        "_used": F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        "_all": F.sum("source_size").over(whole).cast("double") * F.lit(float(share)),
        "_weights": F.sum("weight").over(whole),
    })
    level = (F.col("_all") - F.col("_full")) / (F.col("_weights") - F.col("_used"))
    t = t.withColumn("_level", F.when(own * F.lit(float(cap)) > level * F.col("weight"), level))
    t = t.withColumn("_level", F.first("_level", ignorenulls=True).over(filled.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    least = F.coalesce(F.least(own * F.lit(float(cap)), F.col("_level") * F.col("weight")), own * F.lit(float(cap)))
    return t.select("source", "source_size", "weight", least.alias("target"))


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED, whole: bool = False) -> DataFrame:
    """One row for each row of docs: (doc_id, source, hash, size, source_size, target, copies, taken).

    A document's expected copies are its source's target over its source's size. Within a source, documents stand in
    the order of (size, id); with the running sum of expected copies S and one offset u for the source, document k is
    taken floor(S_k + u) - floor(S_(k-1) + u) times. As sizes rise along the order, the words taken differ from the
    target by about one document of the largest size at most. Reruns agree: the order and u are fixed by the data.

    The running sum is a global one without a global sort in one task: rows are range-partitioned by (source, size,
    id), each partition's rows are counted by source, and a row's rank is its partition's start plus its place there.
    A source with a third of all rows is spread over as many range partitions as its rows need; so are repeated rows.

    Nulls: a null text and an empty one have size 0; null sources form one source, the last; null ids stand first
    among equal sizes. A source of size 0 has target 0 and gives nothing. Repeated rows each get their own copies.
    Ties in (size, id) go by a hash of the text, or of all columns with `whole`. An empty table gives none. Other
    columns of docs are not read otherwise.
    """
    rows = docs.select(col(id_col).alias("doc_id"), col(source_col).cast("string").alias("source"), (row_hash(docs) if whole else F.xxhash64(col(text_col))).alias("hash"), words(col(text_col)).alias("size"))
    order = [F.col(c).asc_nulls_first() for c in ("size", "doc_id", "hash", "_row")]
    rows = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(partitions(docs.sparkSession), F.col("source").asc_nulls_last(), *order)
    # The partition a row came to is read by two branches below, so it is stored.
    rows = cut(rows.withColumn("_part", F.spark_partition_id()))
    parts = rows.groupBy("source", "_part").agg(F.count("*").alias("_n"), F.sum("size").alias("_size"))
    by = targets(parts.groupBy("source").agg(F.sum("_size").alias("source_size")), weights, share, cap)
    before = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("source", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    starts = starts.alias("s").join(by.alias("b"), F.col("s.source").eqNullSafe(F.col("b.source"))).select(F.col("s.source").alias("_source"), F.col("_part").alias("_p"), "_start", "source_size", "target")
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("source", "_part").orderBy(*order)))
    ranked = ranked.join(starts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_part") == F.col("_p"))).withColumn("_rank", F.col("_rank") + F.col("_start"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    u = offset(F.col("source"), seed)
    copies = F.floor(rate * F.col("_rank") + u) - F.floor(rate * (F.col("_rank") - 1) + u)
    return ranked.withColumn("copies", F.least(copies, F.lit(int(-(-cap // 1)))).cast("long")).select("doc_id", "source", "hash", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """docs with every row as often as the mix takes it; the columns, extra ones included, stay as they are.

    The copies are found on ids, sizes and hashes alone and joined to the whole rows by id and a hash of all columns,
    so texts are shuffled once. Rows alike in every column are one row here that is taken as often as all of them
    together; map-side, one of them is kept before the shuffle, so a third of all rows may be the same row. Nulls, ties
    and empty tables as in plan_mix; reruns agree.
    """
    keys = [fresh(docs, k) for k in ("id", "hash", "n", "copies")]
    plan = plan_mix(docs, id_col, text_col, source_col, whole=True, **how)
    plan = cut(plan.groupBy("doc_id", "hash").agg(F.count("*").alias("n"), F.sum("copies").alias("copies")).where("copies > 0")).toDF(*keys)
    hashed, again = fresh(docs, "of"), fresh(docs, "again")
    docs = docs.withColumn(hashed, row_hash(docs))
    on = col(id_col).eqNullSafe(F.col(keys[0])) & (F.col(hashed) == F.col(keys[1]))

    def taken(rows: DataFrame, plan: DataFrame) -> DataFrame:
        return rows.join(plan, on).withColumn(again, F.explode(F.sequence(F.lit(1), F.col(keys[3]).cast("int")))).select(*(col(c) for c in docs.columns if c != hashed))

    alone, several = plan.where(F.col(keys[2]) == 1), plan.where(F.col(keys[2]) > 1)
    if several.isEmpty():
        return taken(docs, plan)
    return taken(docs, alone).unionByName(taken(docs.join(several, on, "left_semi").dropDuplicates([hashed]), several))


#: The same rows in DuckDB's SQL.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CAST([3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS DOUBLE) AS weight FROM s
), f AS (
  SELECT *, CAST(coalesce(sum(source_size) OVER o, 0) AS DOUBLE) * 2.0 AS used_size, coalesce(sum(weight) OVER o, 0.0) AS used_weight,
    CAST(sum(source_size) OVER () AS DOUBLE) * CAST(1.5 AS DOUBLE) AS total, sum(weight) OVER () AS weights
  FROM w WINDOW o AS (ORDER BY CAST(source_size AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT min(level) AS level FROM (
    SELECT (total - used_size) / (weights - used_weight) AS level, row_number() OVER (ORDER BY CAST(source_size AS DOUBLE) / weight, source NULLS LAST) AS k
    FROM f WHERE source_size * CAST(2 AS DOUBLE) > (total - used_size) / (weights - used_weight) * weight
  ) WHERE k = 1
), t AS (
  SELECT source, source_size, coalesce(least(source_size * CAST(2 AS DOUBLE), (SELECT level FROM l) * weight), source_size * CAST(2 AS DOUBLE)) AS target,
    CAST(('0x' || substr(md5('mix-1|' || coalesce('s' || source, 'n')), 1, 8)) AS BIGINT) / CAST(4294967296 AS DOUBLE) AS u
  FROM w
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS FIRST) AS k
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST(least(floor(rate * k + u) - floor(rate * (k - 1) + u), 2) AS BIGINT) * size AS taken FROM r
"""
