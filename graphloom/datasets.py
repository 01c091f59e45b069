"""Graphs derived from star-schema tables, and the same edges in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .plans.graph import Graph
from .plans.store import freed, stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def copurchase(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts in one order, the smaller to the larger id."""
    lines = table(spark, sf_dir, "lineitem").where("l_orderkey is not null")
    # One shuffle brings an order's parts together, as a list that is no longer than the vertices.
    orders = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("parts"))
    firsts = orders.select("parts", F.posexplode("parts").alias("at", "src"))
    pairs = firsts.select("src", F.explode(F.slice("parts", F.col("at") + 2, F.size("parts"))).alias("dst"))
    # Stored, as the largest id and the algorithms read them apart.
    with freed(spark):
        return Graph.from_edges(stored(pairs.distinct()))


def customer_supplier(spark: SparkSession, sf_dir: str) -> Graph:
    """One edge for each line item, from the customer to the supplier, weighted by price."""
    shift = table(spark, sf_dir, "customer").agg(F.max("c_custkey")).first()[0] + 1
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") + shift).alias("dst"), F.col("l_extendedprice").alias("weight"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("src"))
    return Graph.from_edges(orders.join(lines, "l_orderkey").select("src", "dst", "weight"))


def user_transitions(spark: SparkSession, sf_dir: str) -> Graph:
    """From the user of an event to the user of the next one of its type, weighted by the event's value.

    Types are few, so the order is spread over ranges of (type, time): within a range the next event is the next row, and
    the last one of a type goes on to the first of the same type in a later range, of which there is one row a range.
    """
    order = ["event_type", "ts", "event_id"]
    events = table(spark, sf_dir, "events").select(*order, "user_id", "value").repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order)
    # Which range a row came to is read twice.
    events = stored(events.withColumn("range", F.spark_partition_id()))
    firsts = events.groupBy("event_type", "range").agg(F.min_by("user_id", F.struct("ts", "event_id")).alias("first"))
    after = firsts.select("event_type", "range", F.lead("first").over(Window.partitionBy("event_type").orderBy("range")).alias("after"))
    nxt = F.lead("user_id").over(Window.partitionBy("event_type", "range").orderBy("ts", "event_id"))
    ends = events.withColumn("own", nxt).join(after, ["event_type", "range"]).withColumn("dst", F.coalesce("own", "after"))
    return Graph.from_edges(ends.select(F.col("user_id").alias("src"), "dst", F.col("value").alias("weight")).where("dst is not null"))


def conversations(spark: SparkSession, sf_dir: str) -> Graph:
    """From each turn to the next; ids are conv_id * 1000 + turn, and only these are vertices."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", (F.col("conv_id") * 1000 + F.col("turn")).alias("src"))
    nxt = F.lead("src").over(Window.partitionBy("conv_id").orderBy("src"))
    return Graph.from_edges(turns.withColumn("dst", nxt).where("dst is not null"), vertices=turns.select(F.col("src").alias("id")).distinct())


def geography(spark: SparkSession, sf_dir: str) -> Graph:
    """Regions to nations to customers, each kind with ids of its own."""
    nations, customers = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    r = table(spark, sf_dir, "region").agg(F.max("r_regionkey")).first()[0] + 1
    n = nations.agg(F.max("n_nationkey")).first()[0] + 1
    up = nations.select(F.col("n_regionkey").alias("src"), (F.col("n_nationkey") + r).alias("dst"))
    return Graph.from_edges(up.union(customers.select((F.col("c_nationkey") + r).alias("src"), (F.col("c_custkey") + r + n).alias("dst"))))


def customers(spark: SparkSession, sf_dir: str) -> Graph:
    """Customers as vertices with properties, and no edges."""
    c = table(spark, sf_dir, "customer")
    pairs = {"name": F.col("c_name"), "segment": F.col("c_mktsegment"), "balance": F.col("c_acctbal").cast("string"), "code": F.concat((F.col("c_custkey") % 50).cast("string"), F.lit("abc"))}
    code = F.create_map(*(x for k, v in pairs.items() for x in (F.lit(k), v)))
    # Some have no segment at all.
    some = F.when(F.col("c_custkey") % 7 == 0, F.map_filter(code, lambda k, _: k != "segment")).otherwise(code)
    edges = spark.createDataFrame([], "src long, dst long")
    return Graph.from_edges(edges, vertices=c.select(F.col("c_custkey").cast("long").alias("id"), some.alias("properties")))


#: The edges in SQL, by name.
SQL = {
    "cp": "SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey",
    "cs": "SELECT o_custkey AS src, l_suppkey + (SELECT max(c_custkey) + 1 FROM customer) AS dst, l_extendedprice AS weight FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
    "ut": "SELECT * FROM (SELECT user_id AS src, lead(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS dst, value AS weight FROM events) WHERE dst IS NOT NULL",
    "cv": "SELECT * FROM (SELECT conv_id * 1000 + turn AS src, lead(conv_id * 1000 + turn) OVER (PARTITION BY conv_id ORDER BY turn) AS dst FROM conversations) WHERE dst IS NOT NULL",
    "geo": "SELECT n_regionkey AS src, n_nationkey + (SELECT max(r_regionkey) + 1 FROM region) AS dst FROM nation UNION ALL SELECT c_nationkey + (SELECT max(r_regionkey) + 1 FROM region), c_custkey + (SELECT max(r_regionkey) + 1 FROM region) + (SELECT max(n_nationkey) + 1 FROM nation) FROM customer",
}
GRAPHS = {"cp": copurchase, "cs": customer_supplier, "ut": user_transitions, "cv": conversations, "geo": geography}
