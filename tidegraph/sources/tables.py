"""Networks over tables of orders: who is linked to whom by what they share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import DiGraph, Duplicates, Graph


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _graph(spark: SparkSession, pairs: DataFrame) -> Graph:
    ends = pairs.select(F.col(pairs.columns[0]).alias("id")).union(pairs.select(pairs.columns[1]))
    return Graph.of(spark, ends, pairs)


def basket(spark: SparkSession, folder: str) -> Graph:
    """Orders (even ids) and the parts (odd ids) that they hold."""
    lines = read(spark, folder, "lineitem")
    return _graph(spark, lines.select((2 * F.col("l_orderkey")).alias("a"), (2 * F.col("l_partkey") + 1).alias("b")))


def supply(spark: SparkSession, folder: str) -> Graph:
    """Suppliers (even ids) and parts (odd ids), weighing their dearest line."""
    lines = read(spark, folder, "lineitem")
    return _graph(
        spark,
        lines.select((2 * F.col("l_suppkey")).alias("a"), (2 * F.col("l_partkey") + 1).alias("b"), F.col("l_extendedprice").cast("double").alias("w")),
    )


def successions(spark: SparkSession, folder: str) -> DataFrame:
    """``src, dst, weight``: parts on consecutive lines of an order, repeats included."""
    lines = read(spark, folder, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    after = lines.select(
        F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst"),
        F.col("l_quantity").cast("double").alias("weight"),
    )
    return after.where("src <> dst")


def succession(spark: SparkSession, folder: str, duplicates: Duplicates = Duplicates.SUM) -> DiGraph:
    arcs = successions(spark, folder)
    ends = arcs.select(F.col("src").alias("id")).union(arcs.select("dst"))
    return DiGraph.of(spark, ends, arcs, duplicates)


def chains(spark: SparkSession, folder: str) -> DiGraph:
    """Every order depends on the same customer's order before it."""
    orders = read(spark, folder, "orders")
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    arcs = orders.select(F.col("o_orderkey").alias("src"), F.lag("o_orderkey").over(order).alias("dst")).where("dst is not null")
    return DiGraph.of(spark, orders.select(F.col("o_orderkey").alias("id")), arcs)


def diary(spark: SparkSession, folder: str) -> Graph:
    """Orders, each next to the same customer's order before it, and to the one before of the same priority.

    So every customer's orders are a path with chords.
    """
    orders = read(spark, folder, "orders")
    by = [F.col("o_orderdate"), F.col("o_orderkey")]
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy(*by))
    alike = F.lag("o_orderkey").over(Window.partitionBy("o_custkey", "o_orderpriority").orderBy(*by))
    both = orders.select(F.col("o_orderkey").alias("a"), before.alias("before"), alike.alias("alike"))
    pairs = both.select("a", F.explode(F.array("before", "alike")).alias("b")).where("b is not null")
    return Graph.of(spark, orders.select(F.col("o_orderkey").alias("id")), pairs)


def returns(spark: SparkSession, folder: str) -> DiGraph:
    """Orders, each leading to the same customer's next one, and back to the one before of the same priority if far."""
    orders = read(spark, folder, "orders")
    by = [F.col("o_orderdate"), F.col("o_orderkey")]
    own = Window.partitionBy("o_custkey").orderBy(*by)
    alike = Window.partitionBy("o_custkey", "o_orderpriority").orderBy(*by)
    placed = orders.withColumn("place", F.row_number().over(own)).select(
        "o_orderkey", F.lead("o_orderkey").over(own).alias("next"),
        F.lag(F.struct("o_orderkey", "place")).over(alike).alias("back"), "place",
    )
    far = F.when(F.col("place") - F.col("back.place") == 3, F.col("back.o_orderkey"))
    arcs = placed.select(F.col("o_orderkey").alias("src"), F.explode(F.array("next", far)).alias("dst")).where("dst is not null")
    return DiGraph.of(spark, orders.select(F.col("o_orderkey").alias("id")), arcs)


def trade(spark: SparkSession, folder: str) -> Graph:
    """Nations, weighing what suppliers of one sold to customers of the other.

    The sum over both directions is taken before the graph is built.
    """
    lines = read(spark, folder, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    orders = read(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    supplier = read(spark, folder, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("s"))
    customer = read(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("c"))
    sold = lines.join(orders, "l_orderkey").join(supplier, "l_suppkey").join(customer, "o_custkey")
    sums = sold.groupBy(F.least("s", "c").alias("a"), F.greatest("s", "c").alias("b")).agg(F.sum("l_quantity").cast("double").alias("w"))
    nations = read(spark, folder, "nation").select(F.col("n_nationkey").alias("id"))
    return Graph.of(spark, nations, sums)


def boxes(spark: SparkSession, folder: str) -> DataFrame:
    """An axis-parallel square for every nation, in a grid of five by five."""
    n = read(spark, folder, "nation").select(F.col("n_nationkey").cast("bigint").alias("obstacle_id"))
    x, y = 3.0 * (F.col("obstacle_id") % 5), 3.0 * F.floor(F.col("obstacle_id") / 5)
    point = lambda dx, dy: F.struct((x + dx).cast("double").alias("x"), (y + dy).cast("double").alias("y"))
    return n.select("obstacle_id", F.array(point(0.0, 0.0), point(1.5, 0.0), point(1.5, 1.5), point(0.0, 1.5)).alias("ring"))


def places(spark: SparkSession, folder: str) -> DataFrame:
    """``id, x, y, z``: a point for every embedding, from its first three numbers, on a quarter grid."""
    e = read(spark, folder, "embeddings")
    at = lambda k: (F.round(F.col("embedding")[k].cast("double") * 80) / 4 + 7).cast("double")
    return e.select(F.col("vec_id").cast("bigint").alias("id"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))
