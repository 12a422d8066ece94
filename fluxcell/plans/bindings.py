"""Count matrices, vectors and trajectories over the relational test tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LAYERS = ["spliced", "unspliced"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def counts(spark: SparkSession, d: str) -> DataFrame:
    """Cells = suppliers, genes = brands, spliced = line status F, value = quantity."""
    lines = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_linestatus", "l_quantity")
    parts = table(spark, d, "part").select("p_partkey", "p_brand")
    named = F.when(F.col("l_linestatus") == "F", "spliced").otherwise("unspliced")
    return (
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("l_suppkey").alias("cell_id"), F.col("p_brand").alias("gene_id"), named.alias("layer"))
        .agg(F.sum("l_quantity").alias("value"))
    )


def sparse_counts(spark: SparkSession, d: str) -> DataFrame:
    """As ``counts`` with parts as genes."""
    named = F.when(F.col("l_linestatus") == "F", "spliced").otherwise("unspliced")
    lines = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_linestatus", "l_quantity")
    return lines.groupBy(
        F.col("l_suppkey").alias("cell_id"), F.col("l_partkey").alias("gene_id"), named.alias("layer")
    ).agg(F.sum("l_quantity").alias("value"))


def total_layer(expr: DataFrame) -> DataFrame:
    return expr.groupBy("cell_id", "gene_id").agg(F.sum("value").alias("value"))


def labeled(spark: SparkSession, d: str) -> DataFrame:
    """``(cell_id, gene_id, t, new, total)``: new = return flag N, t = ship year - 1994."""
    lines = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag", "l_quantity", "l_shipdate")
    parts = table(spark, d, "part").select("p_partkey", "p_brand")
    t = (F.year("l_shipdate") - 1994).cast("double")
    new = F.when(F.col("l_returnflag") == "N", F.col("l_quantity")).otherwise(0.0)
    return (
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("l_suppkey").alias("cell_id"), F.col("p_brand").alias("gene_id"), t.alias("t"))
        .agg(F.sum(new).alias("new"), F.sum("l_quantity").alias("total"))
    )


def cells(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    return s.select(F.col("s_suppkey").alias("cell_id"), F.col("s_nationkey").cast("string").alias("grp"))


def n_cells(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").agg(F.count("*").alias("n_cells"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("cell_id"), F.col("embedding").cast("array<double>").alias("x"), "label")


def steps(spark: SparkSession, d: str) -> DataFrame:
    """Trajectories: users, ordered by time and event; state = event type; t in days."""
    e = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 86400e6
    return e.select(
        F.col("user_id").alias("traj_id"), "ts", "event_id", t.alias("t"), F.col("event_type").alias("state"), "value"
    )


COUNTS_SQL = """
e AS (
  SELECT l_suppkey AS cell_id, p_brand AS gene_id,
         CASE WHEN l_linestatus = 'F' THEN 'spliced' ELSE 'unspliced' END AS layer, sum(l_quantity) AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL
), x AS (
  SELECT cell_id, gene_id, sum(value) AS value FROM e GROUP BY ALL
), n AS (
  SELECT count(*) AS n_cells FROM supplier
), w AS (
  SELECT cell_id, gene_id, coalesce(sum(value) FILTER (WHERE layer = 'spliced'), 0) AS spliced,
         coalesce(sum(value) FILTER (WHERE layer = 'unspliced'), 0) AS unspliced FROM e GROUP BY ALL
), g AS (
  SELECT DISTINCT gene_id FROM e
), dense AS (
  SELECT s_suppkey AS cell_id, g.gene_id, coalesce(spliced, 0.0) AS spliced, coalesce(unspliced, 0.0) AS unspliced
  FROM supplier CROSS JOIN g LEFT JOIN w ON w.cell_id = s_suppkey AND w.gene_id = g.gene_id
)"""

SPARSE_SQL = """
e AS (
  SELECT l_suppkey AS cell_id, l_partkey AS gene_id,
         CASE WHEN l_linestatus = 'F' THEN 'spliced' ELSE 'unspliced' END AS layer, sum(l_quantity) AS value
  FROM lineitem GROUP BY ALL
), x AS (
  SELECT cell_id, gene_id, sum(value) AS value FROM e GROUP BY ALL
), n AS (
  SELECT count(*) AS n_cells FROM supplier
)"""

LABELED_SQL = """
lab AS (
  SELECT l_suppkey AS cell_id, p_brand AS gene_id, (year(l_shipdate) - 1994)::DOUBLE AS t,
         coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'N'), 0) AS new, sum(l_quantity) AS total
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL
)"""

STEPS_SQL = """
steps AS (
  SELECT user_id AS traj_id, ts, event_id, epoch_us(ts) / 86400e6 AS t, event_type AS state, value FROM events
)"""
