"""Edges: merging, aggregation to groups, fan-in and fan-out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_edges(rows: DataFrame) -> DataFrame:
    """One row for each (src, dst): occurrences are distinct sites; the edge is lazy if every row is."""
    return rows.groupBy("src", "dst").agg(F.count_distinct("site").alias("occurrences"), F.bool_and("lazy").alias("lazy"))


def aggregate(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Edges between groups; edges within a group and those without one are dropped."""
    kept = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
    return kept.groupBy(F.col(src).alias("src"), F.col(dst).alias("dst")).agg(F.sum("occurrences").alias("occurrences"), F.count(F.lit(1)).alias("edges"), F.bool_and("lazy").alias("lazy"))


def fan(edges: DataFrame) -> DataFrame:
    """(node, fan_in, fan_out, instability) from distinct neighbours; instability is null for isolated nodes."""
    out = edges.where("src <> dst").groupBy(F.col("src").alias("node")).agg(F.count_distinct("dst").alias("o"))
    into = edges.where("src <> dst").groupBy(F.col("dst").alias("node")).agg(F.count_distinct("src").alias("i"))
    both = out.join(into, "node", "full_outer").select("node", F.coalesce("i", F.lit(0).cast("long")).alias("fan_in"), F.coalesce("o", F.lit(0).cast("long")).alias("fan_out"))
    return both.withColumn("instability", F.col("fan_out") / F.nullif(F.col("fan_in") + F.col("fan_out"), F.lit(0)))
