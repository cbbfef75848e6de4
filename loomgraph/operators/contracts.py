"""Architecture contracts over edges whose ends carry a unit (layer, package, region)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def layer_violations(edges: DataFrame, src_layer: str, dst_layer: str) -> DataFrame:
    """Edges from a lower layer (larger number) up to a higher one."""
    return edges.where(F.col(dst_layer) < F.col(src_layer))


def independence_violations(edges: DataFrame, src_unit: str, dst_unit: str) -> DataFrame:
    return edges.where(F.col(src_unit) != F.col(dst_unit))


def forbidden(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges from ``sources (src)`` to ``targets (dst)`` whose end isn't a source itself."""
    inner = sources.select(F.col("src").alias("dst"))
    return edges.join(sources, "src", "left_semi").join(targets, "dst", "left_semi").join(inner, "dst", "left_anti")


def required(sources: DataFrame, edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Sources that import none of the targets."""
    return sources.join(edges.join(targets, "dst", "left_semi").select("src"), "src", "left_anti")


def report(current: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Violations with state new, known or fixed."""
    c, k = current.select(*keys).distinct().withColumn("__c", F.lit(True)), known.select(*keys).distinct().withColumn("__k", F.lit(True))
    state = F.when(F.col("__k").isNull(), "new").when(F.col("__c").isNull(), "fixed").otherwise("known")
    return c.join(k, keys, "full_outer").withColumn("state", state).drop("__c", "__k")
