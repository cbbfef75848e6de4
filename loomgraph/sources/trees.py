"""File trees as rows (path, content): directories on disk, overlays, nested trees, decoded texts, state digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.texts import glob_regex

SCHEMA = "path string, content binary"


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def directory(spark: SparkSession, root: str, excluded: tuple[str, ...] = (".git", "node_modules")) -> DataFrame:
    """Every file below ``root`` by its path from there, without those below an excluded directory name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    clean = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    below = F.regexp_replace("path", r"^[a-z]+:/*", "")
    rows = files.select(F.substring(below, len(clean) + 2, 1 << 30).alias("path"), "content")
    for name in excluded:
        rows = rows.where(~F.array_contains(F.split("path", "/"), name))
    return rows


def overlay(base: DataFrame, overrides: DataFrame) -> DataFrame:
    """``base`` with some paths replaced or added; an override whose content is null deletes."""
    return base.join(overrides.select("path"), "path", "left_anti").unionByName(overrides.where("content is not null").select(*base.columns))


def nested(base: DataFrame, inner: DataFrame, prefix: str) -> DataFrame:
    """``base`` with the tree ``inner`` below ``prefix``, in place of what is there."""
    kept = base.where(~F.col("path").startswith(prefix.rstrip("/") + "/"))
    return kept.unionByName(inner.withColumn("path", F.concat(F.lit(prefix.rstrip("/") + "/"), "path")).select(*base.columns))


def text_of(content: Column, max_bytes: int = 1_000_000) -> Column:
    """The content as text; null if it is missing, holds a zero byte or is longer than ``max_bytes``."""
    plain = (F.length(content) <= max_bytes) & ~F.contains(content, F.lit(b"\x00"))
    return F.when(plain, F.try_validate_utf8(content.cast("string")))


def ancestors(path: Column) -> Column:
    """The directories above a path, the topmost first."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def directories(files: DataFrame) -> DataFrame:
    return files.select(F.explode(ancestors(F.col("path"))).alias("directory")).distinct()


def blobs(files: DataFrame) -> DataFrame:
    """(path, blob): the version-control hash of each content."""
    header = F.encode(F.concat(F.lit("blob "), F.length("content").cast("string")), "utf-8")
    return files.select("path", F.sha1(F.concat(header, F.lit(b"\x00"), "content")).alias("blob"))


def changed_paths(a: DataFrame, b: DataFrame) -> DataFrame:
    """Paths whose blob differs between two (path, blob) frames, or that only one holds."""
    j = a.select("path", F.col("blob").alias("x")).join(b.select("path", F.col("blob").alias("y")), "path", "full_outer")
    return j.where(~F.col("x").eqNullSafe(F.col("y"))).select("path")


def topmost(dirs: DataFrame) -> DataFrame:
    """Directories (directory) without those below another one."""
    inner = dirs.select("directory", F.explode(ancestors(F.col("directory"))).alias("above"))
    nested_ones = inner.join(dirs.select(F.col("directory").alias("above")), "above", "left_semi").select("directory")
    return dirs.join(nested_ones, "directory", "left_anti")


def matching(files: DataFrame, patterns: list[str]) -> DataFrame:
    return files.where(F.col("path").rlike("|".join(f"(?:{glob_regex(p)})" for p in patterns))) if patterns else files.limit(0)
