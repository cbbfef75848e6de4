"""Contiguous shards of near equal bytes.

Documents are put in order by range partitioning of narrow rows; each partition
reports its bytes and rows, the totals' prefix sums give every row its global
byte and row position, and the byte line is cut at equal targets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_names, map_batches, materialize, table, text_of


def assign_shards(docs: DataFrame, shards: int = 8, row: str | None = None) -> DataFrame:
    """(doc_id, text_hash, size, text_crc32, shard, slot) of each row of ``docs``, and its ``row``, the name of a column of unique numbers.

    Order: doc_id (nulls first), then text hash; rows that repeat both are laid
    out in any order, which can't be told apart. A row goes to the shard that
    holds its middle byte, so shards differ by less than the largest row. A
    null text has size 1. Slots count from 0 in each shard; some shards stay
    empty when there are fewer rows than shards.
    """
    spark = docs.sparkSession
    raw = F.col("text").cast("string")
    slim = docs.select("doc_id", F.xxhash64(text_of()).alias("text_hash"), (F.octet_length(text_of()) + F.lit(1)).cast("long").alias("size"), F.crc32(F.coalesce(raw, F.lit("")).cast("binary")).alias("text_crc32"), (F.col(row) if row else F.monotonically_increasing_id()).alias("tie"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["doc_id", "text_hash", "tie"]
    dealt = slim.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows, size = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            sizes = b.column(2).to_numpy(zero_copy_only=False)
            n, ends = len(sizes), np.cumsum(sizes)
            own = [pa.array(np.full(n, part, np.int64)), pa.array(np.arange(rows, rows + n)), pa.array(size + ends - sizes)]
            rows, size = rows + n, size + (int(ends[-1]) if n else 0)
            yield pa.RecordBatch.from_arrays([*b.columns, *own], names=[*b.schema.names, "part", "row_before", "byte_before"])

    placed = materialize(map_batches(dealt, place, dealt.schema.simpleString()[7:-1] + ", part long, row_before long, byte_before long"))
    # one row for each partition
    totals = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s")).orderBy("part").collect()
    rows = np.concatenate(([0], np.cumsum([r.n for r in totals]))).astype(np.int64)
    sizes = np.concatenate(([0], np.cumsum([r.s for r in totals]))).astype(np.int64)
    base = spark.createDataFrame([(int(r.part), int(a), int(s)) for r, a, s in zip(totals, rows, sizes)], "part long, part_row long, part_byte long")
    whole = max(1, int(sizes[-1]))
    at = placed.join(F.broadcast(base), "part")
    middle = 2 * (F.col("part_byte") + F.col("byte_before")) + F.col("size")
    # decimal, since bytes times shards can pass 2^63
    shard = F.floor(middle.cast("decimal(24,0)") * F.lit(shards) / F.lit(2 * whole).cast("decimal(24,0)")).cast("int")
    at = at.withColumn("shard", F.least(F.lit(shards - 1), shard))
    counts = {r.shard: r.n for r in at.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    first, before = [], 0
    for s in range(shards):
        first.append((s, before))
        before += counts.get(s, 0)
    starts = spark.createDataFrame(first, "shard int, shard_row long")
    return at.join(F.broadcast(starts), "shard").select("doc_id", "text_hash", "size", "text_crc32", *([F.col("tie").alias(row)] if row else []), "shard", (F.col("part_row") + F.col("row_before") - F.col("shard_row")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """``docs`` with the columns shard and slot (such columns of its own are replaced); ready for ``write.partitionBy("shard")``.

    Rows are told apart by a number that is written with them, so rows that
    repeat id and text, whatever their other columns, get one place each.
    """
    names = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    (row,) = free_names(docs.columns, "row")
    left = materialize(docs.select(*[F.col(f"`{c}`") for c in names], F.monotonically_increasing_id().alias(row)))
    places = assign_shards(left, shards, row).select(row, "shard", "slot")
    return left.join(places, row).drop(row)


def op6_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign_shards(table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
