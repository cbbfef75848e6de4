"""Helpers shared by the corpus operators.

Conventions that hold for all operators of this package:

* a null text counts as the empty text, an empty table gives an empty result;
* operators address the columns they need by name; names that they need beside
  the input's columns are chosen so that no column has them (``free_names``);
  where an operator adds columns to its input, a column of the same name is
  replaced;
* where rows must be told apart, a document is its ``doc_id`` and the 64-bit
  hash of its text: rows that repeat both are one document.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A-Z to a-z on UTF-8 bytes; other letters stay as they are.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir. Where that is unset, a local session gets a temporary one and a cluster one in its warehouse."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        own = tempfile.mkdtemp(prefix="checkpoints-") if sc.master.startswith("local") else f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or own)
    return sc.getCheckpointDir()


#: Tables whose rows are estimated to be at most so many bytes together are broadcast.
BROADCAST_BYTES = 64 << 20


def broadcast_if_small(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df``, a written table, marked for broadcast if its rows, of about ``row_bytes`` each, are few enough; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def free_names(columns: Iterable[str], *names: str) -> list[str]:
    """A name like each of ``names`` that none of ``columns`` has, whatever the case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while f"__{name}" in taken:
            name += "_"
        taken.add(f"__{name}")
        out.append(f"__{name}")
    return out


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts the lineage, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that go to Python at once: a batch of whole texts stays some megabytes.
BATCH_ROWS = 1000


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` in batches of at most ``BATCH_ROWS`` rows, which the session's conf says from then on.

    A task gives the memory that it has freed back to the system at its end, since workers outlive tasks.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        hand_back()

    return df.mapInArrow(whole, schema)


def hand_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library keeps what it likes


def gathered(batches: Iterator[pa.RecordBatch], size: Callable[[pa.RecordBatch], int], least: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in batches of ``size`` ``least`` or more, but for the last."""
    held, have = [], 0
    for batch in batches:
        held.append(batch)
        have += size(batch)
        if have >= least:
            yield pa.concat_batches(held) if len(held) > 1 else held[0]
            held, have = [], 0
    if held:
        yield pa.concat_batches(held)


def text_of(col: str = "text"):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def crc_of_id(col: str = "doc_id"):
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def add_columns(df: DataFrame, fields: list[T.StructField], make: Callable[[Iterable[str]], Iterator[tuple]], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) and the columns ``fields``, one tuple from ``make(texts)`` for each row.

    Runs as one Arrow map without a shuffle. ``make`` gets the whole texts of a
    batch as an iterable and yields as many tuples in that order.
    """
    added = {f.name.lower() for f in fields}
    names = [c for c in (keep if keep is not None else df.columns) if c.lower() not in added]
    (whole,) = free_names(names, "text")
    source = df.select(*[F.col(f"`{c}`") for c in names], text_of(text).alias(whole))
    schema = T.StructType([f for f in source.schema.fields if f.name != whole] + fields)
    out_types = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out_types)
        for batch in batches:
            # some thousand documents can hold many megabytes: work on slices
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                k = part.num_columns - 1
                rows = list(make(part.column(k).to_pylist()))
                columns = list(zip(*rows)) if rows else [()] * len(arrow)
                arrays = [part.column(i) for i in range(part.num_columns) if i != k]
                arrays += [pa.array(c, type=f.type) for c, f in zip(columns, arrow)]
                keep_fields = [part.schema.field(i) for i in range(part.num_columns) if i != k]
                yield pa.RecordBatch.from_arrays(arrays, schema=pa.schema(keep_fields + list(arrow)))

    return map_batches(source, run, schema)


def hot_lookup(big: DataFrame, small: DataFrame, key: str, n_big: int, share: float = 1 / 2000, how: str = "left", hot: list | None = None) -> DataFrame:
    """``big`` joined with ``small`` (unique in ``key``) on ``key``, safe against hot keys.

    Keys that hold more than ``share`` of the ``n_big`` rows of ``big`` number
    at most ``1 / share``, so their rows of ``small`` are broadcast; the other
    keys go through an ordinary shuffled join in which no key is hot. ``hot``:
    those keys, where the caller knows them.
    """
    least = max(64, int(n_big * share))
    if hot is None:
        hot = [r[0] for r in big.groupBy(key).count().where((F.col("count") > least) & F.col(key).isNotNull()).select(key).collect()]
    if not hot:
        return big.join(small, key, how)
    (mark,) = free_names([*big.columns, *small.columns], "hot")
    # literals, so no Python worker takes part
    flags = big.sparkSession.range(1).select(F.explode(F.array(*[F.lit(h).cast(big.schema[key].dataType) for h in hot])).alias(key))
    heads = small.join(F.broadcast(flags), key, "left_semi")
    marked = big.join(F.broadcast(flags.withColumn(mark, F.lit(True))), key, "left")
    warm = marked.where(F.col(mark)).drop(mark).join(F.broadcast(heads), key, how)
    cold = marked.where(F.col(mark).isNull()).drop(mark).join(small, key, how)
    return warm.unionByName(cold)


#: Edges that a task of ``contracted`` holds at once.
STARS = 1 << 17


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of the connected components of the edges (u, v), root the smallest node; roots have no row of their own."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != root[root]).any():
            root = root[root]
    child = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[child], nodes[root[child]]


def contracted(edges: DataFrame, each: int) -> DataFrame:
    """Fewer edges (u, v), u > v, with the components of ``edges``: stars of every ``each`` edges of a task, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, lambda b: b.num_rows, each):
            node, root = stars(*(c.to_numpy(zero_copy_only=False) for c in batch.columns))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["u", "v"])

    return map_batches(edges, run, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links (a, b)`` as ``(node, root)``, root the smallest node; nodes without links aren't listed.

    Tasks make stars of the edges they hold. Where stars of several tasks share nodes,
    large-star and small-star steps alternate on tables in the shared folder;
    a step is an aggregate with partial sums and a lookup join that is safe
    against hot nodes, so a component of any size spreads over all tasks.
    """
    edges = materialize(contracted(links.where("a <> b").select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v")), STARS))
    while True:
        # a task for as many edges as it holds at once, whatever the number of files
        edges = materialize(contracted(edges.coalesce(edges.count() // STARS + 1), STARS))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("most"), F.count(F.lit(1)).alias("n")))
        n, tied = least.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.expr("m < u and most > m"), 1))).first()
        # in a forest of stars a node above its smallest neighbour has no other
        if not tied:
            return least.select(F.col("u").alias("node"), F.least("u", "m").alias("root"))
        # large star: neighbours above a node are tied to the smallest of its neighbourhood
        large = hot_lookup(both, least.select("u", F.least("u", "m").alias("m")), "u", n, how="inner", hot=frequent(least, n)).where("v > u")
        large = materialize(large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: a node and its smaller neighbours are tied to the smallest of them
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")))
        small = hot_lookup(large, least.select("u", "m"), "u", n, how="inner", hot=frequent(least, n)).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = materialize(contracted(small.unionByName(least.select("u", F.col("m").alias("v"))), STARS))


def frequent(counts: DataFrame, total: int, share: float = 1 / 2000) -> list:
    """The hot keys of ``hot_lookup`` by ``counts (u, n)`` of ``total`` rows."""
    return [r[0] for r in counts.where(F.col("n") > max(64, int(total * share))).select("u").collect()]
