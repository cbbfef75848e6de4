"""Breadth-first walks from many starts at once, each of a bounded size, and what they reach."""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from loomgraph.operators.graphs import cut, together

# fixed values: nodes of one walk, and of all walks of a change together
WALK_NODES, ALL_NODES = 5000, 200_000

#: Nodes, or pieces of walks, that are rows of one Arrow batch at once.
LISTED_ROWS = 20_000
#: Marked nodes that are sent to the walks, at about 80 bytes each: 64 MB. More are joined by shuffle.
SENT_MARKS = 800_000


def _numbers(kind: T.DataType) -> bool:
    return isinstance(kind, T.IntegralType)


def _pack(values: np.ndarray, numbers: bool) -> bytes:
    """Nodes in a row as bytes: numbers as their steps, lowest bytes first, so rising ones take a byte or two each before any compression."""
    if not numbers:
        return pickle.dumps(values.tolist())
    steps = np.diff(values, prepend=np.int64(0))
    planes = ((steps << 1) ^ (steps >> 63)).view(np.uint8).reshape(-1, 8)
    width = next((k for k in range(8, 0, -1) if planes[:, k - 1].any()), 0) if len(values) else 0
    return len(values).to_bytes(8, "little") + planes[:, :width].T.tobytes()


def _unpack(data: bytes, numbers: bool) -> np.ndarray:
    if not numbers:
        values = pickle.loads(data)
        out = np.empty(len(values), object)
        out[:] = values
        return out
    n = int.from_bytes(data[:8], "little")
    planes = np.zeros((n, 8), np.uint8)
    if n and (width := (len(data) - 8) // n):
        planes[:, :width] = np.frombuffer(data, np.uint8, offset=8).reshape(width, n).T
    steps = planes.reshape(-1).view(np.uint64)
    return np.cumsum((steps >> np.uint64(1)).view(np.int64) ^ -(steps & np.uint64(1)).view(np.int64))


def _packed(df: DataFrame) -> DataFrame:
    """``df`` with its arrays ``nodes`` as bytes."""
    numbers = _numbers(df.schema["nodes"].dataType.elementType)
    schema = T.StructType([T.StructField("nodes", T.BinaryType()) if f.name == "nodes" else f for f in df.schema])

    def run(batches):
        for batch in batches:
            nodes = batch.column("nodes")
            as_array = (lambda x: x.values.cast(pa.int64()).to_numpy()) if numbers else (lambda x: np.array([*x.as_py(), None], object)[:-1])
            blobs = pa.array([_pack(as_array(x), numbers) for x in nodes], pa.binary())
            yield pa.RecordBatch.from_arrays([blobs if c == "nodes" else batch.column(c) for c in batch.schema.names], names=batch.schema.names)

    return df.mapInArrow(run, schema)


def _listed(pieces: DataFrame, kind: T.DataType) -> DataFrame:
    """(start, node, place), and what else ``pieces (start, place, nodes)`` have, of their nodes one by one."""
    numbers, arrow = _numbers(kind), to_arrow_type(kind)
    rest = [f for f in pieces.schema if f.name not in ("start", "place", "nodes")]
    schema = T.StructType([pieces.schema["start"], T.StructField("node", kind), T.StructField("place", T.LongType()), *rest])

    def some(batch: pa.RecordBatch, rows: list[int], parts: list[np.ndarray]) -> pa.RecordBatch:
        again = pa.array(np.repeat(rows, [len(p) for p in parts]), pa.int64())
        nodes = np.concatenate(parts)
        places = np.concatenate([np.arange(len(p)) for p in parts]) + batch.column("place").take(again).to_numpy()
        nodes = pa.array(nodes, pa.int64()).cast(arrow) if numbers else pa.array(nodes.tolist(), arrow)
        return pa.RecordBatch.from_arrays([batch.column("start").take(again), nodes, pa.array(places, pa.int64()), *[batch.column(f.name).take(again) for f in rest]], names=schema.names)

    def run(batches):
        for batch in batches:
            rows: list[int] = []
            parts: list[np.ndarray] = []
            size = 0
            for k in range(batch.num_rows):
                rows.append(k)
                parts.append(_unpack(batch.column("nodes")[k].as_py(), numbers))
                size += len(parts[-1])
                if max(size, len(rows)) >= LISTED_ROWS or k == batch.num_rows - 1:
                    yield some(batch, rows, parts)
                    rows, parts, size = [], [], 0

    return pieces.mapInArrow(run, schema)


def walks(edges: DataFrame, roots: DataFrame, limit: int = WALK_NODES, ahead: int | None = None, listed: bool = True) -> tuple[DataFrame | None, DataFrame]:
    """((start, node, place), (start, n, complete)): the nodes that each ``start`` of ``roots (start, node)`` reaches over ``edges (src, dst)``, in breadth-first order.

    Roots come first, by node; then, node by node in their order, the neighbours
    of each that weren't met yet, the smallest first. A walk ends where a
    further node would be its ``limit``-th and one more: it is then not
    complete. Roots all count, even if they are more than ``limit``. Null nodes
    and starts are left out. Without ``listed`` only the sizes are made, and of walks that end no nodes are kept.

    A round takes the first nodes of each walk's queue, as many as have edges for
    the room that it has left, or a quarter of the edges followed before (``ahead`` edges,
    or as many as before, if that is given; one node at least); what is found comes behind the rest of the queue, and a walk with no
    room left is taken no further. So a walk follows little more than the edges that it needs, in rounds
    whose number grows with their logarithm, and not those of each node in line.
    Of the neighbours of one node a walk has met at most ``limit`` (or its roots) and takes at
    most ``limit`` more, so a node that points everywhere is cut to so many, the
    first, with the same result; no table has a row for each pair that merely reaches.

    A node's neighbours are one row of packed bytes, and so is what a round finds for a walk: these meet in
    the walk's task, where nodes met before are left out. One task holds one walk at once, of ``limit`` nodes or its roots.
    """
    roots = cut(roots.where("start is not null and node is not null").select("start", "node").distinct())
    most = roots.groupBy("start").count().agg(F.max("count")).first()[0] or 0
    edges = edges.where("src is not null and dst is not null").select("src", "dst").distinct()
    kind = roots.select("node").union(edges.select("dst")).schema["node"].dataType
    numbers = _numbers(kind)
    first = F.row_number().over(Window.partitionBy("src").orderBy("dst"))
    edges = edges.withColumn("k", first).where(F.col("k") <= limit + max(limit, most) + 1)
    edges = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"), F.array_sort(F.collect_list(F.col("dst").cast(kind))).alias("nodes"))
    edges = cut(_packed(edges))
    degrees = edges.select("node", "degree")

    def marked(queue: DataFrame) -> DataFrame:
        """The queue with ``now``: whether a node's turn has come; ``tried`` counts the edges followed by then. Nodes without edges are done."""
        w = Window.partitionBy("start")
        before = F.coalesce(F.sum("degree").over(w.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        room = F.greatest(F.lit(limit) - F.col("n"), F.lit(0)) + 1
        follow = F.greatest(room, F.col("tried") / 4) if ahead is None else F.greatest(F.lit(ahead), "tried")
        told = queue.join(degrees, "node").withColumn("now", before < follow)
        return cut(told.select("start", "node", "place", "n", "now", (F.col("tried") + F.sum(F.when(F.col("now"), F.col("degree"))).over(w)).alias("tried")))

    start = roots.schema["start"]
    schema = T.StructType([start, *[T.StructField(c, T.LongType()) for c in ("place", "n", "tried")], T.StructField("short", T.BooleanType()), T.StructField("nodes", T.BinaryType())])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])

    def step(t: pa.Table) -> pa.Table:
        rows = sorted(zip(t.column("met").to_pylist(), t.column("place").to_pylist(), range(t.num_rows)), key=lambda r: (not r[0], r[1]))
        blobs, tried = t.column("nodes"), max(t.column("tried").to_pylist())
        parts = [_unpack(blobs[k].as_py(), numbers) for _, _, k in rows]
        n = sum(len(p) for p, (met, _, _) in zip(parts, rows) if met)
        new = pd.unique(np.concatenate(parts))[n:]
        kept = new[: max(limit - n, 0)]
        short = len(new) > len(kept)
        nodes = _pack(kept, numbers) if listed or not short else None
        return pa.Table.from_arrays([t.column("start").slice(0, 1).cast(arrow.field("start").type), *[pa.array([v]) for v in (n, n + len(kept), tried, short)], pa.array([nodes], pa.binary())], schema=arrow)

    own = roots.groupBy("start").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.col("node").cast(kind))).alias("nodes"))
    zero = F.lit(0).cast("long")
    seen = [cut(_packed(own.select("start", zero.alias("place"), "n", zero.alias("tried"), F.lit(False).alias("short"), "nodes")))]
    queue = marked(_listed(seen[0].select("start", "place", "n", "tried", "nodes"), kind))
    while not queue.isEmpty():
        turn = queue.where("now").join(edges, "node").select("start", "place", "tried", F.lit(False).alias("met"), "nodes")
        # walks that go on; those that have ended are read no more
        before = together(seen).join(queue.select("start").distinct(), "start", "left_semi").select("start", "place", "tried", F.lit(True).alias("met"), "nodes")
        found = cut(turn.unionByName(before).groupBy("start").applyInArrow(step, schema))
        fresh = _listed(found.where("not short").select("start", "place", "n", "tried", "nodes"), kind)
        line = queue.where("not now").select("start", "node", "place", "tried").join(found.where("not short").select("start", "n"), "start")
        queue = marked(line.unionByName(fresh))
        # later rounds' tables, mostly small, are put together by tens, so plans stay short
        seen = [*seen[:3], cut(together([*seen[3:], found]))] if len(seen) == 13 else [*seen, found]
    pieces = together(seen)
    sizes = pieces.groupBy("start").agg(F.max("n").alias("n"), (~F.bool_or("short")).alias("complete"))
    return (_listed(pieces.select("start", "place", "nodes"), kind) if listed else None), sizes


def within_total(nodes: DataFrame, sizes: DataFrame, starts: DataFrame, total: int = ALL_NODES) -> tuple[DataFrame, DataFrame]:
    """Walks of the starts of a wave, in order, until ``total`` nodes are used up: of ``starts (wave, start, order)``.

    (wave, start, node, place) and (wave, start, n, complete); the walk that the
    total ends in is cut there and not complete, those behind it have no nodes and aren't either.
    """
    own = starts.join(sizes, "start", "left").select("wave", "start", "order", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("complete", F.lit(True)).alias("complete"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("wave").orderBy("order", "start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = cut(own.withColumn("room", F.greatest(F.lit(0), F.lit(total) - before)))
    left = room.select("wave", "start", F.least("n", "room").alias("n"), (F.col("complete") & (F.col("n") <= F.col("room")) & (F.col("room") > 0)).alias("complete"))
    return nodes.join(room.select("wave", "start", "room"), "start").where(F.col("place") < F.col("room")).select("wave", "start", "node", "place"), left


def reached(nodes: DataFrame, sizes: DataFrame, marked: DataFrame, shown: int = 3) -> DataFrame:
    """(start, n, complete, marked, names) of walks: how many of the ``marked (node, name)`` each reaches, roots included, and the first ``shown`` names in order."""
    named = marked.where("node is not null").select("node", "name").distinct()
    own = cut(named.groupBy("node").agg(F.slice(F.array_sort(F.collect_set("name")), 1, shown).alias("names")))
    hits = nodes.select("start", "node").join(F.broadcast(own) if own.count() <= SENT_MARKS else own, "node").select("start", "names")
    kept = T.StructType([hits.schema["start"], T.StructField("marked", T.LongType()), T.StructField("names", hits.schema["names"].dataType)])

    def run(batches):
        # a walk's nodes stand together, so few rows of a batch are sent on
        for batch in batches:
            starts = batch.column("start").to_pylist()
            met: dict = {}
            for k, names in zip(starts, batch.column("names").to_pylist()):
                met.setdefault(k, []).append(names)
            first = [sorted({x for names in v for x in names})[:shown] for v in met.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(met), batch.schema.field("start").type), pa.array([len(v) for v in met.values()], pa.int64()), pa.array(first, batch.schema.field("names").type)], names=kept.names)

    by_start = hits.mapInArrow(run, kept).groupBy("start").agg(F.sum("marked").alias("marked"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))), 1, shown).alias("names"))
    return sizes.join(by_start, "start", "left").select("start", "n", "complete", F.coalesce("marked", F.lit(0)).cast("long").alias("marked"), F.coalesce("names", F.array().cast("array<string>")).alias("names"))
