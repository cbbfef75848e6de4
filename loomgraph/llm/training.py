"""Bounded samples of labelled rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, materialize, text_of


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, held_out=None) -> list[tuple[str, int]]:
    """(text, label) of at most ``per_class`` labelled documents of each class, in a fixed pseudo-random order; texts of any length.

    ``held_out`` is a condition on doc_id whose rows are never read (default:
    crc32 of the id modulo 3 is 1). Labels other than 0 and 1 count as absent,
    as do null ids; of rows that repeat an id one text is taken. Labels without
    a document are passed over: more labels are looked up until there are
    enough documents or no labels left.
    """
    held_out = crc_of_id() % 3 == 1 if held_out is None else held_out
    own = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & ~held_out & F.col("y").isin(0, 1))
    own = materialize(own.groupBy("doc_id").agg(F.max("y").alias("y")))
    out: list[tuple[str, int]] = []
    for y in (0, 1):
        own_class = own.where(F.col("y") == y)
        tried = 2 * per_class
        while True:
            ids = own_class.orderBy(F.xxhash64("doc_id"), "doc_id").limit(tried)
            found = docs.select("doc_id", text_of().alias("text")).join(ids, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
            rows = found.orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).select("text").collect()
            if len(rows) >= per_class or ids.count() < tried:
                break
            tried *= 4
        out += [(r.text, y) for r in rows]
    return out
