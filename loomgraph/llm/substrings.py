"""Substring dedup by content-defined chunks.

A gear rolling hash over the last 16 bytes of a text (its words joined by single
spaces) marks cut points, moved to the end of their word; of ``LONGEST`` words without one
the word of the smallest hash is one. So an insertion moves no cut but those
beside it. Chunks have a digest each. A single one may be a word or two, so what
is looked up are the shortest sequences of neighbouring chunks with ``min_words``
words or more, from each chunk on and up to the last one, by a digest of
their chunks' digests. Of each sequence the first document (smallest doc_id, then text hash)
keeps it, in others its chunks go. So whatever goes stands in sequences of whole
chunks that one other document holds as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if_small, free_names, hot_lookup, map_batches, materialize, table, text_of

#: One cut in so many bytes on average; a passage needs two cuts to be found.
AVERAGE = 32
#: Of so many words in a row one is the last of its chunk: where no cut falls, that with the smallest hash.
LONGEST = 12
#: Shorter repeats stay: idioms, names, licence lines.
MIN_WORDS = 16

_GEAR = np.random.default_rng(20240501).integers(0, 2**32, 256, dtype=np.uint32)
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash at each byte: sum of GEAR[b] shifted by its distance, over 16 bytes, by doubling."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8):
        if len(h) > step:
            h[step:] = h[step:] + (h[:-step].copy() << np.uint32(step))
    return h


def split(text: str) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(words joined by single spaces, the end of each word, the numbers of the chunks' last words)."""
    words = text.encode("utf-8", "surrogatepass").split()
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if not words:
        return joined, ends, ends
    h = gear(np.frombuffer(joined, np.uint8)) >> np.uint32(15)
    last = np.unique(np.minimum(np.searchsorted(ends, np.flatnonzero(h % AVERAGE == 0)), len(words) - 1))
    if len(words) >= LONGEST:
        # words and their hashes tell where a stretch without a cut gets one, so it gets the same one in any document
        before = np.searchsorted(last, np.arange(len(words) + 1))
        bare = np.flatnonzero(before[LONGEST:] == before[:-LONGEST])
        if len(bare):
            at = h[ends - 1]
            least = np.concatenate([b + np.lib.stride_tricks.sliding_window_view(at, LONGEST)[b].argmin(1) for b in np.array_split(bare, len(bare) // 4096 + 1)])
            last = np.concatenate((last, least))
    return joined, ends, np.unique(np.append(last, len(words) - 1))


def _digests(joined: bytes, ends: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[int]:
    import xxhash

    begin = np.where(first > 0, ends[first - 1] + 1, 0)
    one = xxhash.xxh64_intdigest
    return np.fromiter((one(joined[a:b]) for a, b in zip(begin.tolist(), ends[last].tolist())), np.uint64, len(last)).view(np.int64).tolist()


def chunk(text: str) -> tuple[list[int], list[int]]:
    """(signed 64-bit digests, numbers of words) of the chunks; none for a text without words."""
    joined, ends, last = split(text)
    if not len(last):
        return [], []
    first = np.concatenate(([0], last[:-1] + 1))
    return _digests(joined, ends, first, last), (last - first + 1).tolist()


def sequences(sizes: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) chunks of the shortest sequences of at least ``min_words`` words: from each chunk on, and up to the last chunk."""
    upto = np.concatenate(([0], np.cumsum(sizes)))
    if upto[-1] < min_words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    last = np.searchsorted(upto, upto[:-1] + min_words) - 1
    first = np.flatnonzero(last < len(sizes))
    last = last[first]
    back = int(np.searchsorted(upto, upto[-1] - min_words, side="right")) - 1
    if last[-1] != len(sizes) - 1 or first[-1] != back:
        first, last = np.append(first, back), np.append(last, len(sizes) - 1)
    return first, last


def sequence_digests(text: str, min_words: int = MIN_WORDS) -> list[int]:
    """Digests of the sequences of ``text``; none for fewer than ``min_words`` words."""
    import xxhash

    digests, sizes = chunk(text)
    first, last = sequences(np.array(sizes, np.int64), min_words)
    data, one = memoryview(np.array(digests, np.int64).tobytes()), xxhash.xxh64_intdigest
    return np.fromiter((one(data[8 * a : 8 * b + 8]) for a, b in zip(first.tolist(), last.tolist())), np.uint64, len(first)).view(np.int64).tolist()


def cut(text: str, repeated: list[int], min_words: int = MIN_WORDS) -> tuple[str, list[tuple[int, int]], int]:
    """(text without the chunks of the sequences ``repeated``, their spans in ``text``, their words)."""
    if not repeated:
        return text, [], 0
    _, _, ends = split(text)
    ends = ends + 1
    begins = np.concatenate(([0], ends[:-1]))
    first, last = sequences(ends - begins, min_words)
    gone: list[list[int]] = []
    for i in sorted(set(repeated), key=lambda i: first[i]):
        a, b = int(begins[first[i]]), int(ends[last[i]])
        if gone and gone[-1][1] >= a:
            gone[-1][1] = max(gone[-1][1], b)
        else:
            gone.append([a, b])
    places = [m.span() for m in _WORD.finditer(text)]
    spans, out, at = [], [], 0
    for a, b in gone:
        lo, hi = places[a][0], places[b][0] if b < len(places) else len(text)
        spans.append((lo, hi))
        out.append(text[at:lo])
        at = hi
    out.append(text[at:])
    return "".join(out), spans, sum(b - a for a, b in gone)


def repeated_chunks(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_hash, repeated) for documents that hold sequences of chunks of an earlier document; ``repeated``: the sequences' numbers."""
    slim = docs.select("doc_id", F.xxhash64(text_of()).alias("text_hash"), text_of().alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                digests = [sequence_digests(t, min_words) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(digests, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "digests"])

    chunks = materialize(map_batches(slim, run, f"doc_id {kind}, text_hash long, digests array<long>"))
    n = chunks.agg(F.sum(F.size("digests"))).first()[0] or 0
    own = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("text_hash").alias("text_hash"))
    each = chunks.select(own.alias("own"), F.explode(F.array_distinct("digests")).alias("digest"))
    shared = materialize(each.groupBy("digest").agg(F.min("own").alias("owner"), F.max("own").alias("other"), F.count(F.lit(1)).alias("n")).where("owner <> other").drop("other"))
    # at most 2000 digests can hold a 2000th of all rows each
    hot = [r[0] for r in shared.where(F.col("n") > max(64, n // 2000)).select("digest").collect()]
    placed = chunks.select(own.alias("own"), F.posexplode("digests").alias("at", "digest"))
    met = hot_lookup(placed, shared.drop("n"), "digest", n, how="inner", hot=hot).where("owner <> own")
    return met.groupBy("own").agg(F.collect_set("at").alias("repeated")).select("own.doc_id", "own.text_hash", "repeated")


def dedup_substrings(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with ``text`` cut, n_chars (where there is such a column) set anew, and the columns removed_words and removed_spans.

    Every row stays, also where nothing of its text is left. Rows that repeat
    id and text are one document and keep or lose the same chunks. Repeats
    within one document stay. ``removed_spans`` are characters of the old text.
    """
    id_, other, own, list_ = free_names(docs.columns, "id", "other", "own", "repeated")
    repeated = materialize(repeated_chunks(docs, min_words).toDF(id_, other, list_))
    entries, rows = repeated.agg(F.coalesce(F.sum(F.size(list_)), F.lit(0)), F.count(F.lit(1))).first()
    keep = [c for c in docs.columns if c.lower() not in ("removed_words", "removed_spans")]
    left = docs.select(*[F.col(f"`{c}`") for c in keep]).withColumn(own, F.xxhash64(text_of()))
    # the lists go to the texts where they are few, else both are shuffled
    repeated = broadcast_if_small(repeated, 64 + 4 * entries // max(1, rows))
    both = left.join(repeated, (F.col(own) == F.col(other)) & F.col("doc_id").eqNullSafe(F.col(id_)), "left").drop(own, other, id_)
    at_text, at_chars = keep.index("text"), keep.index("n_chars") if "n_chars" in keep else None
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([*both.schema.fields[:-1], T.StructField("removed_words", T.IntegerType()), T.StructField("removed_spans", span)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                cols = list(part.columns[:-1])
                done = [(t, [], 0) if not r or t is None else cut(t, r, min_words) for t, r in zip(cols[at_text].to_pylist(), part.columns[-1].to_pylist())]
                if at_chars is not None:
                    old = cols[at_chars]
                    sizes = [n if not d[1] else len(d[0]) for d, n in zip(done, old.to_pylist())]
                    cols[at_chars] = pa.array(sizes, old.type)
                cols[at_text] = pa.array([d[0] for d in done], cols[at_text].type)
                cols.append(pa.array([d[2] for d in done], pa.int32()))
                cols.append(pa.array([[{"start": a, "end": b} for a, b in d[1]] for d in done], kind))
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, "removed_words", "removed_spans"])

    return map_batches(both, run, schema)


def op3_gear_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.array_join(F.transform("removed_spans", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")
    return out.select("doc_id", "text", "removed_words", spans.alias("removed_spans"))
