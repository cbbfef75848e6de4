"""Merkle fingerprints: leaves, paragraphs, sections, root.

A paragraph is a line; its leaves are its sentences, long ones in steps of
``STEP`` characters. Paragraphs form sections: a section ends after a paragraph
whose digest is divisible by ``SECTION``, so sections found in two texts line up
again after an edit. Equal roots mean equal texts; where roots differ, sections
are paired off by their digests, then the paragraphs of the sections left over,
then the leaves of the paragraphs left over. What pairs off, weighted by its
characters, tells how alike the texts are, and the leaves left over locate edits.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, materialize, table, text_of

STEP, SECTION = 24, 8
_LEAF = re.compile(r"[^.!?|]+[.!?|]*\s*|[.!?|]+\s*")


def _digest(children: list[bytes]) -> bytes:
    return hashlib.blake2b(b"".join(children), digest_size=16).digest()


class Branch:
    """A node of a tree: ``digest``, ``chars`` of its leaves, ``children`` (empty in leaves), and ``at``, where its text begins."""

    __slots__ = ("at", "chars", "children", "digest")

    def __init__(self, digest: bytes, chars: int, at: int, children: list[Branch]) -> None:
        self.digest, self.chars, self.at, self.children = digest, chars, at, children


class Tree:
    """The tree of one text: ``root`` and ``sections``, whose children are paragraphs, whose children are leaves."""

    __slots__ = ("chars", "root", "sections")

    def __init__(self, text: str) -> None:
        import xxhash

        one = xxhash.xxh3_128_digest
        self.chars, self.sections = len(text), []
        section: list[Branch] = []
        at = 0

        def close() -> None:
            self.sections.append(Branch(_digest([p.digest for p in section]), sum(p.chars for p in section), section[0].at if section else at, list(section)))
            section.clear()

        for line in text.split("\n"):
            leaves, begin = [], at
            for piece in _LEAF.findall(line):
                for k in range(0, len(piece), STEP):
                    cut = piece[k : k + STEP]
                    leaves.append(Branch(one(cut.encode("utf-8", "surrogatepass")), len(cut), at, []))
                    at += len(cut)
            # the line end belongs to the paragraph: "a\n" and "a" differ
            section.append(Branch(_digest([x.digest for x in leaves]), at - begin, begin, leaves))
            at += 1
            if section[-1].digest[0] % SECTION == 0:
                close()
        close()
        self.root = _digest([b"root", *(x.digest for x in self.sections)])

    @property
    def fingerprint(self) -> str:
        return self.root.hex()


def pair_off(a: list[Branch], b: list[Branch]) -> tuple[int, list[Branch], list[Branch]]:
    """(characters of the branches that pair off by equal digests, the branches of ``a`` and of ``b`` left over)."""
    free = Counter(x.digest for x in a)
    common, left = 0, []
    for x in b:
        if free.get(x.digest, 0):
            free[x.digest] -= 1
            common += x.chars
        else:
            left.append(x)
    rest = []
    # the last of equal branches stay, as the first ones paired off
    for x in reversed(a):
        if free.get(x.digest, 0):
            free[x.digest] -= 1
            rest.append(x)
    return common, rest[::-1], left


def descend(a: Tree, b: Tree) -> tuple[int, list[Branch]]:
    """(characters in common, leaves of ``b`` that ``a`` lacks), from the root down: equal branches count whole, only differing ones are opened."""
    if a.root == b.root:
        return a.chars, []
    common, own, other = 0, a.sections, b.sections
    for level in ("sections", "paragraphs", "leaves"):
        more, own, other = pair_off(own, other)
        common += more
        if level != "leaves":
            own, other = ([c for x in xs for c in x.children] for xs in (own, other))
    return common, other


def likeness(a: Tree, b: Tree) -> float:
    """1 for equal texts, else the share of characters in branches that both have (0 to 1); an empty text is like the empty text only."""
    if a.root == b.root:
        return 1.0
    whole = a.chars + b.chars
    return min(1.0, 2.0 * descend(a, b)[0] / whole) if whole else 0.0


def locate_edits(a: Tree, b: Tree) -> list[tuple[int, int]]:
    """Spans (start, end) of ``b``'s text whose leaves aren't in the branches of ``a`` that differ from its own."""
    out: list[tuple[int, int]] = []
    for leaf in sorted(descend(a, b)[1], key=lambda x: x.at):
        if out and out[-1][1] == leaf.at:
            out[-1] = (out[-1][0], leaf.at + leaf.chars)
        else:
            out.append((leaf.at, leaf.at + leaf.chars))
    return out


def edit(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many (or all) of ``following``."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k] if k else text


RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edits string"


def compare(text: str, own: Tree, following: str, after: Tree) -> tuple:
    edited = edit(text, following)
    changed = own if edited == text else Tree(edited)
    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    edits = ",".join(f"{a}-{b}" for a, b in locate_edits(own, changed))
    return len(text), sha, own.fingerprint, changed.fingerprint, likeness(own, changed), likeness(own, after), edits


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, edits) of each row.

    ``edits``: spans of the edited text that the tree locates, as ``start-end``, comma-joined.

    The next document is the one after it in descending doc_id (nulls last,
    ties by text hash); after the last comes the first, so a single row is its
    own next. A null text is the empty text.

    The texts are shuffled once, by range; a task compares neighbours and hands
    on its first and last row, and those few are joined across tasks.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col("doc_id").desc_nulls_last(), F.col("h"), F.col("tie")]
    rows = docs.select("doc_id", text_of().alias("text"), F.xxhash64(text_of()).alias("h"), F.monotonically_increasing_id().alias("tie"))
    dealt = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("doc_id", "text")
    schema = f"doc_id {kind}, {RESULT}, part int, edge string, text string"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last = None

        def send(out: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*out))
            kinds = [ids, pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64(), pa.string(), pa.int32(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

        ids = None
        for batch in batches:
            ids = batch.schema.field(0).type
            for at in range(0, batch.num_rows, 256):
                out = []
                piece = batch.slice(at, 256)
                for doc_id, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                    tree = Tree(text)
                    if last is None:
                        out.append((doc_id, *[None] * 7, part, "first", text))
                    else:
                        out.append((last[0], *compare(last[1], last[2], text, tree), part, None, None))
                    last = (doc_id, text, tree)
                if out:
                    yield send(out)
        if last is not None:
            yield send([(last[0], *[None] * 7, part, "last", last[1])])

    done = materialize(map_batches(dealt, run, schema))
    # two rows for each partition that has rows
    full = [r.part for r in done.where("edge = 'first'").select("part").orderBy("part").collect()]
    if not full:
        return done.drop("part", "edge", "text")
    order = spark.createDataFrame([(p, k) for k, p in enumerate(full)], "part int, k int")
    edges = done.where("edge is not null").join(F.broadcast(order), "part")
    pair = F.when(F.col("edge") == "last", F.col("k")).otherwise(F.pmod(F.col("k") - 1, F.lit(len(full))))
    edges = edges.select("doc_id", "text", "edge", pair.alias("pair"))

    def join(pdf):
        import pandas as pd

        own, after = pdf[pdf.edge == "last"].iloc[0], pdf[pdf.edge == "first"].iloc[0]
        row = compare(own.text, Tree(own.text), after.text, Tree(after.text))
        return pd.DataFrame([(own.doc_id, *row)], columns=names[:8])

    joined = edges.groupBy("pair").applyInPandas(join, f"doc_id {kind}, {RESULT}")
    return done.where("edge is null").drop("part", "edge", "text").unionByName(joined)


def op10_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))
