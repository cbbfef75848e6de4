"""Licence scan by a positional index of rare template words.

Templates are short licence notices. Each is indexed by its rarest words (by
inverse document frequency over the whole corpus) with their positions. A
file's rarest index words vote for (template, offset) by relative position; an
offset with enough votes is verified: mandatory key phrases must stand in place
and most of the template's words must match.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, add_columns, map_batches, table, text_of

# The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Fixed values: (label, notice, mandatory key phrases), as the licences word them.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ["source and binary forms"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by", "4 0"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ["general public license version 3"]),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", ["general public license version 2"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["lesser general public license"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ["free of charge", "obtaining a copy"]),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
]

#: Separators of words: every ASCII byte but digits and lower-case letters, after lowering A-Z.
_SPACE = bytes(b if b >= 128 or chr(b).isalnum() and not chr(b).isupper() else 32 for b in range(256))
_WORDS = bytes(_SPACE[LOWER[b]] for b in range(256))
#: Index words of a template, its rarest ones.
INDEXED = 3


def words_of(text: str) -> list[bytes]:
    """Words after lowering A-Z: runs of characters that are digits, a-z or beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split()


@dataclass
class Index:
    """``postings``: word -> [(template, position)]; templates are (label, words, [(offset, words)], is base)."""

    templates: list[tuple[str, list[bytes], list[tuple[int, list[bytes]]], bool]]
    postings: dict[bytes, list[tuple[int, int]]]
    idf: dict[bytes, float]


def vocabulary() -> list[bytes]:
    return sorted({w for phrase in [*BASE, *(t[1] for t in TEMPLATES)] for w in phrase.encode().split()})


def build_index(doc_frequency: dict[bytes, int], n_docs: int) -> Index:
    idf = {w: math.log((1 + n_docs) / (1 + doc_frequency.get(w, 0))) for w in vocabulary()}
    templates, postings = [], {}
    for label, phrase, keys, base in [*((lab, p, [p], True) for p, lab in BASE.items()), *((*t, False) for t in TEMPLATES)]:
        words = phrase.encode().split()
        places = []
        for key in keys:
            k = key.encode().split()
            places.append((next(i for i in range(len(words)) if words[i : i + len(k)] == k), k))
        number = len(templates)
        templates.append((label, words, places, base))
        rare = sorted(range(len(words)), key=lambda i: (-idf[words[i]], i))[: 1 if base else INDEXED]
        for i in rare:
            postings.setdefault(words[i], []).append((number, i))
    return Index(templates, postings, idf)


def scan(text: str, index: Index, coverage: float = 0.75) -> tuple[int, int, int | None, int | None, str, str, float]:
    """(words, base places, first and last start of a place, base labels, labels, score)."""
    words = words_of(text)
    n = len(words)
    found = [(i, w) for i, w in enumerate(words) if w in index.postings]
    votes: Counter = Counter()
    for i, w in sorted(found, key=lambda x: -index.idf[x[1]]):
        for number, at in index.postings[w]:
            votes[number, i - at] += 1
    base_starts, base_labels, labels, score = [], set(), set(), 0.0
    for (number, at), count in votes.items():
        label, template, keys, base = index.templates[number]
        if base:
            if at >= 0 and words[at : at + len(template)] == template:
                base_starts.append(at)
                base_labels.add(label)
                score = 1.0
            continue
        if count < 2 or not all(at + o >= 0 and words[at + o : at + o + len(k)] == k for o, k in keys):
            continue
        matched = sum(0 <= at + j < n and words[at + j] == w for j, w in enumerate(template))
        if matched >= coverage * len(template):
            labels.add(label)
            score = max(score, matched / len(template))
    labels |= base_labels
    first, last = (min(base_starts), max(base_starts)) if base_starts else (None, None)
    return n, len(base_starts), first, last, ",".join(sorted(base_labels)), ",".join(sorted(labels)), score


def document_frequencies(docs: DataFrame) -> tuple[dict[bytes, int], int]:
    """In how many documents each word of the templates occurs, and how many documents there are; over all of them."""
    wanted = frozenset(vocabulary())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        n = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                for text in batch.slice(at, 512).column(0).to_pylist():
                    n += 1
                    seen.update(wanted.intersection(text.encode("utf-8", "surrogatepass").translate(_WORDS).split()))
        out = [*seen.items(), (b"", n)]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in out], pa.binary()), pa.array([c for _, c in out], pa.int64())], names=["word", "n"])

    rows = map_batches(docs.select(text_of().alias("text")), count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    got = {bytes(r.word): r.n for r in rows}
    return got, got.pop(b"", 0)


FIELDS = [T.StructField(n, t) for n, t in (("n_words", T.LongType()), ("n_base", T.LongType()), ("first_word", T.LongType()), ("last_word", T.LongType()), ("base_labels", T.StringType()), ("labels", T.StringType()), ("score", T.DoubleType()))]


def scan_documents(docs: DataFrame, coverage: float = 0.75, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with the columns of ``scan``; null and empty texts have no words and no labels."""
    index = build_index(*document_frequencies(docs))
    return add_columns(docs, FIELDS, lambda texts: (scan(t, index, coverage) for t in texts), keep=keep)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(table(spark, sf_dir, "documents"), keep=["doc_id"])
