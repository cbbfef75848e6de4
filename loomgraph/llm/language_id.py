"""Language of documents: sparse multinomial logistic regression on TF-IDF character n-grams.

A text's n-grams (lengths 1 to 4, over lower-cased letters with one space for
each run of other characters) are hashed into ``BUCKETS``. Document
frequencies are counted over all training documents. Weights are trained by
follow-the-regularised-leader with L1 and L2 penalties, so most stay exactly
zero; a temperature fitted on documents apart calibrates the probabilities.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, crc_of_id, map_batches, table, text_of

LENGTHS, BUCKETS = 4, 1 << 15
#: Documents that training reads at most, in equal shares for each language but at least ``LEAST_PER_LANG``.
SAMPLE_ROWS, LEAST_PER_LANG = 1600, 8
#: One in so many sampled documents of a language is kept for the temperature.
CALIBRATION = 5
#: Learning rate, its start, and the penalties of the absolute and of the squared weights.
ALPHA, BETA, L1, L2 = 1.0, 0.1, 0.02, 0.001
EPOCHS = 6
NO_LANGUAGE = "und"
#: Characters of a text that are looked at at once.
SLICE = 1 << 18

_letters: list[np.ndarray] = []


def is_letter(x: np.ndarray) -> np.ndarray:
    """Which code points are letters (Unicode categories L*)."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x10000)), bool, 0x10000))
    out = _letters[0][np.minimum(x, 0xFFFF)]
    high = np.flatnonzero(x > 0xFFFF)
    if len(high):
        kinds, back = np.unique(x[high], return_inverse=True)
        out[high] = np.array([c <= sys.maxunicode and chr(c).isalpha() for c in kinds.tolist()])[back]
    return out


def grams_of(text: str) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of the whole text, slice by slice; nothing for a text without letters."""
    tail, open_word = np.array([32], np.uint32), False
    for at in range(0, len(text) + 1, SLICE):
        x = np.frombuffer(text[at : at + SLICE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = is_letter(x)
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        if len(x):
            keep[0] |= open_word
            open_word = bool(letter[-1])
        x = np.where(letter, x, np.uint32(32))[keep]
        if at + SLICE > len(text) and open_word:
            x = np.append(x, np.uint32(32))
        p = len(tail)
        x = np.concatenate((tail, x))
        h = x
        for n in range(1, LENGTHS + 1):
            if n > 1:
                h = h[:-1] * np.uint32(0x01000193) ^ x[n - 1 :]
            own = h[max(0, p - n + 1) :]
            if n == 1:
                own = own[own != 32]
            if len(own):
                yield (((own ^ (own >> np.uint32(15))) * np.uint32(0x9E3779B1)) >> np.uint32(17)).astype(np.int32)
        tail = x[-(LENGTHS - 1) :]


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of a whole text; both empty if it has no letter."""
    if len(text) <= 1 << 14:
        parts = list(grams_of(text))
        return np.unique(np.concatenate(parts), return_counts=True) if parts else (np.empty(0, np.int32), np.empty(0, np.int64))
    total = np.zeros(BUCKETS, np.int64)
    for part in grams_of(text):
        total += np.bincount(part, minlength=BUCKETS)
    held = np.flatnonzero(total).astype(np.int32)
    return held, total[held]


@dataclass
class Model:
    """``weights`` (bucket, language), ``bias`` and inverse document frequencies; ``languages`` sorted."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, buckets: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """TF-IDF of length 1."""
        v = (1 + np.log(counts)) * self.idf[buckets]
        return v / max(np.sqrt(v @ v), 1e-12)

    def logits(self, buckets: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.vector(buckets, counts) @ self.weights[buckets] + self.bias

    def predict(self, text: str) -> tuple[str, float]:
        buckets, counts = features(text)
        if not len(buckets) or not self.languages:
            return NO_LANGUAGE, 0.0
        p = softmax(self.logits(buckets, counts) / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


@dataclass
class Ftrl:
    """Follow the regularised leader for one table of coordinates: ``z`` sums gradients, ``n`` their squares."""

    shape: tuple[int, ...]
    l1: float = L1
    z: np.ndarray = field(init=False)
    n: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.z, self.n = np.zeros(self.shape), np.zeros(self.shape)

    def weights(self, at=slice(None)) -> np.ndarray:
        """Zero where the sum of gradients stays within the L1 penalty."""
        z = self.z[at]
        return -np.sign(z) * np.maximum(np.abs(z) - self.l1, 0) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2)

    def step(self, at, w: np.ndarray, g: np.ndarray) -> None:
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def temperature_of(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden sections of its logarithm over 1/20 to 20; 1 without documents or with one language.

    Of n documents one more is taken to be of another language, so where all
    are told right the temperature stays where n documents can say it.
    """
    n, k = logits.shape
    if not n or k < 2:
        return 1.0
    target = np.full((n, k), 1 / (n + 1) / (k - 1))
    target[np.arange(n), y] = n / (n + 1)

    def loss(log_t: float) -> float:
        return -(target * np.log(np.maximum(softmax(logits / np.exp(log_t)), 1e-300))).sum()

    lo, hi, share = -np.log(20.0), np.log(20.0), (np.sqrt(5) - 1) / 2
    a, b = hi - share * (hi - lo), lo + share * (hi - lo)
    for _ in range(40):
        if loss(a) <= loss(b):
            hi, b = b, a
            a = hi - share * (hi - lo)
        else:
            lo, a = a, b
            b = lo + share * (hi - lo)
    return float(np.exp((lo + hi) / 2))


def train(sample: list[tuple[str, np.ndarray, np.ndarray]], idf: np.ndarray, epochs: int = EPOCHS, seed: int = 12) -> Model:
    """From (language, buckets, counts) of sampled documents."""
    languages = sorted({lang for lang, _, _ in sample})
    k = len(languages)
    model = Model(languages, idf, np.zeros((BUCKETS, k), np.float32), np.zeros(k))
    rows, seen = [], dict.fromkeys(languages, 0)
    for lang, buckets, counts in sample:
        seen[lang] += 1
        rows.append((buckets, model.vector(buckets, counts), languages.index(lang), seen[lang] % CALIBRATION == 0))
    own = [r for r in rows if not r[3]]
    table_, bias = Ftrl((BUCKETS, k)), Ftrl((k,), 0.0)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(own)):
            buckets, v, y, _ = own[i]
            w, b = table_.weights(buckets), bias.weights()
            err = softmax(v @ w + b)
            err[y] -= 1
            table_.step(buckets, w, v[:, None] * err)
            bias.step(slice(None), b, err)
    model.weights, model.bias = table_.weights().astype(np.float32), bias.weights()
    apart = [r for r in rows if r[3]]
    logits = np.array([v @ model.weights[buckets] + model.bias for buckets, v, _, _ in apart]).reshape(len(apart), k)
    model.temperature = temperature_of(logits, np.array([r[2] for r in apart], int))
    return model


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """In how many of ``docs`` (text) each bucket is: counted by task, added up by Spark; the driver gets a number for each bucket."""

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in batch.column(0):
                total[features(text.as_py())[0]] += 1
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in map_batches(docs.select("text"), run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def labelled_features(docs: DataFrame, rows: int = SAMPLE_ROWS) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(language, buckets, counts) of at most ``rows`` distinct texts of ``docs (lang, text)``, as many of each language as there are, in the order of the texts' hashes.

    What goes to the driver is bounded by rows times buckets, whatever the length of texts. Texts
    without letters are passed over. Languages are taken to be few: one row for each goes through the driver.
    """
    hashed = docs.select("lang", "text", F.xxhash64("text").alias("h"))
    sizes = [(r.lang, r["count"]) for r in hashed.select("lang", "h").distinct().groupBy("lang").count().collect()]
    if not sizes:
        return []
    each = max(LEAST_PER_LANG, rows // len(sizes))
    # the lowest hashes: a share that holds three times as many as asked for, on average
    most = {lang: min(2**63 - 1, int(-(2**63) + 2**64 * min(1.0, 3 * each / n))) for lang, n in sizes}
    bounds = docs.sparkSession.createDataFrame(list(most.items()), "lang string, most long")

    def run(batches):
        done = set()
        for batch in batches:
            for lang, h, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (lang, h) in done:
                    continue
                done.add((lang, h))
                buckets, counts = features(text)
                if len(buckets):
                    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([h]), pa.array([buckets.tobytes()]), pa.array([counts.tobytes()])], names=["lang", "h", "buckets", "counts"])

    low = hashed.join(F.broadcast(bounds), "lang").where("h <= most").select("lang", "h", "text")
    found = map_batches(low, run, "lang string, h long, buckets binary, counts binary").dropDuplicates(["lang", "h"])
    ranked = found.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("k") <= each)
    got = sorted(ranked.collect(), key=lambda r: (r.lang, r.h))
    return [(r.lang, np.frombuffer(r.buckets, np.int32), np.frombuffer(r.counts, np.int64)) for r in got]


def fit(docs: DataFrame, held_out=None, rows: int = SAMPLE_ROWS) -> Model:
    """Learns from ``docs (doc_id, text, lang)`` but for the rows ``held_out`` (default: crc32 of the id modulo 4 is 2) and those whose text or language is null."""
    held_out = crc_of_id() % 4 == 2 if held_out is None else held_out
    own = docs.where(~held_out & F.col("text").isNotNull() & F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), text_of().alias("text"))
    n = own.count()
    idf = np.log((1 + n) / (1 + document_frequencies(own))) + 1
    return train(labelled_features(own, rows), idf)


FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]


def predict_languages(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with lang_pred and score, the calibrated probability of that language.

    A null text, one without letters, and any text for a model that has seen
    no language, gives ``und`` and 0. Ties go to the first language in order.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats for each language, whatever the input

    def make(texts):
        own = shared.value
        return (own.predict(t) for t in texts)

    return add_columns(docs, FIELDS, make, keep=keep)


def op12_ftrl_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = predict_languages(docs.select("doc_id", "text"), fit(docs), keep=["doc_id"])
    return out.select("doc_id", (crc_of_id() % 4 == 2).alias("held_out"), "lang_pred", "score")
