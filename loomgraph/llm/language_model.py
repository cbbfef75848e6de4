"""Language-model scores: unigram base and a log-bilinear model.

Every word has a class: the most frequent words one of their own, all others one
by their last two bytes, so a word never seen has one too. The log-bilinear
model gives the next word's class from the classes a, b of the last two words,
with matrices of their own for either position:
score(c | a, b) = q1_a . r1_c + bias1_c + SECOND (q2_b . r2_c + bias2_c - log u_c),
u the classes' shares. The sum over all c, for all pairs (a, b) at once, is one
product of matrices, so scores are normalised exactly. Both positions are
trained in numpy with noise-contrastive estimation on the class pairs of every
training document. Within a class words share by smoothed counts. Token counts
cover all training documents; rare words meet their counts in a shuffled join.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, crc_of_id, map_batches, materialize, table, text_of

#: Words with a class of their own, and classes of the others by their last two bytes.
TOP, SUFFIXES, DIM = 446, 320, 48
#: Weight of the position two words back; both positions tell in part the same.
SECOND = 0.6
#: Pseudo-counts of the class unigram in each context, so rare contexts learn no noise.
PRIOR = 40.0
#: Most frequent tokens that every task holds with their counts.
HEAD = 50_000
#: Distinct words that a task counts before it hands its counts on.
FLUSH = 200_000
END = b"\n"  # no word: words hold no white space


def tokens_of(text: str) -> list[bytes]:
    """Words after lowering A-Z, split at ASCII white space, and one end."""
    out = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    out.append(END)
    return out


def _each(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[str]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            yield from batch.slice(at, 512).column(column).to_pylist()


def token_counts(train: DataFrame) -> DataFrame:
    """(word, c) of all tokens of ``train``, as binary words; pre-aggregated in each task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def send() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])
            seen.clear()
            return out

        for text in _each(batches, 0):
            seen.update(tokens_of(text))
            if len(seen) > FLUSH:
                yield send()
        yield send()

    return map_batches(train.select(text_of().alias("text")), count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def head_of(counts: DataFrame, size: int = HEAD) -> list[tuple[bytes, int]]:
    """The ``size`` most frequent (word, c), by count, then word.

    A histogram of counts (at most 4096 bins and 64 for each doubling above)
    tells how far down they reach. Words of rarer bins are left out first, and
    one task merges what is left before the driver sees ``size`` rows.
    """
    bin_ = F.when(F.col("c") < 4096, F.col("c")).otherwise(4096 + F.floor(64 * F.log2(F.col("c") / 4096)))
    least, reached = 0, 0
    for b, n in sorted(map(tuple, counts.groupBy(bin_.alias("b")).count().collect()), reverse=True):
        least, reached = b, reached + n
        if reached >= size:
            break
    top = materialize(counts.where(bin_ >= least).orderBy(F.desc("c"), "word").limit(size))
    return sorted(((bytes(x.word), x.c) for x in top.collect()), key=lambda x: (-x[1], x[0]))


class Classes(dict):
    """Word to class: 0 the end, then those given, then by the last two bytes."""

    def __init__(self, top: list[bytes]) -> None:
        super().__init__({END: 0, **{w: i + 1 for i, w in enumerate(top)}})
        self.first = len(top) + 1
        self.size = self.first + SUFFIXES

    def __missing__(self, word: bytes) -> int:
        return self.first + zlib.crc32(word[-2:]) % SUFFIXES


def suffix_totals(counts: DataFrame, classes: Classes) -> tuple[np.ndarray, np.ndarray]:
    """For each class (tokens, distinct words) of all counted words."""
    of = (F.crc32(F.substring("word", -2, 2)) % SUFFIXES).alias("k")
    tokens, words = np.zeros(classes.size), np.zeros(classes.size)
    for k, t, d in counts.groupBy(of).agg(F.sum("c"), F.count(F.lit(1))).collect():  # at most SUFFIXES rows
        tokens[classes.first + k], words[classes.first + k] = t, d
    return tokens, words


def class_pairs(train: DataFrame, classes: Classes) -> tuple[np.ndarray, np.ndarray]:
    """Counts of (class, next class) and (class, class after next) over all tokens of ``train``; a document begins after two ends."""
    size = classes.size

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.zeros(2 * size * size, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                cells = []
                for text in batch.slice(at, 256).column(0).to_pylist():
                    x = np.array([0, 0, *map(classes.__getitem__, tokens_of(text))], np.int64)
                    cells += [x[1:-1] * size + x[2:], (size + x[:-2]) * size + x[2:]]
                cell, times = np.unique(np.concatenate(cells), return_counts=True)
                whole[cell] += times
        cell = np.flatnonzero(whole)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(whole[cell])], names=["cell", "n"])

    out = np.zeros(2 * size * size)
    # at most 2 * size * size rows
    found = map_batches(train.select(text_of().alias("text")), count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return tuple(out.reshape(2, size, size))


def train_bilinear(bigrams: np.ndarray, dim: int = DIM, noise: int = 10, rounds: int = 250, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(q, r, bias) by noise-contrastive estimation with ``noise`` noise words a word.

    The expectation over data and noise is taken over all class pairs instead
    of draws, so the result is the same each time. Noise is the class unigram.
    """
    size = len(bigrams)
    rng = np.random.default_rng(seed)
    total = max(1.0, bigrams.sum())
    unigram = (bigrams.sum(0) + 1) / (total + size)
    joint = (bigrams + PRIOR * unigram[None]) / (total + PRIOR * size)
    context = joint.sum(1)
    log_noise = np.log(noise * unigram)
    q, r, bias = rng.normal(0, 0.1, (size, dim)), rng.normal(0, 0.1, (size, dim)), np.log(unigram)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (q, r, bias)]
    fake = context[:, None] * (noise * unigram)[None]
    for step in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(q @ r.T + bias - log_noise, -30, 30)))
        # rows of rare contexts would hardly move: each context weighs by the root of its share
        gap = (joint * (1 - p) - fake * p) / np.sqrt(context + 1e-12)[:, None]
        grads = (gap @ r, gap.T @ q, gap.sum(0))
        for k, g in enumerate(grads):
            m, v = state[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-10) * (1 - 0.9 * step / rounds)
            if k == 0:
                q += move
            elif k == 1:
                r += move
            else:
                bias += move
    return q, r, bias


def log10_table(q: np.ndarray, r: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Normalised log10 P(next class | class), one batched product for all contexts."""
    z = q @ r.T + bias
    z -= z.max(1, keepdims=True)
    return ((z - np.log(np.exp(z).sum(1, keepdims=True))) / np.log(10)).astype(np.float32)


@dataclass
class Bilinear:
    """log10 P(c | a, b) = ``near[a, c] + far[b, c] - norm[a, b]``."""

    near: np.ndarray
    far: np.ndarray
    norm: np.ndarray

    def log10(self, ids: np.ndarray) -> np.ndarray:
        """Of each of a document's classes."""
        a, b = np.concatenate(([0], ids[:-1])), np.concatenate(([0, 0], ids[:-2]))[: len(ids)]
        return self.near[a, ids].astype(np.float64) + self.far[b, ids] - self.norm[a, b]


def fit_bilinear(first: np.ndarray, second: np.ndarray) -> Bilinear:
    """From the counts of ``class_pairs``."""
    share = (first.sum(0) + 1) / (first.sum() + len(first))
    near = log10_table(*train_bilinear(first)).astype(np.float64)
    far = SECOND * (log10_table(*train_bilinear(second)).astype(np.float64) - np.log10(share))
    norm = np.log10((10.0**near) @ (10.0**far).T)
    return Bilinear(near.astype(np.float32), far.astype(np.float32), norm.astype(np.float32))


def score_documents(docs: DataFrame, train_where=None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row.

    ``train_where``: condition on doc_id of training rows (default: crc32 of
    the id modulo 7 isn't 2). A null or empty text is one end token. Without
    training rows every token is unknown and both scores are those of an empty
    count table. Repeated rows give repeated results.
    """
    spark = docs.sparkSession
    held = ~train_where if train_where is not None else crc_of_id() % 7 == 2
    train = docs.where(~held).select("text")
    counts = materialize(token_counts(train))
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    head = head_of(counts)
    classes = Classes([w for w, _ in head if w != END][:TOP])
    model = fit_bilinear(*class_pairs(train, classes))
    tokens, words = suffix_totals(counts, classes)
    known = dict(head)
    for w in [END, *classes]:
        if known.get(w, 0):
            k = classes.first + zlib.crc32(w[-2:]) % SUFFIXES
            tokens[k] -= known[w]
            words[k] -= 1
            known[w] = 0
    base_norm = float(np.log10(total + distinct + 1))
    # of words in classes of their own nothing is left to share
    norms = np.where(np.arange(classes.size) < classes.first, 0.0, np.log10(tokens + words + 1))
    # bounded by HEAD words and 3 * (TOP + SUFFIXES)^2 numbers
    shared = spark.sparkContext.broadcast(({w: i for i, (w, _) in enumerate(head)}, np.array([c for _, c in head], np.float64), np.array([classes[w] for w, _ in head], np.int64), model, norms, classes))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, count, klass, own, norm, of = shared.value
        count, klass = np.append(count, 0.0), np.append(klass, 0)
        log_count, rest = np.log10(count + 1), len(count) - 1
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                cols = [[] for _ in range(6)]
                for text in part.column(1).to_pylist():
                    words = tokens_of(text)
                    get = place.get
                    ids = np.fromiter((get(w, rest) for w in words), np.int64, len(words))
                    k = klass[ids]
                    unseen = np.flatnonzero(ids == rest)
                    k[unseen] = [of[words[i]] for i in unseen.tolist()]
                    logs = log_count[ids]
                    shares = (k >= of.first) * logs - norm[k]
                    model_ = float((own.log10(k) + shares).sum())
                    rare = Counter(words[i] for i in unseen.tolist())
                    for c, v in zip(cols, (len(words), int((count[ids] > 0).sum()), float(logs.sum()) - len(words) * base_norm, model_, list(rare), list(rare.values()))):
                        c.append(v)
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, t) for c, t in zip(cols, kinds)]], names=["doc_id", "n_tokens", "n_known", "base", "model", "rare", "times"])

    first = map_batches(docs.select("doc_id", text_of().alias("text")), score, f"doc_id {kind}, n_tokens long, n_known long, base double, model double, rare array<binary>, times array<int>")
    row = F.monotonically_increasing_id()
    scored = materialize(first.withColumn("row", row))
    words = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    # words outside the head are no more frequent than its last; no key is hot
    met = words.join(counts, "word").groupBy("row").agg(F.sum("times").alias("known"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("extra"))
    slim = scored.drop("rare", "times")
    out = slim.join(met, "row", "left")
    extra = F.coalesce("extra", F.lit(0.0))
    return out.select("doc_id", held.alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("base") + extra).alias("base_score"), (F.col("model") + extra).alias("score"))


def op8_bilinear_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
