"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A text is cut into windows of ``WINDOW`` words. A window is the mean of the
embeddings of its character n-grams (lengths 3 to 5, with word ends), hashed
into ``BUCKETS`` rows, followed by a linear softmax over two classes; the two
are trained together in numpy. A misspelt word shares most n-grams with the
word and so its vectors. A document's score is its most toxic window's.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, crc_of_id, table
from .training import labelled_sample

WINDOW, BUCKETS, DIM = 24, 1 << 17, 8
#: Documents at which an n-gram's log odds count half at the start of training.
START_SHRINK = 10.0
#: Labelled rows of each class that training reads at most.
SAMPLE_PER_CLASS = 900


def _grams(text: str) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For lengths 3, 4, 5: (bucket, whether it is an n-gram) at each position; and the positions where words' n-grams begin.

    Words are runs of letters and digits. An n-gram's inner characters lie in
    one word; its first and last may be the word's ends, which are all alike.
    """
    x = np.frombuffer((" " + text.lower() + " " * 5).encode("utf-32-le", "surrogatepass"), np.uint32)
    word = (x - 97 < 26) | (x - 48 < 10) | (x >= 0xC0) & ~((x >= 0x2000) & (x <= 0x206F)) & (x != 0x3000)
    x = np.where(word, x, np.uint32(32))
    begin = np.flatnonzero(word[1:] & ~word[:-1])
    m = len(x) - 4
    h = x[:-1] * np.uint32(0x01000193) ^ x[1:]
    ok = word[1 : m + 1]
    out = []
    for n in (3, 4, 5):
        h = h[:-1] * np.uint32(0x01000193) ^ x[n - 1 :]
        if n > 3:
            ok = ok & word[n - 2 : n - 2 + m]
        out.append((((h[:m] ^ (h[:m] >> np.uint32(13))) * np.uint32(0x9E3779B1)) >> np.uint32(15), ok))
    return out, begin


def windows_of(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """(buckets, window number of each, number of windows); one empty window for a text without words."""
    grams, begin = _grams(text)
    at = [np.flatnonzero(ok) for _, ok in grams]
    buckets = np.concatenate([b[p] for (b, _), p in zip(grams, at)]).astype(np.int32)
    first = begin[::WINDOW]
    window = np.maximum(np.searchsorted(first, np.concatenate(at), side="right") - 1, 0)
    return buckets, window, max(1, len(first))


@dataclass
class Model:
    """Score of each bucket: its embedding times the difference of the two softmax rows; ``bias`` likewise."""

    weights: np.ndarray
    bias: float

    def score(self, text: str) -> float:
        grams, begin = _grams(text)
        if not len(begin):
            return float(1 / (1 + np.exp(-np.clip(self.bias, -30, 30))))
        own, count = np.zeros(len(grams[0][1]), np.float32), np.zeros(len(grams[0][1]), np.int8)
        for bucket, ok in grams:
            own += self.weights[bucket] * ok
            count += ok
        first = begin[::WINDOW]
        sums, count = np.add.reduceat(own, first, dtype=np.float64), np.add.reduceat(count, first, dtype=np.int64)
        logit = float((sums / np.maximum(count, 1)).max()) + self.bias
        return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))


def train(sample: list[tuple[str, int]], epochs: int = 14, seed: int = 5) -> Model:
    """AdaGrad on embeddings and softmax together, on the windows that the model finds most toxic in each document."""
    if not sample:
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    rng = np.random.default_rng(seed)
    # n-grams document by document, each document's in the order of its windows
    grams, sizes, first, label = [], [], [0], []
    ones, both = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for text, y in sample:
        b, w, n = windows_of(text)
        grams.append(b[np.argsort(w, kind="stable")])
        sizes.append(np.bincount(w, minlength=n))
        first.append(first[-1] + n)
        label.append(y)
        held = np.unique(b)
        both[held] += 1
        ones[held] += y
    g = np.concatenate(grams)
    del grams
    begin = np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
    n = first[-1]
    y_doc = np.array(label)
    doc_of = np.repeat(np.arange(len(label)), np.diff(first))
    size = np.maximum(np.diff(begin), 1)
    soft = np.zeros((2, DIM), np.float32)
    soft[1] = rng.normal(0, 0.5, DIM)
    bias = np.zeros(2, np.float32)
    # start: the n-grams' log odds between toxic and clean documents, shrunk where few hold them,
    # so the first windows chosen make sense; an n-gram that training never meets weighs nothing
    rate = [(c + 0.5) / (n_ + 1.0) for c, n_ in ((ones, (y_doc == 1).sum()), (both - ones, (y_doc == 0).sum()))]
    odds = np.log(rate[0] / rate[1]) * (both / (both + START_SHRINK)) if 0 < y_doc.sum() < len(y_doc) else np.zeros(BUCKETS)
    apart = soft[1] - soft[0]
    emb = (4 * odds[:, None] * apart / (apart @ apart)).astype(np.float32)
    seen_e, seen_s, seen_b = np.full(BUCKETS, 1e-6, np.float32), np.full((2, DIM), 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    share = np.array([0.5 / max(1, (y_doc == 0).sum()), 0.5 / max(1, (y_doc == 1).sum())]) * len(y_doc)
    for _ in range(epochs):
        flat = emb @ (soft[1] - soft[0])
        logit = np.empty(n)
        for at in range(0, n, 8192):
            lo, hi = begin[at], begin[min(n, at + 8192)]
            upto = np.concatenate(([0.0], np.cumsum(flat[g[lo:hi]], dtype=np.float64)))
            ends = begin[at : at + 8193] - lo
            logit[at : at + 8192] = (upto[ends[1:]] - upto[ends[:-1]]) / size[at : at + 8192]
        # the most toxic window of every document, and three more of clean documents
        by = np.lexsort((-logit, doc_of))
        place = np.arange(n) - np.array(first[:-1])[doc_of[by]]
        chosen = by[(place == 0) | (place < 4) & (y_doc[doc_of[by]] == 0)]
        chosen = rng.permutation(chosen)
        for at in range(0, len(chosen), 256):
            own = chosen[at : at + 256]
            lens = begin[own + 1] - begin[own]
            if not lens.sum():
                continue
            row = np.repeat(np.arange(len(own)), lens)
            pos = np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens) + np.repeat(begin[own], lens)
            b = g[pos]
            mean = np.stack([np.bincount(row, weights=emb[b, d], minlength=len(own)) for d in range(DIM)], 1) / np.maximum(lens, 1)[:, None]
            z = mean @ soft.T + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            y = y_doc[doc_of[own]]
            err = p
            err[np.arange(len(own)), y] -= 1
            err *= (share[y] / len(own))[:, None]
            g_soft, g_bias = err.T @ mean, err.sum(0)
            g_mean = (err @ soft) / np.maximum(lens, 1)[:, None]
            touched, back = np.unique(b, return_inverse=True)
            g_emb = np.stack([np.bincount(back, weights=g_mean[row, d], minlength=len(touched)) for d in range(DIM)], 1)
            seen_e[touched] += (g_emb**2).mean(1)
            emb[touched] -= (0.5 * g_emb / np.sqrt(seen_e[touched])[:, None]).astype(np.float32)
            seen_s += g_soft**2
            soft -= (0.1 * g_soft / np.sqrt(seen_s)).astype(np.float32)
            seen_b += g_bias**2
            bias -= (0.1 * g_bias / np.sqrt(seen_b)).astype(np.float32)
    return Model((emb @ (soft[1] - soft[0])).astype(np.float32), float(bias[1] - bias[0]))


FIELDS = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.7, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with score and predicted.

    Whole texts are scored; a null, empty or wordless text gets the bias alone.
    Ties at the threshold are predicted toxic.
    """
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(model)  # 2^17 floats, whatever the input

    def make(texts):
        own = shared.value
        for t in texts:
            s = own.score(t)
            yield s, int(s >= threshold)

    return add_columns(docs, FIELDS, make, keep=keep)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model:
    return train(labelled_sample(docs, labels, "toxic", per_class))


def op1_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, model, keep=["doc_id"]).select("doc_id", (crc_of_id() % 3 == 1).alias("held_out"), "score", "predicted")
