"""Quality: a linear-chain conditional random field over the lines of a text.

Each line is good or bad; its features are its own and its neighbours'. The
field is trained in numpy by gradient ascent. Only documents have labels: those
of lines are latent, bound by their document's, and documents spliced together
show the changes. A document's quality is the mean of its lines' marginal
probabilities of being good, weighted by their lengths.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, crc_of_id, table
from .training import labelled_sample

#: Labelled rows of each class that training reads at most.
SAMPLE_PER_CLASS = 1500
#: Longer lines count as several, so one line can't stand for a whole book.
LINE = 2000
BASE = 14
#: Lines of so much of a document's length have its label, in training.
SHARE = 0.7
FEATURES = 3 * BASE + 1


def lines_of(text: str) -> list[str]:
    """Lines that aren't blank, long ones in steps; one empty line for a blank text."""
    out = []
    for line in text.split("\n"):
        if line.strip():
            out += [line] if len(line) <= LINE else [line[a : a + LINE] for a in range(0, len(line), LINE)]
    return out or [""]


#: Classes of ASCII bytes: 1 upper, 2 lower, 3 digit, 4 plain punctuation, 5 space, 6 other symbols, 7 beyond ASCII
_CLASS = np.full(256, 7, np.uint8)
for _b in range(128):
    _c = chr(_b)
    _CLASS[_b] = 1 if _c.isupper() else 2 if _c.islower() else 3 if _c.isdigit() else 4 if _c in ".,;:'\"-()?" else 5 if _c.isspace() else 6


def line_features(lines: list[str]) -> np.ndarray:
    """(lines, BASE) numbers between about 0 and 1."""
    raw = [x.encode("utf-8", "surrogatepass") for x in lines]
    data = _CLASS[np.frombuffer(b"".join(raw), np.uint8)]
    size = np.array([len(r) for r in raw])
    ends = np.cumsum(size)
    n = np.maximum(size, 1)
    share = np.empty((len(lines), 8))
    for k in (1, 2, 3, 4, 6, 7):
        total = np.concatenate(([0], np.cumsum(data == k)))
        share[:, k] = (total[ends] - total[ends - size]) / n
    again = Counter(lines)
    words = [x.split() for x in lines]
    count = np.array([len(w) for w in words])
    distinct = np.array([len(set(w)) for w in words])
    bytes_in = np.array([sum(map(len, w)) for w in words])
    many = np.maximum(count, 1)
    f = np.empty((len(lines), BASE))
    f[:, 0], f[:, 1], f[:, 2], f[:, 3], f[:, 4] = share[:, 1], share[:, 3], share[:, 4], 3 * share[:, 6], share[:, 7]
    f[:, 5] = 1 - distinct / many  # repeated words
    f[:, 6] = (count > 8) * (1 - distinct / many)
    f[:, 7] = np.minimum(1, np.log1p(count) / 6)
    f[:, 8] = np.minimum(2, bytes_in / many / 10)
    f[:, 9] = np.array([again[x] > 1 for x in lines])
    f[:, 10] = np.array([min(1.0, len(again) / len(lines))] * len(lines))
    f[:, 11] = (share[:, 6] > 0.02) * 1.0
    f[:, 12] = (share[:, 1] > 0.3) * 1.0
    f[:, 13] = np.minimum(1, share[:, 3] * 8)
    return f


def features_of(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(lines, FEATURES): a line's own, the previous and the next line's numbers and 1; and the lines' lengths."""
    f = line_features(lines)
    before = np.vstack((np.zeros((1, BASE)), f[:-1]))
    after = np.vstack((f[1:], np.zeros((1, BASE))))
    return np.hstack((f, before, after, np.ones((len(f), 1)))), np.array([max(1, len(x)) for x in lines], float)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    return features_of(lines_of(text))


@dataclass
class Field:
    """``emit``: weights of good against bad; ``move[a, b]``: weight of a line b after a line a (0 bad, 1 good)."""

    emit: np.ndarray
    move: np.ndarray

    def marginals(self, x: np.ndarray) -> np.ndarray:
        """Probability of good for each line of a batch (documents, lines, FEATURES) whose padding comes last; see ``forward_backward``."""
        return forward_backward(x @ self.emit, self.move, np.full(len(x), x.shape[1]))[0]


def forward_backward(score: np.ndarray, move: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(P(good) of each line, expected counts of moves for each document), in the log domain.

    ``score`` (documents, lines) is the weight of good; lines from ``length`` on are padding.
    """
    n, steps = score.shape
    e = np.stack((np.zeros_like(score), score), 2)
    alpha, beta = np.empty((steps, n, 2)), np.zeros((steps, n, 2))
    alpha[0] = e[:, 0]
    for t in range(1, steps):
        a = alpha[t - 1]
        alpha[t] = np.logaddexp(a[:, :1] + move[0], a[:, 1:] + move[1]) + e[:, t]
    for t in range(steps - 2, -1, -1):
        inner = beta[t + 1] + e[:, t + 1]
        step = np.logaddexp(move[:, 0] + inner[:, :1], move[:, 1] + inner[:, 1:])
        beta[t] = np.where((t + 1 < length)[:, None], step, 0.0)
    both = alpha + beta
    z = np.logaddexp(both[..., 0], both[..., 1])
    good = np.exp(both[..., 1] - z).T
    counts = np.zeros((n, 2, 2))
    for t in range(1, steps):
        live = t < length
        if not live.any():
            break
        inner = beta[t] + e[:, t]
        joint = alpha[t - 1][:, :, None] + move[None] + inner[:, None, :] - z[t - 1][:, None, None]
        counts += np.where(live[:, None, None], np.exp(np.minimum(joint, 0)), 0)
    return good, counts


def packs_of(chains: list[tuple[np.ndarray, np.ndarray, float]], slots: int = 20_000) -> list[tuple]:
    """(features, line labels, lengths, weights) of chains of like lengths together: at most 128 of them and ``slots`` lines with padding, or one chain."""
    order = sorted(range(len(chains)), key=lambda i: len(chains[i][0]))
    out, at = [], 0
    while at < len(order):
        end = at + 1
        while end < len(order) and end - at < 128 and (end - at + 1) * len(chains[order[end]][0]) <= slots:
            end += 1
        own = [chains[i] for i in order[at:end]]
        length = np.array([len(c[0]) for c in own])
        x, y = np.zeros((len(own), length.max(), FEATURES)), np.zeros((len(own), length.max()), np.int64)
        for k, (f, labels, _) in enumerate(own):
            x[k, : len(f)], y[k, : len(f)] = f, labels
        out.append((x, y, length, np.array([c[2] for c in own])))
        at = end
    return out


def ascend(field: Field, chains: list[tuple[np.ndarray, np.ndarray, float]], epochs: int, rng: np.random.Generator) -> Field:
    """Adam on the mean log-likelihood of the chains' line labels, from ``field`` on; a chain weighs the same whatever its number of lines."""
    packs = packs_of(chains)
    theta = np.concatenate((field.emit, field.move.ravel()))
    m, v, step = np.zeros_like(theta), np.zeros_like(theta), 0
    for _ in range(epochs):
        for k in rng.permutation(len(packs)):
            x, y, length, w = packs[k]
            move = theta[FEATURES:].reshape(2, 2)
            good, counts = forward_backward(x @ theta[:FEATURES], move, length)
            live = np.arange(x.shape[1])[None] < length[:, None]
            scale = w / length
            grad_e = np.einsum("nt,ntf->f", (y - good) * live * scale[:, None], x)
            moves = np.stack([((y[:, :-1] == a) & (y[:, 1:] == b) & live[:, 1:]).sum(1) for a in (0, 1) for b in (0, 1)], 1).reshape(-1, 2, 2)
            grad_m = ((moves - counts) * scale[:, None, None]).sum(0)
            grad = np.concatenate((grad_e, grad_m.ravel())) / len(x) - 1e-4 * theta
            step += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            theta = theta + 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Field(theta[:FEATURES], theta[FEATURES:].reshape(2, 2))


def line_labels(field: Field, x: np.ndarray, size: np.ndarray, y: int) -> np.ndarray:
    """The likelier label of each line, given that lines of at least ``SHARE`` of a document's length have its label ``y``.

    The document's weight that its lines share is raised, by bisection, until
    the expected share of length holds; it is not touched where it holds already.
    """
    score, length = (x @ field.emit)[None], np.array([len(x)])

    def good(bias: float) -> np.ndarray:
        return forward_backward(score + bias, field.move, length)[0][0]

    sign = 1.0 if y else -1.0
    lo, hi = 0.0, 0.0
    share = lambda g: float(((g if y else 1 - g) * size).sum() / size.sum())
    own = good(0.0)
    if share(own) < SHARE:
        hi = 1.0
        while share(good(sign * hi)) < SHARE and hi < 64:
            hi *= 2
        for _ in range(8):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if share(good(sign * mid)) >= SHARE else (mid, hi)
        own = good(sign * hi)
    return (own > 0.5).astype(np.int64)


def train(sample: list[tuple[str, int]], epochs: int = 12, seed: int = 3) -> Field:
    """Trains on documents and on documents spliced from two, both classes of documents weighing the same.

    Line labels are latent: at first lines have their document's label, then the
    likelier ones under the field so far, bound to the document's label by
    ``line_labels``. In a spliced chain, the first lines of one document and the
    last of another, labels change where the documents do, so changes are learnt.
    """
    field = Field(np.zeros(FEATURES), np.zeros((2, 2)))
    if not sample:
        return field
    rng = np.random.default_rng(seed)
    lines = [lines_of(t) for t, _ in sample]
    y = [label for _, label in sample]
    each = [0.5 * len(y) / max(1, y.count(k)) for k in (0, 1)]
    whole = [features_of(own) for own in lines]
    labels = [np.full(len(own), k) for own, k in zip(lines, y)]
    pairs = rng.integers(0, len(sample), (len(sample), 2))
    cuts = [(int(rng.integers(1, len(lines[a]) + 1)), int(rng.integers(0, len(lines[b])))) for a, b in pairs]
    spliced = [features_of(lines[a][:i] + lines[b][j:])[0] for (a, b), (i, j) in zip(pairs, cuts)]
    for turn in range(2):
        chains = [(x, own, each[k]) for (x, _), own, k in zip(whole, labels, y)]
        chains += [(x, np.concatenate((labels[a][:i], labels[b][j:])), 1.0) for x, (a, b), (i, j) in zip(spliced, pairs, cuts)]
        field = ascend(field, chains, epochs, rng)
        if not turn:
            labels = [line_labels(field, x, size, k) for (x, size), k in zip(whole, y)]
    return field


def score_texts(field: Field, texts: Iterable[str]) -> Iterator[float]:
    """Length-weighted mean of the lines' probabilities of good; texts of like line counts share a pass."""
    texts = list(texts)
    found = []
    for t in texts:
        x, size = features(t)
        found.append((x @ field.emit, size))
    order = sorted(range(len(texts)), key=lambda i: len(found[i][0]))
    out = np.empty(len(texts))
    at = 0
    while at < len(order):
        # batches of at most 64 documents and twice the shortest's lines
        shortest = len(found[order[at]][0])
        end = at + 1
        while end < len(order) and end - at < 64 and len(found[order[end]][0]) <= 2 * shortest + 8:
            end += 1
        own = order[at:end]
        length = np.array([len(found[i][0]) for i in own])
        score = np.zeros((len(own), length.max()))
        for k, i in enumerate(own):
            score[k, : length[k]] = found[i][0]
        good, _ = forward_backward(score, field.move, length)
        for k, i in enumerate(own):
            size = found[i][1]
            out[i] = float((good[k, : length[k]] * size).sum() / size.sum())
        at = end
    return iter(np.clip(out, 0, 1).tolist())


FIELDS = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]


def score_documents(docs: DataFrame, field: Field, threshold: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with score and predicted; null and blank texts count as one empty line."""

    def make(texts):
        for s in score_texts(field, texts):
            yield s, int(s >= threshold)

    return add_columns(docs, FIELDS, make, keep=keep)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Field:
    return train(labelled_sample(docs, labels, "quality", per_class))


def op9_line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    field = fit(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, field, keep=["doc_id"]).select("doc_id", (crc_of_id() % 3 == 1).alias("held_out"), "score", "predicted")
