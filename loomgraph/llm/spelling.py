"""Spelling variants: words one inserted, deleted or replaced code point apart, found by full neighbourhoods.

Every word emits all its distinct neighbours over the alphabet that the
vocabulary itself uses: its deletions, its replacements and its insertions. A
neighbour that is a word too is met by an equality join, so no distance is
ever computed and no two words are compared. Words of m code points over k
letters have about ``2 * m * k`` neighbours, whatever the vocabulary's size;
those that a bit filter of all words rules out aren't written out as strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, table, text_of

LEAST_LENGTH, LEAST_COUNT, FORM_FACTOR = 6, 5, 5
#: Of the pairs of a document and a word one in so many, by their crc32, loses a letter.
SLIP = 199
#: Estimated bytes of a word and its count in a broadcast table.
WORD_BYTES = 100
#: The filter has at most so many bits (as a power of two), in pieces of so many.
MOST_BITS, PIECE = 28, 19
#: Words whose neighbours a task looks up.
WORDS_A_TASK = 20_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower_ascii(word: Column) -> Column:
    # the built-in is the faster, but lower-cases other letters too
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


def _without(word: str, at: str) -> Column:
    """``word`` without its code point ``at`` (from 0)."""
    return F.expr(f"concat(substring({word}, 1, {at}), substring({word}, {at} + 2, length({word})))")


def words_of(docs: DataFrame, least_length: int = LEAST_LENGTH, slip: int = SLIP) -> DataFrame:
    """``word``: one row for each run of letters of the whole texts, of at least ``least_length`` code points.

    Only A-Z are lower-cased. Where ``slip`` divides the crc32 of
    ``<doc_id>:<word>`` the word loses the code point that the crc32 points
    at; a null id counts as the empty text there. Runs that a loss makes too
    short give no row. A null text has no runs.
    """
    # shorter runs can't become long enough
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text_of(), F.lit(f"[A-Za-zÀ-ÿ]{{{least_length},}}"), 0)).alias("run"))
    words = runs.select("id", _lower_ascii(F.col("run")).alias("word"))
    words = words.select("word", F.crc32(F.concat("id", F.lit(":"), "word").cast("binary")).alias("h"))
    slipped = words.select(F.when(F.col("h") % slip == 0, _without("word", "int(h % length(word))")).otherwise(F.col("word")).alias("word"))
    return slipped.where(F.length("word") >= least_length)


def vocabulary(words: DataFrame, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words that occur at least so often; counts add up before the shuffle, so a frequent word is no hot key."""
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


class Letters:
    """Hashes of words and of all their neighbours, without making the strings.

    A letter has a fixed 64-bit number; a word's hash is the polynomial of its
    letters' numbers in ``_BASE`` modulo 2^64, so a neighbour's follows from
    the hashes of the word's beginning and end.
    """

    _BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

    def __init__(self, letters: list[str], bits: int) -> None:
        self.letters = letters
        self.codes = np.array([ord(c) for c in letters], np.uint32)
        x = self.codes.astype(np.uint64) * self._MIX
        self.numbers = (x ^ (x >> np.uint64(29))) * self._BASE | np.uint64(1)
        self.shift = np.uint64(64 - bits)

    def of(self, words: list[str]) -> np.ndarray:
        """Words of one length as rows of places in the alphabet."""
        x = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        return np.searchsorted(self.codes, x).reshape(len(words), -1)

    def powers(self, n: int) -> np.ndarray:
        return np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(n, self._BASE))))

    def hashes(self, rows: np.ndarray) -> np.ndarray:
        return (self.numbers[rows] * self.powers(rows.shape[1] - 1)[::-1]).sum(1, dtype=np.uint64)

    def bit(self, hashes: np.ndarray) -> np.ndarray:
        """The place in the filter."""
        return ((hashes ^ (hashes >> np.uint64(31))) * self._MIX) >> self.shift

    def neighbours(self, rows: np.ndarray, cells: int = 1 << 19) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray | None, np.ndarray]]:
        """(kind, rows, places, letters, hashes) of all distinct deletions, replacements and insertions of words of one length, in pieces of about ``cells``.

        A deletion comes once for each run of one letter, and an insertion not
        behind its own letter, so each neighbour comes once. ``places`` are those
        of the word before which or at which it is edited.
        """
        n, m = rows.shape
        k = len(self.letters)
        power = self.powers(m + 1)
        own = self.numbers[rows]
        start = np.zeros((n, m + 1), np.uint64)
        for i in range(m):
            start[:, i + 1] = start[:, i] * self._BASE + own[:, i]
        end = np.zeros((n, m + 1), np.uint64)
        end[:, :m] = np.cumsum((own * power[m - 1 :: -1][:m])[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1]
        step = max(1, cells // (n * k))
        for at in range(0, m + 1, step):
            upto = min(at + step, m + 1)
            i = np.arange(at, upto)
            inner = i[i < m]
            before = np.where(i > 0, rows[:, np.maximum(i - 1, 0)], -1)
            # deletions
            r, p = np.nonzero(rows[:, inner] != before[:, : len(inner)])
            p = inner[p]
            yield "delete", r, p, None, start[r, p] * power[m - 1 - p] + end[r, p + 1]
            letters = np.arange(k)
            h = (start[:, inner] * power[m - inner] + end[:, inner + 1])[:, :, None] + self.numbers * power[m - 1 - inner][:, None]
            r, p, c = np.nonzero(rows[:, inner][:, :, None] != letters)
            yield "replace", r, inner[p], c, h[r, p, c]
            h = (start[:, i] * power[m - i + 1] + end[:, i])[:, :, None] + self.numbers * power[m - i][:, None]
            r, p, c = np.nonzero(before[:, :, None] != letters)
            yield "insert", r, i[p], c, h[r, p, c]


def _by_length(words: Iterator[str], most: int = 4096) -> Iterator[list[str]]:
    held: dict[int, list[str]] = {}
    for w in words:
        own = held.setdefault(len(w), [])
        own.append(w)
        if len(own) >= most or len(own) * len(w) > 1 << 16:
            yield held.pop(len(w))
    yield from held.values()


def _words(batches) -> Iterator[str]:
    for batch in batches:
        yield from batch.column(0).to_pylist()


def known_bits(words: DataFrame, letters: Letters, bits: int) -> np.ndarray:
    """A filter of 2^bits bits: those of the hashes of all ``words``. Put together in pieces of 64 KB by Spark, each word sending one number."""

    def places(batches):
        for own in _by_length(_words(batches)):
            at = letters.bit(letters.hashes(letters.of(own))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> PIECE), pa.array(at & ((1 << PIECE) - 1))], names=["piece", "at"])

    def piece(t: pa.Table) -> pa.Table:
        held = np.zeros(1 << PIECE, bool)
        held[t.column("at").to_numpy()] = True
        return pa.table({"piece": t.column("piece")[:1], "held": [np.packbits(held, bitorder="little").tobytes()]})

    out = np.zeros(1 << (bits - 3), np.uint8)
    size = 1 << (PIECE - 3)
    for r in words.select("word").mapInArrow(places, "piece long, at long").distinct().groupBy("piece").applyInArrow(piece, "piece long, held binary").collect():
        out[r.piece * size : (r.piece + 1) * size] = np.frombuffer(r.held, np.uint8)
    return out


def neighbours(words: DataFrame, n_words: int) -> DataFrame:
    """(near, word): the distinct deletions, replacements and insertions of each ``word``, over the code points that words have, but for those that a filter shows to be no word.

    All neighbours' hashes are tried against a filter of at most ``MOST_BITS``
    bits, whatever the vocabulary; a neighbour that is a word always passes, so
    where the filter fills up more strings are made, and nothing is lost. The
    alphabet goes through the driver: Latin words have under a hundred letters,
    and no vocabulary has more than Unicode.
    """
    letters = sorted(r[0] for r in words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct().collect())
    bits = min(MOST_BITS, max(PIECE, (64 * n_words).bit_length()))
    alphabet = Letters(letters, bits)
    shared = words.sparkSession.sparkContext.broadcast(known_bits(words, alphabet, bits) if letters else None)

    def run(batches):
        held = shared.value
        for own in _by_length(_words(batches)):
            near, word = [], []
            for kind, r, p, c, h in alphabet.neighbours(alphabet.of(own)):
                at = alphabet.bit(h)
                hit = np.flatnonzero(held[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1)
                signs = [""] * len(hit) if c is None else [letters[j] for j in c[hit]]
                skip = 0 if kind == "insert" else 1
                for i, j, sign in zip(r[hit].tolist(), p[hit].tolist(), signs):
                    w = own[i]
                    near.append(w[:j] + sign + w[j + skip :])
                    word.append(w)
            yield pa.RecordBatch.from_arrays([pa.array(near, pa.string()), pa.array(word, pa.string())], names=["near", "word"])

    spread = words.select("word").repartition(max(1, n_words // WORDS_A_TASK))
    return spread.mapInArrow(run, "near string, word string")


def near_words(vocab: DataFrame) -> DataFrame:
    """(word, near, near_n) for each word of ``vocab (word, n)``, a written table, and each other word one edit apart; both orders of a pair are there.

    Neighbours meet words by an equality join, whose key is hot for no word,
    since a word has few neighbours; a vocabulary of a counted size of at most
    ``BROADCAST_BYTES`` is broadcast.
    """
    known = broadcast_if_small(vocab.select(F.col("word").alias("near"), F.col("n").alias("near_n")), WORD_BYTES)
    return neighbours(vocab, vocab.count()).join(known, "near").select("word", "near", "near_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms (word, form)``: the last word on the way along forms, by pointer jumping.

    A form has several times its word's count, so ways don't turn in circles
    and have at most the logarithm of the largest count as their length;
    jumping takes the logarithm of that.
    """
    at = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        up = at.select(F.col("word").alias("root"), F.col("root").alias("above"))
        step = materialize(at.join(up, "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")))
        at = step.drop("moved")
        if step.where("moved").isEmpty():
            return at


def spelling_variants(vocab: DataFrame, factor: int = FORM_FACTOR) -> DataFrame:
    """``vocab (word, n)``, unique in ``word``, as (word, form, root, n, n_near, form_n).

    ``form``: of the words one edit apart the most frequent (ties: the smallest
    in code-point order), if it occurs at least ``factor`` (over 1) times as
    often; else null. ``root``: the last word along forms, the word itself
    without a form. An empty vocabulary gives no rows; null and empty words are
    left out.
    """
    vocab = materialize(vocab.where("word <> ''").select("word", "n"))
    best = near_words(vocab).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    stands = (-F.col("best.less")) >= factor * F.col("n")
    found = materialize(
        vocab.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(stands, F.col("best.near")).alias("form"), F.when(stands, -F.col("best.less")).alias("form_n")
        )
    )
    last = roots(found.where("form IS NOT NULL"))
    return found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(vocabulary(words_of(table(spark, sf_dir, "documents").select("doc_id", "text"))))
