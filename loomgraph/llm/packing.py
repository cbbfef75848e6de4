"""Packing by power-of-two decomposition.

A tokenised document is cut into pieces whose lengths are powers of two: as
many of the full length as fit, then the binary digits of the rest. Each piece
is a sequence of its own, grouped with others of its length, so there is no
padding and no sequence crosses documents.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gathered, map_batches, table, text_of

#: Entries of a generation of the cache; two are kept, so pieces in use never go.
CACHE = 150_000
#: Marks of pieces met once; a piece is kept when it is met again.
DOOR = 1 << 21
#: Longer words go through the tokenizer without being kept.
LONG_WORD = 32
#: Bytes of text that are gathered to be cut into words at once.
SLICE = 4 << 20

_PIECES = r"('s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+)"
_MIXED = r"[^\p{L}]"
#: Words that normalisation leaves alone but for case, one character for one.
_PLAIN = r"^[\x{21}-\x{7e}\x{a1}-\x{12f}\x{131}-\x{17f}]+$"
#: Arrow splits there, the tokenizer doesn't.
_ODD_SPACE = r"[\x1c-\x1f]"


def ragged(flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches ``flat[begins[c] : begins[c] + sizes[c]]`` of all ``codes`` one after another, and where each begins (and the end)."""
    lens = sizes[codes]
    upto = np.concatenate(([0], np.cumsum(lens)))
    first = begins[codes] - upto[:-1]
    # a run of texts has far fewer than 2^31 ids; narrow numbers halve the memory
    narrow = np.int32 if max(len(flat), int(upto[-1])) < 2**31 - 1 else np.int64
    place = np.repeat(first.astype(narrow), lens)
    del first, lens
    place += np.arange(len(place), dtype=narrow)
    return flat[place], upto


def table_of(found: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, begins, sizes) of strings of 32-bit ids."""
    sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
    return np.frombuffer(b"".join(found), np.uint32), np.cumsum(sizes) - sizes, sizes


class WordCache:
    """Ids of texts, word by word: the tokenizer never joins what white space divides, nor a word's pieces.

    The ids of pieces live in two generations: new ones go to the young, and
    when that is full it becomes the old one; a piece found in the old one moves
    up. A piece met for the first time only leaves a mark, so the many that never
    come again take no room. So the cache is bounded and keeps what the texts
    use, whatever their number.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.door, self.marks = bytearray(DOOR), 0
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.byte_chars = dict(zip(plain + rest, map(chr, plain + [256 + i for i in range(len(rest))])))

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def piece(self, piece: str) -> bytes:
        tokens = self.tokenizer.model.tokenize(piece.encode().decode("latin-1").translate(self.byte_chars))
        return array("I", [t.id for t in tokens]).tobytes()

    def get(self, words: list[str], make: Callable[[str], bytes]) -> list[bytes]:
        """The ids of distinct ``words``."""
        found = list(map(self.young.get, words))
        for i in [i for i, ids in enumerate(found) if ids is None]:
            word = words[i]
            ids = self.old.get(word)
            if ids is None:
                found[i] = ids = make(word) if word else b""
                at = hash(word) % DOOR
                if not self.door[at]:
                    self.door[at] = 1
                    self.marks += 1
                    continue
            else:
                found[i] = ids
            if len(word) <= LONG_WORD:
                if len(self.young) >= CACHE:
                    self.old, self.young = self.young, {}
                self.young[word] = ids
        if self.marks > DOOR // 2:
            self.door, self.marks = bytearray(DOOR), 0
        return found

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begins, sizes) of distinct words."""
        plain = pc.and_(pc.match_substring_regex(words, _PLAIN), pc.invert(pc.match_substring(words, "<|"))).to_numpy(zero_copy_only=False)
        low = pc.utf8_lower(words.filter(pa.array(plain)))
        # most words are letters alone, one piece
        mixed = pc.match_substring_regex(low, _MIXED)
        pieces = pc.split_pattern(pc.replace_with_mask(low, mixed, pc.replace_substring_regex(low.filter(mixed), _PIECES, r"\1 ")), " ")
        coded = pieces.values.dictionary_encode()
        found = self.get(coded.dictionary.to_pylist(), self.piece)
        flat, upto = ragged(*table_of(found), coded.indices.to_numpy(zero_copy_only=False))
        ends = upto[np.asarray(pieces.offsets)]
        # a piece and an odd word are never the same string
        odd = self.get(words.filter(pa.array(~plain)).to_pylist(), self.whole)
        more, begin, size = table_of(odd)
        begins, sizes = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        begins[plain], sizes[plain] = ends[:-1], np.diff(ends)
        begins[~plain], sizes[~plain] = begin + len(flat), size
        return np.concatenate((flat, more)), begins, sizes

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each text); only distinct pieces of words are seen one by one."""
        odd = pc.match_substring_regex(texts, _ODD_SPACE)
        some = pc.any(odd).as_py()
        words = pc.utf8_split_whitespace(pc.if_else(odd, "", texts) if some else texts)
        coded, ends = words.values.dictionary_encode(), np.array(words.offsets)
        del words
        ids, upto = ragged(*self.words(coded.dictionary), coded.indices.to_numpy(zero_copy_only=False))
        ends = upto[ends]
        if not some:
            return ids, np.diff(ends)
        parts = [self.whole(t.as_py()) if o.as_py() else ids[a:b].tobytes() for t, o, a, b in zip(texts, odd, ends[:-1].tolist(), ends[1:].tolist())]
        flat, _, sizes = table_of(parts)
        return flat, sizes

    def encode(self, text: str) -> bytes:
        return self.encode_all(pa.array([text]))[0].astype("<u4").tobytes()


_caches: dict[str, WordCache] = {}


def cache_of(path: str) -> WordCache:
    """One for each worker process, kept between tasks."""
    if path not in _caches:
        _caches[path] = WordCache(path)
    return _caches[path]


def decompose(counts: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, length) of each piece: of every count the powers of two, largest first, that add up to it."""
    full, rest = counts // longest, counts % longest
    bits = 1 << np.arange(longest.bit_length() - 2, -1, -1, dtype=np.int64)
    digits = rest[:, None] & bits
    number = full + (digits > 0).sum(1)
    doc = np.repeat(np.arange(len(counts)), number)
    rank = np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)
    length = np.full(len(doc), longest, np.int64)
    length[rank >= full[doc]] = digits[digits > 0]
    return doc, length


def slices(texts: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """(start, number) of runs of texts of at most twice ``size`` bytes together; a longer text is a run by itself."""
    upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(upto):
        before = upto[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(upto, before + 2 * size, side="right")))
        yield at, end - at
        at = end


def pack(docs: DataFrame, tokenizer: str, longest: int = 2048, end_id: int = 1, at_once: int = SLICE) -> DataFrame:
    """(doc_id, start, length, tokens, doc_tokens, sequence_id, offset, bucket) of each piece.

    ``tokens`` are the ids as little-endian unsigned 32-bit integers. A null or
    empty text is the single end id. Rows that repeat a doc_id are packed each
    for itself. ``longest`` must be a power of two. A sequence is one piece, so
    ``offset`` is 0; ``sequence_id`` is unique and its upper byte is the bucket,
    the binary logarithm of the length. ``at_once``: bytes of text that a task
    cuts into words together; fewer take less memory and more time.
    """
    if longest < 2 or longest & (longest - 1):
        raise ValueError("longest must be a power of two above 1")
    source = docs.select("doc_id", text_of().alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def cut_up(words: WordCache, part: pa.RecordBatch) -> pa.RecordBatch:
        ids, counts = words.encode_all(part.column(1))
        # the end id after each text
        ids = np.insert(ids, np.cumsum(counts), end_id).astype("<u4", copy=False)
        counts = counts + 1
        doc, length = decompose(counts, longest)
        upto = np.concatenate(([0], np.cumsum(length)))
        begin = np.cumsum(counts) - counts
        # the pieces lie one after another in the ids
        tokens = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(4 * upto), pa.py_buffer(ids)]).cast(pa.binary())
        return pa.RecordBatch.from_arrays(
            [part.column(0).take(pa.array(doc)), pa.array(upto[:-1] - begin[doc]), pa.array(length), tokens, pa.array(counts[doc])],
            names=["doc_id", "start", "length", "tokens", "doc_tokens"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = cache_of(tokenizer)
        for batch in gathered(batches, lambda b: b.column(1).nbytes, at_once):
            for at, rows in slices(batch.column(1), at_once):
                # nothing of a run is held while the next one is encoded
                yield cut_up(words, batch.slice(at, rows))
                # Arrow keeps what its functions have freed
                pa.default_memory_pool().release_unused()

    pieces = map_batches(source, run, f"doc_id {kind}, start long, length long, tokens binary, doc_tokens long")
    bucket = F.log2("length").cast("int")
    return pieces.select("*", (F.shiftleft(bucket.cast("long"), 56) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), bucket.alias("bucket"))


def bucketed(pieces: DataFrame) -> DataFrame:
    """``pieces`` with those of a bucket side by side in every partition, so batches of one length are read off in a row.

    A bucket is spread over all partitions by sequence_id, since one length may hold most of the rows.
    """
    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pieces.repartition(parts, F.xxhash64("sequence_id")).sortWithinPartitions("bucket", "sequence_id")


def write_buckets(pieces: DataFrame, path: str) -> None:
    """One folder for each length, ``bucket=0`` .. at ``path``; no shuffle."""
    pieces.write.partitionBy("bucket").parquet(path)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bucketed(digest(pack(table(spark, sf_dir, "documents"), tokenizer_path())))
