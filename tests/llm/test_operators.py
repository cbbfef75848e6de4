import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomgraph.llm import decontamination, language_model, licenses, merkle, packing, quality, sharding, substrings, toxicity
from loomgraph.llm.common import table

LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r.doc_id: r.text for r in table(spark, sf, "documents").select("doc_id", "text").collect()}


def test_shards(spark, sf, docs, odd, empty):
    rows = sharding.op6_byte_shards(spark, sf).orderBy("shard", "slot").collect()
    assert [r.doc_id for r in rows] == sorted(docs)
    sizes = Counter()
    for k, r in enumerate(rows):
        data = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
        assert r.slot == (0 if not k or rows[k - 1].shard != r.shard else rows[k - 1].slot + 1)
        sizes[r.shard] += r.size
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) < 2 * max(r.size for r in rows)
    assert sharding.assign_shards(odd).count() == odd.count()
    whole = sharding.shard_documents(odd, 3)
    assert whole.count() == odd.count() and whole.columns == [*[c for c in odd.columns if c != "shard"], "shard", "slot"]
    assert sharding.assign_shards(empty).count() == 0


def test_packing_round_trip(spark, sf, docs, odd, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    pieces = packing.pack(table(spark, sf, "documents"), packing.tokenizer_path()).orderBy("doc_id", "start").collect()
    got: dict = {}
    for p in pieces:
        ids = got.setdefault(p.doc_id, [])
        assert p.start == len(ids) and p.length & (p.length - 1) == 0 and p.length <= 2048 and p.offset == 0
        ids += np.frombuffer(p.tokens, "<u4").tolist()
    assert len({p.sequence_id for p in pieces}) == len(pieces)
    for d, text in docs.items():
        assert got[d] == [*t.encode(text, add_special_tokens=False).ids, 1]
    strange = ["a\x1cb", "<|endoftext|> x", "İstanbul ΣΑΣ été", "it's 12 345 don't", " x　y", "漢字かな🙂🙂", "a" * 300]
    for s in strange:
        assert np.frombuffer(packing.cache_of(packing.tokenizer_path()).encode(s), "<u4").tolist() == t.encode(s, add_special_tokens=False).ids
    sizes = packing.pack(odd, packing.tokenizer_path()).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert {r.doc_id: r.n for r in sizes}[3] == 1 and len(sizes) == 9
    assert packing.pack(empty, packing.tokenizer_path()).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2047, 2048, 5000])
def test_decompose(n):
    doc, out = packing.decompose(np.array([n, 7]), 2048)
    own = out[doc == 0].tolist()
    assert sum(own) == n and len(own) == n // 2048 + (n % 2048).bit_count() and own == sorted(own, reverse=True)
    assert out[doc == 1].tolist() == [4, 2, 1]


def test_word_cache_forgets_only_what_is_unused(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "CACHE", 50)
    t, words = Tokenizer.from_file(packing.tokenizer_path()), packing.WordCache(packing.tokenizer_path())
    for k in range(40):
        text = " ".join(["always", *(f"w{k}x{i}" for i in range(9)), "Çe", "l'été"])
        assert np.frombuffer(words.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids
        assert len(words.young) <= 50 and len(words.old) <= 50 and (not k or "always" in words.young or "always" in words.old)


def test_every_character_is_tokenised_alike():
    import pyarrow as pa
    from tokenizers import Tokenizer

    t, words = Tokenizer.from_file(packing.tokenizer_path()), packing.cache_of(packing.tokenizer_path())
    texts = [x for c in range(1, 0x3100) for x in (chr(c), f"A{chr(c)}b")]
    ids, sizes = words.encode_all(pa.array(texts))
    ends = np.cumsum(sizes)
    want = t.encode_batch(texts, add_special_tokens=False)
    assert all(ids[e - n : e].tolist() == w.ids for e, n, w in zip(ends, sizes, want))


def test_buckets_lie_together(spark, sf):
    pieces = packing.bucketed(packing.digest(packing.pack(table(spark, sf, "documents"), packing.tokenizer_path())))
    parts = pieces.select(F.spark_partition_id().alias("p"), "bucket").collect()
    for p in {r.p for r in parts}:
        own = [r.bucket for r in parts if r.p == p]
        assert own == sorted(own)


def naive_likeness(a, b):
    """Trees of plain strings, paired off level by level."""

    def tree(text):
        out, section = [], []
        for line in text.split("\n"):
            leaves = tuple(p[k : k + merkle.STEP] for p in merkle._LEAF.findall(line) for k in range(0, len(p), merkle.STEP))
            section.append(leaves)
            if merkle._digest([xxhash.xxh3_128_digest(x.encode()) for x in leaves])[0] % merkle.SECTION == 0:
                out.append(tuple(section))
                section = []
        return [*out, tuple(section)]

    def size(x):
        return len(x) if isinstance(x, str) else sum(map(size, x))

    xs, ys, common = Counter(tree(a)), Counter(tree(b)), 0
    if a == b:
        return 1.0
    for _ in range(3):
        both = xs & ys
        common += sum(size(x) * n for x, n in both.items())
        xs, ys = xs - both, ys - both
        if all(isinstance(x, str) for x in [*xs, *ys]):
            break
        xs, ys = (Counter(c for x in zs.elements() for c in x) for zs in (xs, ys))
    return 2 * common / (len(a) + len(b)) if a or b else 0.0


def test_merkle(spark, sf, docs, odd, empty):
    got = {r.doc_id: r for r in merkle.op10_merkle_fingerprints(spark, sf).collect()}
    ids = sorted(docs, reverse=True)
    prints: dict = {}
    for k, d in enumerate(ids):
        text, after = docs[d], docs[ids[(k + 1) % len(ids)]]
        n = len(text)
        edited = text[: n - n // 3] + after[: n // 3]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert prints.setdefault(r.fingerprint, text) == text
        assert r.edited_fingerprint == merkle.Tree(edited).fingerprint
        assert r.near_edited == pytest.approx(naive_likeness(text, edited)) and r.near_next == pytest.approx(naive_likeness(text, after))
        spans = [tuple(map(int, s.split("-"))) for s in r.edits.split(",") if s]
        assert bool(spans) == (text != edited) and all(0 <= a < b <= len(edited) for a, b in spans)
    assert len(prints) == len(set(docs.values()))
    assert sum(r.near_edited > r.near_next for r in got.values()) > 0.97 * len(got)
    assert len(merkle.fingerprint_documents(odd).collect()) == odd.count()
    assert merkle.fingerprint_documents(empty).count() == 0
    one = merkle.fingerprint_documents(odd.where("doc_id = 5")).first()
    assert one.near_next == 1.0


def test_merkle_locates_edits():
    a = "\n".join(f"Line {i} says this. And that, too." for i in range(50))
    b = a.replace("Line 20 says this.", "Line 20 says more.")
    spans = merkle.locate_edits(merkle.Tree(a), merkle.Tree(b))
    assert len(spans) == 1 and b[spans[0][0] : spans[0][1]].startswith("Line 20 says more.")
    assert merkle.locate_edits(merkle.Tree(a), merkle.Tree(a)) == []
    assert merkle.Tree("a\n").root != merkle.Tree("a").root


def test_licenses(spark, sf, docs, odd, empty):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    for r in licenses.op7_license_scan(spark, sf).collect():
        words = word.findall(docs[r.doc_id].translate(LOWER))
        places, labels = [], set()
        for phrase, label in licenses.BASE.items():
            k = phrase.split()
            own = [i for i in range(len(words) - len(k) + 1) if words[i : i + len(k)] == k]
            places += own
            labels |= {label} if own else set()
        assert (r.n_words, r.n_base, r.base_labels) == (len(words), len(places), ",".join(sorted(labels)))
        assert (r.first_word, r.last_word) == ((min(places), max(places)) if places else (None, None))
        assert labels <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    index = licenses.build_index({}, 10)
    assert licenses.scan("Released under the MIT License.", index)[5] == "mit"
    assert licenses.scan("x CC BY cc-by", index)[:4] == (5, 2, 1, 3)
    assert licenses.scan_documents(odd).count() == odd.count()
    assert licenses.scan_documents(empty).count() == 0


def test_language_model(spark, sf, docs, odd, empty):
    word = re.compile("[^\x20\x09-\x0d]+")
    tokens = {d: [*word.findall(t.translate(LOWER)), None] for d, t in docs.items()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in docs}
    counts: Counter = Counter()
    for d in docs:
        if not held[d]:
            counts.update(tokens[d])
    n, v = sum(counts.values()), len(counts)
    rows = {r.doc_id: r for r in language_model.op8_bilinear_scores(spark, sf).collect()}
    for d, r in rows.items():
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens[d])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(tokens[d]), sum(t in counts for t in tokens[d]), n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0
    out = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    # the scores anew, in plain Python, from the same model; and against smoothed bigrams of the classes
    M = language_model
    raw = {d: [t.encode() if t is not None else M.END for t in ts] for d, ts in tokens.items()}
    seen = Counter(t for d in docs if not held[d] for t in raw[d])
    classes = M.Classes([w for w, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0])) if w != M.END][: M.TOP])
    pairs = np.zeros((2, classes.size, classes.size))
    for d in docs:
        if not held[d]:
            x = [0, 0, *(classes[t] for t in raw[d])]
            for a, b, c in zip(x[1:], x, x[2:]):
                pairs[0, a, c] += 1
                pairs[1, b, c] += 1
    got = M.class_pairs(table(spark, sf, "documents").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2), classes)
    assert (got[0] == pairs[0]).all() and (got[1] == pairs[1]).all()
    model = M.fit_bilinear(*got)
    share, kinds = Counter(), Counter()
    for w, c in seen.items():
        if w not in classes:
            share[classes[w]] += c
            kinds[classes[w]] += 1
    uni = (pairs[0].sum(0) + 1) / (pairs[0].sum() + classes.size)
    bigram = (pairs[0] + M.PRIOR * uni) / (pairs[0].sum(1, keepdims=True) + M.PRIOR)
    plain = 0.0
    for d in docs:
        x = [classes[t] for t in raw[d]]
        inner = sum(math.log10((seen[t] + 1) / (share[k] + kinds[k] + 1)) for t, k in zip(raw[d], x) if t not in classes)
        z = [sum(10 ** (float(model.near[a, c]) + float(model.far[b, c])) for c in range(classes.size)) for a, b in list(zip([0, *x], [0, 0, *x]))[: min(3, len(x))]]
        assert np.allclose(np.log10(z), [model.norm[a, b] for a, b in zip([0, *x], [0, 0, *x][: len(z)])], atol=1e-4)
        assert rows[d].score == pytest.approx(float(model.log10(np.array(x)).sum()) + inner, rel=1e-5)
        if held[d]:
            plain += sum(math.log10(bigram[a, c]) for a, c in zip([0, *x], x)) + inner
    assert sum(r.score for r in out) > plain
    assert language_model.score_documents(odd).count() == odd.count()
    assert language_model.score_documents(empty).count() == 0


def test_bilinear_is_normalised():
    rng = np.random.default_rng(0)
    bigrams = rng.integers(0, 50, (20, 20)).astype(float)
    bigrams[3, 4] = 5000
    table_ = language_model.log10_table(*language_model.train_bilinear(bigrams, dim=8))
    assert np.allclose((10.0 ** table_.astype(float)).sum(1), 1, atol=1e-4) and table_[3].argmax() == 4


def test_substrings(spark, sf, docs, odd, empty):
    rows = {r.doc_id: r for r in substrings.op3_gear_chunk_dedup(spark, sf).collect()}

    def repeats(texts):
        first, out = {}, Counter()
        for d in sorted(texts):
            w = texts[d].split()
            for i in range(len(w) - 49):
                if first.setdefault(tuple(w[i : i + 50]), d) != d:
                    out[d] += 1
        return out

    before, after = repeats(docs), repeats({d: r.text for d, r in rows.items()})
    assert before and sum(after.values()) <= 0.02 * sum(before.values())
    for d, r in rows.items():
        spans = [tuple(map(int, s.split("-"))) for s in r.removed_spans.split(",") if s]
        kept = "".join(docs[d][a:b] for a, b in zip([0, *[e for _, e in spans]], [*[s for s, _ in spans], len(docs[d])]))
        assert kept == r.text
    out = substrings.dedup_substrings(odd)
    assert out.columns == [*odd.columns, "removed_words", "removed_spans"] and out.count() == odd.count()
    by = {r.doc_id: r for r in out.collect()}
    assert by[1].text and not by[2].text.strip() and by[3].text is None
    assert substrings.dedup_substrings(empty).count() == 0


def test_no_passage_is_missed_whole(spark):
    rng = np.random.default_rng(9)
    rows = []
    for j in range(400):
        passage = " ".join(f"{i:x}" for i in rng.integers(0, 2**16, 50))
        for side in (0, 1):
            rows.append((2 * j + side, " ".join([f"a{j}x{side}x{i}" for i in range(30)] + [passage] + [f"b{j}x{side}x{i}" for i in range(30)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.removed_words for r in substrings.dedup_substrings(docs).select("doc_id", "removed_words").collect()}
    assert all(got[2 * j] == 0 and substrings.MIN_WORDS <= got[2 * j + 1] <= 50 for j in range(400))


def test_only_runs_of_one_document_go(spark):
    rng = np.random.default_rng(8)
    words = [f"word{i}" for i in rng.integers(0, 10**6, 600)]
    at = np.concatenate(([0], np.cumsum(substrings.chunk(" ".join(words))[1])))
    parts = [words[a:b] for a, b in zip(at, at[1:]) if b - a < substrings.MIN_WORDS]
    texts = [[w for p in order for w in p] for order in (parts, parts[::-1], parts[:20] + parts[60:90] + parts[30:50])]
    rows = substrings.dedup_substrings(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")).collect()
    got = {r.doc_id: r for r in rows}
    assert got[0].removed_words == 0 and got[1].removed_words == 0 < got[2].removed_words
    seen = {tuple(w[i : i + substrings.MIN_WORDS]) for w in texts[:2] for i in range(len(w) - substrings.MIN_WORDS + 1)}
    covered = {i + k for i in range(len(texts[2])) if tuple(texts[2][i : i + substrings.MIN_WORDS]) in seen for k in range(substrings.MIN_WORDS)}
    places = np.cumsum([0] + [len(w) + 1 for w in texts[2]])
    gone = {k for s in got[2].removed_spans for k in range(len(texts[2])) if s.start <= places[k] < s.end}
    assert gone <= covered and len(gone) == got[2].removed_words


def plain_chunks(text):
    """The chunks as lists of words, by loops: gear sums over 16 bytes, a cut's word, and the smallest hash of a stretch without one."""
    words = text.encode("utf-8", "surrogatepass").split()
    data = b" ".join(words)
    gear = substrings._GEAR.tolist()
    h = [(sum(gear[data[i - k]] << k for k in range(16) if i >= k) & 0xFFFFFFFF) >> 15 for i in range(len(data))]
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    word_at = [k for k, w in enumerate(words) for _ in range(len(w) + 1)]
    cuts = {min(word_at[i], len(words) - 1) for i in range(len(data)) if h[i] % substrings.AVERAGE == 0}
    more = set()
    for a in range(len(words) - substrings.LONGEST + 1):
        stretch = range(a, a + substrings.LONGEST)
        if not cuts & set(stretch):
            more.add(min(stretch, key=lambda k: (h[ends[k] - 1], k)))
    out, own = [], []
    for k, w in enumerate(words):
        own.append(w)
        if k in cuts | more or k == len(words) - 1:
            out.append(tuple(own))
            own = []
    return out


def plain_repeats(texts, least=substrings.MIN_WORDS):
    """{document: numbers of the words that must go}, document by document in order."""
    seen, gone = {}, {}
    for d in sorted(texts):
        chunks = plain_chunks(texts[d])
        begins = [sum(map(len, chunks[:i])) for i in range(len(chunks) + 1)]
        found = set()
        for i in range(len(chunks)):
            j = next((j for j in range(i + 1, len(chunks) + 1) if begins[j] - begins[i] >= least), None)
            if j is not None:
                found.add((i, j))
        back = next((i for i in range(len(chunks) - 1, -1, -1) if begins[-1] - begins[i] >= least), None)
        if back is not None:
            found.add((back, len(chunks)))
        gone[d] = set()
        for i, j in found:
            if seen.setdefault(tuple(chunks[i:j]), d) != d:
                gone[d] |= set(range(begins[i], begins[j]))
    return gone


def test_what_goes_and_stays_against_loops(spark):
    """Passages put into other texts whole, with words put in, in another order, and within one document; short, empty and repeated texts."""
    rng = np.random.default_rng(31)
    word = lambda: f"{rng.integers(0, 900):x}" + "z" * int(rng.integers(0, 5))
    some = lambda n: [word() for _ in range(n)]
    passages = [some(int(rng.integers(10, 90))) for _ in range(12)]
    texts = {}
    for d in range(60):
        own = some(int(rng.integers(0, 40)))
        for _ in range(int(rng.integers(0, 3))):
            p = list(passages[rng.integers(0, 12)])
            if rng.random() < 0.4:
                p.insert(int(rng.integers(0, len(p))), "inserted")
            own += p + some(int(rng.integers(0, 20)))
        texts[d] = (" " if d % 2 else "\n").join(own)
    texts |= {60: texts[3], 61: "", 62: "one word " * 30, 63: "one word " * 40, 64: "x" * 3000}
    rows = substrings.dedup_substrings(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    want = plain_repeats(texts)
    assert sum(map(len, want.values())) > 1000
    for r in rows:
        places = [m.span() for m in re.finditer("[^\x20\x09-\x0d]+", texts[r.doc_id])]
        gone = {k for s in r.removed_spans for k, (a, b) in enumerate(places) if s.start <= a < s.end}
        assert gone == want[r.doc_id] and r.removed_words == len(gone)
        assert r.text.split() == [texts[r.doc_id][a:b] for k, (a, b) in enumerate(places) if k not in gone]


def test_the_query_cuts_whole_chunks(spark, sf, docs):
    """All that goes are whole chunks; words put into a copied text keep two chunks at most."""
    for r in substrings.op3_gear_chunk_dedup(spark, sf).collect():
        begins = np.concatenate(([0], np.cumsum(substrings.chunk(docs[r.doc_id])[1]))).tolist()
        places = [m.start() for m in re.finditer("[^\x20\x09-\x0d]+", docs[r.doc_id])]
        for span in r.removed_spans.split(","):
            if span:
                a, b = (np.searchsorted(places, int(x)) for x in span.split("-"))
                assert a in begins and b in begins
    words = max(docs.values(), key=len).split()[:600]
    rows = substrings.dedup_substrings(spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words[:300], "put", "in", *words[300:]]))], "doc_id long, text string"))
    left = {r.doc_id: r.removed_words for r in rows.collect()}
    assert left[1] == 0 and left[2] >= 600 - 4 * substrings.LONGEST


def test_chunks_resist_insertions():
    rng = np.random.default_rng(3)
    words = [f"word{i}" for i in rng.integers(0, 10**6, 2000)]
    a, b = set(substrings.chunk(" ".join(words))[0]), set(substrings.chunk(" ".join(words[:700] + ["new", "words"] + words[700:]))[0])
    assert len(a - b) <= 2
    assert substrings.chunk("") == ([], [])
    h = substrings.gear(np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8))
    slow = sum(int(substrings._GEAR[ord("z") - k]) << k for k in range(16)) % 2**32
    assert int(h[-1]) == slow


def test_decontamination(spark, sf, docs, odd, empty):
    bench = table(spark, sf, "benchmark")
    plain = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    items = {r.item_id: plain(r.text) for r in bench.collect()}
    want = {d: {i for i, p in items.items() if p in plain(t)} for d, t in docs.items()}
    got = {r.doc_id: {int(x) for x in r.item_ids.split(",") if x} for r in decontamination.op4_template_decontamination(spark, sf).collect()}
    assert all(want[d] <= got[d] for d in docs) and sum(map(bool, got.values())) <= sum(map(bool, want.values())) + 2
    assert decontamination.flag_documents(odd, bench).count() == odd.count()
    assert decontamination.flag_documents(empty, bench).count() == 0
    assert decontamination.flag_documents(odd, bench.limit(0)).where("contaminated").count() == 0
    assert decontamination.drop_contaminated(odd, bench).columns == odd.columns


def test_reparameterised_questions(spark):
    ask = "A train leaves the old station at {} km per hour while farmer {} counts {} sheep and then {} counts again until the evening bell rings twice."
    bench = spark.createDataFrame([(1, ask.format(40, "Anna", 12, "Anna"))], "item_id long, text string")
    rows = [(1, ask.format(95, "Bertha", 700, "Bertha")), (2, ask.format(95, "Bertha", 700, "Carla")), (3, "A train is late and nobody counts sheep at the old station today.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.contaminated for r in decontamination.flag_documents(docs, bench).collect()}
    assert got == {1: True, 2: False, 3: False}


def test_broken_and_partial_copies(spark, sf):
    items = [(r.item_id, r.text.split()) for r in table(spark, sf, "benchmark").collect() if len(r.text.split()) >= 24]
    filler = " ".join(f"other{i}" for i in range(40))
    forms = {"whole": lambda w: w, "put in": lambda w: w[: len(w) // 2] + ["zzz"] + w[len(w) // 2 :], "left out": lambda w: w[: len(w) // 2] + w[len(w) // 2 + 1 :], "half": lambda w: w[: len(w) // 2]}
    rows = [(n, i, f"{filler} {' '.join(make(w))} {filler}") for n, make in forms.items() for i, w in items]
    docs = spark.createDataFrame([(f"{n}/{i}", text) for n, i, text in rows], "doc_id string, text string")
    got = {r.doc_id: r.item_ids.split(",") for r in decontamination.flag_documents(docs, table(spark, sf, "benchmark")).collect()}
    for n in forms:
        assert sum(str(i) in got[f"{n}/{i}"] for i, _ in items) >= 0.95 * len(items) > 0, n


def test_one_unequal_slot_of_many(spark):
    ask = "Then {} sold apples to the baker, and {} sold pears to the miller, and {} went home along the quiet river road."
    bench = spark.createDataFrame([(1, ask.format("Anna", "Anna", "Anna"))], "item_id long, text string")
    docs = spark.createDataFrame([(1, ask.format("Bertha", "Bertha", "Carla")), (2, ask.format("Bertha", "Dora", "Carla"))], "doc_id long, text string")
    got = {r.doc_id: r.contaminated for r in decontamination.flag_documents(docs, bench).collect()}
    assert got == {1: True, 2: False}


def test_toxicity(spark, sf, odd, empty):
    more = sf.replace("sf0.001", "sf0.01")  # the smallest tables have eight toxic rows
    out = toxicity.op1_subword_toxicity(spark, more).join(table(spark, more, "labels"), "doc_id").where("held_out").select("score", "toxic").collect()
    pos, neg = [r.score for r in out if r.toxic], [r.score for r in out if not r.toxic]
    assert all(0 <= s <= 1 for s in pos + neg) and np.mean([[p > n for n in neg] for p in pos]) > 0.8
    rng = np.random.default_rng(2)
    filler = lambda: " ".join(f"w{i}" for i in rng.integers(0, 400, 60))
    sample = [(f"{filler()} dreadful {filler()}", 1) for _ in range(80)] + [(filler(), 0) for _ in range(80)]
    model = toxicity.train(sample)
    assert model.score(f"{filler()} dreadfull {filler()}") > 0.5 > model.score(filler())
    scored = toxicity.score_documents(odd, model)
    assert scored.count() == odd.count() and scored.columns.count("score") == 1
    assert toxicity.score_documents(empty, model).count() == 0
    assert toxicity.train([]).score("anything") == 0.5


def test_quality(spark, sf, odd, empty):
    out = quality.op9_line_crf_quality(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out").select("score", "quality").collect()
    pos, neg = [r.score for r in out if r.quality], [r.score for r in out if not r.quality]
    assert np.mean([[p > n for n in neg] for p in pos]) > 0.9
    scored = quality.score_documents(odd, quality.train([]))
    assert scored.count() == odd.count()
    assert quality.score_documents(empty, quality.train([])).count() == 0


def test_field_learns_changes_within_a_document():
    rng = np.random.default_rng(7)

    def prose(n):
        return ["The " + " ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(12)) + "." for _ in range(n)]

    def junk(n):
        return ["| ".join(["##", *("%d" % x for x in rng.integers(0, 99, 9))]) for _ in range(n)]

    # one line in ten is of the other kind
    sample = [("\n".join(prose(10 + k % 7) + junk(1)), 1) for k in range(60)] + [("\n".join(junk(10 + k % 7) + prose(1)), 0) for k in range(60)]
    field = quality.train(sample)
    x, size = quality.features("\n".join(junk(12) + prose(12)))
    good = quality.forward_backward((x @ field.emit)[None], field.move, np.array([24]))[0][0]
    assert good[:12].max() < 0.5 < good[12:].min() and good[12:].mean() - good[:12].mean() > 0.9
    assert field.move[0, 0] + field.move[1, 1] > field.move[0, 1] + field.move[1, 0]
    scores = list(quality.score_texts(field, ["\n".join(prose(20)), "\n".join(prose(10) + junk(10)), "\n".join(junk(20))]))
    assert scores[0] > scores[1] > scores[2]
    x, size = quality.features("\n".join(prose(10) + junk(10)))
    free = quality.forward_backward((x @ field.emit)[None], field.move, np.array([20]))[0][0] > 0.5
    for y in (0, 1):
        labels = quality.line_labels(field, x, size, y)
        assert ((labels == y) * size).sum() >= (quality.SHARE - 0.1) * size.sum()
        # lines of the label's own kind keep it
        assert (labels[free == y] == y).all()


def test_long_documents_are_trained_on_whole():
    chains = [(np.zeros((n, quality.FEATURES)), np.zeros(n, np.int64), 1.0) for n in (1, 3, 400, 30_000)]
    packs = quality.packs_of(chains)
    assert sum(p[2].sum() for p in packs) == 30_404


def test_forward_backward_against_all_paths():
    from itertools import product

    rng = np.random.default_rng(4)
    score, move = rng.normal(size=(1, 5)), rng.normal(size=(2, 2))
    weight = {p: math.exp(sum(score[0, t] * p[t] for t in range(5)) + sum(move[p[t], p[t + 1]] for t in range(4))) for p in product((0, 1), repeat=5)}
    z = sum(weight.values())
    good, counts = quality.forward_backward(np.pad(score, ((0, 0), (0, 2))), move, np.array([5]))
    for t in range(5):
        assert good[0, t] == pytest.approx(sum(w for p, w in weight.items() if p[t]) / z)
    assert counts[0, 0, 1] == pytest.approx(sum(w * sum(p[t] == 0 and p[t + 1] == 1 for t in range(4)) for p, w in weight.items()) / z)


def test_pipeline(spark, sf, odd):
    import corpus_pipeline

    docs = table(spark, sf, "documents")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).checkpoint()
        assert docs.columns == columns and docs.count() <= n, name
        n = docs.count()
    assert n > 100
    pieces = corpus_pipeline.pack(spark, docs, sf)
    assert pieces.select("doc_id").distinct().count() == n


def test_head_words_are_the_most_frequent(spark):
    r = np.random.default_rng(4)
    rows = [(b"w%d" % i, int(c)) for i, c in enumerate(r.choice([1, 2, 3, 5000, 5001, 900_000], 400))]
    counts = spark.createDataFrame(rows, "word binary, c long").repartition(7)
    for size in (1, 5, 120, 399, 1000):
        assert language_model.head_of(counts, size) == sorted(rows, key=lambda x: (-x[1], x[0]))[:size]
    assert language_model.head_of(counts.limit(0)) == []


SHORT_ITEMS = [
    "Paris",
    "Who wrote Hamlet?",
    "The capital city is Lima.",
    "Name the seven smaller moons now.",
    "Which river crosses the old town today?",
    "Anna 12, Boris 40, Carla 77, Dora 15, Emil 90, Frida 31, Gustav 8, Hanna 56, Ivan 3, Jana 64",
    "3 4 5 6 7 8 9 10 11 12 13 14",
    "Wie heißt ‘Größe’ – auf Englisch?",
    "١٢ كم يساوي",
]


@pytest.mark.parametrize("small", [True, False])
def test_every_item_is_found_at_any_offset(spark, sf, monkeypatch, small):
    if not small:
        monkeypatch.setattr("loomgraph.llm.common.BROADCAST_BYTES", -1)
    rng = np.random.default_rng(12)
    items = SHORT_ITEMS + [r.text for r in table(spark, sf, "benchmark").limit(40).collect()]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    rows = []
    for i, t in enumerate(items):
        for k in range(9):
            before, after = (" ".join(f"other{x}" for x in rng.integers(0, 10**6, n)) for n in (k, rng.integers(0, 30)))
            rows.append((f"{i}/{k}", " ".join(x for x in (before, t, after) if x)))
    rows += [(f"clean/{k}", " ".join(f"other{x}" for x in rng.integers(0, 10**6, 60))) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(8)
    got = {r.doc_id: r.item_ids.split(",") for r in decontamination.flag_documents(docs, bench).collect()}
    assert [d for d in got if d.split("/")[0] not in got[d] and not d.startswith("clean")] == []
    assert all(got[f"clean/{k}"] == [""] for k in range(30))


def test_new_numbers_and_names_are_found(spark):
    rng = np.random.default_rng(5)
    names = ["Anna", "Boris", "Carla", "Dora", "Emil", "Frida", "Gustav", "Hanna"]
    verbs = ["buys", "sells", "paints", "counts", "carries", "drops", "finds", "loses"]
    things = ["apples", "boxes", "lamps", "stones", "ropes", "tins", "candles", "nails"]

    def ask(words, values):
        a, b, c, x, y = values
        v, w, t, u = words
        return f"Every morning {a} {v} {x} {t} near the mill while {b} {w} {y} {u} at home, so how many {t} does {a} have if {c} takes half?"

    def draw():
        return (*rng.choice(names, 3, replace=False), *rng.integers(2, 99, 2))

    questions = [(*rng.choice(verbs, 2, replace=False), *rng.choice(things, 2, replace=False)) for _ in range(30)]
    bench = spark.createDataFrame([(i, ask(q, draw())) for i, q in enumerate(questions)], "item_id long, text string")
    filler = " ".join(f"other{i}" for i in range(17))
    docs = spark.createDataFrame([(i, f"{filler} {ask(q, draw())} {filler}") for i, q in enumerate(questions)], "doc_id long, text string")
    got = {r.doc_id: r.item_ids.split(",") for r in decontamination.flag_documents(docs, bench).collect()}
    assert sum(str(i) in got[i] for i in got) >= 0.9 * len(questions)
