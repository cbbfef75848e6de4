import re
import zlib
from collections import Counter

import pytest

from loomgraph.llm import spelling
from loomgraph.llm.common import table

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_vocabulary(rows, least=5):
    count: Counter = Counter()
    for d, text in rows:
        for run in RUN.findall(text or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    return {w: n for w, n in count.items() if len(w) >= 6 and n >= least}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k:] == b[k + 1 :] or a[k + 1 :] == b[k + 1 :]


def plain_variants(vocab, factor=5):
    near = {w: [x for x in vocab if abs(len(x) - len(w)) < 2 and one_edit(w, x)] for w in vocab}
    best = {w: min(near[w], key=lambda x: (-vocab[x], x), default=None) for w in vocab}
    form = {w: b if b is not None and vocab[b] >= factor * vocab[w] else None for w, b in best.items()}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), vocab.get(form[w])) for w, n in vocab.items()}


def rows_of(df):
    got = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(set(got)) == len(got)
    return set(got)


def test_query_against_all_pairs(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    assert rows_of(spelling.op13_spelling_variants(spark, sf)) == plain_variants(plain_vocabulary(rows))


#: Chains over three forms, ties, doubled letters, letters of two bytes, neighbours by each kind of edit.
VOCAB = {"colour": 4000, "colours": 700, "coloours": 100, "colooours": 12, "color": 4000, "colar": 5, "coler": 5, "naïve": 90, "naive": 10, "aaaa": 6, "aaaaa": 30, "aaab": 30, "zz": 7}


@pytest.mark.parametrize("small", [True, False])
def test_vocabulary_against_all_pairs(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr("loomgraph.llm.common.BROADCAST_BYTES", 0)
    vocab = spark.createDataFrame(list(VOCAB.items()), "word string, n long")
    got = rows_of(spelling.spelling_variants(vocab))
    assert got == plain_variants(VOCAB)
    assert next(g for g in got if g[0] == "colooours")[1:3] == ("coloours", "colour")


@pytest.mark.parametrize("cells", [1, 64, 1 << 19])
def test_neighbours_are_distinct_and_whole(cells):
    letters = spelling.Letters(list("abé"), 40)
    hashed = {}
    for words in (["abba", "aabb", "ébéa"], ["é", "a"]):
        got = []
        rows = letters.of(words)
        for kind, r, p, c, h in letters.neighbours(rows, cells):
            for i, j, sign, value in zip(r.tolist(), p.tolist(), ["", ""] * len(r) if c is None else [letters.letters[x] for x in c], h.tolist()):
                near = words[i][:j] + sign + words[i][j + (kind != "insert") :]
                got.append((near, words[i]))
                assert hashed.setdefault(near, value) == value
                assert not near or int(letters.hashes(letters.of([near]))[0]) == value
        want = set()
        for w in words:
            own = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[j:] for i in range(len(w) + 1) for c in "abé" for j in (i, i + 1)}
            want |= {(x, w) for x in own | {w + c for c in "abé"} if x != w}
        assert len(got) == len(set(got)) and set(got) == want
    assert len(set(hashed.values())) == len(hashed)


def test_a_full_filter_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(spelling, "MOST_BITS", spelling.PIECE)
    monkeypatch.setattr(spelling.Letters, "bit", lambda self, h: h & h.dtype.type(3))
    vocab = spark.createDataFrame(list(VOCAB.items()), "word string, n long")
    assert rows_of(spelling.spelling_variants(vocab)) == plain_variants(VOCAB)


def test_odd_rows(spark, odd, empty):
    """Nulls and empty texts have no words; a null id is the empty text; long runs, repeated rows and clashing columns count as they are."""
    texts = odd.select("doc_id", "text").collect()
    assert rows_of(spelling.spelling_variants(spelling.vocabulary(spelling.words_of(odd)))) == plain_variants(plain_vocabulary([tuple(r) for r in texts]))
    assert spelling.spelling_variants(spelling.vocabulary(spelling.words_of(empty))).count() == 0
    strange = spark.createDataFrame([(None, "Größere GRÖSSERE Größere×÷x " * 5), (1, "ÀÉÎÕÜß àéîõüß ÀÉÎÕÜß " * 5), (1, "don't abc123def " * 9)], "doc_id long, text string")
    assert rows_of(spelling.spelling_variants(spelling.vocabulary(spelling.words_of(strange)))) == plain_variants(plain_vocabulary([tuple(r) for r in strange.collect()]))
    blank = spark.createDataFrame([(None, 5), ("", 5), ("word", 5)], "word string, n long")
    assert rows_of(spelling.spelling_variants(blank)) == {("word", None, "word", 5, 0, None)}
