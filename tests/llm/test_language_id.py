import math
import zlib
from collections import Counter

import numpy as np
import pytest

from loomgraph.llm import language_id as L
from loomgraph.llm.common import table


def plain_grams(text):
    """N-grams as strings: letters lower-cased, one space for each run of anything else, one at either end."""
    runs = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    if not runs:
        return Counter()
    x = " " + " ".join(runs) + " "
    return Counter(g for n in range(1, 5) for g in (x[i : i + n] for i in range(len(x) - n + 1)) if g != " ")


def bucket(gram):
    h = ord(gram[0])
    for c in gram[1:]:
        h = (h * 0x01000193 & 0xFFFFFFFF) ^ ord(c)
    return ((h ^ (h >> 15)) * 0x9E3779B1 & 0xFFFFFFFF) >> 17


@pytest.mark.parametrize("text", ["", " .,! 12\n", "a", "Été à  l'école, 3 fois!", "漢字 かな 🙂 𝒳𝒴 x", "x" * 20_000 + " y z. " * 3000, "ab, " * 70_000, "\ud800x"])
def test_features_against_strings(text, monkeypatch):
    want: Counter = Counter()
    for g, n in plain_grams(text).items():
        want[bucket(g)] += n
    for size in (L.SLICE, 7, 64) if len(text) < 50_000 else (L.SLICE, 10_001):
        monkeypatch.setattr(L, "SLICE", size)
        buckets, counts = L.features(text)
        assert dict(zip(buckets.tolist(), counts.tolist())) == dict(want)


def test_query(spark, sf):
    docs = {r.doc_id: r for r in table(spark, sf, "documents").collect()}
    rows = {r.doc_id: r for r in L.op12_ftrl_languages(spark, sf).collect()}
    assert set(rows) == set(docs)
    held = [r for r in rows.values() if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r.score <= 1 for d, r in rows.items())
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.95 * len(held)
    # the same model in plain Python: frequencies of all training documents, then the learner on the sample
    own = [r for d, r in docs.items() if zlib.crc32(str(d).encode()) % 4 != 2 and r.text is not None and r.lang is not None]
    df: Counter = Counter()
    for r in own:
        df.update({bucket(g) for g in plain_grams(r.text)})
    idf = np.array([math.log((1 + len(own)) / (1 + df[b])) + 1 for b in range(L.BUCKETS)])
    fit = L.fit(table(spark, sf, "documents"))
    assert np.allclose(fit.idf, idf)
    for d, r in list(docs.items())[:60]:
        counts: Counter = Counter()
        for g, n in plain_grams(r.text or "").items():
            counts[bucket(g)] += n
        v = {b: (1 + math.log(n)) * idf[b] for b, n in counts.items()}
        length = math.sqrt(sum(x * x for x in v.values()))
        z = np.array([sum(x / length * fit.weights[b, k] for b, x in v.items()) + fit.bias[k] for k in range(len(fit.languages))]) / fit.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert rows[d].lang_pred == fit.languages[int(p.argmax())] and rows[d].score == pytest.approx(p.max(), rel=1e-6)


def test_only_training_rows_are_learnt_from(spark):
    """Held-out rows and those of null language or text change nothing, nor do columns beside."""
    words = {"aa": "one two three four", "bb": "uno dos tres cuatro"}
    rows = [(i, f"{w} {i * 7919 % 1000}x", lang, "src") for i in range(60) for lang, w in words.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    held = [(i, "zz qq ww", "cc", "src") for i in range(300) if zlib.crc32(str(i).encode()) % 4 == 2]
    noise = spark.createDataFrame(held + [(5, None, "aa", ""), (5, "zz qq ww", None, "")], df.schema)
    a, b = L.fit(df), L.fit(df.unionByName(noise))
    assert a.languages == b.languages == ["aa", "bb"] and np.array_equal(a.weights, b.weights) and a.temperature == b.temperature and np.array_equal(a.idf, b.idf)
    assert (a.weights == 0).mean() > 0.9
    assert a.predict("dos cuatro tres")[0] == "bb" and a.predict("three four")[0] == "aa"


def test_sample_is_bounded_and_distinct(spark):
    """One text that holds a third of all rows counts once; each language gives its share of distinct texts, by hash."""
    rows = [(i, f"text number {'x' * i}", "aa" if i % 3 else "bb") for i in range(400)] + [(i, "the same text", "aa") for i in range(200)] + [(1, "only one", "cc"), (1, "123", "dd")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = L.labelled_features(df.select("lang", "text"), rows=80)
    assert Counter(lang for lang, _, _ in sample) == {"aa": 20, "bb": 20, "cc": 1}
    assert len({(lang, b.tobytes(), c.tobytes()) for lang, b, c in sample}) == len(sample)


def test_one_step_of_the_learner():
    f = L.Ftrl((3, 2), 0.1)
    z, n = np.zeros((3, 2)), np.zeros((3, 2))
    rng = np.random.default_rng(1)
    for _ in range(20):
        at, g = rng.permutation(3)[:2], rng.normal(size=(2, 2))
        w = f.weights(at)
        for i, row in enumerate(at):
            for k in range(2):
                want = 0.0 if abs(z[row, k]) <= 0.1 else -(z[row, k] - math.copysign(0.1, z[row, k])) / ((L.BETA + math.sqrt(n[row, k])) / L.ALPHA + L.L2)
                assert w[i, k] == pytest.approx(want)
                sigma = (math.sqrt(n[row, k] + g[i, k] ** 2) - math.sqrt(n[row, k])) / L.ALPHA
                z[row, k] += g[i, k] - sigma * want
                n[row, k] += g[i, k] ** 2
        f.step(at, w, g)
    assert np.allclose(f.z, z) and np.allclose(f.n, n)


def test_temperature_finds_overconfidence():
    rng = np.random.default_rng(4)
    z = rng.normal(size=(4000, 3))
    p = L.softmax(z)
    y = (rng.random(4000)[:, None] > np.cumsum(p, 1)).sum(1)
    assert L.temperature_of(z * 5, y) == pytest.approx(5, rel=0.1)
    assert L.temperature_of(np.empty((0, 3)), np.empty(0, int)) == 1.0


def test_odd_rows(spark, odd, empty):
    model = L.fit(odd)
    out = L.predict_languages(odd, model)
    assert out.columns == [*[c for c in odd.columns if c != "score"], "lang_pred", "score"] and out.count() == odd.count()
    got = {r.doc_id: r for r in out.collect()}
    assert got[3].lang_pred == got[4].lang_pred == got[8].lang_pred == "und" and got[3].score == 0
    assert got[6].lang_pred == "en"
    assert L.predict_languages(empty, L.fit(empty)).count() == 0
    assert {r.lang_pred for r in L.predict_languages(odd, L.fit(empty)).collect()} == {"und"}
