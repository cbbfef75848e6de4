"""run() against brute force on documents with planted cases, and on odd and empty tables."""

import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from loomgraph.llm import packing, toxicity

BAD = "you worthless stupid idiot shut up and get lost"


def words(rng, n):
    return [f"{a}{b}" for a, b in zip(rng.choice(list("bcdfgklmnprst"), n), rng.integers(0, 10**5, n))]


def write(spark, path, docs, labels, items):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def test_run_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(17)
    texts = {i: " ".join(words(rng, 150)) for i in range(120)}
    for i in range(30):  # toxic
        texts[200 + i] = " ".join([*words(rng, 40), *BAD.split() * 3, *words(rng, 40)])
    for i in range(20):  # copies, whole and near
        texts[300 + i] = texts[i]
        w = texts[20 + i].split()
        w[70] = "changed"
        texts[400 + i] = " ".join(w)
    passage = words(rng, 60)
    for i in range(10):  # a passage that documents share
        texts[500 + i] = " ".join([*words(rng, 50), *passage, *words(rng, 50)])
    items = [(k, " ".join(words(rng, 25))) for k in range(6)]
    for i in range(6):  # an item each
        texts[600 + i] = " ".join([*words(rng, 30), items[i][1], *words(rng, 30)])
    docs = [(d, t, "en", "s", len(t)) for d, t in texts.items()]
    labels = [(d, 1, int(200 <= d < 300)) for d in texts if d < 300]
    write(spark, f"{tmp_path}", docs, labels, items)
    rows = corpus_pipeline.run(spark, f"{tmp_path}").orderBy("doc_id", "start").collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(r)

    # 1: the model's own scores, text by text
    sample = {y: sorted((d for d in texts if d < 300 and zlib.crc32(str(d).encode()) % 3 != 1 and (200 <= d) == bool(y))) for y in (0, 1)}
    model = toxicity.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert all(model.score(texts[d]) >= 0.7 for d in sample[1])
    left = {d for d in texts if model.score(texts[d]) < 0.7}
    assert {d for d in texts if not 200 <= d < 300} <= left
    # 2: of similar documents the smallest id stays
    left = {d for d in left if not any(e in left and e < d and jaccard(texts[e], texts[d]) >= 0.8 for e in texts)}
    assert not {300, 419} & left and {0, 20, 500, 509} <= left
    # 4: documents that hold an item go
    left = {d for d in left if not any(t in texts[d] for _, t in items)}
    assert set(got) == left

    # 5 and 3: pieces are the tokens of what is left of the text
    t = Tokenizer.from_file(packing.tokenizer_path())
    for d in left:
        ids = [x for r in got[d] for x in np.frombuffer(r.tokens, "<u4").tolist()]
        assert ids[-1] == 1 and all(r.length & (r.length - 1) == 0 for r in got[d])
        whole = t.encode(texts[d], add_special_tokens=False).ids
        if not 500 < d < 510:
            assert ids[:-1] == whole
        else:
            # of the shared passage at least two thirds go, of the rest nothing
            inner = len(t.encode(" ".join(passage), add_special_tokens=False).ids)
            assert inner * 2 / 3 <= len(whole) - len(ids) + 1 <= inner
            own = texts[d].split()
            for side in (own[:50], own[-50:]):
                part = t.encode(" ".join(side), add_special_tokens=False).ids
                assert ids[: len(part)] == part or ids[-len(part) - 1 : -1] == part


def test_run_on_odd_and_empty_tables(spark, tmp_path, odd):
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in odd.collect()]
    write(spark, f"{tmp_path}/odd", rows, [(7, 0, 1), (5, 1, 0), (None, 1, 1)], [(1, None), (2, "")])
    left = {r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/odd").select("doc_id").distinct().collect()}
    assert {1, 3, 5, 6} <= left and 2 not in left and 4 not in left
    write(spark, f"{tmp_path}/empty", [], [], [])
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
