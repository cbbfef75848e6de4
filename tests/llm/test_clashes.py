"""Every operator on tables whose further columns bear its helpers' names, on empty tables, very long texts and repeated rows."""

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import decontamination, language_model, licenses, merkle, packing, quality, sharding, simhash, substrings, toxicity

NAMES = "__text __hash __h __id __own __other __repeated __row __hot __n __stays __tie text_hash node f0 key probe pair raw template hits size part row tie shingles digest digests own other h n kept root rows bytes word c".split()
LONG = "word " * 1_000_000 + "end."


@pytest.fixture(scope="module")
def wide(spark):
    """Documents, two rows that differ in a further column only, a very long text, and a map and an array among the columns."""
    rows = [(1, "The quick brown fox jumps over the lazy dog, again and again, until the evening comes to town.", 0)]
    rows += [(1, rows[0][1], 1), (2, rows[0][1], 0), (3, LONG, 0), (4, None, 0), (None, "you stupid idiot", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra int")
    own = [(F.coalesce("doc_id", F.lit(9)) * 1000 + F.col("extra") * 100 + i).alias(n) for i, n in enumerate(NAMES)]
    return docs.select("*", *own, F.create_map(F.lit("a"), F.col("extra")).alias("m"), F.array("extra").alias("xs")).cache()




OPERATORS = {
    "toxicity": (lambda d, b: toxicity.score_documents(d, toxicity.train([("you idiot", 1), ("good day", 0)])), ("score", "predicted"), None),
    "near copies": (lambda d, b: simhash.drop_near_copies(d), (), 4),
    "substrings": (lambda d, b: substrings.dedup_substrings(d), ("removed_words", "removed_spans"), None),
    "decontamination": (lambda d, b: decontamination.drop_contaminated(d, b), (), 3),
    "sharding": (lambda d, b: sharding.shard_documents(d, 3), ("shard", "slot"), None),
    "licences": (lambda d, b: licenses.scan_documents(d), tuple(f.name for f in licenses.FIELDS), None),
    "quality": (lambda d, b: quality.score_documents(d, quality.train([("you idiot", 0), ("good day", 1)])), ("score", "predicted"), None),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns(spark, wide, name):
    make, added, rows = OPERATORS[name]
    bench = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog, again and again")], "item_id long, text string")
    clean = wide.drop(*added)
    out = make(clean, bench)
    assert out.columns == [*clean.columns, *added]
    got = out.collect()
    assert len(got) == (wide.count() if rows is None else rows)
    left = [n for n in NAMES if n not in added]
    for r in got:
        base = (9 if r.doc_id is None else r.doc_id) * 1000 + r.extra * 100
        assert all(r[n] == base + NAMES.index(n) for n in left) and r.m == {"a": r.extra} and r.xs == [r.extra]
    assert make(clean.limit(0), bench).count() == 0


TABLES = {
    "components": simhash.components_of,
    "packing": lambda d: packing.pack(d, packing.tokenizer_path()).groupBy("doc_id", "start").count(),
    "language model": language_model.score_documents,
    "fingerprints": merkle.fingerprint_documents,
    "flags": lambda d: decontamination.flag_documents(d, d.select(F.col("doc_id").alias("item_id"), "text").limit(0)),
    "shards": sharding.assign_shards,
}


@pytest.mark.parametrize("name", TABLES)
def test_results_of_wide_tables(wide, name):
    out = TABLES[name](wide)
    n = out.count()
    assert n >= (5 if name == "packing" else wide.count())
    assert TABLES[name](wide.limit(0)).count() == 0


def test_sharding_keeps_rows_that_differ_elsewhere(wide):
    got = sharding.shard_documents(wide, 2).collect()
    assert sorted((r.doc_id or 0, r.extra) for r in got) == sorted((r.doc_id or 0, r.extra) for r in wide.collect())
    assert len({(r.shard, r.slot) for r in got}) == len(got)


def test_training_on_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None, 7)], "doc_id long, toxic int, quality int")
    for fit, score in ((toxicity.fit, toxicity.score_documents), (quality.fit, quality.score_documents)):
        rows = score(docs, fit(docs, labels)).collect()
        assert all(0 <= r.score <= 1 for r in rows)
        # a tie at the threshold counts as reached
        threshold = rows[0].score
        assert score(docs, fit(docs.limit(0), labels.limit(0)), threshold).where("doc_id = 1").first().predicted == int(threshold <= 0.5)


def test_sample_passes_over_labels_without_documents(spark):
    from loomgraph.llm.training import labelled_sample

    labels = spark.range(4000).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")
    docs = spark.range(3900, 4000).selectExpr("id as doc_id", "concat('text ', id, repeat(' x', 200000)) as text")
    sample = labelled_sample(docs, labels, "toxic", 20, held_out=F.lit(False))
    assert [y for _, y in sample] == [0] * 20 + [1] * 20 and len({t for t, _ in sample}) == 40
