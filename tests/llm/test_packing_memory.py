"""What a task of the packing stage holds at once."""

import pyarrow as pa

import corpus_pipeline
from loomgraph.llm import packing


def test_runs_of_texts_are_bounded():
    texts = pa.array(["x" * 900] * 20 + ["y" * 5000] + [""] * 5 + ["z"] * 3)
    runs = list(packing.slices(texts, 1000))
    assert [n for _, n in runs[:10]] == [2] * 10 and sum(n for _, n in runs) == len(texts)
    assert all(texts.slice(at, n).nbytes <= 2000 + 8 * n or n == 1 for at, n in runs)


def test_the_pipeline_takes_less_at_once(spark, odd, monkeypatch):
    """Same pieces as with op5's size; the pipeline's stage hands a worker at most a megabyte of texts together."""
    whole = packing.digest(packing.pack(odd, packing.tokenizer_path())).drop("sequence_id")
    small = packing.digest(packing.pack(odd, packing.tokenizer_path(), at_once=1 << 16)).drop("sequence_id")
    assert sorted(whole.collect(), key=repr) == sorted(small.collect(), key=repr)
    asked = {}
    monkeypatch.setattr(packing, "pack", lambda docs, path, **more: asked.update(more))
    corpus_pipeline.pack(spark, odd, "")
    assert 2 * asked["at_once"] <= 1 << 20
