"""Corpus pipeline: five stages over ``documents``, each written and read again by the caller.

1. toxicity: documents scored toxic go;
2. near copies: of each group of near copies (five-word shingles, similarity of
   0.8 or more) one document stays;
3. substring dedup: passages that an earlier document holds are cut;
4. decontamination: documents that hold benchmark passages go;
5. packing: the rest as token pieces of power-of-two lengths.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import decontamination, packing, simhash, substrings, toxicity
from loomgraph.llm.common import hand_back, shared_dir, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled rows outside the held-out third; keeps rows below the threshold."""
    model = toxicity.fit(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    hand_back()  # what training held stays in the driver else
    # columns of the input by the names of the model's are put aside
    own = {c: f"__own_{c}" for c in docs.columns if c in ("score", "predicted")}
    scored = toxicity.score_documents(docs.withColumnsRenamed(own), model)
    kept = scored.where("predicted = 0").drop("score", "predicted")
    return kept.withColumnsRenamed({v: k for k, v in own.items()}).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_copies(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(docs).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # the workers of the stages before wait beside those that pack, so these take less at once
    return packing.pack(docs, packing.tokenizer_path(), at_once=packing.SLICE // 8)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL can't express the model, the components or the tokenizer; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on ``documents``; what is between them is written to the shared folder."""
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{base}/{k}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
