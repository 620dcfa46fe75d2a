"""A document pipeline of five stages, each built on one operator of heightfield.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from heightfield.llm import common as C
from heightfield.llm import decontaminate, langid, minhash, packing, secrets
from heightfield.llm.suite import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language stay; references are learned from the stage's own labelled rows outside the held-out third."""
    refs = langid.references(docs.filter(C.crc_mod("doc_id", 3) != 1))
    return langid.accepted(docs, refs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates stays."""
    return minhash.kept(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, C.table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; the secrets in them are masked."""
    return secrets.redacted(docs, secrets.learn(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in sequences of at most 4096 tokens, one row per piece."""
    return packing.packed(docs, tokenizer_path())


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secret_scan", secret_scan),
          ("best_fit_packing", best_fit_packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = C.stored(docs, f"stage-{name}")
    return docs
