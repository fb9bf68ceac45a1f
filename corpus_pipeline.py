"""A training corpus from documents, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. The first four return the columns of
documents; the last returns packed pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

Defined cases: rows are judged and removed one by one, by a key over their values, so rows with a null doc_id, or that repeat one
with other texts, go or stay like any others. A null or empty text has no letters and goes in the first stage. Of equal rows
one stays, as of near copies. Without labels of both classes the second stage keeps all; without benchmark items the fourth does.
An empty table gives an empty result. Further columns of docs, whatever their names, are kept by the first four stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronopix.llm import decontaminate, jaccard, language, packing, quality
from chronopix.llm.common import release, save, table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language the fused evidence settles; without any declared language none is."""
    return language.keep_identified(docs, language.identify(docs))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the classifier predicts to be good."""
    return quality.keep_good(docs, save(quality.score_documents(docs, table(spark, sf_dir, "labels")), "pipeline-quality"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near copies; a null one only if there is no other."""
    return jaccard.keep_one(docs, save(jaccard.similar_components(docs), "pipeline-components"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that hold no benchmark item."""
    return decontaminate.drop_leaks(docs, decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the documents' ids into pieces and packs them into sequences."""
    packed = packing.pack_documents(docs, with_ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language", language_stage),
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, save(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(before)
    return docs
