"""A corpus pipeline of the training-data operators: filter, deduplicate twice, mix, pack.

Every stage takes (spark, docs, sf_dir) and all that its predecessor kept. All but the last return the columns of
``documents``: rejected documents and all but one of near-duplicates are gone, repeated passages are cut out of the
texts (``n_chars`` follows), and the mix repeats or leaves out documents. The last returns the pieces of sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orrery.llm.common import discard, recorded, stored, table
from orrery.llm.exact_substr import remove_repeats
from orrery.llm.mixing import mix_documents
from orrery.llm.neardup import near_duplicate_filter
from orrery.llm.packing import pack
from orrery.llm.quality_rules import quality_filter


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_filter(spark, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicate_filter(spark, docs)


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove_repeats(spark, docs).selectExpr("doc_id", "text", "lang", "source", "cast(length(text) AS long) AS n_chars")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_documents(spark, docs).selectExpr("doc_id", "text", "lang", "source", "cast(length(text) AS long) AS n_chars")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(spark, docs)


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_duplicates),
    ("repeated substrings", repeated_substrings),
    ("mixing", mixing),
    ("packing", packing),
]
#: SQL can't express signatures' stages, keyed sampling and packing; tests/llm/test_pipeline.py has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's output is stored; what it was made from is deleted then, so that the disk holds one stage at a time."""
    docs, before = table(spark, sf_dir, "documents"), []
    for i, (_, stage) in enumerate(STAGES):
        last = i + 1 == len(STAGES)
        with recorded() as made:
            docs = stage(spark, docs, sf_dir)
            if not last:
                docs = stored(docs, spark)
        if not last:
            discard(spark, [*before, *made[:-1]])
            before = made[-1:]
    return docs
