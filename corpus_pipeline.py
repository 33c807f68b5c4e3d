"""The corpus pipeline: from raw documents to token-budget batches, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns a
DataFrame that is written as Parquet and read again. All but the last return the columns of
``documents``.

1. language: documents without letters, or less like any learned language than texts of their
   length are, go, those too short to judge stay; a null ``lang`` is filled with the prediction.
2. near_duplicates: one document of each group of near copies stays.
3. personal_data: personal data in the texts is masked.
4. mixture: documents are sampled to raked source, language and topic weights.
5. packing: texts are cut into sequences and dealt to buckets and batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm import langid, mixing, ngram_join, packing, pii
from loomspan.llm.common import table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = langid.identify_fitting(docs, keep=tuple(docs.columns))
    kept = judged.where((F.col("lang_pred") != langid.UNKNOWN) & F.col("fits"))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.drop_near_copies(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask_pii(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("packing", pack),
]

#: SQL has no form of the language profiles, the field or the near-duplicate groups.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
