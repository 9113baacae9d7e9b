"""From raw documents to packed training sequences: five stages, each written as Parquet and read by the next.

1. ``quality_classifier``: rows that the ordinal model does not grade as good go; harmful and poor texts among them.
2. ``exact_dedup``: of equal texts (white space aside) the row with the smallest id stays.
3. ``ngram_jaccard``: of each group of texts linked by 5-word shingles with a similarity of 0.8 or more, one stays.
4. ``decontamination``: rows that hold an item of the benchmark go.
5. ``best_fit_packing``: the place of every piece of every row in a sequence.

Stages 1 to 4 return the columns of their input. Nulls, empty texts, repeated rows and empty tables are handled as each operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.llm import decontaminate, digest_index, jaccard_join, ordinal, packing
from tabsmith.llm.common import scratch_path

SHINGLE_WORDS = 5
SIMILAR_PERCENT = 80
GOOD = 0.5


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    grades = labels.select("doc_id", ordinal.rating(F.col("quality"), F.col("toxic")).alias("grade"))
    return ordinal.select_good(docs, ordinal.fit(docs, grades), GOOD)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return digest_index.keep_first(docs, digest_index.DigestIndex(spark, scratch_path(spark, "digest-index")))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs, SHINGLE_WORDS, SIMILAR_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can express neither the classifier nor the latent search.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
