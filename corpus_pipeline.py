"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination, mixing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before
kept; between stages the documents are written as Parquet and read again. All but the
last return the columns of the documents table. Empty input gives empty output; rows
with nulls, repeated rows and further columns are treated as each operator's
docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factspark.llm.decontaminate import drop_contaminated
from factspark.llm.line_dedup import dedup_lines
from factspark.llm.mixing import mix, quality_weights
from factspark.llm.simhash import keep_one_of_each
from factspark.llm.toxicity import train_on_labels, with_score
from factspark.storage import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones, does not find toxic."""
    model = train_on_labels(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return with_score(docs, model, "_toxicity").filter("_toxicity < 0.5").drop("_toxicity")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that repeat an earlier one or nearly do."""
    kept = dedup_lines(docs).select(docs.columns)
    return kept.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies."""
    return keep_one_of_each(docs)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth repeats benchmark items."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often, or how much of, each remaining document the mix takes."""
    return mix(docs, quality_weights(spark.read.parquet(f"{sf_dir}/labels.parquet")))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_copies),
    ("mixing", mix_sources),
]

#: SQL has neither the classifier, nor MinHash, nor XXH64; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = materialize(docs, f"stage{number}")
    return docs
