"""Five stages from raw documents to a training mixture, each a step of tesserae.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the
rows are written as Parquet and read again. All but the last return the columns of
documents. Rows keep their order of nothing: stages are functions of the set of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm import decontaminate, jaccard_join, line_dedup, mixing, quality_model
from tesserae.runtime import cut

#: A document is rejected if its calibrated probability of quality is below this.
LEAST_QUALITY = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the quality classifier rejects. Its words come from ``docs``, its labels
    from the labels table, only the part that its query learns from. An empty text has
    the score of no words."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~quality_model.held_out(3, 1)).select("doc_id", "quality")
    model = quality_model.fit(docs.select("doc_id", "text"), labels)
    return quality_model.with_score(docs, model, score="__score").filter(f"__score >= {LEAST_QUALITY}").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that repeat an earlier line; a document that loses all of them goes."""
    return line_dedup.dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least doc_id of each class of the n-gram Jaccard join."""
    return jaccard_join.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontaminate.remove_documents(docs, items)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What each leaf of domain, language and source contributes, by epoch."""
    return mixing.mix(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("mixture", mixture)]

#: A fitted classifier decides what the first stage keeps; SQL cannot express it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
