"""Pages: small pieces stored together, found by an index.

A page is a partition folder. Pieces of more than ``SMALL`` bytes have pages of their own,
numbered after those of the small ones, so that a lookup of small pieces opens few files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SMALL, PAGE = 1024, 1_000_000


def write_pages(pieces: DataFrame, path: str, small: int = SMALL, page: int = PAGE) -> None:
    """pieces (piece_id, size_b, payload) -> ``path``/pages by page, and ``path``/index. A
    piece's page is its hash over as many pages as its kind of pieces fills, so no order of
    all pieces is needed."""
    kind = F.col("size_b") > small
    sizes = {r["big"]: r["b"] for r in pieces.groupBy(kind.alias("big")).agg(F.sum("size_b").alias("b")).collect()}  # two rows
    n_small, n_big = (-(-(sizes.get(big) or 0) // page) or 1 for big in (False, True))
    at = F.when(kind, F.lit(n_small) + F.pmod(F.xxhash64("piece_id"), F.lit(n_big))).otherwise(F.pmod(F.xxhash64("piece_id"), F.lit(n_small)))
    placed = pieces.withColumn("page", at.cast("long"))
    placed.repartition("page").write.partitionBy("page").parquet(f"{path}/pages")
    placed.select("piece_id", "page", "size_b").write.parquet(f"{path}/index")


def lookup(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """wanted (piece_id) -> piece_id, page, payload of those that are there. The index tells
    the pages; the join on the partition column lets Spark read only these."""
    index = spark.read.parquet(f"{path}/index").join(wanted.select("piece_id").distinct(), "piece_id").select("piece_id", "page")
    return spark.read.parquet(f"{path}/pages").select("piece_id", "page", "payload").join(index, ["page", "piece_id"]).select("piece_id", "page", "payload")
