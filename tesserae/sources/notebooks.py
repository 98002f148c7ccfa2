"""Code cells of notebooks and scripts as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A cell's source is one string or a list of lines.
CELLS = "cells array<struct<cell_type:string,source:variant>>"


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def read_notebooks(spark: SparkSession, path: str) -> DataFrame:
    """path, cell (from 0 among the code cells), source. Files that are no notebook have no cell."""
    cells = F.filter(F.from_json("value", CELLS)["cells"], lambda c: c["cell_type"] == "code")
    rows = _whole(spark, path).select("path", F.posexplode(cells).alias("cell", "c"))
    lines, text = (F.try_variant_get("c.source", "$", kind) for kind in ("array<string>", "string"))
    return rows.select("path", "cell", F.coalesce(F.array_join(lines, ""), text, F.lit("")).alias("source"))


def read_scripts(spark: SparkSession, path: str) -> DataFrame:
    """path, cell, source: a script is a single cell."""
    return _whole(spark, path).select("path", F.lit(0).alias("cell"), F.col("value").alias("source"))
