"""Sources and sinks besides Parquet: CSV sets, JSON lines, run statistics, text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Statistics of one run, nested as they are recorded.
RUN = (
    "nb string, sut string, dumps array<struct<nth:int,time_s:double,storage_b:bigint>>, loads array<struct<nth:int,tid:int,time_s:double,load_b:bigint>>, "
    "async_dumps array<struct<nth:int,time_s:double,storage_b:bigint>>, exec_times array<double>, lock_times array<double>, join_times array<double>"
)


def read_csvs(spark: SparkSession, paths: list[str] | str, schema: str, sep: str = ",", header: bool = True) -> DataFrame:
    """Files of one schema as one table; the order of rows means nothing."""
    return spark.read.schema(schema).option("sep", sep).option("header", header).csv(paths)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line; a broken line is a row of nulls."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Lines of numbers between blanks -> values; comments begin with '#'."""
    lines = spark.read.text(path).select(F.trim("value").alias("v")).filter("v <> '' and not startswith(v, '#')")
    return lines.select(F.transform(F.split("v", r"\s+"), lambda x: x.cast("double")).alias("values"))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN).json(path)


def flat_loads(runs: DataFrame) -> DataFrame:
    return runs.select("nb", "sut", F.posexplode("loads").alias("position", "x")).select("nb", "sut", "position", "x.*")


def aligned(runs: DataFrame) -> DataFrame:
    """One row a cell: its exec, lock and dump time, and the join time of the cell before."""
    parts = {"exec_s": "exec_times", "lock_s": "lock_times", "dump_s": "dumps.time_s"}
    at = F.arrays_zip(*(F.col(c).alias(n) for n, c in parts.items()), F.concat(F.array(F.lit(0.0)), F.coalesce("join_times", F.array().cast("array<double>"))).alias("join_s"))
    rows = runs.select("nb", "sut", F.posexplode(at).alias("idx", "x")).select("nb", "sut", "idx", "x.*")
    cells = F.size("exec_times")
    return rows.join(runs.select("nb", "sut", cells.alias("n")), ["nb", "sut"]).filter("idx < n").drop("n").na.fill(0.0, ["join_s"])


def write_text_table(df: DataFrame, path: str, sep: str = " ", end: str = "") -> None:
    """Rows as lines, in the order of the frame's partitions; '&' and a double backslash at the end give LaTeX."""
    line = F.concat(F.concat_ws(sep, *(F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in df.columns)), F.lit(end))
    df.select(line.alias("value")).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_nowhere(df: DataFrame) -> None:
    """Runs a frame and keeps nothing."""
    df.write.format("noop").mode("overwrite").save()
