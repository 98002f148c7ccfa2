"""Versions of tables that change at a known rate, for tests and measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def mutating_lists(spark: SparkSession, versions: int, names: int, length: int, share_names: float, share_items: float, seed: int = 73) -> DataFrame:
    """version, name, idx, value. In each version after the first a share of the names has a
    share of its items changed; a value is a hash of the item and its last change."""
    draw = lambda *cols: F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1_000_000)) / 1_000_000
    items = spark.range(names * length).select(F.concat(F.lit("l_"), F.floor(F.col("id") / length)).alias("name"), (F.col("id") % length).alias("idx"))
    rows = items.withColumn("version", F.explode(F.sequence(F.lit(1), F.lit(versions))))
    change = (F.col("version") > 1) & (draw("version", "name") < share_names) & (draw("version", "name", "idx") < share_items)
    from pyspark.sql import Window

    last = F.max(F.when(change, F.col("version")).otherwise(1)).over(Window.partitionBy("name", "idx").orderBy("version").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("last", last).select("version", "name", "idx", F.sha2(F.concat_ws(":", F.lit(seed), "name", "idx", "last"), 256).alias("value"))


def mutating_trees(spark: SparkSession, versions: int, lists: int, elements: int, share_lists: float = 0.1, share_items: float = 0.1, element_b: int = 100, seed: int = 73) -> DataFrame:
    """version, name, idx, value: ``lists`` lists of ``elements`` values of ``element_b`` bytes.
    In each version after the first exactly a share of the lists, and of the items of each of
    them, is drawn anew, as sampling without replacement would."""
    from pyspark.sql import Window

    draw = lambda *cols: F.xxhash64(F.lit(seed), *cols)
    top = lambda by, order, n: F.row_number().over(Window.partitionBy(*by).orderBy(order)) <= n
    each = spark.range(lists).select(F.col("id").alias("l")).withColumn("version", F.explode(F.sequence(F.lit(2), F.lit(versions)))) if versions > 1 else None
    items = spark.range(lists * elements).select(F.floor(F.col("id") / elements).alias("l"), (F.col("id") % elements).alias("idx"))
    rows = items.withColumn("version", F.explode(F.sequence(F.lit(1), F.lit(versions))))
    last = F.lit(1)
    if each is not None:
        picked = each.withColumn("p", top(["version"], draw("version", "l"), int(lists * share_lists))).filter("p").drop("p")
        changed = picked.withColumn("idx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(elements - 1).cast("long"))))
        changed = changed.withColumn("p", top(["version", "l"], draw("version", "l", "idx"), int(elements * share_items))).filter("p").withColumnRenamed("p", "new")
        rows = rows.join(changed, ["version", "l", "idx"], "left")
        last = F.max(F.when(F.col("new"), F.col("version")).otherwise(1)).over(Window.partitionBy("l", "idx").orderBy("version").rowsBetween(Window.unboundedPreceding, 0))
    body = lambda: F.substring(F.repeat(F.sha2(F.concat_ws(":", F.lit(seed), "l", "idx", "last"), 256), -(-element_b // 64)), 1, element_b)
    return rows.withColumn("last", last).select("version", F.concat(F.lit("l_"), "l").alias("name"), "idx", body().alias("value"))
