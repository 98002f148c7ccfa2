"""Window recipes that follow the habits of dataframe libraries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tesserae.runtime import cut


def rolling(value: str, by: list[str], order: list[str], width: int, how=F.avg, least: int | None = None) -> Column:
    """A statistic of the last ``width`` rows; null while fewer than ``least`` have a value."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(1 - width, 0)
    return F.when(F.count(value).over(w) >= (width if least is None else least), how(value).over(w))


def expanding(value: str, by: list[str], order: list[str], how=F.avg, least: int = 1) -> Column:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return F.when(F.count(value).over(w) >= least, how(value).over(w))


def forward_fill(value: str, by: list[str], order: list[str]) -> Column:
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def back_fill(value: str, by: list[str], order: list[str]) -> Column:
    return F.first(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(0, Window.unboundedFollowing))


def interpolate(df: DataFrame, by: list[str], order: str, value: str) -> Column:
    """Linear between the nearest values by rows; the ends stay as they are."""
    w = Window.partitionBy(*by).orderBy(order)
    at = F.row_number().over(w)
    known = F.when(F.col(value).isNotNull(), F.struct(F.lit(0).alias("z"), F.col(value).alias("v"), F.col("__at").alias("i")))
    df = df.withColumn("__at", at)
    past, future = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    df = df.withColumn("__p", F.last(known, ignorenulls=True).over(past)).withColumn("__n", F.first(known, ignorenulls=True).over(future))
    step = F.col("__p.v") + (F.col("__n.v") - F.col("__p.v")) * (F.col("__at") - F.col("__p.i")) / (F.col("__n.i") - F.col("__p.i"))
    filled = F.coalesce(F.col(value), step)
    return df.withColumn(f"{value}_filled", filled).drop("__at", "__p", "__n")


def ewm_mean(df: DataFrame, by: list[str], order: str, value: str, span: float) -> DataFrame:
    """Exponentially weighted mean with adjusted weights: one row a group and row, by a fold
    over the group's rows in order, so a group is bounded by what one row can hold."""
    keep = 1 - 2 / (span + 1)
    state = "struct<n:double,d:double,out:array<struct<o:bigint,ewm:double>>>"
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("d"), F.array().alias("out")).cast(state)

    def step(a, x):
        n, d = a["n"] * keep + x["v"], a["d"] * keep + 1.0
        return F.struct(n.alias("n"), d.alias("d"), F.array_append(a["out"], F.struct(x["o"].alias("o"), (n / d).alias("ewm"))).alias("out"))

    rows = F.array_sort(F.collect_list(F.struct(F.col(order).cast("bigint").alias("o"), F.col(value).cast("double").alias("v"))))
    return df.groupBy(*by).agg(rows.alias("r")).select(*by, F.inline(F.aggregate("r", zero, step, lambda a: a["out"])))


def as_of_join(left: DataFrame, right: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """Each left row with the last right value at or before it: a union, then a window, so
    no pair of rows is ever made."""
    a = left.withColumn("__side", F.lit(1)).withColumn("__v", F.lit(None).cast(right.schema[value].dataType))
    b = right.select(*by, at, F.lit(0).alias("__side"), F.col(value).alias("__v"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("__v", ignorenulls=True).over(w)).filter("__side = 1").drop("__side", "__v")


def range_join(left: DataFrame, right: DataFrame, point: str, low: str, high: str, width: int) -> DataFrame:
    """Rows of ``left`` inside the closed ranges of ``right``, met in bins of ``width`` so
    that the join has an equality; a range stands in every bin it touches."""
    a = left.withColumn("__bin", F.floor(F.col(point) / width))
    b = right.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return a.join(b, "__bin").filter(F.col(point).between(F.col(low), F.col(high))).drop("__bin")


def at_positions(df: DataFrame, order: list[str], first: int, last: int) -> DataFrame:
    """The rows at positions ``first`` to ``last`` (from 1) of a total order. Positions are
    found by counts of sorted partitions: only counts, one a partition, go to the driver, and
    no task gets more than its part of the order."""
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order)
    counted = cut(spread.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1)) + 1), "positions")
    sizes = {r["__part"]: r["n"] for r in counted.groupBy("__part").agg(F.count("*").alias("n")).collect()}
    wanted, before = F.lit(False), 0
    for part in sorted(sizes):
        if before + sizes[part] >= first and before < last:
            wanted = wanted | ((F.col("__part") == part) & F.col("__at").between(first - before, last - before))
        before += sizes[part]
    return counted.filter(wanted).drop("__part", "__at")


def _by_ranges(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``df`` dealt and sorted by ranges of group and order (nulls last), with the range's
    number and the place in it."""
    keys = [F.col(c).asc_nulls_last() for c in (*by, *order)]
    spread = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return spread.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1)))


def _earlier(ranged: DataFrame, by: list[str], value: Column) -> tuple[DataFrame, Column]:
    """One row a range and group with ``__before``, the sum of ``value`` in earlier ranges of the
    group, and ``__first``, the group's first place in the range; how to join it."""
    past = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("__part", *by).agg(F.sum(value).alias("__n"), F.min("__at").alias("__first"))
    parts = parts.select(F.col("__part").alias("__p"), *[F.col(c).alias(f"__{c}") for c in by], "__first", F.coalesce(F.sum("__n").over(past), F.lit(0)).alias("__before"))
    on = F.col("__part") == F.col("__p")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return parts, on


def places(df: DataFrame, by: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """The columns ``keep`` (with ``by``) of ``df``, with ``before``: how many rows of its group come before a row in the order. For few
    large groups: rows are dealt by ranges of the order and counted where they lie, one row a
    range and group is added up apart, so no task gets more than its range."""
    ranged = cut(_by_ranges(df, by, order).select(*keep, "__part", "__at"), "places")
    parts, on = _earlier(ranged, by, F.lit(1))
    return ranged.join(F.broadcast(parts), on).select(*keep, (F.col("__before") + F.col("__at") - F.col("__first")).alias("before"))


def running_sums(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """``df`` with ``before``: the sum of ``value`` over the rows of its group that come before a
    row in the order, as ``places``."""
    ranged = cut(_by_ranges(df, by, order), "running")
    parts, on = _earlier(ranged, by, F.col(value))
    inside = Window.partitionBy("__part", *by).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return sums.join(F.broadcast(parts), on).select(*df.columns, (F.col("__before") + F.col("__inside")).alias("before"))


def apply_to_groups(df: DataFrame, by: str, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``f`` over frames of many whole groups. Rows are dealt and sorted by the key; a group that
    may go on in the next Arrow batch waits for it, so a task holds one batch and one group.
    Whole numbers come as Int64, so that nulls among them cost no digits."""
    out = StructType.fromDDL(schema)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pd.DataFrame] = []
        done = lambda frames: pa.RecordBatch.from_pandas(f(pd.concat(frames, ignore_index=True)), arrow, preserve_index=False)
        for batch in batches:
            if not batch.num_rows:
                continue
            pdf = batch.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
            last = pdf[by].iloc[-1]
            same = pdf[by].isna() if pd.isna(last) else (pdf[by] == last).fillna(False)
            first = len(pdf) - int(same.sum())  # where the last group begins
            if first:
                yield done([*held, pdf[:first]])
                held = []
            held.append(pdf[first:])
        if held:
            yield done(held)

    return df.repartition(by).sortWithinPartitions(by).mapInArrow(run, out)


def sums_above(df: DataFrame, at: str, values: list[str]) -> DataFrame:
    """``df`` (one row for each ``at``) with ``<value>_above``: each sum over the rows with a larger ``at``. Rows are dealt
    by ranges of ``at``; the sums of whole ranges, one row each, are added to running sums
    inside a range, so no task sees more than its range."""
    ranged = cut(df.repartitionByRange(at).withColumn("__part", F.spark_partition_id()), "ranges")
    parts = ranged.groupBy("__part").agg(*[F.sum(v).alias(v) for v in values])  # one row a range
    after = Window.orderBy(F.desc("__part")).rowsBetween(Window.unboundedPreceding, -1)
    later = parts.select("__part", *[F.coalesce(F.sum(v).over(after), F.lit(0)).alias(f"__{v}") for v in values])
    inside = Window.partitionBy("__part").orderBy(F.desc(at)).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(later), "__part")
    return out.withColumns({f"{v}_above": F.col(f"__{v}") + F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values}).drop("__part", *[f"__{v}" for v in values])
