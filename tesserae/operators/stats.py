"""Statistics with the conventions of dataframe libraries, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def box_plot(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Quartiles by linear interpolation; whiskers at the last datum within 1.5 times the
    distance of the quartiles."""
    q = df.groupBy(*by).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.max(value).alias("highest"))
    q = q.select(*by, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "highest")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    joined = df.join(q, by)
    inside = F.when(F.col(value).between(F.col("q1") - reach, F.col("q3") + reach), F.col(value))
    return joined.groupBy(*by, "q1", "median", "q3", "highest").agg(F.min(inside).alias("whisker_low"), F.max(inside).alias("whisker_high"))


def ecdf(df: DataFrame, by: list[str], value: str, tie: str) -> DataFrame:
    """Each row's share in percent of the rows up to it; ties keep steps of their own."""
    w = Window.partitionBy(*by)
    rank = F.row_number().over(w.orderBy(value, tie))
    return df.withColumn("percent", rank / F.count(F.lit(1)).over(w) * 100)


def fixed(x: Column, digits: int = 1) -> Column:
    """``x`` with one or two digits, as C's printf writes it: what is rounded, half to even, is
    the binary number itself, not its shortest decimal form as in ``format_string``. From 1 up
    in whole numbers: the fraction is a multiple of 2^-52."""
    v, ten = F.abs(x), 10**digits
    whole = F.floor(v)
    part = ((v - whole) * 2.0**52).cast("bigint") * ten
    cut, rest = F.shiftright(part, 52), part.bitwiseAND(F.lit(2**52 - 1))
    cut = cut + ((rest > 2**51) | ((rest == 2**51) & (cut % 2 == 1))).cast("bigint")
    text = F.concat((whole + (cut == ten).cast("bigint")).cast("string"), F.lit("."), F.lpad((cut % ten).cast("string"), digits, "0"))
    small = F.format_number(v, digits)
    sign = F.when(x < 0, "-").otherwise("")
    return F.when(v < 1, F.concat(sign, small)).when(v < 2.0**63, F.concat(sign, text)).when(x.isNotNull(), F.format_string(f"%.{digits}f", x))


def human_bytes(b: Column) -> Column:
    unit = lambda n, name: F.concat(fixed(b / n), F.lit(f" {name}"))
    return F.when(b >= 1e9, unit(1e9, "GB")).when(b >= 1e6, unit(1e6, "MB")).when(b >= 1e3, unit(1e3, "KB")).otherwise(unit(1.0, " B"))


def skew_unbiased(x: str) -> Column:
    n = F.count(x)
    return F.skewness(x) * F.sqrt(n * (n - 1.0)) / (n - 2.0)


def kurtosis_unbiased(x: str) -> Column:
    n = F.count(x)
    return (n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1.0) * F.kurtosis(x) + 6.0)


def histogram(value: Column, bins: int, low: float, high: float) -> Column:
    """The number of the equal bin of a value; the last bin is closed."""
    return F.least(F.floor((value - low) / (high - low) * bins), F.lit(bins - 1)).cast("bigint")


def hash_split(key: Column, percent: int) -> Column:
    """Whether a key belongs to the test part, by its hash; the same on every run."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 4), 16, 10).cast("int") % 100 < percent
