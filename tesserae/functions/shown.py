"""How measurements are written for people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.operators.stats import fixed, human_bytes  # noqa: F401


def human_seconds(s: Column) -> Column:
    """1:5 is a minute and five seconds; nothing is padded."""
    text = lambda x: x.cast("bigint").cast("string")
    unit = lambda by, name: F.concat(fixed(s * by), F.lit(f" {name}"))
    seconds = text(F.rint(s % 60))
    clock = F.concat_ws(":", text(F.floor(s / 3600)), text(F.floor(s % 3600 / 60)), seconds)
    short = F.when(s >= 1, unit(1.0, "sec")).when(s >= 1e-3, unit(1e3, "msec")).otherwise(unit(1e6, "usec"))
    return F.when(s == float("inf"), "inf").when(s >= 3600, clock).when(s >= 60, F.concat_ws(":", text(F.floor(s / 60)), seconds)).otherwise(short)


def human_rate(n: Column) -> Column:
    """Operations a second."""
    unit = lambda by, name: F.concat(fixed(n / by), F.lit(f" {name}op/s"))
    return F.when(n >= 1e9, unit(1e9, "G")).when(n >= 1e6, unit(1e6, "M")).when(n >= 1e3, unit(1e3, "K")).otherwise(unit(1.0, ""))


def human_percent(p: Column) -> Column:
    """A share between 0 and 1, with one digit from ten percent on, else two."""
    return F.when(p >= 0.1, F.concat(fixed(p * 100), F.lit("%"))).otherwise(F.concat(fixed(p * 100, 2), F.lit("%")))


def piece_name(tid: Column, oid: Column) -> Column:
    return F.concat_ws("|", tid.cast("string"), oid.cast("string"))


def parse_piece_name(name: Column) -> Column:
    part = F.split(name, r"\|")
    return F.struct(part[0].cast("bigint").alias("tid"), part[1].cast("bigint").alias("oid"))
