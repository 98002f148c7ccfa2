"""Streams drained to their end, so that a batch query gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.plans.registry import plan
from tesserae.streaming import events as E


@plan("SELECT ts::DATE AS day, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL")
def stream_windowed_counts(t):
    out = E.drain(E.windowed_counts(E.source(t.spark, f"{t.sf_dir}/events.parquet")), "complete")
    return out.select(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_seconds("start") / 86400).cast("int")).alias("day"), "event_type", "n", F.round("total", 3).alias("total"))


@plan("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(t):
    return E.drain(E.first_contents(E.source(t.spark, f"{t.sf_dir}/events.parquet")))
