"""What a run measures of itself: appended by the driver, one record a call, written as one
line of JSON in the schema of ``files.RUN``."""

from __future__ import annotations

import json
import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.functions.shown import human_bytes, human_rate, human_seconds
from tesserae.sources.files import RUN


class RunLog:
    """Times of saves, loads, cells, locks and joins, with their running sums."""

    def __init__(self, nb: str, sut: str):
        self.record: dict = {"nb": nb, "sut": sut, "dumps": [], "loads": [], "async_dumps": [], "exec_times": [], "lock_times": [], "join_times": []}
        self.sums = {"dumps": 0.0, "loads": 0.0, "async_dumps": 0.0}

    def add_dump(self, nth: int, time_s: float, storage_b: int) -> None:
        self._add("dumps", nth=nth, time_s=time_s, storage_b=storage_b)

    def add_load(self, nth: int, tid: int, time_s: float, load_b: int | None) -> None:
        self._add("loads", nth=nth, tid=tid, time_s=time_s, load_b=load_b)

    def add_async_dump(self, nth: int, time_s: float, storage_b: int) -> None:
        self._add("async_dumps", nth=nth, time_s=time_s, storage_b=storage_b)

    def _add(self, kind: str, **row) -> None:
        self.record[kind].append(row)
        self.sums[kind] += row["time_s"]

    def add_time(self, kind: str, time_s: float) -> None:
        """kind: exec, lock or join."""
        self.record[f"{kind}_times"].append(time_s)

    @contextmanager
    def timed(self, kind: str):
        """Adds how long a block takes, also if it fails."""
        began = time.perf_counter()
        try:
            yield
        finally:
            self.add_time(kind, time.perf_counter() - began)

    def instrument(self, store):
        """A store's save and load add their times from now on."""
        save, load = store.save, store.load

        def timed_save(*args, **more):
            began = time.perf_counter()
            tid = save(*args, **more)
            self.add_dump(len(self.record["dumps"]) + 1, time.perf_counter() - began, store.size())
            return tid

        def timed_load(tid, *args, **more):
            began = time.perf_counter()
            out = load(tid, *args, **more)
            self.add_load(len(self.record["loads"]) + 1, tid, time.perf_counter() - began, None)
            return out

        store.save, store.load = timed_save, timed_load
        return store

    def write(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(self.record),)], "value string").coalesce(1).write.mode("append").text(path)


def running_averages(runs: DataFrame) -> DataFrame:
    """``files.RUN`` -> nb, sut, nth, running sum and mean of the save times, and how they are
    shown: each run's arrays are its own, so nothing shuffles but the window by run."""
    rows = runs.select("nb", "sut", F.posexplode("dumps").alias("at", "d")).select("nb", "sut", (F.col("at") + 1).alias("nth"), "d.time_s", "d.storage_b")
    w = Window.partitionBy("nb", "sut").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("sum_s", F.sum("time_s").over(w)).withColumn("avg_s", F.col("sum_s") / F.col("nth"))
    return out.select("nb", "sut", "nth", "sum_s", "avg_s", human_seconds(F.col("avg_s")).alias("shown_avg"), human_rate(1 / F.col("avg_s")).alias("shown_rate"), human_bytes(F.col("storage_b").cast("double")).alias("shown_size"))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN).json(path)
