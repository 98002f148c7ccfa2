"""Which contents change from dump to dump, counted only while tracking is on."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.runtime import cut


class ChangeTracker:
    """``with tracker.on(): tracker.dump(pieces)`` counts; dumps outside do nothing. Leaving
    the scope forgets what was counted unless it is told to keep it."""

    def __init__(self):
        self.is_on, self._dumps, self._next = False, [], 1

    @contextmanager
    def on(self, keep: bool = True):
        if self.is_on:
            raise ValueError("tracking is on already")
        self.is_on = True
        try:
            yield self
        finally:
            self.is_on = False
            if not keep:
                self._dumps, self._next = [], 1

    def dump(self, pieces: DataFrame) -> None:
        """pieces: oid, content_hash of one version."""
        if self.is_on:
            self._dumps.append(cut(pieces.select("oid", "content_hash", F.lit(self._next).cast("long").alias("nth")), "tracked"))
            self._next += 1

    def counts(self) -> DataFrame:
        """oid, seen, changed: how many dumps had it, and in how many its content was new to
        all of them."""
        if not self._dumps:
            raise ValueError("nothing was tracked")
        every = self._dumps[0]
        for more in self._dumps[1:]:
            every = every.unionByName(more)
        first = every.groupBy("content_hash").agg(F.min("nth").alias("first"))
        return every.join(first, "content_hash").groupBy("oid").agg(F.count("*").alias("seen"), F.count_if(F.col("nth") == F.col("first")).alias("changed"))

    def probabilities(self) -> DataFrame:
        return self.counts().withColumn("p", F.col("changed") / F.col("seen"))


def history(versions: DataFrame) -> DataFrame:
    """oid, content_hash, nth of many dumps at once -> the same with changed, seen so far."""
    first = versions.groupBy("content_hash").agg(F.min("nth").alias("first"))
    w = Window.partitionBy("oid").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    return versions.join(first, "content_hash").withColumn("changed", F.col("nth") == F.col("first")).drop("first").withColumn("seen", F.count("*").over(w))
