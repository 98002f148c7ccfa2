"""Stores that keep whole tables in each version, to compare the version store with.

``copy`` writes every table in full, ``delta`` writes the rows that a table has more
and less than in its first version, ``nothing`` runs the tables and keeps no row. A
name is a folder of its own in every mode, so a load reads only the names it asks for.
A version is there once its commit is; a store opened again on its folder goes on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserae.operators.store import Folder

MODES = ("copy", "delta", "nothing")


class SnapshotStore:
    def __init__(self, spark: SparkSession, path: str, mode: str = "copy", codec: str = "zstd"):
        if mode not in MODES:
            raise ValueError(f"mode is one of {', '.join(MODES)}")
        self.spark, self.path, self.mode, self.codec = spark, path.rstrip("/"), mode, codec
        self._folder = Folder(spark, self.path)
        #: The first version of each name, and the names of each version.
        self._first: dict[str, int] = {}
        self._names: list[set[str]] = []
        for _, commit in sorted(self._folder.commits().items()):
            self._note(set(commit["names"]))

    def _note(self, names: set[str]) -> None:
        self._names.append(names)
        for name in names:
            self._first.setdefault(name, len(self._names))

    def _at(self, tid: int, name: str, part: str = "rows") -> str:
        return f"{self.path}/tid={tid}/{name}/{part}"

    def save(self, tables: dict[str, DataFrame]) -> int:
        """Writes a version, counted from 1."""
        tid = len(self._names) + 1
        for name, df in tables.items():
            if self.mode == "nothing":
                df.write.format("noop").mode("overwrite").save()
            elif self.mode == "copy" or name not in self._first:
                self._put(df, self._at(tid, name))
            else:
                base = self._rows(self._first[name], name)
                if base.schema.simpleString() != df.schema.simpleString():
                    self._put(df, self._at(tid, name))  # other columns: a delta means nothing
                else:
                    self._put(df.exceptAll(base), self._at(tid, name, "more"))
                    self._put(base.exceptAll(df), self._at(tid, name, "less"))
        names = set() if self.mode == "nothing" else set(tables)
        if self.mode != "nothing":
            self._folder.commit(tid, {"tid": tid, "names": sorted(names)})
        self._note(names)
        return tid

    def load(self, tid: int, names: list[str] | None = None) -> dict[str, DataFrame]:
        """The tables of a version by name; names that it lacks are left out."""
        held = self._names[tid - 1]
        return {n: self._rows(tid, n) for n in sorted(held if names is None else held & set(names))}

    def size(self) -> int:
        """Bytes on disk."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        system = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return system.getContentSummary(where).getLength() if system.exists(where) else 0

    def _put(self, df: DataFrame, path: str) -> None:
        df.write.option("compression", self.codec).mode("overwrite").parquet(path)

    def _exists(self, path: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def _rows(self, tid: int, name: str) -> DataFrame:
        if self._exists(self._at(tid, name)):
            return self.spark.read.parquet(self._at(tid, name))
        base = self.spark.read.parquet(self._at(self._first[name], name))
        less, more = (self.spark.read.parquet(self._at(tid, name, p)) for p in ("less", "more"))
        return base.exceptAll(less).unionByName(more)
