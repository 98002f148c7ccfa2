"""A store of table versions that writes only content it has not seen.

A version (``tid``) maps names to row groups. A row group is a *piece*: the rows of one
object in canonical order as bytes, named by the version that first held them. A piece
whose bytes were stored before is recorded as a synonym and adds nothing. Names that a
commit does not touch keep the piece they had. Tables: namemap, pieces, synonyms, edges.

A save writes each table under a name of its own attempt and then one commit, which
names the attempt. Only what a commit names is ever read, so a save that fails, at
whatever step, leaves nothing that a later one could take for content; its version is
given again. A commit is created only if its version has none, so of two writers that
take the same version one fails, and may save again.
"""

from __future__ import annotations

import json
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.operators import graph
from tesserae.operators.namespace import Namespace
from tesserae.runtime import cut, discard

#: The name under which ``dump`` stores; versions after it do not carry it on.
OBJECT = "__object__"
SCHEMAS = {
    "commits": "n_names long, n_new long, new_bytes long",
    "namemap": "name string, piece_tid long, piece_id long",
    "pieces": "piece_id long, content_hash string, size_b long, payload string",
    "synonyms": "piece_id long, syn_tid long, syn_id long",
    "edges": "piece_id long, dep_tid long, dep_id long",
}


def bounded_memo(firsts: DataFrame, capacity: int, least_b: int = 0, most_b: int | None = None) -> DataFrame:
    """firsts (tid, oid, content_hash, size_b: the first holder of each content) -> what a memo
    of ``capacity`` entries holds: the earliest contents of ``least_b`` to ``most_b`` bytes."""
    fits = F.col("size_b") >= least_b
    fits = fits if most_b is None else fits & (F.col("size_b") <= most_b)
    return firsts.filter(fits).orderBy("tid", "oid").limit(capacity)


class Folder:
    """Where a store keeps its tables: Parquet in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, codec: str = "zstd"):
        self.spark, self.path, self.codec = spark, path.rstrip("/"), codec

    def _fs(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def write(self, name: str, tid: int, attempt: str, df: DataFrame) -> None:
        df.write.option("compression", self.codec).parquet(f"{self.path}/{name}/tid={tid}/attempt={attempt}")

    def read(self, name: str, schema: T.StructType, at: dict[int, str]) -> DataFrame:
        """The rows of some versions, with ``tid``; only their folders are listed and read."""
        if not at:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.path}/{name}/tid={tid}/attempt={attempt}" for tid, attempt in sorted(at.items())]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(*paths)

    def commit(self, tid: int, row: dict) -> None:
        """Fails if the version is there, whoever wrote it."""
        fs, at = self._fs(f"commits/{tid:019d}.json")
        out = fs.create(at, False)
        out.write(bytearray((json.dumps(row) + "\n").encode()))
        out.close()

    def commits(self) -> dict[int, dict]:
        """tid -> its commit: one small row a version."""
        fs, at = self._fs("commits")
        if not fs.exists(at):
            return {}
        rows = [json.loads(r[0]) for r in self.spark.read.text(str(at.toString())).filter("value <> ''").collect()]
        return {r["tid"]: r for r in rows}


class Memory:
    """As ``Folder``, but lives as long as its process: tables are cut into the shared folder
    under names that only this object knows."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._tables: dict[tuple[str, int, str], DataFrame] = {}
        self._commits: dict[int, dict] = {}

    def write(self, name: str, tid: int, attempt: str, df: DataFrame) -> None:
        self._tables[name, tid, attempt] = cut(df, f"store-{name}")

    def read(self, name: str, schema: T.StructType, at: dict[int, str]) -> DataFrame:
        out = self.spark.createDataFrame([], schema)
        for tid, attempt in sorted(at.items()):
            out = out.unionByName(self._tables[name, tid, attempt].withColumn("tid", F.lit(tid).cast("long")))
        return out

    def commit(self, tid: int, row: dict) -> None:
        if self._commits.setdefault(tid, row) is not row:
            raise ValueError(f"version {tid} is there")

    def commits(self) -> dict[int, dict]:
        return dict(self._commits)


def canonical(df: DataFrame, key: str, name: str) -> DataFrame:
    """Rows -> one row a key: name, piece_id, payload (its rows as JSON in order)."""
    row = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    return df.groupBy(F.col(key).cast("long").alias("piece_id")).agg(F.array_join(F.sort_array(F.collect_list(row)), "\n").alias("payload")).withColumn("name", F.lit(name))


class VersionStore:
    def __init__(self, spark: SparkSession, path: str | Folder | Memory, codec: str = "zstd"):
        self.spark, self.lock = spark, threading.Lock()
        self.tables = Folder(spark, path, codec) if isinstance(path, str) else path
        self.touched: set[str] = set()
        self.tracking = True
        self._running: threading.Thread | None = None
        self._failed: BaseException | None = None

    def read(self, name: str, tids: list[int] | None = None) -> DataFrame:
        """A table of the committed versions, or of some of them."""
        done = self.tables.commits()
        if name == "commits":
            fields = [f.split()[0] for f in SCHEMAS[name].split(", ")] + ["tid"]
            return self.spark.createDataFrame([tuple(c[f] for f in fields) for c in done.values()], SCHEMAS[name] + ", tid long")
        at = {t: c["attempt"] for t, c in done.items() if name in c["tables"] and (tids is None or t in tids)}
        return self.tables.read(name, T._parse_datatype_string(SCHEMAS[name] + ", tid long"), at)

    def _write(self, name: str, tid: int, attempt: str, df: DataFrame) -> None:
        self.tables.write(name, tid, attempt, df)

    def versions(self) -> DataFrame:
        return self.read("commits").select("tid").orderBy("tid")

    def next_tid(self) -> int:
        return max(self.tables.commits(), default=0) + 1

    def save(self, tables: dict[str, tuple[DataFrame, str]], edges: DataFrame | None = None, keep: set[str] | None = None) -> int:
        """Commits ``name -> (rows, key)``; names left out keep their pieces, or only those in
        ``keep``, if it is given. Of the pieces before only hashes are read. Returns tid."""
        with self.lock:
            tid, attempt = self.next_tid(), uuid.uuid4().hex
            parts = [canonical(df, key, name) for name, (df, key) in tables.items()]
            new = parts[0] if parts else self.spark.createDataFrame([], "piece_id long, payload string, name string")
            for part in parts[1:]:
                new = new.unionByName(part)
            # ids are unique in a version: name and key together
            new = cut(new.select("name", F.xxhash64("name", "piece_id").alias("piece_id"), F.sha2("payload", 256).alias("content_hash"), F.octet_length("payload").cast("long").alias("size_b"), "payload"), "store-new")
            try:
                first = new.groupBy("content_hash").agg(F.min("piece_id").alias("first_id"))
                met = self.read("pieces").select("content_hash", F.col("tid").alias("syn_tid"), F.col("piece_id").alias("syn_id")).join(first.select("content_hash"), "content_hash")
                known = met.groupBy("content_hash").agg(F.min_by(F.struct("syn_tid", "syn_id"), "syn_tid").alias("k"))
                judged = cut(new.select("piece_id", "content_hash").join(first, "content_hash").join(known, "content_hash", "left"), "store-judged")
                fresh = judged.filter(F.col("k").isNull() & (F.col("piece_id") == F.col("first_id")))
                old = judged.filter(F.col("k").isNotNull() | (F.col("piece_id") != F.col("first_id")))
                self._write("pieces", tid, attempt, new.join(fresh.select("piece_id"), "piece_id", "left_semi").select("piece_id", "content_hash", "size_b", "payload"))
                self._write("synonyms", tid, attempt, old.select("piece_id", F.coalesce("k.syn_tid", F.lit(tid).cast("long")).alias("syn_tid"), F.coalesce("k.syn_id", "first_id").alias("syn_id")))
                kept = self.namemap(tid - 1).filter(~F.col("name").isin([OBJECT, *tables]))
                kept = kept if keep is None else kept.filter(F.col("name").isin(sorted(keep)))
                names = kept.unionByName(new.select("name", F.lit(tid).cast("long").alias("piece_tid"), "piece_id"))
                self._write("namemap", tid, attempt, names)
                if edges is not None:
                    self._write("edges", tid, attempt, edges.select("piece_id", "dep_tid", "dep_id"))
                stats = new.join(fresh.select("piece_id"), "piece_id", "left_semi").agg(F.count("*").alias("n"), F.coalesce(F.sum("size_b"), F.lit(0)).alias("b")).first()
                written = ["pieces", "synonyms", "namemap"] + ["edges"] * (edges is not None)
                row = {"tid": tid, "attempt": attempt, "tables": written, "n_names": names.select("name").distinct().count(), "n_new": stats["n"], "new_bytes": stats["b"]}
                self.tables.commit(tid, row)
                discard(judged)
            finally:
                discard(new)
            self.touched.clear()
            return tid

    def save_async(self, tables, edges=None, keep=None, undo=lambda: None) -> threading.Thread:
        """Waits for the save before, then saves in a thread, which calls ``undo`` if it
        fails; frames are immutable."""
        self.join()

        def run():
            try:
                self.save(tables, edges, keep)
            except BaseException as e:  # noqa: BLE001 - join() raises it
                self._failed = e
                undo()

        self._running = threading.Thread(target=run)
        self._running.start()
        return self._running

    def join(self) -> None:
        """Waits for the save that runs; raises what made it fail."""
        if self._running is not None:
            self._running.join()
            self._running = None
        if self._failed is not None:
            failed, self._failed = self._failed, None
            raise failed

    def commit(self, names: Namespace, exclude: set[str] = frozenset(), wait: bool = True) -> int:
        """A version of a namespace. Names that are active, new or connected to an active
        one are written, other ones keep their pieces; names that the namespace lacks or
        that ``exclude`` lists are not in the version. Without ``wait`` the plan is made
        now and a thread writes. Returns the version."""
        self.join()
        tid, here = self.next_tid(), set(names) - set(exclude)
        before = {r["name"] for r in self.namemap(tid - 1).select("name").distinct().collect()}  # as many as a namespace has
        write = (names.active & here) | (here - before)
        if write & before:
            write |= {r["name"] for r in self.connected_names(tid - 1, write & before).collect()} & here
        job = names.tables(write), None, here - write
        done = names.active & here
        names.active -= done
        # a save that fails leaves its names active
        self.save_async(*job, undo=lambda: names.active.update(done))
        if wait:
            self.join()
        return tid

    def namemap(self, tid: int) -> DataFrame:
        """name, piece_tid, piece_id of a version."""
        return self.read("namemap", [tid]).select("name", "piece_tid", "piece_id")

    def connected_names(self, tid: int, active: set[str]) -> DataFrame:
        """Names of a version with a piece in one component with a piece of an active name."""
        held = self.namemap(tid).select("name", F.xxhash64("piece_tid", "piece_id").alias("node"))
        edges = self.read("edges").select(F.xxhash64("tid", "piece_id").alias("src"), F.xxhash64("dep_tid", "dep_id").alias("dst"))
        ends = edges.select(F.col("src").alias("node")).union(edges.select("dst"))
        comp = held.join(graph.components(held.select("node").union(ends).distinct(), edges), "node")
        near = comp.filter(F.col("name").isin(sorted(active))).select("comp").distinct()
        return comp.join(near, "comp", "left_semi").select("name").distinct()

    def _held(self, wanted: DataFrame) -> DataFrame:
        """version, name, piece_tid, piece_id -> version, name, piece_id, payload."""
        tids = lambda df, c: [r[0] for r in df.select(c).distinct().collect()]  # noqa: E731 - one row a version
        syn = self.read("synonyms", tids(wanted, "piece_tid")).withColumnRenamed("tid", "piece_tid")
        at = wanted.join(syn, ["piece_tid", "piece_id"], "left").select("version", "name", "piece_id", F.coalesce("syn_tid", "piece_tid").alias("tid"), F.coalesce("syn_id", "piece_id").alias("__p"))
        held = self.read("pieces", tids(at, "tid")).select("tid", F.col("piece_id").alias("__p"), "payload")
        return at.join(held, ["tid", "__p"]).select("version", "name", "piece_id", "payload")

    def load(self, tid: int, names: list[str] | None = None) -> DataFrame:
        """name, piece_id, payload of a version; names that it lacks are left out."""
        wanted = self.namemap(tid).withColumn("version", F.lit(tid).cast("long"))
        return self._held(wanted if names is None else wanted.filter(F.col("name").isin(names))).drop("version")

    def load_many(self, wanted: dict[int, list[str] | None]) -> DataFrame:
        """version, name, piece_id, payload of several versions in one read; None: all names."""
        pick = F.lit(False)
        for tid, names in wanted.items():
            pick = pick | ((F.col("tid") == tid) & (F.lit(True) if names is None else F.col("name").isin(names)))
        held = self.read("namemap", list(wanted)).filter(pick)
        return self._held(held.select(F.col("tid").alias("version"), "name", "piece_tid", "piece_id"))

    def dump(self, df: DataFrame, key: str) -> int:
        """Stores one table as a version of its own beside the names; returns the version."""
        return self.save({OBJECT: (df, key)})

    def load_dump(self, tid: int, schema: str) -> DataFrame:
        return self.rows(tid, OBJECT, schema)

    def rows(self, tid: int, name: str, schema: str) -> DataFrame:
        """The rows of one name of a version, parsed."""
        lines = self.load(tid, [name]).select(F.explode(F.split("payload", "\n")).alias("j"))
        return lines.select(F.from_json("j", schema).alias("r")).select("r.*")

    def size(self) -> int:
        return self.read("pieces").agg(F.sum("size_b")).first()[0] or 0

    def touch(self, name: str) -> None:
        if self.tracking:
            self.touched.add(name)
