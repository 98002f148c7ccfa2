"""Session helpers: reading tables, and cutting lineage through the shared folder.

Anything that must outlive one job goes to the folder the cluster names in
``spark.checkpoint.dir``; machine-local folders are never used, because an
executor does not see another one's disk.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Paths that this process has written and not yet deleted.
_written: list[str] = []
#: Rows and bytes of one Arrow batch handed to Python. Texts are long, so batches are short.
ARROW_ROWS, ARROW_BYTES = 500, 64 << 20


def session(app: str = "tesserae", cpus: str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read only by Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches so that long texts fit a Python worker. The settings stay in the
    session: plans are lazy and read them only when they run."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; one is set only where a local session has none. On a
    cluster it must be named: no folder of one machine would do."""
    sc = spark.sparkContext
    if found := sc.getConf().get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir("/tmp/checkpoints/tesserae")
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def cut(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lineage cut that survives
    the loss of any executor and keeps columnar reads."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tesserae_path = path  # for discard()
    _written.append(path)
    return out


def cut_any(df: DataFrame, label: str, which: Column | None = None) -> tuple[DataFrame, bool]:
    """As ``cut``, and whether any row was written (any for which ``which`` is true). Found in
    what was written, up to the first such row: an observation would stay in the session,
    and fitted models could no more be sent to executors from it."""
    out = cut(df, label)
    return out, not (out if which is None else out.filter(which)).isEmpty()


#: Heavy keys are those with more than this share of the rows; so there are at most 2,000.
HEAVY = 1 / 2000


def join_skewed(rows: DataFrame, side: DataFrame, keys: list[str], count: str, total: int, how: str = "inner", wide: bool = False) -> DataFrame:
    """``rows`` joined with ``side``, one row a key that knows how many rows have it: keys with
    more than ``HEAVY`` of the ``total`` are few, so they are broadcast and their rows stay
    where they are; all others shuffle. ``how`` may also be left. ``wide``: the others are many,
    whatever the size of their files, so they are never broadcast."""
    light = side.filter(F.col(count) <= total * HEAVY)
    heavy = side.filter(F.col(count) > total * HEAVY)
    others = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light.hint("merge") if wide else light, keys, how)
    return rows.join(F.broadcast(heavy), keys).unionByName(others)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    if path in _written:
        _written.remove(path)


def discard(df: DataFrame) -> None:
    """Delete what ``cut`` wrote, once nothing reads it any more."""
    if path := getattr(df, "_tesserae_path", None):
        _delete(df.sparkSession, path)


def purge(spark: SparkSession) -> int:
    """Delete every table that ``cut`` wrote in this process; call it when all frames that
    came from operators have been written or read. Returns how many went."""
    paths = list(_written)
    for path in paths:
        _delete(spark, path)
    return len(paths)
