"""Model files: fitted models as their library writes them, and boosted trees as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def save_model(model, path: str) -> None:
    """A fitted model of ``pyspark.ml``, in the folder that all executors share."""
    model.write().overwrite().save(path)


def load_model(kind, path: str):
    """The model that ``save_model`` wrote; ``kind`` is its class."""
    return kind.load(path)


def parse_trees(text: str) -> list:
    """The trees of a text file of gradient-boosted trees (sections ``Tree=n`` of ``key=value``
    lines) as ``policy.tree_score`` takes them. Categorical splits are an error."""
    head, *sections = text.split("\nTree=")
    names = next(line.split("=", 1)[1].split() for line in head.split("\n") if line.startswith("feature_names="))
    trees = []
    for section in sections:
        section = section.split("\nend of trees")[0]
        held = dict(line.split("=", 1) for line in section.split("\n")[1:] if "=" in line)
        leaf = [float(x) for x in held["leaf_value"].split()]
        if len(leaf) == 1:
            trees.append(leaf[0])
            continue
        feature, cut_at, kind, low, high = (held[k].split() for k in ("split_feature", "threshold", "decision_type", "left_child", "right_child"))

        def build(node: int, leaf=leaf, feature=feature, cut_at=cut_at, kind=kind, low=low, high=high):
            if node < 0:  # leaves are numbered from -1 down
                return leaf[-node - 1]
            bits = int(kind[node])
            if bits & 1:
                raise ValueError("categorical splits are not read")
            missing = ("low" if bits & 2 else "high") if bits >> 2 == 2 else "zero"
            return (names[int(feature[node])], float(cut_at[node]), build(int(low[node])), build(int(high[node])), missing)

        trees.append(build(0))
    return trees


def read_trees(spark: SparkSession, path: str) -> list:
    """As ``parse_trees``, of a file; a model is small enough for the driver by its nature."""
    return parse_trees(spark.read.text(path, wholetext=True).first()[0])


def read_feather(spark: SparkSession, paths: list[str] | str, schema: str) -> DataFrame:
    """Feather (Arrow) files of one schema as one table, a file a task; files of up to 2 GB."""
    import pyarrow as pa
    from pyarrow import feather
    from pyspark.sql.pandas.types import to_arrow_schema

    wanted = to_arrow_schema(spark.createDataFrame([], schema).schema)

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                table = feather.read_table(pa.BufferReader(content.as_buffer())).select(wanted.names)
                yield from table.cast(wanted).to_batches(max_chunksize=10_000)

    return spark.read.format("binaryFile").load(paths).select("content").mapInArrow(run, schema)
