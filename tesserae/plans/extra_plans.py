"""Plans of the write and read path, and of fitting, that stand alone."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.plans.registry import plan
from tesserae.runtime import cut


@plan("""SELECT event_id AS oid, NULL::BIGINT AS parent, 'row' AS part, NULL::VARCHAR AS value FROM events
    UNION ALL SELECT event_id, event_id, 'props.k', (props->>'$.k') FROM events WHERE (props->>'$.k') IS NOT NULL""")
def nested_split(t):
    """A nested value leaves its parent as a row of its own."""
    parsed = t.events.select("event_id", F.from_json("props", "map<string,string>").alias("m"))
    root = parsed.select(F.col("event_id").alias("oid"), F.lit(None).cast("bigint").alias("parent"), F.lit("row").alias("part"), F.lit(None).cast("string").alias("value"))
    child = parsed.select(F.col("event_id").alias("oid"), F.col("event_id").alias("parent"), F.explode("m").alias("k", "value")).select("oid", "parent", F.concat(F.lit("props."), "k").alias("part"), "value")
    return root.unionByName(child)


@plan("SELECT user_id, arg_min(event_type, event_id) AS action, count(*) - 1 AS forced FROM events GROUP BY user_id")
def action_cache(t):
    return t.events.groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("action"), (F.count("*") - 1).alias("forced"))


@plan("SELECT DISTINCT ts::DATE AS day, user_id FROM events")
def visited_dedup(t):
    return t.events.select(F.to_date("ts").alias("day"), "user_id").dropDuplicates(["day", "user_id"])


@plan("SELECT o_custkey AS src, o_orderkey AS dst FROM orders UNION SELECT o_custkey, l_orderkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity > 40")
def dependency_collection(t):
    split = t.orders.select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"))
    shared = t.lineitem.filter("l_quantity > 40").join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("src"), F.col("l_orderkey").alias("dst"))
    return split.union(shared).distinct()


@plan("SELECT user_id, event_type AS root FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def merge_latest_results(t):
    n = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return t.events.withColumn("n", n).filter("n = 1").select("user_id", F.col("event_type").alias("root"))


@plan("SELECT day, row_number() OVER (ORDER BY md5('123:' || day::VARCHAR)) AS turn FROM (SELECT DISTINCT ts::DATE AS day FROM events)")
def shuffled_load_order(t):
    days = t.events.select(F.to_date("ts").alias("day")).distinct()  # one row a version
    return days.withColumn("turn", F.row_number().over(W.orderBy(F.md5(F.concat(F.lit("123:"), F.col("day").cast("string"))))).cast("bigint"))


@plan("SELECT ts::DATE AS day, count(*) AS n, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS names FROM events GROUP BY 1")
def batch_load_by_version(t):
    return t.events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("names"))


@plan("SELECT c_custkey FROM customer WHERE ('0x' || substr(md5(c_custkey::VARCHAR), 1, 4))::INT % 10 = 0")
def hash_sample(t):
    return t.customer.filter(F.conv(F.substring(F.md5(F.col("c_custkey").cast("string")), 1, 4), 16, 10).cast("int") % 10 == 0).select("c_custkey")


@plan("SELECT c_custkey, round((c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_pop(c_acctbal) FROM customer), 6) AS z FROM customer")
def standard_scale(t):
    m = t.customer.agg(F.avg("c_acctbal").alias("m"), F.stddev_pop("c_acctbal").alias("s"))  # one row
    return t.customer.crossJoin(F.broadcast(m)).select("c_custkey", F.round((F.col("c_acctbal") - F.col("m")) / F.col("s"), 6).alias("z"))


def _vectors(t):
    from pyspark.ml.functions import array_to_vector

    return t.embeddings.select("vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))


@plan()
def pca_kmeans(t):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA

    v = _vectors(t)
    reduced = PCA(k=3, inputCol="features", outputCol="p").fit(v).transform(v)
    return KMeans(k=4, seed=1, featuresCol="p").fit(reduced).transform(reduced).groupBy("prediction").agg(F.count("*").alias("n"))


@plan()
def logistic_forest_fit(t):
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier

    v = _vectors(t).withColumn("label", (F.col("label") % 2).cast("double"))
    # predictions are written, so that no plan holds two fitted models
    a = cut(LogisticRegression(maxIter=20).fit(v).transform(v).select("vec_id", "label", F.col("prediction").alias("logistic")), "logistic")
    b = cut(RandomForestClassifier(numTrees=10, seed=1).fit(v).transform(v).select("vec_id", F.col("prediction").alias("forest")), "forest")
    return a.join(b, "vec_id").groupBy("label", "logistic", "forest").agg(F.count("*").alias("n"))


@plan()
def fft_denoise(t):
    """Each user's values with all but the strongest frequencies removed."""

    def f(pdf):
        pdf = pdf.sort_values("event_id")
        spectrum = np.fft.rfft(pdf["value"].to_numpy())
        power = np.abs(spectrum) ** 2
        spectrum[power < 0.1 * power.max()] = 0
        return pdf.assign(smooth=np.fft.irfft(spectrum, len(pdf)))[["user_id", "event_id", "smooth"]]

    return t.events.select("user_id", "event_id", "value").groupBy("user_id").applyInPandas(f, "user_id long, event_id long, smooth double")
