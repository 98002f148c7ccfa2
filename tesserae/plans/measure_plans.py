"""Plans over measurements: a run is an order; workload = priority, system = status,
seconds = price / 1000, position = order of the key in its workload and system."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.operators import stats as S
from tesserae.operators import windows as X
from tesserae.plans.registry import plan

RUNS = """runs AS (SELECT o_orderkey AS id, o_orderpriority AS nb, o_orderstatus AS sut, o_totalprice / 1000 AS s, o_custkey AS b,
  row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY o_orderkey) AS idx FROM orders)"""


def runs(t):
    idx = F.row_number().over(W.partitionBy("o_orderpriority", "o_orderstatus").orderBy("o_orderkey"))
    return t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("nb"), F.col("o_orderstatus").alias("sut"), (F.col("o_totalprice") / 1000).alias("s"), F.col("o_custkey").alias("b"), idx.cast("bigint").alias("idx"))


def r(c, n=4):
    return F.round(c, n)


@plan(f"WITH {RUNS} SELECT sut, count(*) AS n, round(sum(s), 3) AS total, round(avg(s), 4) AS mean, round(sum(b) / sum(s), 4) AS throughput FROM runs GROUP BY sut")
def run_summary(t):
    return runs(t).groupBy("sut").agg(F.count("*").alias("n"), r(F.sum("s"), 3).alias("total"), r(F.avg("s")).alias("mean"), r(F.sum("b") / F.sum("s")).alias("throughput"))


@plan(f"WITH {RUNS} SELECT id, b - coalesce(lag(b) OVER (PARTITION BY nb, sut ORDER BY idx), 0) AS step FROM runs")
def storage_increment(t):
    return runs(t).select("id", (F.col("b") - F.coalesce(F.lag("b").over(W.partitionBy("nb", "sut").orderBy("idx")), F.lit(0))).alias("step"))


@plan(f"""WITH {RUNS} SELECT sut, part, round(seconds, 4) AS seconds FROM (SELECT sut, avg(s) AS exec, avg(s % 7) AS lock, avg(s % 3) AS save FROM runs GROUP BY sut)
    UNPIVOT (seconds FOR part IN (exec, lock, save))""")
def time_breakdown(t):
    g = runs(t).groupBy("sut").agg(F.avg("s").alias("exec"), F.avg(F.col("s") % 7).alias("lock"), F.avg(F.col("s") % 3).alias("save"))
    return g.unpivot("sut", ["exec", "lock", "save"], "part", "seconds").withColumn("seconds", r(F.col("seconds")))


@plan(f"WITH {RUNS} SELECT nb, sut, max(b) AS storage, round(sum(s), 3) AS total, round(avg(s), 4) AS mean, round(median(s), 7) AS median, count(*) AS n FROM runs GROUP BY nb, sut")
def parse_result(t):
    return runs(t).groupBy("nb", "sut").agg(F.max("b").alias("storage"), r(F.sum("s"), 3).alias("total"), r(F.avg("s")).alias("mean"), r(F.median("s"), 7).alias("median"), F.count("*").alias("n"))


@plan(f"""WITH {RUNS}, m AS (SELECT nb, sut, avg(s) AS v FROM runs GROUP BY nb, sut)
    SELECT nb, sut, round(CASE WHEN sut IN ('F', 'O') THEN 1.0 ELSE min(v) FILTER (WHERE sut IN ('F', 'O')) OVER (PARTITION BY nb) / v END, 6) AS relative FROM m""")
def relative_to_best(t):
    m = runs(t).groupBy("nb", "sut").agg(F.avg("s").alias("v"))
    base = F.col("sut").isin("F", "O")
    best = F.min(F.when(base, F.col("v"))).over(W.partitionBy("nb"))
    return m.select("nb", "sut", r(F.when(base, 1.0).otherwise(best / F.col("v")), 6).alias("relative"))


@plan(f"""WITH {RUNS} SELECT nb, round(avg(s) FILTER (WHERE sut = 'F'), 4) AS "F_mean", round(avg(s) FILTER (WHERE sut = 'O'), 4) AS "O_mean", round(avg(s) FILTER (WHERE sut = 'P'), 4) AS "P_mean" FROM runs GROUP BY nb""")
def wide_pivot(t):
    p = runs(t).groupBy("nb").pivot("sut", ["F", "O", "P"]).agg(r(F.avg("s")))
    return p.select("nb", *(F.col(c).alias(f"{c}_mean") for c in "FOP"))


@plan(f"WITH {RUNS} SELECT nb, round(max(s) / min(s), 4) AS ratio, round(1 - avg(s) / max(s), 4) AS spare FROM runs GROUP BY nb")
def ratio_columns(t):
    return runs(t).groupBy("nb").agg(r(F.max("s") / F.min("s")).alias("ratio"), r(1 - F.avg("s") / F.max("s")).alias("spare"))


@plan(f"WITH {RUNS} SELECT idx AS tid, round(avg(s), 7) AS mean FROM runs WHERE sut IN ('F', 'O') AND nb = '1-URGENT' GROUP BY idx")
def group_loads_by_position(t):
    return runs(t).filter(F.col("sut").isin("F", "O") & (F.col("nb") == "1-URGENT")).groupBy(F.col("idx").alias("tid")).agg(r(F.avg("s"), 7).alias("mean"))


@plan(f"WITH {RUNS} SELECT id, round(sum(s) OVER (PARTITION BY nb, sut ORDER BY idx), 6) AS running FROM runs")
def cumulative_exec(t):
    return runs(t).select("id", r(F.sum("s").over(W.partitionBy("nb", "sut").orderBy("idx").rowsBetween(W.unboundedPreceding, 0)), 6).alias("running"))


@plan(f"WITH {RUNS} SELECT id, round(s + greatest(s - 100, 0), 7) AS cost FROM runs")
def clipped_excess(t):
    return runs(t).select("id", r(F.col("s") + F.greatest(F.col("s") - 100, F.lit(0.0)), 7).alias("cost"))


@plan(f"WITH {RUNS} SELECT id, idx - 1 AS position FROM runs")
def row_positions(t):
    return runs(t).select("id", (F.col("idx") - 1).alias("position"))


@plan(f"WITH {RUNS} SELECT nb, count(*) FILTER (WHERE s < 100) AS below, round(quantile_cont(s, 0.9), 4) AS p90 FROM runs GROUP BY nb")
def percentile_90(t):
    return runs(t).groupBy("nb").agg(F.count_if(F.col("s") < 100).alias("below"), r(F.percentile("s", 0.9)).alias("p90"))


@plan(f"""WITH {RUNS} SELECT idx, round(median(s) FILTER (WHERE sut = 'F'), 7) AS "F", round(median(s) FILTER (WHERE sut = 'O'), 7) AS "O", round(median(s) FILTER (WHERE sut = 'P'), 7) AS "P" FROM runs GROUP BY idx""")
def median_pivot(t):
    return runs(t).groupBy("idx").pivot("sut", ["F", "O", "P"]).agg(r(F.median("s"), 7))


@plan(f"WITH {RUNS} SELECT sut, id, round(row_number() OVER (PARTITION BY sut ORDER BY s, id) / count(*) OVER (PARTITION BY sut)::DOUBLE * 100, 6) AS percent FROM runs")
def ecdf(t):
    return S.ecdf(runs(t), ["sut"], "s", "id").select("sut", "id", r(F.col("percent"), 6).alias("percent"))


@plan("""WITH d AS (SELECT (o_orderkey % 20)::DOUBLE AS wait, (o_orderkey % 13)::DOUBLE AS sync, (o_orderkey % 31)::DOUBLE AS async FROM orders),
    g AS (SELECT wait, sync, async, count(*) AS n FROM d GROUP BY ALL)
    SELECT w.wait, round(sum(n * (sync + greatest(async - w.wait, 0))) / sum(n), 6) AS delay FROM (SELECT DISTINCT wait FROM d) w, g GROUP BY w.wait""")
def wait_delay_curve(t):
    d = t.orders.select(*((F.col("o_orderkey") % k).cast("double").alias(c) for c, k in (("wait", 20), ("sync", 13), ("async", 31))))
    # sum of max(async - wait, 0) over all rows = sum of async above it less wait times their number
    at = d.groupBy(F.col("async").alias("x")).agg(F.count("*").alias("n"), F.sum("async").alias("s"))
    at = at.unionByName(d.select(F.col("wait").alias("x")).distinct().withColumn("asked", F.lit(True)), allowMissingColumns=True)
    total = d.agg(F.count("*").alias("rows"), F.sum("sync").alias("sync"))  # one row
    above = X.sums_above(at.groupBy("x").agg(F.max("asked").alias("asked"), F.sum("n").alias("n"), F.sum("s").alias("s")), "x", ["n", "s"])
    delay = (F.col("sync") + F.coalesce("s_above", F.lit(0.0)) - F.col("x") * F.coalesce("n_above", F.lit(0))) / F.col("rows")
    return above.filter("asked").crossJoin(F.broadcast(total)).select(F.col("x").alias("wait"), r(delay, 6).alias("delay"))


@plan("SELECT r.r_name, s.seg, k.range::BIGINT AS k FROM region r, (SELECT DISTINCT c_mktsegment AS seg FROM customer) s, range(3) k")
def parameter_grid(t):
    return t.region.select("r_name").crossJoin(t.customer.select(F.col("c_mktsegment").alias("seg")).distinct()).crossJoin(t.spark.range(3).withColumnRenamed("id", "k"))


@plan("SELECT 'c' AS kind, c_custkey AS key, c_acctbal AS amount, NULL::VARCHAR AS name FROM customer UNION ALL SELECT 's', s_suppkey, s_acctbal, s_name FROM supplier")
def union_missing_columns(t):
    a = t.customer.select(F.lit("c").alias("kind"), F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("amount"))
    b = t.supplier.select(F.lit("s").alias("kind"), F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("amount"), F.col("s_name").alias("name"))
    return a.unionByName(b, allowMissingColumns=True)


@plan("SELECT o_orderkey, step FROM (SELECT o_orderkey, o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS step FROM orders) WHERE step IS NOT NULL AND o_orderkey IS NOT NULL")
def drop_null_rows(t):
    step = F.col("o_totalprice") - F.lag("o_totalprice").over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    return t.orders.select("o_orderkey", step.alias("step")).na.drop()


@plan(f"""WITH {RUNS}, a AS (SELECT nb, sut, idx % 5 AS rdx, sum(s) AS s FROM runs GROUP BY ALL)
    SELECT nb, sut, round(avg(s), 3) AS mean, round(stddev_samp(s), 3) AS std FROM a GROUP BY nb, sut""")
def two_level_mean_std(t):
    a = runs(t).groupBy("nb", "sut", (F.col("idx") % 5).alias("rdx")).agg(F.sum("s").alias("s"))
    return a.groupBy("nb", "sut").agg(r(F.avg("s"), 3).alias("mean"), r(F.stddev_samp("s"), 3).alias("std"))


@plan(f"""WITH {RUNS}, q AS (SELECT sut, quantile_cont(s, 0.25) AS q1, quantile_cont(s, 0.5) AS median, quantile_cont(s, 0.75) AS q3, max(s) AS highest FROM runs GROUP BY sut)
    SELECT sut, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, round(highest, 4) AS highest,
      round(min(s) FILTER (WHERE s BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 4) AS whisker_low,
      round(max(s) FILTER (WHERE s BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 4) AS whisker_high FROM runs JOIN q USING (sut) GROUP BY ALL""")
def boxplot_stats(t):
    b = S.box_plot(runs(t), ["sut"], "s")
    return b.select("sut", *(r(F.col(c)).alias(c) for c in b.columns if c != "sut"))


@plan(f"""WITH {RUNS} SELECT id, coalesce(lag(s) OVER (PARTITION BY nb, sut ORDER BY idx), 0)::DOUBLE AS join_s, s AS exec_s FROM runs""")
def aligned_shift(t):
    return runs(t).select("id", F.lag("s", 1, 0.0).over(W.partitionBy("nb", "sut").orderBy("idx")).alias("join_s"), F.col("s").alias("exec_s"))


@plan("""SELECT p_partkey, CASE WHEN b >= 1e9 THEN printf('%.1f GB', b / 1e9) WHEN b >= 1e6 THEN printf('%.1f MB', b / 1e6) WHEN b >= 1e3 THEN printf('%.1f KB', b / 1e3) ELSE printf('%.1f  B', b) END AS shown
    FROM (SELECT p_partkey, (p_partkey * p_partkey * p_partkey * 4)::DOUBLE AS b FROM part)""")
def format_units(t):
    k = F.col("p_partkey")
    return t.part.select("p_partkey", S.human_bytes((k * k * k * 4).cast("double")).alias("shown"))


@plan(f"""WITH {RUNS}, c AS (SELECT sut, b % 50 AS page, b AS bytes, row_number() OVER (PARTITION BY sut, b % 50 ORDER BY id) AS n FROM runs)
    SELECT sut, sum(bytes)::BIGINT AS read_b, sum(CASE WHEN n = 1 THEN bytes ELSE 0 END)::BIGINT AS io_b, round(sum(bytes) / sum(CASE WHEN n = 1 THEN bytes ELSE 0 END)::DOUBLE, 6) AS save_ratio FROM c GROUP BY sut""")
def cache_statistics(t):
    n = F.row_number().over(W.partitionBy("sut", F.col("b") % 50).orderBy("id"))
    first = F.when(F.col("n") == 1, F.col("b")).otherwise(0)
    return runs(t).withColumn("n", n).groupBy("sut").agg(F.sum("b").alias("read_b"), F.sum(first).alias("io_b"), r(F.sum("b") / F.sum(first), 6).alias("save_ratio"))


@plan(f"""WITH {RUNS}, a AS (SELECT nb, list(s ORDER BY idx, id) AS l FROM runs WHERE sut = 'P' GROUP BY nb) SELECT nb, i - 1 AS position, l[i] AS seconds FROM (SELECT nb, l, unnest(range(1, len(l) + 1)) AS i FROM a)""")
def nested_flatten(t):
    a = runs(t).filter("sut = 'P'").groupBy("nb").agg(F.array_sort(F.collect_list(F.struct("idx", "id", "s"))).alias("l"))
    return a.select("nb", F.posexplode("l").alias("position", "x")).select("nb", F.col("position").cast("bigint").alias("position"), F.col("x.s").alias("seconds"))


@plan(f"""WITH {RUNS} SELECT nb, count(*) FILTER (WHERE sut = 'F') AS "F", count(*) FILTER (WHERE sut = 'O') AS "O", count(*) FILTER (WHERE sut = 'X') AS "X" FROM runs GROUP BY nb""")
def count_pivot_fill(t):
    return runs(t).groupBy("nb").pivot("sut", ["F", "O", "X"]).count().na.fill(0)


@plan("SELECT l_partkey, count(*) AS n, sum((l_quantity > 25)::INT)::BIGINT AS big FROM lineitem WHERE l_linenumber > 1 GROUP BY l_partkey")
def filtered_sum_count(t):
    return t.lineitem.filter("l_linenumber > 1").groupBy("l_partkey").agg(F.count("*").alias("n"), F.sum((F.col("l_quantity") > 25).cast("int")).alias("big"))


@plan("""WITH f AS (SELECT p_partkey AS oid, p_size, p_type FROM part), l AS (SELECT l_partkey AS oid, sum((l_quantity > 45)::INT) AS c FROM lineitem GROUP BY 1)
    SELECT oid, p_size, p_type IN ('PROMO', 'SMALL') AS fixed, c = 0 AS unchanged FROM f JOIN l USING (oid)""")
def feature_label_join(t):
    lab = t.lineitem.groupBy(F.col("l_partkey").alias("oid")).agg(F.sum((F.col("l_quantity") > 45).cast("int")).alias("c"))
    return t.part.select(F.col("p_partkey").alias("oid"), "p_size", "p_type").join(lab, "oid").select("oid", "p_size", F.col("p_type").isin("PROMO", "SMALL").alias("fixed"), (F.col("c") == 0).alias("unchanged"))


@plan("SELECT count(*) FILTER (WHERE o_totalprice IS NULL) AS price, count(*) FILTER (WHERE prev IS NULL) AS prev FROM (SELECT *, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev FROM orders)")
def null_counts(t):
    p = t.orders.withColumn("prev", F.lag("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderkey")))
    return p.agg(F.count_if(F.col("o_totalprice").isNull()).alias("price"), F.count_if(F.col("prev").isNull()).alias("prev"))


@plan("SELECT least(floor((o_totalprice) / 500000 * 10), 9)::BIGINT AS bin, count(*) AS n FROM orders GROUP BY 1")
def histogram(t):
    return t.orders.groupBy(S.histogram(F.col("o_totalprice"), 10, 0.0, 500000.0).alias("bin")).agg(F.count("*").alias("n"))


@plan("SELECT o_orderkey, ('0x' || substr(md5(o_orderkey::VARCHAR), 1, 4))::INT % 100 < 20 AS is_test FROM orders")
def hash_split(t):
    return t.orders.select("o_orderkey", S.hash_split(F.col("o_orderkey"), 20).alias("is_test"))


@plan("""WITH p AS (SELECT quality AS y, (n_chars > 400)::INT AS p FROM labels JOIN documents USING (doc_id)), c AS (SELECT y, p, count(*) AS n FROM p GROUP BY ALL)
    SELECT y, p AS predicted, n, round(n / (sum(n) OVER (PARTITION BY y))::DOUBLE, 6) AS by_true, round(n / (sum(n) OVER (PARTITION BY p))::DOUBLE, 6) AS by_predicted, round(n / (sum(n) OVER ())::DOUBLE, 6) AS by_all FROM c""")
def confusion_matrix(t):
    c = t.labels.join(t.documents, "doc_id").groupBy(F.col("quality").alias("y"), (F.col("n_chars") > 400).cast("int").alias("predicted")).agg(F.count("*").alias("n"))
    share = lambda *by: r(F.col("n") / F.sum("n").over(W.partitionBy(*by)), 6)
    return c.select("y", "predicted", "n", share("y").alias("by_true"), share("predicted").alias("by_predicted"), share(F.lit(0)).alias("by_all"))


@plan("SELECT quality, count(*) AS n, round((SELECT count(*) FROM labels) / (2.0 * count(*)), 6) AS weight FROM labels GROUP BY quality")
def class_weights(t):
    c = t.labels.groupBy("quality").agg(F.count("*").alias("n"))
    return c.select("quality", "n", r(F.sum("n").over(W.partitionBy(F.lit(0))) / (2.0 * F.col("n")), 6).alias("weight"))


@plan()
def boosted_trees_fit(t):
    """Fit, predict and confusion counts; a fit is not the same bit by bit elsewhere."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    data = t.documents.join(t.labels, "doc_id").select("doc_id", F.col("quality").cast("double").alias("label"), F.length("text").cast("double").alias("a"), (F.length("text") - F.length(F.translate("text", "%$&#*!|", ""))).cast("double").alias("b"))
    data = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(data).withColumn("test", S.hash_split(F.col("doc_id"), 20))
    model = GBTClassifier(maxIter=5, maxDepth=2, seed=1).fit(data.filter("not test"))
    return model.transform(data.filter("test")).groupBy("label", "prediction").agg(F.count("*").alias("n"))
