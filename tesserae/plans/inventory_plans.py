"""Plans of single lines of the inventory: features of objects, calendars, encodings, sizes."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.plans.registry import plan


@plan("""WITH o AS (SELECT ts::DATE AS day, user_id, count(*) AS n, md5(string_agg(event_type, ',' ORDER BY event_id)) AS h, arg_min(event_type, event_id) AS kind FROM events GROUP BY 1, 2),
    f AS (SELECT *, min(day) OVER (PARTITION BY user_id, h) = day AS changed, sum(n) OVER (PARTITION BY day) AS group_size FROM o),
    c AS (SELECT *, count(*) OVER w AS seen, coalesce(sum(changed::INT) OVER w, 0) AS changes FROM f
      WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    p AS (SELECT *, CASE WHEN seen = 0 THEN 0.0 ELSE changes / seen END AS prob FROM c)
    SELECT day, user_id AS oid, group_size::BIGINT AS group_size, round(max(prob) OVER (PARTITION BY day), 6) AS group_max_prob, seen::BIGINT AS seen, changes::BIGINT AS changes,
      round(prob, 6) AS prob, kind, n AS len, changed AS has_changed FROM p""")
def manual_feature_table(t):
    """What a policy could know of an object before a version is written, and whether the
    object changed. An object is a user's day; its version is the day."""
    seq = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]), ",")
    o = t.events.groupBy(F.to_date("ts").alias("day"), F.col("user_id").alias("oid")).agg(F.count("*").alias("len"), F.md5(seq).alias("h"), F.min_by("event_type", "event_id").alias("kind"))
    o = o.withColumn("has_changed", F.min("day").over(W.partitionBy("oid", "h")) == F.col("day"))
    earlier = W.partitionBy("oid").orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    o = o.withColumn("seen", F.count("*").over(earlier)).withColumn("changes", F.coalesce(F.sum(F.col("has_changed").cast("int")).over(earlier), F.lit(0)))
    o = o.withColumn("p", F.when(F.col("seen") == 0, 0.0).otherwise(F.col("changes") / F.col("seen")))
    group = o.groupBy("day").agg(F.sum("len").alias("group_size"), F.round(F.max("p"), 6).alias("group_max_prob"))  # combines before it moves, which a window would not
    return o.join(group, "day").select("day", "oid", "group_size", "group_max_prob", "seen", "changes", F.round("p", 6).alias("prob"), "kind", "len", "has_changed")


@plan("SELECT user_id AS oid, max(ts::DATE) AS latest, count(DISTINCT ts::DATE) AS pieces FROM events GROUP BY user_id")
def object_latest_piece(t):
    """The bridge of objects and pieces: the latest piece of each object, and how many hold it."""
    bridge = t.events.select(F.col("user_id").alias("oid"), F.to_date("ts").alias("day")).distinct()
    return bridge.groupBy("oid").agg(F.max("day").alias("latest"), F.count("*").alias("pieces"))


@plan("SELECT user_id AS oid, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS names FROM events GROUP BY user_id")
def variables_map(t):
    return t.events.groupBy(F.col("user_id").alias("oid")).agg(F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("names"))


@plan("""SELECT p_partkey, CASE WHEN d < 128 THEN 'bundle' WHEN d < 192 THEN 'split' ELSE 'split_final' END AS action
    FROM (SELECT p_partkey, ('0x' || substr(md5('7:' || p_partkey::VARCHAR), 1, 2))::INT AS d FROM part)""")
def random_policy(t):
    """A draw of 1/2, 1/4, 1/4 by a seeded hash, so that a run repeats."""
    d = F.conv(F.substring(F.md5(F.concat(F.lit("7:"), F.col("p_partkey").cast("string"))), 1, 2), 16, 10).cast("int")
    return t.part.select("p_partkey", F.when(d < 128, "bundle").when(d < 192, "split").otherwise("split_final").alias("action"))


@plan("""WITH d AS (SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1), r AS (SELECT min(day) AS a, max(day) AS b FROM d)
    SELECT g::DATE AS day, coalesce(n, 0)::BIGINT AS n FROM r, unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 DAY)) AS s(g) LEFT JOIN d ON d.day = g::DATE""")
def date_range(t):
    """Every day between the first and the last, with the count of those that have none."""
    d = t.events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    days = d.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    return days.join(d, "day", "left").na.fill(0, ["n"])


@plan("""WITH m AS (SELECT l_orderkey, string_agg(l_linenumber::VARCHAR || ' ' || l_quantity::INT::VARCHAR, ' ' ORDER BY l_linenumber, l_quantity::INT) AS mask FROM lineitem GROUP BY 1),
    s AS (SELECT *, string_split(mask, ' ') AS p FROM m)
    SELECT l_orderkey, mask, list_sum(list_transform(range(2, len(p) + 1, 2), lambda i: p[i]::BIGINT))::BIGINT AS pixels FROM s""")
def run_length_mask(t):
    """A mask is a list of start and length; its pixels are the sum of every second number."""
    runs = F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("q"))))
    mask = F.array_join(F.transform(runs, lambda r: F.concat_ws(" ", r["l_linenumber"], r["q"])), " ")
    masks = t.lineitem.groupBy("l_orderkey").agg(mask.alias("mask"))
    lengths = F.filter(F.split("mask", " "), lambda x, i: i % 2 == 1)
    return masks.withColumn("pixels", F.aggregate(lengths, F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint")))


@plan("""WITH n AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events WHERE value IS NOT NULL),
    p AS (SELECT user_id, i // 2 AS k, min(CASE WHEN i % 2 = 0 THEN value END) AS a, min(CASE WHEN i % 2 = 1 THEN value END) AS b FROM n GROUP BY 1, 2)
    SELECT n.user_id, event_id, round(CASE WHEN b IS NOT NULL AND abs(a - b) / 2 < 10 THEN (a + b) / 2 ELSE value END, 4) AS smooth FROM n JOIN p ON n.user_id = p.user_id AND n.i // 2 = p.k""")
def wavelet_denoise(t):
    """One level of the Haar transform: differences of neighbours below a threshold go."""
    by = W.partitionBy("user_id").orderBy("event_id")
    n = t.events.filter("value is not null").select("user_id", "event_id", "value", (F.row_number().over(by) - 1).alias("i"), F.lag("value").over(by).alias("a"), F.lead("value").over(by).alias("b"))
    other = F.when(F.col("i") % 2 == 0, F.col("b")).otherwise(F.col("a"))
    flat = other.isNotNull() & (F.abs(F.col("value") - other) / 2 < 10)
    return n.select("user_id", "event_id", F.round(F.when(flat, (F.col("value") + other) / 2).otherwise(F.col("value")), 4).alias("smooth"))


def _sizes(strings: str, longs: str) -> str:
    parts = [f"SELECT '{c}' AS name, count({c}) AS non_null, coalesce(sum(octet_length(encode({c}))), 0)::BIGINT AS bytes FROM customer" for c in strings.split()]
    return " UNION ALL ".join(parts + [f"SELECT '{c}', count({c}), (count({c}) * {w})::BIGINT FROM customer" for c, w in (x.split(":") for x in longs.split())])


@plan(_sizes("c_name c_mktsegment", "c_custkey:8 c_nationkey:4 c_acctbal:8"))
def column_sizes(t):
    """Name, filled rows and bytes of each column, in one pass over the table."""
    width = {"bigint": 8, "int": 4, "double": 8}
    cells = [
        F.struct(F.lit(c).alias("name"), F.count(c).alias("non_null"), (F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) if kind == "string" else F.count(c) * width[kind]).cast("bigint").alias("bytes"))
        for c, kind in t.customer.dtypes
    ]
    return t.customer.agg(F.array(*cells).alias("c")).select(F.inline("c"))


@plan("SELECT p_partkey, string_split(p_type, ' ')[1] AS first, string_split(p_type, ' ')[2] AS second FROM part")
def split_columns(t):
    parts = F.split("p_type", " ")
    return t.part.select("p_partkey", F.get(parts, 0).alias("first"), F.get(parts, 1).alias("second"))


@plan("""(SELECT 'head' AS part, o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5) UNION ALL (SELECT 'tail', o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 5)""")
def head_tail(t):
    keys = t.orders.select("o_orderkey")
    head, tail = (keys.orderBy(order).limit(5).withColumn("part", F.lit(name)) for name, order in (("head", F.asc("o_orderkey")), ("tail", F.desc("o_orderkey"))))
    return head.unionByName(tail)


@plan("SELECT n_nationkey, n_name, row_number() OVER (ORDER BY n_nationkey DESC) AS position FROM nation")
def reverse_rows(t):
    """Positions from the end; over all rows, so for tables of a fixed size."""
    return t.nation.select("n_nationkey", "n_name", F.row_number().over(W.orderBy(F.desc("n_nationkey"))).cast("bigint").alias("position"))


@plan("""SELECT coalesce(l_returnflag, '*') AS flag, coalesce(l_linestatus, '*') AS status, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem
    GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())""")
def grouping_sets(t):
    """Extension. Named sets only, so a cube's other combinations are not computed."""
    cols = [F.col("l_returnflag"), F.col("l_linestatus")]
    out = t.lineitem.groupingSets([cols, cols[:1], []], *cols).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    return out.select(F.coalesce("l_returnflag", F.lit("*")).alias("flag"), F.coalesce("l_linestatus", F.lit("*")).alias("status"), "n", "quantity")


@plan("""WITH s AS (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 1 DAY THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    k AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM s)
    SELECT user_id, session::BIGINT AS session, count(*) AS n FROM k GROUP BY 1, 2""")
def gap_sessions(t):
    """Extension. Sessions of a user that end after a day without an event."""
    by = W.partitionBy("user_id").orderBy("ts", "event_id")
    fresh = F.when(F.col("ts") - F.lag("ts").over(by) <= F.expr("INTERVAL 1 DAY"), 0).otherwise(1)
    marked = t.events.select("user_id", "event_id", "ts", fresh.alias("b"))
    return marked.withColumn("session", F.sum("b").over(by)).groupBy("user_id", "session").agg(F.count("*").alias("n"))
