"""Plans of the version store: versions are days of events, objects are users, names are
event types, the content of an object in a version is its sequence of event types."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.operators import policy as P
from tesserae.operators.store import bounded_memo as memo
from tesserae.plans.registry import plan
from tesserae.sources.models import parse_trees

BASE = """
ev AS (SELECT event_id, user_id, event_type, value, CAST(ts AS DATE) AS day FROM events),
days AS (SELECT day, row_number() OVER (ORDER BY day) AS tid FROM (SELECT DISTINCT day FROM ev)),
pieces AS (SELECT tid, user_id AS oid, md5(string_agg(event_type, ',' ORDER BY event_type)) AS content_hash, sum(length(event_type))::BIGINT AS size_b
           FROM ev JOIN days USING (day) GROUP BY tid, user_id),
names AS (SELECT DISTINCT tid, event_type AS name FROM ev JOIN days USING (day)),
firsts AS (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY tid, oid) = 1 AS is_new FROM pieces)"""


def events(t):
    ev = t.events.select("event_id", "user_id", "event_type", "value", F.to_date("ts").alias("day"))
    days = ev.select("day").distinct().withColumn("tid", F.row_number().over(W.orderBy("day")).cast("bigint"))
    return ev.join(F.broadcast(days), "day")  # one row a day


def pieces(t):
    return events(t).groupBy("tid", F.col("user_id").alias("oid")).agg(
        F.md5(F.array_join(F.sort_array(F.collect_list("event_type")), ",")).alias("content_hash"), F.sum(F.length("event_type")).alias("size_b")
    )


def firsts(t):
    p = pieces(t)
    first = p.groupBy("content_hash").agg(F.min(F.struct("tid", "oid")).alias("f"))
    return p.join(first, "content_hash").withColumn("is_new", F.struct("tid", "oid") == F.col("f"))


def names(t):
    return events(t).select("tid", F.col("event_type").alias("name")).distinct()


@plan("""SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS canonical_id,
    doc_id = min(doc_id) OVER (PARTITION BY md5(text)) AS is_new FROM documents""")
def content_synonyms(t):
    docs = t.documents.select("doc_id", F.md5("text").alias("content_hash"))
    first = docs.groupBy("content_hash").agg(F.min("doc_id").alias("canonical_id"))
    return docs.join(first, "content_hash").select("doc_id", "canonical_id", (F.col("doc_id") == F.col("canonical_id")).alias("is_new"))


@plan("""WITH s AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS syn FROM documents)
    SELECT d.doc_id, coalesce(s.syn, d.doc_id) AS resolved_id FROM documents d LEFT JOIN (SELECT * FROM s WHERE syn <> doc_id) s USING (doc_id)""")
def synonym_resolve(t):
    syn = content_synonyms(t).filter("not is_new").select("doc_id", F.col("canonical_id").alias("syn"))
    return t.documents.select("doc_id").join(syn, "doc_id", "left").select("doc_id", F.coalesce("syn", "doc_id").alias("resolved_id"))


@plan(f"WITH {BASE} SELECT tid, count(*) FILTER (WHERE is_new) AS new_pieces, coalesce(sum(size_b) FILTER (WHERE is_new), 0)::BIGINT AS new_bytes, count(*) AS pieces FROM firsts GROUP BY tid")
def new_bytes_per_version(t):
    return firsts(t).groupBy("tid").agg(F.count_if("is_new").alias("new_pieces"), F.sum(F.when(F.col("is_new"), F.col("size_b")).otherwise(0)).alias("new_bytes"), F.count("*").alias("pieces"))


@plan(f"WITH {BASE} SELECT sum(size_b)::BIGINT AS snapshot_bytes, sum(CASE WHEN is_new THEN size_b ELSE 0 END)::BIGINT AS delta_bytes FROM firsts")
def snapshot_vs_delta_size(t):
    return firsts(t).agg(F.sum("size_b").alias("snapshot_bytes"), F.sum(F.when(F.col("is_new"), F.col("size_b")).otherwise(0)).alias("delta_bytes"))


CARRY = """carried AS (SELECT d.tid, n.name, max(n.tid) AS piece_tid FROM days d JOIN names n ON n.tid <= d.tid GROUP BY d.tid, n.name)"""


def carried(t):
    n = names(t)
    every = n.select("tid").distinct().crossJoin(n.select("name").distinct())  # versions by names
    last = F.last("a", ignorenulls=True).over(W.partitionBy("name").orderBy("tid").rowsBetween(W.unboundedPreceding, 0))
    return every.join(n.withColumn("a", F.col("tid")), ["tid", "name"], "left").withColumn("piece_tid", last).filter("piece_tid is not null").select("tid", "name", "piece_tid")


@plan(f"WITH {BASE}, {CARRY} SELECT tid, name, piece_tid FROM carried")
def namemap_carry_forward(t):
    return carried(t)


@plan(f"""WITH {BASE}, {CARRY}, v AS (SELECT (max(tid) + 1) // 2 AS at FROM days)
    SELECT c.name, c.piece_tid, e.user_id, count(*) AS n_events FROM carried c, v, ev e JOIN days d USING (day)
    WHERE c.tid = v.at AND d.tid = c.piece_tid AND e.event_type = c.name GROUP BY ALL""")
def time_travel_load(t):
    c = carried(t)
    at = c.agg(F.expr("(max(tid) + 1) div 2").alias("tid"))
    return c.join(F.broadcast(at), "tid").select("name", "piece_tid").join(events(t).select(F.col("event_type").alias("name"), F.col("tid").alias("piece_tid"), "user_id"), ["name", "piece_tid"]).groupBy("name", "piece_tid", "user_id").agg(F.count("*").alias("n_events"))


@plan(f"""WITH {BASE}, {CARRY} SELECT tid, name, piece_tid FROM carried WHERE name IN ('click', 'purchase', 'missing') AND tid = (SELECT max(tid) FROM days)""")
def partial_load(t):
    c = carried(t)
    wanted = t.spark.createDataFrame([("click",), ("purchase",), ("missing",)], "name string")
    return c.join(F.broadcast(c.agg(F.max("tid").alias("tid"))), "tid").join(F.broadcast(wanted), "name", "left_semi").select("tid", "name", "piece_tid")


@plan(f"WITH {BASE} SELECT tid, count(*) AS n_active, string_agg(name, ',' ORDER BY name) AS active FROM names GROUP BY tid")
def active_names(t):
    return names(t).groupBy("tid").agg(F.count("*").alias("n_active"), F.array_join(F.sort_array(F.collect_list("name")), ",").alias("active"))


@plan(f"WITH {BASE} SELECT d.tid, n.name FROM days d CROSS JOIN (SELECT DISTINCT name FROM names) n ANTI JOIN names a ON a.tid = d.tid AND a.name = n.name")
def inactive_names(t):
    n = names(t)
    return n.select("tid").distinct().crossJoin(n.select("name").distinct()).join(n, ["tid", "name"], "left_anti")


@plan(f"WITH {BASE} SELECT name, min(tid) AS first_tid, row_number() OVER (ORDER BY min(tid), name) AS rank FROM names GROUP BY name")
def name_rank(t):
    return names(t).groupBy("name").agg(F.min("tid").alias("first_tid")).withColumn("rank", F.row_number().over(W.orderBy("first_tid", "name")).cast("bigint"))


@plan("""WITH act AS (SELECT DISTINCT c_nationkey FROM customer WHERE c_acctbal > 9000)
    SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IN (SELECT n_regionkey FROM nation JOIN act ON n_nationkey = c_nationkey)""")
def connected_active_names(t):
    active = t.customer.filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("n_nationkey")).distinct()
    comps = t.nation.join(active, "n_nationkey", "left_semi").select("n_regionkey").distinct()
    return t.nation.join(comps, "n_regionkey", "left_semi").select("n_nationkey", "n_name")


@plan("""SELECT doc_id, ceil(length(text) / 100.0)::BIGINT AS n_chunks, md5(text) AS joined_hash FROM documents WHERE length(text) > 0""")
def chunk_split_reassemble(t):
    starts = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 100).cast("int"))
    parts = t.documents.filter(F.length("text") > 0).select("doc_id", F.posexplode(F.transform(starts, lambda i: F.substr(F.col("text"), i * 100 + 1, F.lit(100)))).alias("chunk", "body"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "body"))), lambda x: x["body"]), "")
    return parts.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.md5(whole).alias("joined_hash"))


@plan(f"""WITH {BASE} SELECT tid, oid, CASE WHEN size_b > 40 THEN -1 ELSE (sum(CASE WHEN size_b <= 40 THEN size_b ELSE 0 END) OVER (PARTITION BY tid ORDER BY oid)
    - CASE WHEN size_b <= 40 THEN size_b ELSE 0 END)::BIGINT // 200 END AS page FROM firsts WHERE is_new""")
def page_assignment(t):
    small = F.when(F.col("size_b") <= 40, F.col("size_b")).otherwise(0)
    run = F.sum(small).over(W.partitionBy("tid").orderBy("oid").rowsBetween(W.unboundedPreceding, 0))
    return firsts(t).filter("is_new").withColumn("__before", run - small).select("tid", "oid", F.when(F.col("size_b") > 40, F.lit(-1).cast("bigint")).otherwise(F.expr("__before div 200")).alias("page"))


@plan(f"WITH {BASE} SELECT content_hash, tid, oid, row_number() OVER (ORDER BY tid, oid) AS seen FROM firsts WHERE is_new AND size_b BETWEEN 5 AND 40 QUALIFY seen <= 16")
def bounded_memo(t):
    return memo(firsts(t).filter("is_new"), 16, 5, 40).select("content_hash", "tid", "oid", F.row_number().over(W.orderBy("tid", "oid")).cast("bigint").alias("seen"))


@plan(f"""WITH {BASE} SELECT f.tid, (SELECT count(*) FROM names n WHERE n.tid = f.tid) AS n_names, count(*) FILTER (WHERE is_new) AS n_new, count(*) FILTER (WHERE NOT is_new) AS n_synonyms FROM firsts f GROUP BY f.tid""")
def commit_log(t):
    n = names(t).groupBy("tid").agg(F.count("*").alias("n_names"))
    return firsts(t).groupBy("tid").agg(F.count_if("is_new").alias("n_new"), F.count_if(~F.col("is_new")).alias("n_synonyms")).join(n, "tid").select("tid", "n_names", "n_new", "n_synonyms")


@plan("""SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY ALL""")
def upsert_latest(t):
    return t.events.groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("value"), F.max("event_id").alias("event_id"))


@plan("""SELECT DISTINCT o_custkey AS src, c_nationkey AS dst FROM orders JOIN customer ON o_custkey = c_custkey
    WHERE NOT (o_custkey % 3 = 0) UNION SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey % 3 = 0""")
def insert_edges_ignore(t):
    old = t.customer.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("src"), F.col("c_nationkey").cast("int").alias("dst"))
    new = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_custkey").alias("src"), F.col("c_nationkey").alias("dst")).distinct()
    return old.unionByName(new.join(old, ["src", "dst"], "left_anti"))


@plan(f"WITH {BASE} SELECT content_hash, count(*) AS holders, string_agg(DISTINCT tid::VARCHAR, ',' ORDER BY tid::VARCHAR) AS versions FROM pieces GROUP BY content_hash HAVING count(*) > 1")
def synonym_groups(t):
    return pieces(t).groupBy("content_hash").agg(F.count("*").alias("holders"), F.array_join(F.sort_array(F.collect_set(F.col("tid").cast("string"))), ",").alias("versions")).filter("holders > 1")


@plan("SELECT p_partkey, p_name FROM part WHERE p_type LIKE 'PROMO%'")
def prefix_scan(t):
    return t.part.filter(F.col("p_type").startswith("PROMO")).select("p_partkey", "p_name")


@plan("""SELECT 'customer' AS relation, count(*) AS n, sum(length(c_name))::BIGINT AS bytes FROM customer UNION ALL
    SELECT 'supplier', count(*), sum(length(s_name))::BIGINT FROM supplier UNION ALL SELECT 'part', count(*), sum(length(p_name))::BIGINT FROM part""")
def relation_sizes(t):
    one = lambda df, n, c: df.agg(F.lit(n).alias("relation"), F.count("*").alias("n"), F.sum(F.length(c)).alias("bytes"))
    return one(t.customer, "customer", "c_name").unionAll(one(t.supplier, "supplier", "s_name")).unionAll(one(t.part, "part", "p_name"))


@plan("SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') GROUP BY 1")
def selective_save(t):
    left_out = t.spark.createDataFrame([("BUILDING",), ("MACHINERY",)], "c_mktsegment string")
    return t.customer.join(F.broadcast(left_out), "c_mktsegment", "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@plan(f"WITH {BASE} SELECT oid, content_hash FROM pieces WHERE tid = (SELECT max(tid) FROM days) EXCEPT ALL SELECT oid, content_hash FROM pieces WHERE tid = 1")
def delta_vs_first(t):
    p = pieces(t)
    last = p.join(F.broadcast(p.agg(F.max("tid").alias("tid"))), "tid").select("oid", "content_hash")
    return last.exceptAll(p.filter("tid = 1").select("oid", "content_hash"))


@plan("""WITH o AS (SELECT c_nationkey AS n, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS i, sum(abs(c_acctbal)) AS s FROM customer GROUP BY c_nationkey, c_mktsegment),
    c AS (SELECT n, k, sum(CASE WHEN (k >> i) & 1 = 1 THEN s * 0.1 + 1200 ELSE s END) AS cost FROM range(32) r(k), o GROUP BY n, k)
    SELECT n::BIGINT AS n, arg_min(k, (round(cost, 4), k))::BIGINT AS decisions, round(min(cost), 4) AS cost FROM c GROUP BY n""")
def exhaustive_minimum(t):
    """For each nation the cheapest of all decisions over its market segments: 2 ** 5 sets."""
    o = t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.sum(F.abs("c_acctbal")).alias("size"))
    segments = [x["c_mktsegment"] for x in t.customer.select("c_mktsegment").distinct().orderBy("c_mktsegment").limit(P.MOST_DECISIONS + 1).collect()]
    position = F.array_position(F.array(*map(F.lit, segments)), F.col("c_mktsegment")) - 1
    return P.exhaustive(o.select(F.col("c_nationkey").cast("bigint").alias("n"), position.alias("i"), "size"), "n", len(segments), 0.1)


@plan("""SELECT o_custkey, string_agg(o_orderpriority, '|' ORDER BY o_orderkey) AS body FROM orders GROUP BY o_custkey""")
def ordered_chunk_fold(t):
    return t.orders.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda x: x["o_orderpriority"]), "|").alias("body"))


# --- tracking

SEEN = """hist AS (SELECT tid, oid, content_hash, min(tid) OVER (PARTITION BY content_hash) = tid AS changed FROM pieces),
counts AS (SELECT tid, oid, content_hash, changed, count(*) OVER w AS seen, sum(changed::INT) OVER w AS n_changed FROM hist
           WINDOW w AS (PARTITION BY oid ORDER BY tid)),
prob AS (SELECT oid, max(seen) AS seen, max(n_changed)::BIGINT AS n_changed, max(n_changed)::DOUBLE / max(seen) AS p FROM counts GROUP BY oid)"""


def history(t):
    p = pieces(t)
    first = p.groupBy("content_hash").agg(F.min("tid").alias("f"))
    w = W.partitionBy("oid").orderBy("tid").rowsBetween(W.unboundedPreceding, 0)
    h = p.join(first, "content_hash").withColumn("changed", F.col("tid") == F.col("f"))
    return h.select("tid", "oid", "content_hash", "changed", F.count("*").over(w).alias("seen"), F.sum(F.col("changed").cast("bigint")).over(w).alias("n_changed"))


def probability(t):
    return history(t).groupBy("oid").agg(F.max("seen").alias("seen"), F.max("n_changed").alias("n_changed")).withColumn("p", F.col("n_changed") / F.col("seen"))


@plan(f"WITH {BASE}, {SEEN} SELECT tid, oid, changed, seen, n_changed::BIGINT AS n_changed FROM counts")
def seen_changed_counts(t):
    return history(t).drop("content_hash")


@plan(f"WITH {BASE}, {SEEN} SELECT oid, seen, n_changed, round(p, 6) AS change_prob FROM prob")
def change_probability(t):
    return probability(t).select("oid", "seen", "n_changed", F.round("p", 6).alias("change_prob"))


@plan(f"WITH {BASE}, {SEEN} SELECT least(floor(p * 10), 9)::BIGINT AS bin, count(*) AS n FROM prob GROUP BY 1")
def change_prob_histogram(t):
    return probability(t).groupBy(F.least(F.floor(F.col("p") * 10), F.lit(9)).cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


@plan(f"""WITH {BASE}, {SEEN} SELECT content_hash, round(max(coalesce((n_changed - changed::INT)::DOUBLE / nullif(seen - 1, 0), 0)), 6) AS max_prob FROM counts GROUP BY content_hash""")
def piece_max_change_prob(t):
    before = F.coalesce((F.col("n_changed") - F.col("changed").cast("int")) / F.nullif(F.col("seen") - 1, F.lit(0)), F.lit(0.0))
    return history(t).groupBy("content_hash").agg(F.round(F.max(before), 6).alias("max_prob"))


@plan(f"WITH {BASE}, {SEEN} SELECT oid, content_hash FROM counts WHERE changed AND tid = (SELECT max(tid) FROM days)")
def recent_changes(t):
    h = history(t)
    return h.join(F.broadcast(h.agg(F.max("tid").alias("tid"))), "tid").filter("changed").select("oid", "content_hash")


@plan(f"WITH {BASE}, {SEEN} SELECT oid, tid, seen - 1 AS nth, changed FROM counts")
def rate_change_table(t):
    return history(t).select("oid", "tid", (F.col("seen") - 1).alias("nth"), "changed")


@plan("SELECT o_custkey AS src, o_orderkey AS dst, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS nth FROM orders")
def rate_dependency_table(t):
    return t.orders.select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"), (F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).cast("bigint").alias("nth"))


@plan("""WITH l AS (SELECT DISTINCT event_type FROM events WHERE ts::DATE = (SELECT max(ts::DATE) FROM events))
    SELECT user_id AS oid, bool_or(event_type = 'signup') AS "global", arg_min(event_type, event_id) AS type, arg_min(event_type, event_id) IN (SELECT event_type FROM l) AS type_global,
      sum(length(event_type) + length(props))::BIGINT AS size, count(*) AS len, sum(len(json_keys(props)))::BIGINT AS len_dict, NULL::BIGINT AS len_slots FROM events GROUP BY user_id""")
def rate_feature_table(t):
    """What a rate is learnt from, by object: names of the last version are the global ones."""
    last = t.events.agg(F.max(F.to_date("ts")).alias("day"))  # one row
    named = t.events.join(F.broadcast(last), F.to_date("ts") == F.col("day")).select(F.col("event_type").alias("type")).distinct().withColumn("type_global", F.lit(True))
    own = t.events.groupBy(F.col("user_id").alias("oid")).agg(
        F.bool_or(F.col("event_type") == "signup").alias("global"), F.min_by("event_type", "event_id").alias("type"), F.sum(F.length("event_type") + F.length("props")).alias("size"),
        F.count("*").alias("len"), F.sum(F.size(F.call_function("json_object_keys", "props"))).alias("len_dict"), F.lit(None).cast("bigint").alias("len_slots"),
    )
    return own.join(named, "type", "left").withColumn("type_global", F.coalesce("type_global", F.lit(False)))


@plan(f"WITH {BASE}, {SEEN} SELECT oid, sum((changed AND seen > 1)::INT)::BIGINT AS num_changes, sum((changed AND seen > 1)::INT) = 0 AS unchanged FROM counts GROUP BY oid")
def training_labels(t):
    h = history(t).withColumn("c", (F.col("changed") & (F.col("seen") > 1)).cast("int"))
    return h.groupBy("oid").agg(F.sum("c").alias("num_changes")).withColumn("unchanged", F.col("num_changes") == 0)


# --- policies

@plan("""SELECT p_partkey, CASE WHEN k IN ('SMALL', 'ECONOMY') OR k NOT IN ('LARGE', 'PROMO', 'STANDARD') THEN 'bundle'
    WHEN k = 'PROMO' OR p_size % 3 >= 1 THEN 'split_final' ELSE 'split' END AS action FROM (SELECT *, split_part(p_type, ' ', 1) AS k FROM part)""")
def type_policy(t):
    kind = F.substring_index("p_type", " ", 1)
    return t.part.select("p_partkey", P.type_policy(kind, ["SMALL", "ECONOMY"], ["LARGE", "PROMO", "STANDARD"], ["PROMO"], F.col("p_size") % 3).alias("action"))


@plan("SELECT n_nationkey, CASE WHEN (22369621 >> n_nationkey) & 1 = 1 THEN 'split' ELSE 'bundle' END AS action FROM nation")
def fixed_decisions(t):
    return t.nation.select("n_nationkey", P.fixed_policy(F.lit(22369621), F.col("n_nationkey")).alias("action"))


@plan("""SELECT o_orderkey, round((sp + so) * least(cp + co, 1) + 1200, 4) AS bundle_cost, round(sp * cp + so * co + 2400, 4) AS split_cost,
    CASE WHEN (sp + so) * least(cp + co, 1) + 1200 <= sp * cp + so * co + 2400 THEN 'bundle' ELSE 'split' END AS action
    FROM (SELECT o_orderkey, (o_orderkey % 50) * 400.0::DOUBLE AS sp, (o_orderkey % 7) * 100.0::DOUBLE AS so, (o_orderkey % 4) * 0.25::DOUBLE AS cp, (o_orderkey % 3) * 0.5::DOUBLE AS co FROM orders)""")
def greedy_cost_step(t):
    key = F.col("o_orderkey")
    args = ((key % 50) * 400.0, (key % 7) * 100.0, (key % 4) * 0.25, (key % 3) * 0.5)
    b, s = P.bundle_cost(*args), P.split_cost(*args)
    return t.orders.select("o_orderkey", F.round(b, 4).alias("bundle_cost"), F.round(s, 4).alias("split_cost"), F.when(b <= s, "bundle").otherwise("split").alias("action"))


@plan("""WITH RECURSIVE o AS (SELECT o_custkey AS g, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, o_orderkey AS p,
      (o_orderkey % 40) * 1000.0::DOUBLE AS s, (o_orderkey % 5) * 0.05::DOUBLE AS c FROM orders),
    f AS (SELECT g, 0::BIGINT AS i, NULL::BIGINT AS p, 0.0::DOUBLE AS held, 0.0::DOUBLE AS rate, '' AS action FROM (SELECT DISTINCT g FROM o)
      UNION ALL SELECT o.g, o.i, o.p, CASE WHEN st THEN held + o.s ELSE held END, CASE WHEN st THEN least(rate + o.c, 1) ELSE rate END, CASE WHEN st THEN 'bundle' WHEN o.p % 3 >= 1 THEN 'split_final' ELSE 'split' END
      FROM (SELECT f.*, o.s AS s2, o.c AS c2, (held + o.s) * least(rate + o.c, 1) + 1200 <= held * rate + o.s * o.c + 2400 AS st FROM f JOIN o ON o.g = f.g AND o.i = f.i + 1) f JOIN o ON o.g = f.g AND o.i = f.i + 1)
    SELECT g AS group_id, p AS position, action FROM f WHERE i > 0""")
def greedy_policy_fold(t):
    key = F.col("o_orderkey")
    return P.greedy_fold(t.orders.select(F.col("o_custkey").alias("group_id"), key.alias("position"), ((key % 40) * 1000.0).alias("size"), ((key % 5) * 0.05).alias("rate"), (key % 3).alias("depth")))


TREES = [("p_size", 25, ("p_retailprice", 1200, 0.1, -0.2), 0.4), ("p_retailprice", 1500, 0.05, ("p_size", 10, -0.1, 0.2))]


@plan("""SELECT p_partkey, round((CASE WHEN p_size <= 25 THEN CASE WHEN p_retailprice <= 1200 THEN 0.1 ELSE -0.2 END ELSE 0.4 END
    + CASE WHEN p_retailprice <= 1500 THEN 0.05 ELSE CASE WHEN p_size <= 10 THEN -0.1 ELSE 0.2 END END)::DOUBLE, 6) AS score FROM part""")
def tree_ensemble_rate(t):
    return t.part.select("p_partkey", F.round(P.tree_score(TREES), 6).alias("score"))


#: A model of two trees in the text format of gradient-boosted trees.
MODEL = """tree
feature_names=size len len_dict

Tree=0
num_leaves=3
split_feature=0 1
threshold=25.5 20.5
decision_type=2 10
left_child=1 -1
right_child=-2 -3
leaf_value=0.25 -1.5 0.75

Tree=1
num_leaves=2
split_feature=2
threshold=2.5
decision_type=8
left_child=-1
right_child=-2
leaf_value=-0.5 0.125

end of trees
"""


@plan("""WITH f AS (SELECT p_partkey, p_size AS size, CASE WHEN p_partkey % 5 > 0 THEN length(p_name) END AS len, CASE WHEN p_partkey % 4 > 0 THEN p_partkey % 7 END AS len_dict FROM part),
    s AS (SELECT p_partkey, (CASE WHEN coalesce(size, 0) <= 25.5 THEN CASE WHEN len <= 20.5 OR len IS NULL THEN 0.25 ELSE 0.75 END ELSE -1.5 END + CASE WHEN len_dict <= 2.5 THEN -0.5 ELSE 0.125 END)::DOUBLE AS x FROM f)
    SELECT p_partkey, round(1 / (1 + exp(-x)), 6) AS probability,
      CASE WHEN p_partkey % 11 = 0 OR (('0x' || substr(md5(p_partkey::VARCHAR), 1, 4))::INT % 10 = 0 AND 1 / (1 + exp(-x)) < 0.5) THEN 0.0 ELSE 0.1 END::DOUBLE AS rate FROM s""")
def tree_file_rate(t):
    """Rates by a model file: a tenth of the objects, by hash, are asked for."""
    key = F.col("p_partkey")
    f = t.part.select("p_partkey", F.col("p_size").alias("size"), F.when(key % 5 > 0, F.length("p_name")).alias("len"), F.when(key % 4 > 0, key % 7).alias("len_dict"))
    p = P.sigmoid(P.tree_score(parse_trees(MODEL)))
    drawn = F.conv(F.substring(F.md5(key.cast("string")), 1, 4), 16, 10).cast("int") % 10 == 0
    return f.select("p_partkey", F.round(p, 6).alias("probability"), P.sampled_rate(p, key % 11 == 0, drawn).alias("rate"))


@plan("SELECT n_nationkey, 'split' AS alone, 'bundle' AS together, 0.5::DOUBLE AS rate, CASE WHEN n_nationkey % 5 = 0 THEN 0 ELSE greatest(least(n_nationkey / 10.0 - 0.5, 1), 0) END::DOUBLE AS bounded FROM nation")
def naive_policies(t):
    n = F.col("n_nationkey")
    return t.nation.select("n_nationkey", P.naive_policy("split").alias("alone"), P.naive_policy("bundle").alias("together"), P.constant_rate(0.5).alias("rate"), P.bounded_rate(n / 10.0 - 0.5, n % 5 == 0).alias("bounded"))
