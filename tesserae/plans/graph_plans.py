"""Plans over graphs: orders depend on customers, those on nations, those on regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.operators import graph as G
from tesserae.plans.registry import plan
from tesserae.runtime import cut

#: Pairs of a projection that one task makes or counts, about.
PAIRS = 4_000_000
#: Node ids of the four tables, kept apart by an offset.
NODES = """nodes AS (SELECT r_regionkey::BIGINT AS node, 'region' AS kind, 10::BIGINT AS size FROM region
  UNION ALL SELECT 100 + n_nationkey, 'nation', 20 FROM nation UNION ALL SELECT 1000 + c_custkey, 'customer', 30 FROM customer
  UNION ALL SELECT 10000000 + o_orderkey, 'order', 40 FROM orders),
edges AS (SELECT 100 + n_nationkey::BIGINT AS src, n_regionkey::BIGINT AS dst FROM nation UNION ALL SELECT 1000 + c_custkey, 100 + c_nationkey FROM customer
  UNION ALL SELECT 10000000 + o_orderkey, 1000 + o_custkey FROM orders)"""


def nodes(t):
    one = lambda df, c, off, kind, size: df.select((F.col(c) + off).cast("bigint").alias("node"), F.lit(kind).alias("kind"), F.lit(size).cast("bigint").alias("size"))
    return one(t.region, "r_regionkey", 0, "region", 10).unionAll(one(t.nation, "n_nationkey", 100, "nation", 20)).unionAll(one(t.customer, "c_custkey", 1000, "customer", 30)).unionAll(one(t.orders, "o_orderkey", 10_000_000, "order", 40))


def edges(t):
    one = lambda df, a, ao, b, bo: df.select((F.col(a) + ao).cast("bigint").alias("src"), (F.col(b) + bo).cast("bigint").alias("dst"))
    return one(t.nation, "n_nationkey", 100, "n_regionkey", 0).unionAll(one(t.customer, "c_custkey", 1000, "c_nationkey", 100)).unionAll(one(t.orders, "o_orderkey", 10_000_000, "o_custkey", 1000))


def seeds(t):
    return t.orders.select((F.col("o_orderkey") + 10_000_000).alias("node"))


REACH = f"""WITH RECURSIVE {NODES}, reach AS (SELECT 10000000 + o_orderkey AS seed, 10000000 + o_orderkey AS node, 0 AS hops FROM orders
  UNION ALL SELECT seed, e.dst, hops + 1 FROM reach r JOIN edges e ON e.src = r.node)"""


@plan(f"{REACH} SELECT seed, node, hops FROM reach")
def dependency_closure(t):
    return G.closure(edges(t), seeds(t))


@plan(f"{REACH} SELECT seed, count(*) AS n, string_agg(node::VARCHAR, '>' ORDER BY hops DESC, node) AS load_order FROM reach GROUP BY seed")
def closure_load_order(t):
    rows = G.closure(edges(t), seeds(t)).groupBy("seed").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct((-F.col("hops")).alias("h"), "node"))).alias("a"))
    return rows.select("seed", "n", F.array_join(F.transform("a", lambda x: x["node"].cast("string")), ">").alias("load_order"))


@plan(f"""{REACH}, hit AS (SELECT DISTINCT node FROM reach), syn AS (SELECT 1000 + c_custkey AS node, 1000 + min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS target FROM customer)
    SELECT node, hops AS rank, 'own' AS via FROM (SELECT node, min(hops) AS hops FROM reach GROUP BY node)
    UNION ALL SELECT s.target, -1, 'synonym' FROM hit JOIN syn s USING (node) WHERE s.target <> s.node""")
def closure_with_synonyms(t):
    reach = G.closure(edges(t), seeds(t)).groupBy("node").agg(F.min("hops").alias("rank"))
    first = t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.min("c_custkey").alias("m"))
    syn = t.customer.join(first, ["c_nationkey", "c_mktsegment"]).filter("c_custkey <> m").select((F.col("c_custkey") + 1000).alias("node"), (F.col("m") + 1000).alias("target"))
    return reach.withColumn("via", F.lit("own")).unionByName(reach.join(syn, "node").select(F.col("target").alias("node"), F.lit(-1).alias("rank"), F.lit("synonym").alias("via")))


@plan(f"{REACH} SELECT seed, string_agg(DISTINCT node::VARCHAR, ',' ORDER BY node::VARCHAR) AS members FROM reach GROUP BY seed")
def closure_collected(t):
    return G.closure(edges(t), seeds(t)).groupBy("seed").agg(F.array_join(F.sort_array(F.collect_set(F.col("node").cast("string"))), ",").alias("members"))


@plan("""SELECT 1000 + c_custkey AS node, min(1000 + c_custkey) OVER (PARTITION BY c_nationkey) AS low,
    CASE WHEN true THEN 100 + c_nationkey::BIGINT END AS comp FROM customer""")
def components(t):
    e = t.customer.select((F.col("c_custkey") + 1000).alias("src"), (F.col("c_nationkey") + 100).cast("bigint").alias("dst"))
    n = e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct()
    c = G.components(n, e).filter("node >= 1000")
    low = c.groupBy("comp").agg(F.min("node").alias("low"))
    return c.join(low, "comp").select("node", "low", "comp")


@plan("SELECT 100 + c_nationkey::BIGINT AS comp, count(*) + 1 AS n FROM customer GROUP BY 1")
def component_sizes(t):
    e = t.customer.select((F.col("c_custkey") + 1000).alias("src"), (F.col("c_nationkey") + 100).cast("bigint").alias("dst"))
    n = e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct()
    return G.components(n, e).groupBy("comp").agg(F.count("*").alias("n"))


@plan("""SELECT 10000000 + o_orderkey AS node, CASE WHEN c_mktsegment = 'BUILDING' THEN 10000000 + o_orderkey ELSE 1000 + o_custkey END AS comp
    FROM orders JOIN customer ON o_custkey = c_custkey""")
def immutable_cut_components(t):
    # an edge with an immutable end connects nothing
    mutable = t.customer.filter("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    e = t.orders.join(mutable, "o_custkey", "left_semi").select((F.col("o_orderkey") + 10_000_000).alias("src"), (F.col("o_custkey") + 1000).alias("dst"))
    n = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select((F.col("o_orderkey") + 10_000_000).alias("node")).unionByName(t.orders.select((F.col("o_custkey") + 1000).alias("node")))
    return G.components(n, e).filter("node >= 10000000")


@plan(f"""WITH RECURSIVE {NODES}, reach AS (SELECT node AS seed, node FROM nodes WHERE kind <> 'order' UNION ALL SELECT seed, e.src FROM reach r JOIN edges e ON e.dst = r.node)
    SELECT seed AS node, sum(size)::BIGINT AS total, count(*) AS paths FROM reach JOIN nodes USING (node) GROUP BY seed""")
def size_rollup(t):
    turned = edges(t).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    out = G.rollup(nodes(t).select("node", "size"), turned)
    return out.filter("node < 10000000")


@plan(f"WITH {NODES} SELECT kind, count(*) AS n, sum(size)::BIGINT AS bytes, round(avg(size), 4) AS mean FROM nodes GROUP BY kind")
def rollup_by_type(t):
    return nodes(t).groupBy("kind").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.round(F.avg("size"), 4).alias("mean"))


@plan(f"WITH {NODES} SELECT dst AS node, count(*) AS in_degree FROM edges GROUP BY dst")
def in_degree(t):
    return edges(t).groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("in_degree"))


@plan("SELECT l_suppkey, count(DISTINCT l_partkey) AS degree, count(*) AS weighted_degree FROM lineitem GROUP BY l_suppkey")
def weighted_degree(t):
    e = t.lineitem.groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("w"))
    return e.groupBy("l_suppkey").agg(F.count("*").alias("degree"), F.sum("w").alias("weighted_degree"))


@plan("""SELECT l_suppkey, l_partkey, count(*) AS weight FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def edge_list(t):
    return t.lineitem.groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("weight")).filter("weight > 1")


STEPS = """WITH RECURSIVE e AS (SELECT n_nationkey AS src, (n_nationkey * 7 + 3) % 25 AS dst FROM nation UNION SELECT n_nationkey, (n_nationkey + 5) % 25 FROM nation WHERE n_nationkey < 10),
    reach AS (SELECT n_nationkey AS seed, n_nationkey AS node, 0 AS hops FROM nation UNION SELECT seed, e.dst, hops + 1 FROM reach r JOIN e ON e.src = r.node WHERE hops < 25),
    d AS (SELECT seed, node, min(hops) AS hops FROM reach GROUP BY ALL)"""


def steps(t):
    n = F.col("n_nationkey")
    return t.nation.select(n.alias("src"), ((n * 7 + 3) % 25).alias("dst")).union(t.nation.filter("n_nationkey < 10").select(n, (n + 5) % 25)).distinct()


def all_nations(t):
    return t.nation.select(F.col("n_nationkey").alias("node"))


@plan(f"{STEPS} SELECT seed, node, hops FROM d")
def shortest_hops(t):
    return G.closure(steps(t), all_nations(t))


@plan(f"{STEPS} SELECT seed AS node, round((count(*) - 1) / sum(hops)::DOUBLE, 6) AS closeness FROM d GROUP BY seed HAVING sum(hops) > 0")
def closeness(t):
    return G.closure(steps(t), all_nations(t)).groupBy(F.col("seed").alias("node")).agg(F.count("*").alias("n"), F.sum("hops").alias("h")).filter("h > 0").select("node", F.round((F.col("n") - 1) / F.col("h"), 6).alias("closeness"))


@plan(f"{STEPS} SELECT a.seed AS node, min(a.node) AS comp FROM d a JOIN d b ON a.seed = b.node AND a.node = b.seed GROUP BY a.seed")
def strong_components(t):
    return G.strong_components(steps(t))


@plan(f"{STEPS} SELECT count(DISTINCT comp) AS n_strong FROM (SELECT a.seed, min(a.node) AS comp FROM d a JOIN d b ON a.seed = b.node AND a.node = b.seed GROUP BY a.seed)")
def strong_component_count(t):
    return G.strong_components(steps(t)).agg(F.countDistinct("comp").alias("n_strong"))


@plan("""WITH b AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)
    SELECT a.l_suppkey AS left_key, c.l_suppkey AS right_key, count(*) AS shared FROM b a JOIN b c USING (l_partkey) WHERE a.l_suppkey < c.l_suppkey GROUP BY ALL""")
def bipartite_projection(t):
    """Suppliers that share parts. Each supplier of a part meets the later ones of its sorted
    list, so a part of n suppliers costs n(n - 1) / 2, which is its share of the result. The
    lists, not the pairs, move to the first supplier's task; there are as many tasks as the
    counted pairs ask for, so neither side holds more than about ``PAIRS`` of them."""
    lists = t.lineitem.filter("l_partkey is not null").groupBy("l_partkey").agg(F.sort_array(F.collect_set("l_suppkey")).alias("s")).filter("size(s) > 1")
    lists = cut(lists, "projection")
    n = lists.agg(F.sum(F.expr("size(s) * (size(s) - 1L) div 2"))).first()[0] or 0
    tasks = max(lists.sparkSession.sparkContext.defaultParallelism, n // PAIRS + 1)
    left = lists.repartition(tasks, "l_partkey").select("s", F.posexplode("s").alias("i", "left_key"))
    later = left.select("left_key", F.slice("s", F.col("i") + 2, F.size("s")).alias("later")).filter("size(later) > 0").repartition(tasks, "left_key")
    pairs = later.select("left_key", F.explode("later").alias("right_key"))
    return pairs.groupBy("left_key", "right_key").agg(F.count("*").alias("shared"))
