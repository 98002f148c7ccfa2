"""Plans that save and load through the version store itself."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tesserae.functions.shown import human_rate, human_seconds
from tesserae.operators import graph as G
from tesserae.operators.pages import lookup, write_pages
from tesserae.operators.static_check import check_codes
from tesserae.operators.store import VersionStore
from tesserae.operators.tracker import ChangeTracker
from tesserae.plans import store_plans
from tesserae.plans.registry import plan
from tesserae.runtime import shared_dir
from tesserae.sources import run_log

CUSTOMER = "c_custkey long, c_name string, c_acctbal double, c_mktsegment string"
SUPPLIER = "s_suppkey long, s_name string, s_acctbal double"


def store(t) -> VersionStore:
    return VersionStore(t.spark, f"{shared_dir(t.spark)}/store-{uuid.uuid4().hex}")


def customer(t):
    return t.customer.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")


@plan("SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def store_save_load(t):
    s = store(t)
    tid = s.save({"customer": (customer(t), "c_custkey"), "supplier": (t.supplier.select("s_suppkey", "s_name", "s_acctbal"), "s_suppkey")})
    return s.rows(tid, "customer", CUSTOMER)


@plan("SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal > 0")
def store_time_travel(t):
    """The first of three versions, after two that changed or dropped its rows."""
    s = store(t)
    tid = s.save({"customer": (customer(t).filter("c_acctbal > 0"), "c_custkey")})
    s.save({"customer": (customer(t).withColumn("c_acctbal", F.col("c_acctbal") * 2), "c_custkey")})
    s.save({"customer": (customer(t).filter("false"), "c_custkey")})
    return s.rows(tid, "customer", CUSTOMER)


@plan("""SELECT 'supplier' AS name, count(*) AS n, 2::BIGINT AS saved_at FROM supplier
    UNION ALL SELECT 'nation', count(*), 1 FROM nation""")
def store_partial_load(t):
    """Two of three names of the second version, which wrote only one of them."""
    s = store(t)
    s.save({"customer": (customer(t), "c_custkey"), "supplier": (t.supplier.filter("s_suppkey > 1"), "s_suppkey"), "nation": (t.nation, "n_nationkey")})
    tid = s.save({"supplier": (t.supplier, "s_suppkey")})
    at = s.namemap(tid).select("name", "piece_id", "piece_tid")
    loaded = s.load(tid, ["supplier", "nation", "no_such_name"]).select("name", "piece_id")
    return loaded.join(at, ["name", "piece_id"]).groupBy("name").agg(F.count("*").alias("n"), F.max("piece_tid").alias("saved_at"))


@plan("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def store_dump(t):
    s = store(t)
    s.save({"nation": (t.nation, "n_nationkey")})
    return s.load_dump(s.dump(t.supplier.select("s_suppkey", "s_name", "s_acctbal"), "s_suppkey"), SUPPLIER)


@plan("""SELECT 1::BIGINT AS tid, 1::BIGINT AS n_names, count(DISTINCT o_custkey) AS n_new FROM orders WHERE o_orderstatus = 'F'
    UNION ALL SELECT 2, 2, count(DISTINCT o_custkey) + (SELECT count(*) FROM nation) FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT 3, 2, 0""")
def store_new_pieces(t):
    """What three versions wrote: only objects whose content was not there before."""
    s, orders = store(t), t.orders.select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")
    s.save({"orders": (orders.filter("o_orderstatus = 'F'"), "o_custkey")})
    s.save({"orders": (orders, "o_custkey"), "nation": (t.nation, "n_nationkey")})
    s.save({"orders": (orders.orderBy(F.desc("o_orderkey")), "o_custkey")})
    return s.read("commits").select("tid", "n_names", "n_new")


@plan("SELECT c_custkey AS piece_id, c_name AS payload FROM customer WHERE c_custkey % 100 = 0")
def paged_lookup(t):
    path = f"{shared_dir(t.spark)}/pages-{uuid.uuid4().hex}"
    write_pages(t.customer.select(F.col("c_custkey").alias("piece_id"), F.length("c_name").cast("long").alias("size_b"), F.col("c_name").alias("payload")), path, small=1024, page=1000)
    return lookup(t.spark, path, t.customer.filter("c_custkey % 100 = 0").select(F.col("c_custkey").alias("piece_id"))).select("piece_id", "payload")


@plan(f"""WITH {store_plans.BASE}, h AS (SELECT tid, oid, min(tid) OVER (PARTITION BY content_hash) = tid AS changed FROM pieces WHERE tid IN (1, 2, 4))
    SELECT oid, count(*) AS seen, count(*) FILTER (WHERE changed) AS changed FROM h GROUP BY oid""")
def tracked_scope(t):
    """Dumps of the versions 1, 2 and 4; the third one comes while tracking is off."""
    tracker, p = ChangeTracker(), store_plans.pieces(t)
    with tracker.on():
        tracker.dump(p.filter("tid = 1"))
        tracker.dump(p.filter("tid = 2"))
    tracker.dump(p.filter("tid = 3"))
    with tracker.on():
        tracker.dump(p.filter("tid = 4"))
    return tracker.counts()


CODES = ["frame.head(3)", "frame.set_index('a', inplace=True)", "frame['a']", "print(frame)", "frame.drop('a')", "x = 1", "other.head()", "names[0]", "not count", "frame.a = 2", "len(names)", "frame.groupby('a').sum()"]


@plan(f"SELECT p_partkey, CASE p_partkey % {len(CODES)} {' '.join(f'WHEN {i} THEN {ok}' for i, ok in enumerate([True, False, True, True, False, False, False, True, True, False, True, True]))} END AS static FROM part")
def static_code(t):
    """Which cells of a notebook change nothing, by the table of rules and kinds of names."""
    kinds = {"frame": "table", "names": "list", "count": "whole"}
    codes = t.part.select("p_partkey", F.element_at(F.array(*map(F.lit, CODES)), (F.col("p_partkey") % len(CODES) + 1).cast("int")).alias("code"))
    return check_codes(codes, "code", kinds).select("p_partkey", "static")


@plan("""WITH s AS (SELECT p_partkey, (p_partkey * p_partkey * p_partkey)::DOUBLE / 7e6 AS s FROM part)
    SELECT p_partkey, CASE WHEN s >= 3600 THEN printf('%d:%d:%d', floor(s / 3600)::INT, floor((s % 3600) / 60)::INT, round_even(s % 60, 0)::INT) WHEN s >= 60 THEN printf('%d:%d', floor(s / 60)::INT, round_even(s % 60, 0)::INT)
      WHEN s >= 1 THEN printf('%.1f sec', s) WHEN s >= 1e-3 THEN printf('%.1f msec', s * 1e3) ELSE printf('%.1f usec', s * 1e6) END AS shown,
      CASE WHEN 7e12 * s >= 1e9 THEN printf('%.1f Gop/s', 7e12 * s / 1e9) WHEN 7e12 * s >= 1e6 THEN printf('%.1f Mop/s', 7e12 * s / 1e6) WHEN 7e12 * s >= 1e3 THEN printf('%.1f Kop/s', 7e12 * s / 1e3) ELSE printf('%.1f op/s', 7e12 * s) END AS rate FROM s""")
def format_durations(t):
    k = F.col("p_partkey")
    s = t.part.select("p_partkey", ((k * k * k).cast("double") / 7e6).alias("s"))
    return s.select("p_partkey", human_seconds(F.col("s")).alias("shown"), human_rate(7e12 * F.col("s")).alias("rate"))


@plan("""WITH d AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth, o_totalprice / 1e6 AS s FROM orders)
    SELECT o_custkey::VARCHAR AS nb, nth::INT AS nth, round(sum(s) OVER w, 6) AS sum_s, round(sum(s) OVER w / nth, 6) AS avg_s FROM d WINDOW w AS (PARTITION BY o_custkey ORDER BY nth ROWS UNBOUNDED PRECEDING)""")
def run_log_averages(t):
    """The running sums and means that a run's log shows, over runs of one customer each."""
    one = F.struct(F.col("o_orderkey"), F.struct(F.lit(0).alias("nth"), (F.col("o_totalprice") / 1e6).alias("time_s"), F.lit(1).cast("bigint").alias("storage_b")).alias("d"))
    runs = t.orders.groupBy(F.col("o_custkey").cast("string").alias("nb")).agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["d"]).alias("dumps")).withColumn("sut", F.lit("all"))
    return run_log.running_averages(runs).select("nb", "nth", F.round("sum_s", 6).alias("sum_s"), F.round("avg_s", 6).alias("avg_s"))


@plan("""WITH e AS (SELECT n_nationkey AS src, n_nationkey + 1 AS dst FROM nation WHERE n_nationkey % 5 < 4 UNION ALL SELECT n_nationkey, n_nationkey - 1 FROM nation WHERE n_nationkey % 5 = 1)
    SELECT n_nationkey::BIGINT AS node, CASE n_nationkey % 5 WHEN 0 THEN 1 ELSE 5 - n_nationkey % 5 END::BIGINT AS total FROM nation""")
def rollup_cut_cycles(t):
    """Chains of five nations whose first two point at each other: that cycle is cut, so the
    first one has itself only."""
    n = F.col("n_nationkey").cast("bigint")
    e = t.nation.filter("n_nationkey % 5 < 4").select(n.alias("src"), (n + 1).alias("dst")).unionByName(t.nation.filter("n_nationkey % 5 = 1").select(n.alias("src"), (n - 1).alias("dst")))
    return G.rollup(t.nation.select(n.alias("node"), F.lit(1).cast("bigint").alias("size")), e, cut_cycles=True).select("node", "total")
