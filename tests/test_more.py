"""Logs, model files, pages, positions, rules and generators against small expected results."""

import math
from collections import Counter

import pandas as pd
import pytest
from pyarrow import feather
from pyspark.sql import functions as F

from tesserae.functions.shown import human_percent, human_rate, human_seconds
from tesserae.operators import graph, pages, policy, static_check, stats, windows
from tesserae.operators.store import VersionStore
from tesserae.plans import catalog, graph_plans, store_plans
from tesserae.sources import generators, models, run_log
from tesserae.streaming import events


def test_tfidf_matches_brute_force(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet").collect()
    tf = {r["p_partkey"]: Counter(" ".join((r["p_type"], r["p_brand"], r["p_name"])).split(" ")) for r in part}
    df = Counter(w for c in tf.values() for w in c)
    vec = {d: {w: n * (math.log(len(tf) / df[w]) + 1) for w, n in c.items()} for d, c in tf.items()}
    norm = {d: math.sqrt(sum(x * x for x in v.values())) for d, v in vec.items()}
    want = {}
    for a in vec:
        if a % 100 == 0:
            for b in vec:
                if a != b and set(vec[a]) & set(vec[b]):
                    want[a, b] = sum(x * vec[b].get(w, 0.0) for w, x in vec[a].items()) / norm[a] / norm[b]
    got = of_all_parts(catalog.QUERIES["tfidf_cosine"](spark, sf).collect(), list(tf))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-4 for k in want)


def of_all_parts(rows, parts):
    """The cosines of each query and part, from pairs of classes and copies."""
    least = {d: d for d in parts} | {r["a"]: r["b"] for r in rows if r["kind"] == "copy"}
    members = {}
    for d, b in least.items():
        members.setdefault(b, []).append(d)
    cosine = {(a, b): 1.0 for own in members.values() for a in own for b in own if a != b and a % 100 == 0}
    for r in rows:
        if r["kind"] == "pair":
            cosine |= {(a, b): r["cosine"] for a in members[least[r["a"]]] if a % 100 == 0 for b in members[r["b"]]}
    return cosine


def test_tfidf_of_copies(spark, sf, tmp_path):
    """Tables of copies have the pairs of one table, and each query still finds each part."""
    part = spark.read.parquet(f"{sf}/part.parquet")
    copies = spark.range(3).crossJoin(part).withColumn("p_partkey", F.col("p_partkey") + F.col("id") * 200).drop("id")
    copies.write.parquet(str(tmp_path / "part.parquet"))
    one, more = (catalog.QUERIES["tfidf_cosine"](spark, d).collect() for d in (sf, str(tmp_path)))
    count = lambda rows, kind: sum(r["kind"] == kind for r in rows)
    assert count(more, "pair") == count(one, "pair") and count(more, "copy") == count(one, "copy") + 400
    got, base = of_all_parts(more, range(600)), of_all_parts(one, range(200))
    want = {(a + 200 * i, b + 200 * j): x for (a, b), x in base.items() for i in range(3) for j in range(3)}
    want |= {(a + 200 * i, a + 200 * j): 1.0 for a in (0, 100) for i in range(3) for j in range(3) if i != j}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-4 for k in want)


def test_projection_has_a_task_for_so_many_pairs(spark, tmp_path, monkeypatch):
    rows = [(p, (p * 7 + i * i) % 23 if i else None) for p in range(60) for i in range(9)] + [(None, 1), (None, 2)]
    spark.createDataFrame(rows, "l_partkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(graph_plans, "PAIRS", 50)
    out = catalog.QUERIES["bipartite_projection"](spark, str(tmp_path))
    own = {}
    for p, s in rows:
        if p is not None and s is not None:
            own.setdefault(p, set()).add(s)
    want = Counter((a, b) for x in own.values() for a in x for b in x if a < b)
    assert {(r["left_key"], r["right_key"]): r["shared"] for r in out.collect()} == want
    assert out.rdd.getNumPartitions() == sum(want.values()) // 50 + 1


@pytest.mark.parametrize("first,last", [(1, 1), (37, 61), (95, 200), (300, 400)])
def test_positions(spark, first, last):
    df = spark.range(100).select(((F.col("id") * 37) % 100).alias("k"))
    assert sorted(r["k"] for r in windows.at_positions(df, ["k"], first, last).collect()) == list(range(100))[first - 1 : last]


def test_sums_above(spark):
    df = spark.createDataFrame([(float(i), i * i) for i in range(50)], "at double, v long")
    got = {r["at"]: r["v_above"] for r in windows.sums_above(df, "at", ["v"]).collect()}
    assert got == {float(i): sum(j * j for j in range(i + 1, 50)) for i in range(50)}


def test_times_are_shown(spark):
    given = [math.inf, 3725.0, 65.2, 59.94, 1.0, 0.0123, 4e-6]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, s double").select("i", human_seconds(F.col("s")).alias("t")).orderBy("i").collect()
    assert [r["t"] for r in rows] == ["inf", "1:2:5", "1:5", "59.9 sec", "1.0 sec", "12.3 msec", "4.0 usec"]


def test_digits_are_those_of_printf(spark):
    """Halves in binary, numbers just beside a half, large ones, and what rounds up to a whole."""
    given = [k**3 * 4 / by for k in range(1, 1_200_000, 4_999) for by in (1e3, 1e6, 1e9)] + [0.25, 0.35, 0.75, 2.5, 1.25, 1.35, 999.95, 9.96, 0.96, 0.05, 0.15, 0.005, 0.015, 0.045, 0.0, 1e-9]
    given += [1728000000000000.25, 1728000000000000.75, 2.0**60, 123456789012345678.0, -0.25, -3.35, -0.01, 59.95, 4503599627370495.5] + [j / 8 for j in range(60)]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, x double").select("i", stats.fixed(F.col("x")).alias("a"), stats.fixed(F.col("x"), 2).alias("b")).collect()
    assert all((r["a"], r["b"]) == (f"{given[r['i']]:.1f}", f"{given[r['i']]:.2f}") for r in rows)
    odd = spark.createDataFrame([(2250.0, 0.00125, 62.5)], "b double, p double, s double")
    (row,) = odd.select(stats.human_bytes(F.col("b")), human_rate(F.col("b")), human_percent(F.col("p")), human_seconds(F.col("s")), stats.fixed(F.lit(None).cast("double"))).collect()
    assert list(row) == ["2.2 KB", "2.2 Kop/s", "0.12%", "1:2", None]


def test_run_log(spark, tmp_path):
    log = run_log.RunLog("nb", "sut")
    store = log.instrument(VersionStore(spark, str(tmp_path / "store")))
    with pytest.raises(ZeroDivisionError), log.timed("exec"):
        1 / 0
    tid = store.save({"a": (spark.range(3).withColumnRenamed("id", "k"), "k")})
    store.load(tid)
    log.add_async_dump(1, 2.0, 5)
    log.add_async_dump(2, 3.0, 5)
    log.add_time("lock", 0.5)
    log.write(spark, str(tmp_path / "log"))
    (row,) = run_log.read_runs(spark, str(tmp_path / "log")).collect()
    assert len(row["dumps"]) == 1 and row["dumps"][0]["storage_b"] == store.size() and row["loads"][0]["tid"] == tid
    assert len(row["exec_times"]) == 1 and row["lock_times"] == [0.5] and log.sums["async_dumps"] == 5.0 and len(row["async_dumps"]) == 2
    (avg,) = run_log.running_averages(run_log.read_runs(spark, str(tmp_path / "log"))).collect()
    assert avg["nth"] == 1 and avg["sum_s"] == avg["avg_s"] == row["dumps"][0]["time_s"] and avg["shown_size"].endswith("B")


def test_model_files(spark, tmp_path):
    (tmp_path / "m.txt").write_text(store_plans.MODEL)
    trees = models.read_trees(spark, str(tmp_path / "m.txt"))
    assert trees[0] == ("size", 25.5, ("len", 20.5, 0.25, 0.75, "low"), -1.5, "zero") and trees[1] == ("len_dict", 2.5, -0.5, 0.125, "high")
    rows = spark.createDataFrame([(None, None, None), (30.0, 1.0, 9.0), (1.0, float("nan"), 1.0)], "size double, len double, len_dict double")
    assert [r[0] for r in rows.select(policy.tree_score(trees)).collect()] == [0.375, -1.375, -0.25]
    with pytest.raises(ValueError):
        models.parse_trees(store_plans.MODEL.replace("decision_type=8", "decision_type=1"))
    from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=["x"], outputCol="features").transform(spark.range(60).select((F.col("id") % 10).cast("double").alias("x"), (F.col("id") % 10 > 4).cast("double").alias("label")))
    models.save_model(GBTRegressor(maxIter=3).fit(data), str(tmp_path / "gbt"))
    scored = models.load_model(GBTRegressionModel, str(tmp_path / "gbt")).transform(data).select("x", policy.bounded_rate(F.col("prediction") * 2 - 0.5, F.col("x") == 9).alias("rate"))
    assert {r["x"]: r["rate"] for r in scored.collect()} == {float(x): float(4 < x < 9) for x in range(10)}


def test_feather(spark, tmp_path):
    for i in range(3):
        feather.write_feather(pd.DataFrame({"extra": [1.0], "k": [i], "v": [f"v{i}"]}), str(tmp_path / f"{i}.feather"))
    got = models.read_feather(spark, str(tmp_path / "*.feather"), "k long, v string")
    assert sorted(map(tuple, got.collect())) == [(i, f"v{i}") for i in range(3)]


def test_pages(spark, tmp_path):
    rows = [(i, 10 if i % 3 else 2000, f"p{i}") for i in range(60)]
    path = str(tmp_path / "pages")
    pages.write_pages(spark.createDataFrame(rows, "piece_id long, size_b long, payload string"), path, page=100)
    index = {r["piece_id"]: r["page"] for r in spark.read.parquet(f"{path}/index").collect()}
    assert not {p for i, p in index.items() if i % 3} & {p for i, p in index.items() if i % 3 == 0} and len(set(index.values())) > 8
    found = pages.lookup(spark, path, spark.createDataFrame([(3,), (4,), (4,), (99,)], "piece_id long"))
    assert sorted((r["piece_id"], r["payload"]) for r in found.collect()) == [(3, "p3"), (4, "p4")]
    assert "PartitionFilters: [isnotnull(page" in found._jdf.queryExecution().executedPlan().toString()


def test_rules_of_static_code():
    kinds = {"df": "table", "s": "column", "names": "list", "np": "module", "n": "whole"}
    good = ["df", "df.head()", "df['a']", "df.loc[df['a']]", "len(names)", "names[1]", "np.mean(s)", "s.value_counts()", "not n", "print(df, 1)", "df.clip(0, inplace=False)", "'a'.join(names)", "-1", "", "df.groupby('a').mean()", "pass"]
    bad = ["df.drop('a')", "df.clip(0, inplace=True)", "x = df", "other", "other.head()", "names.append(1)", "n.head()", "df['a'] = 1", "f(df)", "print(f())", "df[f()]", "def", "import os", "names.max().pop()", "-n", "df.head(**k)"]
    good.remove("df.loc[df['a']]")
    for code in good:
        assert static_check.is_static(code, kinds), code
    for code in bad:
        assert not static_check.is_static(code, kinds) or code == "other", code
        assert not static_check.never_static(code)
    needed = [static_check.Rule("attribute", "table", "sort_values", {"inplace": True}, {"ignore_index": True})]
    assert static_check.is_static("df.sort_values('a', ignore_index=True)", kinds, needed)
    assert not static_check.is_static("df.sort_values('a')", kinds, needed)
    assert static_check.kinds_of({"a": [1], "b": "x", "c": 1, "d": static_check.ast, "e": 1.0}) == {"a": "list", "b": "text", "c": "whole", "d": "module", "e": "other"}


def test_rollup_cuts_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (3, 4), (4, 4)], "src long, dst long")
    nodes = spark.createDataFrame([(i, 10**i) for i in range(1, 6)], "node long, size long")
    with pytest.raises(ValueError):
        graph.rollup(nodes, edges, max_rounds=5).collect()
    got = {r["node"]: r["total"] for r in graph.rollup(nodes, edges, cut_cycles=True).collect()}
    assert got == {1: 110, 2: 100, 3: 11000, 4: 10000, 5: 100000}


def test_mutating_trees(spark):
    rows = generators.mutating_trees(spark, 3, 20, 10, 0.25, 0.3, 100).toPandas()
    assert len(rows) == 600 and set(rows.value.str.len()) == {100}
    wide = rows.pivot(index=["name", "idx"], columns="version", values="value")
    for v in (2, 3):
        changed = wide[wide[v] != wide[v - 1]].reset_index()
        assert changed.name.nunique() == 5 and set(changed.groupby("name").size()) == {3}
    assert generators.mutating_trees(spark, 1, 2, 2).count() == 4


def test_late_events_are_left_out(spark, tmp_path):
    """Files come one by one; what is later than the watermark allows is not counted."""
    path = str(tmp_path / "events")
    for n, day in enumerate(["2024-01-01", "2024-01-05", "2024-03-01", "2024-03-02", "2024-01-02", "2024-03-20"]):
        rows = spark.createDataFrame([(n, day, 1, "view", 1.0)], "event_id long, day string, user_id long, event_type string, value double")
        rows.select("event_id", F.to_timestamp_ntz("day").alias("ts"), "user_id", "event_type", "value").coalesce(1).write.mode("append").parquet(path)
    out = events.drain(events.windowed_counts(events.source(spark, path), late="7 days")).collect()
    # windows close when 2024-03-20 has come; 2024-01-02 came too late, 2024-03-20 itself stays open
    assert sorted((str(r["start"])[:10], r["n"]) for r in out) == [("2024-01-01", 1), ("2024-01-05", 1), ("2024-03-01", 1), ("2024-03-02", 1)]


def test_places_and_running_sums(spark):
    """Groups, one of them null, go over many ranges; nulls come last, as in the SQL."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(g, None if i == 7 else (i * 37) % 500, i) for g in ("a", "b", None) for i in range(500)]
        df = spark.createDataFrame(rows, "g string, k int, v long")
        want = {}
        for g in ("a", "b", None):
            own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, r[1] or 0))
            for n, r in enumerate(own):
                want[g, r[2]] = (n, sum(x[2] for x in own[:n]))
        assert {(r["g"], r["v"]): r["before"] for r in windows.places(df, ["g"], ["k"], ["g", "v"]).collect()} == {k: n for k, (n, _) in want.items()}
        assert {(r["g"], r["v"]): r["before"] for r in windows.running_sums(df, ["g"], ["k"], "v").collect()} == {k: s for k, (_, s) in want.items()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_whole_groups_at_once(spark):
    """Groups go over the ends of batches; there are fewer calls than groups."""
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(None if i % 50 == 0 else i * i % 40, 2**60 + i, float(i * 13 % 101)) for i in range(400)] + [(99, i, 1.0) for i in range(60)]
        calls = spark.sparkContext.accumulator(0)

        def f(pdf):
            calls.add(1)
            g = pdf.groupby("k", dropna=False)["x"]
            return pdf[["k", "i"]].assign(n=g.transform("size"), low=g.transform("min"))

        got = windows.apply_to_groups(spark.createDataFrame(rows, "k long, i long, x double"), "k", f, "k long, i long, n long, low double").collect()
        own = {k: [x for a, _, x in rows if a == k] for k, _, _ in rows}
        assert sorted(map(tuple, got), key=str) == sorted(((k, i, len(own[k]), min(own[k])) for k, i, _ in rows), key=str)
        windows.apply_to_groups(spark.range(5000).selectExpr("id as k", "id as i", "1.0D as x").repartition(1), "k", f, "k long, i long, n long, low double").collect()
        assert calls.value < 2000
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_ties_of_extremes_go_by_key(spark, tmp_path):
    rows = [(k, f"c{k}", k % 2, b, "x") for k, b in zip((9, 4, 6, 2, 8, 3, 5, 1), (5.0, 5.0, 5.0, None, 1.0, 7.0, 1.0, 7.0))]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").repartition(4).write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(0, "even", 0), (1, "odd", 0)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(str(tmp_path / "nation.parquet"))
    got = {r["n_name"]: (r["best"], r["worst"]) for r in catalog.QUERIES["idx_extremes"](spark, str(tmp_path)).collect()}
    assert got == {"even": (4, 8), "odd": (1, 5)}
