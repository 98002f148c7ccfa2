"""Operators on hand-made frames: nulls, ties, duplicates, empty input, cycles."""

import json

import pytest
from pyspark.sql import functions as F

from tesserae.functions import shown
from tesserae.operators import graph as G
from tesserae.operators import policy as P
from tesserae.operators import stats as S
from tesserae.operators import windows as X
from tesserae.operators.store import VersionStore
from tesserae.sources import files


def edges(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long")


def nodes(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "node long")


def test_closure_takes_cycles_self_edges_and_nulls(spark):
    e = edges(spark, [(1, 2), (2, 1), (2, 2), (2, 3), (2, 3), (None, 3), (4, None)])
    got = {(r["seed"], r["node"]): r["hops"] for r in G.closure(e, nodes(spark, [1, 4, 4])).collect()}
    assert got == {(1, 1): 0, (1, 2): 1, (1, 3): 2, (4, 4): 0}
    assert G.closure(e.filter("false"), nodes(spark, [1])).count() == 1
    assert G.closure(e, nodes(spark, [])).count() == 0


def test_components_cut_at_immutable(spark):
    # a-b, c-b, d-e, f-g with g immutable, 0-a where 0 is the root that joins nothing
    e = edges(spark, [(1, 2), (3, 2), (4, 5), (6, 7), (0, 1)]).filter("src <> 0 and dst <> 7")
    got = dict(G.components(nodes(spark, range(8)), e).collect())
    assert got == {0: 0, 1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7}


def test_components_of_a_long_chain(spark):
    got = dict(G.components(nodes(spark, range(60)), edges(spark, [(i, i + 1) for i in range(59)])).collect())
    assert set(got.values()) == {0}


def test_strong_components_and_rollup(spark):
    got = dict(G.strong_components(edges(spark, [(1, 2), (2, 3), (3, 1), (3, 4), (5, 5)])).collect())
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    assert G.strong_components(edges(spark, [])).count() == 0
    sized = spark.createDataFrame([(1, 1), (2, 10), (3, 100), (4, 1000)], "node long, size long")
    up = {r["node"]: (r["total"], r["paths"]) for r in G.rollup(sized, edges(spark, [(1, 2), (1, 3), (2, 4), (3, 4)])).collect()}
    assert up == {1: (2111, 5), 2: (1010, 2), 3: (1100, 2), 4: (1000, 1)}
    assert G.rollup(sized.filter("false"), edges(spark, [(1, 2), (None, 1)])).count() == 0
    with pytest.raises(ValueError, match="cycle"):
        G.rollup(sized, edges(spark, [(1, 2), (2, 1)]), max_rounds=2)


def test_wide_joins_of_graphs_are_not_broadcast(spark):
    """A row a node may be millions of rows in a small file."""
    n = spark.range(200).select(F.col("id").alias("node"), F.lit(1).cast("bigint").alias("size"))
    e = spark.range(1, 200).select((F.col("id") % 7).alias("src"), (F.col("id") + 7).alias("dst"))
    for out in (G.rollup(n, e), G.closure(e, n.select("node")), G.components(n.select("node"), e), G.strong_components(e, few=0)):
        out.collect()
        assert "BroadcastHashJoin" not in str(out._jdf.queryExecution().executedPlan())
    # the rounds themselves
    seen, real = [], G.cut_any
    try:
        G.cut_any = lambda df, *a: (seen.append(df), real(df, *a))[1]
        G.rollup(n, e).count(), G.closure(e, n.select("node")).count()
    finally:
        G.cut_any = real
    assert any("SortMergeJoin" in str(df._jdf.queryExecution().executedPlan()) for df in seen)
    assert not any("BroadcastHashJoin" in str(df._jdf.queryExecution().executedPlan()) for df in seen)


def test_strong_components_equal_mutual_reach(spark):
    # cycles joined by one-way edges, a chain, a cycle inside a larger one, repeats, nulls
    rows = [(1, 2), (2, 1), (2, 3), (3, 4), (4, 5), (5, 3), (5, 6), (6, 7), (7, 8), (8, 6), (8, 7), (8, 9), (9, 10), (10, 11), (12, 1), (20, 21), (21, 20), (20, 21), (None, 1), (3, None), (9, 9)]
    reach = {a: {a} for r in rows if None not in r for a in r}
    for _ in reach:
        for a, b in rows:
            for seen in reach.values():
                if a in seen and b is not None:
                    seen.add(b)
    want = {a: min(b for b in reach[a] if a in reach[b]) for a in reach}
    for few in (0, 4, 10_000):
        assert dict(G.strong_components(edges(spark, rows), few).collect()) == want


@pytest.mark.parametrize("row,bundle,split,action", [((1000, 100, 0.0, 0.0), 1200, 2400, "bundle"), ((1000, 100, 1.0, 1.0), 2300, 3500, "bundle"), ((100000, 100, 0.0, 0.1), 11210, 2410, "split"), ((12000, 0, 0.0, 0.1), 2400, 2400, "bundle")])
def test_greedy_costs(spark, row, bundle, split, action):
    args = [F.lit(float(x)) for x in row]
    got = spark.range(1).select(P.bundle_cost(*args).alias("b"), P.split_cost(*args).alias("s")).first()
    assert got["b"] == pytest.approx(bundle) and got["s"] == pytest.approx(split)
    assert ("bundle" if got["b"] <= got["s"] else "split") == action


def test_policies(spark):
    kinds = spark.createDataFrame([("int", 0), ("list", 0), ("list", 1), ("str", 0), ("odd", 0), (None, 0)], "k string, d int")
    got = [r[0] for r in kinds.select(P.type_policy(F.col("k"), ["int"], ["list", "str"], ["str"], F.col("d"))).collect()]
    assert got == ["bundle", "split", "split_final", "split_final", "bundle", "bundle"]
    bits = spark.range(5).select(P.fixed_policy(F.lit(0b10110), F.col("id"))).collect()
    assert [r[0] for r in bits] == ["bundle", "split", "split", "bundle", "split"]
    fold = spark.createDataFrame([(1, 1, 100000.0, 0.0), (1, 2, 100.0, 0.1), (1, 3, 50.0, 0.0)], "group_id long, position long, size double, rate double")
    assert [r["action"] for r in P.greedy_fold(fold).orderBy("position").collect()] == ["bundle", "split", "bundle"]


def test_store_round_trip(spark, tmp_path):
    store = VersionStore(spark, str(tmp_path / "store"))
    x = spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], "k long, v string")
    y = spark.createDataFrame([(7, "z")], "k long, v string")
    t1 = store.save({"x": (x, "k")})
    size = store.size()
    t2 = store.save({"y": (y, "k")})
    t3 = store.save({"x": (x.withColumn("v", F.col("v")), "k")})
    assert (t1, t2, t3) == (1, 2, 3)
    new = {r["tid"]: (r["n_names"], r["n_new"]) for r in store.read("commits").collect()}
    assert new == {1: (1, 2), 2: (2, 1), 3: (2, 0)}  # an unchanged table adds nothing
    assert store.size() > size and sorted(r["name"] for r in store.load(2).select("name").distinct().collect()) == ["x", "y"]
    for tid in (1, 2, 3):
        assert sorted(map(tuple, store.rows(tid, "x", "k long, v string").collect()), key=str) == sorted(map(tuple, x.collect()), key=str)
    assert store.load(1, ["y", "missing"]).count() == 0
    store.save_async({"x": (x.filter("k = 1"), "k")})
    store.join()
    assert store.rows(4, "x", "k long, v string").count() == 2 and store.rows(3, "x", "k long, v string").count() == 3
    assert store.read("synonyms").filter("tid = 3").count() == 2


def test_windows(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 1.0), ("a", 3, None), ("a", 4, 4.0), ("b", 1, None)], "g string, i int, v double")
    args = (["g"], ["i"])
    got = df.select("g", "i", X.forward_fill("v", *args).alias("f"), X.back_fill("v", *args).alias("b"), X.rolling("v", *args, 2, least=1).alias("m")).orderBy("g", "i").collect()
    assert [r["f"] for r in got] == [None, 1.0, 1.0, 4.0, None] and [r["b"] for r in got] == [1.0, 1.0, 4.0, 4.0, None]
    assert [r["m"] for r in got] == [None, 1.0, 1.0, 4.0, None]
    assert [r["v_filled"] for r in X.interpolate(df, ["g"], "i", "v").orderBy("g", "i").collect()] == [None, 1.0, 2.5, 4.0, None]
    left = spark.createDataFrame([("a", 5, 1), ("a", 0, 2), ("c", 5, 3)], "g string, i int, id int")
    assert {r["id"]: r["v"] for r in X.as_of_join(left, df, ["g"], "i", "v").collect()} == {1: 4.0, 2: None, 3: None}
    ranges = spark.createDataFrame([(1, 0, 25), (2, 9, 9)], "r int, low int, high int")
    points = spark.createDataFrame([(0,), (9,), (25,), (26,)], "p int")
    assert sorted((r["p"], r["r"]) for r in X.range_join(points, ranges, "p", "low", "high", 10).collect()) == [(0, 1), (9, 1), (9, 2), (25, 1)]
    ewm = X.ewm_mean(spark.createDataFrame([(1, 1, 2.0), (1, 2, 4.0)], "g int, i int, v double"), ["g"], "i", "v", 3).orderBy("o").collect()
    assert [round(r["ewm"], 6) for r in ewm] == [2.0, round((2 * 0.5 + 4) / 1.5, 6)]


def test_statistics(spark):
    df = spark.createDataFrame([("a", float(v), i) for i, v in enumerate([1, 2, 2, 3, 100])], "g string, v double, i int")
    (b,) = S.box_plot(df, ["g"], "v").collect()
    assert (b["q1"], b["median"], b["q3"], b["whisker_low"], b["whisker_high"], b["highest"]) == (2, 2, 3, 1, 3, 100)
    assert [r["percent"] for r in S.ecdf(df, ["g"], "v", "i").orderBy("v", "i").collect()] == [20, 40, 60, 80, 100]
    got = spark.createDataFrame([(0.0,), (0.5,), (0.999,), (1.0,)], "p double").select(S.histogram(F.col("p"), 10, 0.0, 1.0)).collect()
    assert [r[0] for r in got] == [0, 5, 9, 9]
    said = spark.range(1).select(shown.human_seconds(F.lit(3661.0)), shown.human_seconds(F.lit(0.5)), shown.human_percent(F.lit(0.05)), shown.human_bytes(F.lit(1500.0))).first()
    assert list(said) == ["1:1:1", "500.0 msec", "5.00%", "1.5 KB"]
    name = spark.range(1).select(shown.parse_piece_name(shown.piece_name(F.lit(3), F.lit(9))).alias("p")).first()["p"]
    assert (name["tid"], name["oid"]) == (3, 9)


def test_sources(spark, tmp_path):
    (tmp_path / "runs.json").write_text(json.dumps({"nb": "n", "sut": "s", "dumps": [{"nth": 0, "time_s": 1.0, "storage_b": 5}, {"nth": 1, "time_s": 2.0, "storage_b": 9}], "loads": [{"nth": 0, "tid": 1, "time_s": 0.1, "load_b": 3}], "exec_times": [0.5, 0.6], "lock_times": [0.0, 0.1], "join_times": [0.7]}) + "\n")
    runs = files.read_runs(spark, str(tmp_path / "runs.json"))
    assert files.flat_loads(runs).first()["tid"] == 1
    assert [r["join_s"] for r in files.aligned(runs).orderBy("idx").collect()] == [0.0, 0.7]
    (tmp_path / "m.txt").write_text("# c\n 1 2.5\n\n3   4\n")
    assert [r["values"] for r in files.read_matrix(spark, str(tmp_path / "m.txt")).collect()] == [[1.0, 2.5], [3.0, 4.0]]
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, s string").coalesce(1)
    files.write_csv(df, str(tmp_path / "c"))
    assert files.read_csvs(spark, [str(tmp_path / "c")], "i int, s string").count() == 2
    files.write_text_table(df, str(tmp_path / "t"), " & ", " \\\\")
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "t")).collect()) == ["1 & a \\\\", "2 & nan \\\\"]
    (tmp_path / "j.json").write_text('{"i": 1}\nbroken\n')
    assert files.read_json_lines(spark, str(tmp_path / "j.json"), "i int").count() == 2
    files.write_nowhere(df)


@pytest.mark.parametrize("code,still", [("df.head()", True), ("len(df[df.a > 1])", True), ("df.drop('a', inplace=True)", False), ("df['a'] = 1", False), ("x = 1", False), ("df.append(1)", False), ("f(x)", False), ("a +", False), ("", True), ("df.fillna(**k)", False), ("x if y else -z", True), ("[i for i in x]", False)])
def test_static_check(code, still):
    from tesserae.operators.static_check import changes_nothing

    assert changes_nothing(code) == still


def test_generator_feeds_the_store(spark, tmp_path):
    from tesserae.sources.generators import mutating_lists

    lists = mutating_lists(spark, 3, 4, 10, 0.5, 0.5).cache()
    assert lists.count() == 3 * 4 * 10
    store = VersionStore(spark, str(tmp_path / "g"))
    for v in (1, 2, 3):
        store.save({"lists": (lists.filter(F.col("version") == v).select("name", "idx", "value").withColumn("k", F.substring("name", 3, 9).cast("long")), "k")})
    new = [r["n_new"] for r in store.read("commits").orderBy("tid").collect()]
    assert new[0] == 4 and all(n <= 4 for n in new) and sum(new) < 12
    names = mutating_lists(spark, 2, 3, 5, 0.0, 1.0)
    assert names.filter("version = 1").drop("version").exceptAll(names.filter("version = 2").drop("version")).count() == 0


def test_cut_and_purge(spark):
    from tesserae import runtime

    runtime.purge(spark)
    for df, which, want in ((spark.range(0), None, False), (spark.range(5), None, True), (spark.range(5), F.col("id") > 9, False), (spark.range(5).filter("id > 9").distinct(), None, False)):
        out, some = runtime.cut_any(df, "any", which)
        assert some is want and out.count() == df.count()
        runtime.discard(out)
    kept = runtime.cut(spark.range(5), "kept")
    gone = runtime.cut(spark.range(3), "gone")
    assert kept.count() == 5 and gone.count() == 3
    runtime.discard(gone)
    assert runtime.purge(spark) == 1 and runtime.purge(spark) == 0
