"""Namespaces, commits, whole-table stores and notebook readers."""

import json

import pytest
from pyspark.sql import functions as F

from tesserae.operators.namespace import Namespace
from tesserae.operators.snapshots import SnapshotStore
from tesserae.operators.store import Folder, Memory, VersionStore
from tesserae.sources import notebooks

SCHEMA = "k long, v string"


def table(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def test_namespace_tracks_uses():
    ns = Namespace({"a": (None, "k"), "b": (None, "k")})
    assert ns.active == {"a", "b"}
    ns.active.clear()
    assert "a" in ns and len(ns) == 2 and list(ns) == ["a", "b"] and not ns.active
    with ns.untracked():
        ns["a"], ns.get("b")
    assert not ns.active
    ns.get("b")
    assert ns.active == {"b"}
    ns.pop("b")
    assert not ns.active and "b" not in ns
    with pytest.raises(KeyError):
        ns["b"]


def test_commit_writes_active_new_and_connected_names(spark, tmp_path):
    store = VersionStore(spark, str(tmp_path / "store"))
    ns = Namespace({n: (table(spark, (1, n)), "k") for n in "abc"})
    # a and b hang together from version 1 on; ids are hashes of name and key
    ids = [spark.range(1).select(F.xxhash64(F.lit(n), F.lit(1).cast("long"))).first()[0] for n in "ab"]
    edge = spark.createDataFrame([(ids[0], 1, ids[1])], "piece_id long, dep_tid long, dep_id long")
    assert store.save(ns.tables("abc"), edges=edge) == 1
    assert {r["piece_id"] for r in store.namemap(1).filter("name <> 'c'").collect()} == set(ids)
    ns.active.clear()
    assert store.commit(ns) == 2  # nothing is active
    assert {r["piece_tid"] for r in store.namemap(2).collect()} == {1}
    ns["a"] = (table(spark, (1, "new")), "k")
    del ns["c"]
    ns["d"] = (table(spark, (4, None)), "k")
    tid = store.commit(ns, exclude={"d"}, wait=False)
    store.join()
    assert tid == 3 and {r["name"]: r["piece_tid"] for r in store.namemap(3).collect()} == {"a": 3, "b": 3}
    assert ns.active == {"d"}  # it was left out, so it is still to be saved
    many = {(r["version"], r["name"]): r["payload"] for r in store.load_many({1: ["a", "x"], 3: None}).collect()}
    assert set(many) == {(1, "a"), (3, "a"), (3, "b")} and "new" in many[3, "a"]


def rows_of(store, tid, name):
    return sorted(map(tuple, store.rows(tid, name, SCHEMA).collect()), key=str)


@pytest.mark.parametrize("kind", ["folder", "memory"])
def test_a_failed_save_leaves_nothing(spark, tmp_path, monkeypatch, kind):
    """Each write fails in turn; the retry loads what it was given, and later ones too."""
    tables = Folder(spark, str(tmp_path / "store")) if kind == "folder" else Memory(spark)
    store = VersionStore(spark, tables)
    store.save({"a": (table(spark, (1, "old")), "k")})
    edge = spark.createDataFrame([(1, 1, 1)], "piece_id long, dep_tid long, dep_id long")
    real = store._write
    for n, broken in enumerate(["pieces", "synonyms", "namemap", "edges", "commit"]):
        given = {"a": (table(spark, (1, f"new{n}"), (2, "same"), (3, "same")), "k"), "b": (table(spark, (1, f"new{n}")), "k")}

        def fail(name, *args, broken=broken):
            real(name, *args)
            if name == broken:
                raise OSError(broken)

        monkeypatch.setattr(store, "_write", fail)
        if broken == "commit":
            monkeypatch.setattr(tables, "commit", lambda *a: (_ for _ in ()).throw(OSError("commit")))
        with pytest.raises(OSError, match=broken):
            store.save(given, edges=edge)
        monkeypatch.undo()
        assert [r["tid"] for r in store.versions().collect()] == list(range(1, n + 2))
        tid = store.save(given, edges=edge)
        assert tid == n + 2 and rows_of(store, tid, "a") == [(1, f"new{n}"), (2, "same"), (3, "same")] and rows_of(store, tid, "b") == [(1, f"new{n}")]
        assert rows_of(store, 1, "a") == [(1, "old")]
    # a piece holds its key, so that "same" of 2 and of 3 differ, and a and b share the first
    assert [r["n_new"] for r in store.read("commits").orderBy("tid").collect()] == [1, 3, 1, 1, 1, 1]


def test_two_writers_do_not_share_a_version(spark, tmp_path):
    one, two = (VersionStore(spark, str(tmp_path / "store")) for _ in range(2))
    two.next_tid = lambda: 1
    assert one.save({"a": (table(spark, (1, "x")), "k")}) == 1
    with pytest.raises(Exception, match="(?i)exist"):
        two.save({"a": (table(spark, (1, "y")), "k")})
    del two.next_tid
    assert two.save({"a": (table(spark, (1, "y")), "k")}) == 2
    assert rows_of(one, 1, "a") == [(1, "x")] and rows_of(one, 2, "a") == [(1, "y")]


def test_dump_is_not_carried_on(spark, tmp_path):
    store = VersionStore(spark, str(tmp_path / "store"))
    store.save({"a": (table(spark, (1, "x")), "k")})
    tid = store.dump(table(spark, (5, "y"), (5, None)), "k")
    assert sorted(map(tuple, store.load_dump(tid, SCHEMA).collect()), key=str) == [(5, "y"), (5, None)]
    after = store.save({})
    assert [r["name"] for r in store.namemap(after).collect()] == ["a"]


def test_failed_async_save_raises_on_join(spark, tmp_path):
    store = VersionStore(spark, str(tmp_path / "store"))
    store.save_async({"a": (table(spark, (1, "x")), "no_such_column")})
    with pytest.raises(Exception, match="no_such_column"):
        store.join()
    store.join()
    ns = Namespace({"a": (table(spark, (1, "x")), "no_such_column")})
    with pytest.raises(Exception, match="no_such_column"):
        store.commit(ns)
    assert ns.active == {"a"}
    assert store.save({"a": (table(spark, (1, "x")), "k")}) == 1


@pytest.mark.parametrize("mode", ["copy", "delta"])
def test_snapshots(spark, tmp_path, mode):
    store = SnapshotStore(spark, str(tmp_path / mode), mode)
    first, second = table(spark, (1, "a"), (1, "a"), (2, None)), table(spark, (1, "a"), (3, "c"))
    assert [store.save({"x": first, "y": first}), store.save({"x": second}), store.save({"x": first.filter("false")})] == [1, 2, 3]
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(store.load(1)["x"]) == rows(first) and rows(store.load(2)["x"]) == rows(second) and rows(store.load(3)["x"]) == []
    assert set(store.load(1, ["y", "z"])) == {"y"} and set(store.load(2)) == {"x"}
    store.save({"x": first.select("k")})
    assert store.load(4)["x"].columns == ["k"] and store.size() > 0
    again = SnapshotStore(spark, str(tmp_path / mode), mode)
    assert rows(again.load(2)["x"]) == rows(second) and again.save({"y": second}) == 5 and rows(again.load(5)["y"]) == rows(second)


def test_nothing_is_kept(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "none"), "nothing")
    assert store.save({"x": table(spark, (1, "a"))}) == 1 and store.load(1) == {} and store.size() == 0
    with pytest.raises(ValueError):
        SnapshotStore(spark, "x", "other")


def test_notebooks(spark, tmp_path):
    book = {"cells": [{"cell_type": "code", "source": ["a = 1\n", "b = 2"]}, {"cell_type": "markdown", "source": "# t"}, {"cell_type": "code", "source": "[1, 2]"}, {"cell_type": "code", "source": ""}]}
    (tmp_path / "a.ipynb").write_text(json.dumps(book))
    (tmp_path / "b.ipynb").write_text("no notebook")
    (tmp_path / "c.py").write_text("x = 1\ny = 2\n")
    got = sorted((r["cell"], r["source"]) for r in notebooks.read_notebooks(spark, str(tmp_path / "*.ipynb")).collect())
    assert got == [(0, "a = 1\nb = 2"), (1, "[1, 2]"), (2, "")]
    assert [(r["cell"], r["source"]) for r in notebooks.read_scripts(spark, str(tmp_path / "*.py")).collect()] == [(0, "x = 1\ny = 2\n")]
