"""The join and the dedup operators against brute force."""

import random
import time
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import jaccard_join as jj
from tesserae.llm import line_dedup as ld
from tesserae.llm import substring_dedup as sd
from tesserae.llm.common import join_skewed
from tests.llm.helpers import DOCS, edge_rows, frame, rows, words


def shingle_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_classes(data):
    """doc_id -> (class, links to documents, links to other word sequences)."""
    docs = {i: t for i, t, *_ in data if i is not None}
    sets = {i: shingle_set(t) for i, t in docs.items()}
    seq = {i: tuple((t or "").lower().split()) for i, t in docs.items()}
    comp, links, texts = {i: i for i in docs}, dict.fromkeys(docs, 0), {i: set() for i in docs}
    for a, b in combinations(sorted(docs), 2):
        x, y = sets[a], sets[b]
        if x and y and len(x & y) >= 0.8 * len(x | y):
            links[a] += 1
            links[b] += 1
            if seq[a] != seq[b]:
                texts[a].add(seq[b])
                texts[b].add(seq[a])
            low, high = sorted((comp[a], comp[b]))
            comp = {k: low if v == high else v for k, v in comp.items()}
    return {i: (comp[i], links[i], len(texts[i])) for i in docs}


def near_data(seed, groups, size, base=60):
    rng = random.Random(seed)
    out, n = [], 0
    for _ in range(groups):
        w = words(rng, base)
        for _ in range(size):
            v = list(w)
            for _ in range(rng.randrange(0, 3)):
                v[rng.randrange(len(v))] = f"new{rng.randrange(10**6)}"
            out.append([n, " ".join(v), "en", "src0", 0])
            n += 1
    return out


@pytest.mark.parametrize("groups,size", [(12, 6), (1, 90)])
def test_join_matches_brute_force(spark, groups, size):
    data = near_data(3, groups, size) + [[1000 + i, t, *x] for i, t, *x in rows(5, 30)]
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["n_text_links"]) for r in jj.similarity_classes(frame(spark, data)).collect()}
    assert got == brute_classes(data)


def test_join_blocks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(jj, "SMALL", 4)
    monkeypatch.setattr(jj, "BLOCK", 8)
    data = near_data(9, 2, 45)
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["n_text_links"]) for r in jj.similarity_classes(frame(spark, data)).collect()}
    assert got == brute_classes(data)


def test_join_edges(spark):
    got = jj.similarity_classes(frame(spark, edge_rows())).collect()
    assert len(got) == len(edge_rows())
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[0]["class_id"] == 0 and by[1]["n_links"] == 0 and by[2]["n_links"] == 0
    assert {r["class_id"] for r in got if r["doc_id"] is None} == {4, None}
    assert jj.similarity_classes(frame(spark, [])).count() == 0
    data = near_data(3, 2, 5)
    kept = jj.keep_one(frame(spark, data).withColumnRenamed("lang", "rep"))
    want = sorted(i for i, (c, _, _) in brute_classes(data).items() if c == i)
    assert sorted(r["doc_id"] for r in kept.collect()) == want and "rep" in kept.columns


def test_keep_one_decides_text_by_text(spark):
    rng = random.Random(6)
    a, b, c, d, e = (" ".join(words(rng, 40)) for _ in range(5))
    near = d.rsplit(" ", 1)[0] + " other"
    data = [[1, a], [None, a], [None, b], [None, b], [2, a], [2, c], [3, c], [3, c], [None, d], [None, near], [5, e], [5, e], [None, None], [None, ""]]
    kept = jj.keep_one(frame(spark, [[*r, "en", "s", 0] for r in data])).collect()
    got = sorted(((r["doc_id"], r["text"]) for r in kept if r["text"] not in (d, near)), key=str)
    assert got == sorted([(1, a), (None, b), (2, c), (5, e), (None, None), (None, "")], key=str)
    assert sum(r["text"] in (d, near) for r in kept) == 1
    links = sorted((r["n_links"], r["n_text_links"]) for r in jj.similarity_classes(frame(spark, [[*r, "en", "s", 0] for r in data])).collect())
    assert links == sorted([(2, 0)] * 3 + [(1, 0)] * 2 + [(2, 0)] * 3 + [(1, 1)] * 2 + [(1, 0)] * 2 + [(0, 0)] * 2)


def test_runs_reach_the_recall():
    assert jj.missed(jj.RUNS) <= 1 - jj.RECALL < jj.missed(jj.RUNS - 1)
    rng = np.random.default_rng(2)
    e = jj.Embedding()
    lost = 0
    for _ in range(4000):
        a, b = rng.integers(0, 1000, jj.TOKENS).astype(np.uint64), rng.integers(1000, 2000, jj.TOKENS).astype(np.uint64)
        same = rng.random(jj.TOKENS) < jj.SIMILARITY
        b[same] = a[same]
        lost += not (e.paths(a)[:, -1] == e.paths(b)[:, -1]).any()
    assert lost <= 3


def test_heavy_keys_join_as_others(spark):
    left = spark.createDataFrame([(i % 7 if i % 3 else 100, i) for i in range(900)], "k long, i long")
    side = spark.createDataFrame([(k, sum((i % 7 if i % 3 else 100) == k for i in range(900))) for k in (0, 1, 2, 100)], "k long, n long")
    for total in (0, 10**5, 10**6, 10**9):
        for how in ("inner", "left"):
            got = sorted(map(tuple, join_skewed(left, side, ["k"], "n", total, how).collect()), key=str)
            assert got == sorted(map(tuple, left.join(side, "k", how).collect()), key=str)


def test_other_columns_of_any_kind_are_kept(spark):
    """Maps cannot be compared, and names may be those the operators use."""
    rng = random.Random(21)
    a, b = (" ".join(words(rng, 40)) for _ in range(2))
    plain = frame(spark, [[1, a, "", "", 0], [1, a, "", "", 0], [2, b, "", "", 0], [None, b, "", "", 0], [None, b + " more", "", "", 0]]).select("doc_id", "text")
    docs = plain.withColumn("__row", F.create_map(F.lit("k"), F.rand(1))).withColumn("__p", F.lit(7)).withColumn("__o", F.array(F.lit(1))).withColumn("p", F.lit(None).cast("string"))
    for f in (jj.keep_one, ld.dedup_lines):
        out = f(docs)
        assert out.columns == docs.columns
        kept = out.collect()
        assert {r["doc_id"] for r in kept} >= {1, 2} and all(r["__p"] == 7 and r["__o"] == [1] and set(r["__row"]) == {"k"} for r in kept)
    assert len(jj.keep_one(docs).collect()) == 2


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = dict(jj.components(edges).collect())
    assert all(got[i] == 0 for i in range(1, 41)) and got[101] == 100


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return a == b
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i:] == b[i + 1 :] or (len(a) == len(b) and a[i + 1 :] == b[i + 1 :])


def brute_lines(data):
    seen, out = [], {}
    for i, text, *_ in sorted(data, key=lambda r: r[0]):
        drop = []
        for n, line in enumerate((text or "").split("\n")):
            x = ld.normal(line)
            if not x:
                continue
            if any(x == y or (min(len(x), len(y)) >= ld.MIN_CHARS and one_edit(x, y)) for y in seen):
                drop.append(n)
            seen.append(x)
        out[i] = drop
    return out


def line_data(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcde ") for _ in range(rng.randrange(8, 90))).strip() or "a" for _ in range(25)]
    out = []
    for i in range(60):
        lines = []
        for _ in range(rng.randrange(1, 5)):
            x = list(rng.choice(base))
            for _ in range(rng.randrange(0, 3)):
                k = rng.randrange(len(x) + 1)
                kind = rng.randrange(3)
                x[k : k + (kind > 0)] = [] if kind == 2 else [rng.choice("abcdeZ")]
                x = x or ["a"]
            lines.append("".join(x))
        out.append([i, "\n".join(lines), "en", "src0", 0])
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_lines_match_brute_force(spark, seed):
    data = line_data(seed)
    got = {r["doc_id"]: r["dropped"] for r in ld.report(frame(spark, data)).collect()}
    assert got == brute_lines(data)


def test_variants_meet_exactly_at_one_edit():
    rng = random.Random(4)
    for _ in range(400):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 14)))
        b = "".join(rng.choice("ab") for _ in range(max(1, len(a) + rng.randrange(-1, 2))))
        meet = bool(np.intersect1d(ld.variants(a, 0), ld.variants(b, 0)).size)
        assert meet == one_edit(a, b), (a, b)
        if one_edit(a, b):
            assert set(ld.half_variants(a)) & set(ld.half_variants(b))
            assert np.intersect1d(ld.variants(a, 3), ld.variants(b, 3)).size


def test_line_edges(spark):
    out = ld.report(frame(spark, edge_rows()))
    assert out.count() == len({r[0] for r in edge_rows()})
    assert ld.report(frame(spark, [])).count() == 0
    docs = frame(spark, [[1, "a line that is long enough\nown line of the first", "en", "s", 0], [2, "A  line that is long enough\nsomething else entirely here", "en", "s", 0], [3, "a line that is long enough", "en", "s", 0], [4, None, "en", "s", 0]])
    kept = {r["doc_id"]: r["text"] for r in ld.dedup_lines(docs.withColumnRenamed("lang", "line")).collect()}
    assert kept == {1: "a line that is long enough\nown line of the first", 2: "something else entirely here", 4: None}


def test_lines_are_dropped_text_by_text(spark):
    a, b, c, d, e = (f"line {k} that is long enough {k * 9}" for k in "abcde")
    data = [[1, a], [None, f"{a}\n{b}"], [None, c], [None, d], [None, f"{d}\nown"], [4, f"{a}\n{e}"], [4, f"{e[:-1]}x y z\nmore"], [None, None], [None, c]]
    docs = frame(spark, [[*r, "en", "s", 0] for r in data])
    kept = [(r["doc_id"], r["text"]) for r in ld.dedup_lines(docs).collect()]
    # of the two texts of null ids that hold d, the one with the least hash keeps it
    either = [[(None, d), (None, "own")], [(None, f"{d}\nown")]]
    rest = [(1, a), (None, b), (None, c), (4, e), (4, f"{e[:-1]}x y z\nmore"), (None, None)]
    assert any(sorted(kept, key=str) == sorted(rest + two, key=str) for two in either)
    rows4 = sorted((r["n_lines"], r["dropped"]) for r in ld.report(docs).filter("doc_id = 4").collect())
    assert rows4 == [(2, []), (2, [0])]


def test_many_lines_go_in_one_pass(spark):
    every = [f"{'x' * (k % 50)} line {k} of a long text" for k in range(20_000)]
    docs = frame(spark, [[1, "\n".join(every[::2]), "en", "s", 0], [2, "\n".join(every), "en", "s", 0], [3, "\n\n" + every[0] + "\n\nnew one\n", "en", "s", 0]])
    near = ld.near_lines  # numbers differ by one digit, which is one edit
    began = time.time()
    try:
        ld.near_lines = lambda placed, distinct: distinct.select("h1").limit(0)
        kept = {r["doc_id"]: r["text"] for r in ld.dedup_lines(docs).collect()}
    finally:
        ld.near_lines = near
    assert kept == {1: "\n".join(every[::2]), 2: "\n".join(every[1::2]), 3: "\n\n\nnew one\n"} and time.time() - began < 60


def test_gear_hash_depends_on_32_bytes():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 256, 300, dtype=np.uint8), rng.integers(0, 256, 300, dtype=np.uint8)
    b[100:] = a[100:]
    x, y = sd.gear_hash(a, sd.gear_table()), sd.gear_hash(b, sd.gear_table())
    assert (x[131:] == y[131:]).all()
    slow = 0
    for c in a[:200]:
        slow = ((slow << 1) + int(sd.gear_table()[c])) % 2**32
    assert slow == int(x[199])


def test_substring_spans(spark):
    rng = random.Random(8)
    passage = " ".join(words(rng, 80))
    data = [[i, " ".join(words(rng, 60)) + " " + (passage if i in (3, 7, 11) else "") + " " + " ".join(words(rng, 60)), "en", "s", 0] for i in range(14)]
    data.append([20, data[5][1], "en", "s", 0])
    docs = frame(spark, data)
    got = {r["doc_id"]: r for r in sd.report(docs).collect()}
    assert {i for i, r in got.items() if r["removed_bytes"]} == {7, 11, 20}
    assert all(got[i]["removed_words"] >= 55 and got[i]["spans"][0]["first_doc"] == 3 for i in (7, 11))
    assert got[20]["removed_bytes"] == got[20]["n_bytes"]
    clean = {r["doc_id"]: r["text"] for r in sd.remove_spans(docs, sd.repeated_spans(docs)).collect()}
    assert clean[20] == "" and clean[3] == data[3][1] and len(clean[7]) == len(data[7][1]) - got[7]["removed_bytes"]


def test_substring_matches_brute_force(spark):
    data = near_data(2, 4, 5, 120)
    gear, seen, want = sd.gear_table(), {}, {}
    for i, text, *_ in data:
        raw, last, marks = text.encode(), 0, []
        for end in sd.boundaries(raw, gear):
            chunk, old = raw[last:end], seen.setdefault(raw[last:end], (i, last))
            marks.append((chunk, old != (i, last)))
            last = end
        assert b"".join(c for c, _ in marks) == raw
        want[i] = sum(len(c) for c, dup in marks if dup)
    got = {r["doc_id"]: r["removed_bytes"] for r in sd.report(frame(spark, data), min_words=0).collect()}
    assert got == want


def test_substring_spans_stay_in_their_text(spark):
    """Null ids and an id of two texts: spans of one text never cut another one."""
    rng = random.Random(12)
    own = [" ".join(words(rng, 60)) for _ in range(9)]
    passage = " ".join(words(rng, 80))
    data = [[1, f"{own[0]} {passage}"], [None, f"{own[1]} {passage} {own[2]}"], [None, own[3]], [5, own[4]], [5, f"{passage} {own[5]}"], [5, own[6]], [7, own[7]], [7, own[7]], [None, None], [8, own[7]]]
    docs = frame(spark, [[*r, "en", "s", 0] for r in data]).withColumnRenamed("lang", "__p").withColumnRenamed("source", "__s")
    clean = sd.remove_spans(docs, sd.repeated_spans(docs.select("doc_id", "text")))
    assert clean.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in clean.collect()]
    whole = [(1, data[0][1]), (None, own[3]), (5, own[4]), (5, own[6]), (7, own[7]), (7, own[7]), (None, None), (8, "")]
    assert len(got) == len(data) and all(r in got for r in whole)
    cut = [t for i, t in got if t and (i, t) not in whole]
    assert len(cut) == 2 and all(len(t) < len(passage) * 2.6 for t in cut)
    assert any(t.startswith(own[1][:300]) and t.endswith(own[2][-300:]) for t in cut) and any(t.endswith(own[5][-300:]) for t in cut)
    by = sorted((str(r["doc_id"]), r["removed_bytes"] > 400, [s["first_doc"] for s in r["spans"] or []]) for r in sd.report(docs).collect())
    assert [x for x in by if x[1]] == [("5", True, [1]), ("8", True, [7]), ("None", True, [1])]


def test_substring_without_blanks(spark):
    rng = random.Random(13)
    blob = "".join(rng.choice("abcdefghijklmnop") for _ in range(3000))
    got = {r["doc_id"]: r["removed_bytes"] for r in sd.report(frame(spark, [[1, blob, "", "", 0], [2, "x" + blob, "", "", 0], [3, "short one", "", "", 0], [4, "short one", "", "", 0]])).collect()}
    assert got[1] == got[3] == 0 and got[2] > 2800 and got[4] == 9


def test_substring_edges(spark):
    out = sd.report(frame(spark, edge_rows())).collect()
    short = [r for r in out if r["n_bytes"] == 13]  # 4 has it twice, the null id once more
    assert sorted((r["doc_id"] is None, r["removed_bytes"]) for r in short) == [(False, 0), (True, 13)]
    assert {r["doc_id"] for r in out} == {r[0] for r in edge_rows()} and [r["removed_bytes"] for r in out if r["doc_id"] == 0] == [0]
    assert sd.report(frame(spark, [])).count() == 0
    assert DOCS
