"""Held-out accuracy, determinism and edge cases of the models; brute force of the rest."""

import base64
import hashlib
import io
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import chat_format, decontaminate, mixing, quality_model, quality_rules, toxicity, warc
from tests.llm.helpers import edge_rows, frame, rows

LABELS = "doc_id long, quality int, toxic int"


def auc(score, y):
    order = np.argsort(np.argsort(score)) + 1
    n1 = y.sum()
    return (order[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


@pytest.fixture(scope="module")
def small():
    return "/root/testdata/sf0.01"


def test_quality_held_out(spark, small):
    out = quality_model.query(spark, small).join(spark.read.parquet(f"{small}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert auc(out.score.to_numpy(), out.quality.to_numpy()) > 0.97
    assert out.score.between(0, 1).all() and (out.predicted == (out.score >= 0.5)).all()


def test_quality_comes_from_the_vectors(spark, small):
    """Each block alone tells most texts apart; the network has no other input."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    vectors = quality_model.word_vectors(docs)
    data = docs.join(spark.read.parquet(f"{small}/labels.parquet"), "doc_id").withColumn("held", quality_model.held_out(3, 1)).toPandas()
    x, y, held = quality_model.Pool(vectors)(data.text.tolist()).astype(float), data.quality.to_numpy(), data.held.to_numpy()
    assert x.shape[1] == quality_model.WIDTH == 3 * quality_model.DIM
    for block, least in ((slice(None), 0.97), (slice(0, 64), 0.85), (slice(64, 128), 0.97)):
        net = quality_model.Network().fit(x[~held][:, block], y[~held])
        assert auc(net.score(x[held][:, block]), y[held]) > least


def test_toxicity_held_out(spark, small):
    out = toxicity.query(spark, small).join(spark.read.parquet(f"{small}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert auc(out.score.to_numpy(), out.toxic.to_numpy()) > 0.75
    assert ((out.score >= 0.3).astype(int) == out.predicted).all()


@pytest.mark.parametrize("module,label", [(quality_model, "quality"), (toxicity, "toxic")])
def test_models_take_edges(spark, module, label):
    docs = frame(spark, edge_rows() + [[r[0] + 100, *r[1:]] for r in rows()]).withColumn("y", F.lit(1))
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(100, 140)] + [(None, 1, 1)], LABELS)
    out = module.with_score(docs, module.fit(docs.select("doc_id", "text"), labels, label)).collect()
    assert len(out) == len(edge_rows()) + 40 and all(0 <= r["score"] <= 1 for r in out)
    empty = {r["score"] for r in out if not (r["text"] or "").strip()}
    assert len(empty) == 1 and out[0]["y"] == 1
    none = labels.filter("false")
    assert {r["score"] for r in module.with_score(docs, module.fit(docs, none, label)).collect()} == {0.5 if label == "quality" else 0.0}
    assert module.with_score(docs.filter("false"), module.fit(docs.filter("false"), labels, label)).count() == 0


def test_restorer_decodes_hidden_words():
    counts = np.zeros(toxicity.SIZE**3)
    for word in ["idiot", "moron", "stupid", "pathetic", "clown", "the", "and"] * 50:
        c = [0, *(toxicity.CODE[x] for x in word), 0]
        for a, b, d in zip([0, *c], c, c[1:], strict=False):
            counts[(a * toxicity.SIZE + b) * toxicity.SIZE + d] += 1
    r = toxicity.Restorer(counts.reshape((toxicity.SIZE,) * 3))
    for hidden, plain in {"1d10t": "idiot", "i d i o t": "idiot", "m0r0n": "moron", "stuuupid": "stupid", "p@thetic": "pathetic", "idiot": "idiot", "": "", "x" * 100 + "1a": "x" * 100 + "1a"}.items():
        assert r.restore(hidden) == plain


def word_counts(words):
    counts = np.zeros((toxicity.SIZE,) * 3)
    for word in words:
        c = [0, 0, *(toxicity.CODE[x] for x in word), 0]
        for g in zip(c, c[1:], c[2:], strict=False):
            counts[g] += 50
    return counts


def test_restorer_decodes_whole_tokens():
    r = toxicity.Restorer(word_counts(["stupid", "worthless", "idiot", "abc"]))
    spaced = " ".join("abc" * 24 + "worthlessidiot")
    assert r.restore(spaced).replace(" ", "") == "abc" * 24 + "worthlessidiot"
    assert r.restore("stu" + "u" * 70 + "pid") == "stupid"
    assert r.restore("a " + "x" * 100 + "1a") == "a " + "x" * 100 + "1a"
    assert len(r.decode("abc1" * 50_000)) >= 150_000


def test_restorer_takes_any_sign_repeat_and_break():
    r = toxicity.Restorer(word_counts(["stupid", "worthless", "idiot", "hate", "you", "a", "clown", "what"] * 3))
    cases = {
        "hat3": "hate", "id107!": "idiot", "worthle$$": "worthless", "stuupid": "stupid", "*idiot*": "idiot", "idiot!!": "idiot", "$tupid,": "stupid,",
        "w h a t a c l o w n": "what a clown", "y o u  i d i o t": "you idiot", "y.o.u i-d-i-o-t": "you idiot", "12 345 + 6": "12 345 + 6", "pão 1": "pão 1",
    }
    for hidden, plain in cases.items():
        assert r.restore(hidden) == plain, hidden
    long = " ".join("worthlessidiot" * 36)
    assert r.restore(long).replace(" ", "") == "worthlessidiot" * 36


def test_restorer_is_linear():
    r = toxicity.Restorer(word_counts(["stupid", "idiot"]))
    for text in ("0" * 1_000_000 + ",a aaa", "0" * 1_000_000, "a1" * 20_000, "x. " * 300_000, "ab" * 500_000, "$" * 500_000 + "a"):
        began = time.process_time()
        r.restore(text)
        assert time.process_time() - began < 5


def test_short_ways_are_the_decoder(small):
    """The tables for one open place give what the whole lattice gives."""
    rng = np.random.default_rng(5)
    counts = np.zeros((toxicity.SIZE,) * 3)
    np.add.at(counts, tuple(rng.integers(0, 12, (3, 4000))), 5)
    r = toxicity.Restorer(counts)
    for _ in range(3000):
        word = "".join(rng.choice(list("abcdefghijk"), rng.integers(1, 8)))
        token = word + rng.choice(["", "!", "$$", "###", "1"])
        if any(c in toxicity.SIGNS for c in token) or toxicity.DOUBLE.search(token):
            assert r.decode(token) == r.best(r.lattice(token)), token


def test_hidden_toxicity_is_found(spark, small):
    """Held-out texts hidden in three ways score as the plain ones, but not without restoration."""
    rng = random.Random(3)
    marked = "idiot moron stupid pathetic worthless garbage".split()
    hide = [
        lambda w: w.translate(str.maketrans("ioatse", "10@7$3")),
        " ".join,
        lambda w: "".join(c * (3 if c in "aeiou" else 1) for c in w),
    ]
    texts = [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").filter("lang = 'en' and n_chars > 800").orderBy("doc_id").limit(240).collect()]
    train, plain, hidden = [], [], []
    for i, text in enumerate(texts):
        words, y = [w for w in text.split()[:120] if not any(m in w.lower() for m in marked)], i % 2
        places = sorted(rng.sample(range(len(words)), 4))  # the others hide harmless words
        picked = [rng.choice(marked if y else words) for _ in places]
        with_words = lambda form, words=words, places=places, picked=picked: " ".join(w + (" " + form(picked[places.index(k)]) if k in places else "") for k, w in enumerate(words))
        if i < 140:
            train.append((i, with_words(str), y))
        else:
            plain.append((i, with_words(str), y))
            hidden += [(1000 * (k + 1) + i, with_words(form), y) for k, form in enumerate(hide)]
    docs = spark.createDataFrame(train, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))

    def area(data, **more):
        out = toxicity.with_score(spark.createDataFrame(data, "doc_id long, text string, toxic int"), model, **more).toPandas()
        return auc(out.score.to_numpy() + 1e-9 * np.random.default_rng(1).random(len(out)), out.toxic.to_numpy())

    assert area(plain) > 0.95
    for k in range(3):
        part = [r for r in hidden if r[0] // 1000 == k + 1]
        assert area(part) > area(plain) - 0.02, k
        assert area(part, restore=False) < 0.7, k


def test_clashing_score_column_is_kept(spark):
    docs = frame(spark, rows()).withColumn("score", F.lit("x")).withColumn("SCORE_input", F.lit("z"))
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], LABELS)
    for module, label in ((toxicity, "toxic"), (quality_model, "quality")):
        out = module.with_score(docs, module.fit(docs, labels, label), "text")
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "score_input_input", "SCORE_input", "score"]
        assert {(r["score_input_input"], r["SCORE_input"]) for r in out.collect()} == {("x", "z")}


def brute_rules(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    hit = {i + k for i, g in enumerate(wins) if wins.count(g) > 1 for k in range(5)} if len(w) < 3000 else None
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), None if hit is None else len(hit)


def test_rules_match_brute_force(spark):
    data = edge_rows() + [[50, "a b c d e f a b c d e f a b c d e x y", "en", "s", 0], [51, "same line #1\nother\nsame line #1\n\n\n", "en", "s", 0], [52, " lead and trail \x0b\x0c ", "en", "s", 0]]
    out = quality_rules.quality_rules(frame(spark, data).withColumn("n_words_old", F.lit(1))).collect()
    for r in out:
        n, chars, symbols, dup, rep = brute_rules(r["text"])
        got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"])
        assert got == (n, chars, symbols, dup) and (rep is None or r["n_repeat_words"] == rep), r["doc_id"]
        assert not (r["base_failed"] and r["kept"])
    assert quality_rules.quality_rules(frame(spark, [])).count() == 0


def brute_leaks(text, items):
    word = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (x or "").translate(str.maketrans(decontaminate.UPPER, decontaminate.LOWER)))
    w, hit, ids = word(text), set(), set()
    for i, t in items:
        v = word(t)
        n = min(10, len(v))
        wins = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
        for p in range(len(w) - n + 1):
            if n and tuple(w[p : p + n]) in wins:
                hit |= set(range(p, p + n))
                ids.add(str(i))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("limit", [100 << 20, 0])
def test_leaks_match_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", limit)
    base = [f"Q{i}" for i in range(40)]
    items = [(1, " ".join(base)), (2, "one two three"), (10, "É2, word"), (3, None), (4, "..."), (5, "solo"), (6, " ".join(base[5:17])), (1, " ".join(base))]
    data = edge_rows() + [[60, "x " + "-".join(b.lower() for b in base[3:20]) + " y " + " ".join(base[12:22]), "en", "s", 0], [61, "é2 word É2 WORD solo", "en", "s", 0], [62, " ".join(base[:9]), "en", "s", 0]]
    docs = frame(spark, data).withColumn("pos", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r[c] for c in decontaminate.COLUMNS[1:]) for r in decontaminate.report(docs, bench).orderBy("doc_id", "n_words").collect()]
    want = [brute_leaks(t, items) for _, t, *_ in data]
    assert sorted(got) == sorted(want)
    kept = decontaminate.remove_documents(docs, bench)
    assert kept.count() == sum(not w[-1] for w in want) and kept.columns == docs.columns
    words = {r["doc_id"]: r["words"] for r in decontaminate.remove_spans(docs.filter("doc_id >= 60"), bench).collect()}
    assert words[60] == ["x", "y"] and words[62] == [b.lower() for b in base[:9]]
    assert decontaminate.report(docs, bench.filter("false")).filter("contaminated").count() == 0
    assert decontaminate.report(frame(spark, []), bench).count() == 0


def test_leaks_are_cut_row_by_row(spark):
    """Null ids and one id over several texts: spans of one text never cut another one."""
    item = [f"q{i}" for i in range(14)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "solo"), (3, " ".join(item[2:12]))], "item_id long, text string")
    texts = [(1, ["a", *item, "b", "solo", "c"], "abc"), (1, ["d", "e", "f"], "def"), (None, ["solo", "g"], "g"), (None, ["h", "i"], "hi"), (None, None, ""), (2, ["solo"], ""), (2, ["solo"], "")]
    docs = spark.createDataFrame([(i, None if w is None else " ".join(w), "x", "y") for i, w, _ in texts], "doc_id long, text string, __k string, __w string")
    got = sorted((str(r["doc_id"]), "".join(r["words"])) for r in decontaminate.remove_spans(docs, bench).collect())
    assert got == sorted((str(i), left) for i, _, left in texts)
    kept = decontaminate.remove_documents(docs, bench)
    assert kept.columns == docs.columns
    assert {(r["doc_id"], r["text"]) for r in kept.collect()} == {(1, "d e f"), (None, "h i"), (None, None)}
    spans = spark.createDataFrame([([(0, 3), (1, 3), (4, 2), (9, 1), (9, 4)],), ([],)], "s array<struct<pos:int,n:int>>")
    merged = [[tuple(x) for x in r[0]] for r in spans.select(decontaminate._merged(F.col("s"))).collect()]
    assert merged == [[(0, 6), (9, 13)], []]


def test_chat_ties_go_by_the_raw_text(spark):
    data = [(1, 0, "user", "Aa"), (1, 0, "user", "<a"), (1, 0, "user", "[b"), (1, 0, "user", "\\c"), (1, 0, "user", "\\b"), (1, 0, "user", "<a")]
    turns = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").select("conv_id", "turn", "role", chat_format.text_part(F.col("text")).alias("parts"))
    (out,) = chat_format.read_back(chat_format.format_chat(turns)).collect()
    assert [t["text"] for t in out["turns"]] == sorted(t for *_, t in data)


def test_rules_keep_clashing_columns(spark):
    docs = frame(spark, rows()).withColumn("kept", F.lit("k")).withColumn("n_words", F.lit("n")).withColumn("__w", F.lit("w"))
    plain = {r["doc_id"]: r for r in quality_rules.quality_rules(frame(spark, rows())).collect()}
    for r in quality_rules.quality_rules(docs).collect():
        assert (r["kept_input"], r["n_words_input"], r["__w_input"]) == ("k", "n", "w")
        assert (r["kept"], r["n_words"]) == (plain[r["doc_id"]]["kept"], plain[r["doc_id"]]["n_words"])


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "\\l \\\\ <|end|>", "", None, "<|turn:assistant|>x<|end|>", "\n\n漢字 \U0001f600 |>"]
    data = [(1, i, ["user", "assistant"][i % 2], t) for i, t in enumerate(texts)] + [(2, None, None, None), (2, 0, "assistant", "b"), (2, 0, "assistant", "a"), (None, 1, "user|><", "z")]
    turns = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    parts = turns.select("conv_id", "turn", "role", chat_format.text_part(F.col("text")).alias("parts"), F.lit(0).alias("body"))
    out = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_chat(parts)).collect()}
    assert [(t["role"], t["text"]) for t in out[1]["turns"]] == [(r, t or "") for _, _, r, t in data[:6]]
    assert out[1]["loss_text"] == "".join(t or "" for i, t in enumerate(texts) if i % 2)
    assert [t["text"] for t in out[2]["turns"]] == ["", "a", "b"] and out[None]["turns"][0]["role"] == "user|><"
    assert all(x not in out[1]["formatted"] for x in ("</s>", "[INST]", "[/INST]"))
    assert chat_format.format_chat(parts.filter("false")).count() == 0


def test_chat_parts(spark):
    data = [(1, 0, "user", [("text", "see", 0), ("image", "a.png", 4), ("audio", "b.wav", 10), ("text", "<x>", 0)]), (1, 1, "assistant", [("document", "c.pdf", 2), ("odd", None, None)])]
    out = chat_format.format_chat(spark.createDataFrame(data, f"conv_id long, turn long, role string, parts {chat_format.PART}")).first()
    assert out["attachments"] == ["a.png", "b.wav", "c.pdf", None] and out["expanded_tokens"] == 4 * 256 + 10 * 25 + 2 * 512
    assert out["formatted"] == "<|turn:user|>see<|image|><|audio|>\\lx><|end|><|turn:assistant|><|document|><|unknown|><|end|>"
    (span,) = out["loss_mask"]
    assert out["formatted"][span["start"] : span["start"] + span["chars"]] == "<|document|><|unknown|>"


def test_warc_round_trip(spark):
    big = "é" * 300_000
    pages = [(1, "u\r\nX: 1", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (5, "u", big), (None, "u", "same"), (7, "u", "\r\n\r\nWARC/1.1")]
    docs = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("path", F.lit("x"))
    manifest = warc.write_archives(docs)
    got = {r["page_id"]: r for r in warc.read_archives(manifest).collect()}
    assert len(got) == 7 and all(r["verified"] for r in got.values())
    assert {k: (r["record_type"], r["refers_to"]) for k, r in got.items()} == {1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None), None: ("revisit", 2), 7: ("response", None)}
    for i, _, html in pages:
        raw = (html or "").encode()
        assert got[i]["payload_bytes"] == len(raw) and got[i]["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
    assert warc.read_archives(warc.write_archives(docs.filter("false"))).count() == 0


def test_warc_manifest_chooses_and_checks(spark):
    docs = spark.createDataFrame([(i, "u", f"page {i % 40}") for i in range(60)], "page_id long, url string, html string")
    manifest = warc.write_archives(docs)
    parts = manifest.collect()
    assert sum(r["records"] for r in parts) == 60
    # what another attempt of a task leaves behind is not in the manifest, so nobody reads it
    folder = parts[0]["path"].rsplit("/", 1)[0].removeprefix("file:")
    with open(f"{folder}/part-000000-999-0000.warc.gz", "wb") as f:
        f.write(warc.encode_record(1, "u", b"page 1"))
    assert warc.read_archives(manifest).count() == 60
    told = manifest.withColumn("records", F.col("records") + 1)
    with pytest.raises(Exception, match="records, not"):
        warc.read_archives(told).collect()
    with open(f"{folder}/bad.warc.gz", "wb") as f:
        plain = zlib.decompress(warc.encode_record(1, "u", b"page 1"), 31).replace(b"page 1", b"page 2")
        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
        f.write(packer.compress(plain) + packer.flush())
    bad = spark.createDataFrame([(f"{folder}/bad.warc.gz", 1, 1)], warc.MANIFEST)
    with pytest.raises(Exception, match="digest"):
        warc.read_archives(bad).collect()
    assert [r["verified"] for r in warc.read_archives(bad, strict=False).collect()] == [False]


def test_warc_reader_rejects_damage():
    one = warc.encode_record(1, "u", b"payload")
    assert [h["X-Page-ID"] for h, _ in warc.iter_records(io.BytesIO(one * 3))] == ["1"] * 3
    with pytest.raises(ValueError):
        list(warc.iter_records(io.BytesIO(one[:-9])))
    plain = zlib.decompress(one, 31).replace(b"Content-Length: ", b"Content-Length: 1")
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    with pytest.raises(ValueError):
        list(warc.iter_records(io.BytesIO(packer.compress(plain) + packer.flush())))


def test_mixing_shares_and_edges(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_DOCS", 3)
    data = [[i, "w " * (5 + i % 7), ["en", "de", None][i % 3], f"src{i % 5}", 0] for i in range(300)] + edge_rows()
    docs = frame(spark, data).withColumn("budget", F.lit(1))
    base = mixing.leaves(docs)
    supply = base.agg(F.sum("n_tokens")).first()[0]
    plan = {(r["domain"], r["lang"], r["source"]): r for r in mixing.budgets(base).collect()}
    total = sum(r["budget"] for r in plan.values())
    assert supply // 2 - 3 * len(plan) <= total <= supply // 2 + 1
    assert all(0 <= r["budget"] <= 3 * r["supply"] for r in plan.values())
    taken = {}
    for r in mixing.mix(docs).collect():
        key = (r["domain"], r["lang"], r["source"])
        taken[key] = taken.get(key, 0) + r["n_tokens"]
    longest = max(len((r[1] or "").split()) for r in data)
    for key, r in plan.items():
        assert taken.get(key, 0) <= r["budget"] < taken.get(key, 0) + longest + 1
    assert mixing.mix(docs, total_tokens=0).count() == 0 and mixing.mix(frame(spark, [])).count() == 0


def test_mixing_takes_other_trees(spark):
    docs = frame(spark, [[i, "w " * 10, "en", f"src{i % 4}", 0] for i in range(400)])
    levels = [mixing.Level("kind", F.when(F.col("source") < "src2", "a").otherwise("b"), {"a": 3}), mixing.Level("leaf", F.col("source"), {"src1": 4, "src3": 2})]
    got = {(r["kind"], r["leaf"]): r["n"] for r in mixing.mix(docs, total_tokens=1200, levels=levels).groupBy("kind", "leaf").agg(F.sum("n_tokens").alias("n")).collect()}
    assert got == {("a", "src0"): 180, ("a", "src1"): 720, ("b", "src2"): 100, ("b", "src3"): 200}
    with pytest.raises(ValueError):
        mixing.mix(docs, levels=[mixing.Level("leaf", F.col("source"), {"src1": 0})])


def test_mixing_gives_shortage_to_siblings_first(spark):
    nodes = spark.createDataFrame([("a", 1, 10, 100), ("b", 1, 500, 100), ("c", 2, 500, 100)], "name string, weight bigint, cap bigint, parent_budget bigint")
    assert {r["name"]: r["budget"] for r in mixing.share_out(nodes, [], "name").collect()} == {"a": 10, "b": 30, "c": 60}
