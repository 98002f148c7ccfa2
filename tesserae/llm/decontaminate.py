"""Benchmark decontamination: scan the word windows of documents against the windows of
a benchmark, verify each hit word by word, and report or remove what was hit.

The windows of the benchmark are broadcast if their summed bytes fit
``BROADCAST_BYTES``; beyond that the same join shuffles. Only built-in functions are
used. The scan looks up a hash of the first three words of each window; a hit counts
only if all words of the window are equal.

doc_id with the text identifies a row: rows that repeat get equal results, and the texts
of null or shared ids are told apart. Null text has no words and is clean. Items without
words have no window. An empty benchmark leaves every document clean. Other columns are
kept, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import as_row
from tesserae.runtime import cut

WIDTH = 10
ANCHOR = 3
#: Most bytes of windows (words, items that have them, 64 a row) that each executor gets.
BROADCAST_BYTES = 100 << 20
#: What stands between words.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of digits, ASCII letters in lower case and anything beyond ASCII."""
    raw = F.coalesce(text, F.lit(""))
    # lower() is far quicker than translate(), and the same for plain ASCII
    lowered = F.when(F.octet_length(raw) == F.length(raw), F.lower(raw)).otherwise(F.translate(raw, UPPER, LOWER))
    return F.filter(F.split(lowered, GAPS), lambda x: x != "")


def benchmark_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """One row for each distinct window: n (its words), body, items (who has it)."""
    w = items.select(F.col(item_id).cast("string").alias("item"), words(F.col(text)).alias("w")).filter(F.size("w") > 0)
    w = w.withColumn("n", F.least(F.size("w"), F.lit(width)))
    starts = F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)
    rows = w.select("item", "n", F.explode(F.transform(starts, lambda i: F.slice("w", i, F.col("n")))).alias("g"))
    body = F.array_join("g", " ")
    return (
        rows.groupBy("n", body.alias("body")).agg(F.sort_array(F.collect_set("item")).alias("items"), F.first("g").alias("g"))
    )


def find_hits(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs has __key, __w; a row for each occurrence: __key, pos (from 0), n, items."""
    windows = cut(benchmark_windows(items, width=width), "benchmark-windows")
    cost = F.octet_length("body") * 2 + F.aggregate("items", F.lit(64), lambda n, x: n + F.octet_length(x) + 16)
    sizes = {r["k"]: r["c"] for r in windows.groupBy(F.least("n", F.lit(ANCHOR)).alias("k")).agg(F.sum(cost).alias("c")).collect()}  # at most three rows
    total = sum(sizes.values())
    found = []
    for k in sorted(sizes):
        side = windows.filter(F.least("n", F.lit(ANCHOR)) == k).select("n", "body", "items", F.xxhash64(*[F.col("g")[i] for i in range(k)]).alias("a"))
        scan = docs.select("__key", "__w", F.posexplode("__w").alias("pos", "word"))
        anchor = F.xxhash64("word", *[F.get("__w", F.col("pos") + i) for i in range(1, k)])
        if total <= BROADCAST_BYTES:
            side = F.broadcast(side)
            scan = scan.withColumn("__a", anchor)
            whole = F.array_join(F.slice("__w", F.col("pos") + 1, F.col("n")), " ") == F.col("body")
        else:  # rows move: each carries its own window, not its text
            scan = scan.select("__key", "pos", anchor.alias("__a"), F.slice("__w", F.col("pos") + 1, F.lit(width)).alias("__g"))
            whole = F.array_join(F.slice("__g", F.lit(1), F.col("n")), " ") == F.col("body")
        found.append(scan.join(side, (scan["__a"] == side["a"]) & whole).select("__key", "pos", "n", "items"))
    if not found:
        return docs.select("__key", F.lit(0).alias("pos"), F.lit(0).alias("n"), F.array(F.lit("")).alias("items")).limit(0)
    return reduce(DataFrame.unionByName, found)


def _covered(hits: Column) -> Column:
    """Words inside the union of sorted (pos, n) spans."""
    return F.aggregate(
        hits,
        F.struct(F.lit(0).alias("c"), F.lit(0).alias("end")),
        lambda a, h: F.struct((a["c"] + F.greatest(F.lit(0), h["pos"] + h["n"] - F.greatest(a["end"], h["pos"]))).alias("c"), F.greatest(a["end"], h["pos"] + h["n"]).alias("end")),
        lambda a: a["c"],
    )


def report(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, text`` -> doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans."""
    keyed = docs.select("doc_id", "text", F.struct(F.col("doc_id").alias("d"), F.xxhash64("text").alias("t")).alias("__key"))
    scan = keyed.select("__key", words(F.col("text")).alias("__w"))
    hits = find_hits(scan, items, width)
    per = hits.groupBy("__key").agg(
        F.sort_array(F.collect_set(F.struct("pos", "n"))).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("ids"),
    )
    per = per.select(F.col("__key.d").alias("__d"), F.col("__key.t").alias("__t"), "spans", "ids")
    base = keyed.select("doc_id", F.col("__key.t").alias("__t"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    joined = base.join(per, base["doc_id"].eqNullSafe(per["__d"]) & (base["__t"] == per["__t"]), "left")
    no_ids = F.coalesce("ids", F.array().cast("array<string>"))
    return joined.select(
        "doc_id", "n_words",
        F.coalesce(_covered(F.col("spans")), F.lit(0)).cast("long").alias("n_hit"),
        F.size(no_ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(no_ids, ","), 256).alias("items_sha256"),
        F.col("spans").isNotNull().alias("contaminated"),
        F.coalesce("spans", F.array().cast("array<struct<pos:int,n:int>>")).alias("spans"),
    )


def _keyed(docs: DataFrame) -> DataFrame:
    """__row with all columns, doc_id, text and __key, which tells texts apart."""
    return as_row(docs).withColumn("__key", F.struct(F.col("doc_id").alias("d"), F.xxhash64("text").alias("t")))


def remove_documents(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` without those that hold a window of the benchmark; all columns stay."""
    keyed = _keyed(docs)
    scan = keyed.select("__key", words(F.col("text")).alias("__w"))
    bad = find_hits(scan, items, width).select(F.col("__key.d").alias("__d"), F.col("__key.t").alias("__t")).distinct()
    kept = keyed.join(bad, keyed["__key.d"].eqNullSafe(bad["__d"]) & (keyed["__key.t"] == bad["__t"]), "left_anti")
    return kept.select("__row.*")


def _merged(spans: Column) -> Column:
    """Sorted (pos, n) spans as sorted (pos, end) that neither meet nor touch."""
    none = F.array().cast("array<struct<pos:int,end:int>>")
    last = lambda a: F.element_at(a, -1)
    joined = lambda a, s: F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(last(a)["pos"].alias("pos"), F.greatest(last(a)["end"], s["pos"] + s["n"]).alias("end"))))
    more = lambda a, s: F.array_append(a, F.struct(s["pos"].alias("pos"), (s["pos"] + s["n"]).alias("end")))
    return F.aggregate(spans, none, lambda a, s: F.when((F.size(a) > 0) & (F.get(a, F.size(a) - 1)["end"] >= s["pos"]), joined(a, s)).otherwise(more(a, s)))


def remove_spans(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, words: the words of each row outside every hit span, in order. Spans are merged
    first, and the gaps between them are sliced out, so the work is linear in both."""
    keyed = _keyed(docs.select("doc_id", "text")).select("doc_id", "__key", words(F.col("text")).alias("__w"))
    per = find_hits(keyed, items, width).groupBy("__key").agg(F.sort_array(F.collect_set(F.struct("pos", "n"))).alias("__s"))
    per = per.select(F.col("__key.d").alias("__d"), F.col("__key.t").alias("__t"), _merged(F.col("__s")).alias("__s"))
    joined = keyed.join(per, keyed["__key.d"].eqNullSafe(per["__d"]) & (keyed["__key.t"] == per["__t"]), "left")
    from_ = F.concat(F.array(F.lit(0)), F.transform("__s", lambda x: x["end"]))
    to = F.concat(F.transform("__s", lambda x: x["pos"]), F.array(F.size("__w")))
    gaps = F.zip_with(from_, to, lambda a, b: F.slice("__w", a + 1, b - a))
    return joined.select("doc_id", F.when(F.col("__s").isNull(), F.col("__w")).otherwise(F.flatten(gaps)).alias("words"))


COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return report(docs, items).select(*COLUMNS)


def oracle() -> str:
    word = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {word} AS w FROM documents),
    b AS (SELECT item_id, {word} AS w FROM benchmark),
    bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i+n-1], ' ') AS g
           FROM (SELECT item_id, w, least(len(w), {WIDTH}) AS n, unnest(range(1, len(w) - least(len(w), {WIDTH}) + 2)) AS i FROM b WHERE len(w) > 0)),
    ns AS (SELECT DISTINCT n FROM bw),
    dw AS (SELECT rid, n, i, array_to_string(w[i:i+n-1], ' ') AS g
           FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
    h AS (SELECT rid, i, n, item_id FROM dw JOIN bw USING (n, g)),
    c AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM h) GROUP BY rid),
    it AS (SELECT rid, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS sha
           FROM (SELECT DISTINCT rid, item_id::VARCHAR AS s FROM h) GROUP BY rid)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
           coalesce(sha, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
    FROM d LEFT JOIN c USING (rid) LEFT JOIN it USING (rid)"""
