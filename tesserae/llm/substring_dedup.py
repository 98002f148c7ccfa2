"""Substring dedup: content-defined chunks from a gear rolling hash, deduplicated by digest.

A chunk ends where the gear hash of the last 32 bytes has its top bits zero, so an
insertion moves no boundary beyond its own chunk. A chunk is a repeat if its digest
stands in an earlier text (by place: the doc_id, see ``with_place`` for null and shared
ids) or earlier in its own. Repeats that follow each other make one span; a span is
removed if it has ``min_words`` words or ``min_bytes`` bytes (for text without blanks),
or if it is the whole text; so common short lines stay.

The earliest holder of a digest is a minimum and is aggregated before the shuffle; no
group of equal chunks is ever brought together. Equal rows of one id, or of the null id,
are one text. Null or empty text has no chunk. Other columns are kept, whatever their
names. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import as_row, join_skewed, with_place
from tesserae.runtime import cut, cut_any, tune

#: A boundary needs BITS zero bits: chunks of about MIN_BYTES + 2 ** BITS bytes.
BITS, MIN_BYTES, MAX_BYTES = 5, 24, 1024
MIN_WORDS, SPAN_BYTES = 20, 400
CHUNK = "p long, seq int, start int, length int, words int, d1 long, d2 long, again boolean, last boolean"


def gear_table() -> np.ndarray:
    return np.random.default_rng(11).integers(0, 2**32, 256, dtype=np.uint32)


def gear_hash(data: np.ndarray, gear: np.ndarray) -> np.ndarray:
    """The hash behind each byte over the 32 bytes up to it, by doubling its width."""
    h = gear[data]
    for k in (1, 2, 4, 8, 16):
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    return h


def boundaries(raw: bytes, gear: np.ndarray) -> list[int]:
    """Ends of the chunks of ``raw``."""
    n = len(raw)
    if not n:
        return []
    found = np.flatnonzero(gear_hash(np.frombuffer(raw, np.uint8), gear) < np.uint32(2 ** (32 - BITS))) + 1
    ends, last = [], 0
    for at in found.tolist():
        while at - last > MAX_BYTES:
            last += MAX_BYTES
            ends.append(last)
        if at - last >= MIN_BYTES:
            last = at
            ends.append(at)
    while n - last > MAX_BYTES:
        last += MAX_BYTES
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def chunks(placed: DataFrame) -> DataFrame:
    """__p, text -> the chunks of each text, by their bytes in UTF-8."""
    tune(placed.sparkSession)

    def split(batches):
        gear = gear_table()
        for batch in batches:
            cols: list[list] = [[] for _ in range(9)]
            for p, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                ends = boundaries(raw, gear)
                if not ends:
                    continue
                blank = np.frombuffer(raw, np.uint8) <= 32
                starts_word = ~blank
                starts_word[1:] &= blank[:-1]
                words = np.concatenate([[0], np.cumsum(starts_word)])
                edges = np.array([0, *ends])
                digests = [xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
                both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                first: set[bytes] = set()
                again = [d in first or first.add(d) for d in digests]
                for col, values in zip(cols, ([p] * len(ends), range(len(ends)), edges[:-1].tolist(), np.diff(edges).tolist(), np.diff(words[edges]).tolist(), both[:, 0].tolist(), both[:, 1].tolist(), map(bool, again), [False] * (len(ends) - 1) + [True]), strict=True):
                    col.extend(values)
                if len(cols[0]) > 50_000:
                    yield pack(cols)
                    cols = [[] for _ in range(9)]
            yield pack(cols)

    def pack(cols):
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["p", "seq", "start", "length", "words", "d1", "d2", "again", "last"])

    return placed.select("__p", "text").mapInArrow(split, CHUNK)


def _spans(placed: DataFrame, min_words: int, min_bytes: int) -> DataFrame:
    """p, start, length (bytes), words, first (place of the earliest holder) of each span."""
    every = cut(chunks(placed), "substring-chunks")
    held = every.groupBy("d1", "d2").agg(F.min("p").alias("first"), F.max("p").alias("last_p"))
    held = held.filter("first < last_p").select("d1", "d2", "first")
    joined = every.join(held, ["d1", "d2"], "left")
    repeats = joined.filter(F.col("again") | (F.col("p") > F.col("first")))
    # equal rows of one place give each chunk twice
    repeats = repeats.groupBy("p", "seq", "start", "length", "words", "last").agg(F.min(F.coalesce("first", "p")).alias("first"))
    # consecutive numbers less their rank are one island
    spans = repeats.withColumn("__g", F.col("seq") - F.row_number().over(Window.partitionBy("p").orderBy("seq")))
    spans = spans.groupBy("p", "__g").agg(
        F.min("start").alias("start"), F.sum("length").cast("int").alias("length"), F.sum("words").cast("int").alias("words"), F.min("first").alias("first"), F.max("last").alias("last")
    )
    whole = (F.col("start") == 0) & F.col("last")
    return spans.filter((F.col("words") >= min_words) | (F.col("length") >= min_bytes) | whole).select("p", "start", "length", "words", "first")


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, min_bytes: int = SPAN_BYTES) -> DataFrame:
    """doc_id, text_hash, start, length (bytes), words, first_doc, first_hash of each span to
    remove; the hash tells apart the texts of one id."""
    placed = with_place(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    spans = cut(_spans(placed, min_words, min_bytes), "substring-spans")
    names = placed.select("__p", "doc_id", F.xxhash64("text").alias("text_hash")).distinct()
    met = names.join(spans.select(F.col("p").alias("__p")).unionByName(spans.select(F.col("first").alias("__p"))).distinct(), "__p", "left_semi")
    met = cut(met, "substring-names")
    own = spans.join(met.withColumnRenamed("__p", "p"), "p")
    first = met.select(F.col("__p").alias("first"), F.col("doc_id").alias("first_doc"), F.col("text_hash").alias("first_hash"))
    return own.join(first, "first").select("doc_id", "text_hash", "start", "length", "words", "first_doc", "first_hash")


def remove_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with the spans cut out of the texts that they were found in."""
    per = spans.groupBy(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__t")).agg(F.sort_array(F.collect_set(F.struct("start", "length"))).alias("__s"))
    held = as_row(docs)
    joined = held.join(per, held["doc_id"].cast("long").eqNullSafe(per["__d"]) & (F.xxhash64(held["text"]) == per["__t"]), "left")
    raw = F.col("__row.text").cast("binary")
    kept = F.aggregate(
        "__s",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<binary>").alias("parts")),
        lambda a, s: F.struct((s["start"] + s["length"]).alias("at"), F.array_append(a["parts"], F.substring(raw, a["at"] + 1, s["start"] - a["at"])).alias("parts")),
        lambda a: F.array_append(a["parts"], F.substring(raw, a["at"] + 1, F.octet_length(raw))),
    )
    # bytes that a cut inside a character leaves are dropped by the decoder
    text = F.array_join(F.transform(kept, lambda b: F.call_function("try_validate_utf8", b.cast("string"))), "")
    return joined.select(F.when(F.col("__s").isNull(), F.col("__row")).otherwise(F.col("__row").withField("text", text)).alias("__row")).select("__row.*")


def report(docs: DataFrame, min_words: int = MIN_WORDS, min_bytes: int = SPAN_BYTES) -> DataFrame:
    """One row a text of each id: doc_id, n_bytes, removed_bytes, removed_words, n_spans, spans."""
    placed = with_place(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    base = placed.groupBy("__p").agg(F.min("doc_id").alias("doc_id"), F.max(F.coalesce(F.octet_length("text"), F.lit(0))).cast("long").alias("n_bytes"))
    spans = cut(_spans(placed, min_words, min_bytes), "substring-spans")
    # a holder's id is its place, but for null and shared ids
    other, some = cut_any(placed.filter(~F.col("doc_id").eqNullSafe(F.col("__p"))).select(F.col("__p").alias("first"), F.col("doc_id").alias("__id")).distinct(), "substring-names")
    if some:
        named = cut(spans.groupBy("first").agg(F.count("*").alias("__n")).join(other, "first").withColumn("__met", F.lit(True)), "substring-holders")
        spans = join_skewed(spans, named, ["first"], "__n", spans.count(), "left").withColumn("first_doc", F.when(F.col("__met"), F.col("__id")).otherwise(F.col("first")))
    else:
        spans = spans.withColumn("first_doc", F.col("first"))
    span = F.struct("start", "length", "words", "first_doc")
    per = spans.groupBy("p").agg(F.sum("length").alias("removed"), F.sum("words").alias("words"), F.sort_array(F.collect_list(span)).alias("spans"))
    joined = base.join(per, F.col("__p") == F.col("p"), "left")
    return joined.select(
        "doc_id", "n_bytes", F.coalesce("removed", F.lit(0)).cast("long").alias("removed_bytes"),
        F.coalesce("words", F.lit(0)).cast("long").alias("removed_words"), F.coalesce(F.size("spans"), F.lit(0)).alias("n_spans"), "spans",
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = report(docs)
    return out.withColumn("is_repeat", F.col("removed_bytes") > 0).withColumn("first_docs", F.transform("spans", lambda s: s["first_doc"])).drop("spans")
