"""Line dedup: a deletion-neighbourhood join within one edit, the earliest line stays.

A line is compared by its normal form: lower case, runs of blanks as one. Two lines
match if they are equal or, from ``min_chars`` characters on (0: all), one edit apart. A
line goes if it matches an earlier line (by place of the text, line number), dropped or
not; the place is the doc_id, see ``with_place`` for null and shared ids.

Neighbourhood: for a line x and a length L of |x| or |x| + 1, a variant is what stands
before and after a hole at a fixed place of a line of length L. Two lines one edit apart
share the variant whose hole holds the edit, whatever the width of the holes. All
variants with wide holes are hashed and joined first (two a length); only lines that
meet another line there are cut finer (``FINE`` holes), and only those that meet again
emit every one-character hole. Variants equal at that width are one edit apart, so the
earliest line of each is a minimum and no pairs are listed; the edit distance of every
line to the earliest it met is then verified.

Variants are emitted once a distinct line, and lines that hold much of all rows meet
their verdict by a broadcast, so a line that stands everywhere is never gathered.

Null or empty text has no line; blank lines are never compared nor dropped. Equal rows
of one doc_id are one text; other texts of it are compared like those of other ids.
Equal texts of null ids are different documents, of which one stays. Other columns are
kept, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import as_row, finish, join_skewed, with_place
from tesserae.runtime import cut, cut_any, tune

#: Shorter lines must be equal: one edit in a few words makes another line of them.
MIN_CHARS = 20
FINE = 64
U = np.uint64


def normal(line: str) -> str:
    return " ".join(line.lower().split())


def half_variants(x: str) -> list[int]:
    """The variants of two wide holes, for both lengths."""
    n, out = len(x), []
    for long in (n, n + 1):
        width = -(-long // 2)
        for i, (before, after) in enumerate(((0, long - width), (width, long - 2 * width if long > 2 * width else 0))):
            body = x[:before] + "\x00" + (x[n - after :] if after else "")
            out.append(xxhash.xxh3_64_intdigest(f"{long}:{i}:{body}".encode("utf-8", "surrogatepass")) - 2**63)
    return out


def variants(x: str, holes: int) -> np.ndarray:
    """Hashes of the variants of ``holes`` holes (0: holes of one character), for both lengths."""
    c = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32).astype(U)
    n, place = len(c), np.arange(len(c), dtype=U)
    zero = np.zeros(1, U)
    # sums of mixed (character, place) pairs are hashes of every beginning and every end
    head = np.concatenate([zero, np.cumsum(finish(c * U(0x9E3779B97F4A7C15) + place * U(0xC2B2AE3D27D4EB4F)))])
    tail = np.concatenate([zero, np.cumsum(finish(c[::-1] * U(0x165667B19E3779F9) + place * U(0x27D4EB2F165667C5) + U(1)))])
    out = []
    for long in (n, n + 1):
        width = max(1, -(-long // holes)) if holes else 1
        start = np.arange(0, long, width)
        after = np.maximum(long - start - width, 0)
        key = finish(head[np.minimum(start, n)] + U(long * 0xD6E8FEB86659FD93 % 2**64)) ^ finish(tail[np.minimum(after, n)] + start.astype(U) * U(0xA0761D6478BD642F))
        out.append(key)
    return np.unique(np.concatenate(out)).view(np.int64)


WIDE = ["k1", "k2", "k3", "k4"]
LINE = "p long, line int, of int, h1 long, h2 long, again boolean, " + ", ".join(f"{k} long" for k in WIDE)


def lines(placed: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """__p, text -> every line with a word: how many its text has, its digest, whether its
    text had it before, wide variants."""
    tune(placed.sparkSession)
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), *[pa.int64()] * 4)
    names = ["p", "line", "of", "h1", "h2", "again", *WIDE]

    def split(batches):
        for batch in batches:
            cols: list[list] = [[] for _ in kinds]
            for p, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                first: set[bytes] = set()
                found = [(i, x) for i, line in enumerate((text or "").split("\n")) if (x := normal(line))]
                for i, x in found:
                    d = xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass"))
                    again = d in first
                    first.add(d)
                    wide = half_variants(x) if len(x) >= min_chars and not again else [None] * 4
                    row = (p, i, len(found), int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True), again, *wide)
                    for col, v in zip(cols, row, strict=True):
                        col.append(v)
                if len(cols[0]) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)
                    cols = [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return placed.select("__p", "text").mapInArrow(split, LINE)


def _meeting(rows: DataFrame) -> DataFrame:
    """h1 of the lines that share a key with another line; rows: h1, key."""
    shared = rows.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).filter("a <> b").select("key")
    return rows.join(shared, "key", "left_semi").select("h1").distinct()


def _expand(texts: DataFrame, holes: int) -> DataFrame:
    def emit(batches):
        for batch in batches:
            for h1, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                key = variants(x, holes)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), h1)), pa.array(key)], ["h1", "key"])

    return texts.select("h1", "x").mapInArrow(emit, "h1 long, key long")


def _texts(placed: DataFrame, wanted: DataFrame) -> DataFrame:
    """h1, p, line, x: the normal form of the lines in ``wanted`` (p, line, h1)."""
    per = wanted.groupBy(F.col("p").alias("__p")).agg(F.collect_list(F.struct("line", "h1")).alias("__w"))
    held = placed.select("__p", "text").join(per, "__p")

    def pick(batches):
        for batch in batches:
            out = []
            for p, text, want in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                parts = (text or "").split("\n")
                for w in want:
                    if w["line"] < len(parts) and (x := normal(parts[w["line"]])):
                        d = xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass"))
                        if int.from_bytes(d[:8], "big", signed=True) == w["h1"]:
                            out.append((w["h1"], p, w["line"], x))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.string()))], ["h1", "p", "line", "x"])

    return held.select("__p", "text", "__w").mapInArrow(pick, "h1 long, p long, line int, x string")


def near_lines(placed: DataFrame, distinct: DataFrame) -> DataFrame:
    """h1 of the lines that have an earlier line one edit away."""
    wide = _meeting(distinct.filter("k1 is not null").select("h1", F.explode(F.array(*WIDE)).alias("key")))
    held = distinct.join(wide, "h1", "left_semi").select(F.col("first").alias("p"), "line", "h1")
    texts = cut(_texts(placed, held).dropDuplicates(["h1"]), "line-texts")
    close = texts.join(_meeting(_expand(texts, FINE)), "h1", "left_semi")
    close = cut(close, "line-close")
    place = F.struct("p", "line", "h1")
    single = _expand(close, 0).join(close.select("h1", "p", "line"), "h1")
    best = single.groupBy("key").agg(F.min(place).alias("e"), F.count("*").alias("n")).filter("n > 1").select("key", "e")
    # lines that share a variant differ in one character, so they are no more than there are characters
    met = single.join(best, "key").filter(F.col("e") < place)
    met = met.groupBy("h1").agg(F.min("e").alias("e")).select("h1", F.col("e.h1").alias("other"))
    x = close.select("h1", "x")
    pairs = met.join(x, "h1").join(x.select(F.col("h1").alias("other"), F.col("x").alias("y")), "other")
    return pairs.filter(F.levenshtein("x", "y", 1) >= 0).select("h1")


def _per_text(placed: DataFrame, min_chars: int) -> DataFrame:
    """__p, n_lines, n_near, dropped of every text with a line."""
    every = cut(lines(placed, min_chars), "lines")
    by_line = every.groupBy("h1", "h2").agg(
        F.min("p").alias("first"), F.count("*").alias("n"), F.min_by("line", F.when(~F.col("again"), F.col("p"))).alias("line"), *[F.min(k).alias(k) for k in WIDE]
    )
    distinct = cut(by_line, "line-distinct")
    near = cut(near_lines(placed, distinct).distinct(), "line-near").withColumn("near", F.lit(True))
    # lines that stand once and are near to none stay: nothing else is asked about them
    verdict = distinct.select("h1", "h2", "first", "n").join(near, "h1", "left").filter("n > 1 or near")
    verdict = cut(verdict.withColumn("near", F.coalesce("near", F.lit(False))), "line-verdicts")
    total = every.count()
    found = join_skewed(every.select("p", "line", "h1", "h2", "again"), verdict, ["h1", "h2"], "n", total)
    gone = F.col("again") | (F.col("p") > F.col("first")) | F.col("near")
    some = found.filter(gone).groupBy("p").agg(
        F.sort_array(F.collect_set("line")).alias("dropped"), F.size(F.collect_set(F.when(F.col("near"), F.col("line")))).alias("n_near")
    )
    sizes = every.groupBy(F.col("p").alias("__p")).agg(F.max("of").alias("n_lines"))
    joined = sizes.join(some, F.col("p") == F.col("__p"), "left")
    return joined.select("__p", "n_lines", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))


def report(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, n_lines (with a word), n_near, dropped (line numbers): one row a text with
    lines, and one a doc_id that has none."""
    placed = with_place(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    found = placed.select("doc_id", "__p").distinct().join(_per_text(placed, min_chars), "__p", "left")
    found = cut(found, "line-report")
    some = found.filter("n_lines is not null")
    bare = found.filter("n_lines is null").dropDuplicates(["doc_id"])
    bare = bare.join(some.select(F.col("doc_id").alias("__d")), F.col("doc_id").eqNullSafe(F.col("__d")), "left_anti")
    return some.unionByName(bare).select(
        "doc_id", F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"),
    )


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` without the lines that repeat; a document that loses all of its lines goes."""
    names = docs.columns
    placed = with_place(as_row(docs))
    per = cut(_per_text(placed, min_chars), "line-dropped")
    gone = per.filter(F.size("dropped") > 0).select("__p", F.col("n_lines").alias("__n"), F.col("dropped").alias("__gone"))
    joined = placed.join(gone, "__p", "left").filter("__gone is null or size(__gone) < __n")
    # a string with '1' for each line that goes, so that lines and marks are met in one pass
    before = F.concat(F.array(F.lit(-1)), F.slice("__gone", F.lit(1), F.size("__gone") - 1))
    marks = F.concat(F.array_join(F.zip_with("__gone", before, lambda g, b: F.repeat(F.lit("0"), g - b - 1)), "1"), F.lit("1"))
    lines_ = F.split(F.col("__row.text"), "\n")
    kept = F.array_join(F.zip_with(lines_, F.split(marks, ""), lambda x, m: F.when(m.isNull() | (m != "1"), x)), "\n")
    row = F.col("__row").withField("text", kept)
    if "n_chars" in names:
        row = row.withField("n_chars", F.length(kept).cast(docs.schema["n_chars"].dataType))
    out = joined.select("doc_id", "__p", F.when(F.col("__gone").isNull(), F.col("__row")).otherwise(row).alias("__row"))
    # equal texts of null ids that still have lines: the least row stays, as JSON
    again = placed.filter("doc_id is null").groupBy("__p").agg(F.count("*").alias("n")).filter("n > 1")
    again, some = cut_any(again.join(per.select("__p"), "__p", "left_semi").select("__p"), "line-again")
    if not some:
        return out.select("__row.*")
    alone = out.join(again, "__p", "left_anti")
    several = out.filter("doc_id is null").join(again, "__p", "left_semi")
    return alone.select("__row.*").unionByName(several.groupBy("__p").agg(F.min_by("__row", F.to_json("__row")).alias("__row")).select("__row.*"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return report(docs).withColumn("n_dropped", F.size("dropped").cast("long"))
