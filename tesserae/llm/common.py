"""Expressions and Python helpers that several operators share."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.runtime import cut, cut_any, join_skewed  # noqa: F401

#: The six ASCII blanks that separate words.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"


def blank_words(text: Column) -> Column:
    """The maximal runs of non-blank characters; an empty array for null or blank text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN))


def set_aside(docs: DataFrame, names: list[str]) -> DataFrame:
    """``docs`` with columns that have one of ``names`` renamed to ``<name>_input``, so that
    an operator can add its own under these names. Names differ by more than case."""
    taken, wanted = {c.lower() for c in docs.columns}, {n.lower() for n in names}
    for c in docs.columns:
        if c.lower() in wanted:
            new = f"{c}_input"
            while new.lower() in taken:
                new += "_input"
            taken.add(new.lower())
            docs = docs.withColumnRenamed(c, new)
    return docs


UPPER = 2**62 - 1


def with_place(docs: DataFrame, place: str = "__p") -> DataFrame:
    """``docs`` (doc_id, text) with a long that tells its texts apart and orders them: the
    doc_id, if only one text has it. Null ids, and the further texts of a shared id (those
    beyond the one of the least hash), have a place by 62 bits of a hash of id and text, in
    the upper half of the positive numbers. Equal rows share their place."""
    t = F.xxhash64("text")
    upper = lambda h: F.lit(2**63 - 1) - h.bitwiseAND(F.lit(UPPER))
    own = F.when(F.col("doc_id").isNull(), upper(t))
    ids = docs.groupBy(F.col("doc_id").cast("long").alias("__d")).agg(F.count("*").alias("__n")).filter("__d is not null and __n > 1").select("__d")
    ids, some = cut_any(ids, "shared-ids")
    if not some:
        return docs.withColumn(place, own.otherwise(F.col("doc_id").cast("long")))
    texts = docs.select(F.col("doc_id").cast("long").alias("__d"), t.alias("__t")).join(ids, "__d").groupBy("__d").agg(F.min("__t").alias("__low"), F.max("__t").alias("__high"))
    texts = cut(texts.filter("__low <> __high").select("__d", "__low"), "shared-texts")
    joined = docs.join(texts, docs["doc_id"].cast("long") == texts["__d"], "left")
    further = F.col("__low").isNotNull() & (t != F.col("__low"))
    return joined.withColumn(place, own.when(further, upper(F.xxhash64("doc_id", "text"))).otherwise(F.col("doc_id").cast("long"))).drop("__d", "__low")


def as_row(docs: DataFrame) -> DataFrame:
    """doc_id, text and __row, which holds all columns, so that names of columns cannot clash
    with those an operator adds; ``select("__row.*")`` gives the rows back."""
    return docs.select(F.col("doc_id"), F.col("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))


class HashCache(dict):
    """word -> 64-bit hash, emptied when it holds ``limit`` words, so memory is bounded."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def finish(h: np.ndarray) -> np.ndarray:
    """A 64-bit mixer over an array of uint64 (wraps silently)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    """``n`` seeded odd 64-bit multipliers."""
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(words: np.ndarray, width: int, multipliers: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``width`` words; a shorter text is one shingle."""
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    if n < width:
        return finish((words * multipliers[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n))
    total = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        total += words[k : n - width + 1 + k] * multipliers[k]
    return np.unique(finish(total))
