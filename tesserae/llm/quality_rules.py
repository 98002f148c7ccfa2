"""Quality rules: a table of thresholds compiled into one projection.

Every statistic is a built-in expression over the text of its own row, so the
operator is one scan without a shuffle. Null text has no words. A row is kept if
no base rule and no rule of the table fails; rows repeat or tie freely, since no
row looks at another one; an empty table gives an empty result. Columns of the input
that have the name of a result are kept as ``<name>_input``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import blank_words, set_aside

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in that is was for with are this "
    "der die das und den von zu mit ist nicht ein eine des "
    "de la le et les des un une pour dans que est du "
    "el los las y en del por con una se no su"
).split()

#: (statistic, lowest, highest, least number of words at which it holds)
RULES = (
    ("n_words", 10, 200_000, 0),
    ("mean_word_chars", 2.0, 16.0, 0),
    ("symbols_per_word", None, 0.1, 0),
    ("stop_share", 0.02, None, 40),
    ("dup_line_share", None, 0.5, 0),
)

WINDOW = 5
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop"]
HELPERS = ["__w", "__hw", "__h", "__s", "__lines"]


def _statistics(text: str) -> dict[str, Column]:
    raw = F.coalesce(F.col(text), F.lit(""))
    return {
        "__w": blank_words(F.col(text)),
        "word_chars": F.length(F.translate(raw, " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": (F.length(raw) - F.length(F.translate(raw, "#*$%&|<>", ""))).cast("long"),
        "__lines": F.filter(F.split(raw, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
    }


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and n_stop.

    Repeated windows are found by sorting the (hash, position) pairs of one text, so a
    text of n words costs n log n. Only texts that do repeat a window are sorted.
    """
    df = set_aside(docs, STATISTICS + HELPERS).withColumns(_statistics(text))
    df = df.withColumn("__hw", F.transform("__w", lambda x: F.xxhash64(x)))
    starts = F.sequence(F.lit(0), F.size("__hw") - WINDOW)
    window = lambda i: F.xxhash64(*[F.col("__hw")[i + k] for k in range(WINDOW)])
    none = F.array().cast("array<bigint>")
    df = df.withColumn("__h", F.when(F.size("__hw") >= WINDOW, F.transform(starts, window)).otherwise(none))
    pairs = F.sort_array(F.arrays_zip(F.col("__h").alias("h"), F.sequence(F.lit(0), F.size("__h") - 1).alias("p")))
    no_pairs = F.array().cast("array<struct<h:bigint,p:int>>")
    repeats = F.size(F.array_distinct("__h")) < F.size("__h")
    df = df.withColumn("__s", F.when(repeats, pairs).otherwise(no_pairs))
    same = lambda x, i: F.coalesce(F.get("__s", i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("__s", i + 1)["h"] == x["h"], F.lit(False))
    hits = F.sort_array(F.transform(F.filter("__s", same), lambda x: x["p"]))
    covered = F.aggregate(
        hits,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(a["end"], p)).alias("n"), (p + WINDOW).alias("end")),
        lambda a: a["n"],
    )
    return df.withColumns({
        "n_words": F.size("__w").cast("long"),
        "n_lines": F.size("__lines").cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": covered.cast("long"),
        "n_stop": F.size(F.filter("__w", lambda x: x.isin(STOP_WORDS))).cast("long"),
    }).drop(*HELPERS)


def _ratio(top: str, bottom: str) -> Column:
    return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(F.lit(0.0))


def verdict(rules=RULES) -> Column:
    """The table of thresholds as one boolean expression over the statistics."""
    values = {
        "n_words": F.col("n_words"),
        "mean_word_chars": _ratio("word_chars", "n_words"),
        "symbols_per_word": _ratio("n_symbols", "n_words"),
        "stop_share": _ratio("n_stop", "n_words"),
        "dup_line_share": _ratio("n_dup_lines", "n_lines"),
    }
    passed = F.lit(True)
    for name, low, high, least in rules:
        value, ok = values[name], F.lit(True)
        if low is not None:
            ok = ok & (value >= low)
        if high is not None:
            ok = ok & (value <= high)
        passed = passed & ((F.col("n_words") < least) | ok)
    return passed


def quality_rules(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """``docs`` with its statistics, base_failed and kept."""
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return with_statistics(set_aside(docs, ["base_failed", "kept"]), text).withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & verdict(rules))


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_rules(docs).select(*COLUMNS)


def oracle() -> str:
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    return rf"""
    WITH base AS (
      SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
    w AS (
      SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM base),
    win AS (
      SELECT rid, i, array_to_string(w[i:i+4], ' ') AS g
      FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
    rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
    cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY rid),
    s AS (
      SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
             len(list_filter(w, lambda x: x IN ({stops}))) AS n_stop
      FROM w LEFT JOIN cov USING (rid)),
    v AS (
      SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s)
    SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
           n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
           NOT base_failed AND n_words BETWEEN 10 AND 200000 AND word_chars::DOUBLE / n_words BETWEEN 2 AND 16
             AND n_symbols::DOUBLE / n_words <= 0.1 AND (n_words < 40 OR n_stop::DOUBLE / n_words >= 0.02)
             AND (n_lines = 0 OR n_dup_lines::DOUBLE / n_lines <= 0.5) AS kept
    FROM v"""
