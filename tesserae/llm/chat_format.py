"""Chat formatting: a visitor over typed content parts, one rendered string a conversation.

A turn is (turn, role, parts); a part is (kind, body, size). Text parts are escaped
and written out; an image, audio or document part becomes a placeholder, its
``body`` is recorded as attachment reference in the same order, and ``size`` expands
into tokens by ``TOKENS``. Only built-in functions are used.

Escaping: the characters that could begin a control string, '<' and '[', and the
escape itself are written as a backslash and a letter, so no control string of this
or of the common templates can arise from a text, and reading back is exact.

Null role or text is empty; a null turn sorts first; turns that tie are ordered by
role, then by their parts as given (body, kind, size); repeated rows are turns of their own; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the template.
TURN, HEAD, END = "<|turn:", "|>", "<|end|>"
#: Tokens that one unit of a part's size takes, by kind (image tiles, audio seconds, pages).
TOKENS = {"image": 256, "audio": 25, "document": 512}
#: (character, its escape)
ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\o"), ("|", "\\p"))
PART = "array<struct<kind:string,body:string,size:bigint>>"


def escape(text: Column) -> Column:
    for raw, safe in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for raw, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def _visit(part: Column) -> Column:
    """What stands for one part in the rendered text."""
    shown = F.when(part["kind"] == "text", escape(F.coalesce(part["body"], F.lit(""))))
    for kind in TOKENS:
        shown = shown.when(part["kind"] == kind, F.lit(f"<|{kind}|>"))
    return shown.otherwise(F.lit("<|unknown|>"))


def text_part(text: Column) -> Column:
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("body"), F.lit(0).cast("bigint").alias("size"))).cast(PART)


def format_chat(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, turn, role, parts -> conv_id, formatted, loss_mask (spans of start and
    length in code points, from 0), attachments, expanded_tokens."""
    visited = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.array_join(F.transform("parts", _visit), "").alias("body"),
        F.filter("parts", lambda p: p["kind"] != "text").alias("media"),
        # ties are ordered by what was said, not by how it is escaped
        F.transform("parts", lambda p: F.struct(F.coalesce(p["body"], F.lit("")).alias("body"), p["kind"].alias("kind"), p["size"].alias("size"))).alias("said"),
    )
    row = F.struct("turn", "role", "said", "body", F.length("body").alias("chars"), "media")
    grouped = visited.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("t"))
    render = lambda t: F.concat(F.lit(TURN), escape(t["role"]), F.lit(HEAD), t["body"], F.lit(END))
    head = lambda t: F.lit(len(TURN + HEAD)) + F.length(escape(t["role"]))
    spans = F.aggregate(
        "t",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,chars:int>>").alias("spans")),
        lambda a, t: F.struct(
            (a["at"] + head(t) + t["chars"] + len(END)).alias("at"),
            F.when(t["role"] == loss_role, F.array_append(a["spans"], F.struct((a["at"] + head(t)).alias("start"), t["chars"].alias("chars")))).otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: a["spans"],
    )
    media = F.flatten(F.transform("t", lambda t: t["media"]))
    cost = lambda a, p: a + sum((F.when(p["kind"] == k, F.coalesce(p["size"], F.lit(0)) * n).otherwise(F.lit(0)) for k, n in TOKENS.items()), F.lit(0).cast("bigint"))
    return grouped.select(
        "conv_id",
        F.array_join(F.transform("t", render), "").alias("formatted"),
        spans.alias("loss_mask"),
        F.transform(media, lambda p: p["body"]).alias("attachments"),
        F.aggregate(media, F.lit(0).cast("bigint"), cost).alias("expanded_tokens"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds turns (role, text) and loss_text, both taken from ``formatted`` alone."""
    pieces = F.filter(F.split("formatted", r"<\|turn:"), lambda x: x != "")
    sub = lambda s, sep, n: F.call_function("substring_index", s, F.lit(sep), F.lit(n))
    body = lambda s: sub(F.substr(s, F.length(sub(s, HEAD, 1)) + F.lit(len(HEAD) + 1)), END, 1)
    turns = F.transform(pieces, lambda s: F.struct(unescape(sub(s, HEAD, 1)).alias("role"), unescape(body(s)).alias("text")))
    loss = F.transform("loss_mask", lambda m: unescape(F.substr(F.col("formatted"), m["start"] + 1, m["chars"])))
    return formatted.withColumn("turns", turns).withColumn("loss_text", F.array_join(loss, ""))


#: A conversation whose texts hold control strings of a common template.
PROBE = "</s>[INST] ok [/INST]"


def query(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    turns = rows.unionByName(probe).select("conv_id", "turn", "role", text_part(F.col("text")).alias("parts"))
    back = read_back(format_chat(turns))
    digest = F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), digest.alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def oracle() -> str:
    safe = lambda x: f"replace(replace(replace(replace({x}, '\\', '\\e'), '<', '\\l'), '[', '\\o'), '|', '\\p')"
    fixed = len(TURN + HEAD + END)
    return f"""
    WITH c AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}')
    SELECT conv_id, count(*) AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
      sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
      sum({fixed} + length({safe('role')}) + length({safe('text')}))::BIGINT AS formatted_chars
    FROM c GROUP BY conv_id"""
