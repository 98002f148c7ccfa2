"""Mixing sources to target weights by hierarchical budgets.

A tree of domain, language and source carries weights. A token budget flows from the
root down: the children of a node share its budget by weight, a child never gets more
than its whole subtree can supply in ``max_epochs`` passes, and what it cannot take
goes to its siblings before it ever leaves their parent. Each leaf then takes whole
epochs and, of one more, the prefix of a seeded order that fits what is left.

Shares are found in closed form: in the order of capacity over weight the children
that fill up come first, so running sums show who is full. Only tables of nodes go
through those windows. The prefix of a leaf is found by sums over ranges of the seeded
hash, coarse ones, then those inside the one where the budget ends, then by a window over
the documents of the last range; no leaf is ever ordered in a single task. Only built-in
functions are used.

The tree is a list of levels from the root down: a name, the column that tells a
document's node, and whole weights of at least 1 by name (1 if not listed).

Null lang or source is the leaf 'unknown'. Documents without words are never taken.
Ties of the hash go by doc_id, then tokens; rows that repeat are taken on their own.
An empty table, or a budget of 0, gives an empty result.
"""

from __future__ import annotations

from collections import namedtuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import blank_words, join_skewed
from tesserae.runtime import cut

#: Weights in whole parts; names that are not listed weigh 1.
DOMAIN_WEIGHTS = {"web": 5, "books": 3, "forum": 2}
LANG_WEIGHTS = {"en": 6, "de": 2, "fr": 1, "es": 1}
SHARE, MAX_EPOCHS, SEED = (1, 2), 3, 17
#: Documents that one hash range of a leaf holds on average.
RANGE_DOCS = 256

Level = namedtuple("Level", "name of weights")


def domain_of(source: Column) -> Column:
    """A rule over the source's number: 0 is web, 1 to 9 books, the others forum."""
    return F.when(source == "src0", "web").when(source.rlike("^src[1-9]$"), "books").otherwise("forum")


def default_levels() -> list[Level]:
    source = F.coalesce(F.col("source"), F.lit("unknown"))
    return [Level("domain", domain_of(source), DOMAIN_WEIGHTS), Level("lang", F.coalesce("lang", F.lit("unknown")), LANG_WEIGHTS), Level("source", source, {})]


def _weight(name: Column, table: dict[str, int]) -> Column:
    if any(w < 1 or w != int(w) for w in table.values()):
        raise ValueError("weights are whole numbers from 1 on")
    out = F.lit(1)
    for key, value in table.items():
        out = F.when(name == key, value).otherwise(out)
    return out.cast("bigint")


def leaves(docs: DataFrame, levels: list[Level] | None = None) -> DataFrame:
    """doc_id, the name of each level, n_tokens of every document with a word."""
    levels = levels or default_levels()
    tokens = F.size(blank_words(F.col("text"))).cast("bigint")
    return docs.select("doc_id", *[v.of.alias(v.name) for v in levels], tokens.alias("n_tokens")).filter("n_tokens > 0")


def share_out(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """nodes: parent columns, name, weight, cap, parent_budget -> the same and budget."""
    by = Window.partitionBy(*(parent or [F.lit(0)])).orderBy((F.col("cap") / F.col("weight")).asc(), F.col(name).asc())
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy(*(parent or [F.lit(0)]))
    ranked = nodes.withColumn("__before", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("__rest", F.sum("weight").over(after))
    ranked = ranked.withColumn("__full", F.expr("cap * __rest <= (parent_budget - __before) * weight"))
    left = ranked.withColumn("__taken", F.coalesce(F.sum(F.when(F.col("__full"), F.col("cap"))).over(every), F.lit(0)))
    left = left.withColumn("__open", F.sum(F.when(~F.col("__full"), F.col("weight"))).over(every))
    budget = F.when(F.col("__full"), F.col("cap")).otherwise(F.expr("((parent_budget - __taken) * weight) div __open"))
    return left.withColumn("budget", budget.cast("bigint")).drop("__before", "__rest", "__full", "__taken", "__open")


def budgets(base: DataFrame, levels: list[Level] | None = None, share=SHARE, total_tokens: int | None = None, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The names of every leaf, supply, docs, budget; base: as ``leaves`` gives it."""
    levels = levels or default_levels()
    names = [v.name for v in levels]
    leaf = base.groupBy(*names).agg(F.sum("n_tokens").alias("supply"), F.count("*").alias("docs")).withColumn("cap", F.col("supply") * max_epochs)
    tables = [leaf]
    for k in range(len(names) - 1, 0, -1):
        tables.insert(0, tables[0].groupBy(*names[:k]).agg(F.sum("cap").alias("cap")))
    wanted = F.lit(total_tokens).cast("bigint") if total_tokens is not None else F.expr(f"(__cap div {max_epochs}) * {share[0]} div {share[1]}")
    root = tables[0].agg(F.sum("cap").alias("__cap")).select(F.least("__cap", wanted).alias("parent_budget"))
    out = None
    for k, (level, nodes) in enumerate(zip(levels, tables, strict=True)):
        if out is None:
            nodes = nodes.crossJoin(F.broadcast(root))  # one row
        else:
            nodes = nodes.join(out.select(*names[:k], F.col("budget").alias("parent_budget")), names[:k])
        out = share_out(nodes.withColumn("weight", _weight(F.col(level.name), level.weights)), names[:k], level.name)
    return out.select(*names, "supply", "docs", "budget")


def _narrow(part: DataFrame, names: list[str], digits: str) -> tuple[DataFrame, DataFrame]:
    """part: names, rest, digits, __h, n_tokens -> the rows of the hash ranges of that many
    digits that the rest pays for, and those of the range where it ends, with what is left."""
    part = part.withColumn("__r", F.expr(f"left(__h, {digits})"))
    run = Window.partitionBy(*names).orderBy("__r").rowsBetween(Window.unboundedPreceding, 0)
    ranges = part.groupBy(*names, "__r", "rest").agg(F.sum("n_tokens").alias("__t")).withColumn("__to", F.sum("__t").over(run))
    ranges = ranges.withColumn("__from", F.col("__to") - F.col("__t")).filter("__from <= rest").select(*names, "__r", "__from", "__to")
    near = part.join(ranges, [*names, "__r"]).drop("__r")
    left = near.filter("__to > rest").withColumn("rest", F.col("rest") - F.col("__from"))
    return near.filter("__to <= rest").drop("__from", "__to"), left.drop("__from", "__to")


def mix(docs: DataFrame, share=SHARE, total_tokens: int | None = None, max_epochs: int = MAX_EPOCHS, seed: int = SEED, levels: list[Level] | None = None) -> DataFrame:
    """doc_id, the name of each level, epoch (from 1), n_tokens of what the mixture takes."""
    levels = levels or default_levels()
    names = [v.name for v in levels]
    base = cut(leaves(docs, levels), "mixing-tokens")
    plan = cut(
        budgets(base, levels, share, total_tokens, max_epochs)
        .withColumn("full", F.expr("budget div supply"))
        .withColumn("rest", F.col("budget") - F.col("full") * F.col("supply"))
        .withColumn("digits", F.greatest(F.lit(0), F.ceil(F.log(16.0, F.col("docs") / RANGE_DOCS))).cast("int"))
        .select(*names, "full", "rest", "digits", "docs"),
        "mixing-plan",
    )
    joined = join_skewed(base, plan, names, "docs", base.count())
    whole = joined.filter("full > 0").select("doc_id", *names, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("full"))).alias("epoch"), "n_tokens")
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), (F.col("full") + 1).cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    part = joined.filter("rest > 0").withColumn("__h", order)
    first, part = _narrow(part, names, "(digits + 1) div 2")
    second, part = _narrow(part, names, "digits")
    inside = Window.partitionBy(*names).orderBy("__h", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    last = part.withColumn("__c", F.sum("n_tokens").over(inside)).filter("__c <= rest")
    out = ["doc_id", *names, (F.col("full") + 1).alias("epoch"), "n_tokens"]
    for taken in (first, second, last):
        whole = whole.unionByName(taken.select(*out))
    return whole


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return mix(docs)


def oracle() -> str:
    def level(out: str, source: str, parent: str, name: str) -> str:
        by = f"PARTITION BY {parent}" if parent else ""
        return f"""
    {out}_a AS (SELECT *, coalesce(sum(cap) OVER ({by} ORDER BY cap / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef,
        sum(weight) OVER ({by} ORDER BY cap / weight, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rst FROM {source}),
    {out}_b AS (SELECT *, cap * rst <= (pb - bef) * weight AS ful FROM {out}_a),
    {out} AS (SELECT *, CASE WHEN ful THEN cap ELSE ((pb - coalesce(sum(cap) FILTER (WHERE ful) OVER ({by}), 0)) * weight)
        // (sum(weight) FILTER (WHERE NOT ful) OVER ({by})) END AS budget FROM {out}_b)"""

    case = lambda col, t: f"CASE {' '.join(f"WHEN {col} = '{k}' THEN {v}" for k, v in t.items())} ELSE 1 END"
    return rf"""
    WITH d AS (SELECT doc_id, coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
        CASE WHEN source = 'src0' THEN 'web' WHEN regexp_matches(source, '^src[1-9]$') THEN 'books' ELSE 'forum' END AS domain,
        len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents),
    b AS (SELECT * FROM d WHERE n_tokens > 0),
    leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS supply, (sum(n_tokens) * {MAX_EPOCHS})::BIGINT AS cap FROM b GROUP BY ALL),
    lg AS (SELECT domain, lang, sum(cap)::BIGINT AS cap FROM leaf GROUP BY ALL),
    dm AS (SELECT domain, sum(cap)::BIGINT AS cap FROM lg GROUP BY ALL),
    dm1 AS (SELECT *, {case('domain', DOMAIN_WEIGHTS)} AS weight, (SELECT least(sum(cap), (sum(cap) // {MAX_EPOCHS}) * {SHARE[0]} // {SHARE[1]}) FROM dm) AS pb FROM dm),
    {level('dm2', 'dm1', '', 'domain')},
    lg1 AS (SELECT lg.*, {case('lang', LANG_WEIGHTS)} AS weight, dm2.budget AS pb FROM lg JOIN dm2 USING (domain)),
    {level('lg2', 'lg1', 'domain', 'lang')},
    lf1 AS (SELECT leaf.*, 1 AS weight, lg2.budget AS pb FROM leaf JOIN lg2 USING (domain, lang)),
    {level('lf2', 'lf1', 'domain, lang', 'source')},
    pl AS (SELECT domain, lang, source, (budget // supply)::BIGINT AS ful, (budget - (budget // supply) * supply)::BIGINT AS rest FROM lf2),
    j AS (SELECT b.*, pl.ful, pl.rest FROM b JOIN pl USING (domain, lang, source)),
    w AS (SELECT doc_id, domain, lang, source, unnest(range(1, ful + 1)) AS epoch, n_tokens FROM j WHERE ful > 0),
    p AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{SEED}:' || (ful + 1)::VARCHAR || ':' || coalesce(doc_id::VARCHAR, '')), doc_id, n_tokens
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM j WHERE rest > 0)
    SELECT doc_id, domain, lang, source, epoch::BIGINT AS epoch, n_tokens FROM w
    UNION ALL SELECT doc_id, domain, lang, source, (ful + 1)::BIGINT, n_tokens FROM p WHERE c <= rest"""
