"""Grouping policies: which objects are stored with their parent and which alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes that a piece of its own costs besides its content.
OVERHEAD = 1200.0


def type_policy(kind: Column, bundle: list[str], split: list[str], final: list[str], depth: Column) -> Column:
    """Bundled kinds and unknown ones stay inside; split kinds leave, and stop there if
    their kind is final or they are below the root."""
    return F.when(kind.isin(bundle) | ~kind.isin(split) | kind.isNull(), "bundle").when(kind.isin(final) | (depth >= 1), "split_final").otherwise("split")


def fixed_policy(bits: Column, position: Column) -> Column:
    """The decision at a position of a string of bits, lowest first; 1 splits."""
    return F.when(F.pmod(F.floor(bits / F.pow(F.lit(2.0), position)), F.lit(2)) == 1, "split").otherwise("bundle")


def bundle_cost(group_size, object_size, group_rate, object_rate, overhead=OVERHEAD) -> Column:
    return (group_size + object_size) * F.least(group_rate + object_rate, F.lit(1.0)) + overhead


def split_cost(group_size, object_size, group_rate, object_rate, overhead=OVERHEAD) -> Column:
    return group_size * group_rate + object_size * object_rate + 2 * overhead


def naive_policy(action: str) -> Column:
    """The same for every object: "split" stores each one alone, "bundle" all together."""
    if action not in ("split", "bundle"):
        raise ValueError(f"no such policy: {action}")
    return F.lit(action)


def constant_rate(rate: float) -> Column:
    return F.lit(float(rate))


def bounded_rate(score: Column, immutable: Column) -> Column:
    """A regressor's score as a rate from 0 to 1; what cannot change has 0."""
    return F.when(immutable, 0.0).otherwise(F.greatest(F.least(score, F.lit(1.0)), F.lit(0.0)))


def sampled_rate(probability: Column, immutable: Column, drawn: Column) -> Column:
    """A classifier's rate: 0 for what cannot change, and for drawn objects that it takes for
    unchanging; 0.1 for all others."""
    return F.when(immutable | (drawn & (probability < 0.5)), 0.0).otherwise(0.1)


def greedy_fold(objects: DataFrame, overhead: float = OVERHEAD) -> DataFrame:
    """objects (group_id, position, size, rate, depth if known) -> group_id, position, action.
    What leaves below the root leaves for good (split_final).

    The decision depends on what the group holds so far, so each group is folded in order.
    A group is one piece in the making; its number of objects bounds the task.
    """
    depth = F.col("depth") if "depth" in objects.columns else F.lit(0)
    items = F.sort_array(F.collect_list(F.struct("position", "size", "rate", depth.alias("depth"))))
    state = "struct<held:double,rate:double,out:array<struct<position:bigint,action:string>>>"
    zero = F.struct(F.lit(0.0).alias("held"), F.lit(0.0).alias("rate"), F.array().alias("out")).cast(state)

    def step(a, x):
        together = bundle_cost(a["held"], x["size"], a["rate"], x["rate"], overhead)
        apart = split_cost(a["held"], x["size"], a["rate"], x["rate"], overhead)
        stay = together <= apart
        action = F.struct(x["position"].cast("bigint").alias("position"), F.when(stay, "bundle").when(x["depth"] >= 1, "split_final").otherwise("split").alias("action"))
        return F.struct(
            (a["held"] + F.when(stay, x["size"].cast("double")).otherwise(0.0)).alias("held"),
            F.when(stay, F.least(a["rate"] + x["rate"], F.lit(1.0))).otherwise(a["rate"]).alias("rate"),
            F.array_append(a["out"], action).alias("out"),
        )

    folded = objects.groupBy("group_id").agg(items.alias("i")).select("group_id", F.aggregate("i", zero, step, lambda a: a["out"]).alias("o"))
    return folded.select("group_id", F.inline("o"))


#: 2 to this power sets of decisions are tried for each group at most.
MOST_DECISIONS = 16


def exhaustive(objects: DataFrame, group: str, n: int, rate: float, overhead: float = OVERHEAD) -> DataFrame:
    """objects (group, i from 0 to n - 1, size) -> group, decisions, cost: the cheapest set of
    pieces of their own (bits), where one costs its size times ``rate`` and the overhead. All
    2 ** n sets are summed by group; ties go to the least number."""
    if n > MOST_DECISIONS:
        raise ValueError(f"{n} decisions are more than {MOST_DECISIONS}")
    sets = objects.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2**n - 1))))
    alone = F.expr("(k >> cast(i as int)) & 1") == 1
    cost = sets.groupBy(group, "k").agg(F.sum(F.when(alone, F.col("size") * rate + overhead).otherwise(F.col("size"))).alias("cost"))
    best = F.min(F.struct(F.round("cost", 4).alias("cost"), F.col("k").cast("bigint").alias("decisions"))).alias("b")
    return cost.groupBy(group).agg(best).select(group, "b.decisions", "b.cost")


def tree_score(trees: list) -> Column:
    """A sum of decision trees as nested conditions. A tree is a number or (column, threshold,
    tree at or below, tree above, where a missing value goes: "low", "high", or "zero", which
    takes it for 0; "high" if not told)."""

    def one(tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(float(tree))
        name, cut_at, low, high, *missing = tree
        value = F.col(name).cast("double")
        value = F.when(~F.isnan(value), value)
        if missing == ["zero"]:
            value = F.coalesce(value, F.lit(0.0))
        goes_low = value <= cut_at
        return F.when((goes_low | value.isNull()) if missing == ["low"] else goes_low, one(low)).otherwise(one(high))

    return sum((one(t) for t in trees[1:]), one(trees[0]))


def sigmoid(score: Column) -> Column:
    return 1 / (1 + F.exp(-score))
