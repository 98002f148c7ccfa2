"""Graph operators over edge tables, as joins and aggregations in rounds.

Rounds end in a table in the shared folder, so lineage stays short and a lost executor
costs one round. Frontiers and labels are distributed; the driver sees counts only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.runtime import cut, cut_any, join_skewed

#: Edges up to which strong components are finished on the driver.
FEW_EDGES = 20_000


def _wide(df: DataFrame) -> DataFrame:
    """A side of a join that may have a row a node or edge, so both sides are shuffled. Files of
    ids and constants compress so well that Spark would take millions of rows for a small
    table, and build it on the driver to broadcast it."""
    return df.hint("merge")


def closure(edges: DataFrame, seeds: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """edges (src, dst), seeds (node) -> seed, node, hops (least) of all that is reached.

    Semi-naive: each round extends only pairs that the last one found, so cycles end.
    Null ends are ignored; a seed reaches itself in 0 hops.
    """
    edges = cut(edges.select("src", "dst").dropna().distinct(), "closure-edges")
    new, more = cut_any(seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("hops")).dropna().distinct(), "closure")
    found, rounds = new, 0
    while more and (max_rounds is None or rounds < max_rounds):
        rounds += 1
        step = new.join(_wide(edges), new["node"] == edges["src"]).select("seed", F.col("dst").alias("node")).distinct()
        new, more = cut_any(step.join(_wide(found.select("seed", "node")), ["seed", "node"], "left_anti").withColumn("hops", F.lit(rounds)), "closure")
        found = found.unionByName(new)
    return found


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (node), edges (src, dst) -> node, comp: the least node that is connected.

    Every round takes the least label of the neighbours, then the label of the label, so
    long chains halve. It ends when no label changes.
    """
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).dropna().filter("src <> dst").distinct()
    both = cut(both, "component-edges")
    degree = both.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"))
    now = nodes.select("node", F.col("node").alias("comp")).dropna().distinct().join(_wide(degree), "node", "left")
    now, more, ends = cut(now.withColumn("n", F.coalesce("n", F.lit(0))), "components"), True, both.count()
    size = now.count()
    while more:
        label = now.select(F.col("node").alias("dst"), F.col("comp").alias("c"), "n")
        near = join_skewed(both, label, ["dst"], "n", ends, wide=True).groupBy(F.col("src").alias("node")).agg(F.min("c").alias("c"))
        low = now.join(_wide(near), "node", "left").select("node", F.least("comp", F.coalesce("c", "comp")).alias("comp"), F.col("comp").alias("old"), "n")
        low = cut(low, "components")
        held = low.groupBy("comp").agg(F.count("*").alias("m"))
        jump = low.select(F.col("node").alias("comp"), F.col("comp").alias("further")).join(_wide(held), "comp")
        after = join_skewed(low, jump, ["comp"], "m", size, "left", wide=True).select("node", F.coalesce("further", "comp").alias("comp"), "old", "n")
        after, more = cut_any(after, "components", F.col("comp") != F.col("old"))
        now = after.select("node", "comp", "n")
    return now.select("node", "comp")


def strong_components(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """edges (src, dst) -> node, comp: the least node that is reached and reaches back.

    By colours: each node takes the least rank that reaches it, and what reaches the
    owner of its colour inside the colour is that owner's component; the rest of each
    colour goes on, without edges between colours. Ranks are hashes, so that a long
    chain falls into many colours at once. A round moves a row a node and edge, never a
    row for each pair of nodes. When no more than ``few`` edges are left (0: never), the
    driver takes them and finishes. Null ends are ignored.
    """
    live, more = cut_any(edges.select("src", "dst").dropna().distinct(), "strong-edges", F.col("src") != F.col("dst"))
    nodes = live.select(F.col("src").alias("node")).unionByName(live.select(F.col("dst").alias("node"))).distinct()
    live, found = live.filter("src <> dst"), nodes.select("node", F.col("node").alias("owner"))
    while more:
        # what nothing points to, or what points to nothing, is a component of its own
        live = live.join(_wide(live.select(F.col("dst").alias("src")).distinct()), "src", "left_semi").join(_wide(live.select(F.col("src").alias("dst")).distinct()), "dst", "left_semi")
        live = cut(live.select("src", "dst"), "strong-edges")
        left = live.count()
        more = left > few
        if 0 < left <= few:
            found = found.unionByName(live.sparkSession.createDataFrame(_owners(live.collect()), found.schema))
        if more:
            ends = live.select(F.col("src").alias("node")).unionByName(live.select(F.col("dst").alias("node"))).distinct()
            owned = _spread(live, ends.select("node", F.struct(F.xxhash64("node").alias("hash"), "node").alias("mark"))).select("node", F.col("mark.node").alias("owner"))
            owner = lambda end: owned.select(F.col("node").alias(end), F.col("owner").alias(f"{end}_owner"))  # noqa: E731, B023
            live = cut(live.join(_wide(owner("src")), "src").join(_wide(owner("dst")), "dst").filter("src_owner = dst_owner").select("src", "dst"), "strong-edges")
            # edges stay inside colours, so what reaches an owner reaches its own
            reached = _spread(live.select(F.col("dst").alias("src"), F.col("src").alias("dst")), owned.select("node", F.when(F.col("node") == F.col("owner"), 1).alias("mark")))
            core = owned.join(_wide(reached.filter("mark = 1")), "node", "left_semi").select("node", "owner")
            found = found.unionByName(core)
            gone = _wide(core.select("node"))
            live, more = cut_any(live.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"), "strong-edges")
    # a node of a larger component has two rows: itself, and its owner if that is another
    owner = found.groupBy("node").agg(F.max_by("owner", F.col("owner") != F.col("node")).alias("owner"))
    least = owner.groupBy("owner").agg(F.min("node").alias("comp"))
    return owner.join(_wide(least), "owner").select("node", "comp")


def _owners(edges: list) -> list[tuple[int, int]]:
    """(node, one node of its strong component) of a few edges: depth first along the edges,
    then against them in the order of leaving."""
    ahead, back = {}, {}
    for a, b in edges:
        ahead.setdefault(a, []).append(b)
        back.setdefault(b, []).append(a)
    order, seen = [], set()
    for root in {*ahead, *back}:
        stack = [(root, iter(ahead.get(root, ())))] if root not in seen else []
        seen.add(root)
        while stack:
            node, rest = stack[-1]
            after = next((x for x in rest if x not in seen), None)
            if after is None:
                order.append(stack.pop()[0])
            else:
                seen.add(after)
                stack.append((after, iter(ahead.get(after, ()))))
    owner: dict[int, int] = {}
    for root in reversed(order):
        stack = [root] if root not in owner else []
        owner.setdefault(root, root)
        while stack:
            for x in back.get(stack.pop(), ()):
                if x not in owner:
                    owner[x] = root
                    stack.append(x)
    return list(owner.items())


def _spread(edges: DataFrame, marks: DataFrame, steps: int = 2) -> DataFrame:
    """edges (src, dst), marks (node, mark or null) -> node, mark: the least of all that
    reach the node. A round goes ``steps`` edges far, for fewer tables."""
    now, more = cut(marks, "spread"), True
    while more:
        now = now.select("node", "mark", F.col("mark").alias("old"))
        for _ in range(steps):
            near = edges.join(_wide(now.select(F.col("node").alias("src"), "mark").dropna()), "src").groupBy(F.col("dst").alias("node")).agg(F.min("mark").alias("near"))
            now = now.join(_wide(near), "node", "left").select("node", F.least("mark", "near").alias("mark"), "old")
        now, more = cut_any(now, "spread", ~F.col("mark").eqNullSafe(F.col("old")))
        now = now.select("node", "mark")
    return now


def rollup(nodes: DataFrame, edges: DataFrame, max_rounds: int = 1000, cut_cycles: bool = False) -> DataFrame:
    """nodes (node, size), edges (src, dst) -> node, total, paths.

    A node's total is its own size and the totals of what it depends on; a shared child
    counts once for each path. Every round hands sums one edge up, so it moves a row a
    node and edge, never a row for each pair of a node and what it reaches. Edges that
    repeat are paths of their own, null ends are ignored; a path of more than
    ``max_rounds`` edges, as in a cycle, is an error. With ``cut_cycles`` edges whose ends
    reach each other are left out first, so each node of a cycle has its own share only.
    """
    if cut_cycles:
        comp = strong_components(edges)
        side = lambda end: comp.select(F.col("node").alias(end), F.col("comp").alias(f"__{end}"))
        edges = edges.join(_wide(side("src")), "src").join(_wide(side("dst")), "dst").filter("__src <> __dst").select("src", "dst")
    edges = cut(edges.select("src", "dst").dropna(), "rollup-edges")
    step, more = cut_any(nodes.select("node", F.col("size").alias("total"), F.lit(1).cast("bigint").alias("paths")), "rollup")
    found, known = step, nodes.select("node").distinct()
    for _ in range(max_rounds):
        if more:
            up = step.join(_wide(edges), step["node"] == edges["dst"]).groupBy(F.col("src").alias("node"))
            step, more = cut_any(up.agg(F.sum("total").alias("total"), F.sum("paths").alias("paths")), "rollup")
        if not more:
            return found.groupBy("node").agg(F.sum("total").alias("total"), F.sum("paths").alias("paths")).join(_wide(known), "node", "left_semi")
        found = found.unionByName(step)
    raise ValueError(f"a path has more than {max_rounds} edges; is there a cycle?")
