"""Graphs as tables: roots of trees, components, and choosing by priority. Every round is written, and only counts reach the driver:
joins of rounds are marked `merge`, as a broadcast would take one side through the driver in each round."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialise


def roots(edges: DataFrame) -> DataFrame:
    """(child, parent), at most one parent a child and no cycles -> (child, root), by doubling pointers: as many joins as the
    longest way up has binary digits."""
    up = materialise(edges.select("child", F.col("parent").alias("root")), "roots")
    while True:
        above = up.select(F.col("child").alias("root"), F.col("root").alias("_r"))
        up = materialise(up.join(above.hint("merge"), "root", "left").select("child", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")), "roots")
        moved = not up.where("moved").isEmpty()
        up = up.drop("moved")
        if not moved:
            return up


def components(edges: DataFrame) -> DataFrame:
    """(u, v) of any one type -> (node, root), root the least node of the component; both ends of every edge are listed. Each
    round a node learns the least root of its neighbours, hangs its own root under it, and pointers are doubled, so that long
    chains take few rounds."""
    both = materialise(edges.select("u", "v").unionAll(edges.select("v", "u")).distinct(), "component-edges")
    at = materialise(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("root")), "components")
    while True:
        name = at.select(F.col("node").alias("v"), F.col("root").alias("of_v"))
        low = both.join(name.hint("merge"), "v").groupBy(F.col("u").alias("node")).agg(F.min("of_v").alias("low"))
        seen = at.join(low.hint("merge"), "node").select("node", "root", F.least("root", "low").alias("low"))
        hook = seen.where("low < root").groupBy("root").agg(F.min("low").alias("to"))  # the least root that any of its nodes has heard of
        hung = materialise(seen.join(hook.hint("merge"), "root", "left").select("node", F.least("low", F.coalesce("to", "low")).alias("root"), (F.col("low") < F.col("root")).alias("changed")), "components")
        if hung.where("changed").isEmpty():
            return at
        above = hung.select(F.col("node").alias("root"), F.col("root").alias("_r"))
        at = materialise(hung.join(above.hint("merge"), "root", "left").select("node", F.least("root", F.coalesce("_r", "root")).alias("root")), "components")


def chosen(rows: DataFrame, order: list[Column], key: list[str], sides: str = "sides") -> DataFrame:
    """The rows that are taken when all are gone through in ascending order, each if none of its `sides` (an array of what it
    claims) is claimed by a row taken before. order is total, key names columns that tell rows apart. In each round every row that
    is first on all its sides is taken, and what claims the same goes; that gives the same rows as one row after the other."""
    left, taken = materialise(rows, "claims"), None
    while not left.isEmpty():
        each = left.select(*key, F.explode(sides).alias("_side"), *[o.alias(f"_o{k}") for k, o in enumerate(order)])
        place = F.row_number().over(Window.partitionBy("_side").orderBy(*[f"_o{k}" for k in range(len(order))]))
        each = materialise(each.withColumn("_place", place).select(*key, "_side", "_place"), "claims")
        first = left.join(each.where("_place > 1").hint("merge"), key, "left_anti")
        first = materialise(first, "claims-taken")
        taken = first if taken is None else taken.unionAll(first)
        gone = each.join(first.select(F.explode(sides).alias("_side")).hint("merge"), "_side", "left_semi").select(*key).distinct()
        left = materialise(left.join(gone.hint("merge"), key, "left_anti"), "claims")
    return taken if taken is not None else left


def first_of_neighbours(nodes: DataFrame, order: list[Column], edges: DataFrame) -> DataFrame:
    """The rows of nodes (node, ...) that stay when all are gone through in ascending order, each if no neighbour of it (edges
    a, b of nodes) has stayed before. order is total. In each round every row that comes before all its undecided neighbours stays, and
    its neighbours go; that gives the same rows as one row after the other."""
    left = materialise(nodes.withColumn("_o", F.struct(*order)), "undecided")
    rank = lambda c: left.select(F.col("node").alias(c), F.col("_o").alias(f"_{c}"))
    both = edges.where("a <> b").select("a", "b").join(rank("a").hint("merge"), "a").join(rank("b").hint("merge"), "b")
    swap = F.col("_a") < F.col("_b")
    pairs = materialise(both.select(F.when(swap, F.col("a")).otherwise(F.col("b")).alias("before"), F.when(swap, F.col("b")).otherwise(F.col("a")).alias("after")).distinct(), "undecided-pairs")
    stay = None
    while not left.isEmpty():
        first = materialise(left.join(pairs.select(F.col("after").alias("node")).hint("merge"), "node", "left_anti"), "stay")
        stay = first if stay is None else stay.unionAll(first)
        gone = pairs.join(first.select(F.col("node").alias("before")).hint("merge"), "before", "left_semi").select(F.col("after").alias("node"))
        settled = materialise(first.select("node").unionAll(gone).distinct(), "settled")
        left = materialise(left.join(settled.hint("merge"), "node", "left_anti"), "undecided")
        open_ = lambda df, c: df.join(settled.withColumnRenamed("node", c).hint("merge"), c, "left_anti")  # noqa: B023, E731
        pairs = materialise(open_(open_(pairs, "before"), "after"), "undecided-pairs")
    return (left if stay is None else stay).drop("_o")
