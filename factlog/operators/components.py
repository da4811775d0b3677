"""Connected components by randomised contraction of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlog.session import discard, written


def _renamed(labels: DataFrame, by: DataFrame) -> DataFrame:
    """`(id, to)` of `labels` with each `to` replaced by what `by` says of it; what `by` does not know stays."""
    step = by.select(F.col("id").alias("to"), F.col("to").alias("next"))
    return labels.join(step, "to", "left").select("id", F.coalesce("next", "to").alias("to"))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """`(id, component)` for every vertex of an undirected edge table; component is the smallest id that is reachable.

    Each round gives every vertex a random priority (a hash of its id and the round). A vertex hooks to the least of its closed
    neighbourhood, that one's hook is followed once more, and the edges are rewritten between the ends. Priorities are new in
    every round, so a constant share of the vertices goes in each, whatever the shape of the graph and the order of its ids:
    the rounds grow with the logarithm of a component's size, and the tables shrink geometrically. Hooks are then folded from the last
    round back to the first. Every round is written and read again, so its plan begins with a scan; nothing is collected. Minima are
    taken before the shuffle, so a hub is no hot key there.
    Null ends are ignored; a vertex with only a self loop is its own component; an empty table gives an empty result.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    e = written(e.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    hooks: list[DataFrame] = []
    while not e.isEmpty():
        rank = lambda c, k=len(hooks): F.struct(F.xxhash64(c, F.lit(k)).alias("rank"), F.col(c).alias("id"))
        ends = e.select("u", rank("v").alias("p")).union(e.select(F.col("v").alias("u"), rank("u").alias("p")))
        hook = ends.groupBy("u").agg(F.min("p").alias("p")).select(F.col("u").alias("id"), F.least("p", rank("u"))["id"].alias("to"))
        hook = written(_renamed(hook, hook))
        hooks.append(hook)
        a, b = hook.select(F.col("id").alias("u"), F.col("to").alias("a")), hook.select(F.col("id").alias("v"), F.col("to").alias("b"))
        moved = e.where("u <> v").join(a, "u").join(b, "v").where("a <> b")
        old, e = e, written(moved.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
        discard(old)
    if not hooks:
        return e.select(F.col("u").alias("id"), F.col("u").alias("component"))
    labels = hooks.pop()
    while hooks:
        hook = hooks.pop()
        old, labels = labels, written(_renamed(hook, labels))
        discard(old, hook)
    lowest = labels.groupBy("to").agg(F.min("id").alias("component"))
    return labels.join(lowest, "to").select("id", "component")
