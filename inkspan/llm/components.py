"""Connected components by repeated contraction, all in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.llm.common import discard, stage


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b): links between long ids, in any direction, repeats allowed. Returns (node, component) for every node with a
    link to another: component is the smallest node reachable. Each round hooks a node to its smallest neighbour, jumps one
    pointer further, and goes on with the contracted links, so the rounds grow with the logarithm of the longest path. A node
    always hooks to a smaller one, so the last one standing is the smallest. Hubs are only ever aggregated by min(), or joined
    over two exchanges, which adaptive execution splits. Empty input: no rows. Null ends are ignored."""
    ordered = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    links = stage(edges.where("a != b").select(*ordered(F.col("a"), F.col("b"))).distinct())
    found: DataFrame | None = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooked = stage(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("up")))
        far = hooked.select(F.col("node").alias("up"), F.col("up").alias("top"))
        hooks = stage(hooked.join(far, "up").select("node", F.col("top").alias("component")))
        left, right = (hooks.select(F.col("node").alias(x), F.col("component").alias(f"top_{x}")) for x in "ab")
        moved = links.join(left, "a").join(right, "b").where("top_a != top_b")
        before, links = links, stage(moved.select(*ordered(F.col("top_a"), F.col("top_b"))).distinct())
        discard(before, hooked)
        if found is None:
            found = hooks
        else:
            next_up = hooks.select(F.col("node").alias("component"), F.col("component").alias("next_top"))
            last, found = found, stage(found.join(next_up, "component", "left").select("node", F.coalesce("next_top", "component").alias("component")))
            discard(last, hooks)
    if found is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found
