"""Connected components over a table of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import Scratch


def _signature(edges: DataFrame):
    h = F.xxhash64("hi", "lo")
    return tuple(edges.agg(F.count("*"), F.sum(F.shiftright(h, 20)), F.bit_xor(h)).first())


def connected_components(links: DataFrame, a: str = "a", b: str = "b", scratch: Scratch | None = None) -> DataFrame:
    """(node, component): every node that occurs in ``links`` and the smallest node
    that it reaches. ``a`` and ``b`` are of one orderable type; self links and nulls
    are ignored, so a node with only those does not appear; no links, no rows.

    Large-star and small-star rounds (a node hands its neighbours to the least of
    them) contract every component to a star in O(log^2) rounds. A round's table is
    written to the shared folder, so lineage stays short and a lost executor costs
    one stage. Least neighbours come from a map-side combined min joined back, not
    from a window, so that a hub's rows need not meet in one task."""
    spark = links.sparkSession
    scratch = scratch or Scratch(spark, "components")
    edges = scratch.put(
        links.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
        .distinct()
    )
    before = _signature(edges)
    if not before[0]:
        return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    while True:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(least, "hi")
            .where("lo <> m")
            .select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .union(least.select("hi", F.col("m").alias("lo")))
            .distinct()
        )
        done = scratch.put(small)
        scratch.drop(edges)
        edges, after = done, _signature(done)
        if after == before:
            break
        before = after
    star = edges.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return star.union(star.select(F.col("component").alias("node"), "component").distinct())
