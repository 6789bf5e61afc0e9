"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomwright.storage import stage


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One pass over edges (u, v) with u > v.

    Large-star links each node's greater neighbours to the least node around it, small-star
    its lesser neighbours and itself. The least node combines on the map side, and the join
    back can split a node of many neighbours.
    """
    around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = around.join(least, "u")
    if large:
        out = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return out.where("u <> v").distinct()


def connected_components(links: DataFrame, label: str) -> DataFrame:
    """node, component (its least node) of every node in ``links`` (a, b). No links: no rows.

    Each round is written to the shared folder. Rounds end when the edges stay the same: they
    are stars around the least nodes then. Links with a null end are left out.
    """
    edges = stage(
        links.where("a <> b").select(
            F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        f"{label}-edges",
    )
    mark = F.struct(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u")))
    state = edges.agg(mark).first()
    while state[0][0]:
        edges = stage(_stars(_stars(edges, True), False), f"{label}-stars")
        now = edges.agg(mark).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
