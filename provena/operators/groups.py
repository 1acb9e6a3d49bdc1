"""Connected components and visual groups (a representative and its direct neighbours)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import cut


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node of its component, for every node of the edges (a, b).

    Alternates two star operations until no edge changes; rounds grow with the
    logarithm of a component's size.  Every step is a table of its own, so a
    lost executor costs one step, and hubs are joins that can be split.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = mark(now)
    for _ in range(max_rounds):
        if not before[0]:
            break
        sides = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(sides.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "low")
        hung = cut(sides.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        low = cut(hung.groupBy("u").agg(F.min("v").alias("m")), "low")
        moved = hung.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now = cut(moved.where("u <> v").distinct(), "small-star")
        after = mark(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def visual_members(edges: DataFrame) -> DataFrame:
    """(component, image_id, accepted): a member needs a direct confirmed edge to the component's smallest node."""
    known = edges.where("relationship <> 'unknown'").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    nodes = connected_components(known)
    direct = known.select(F.col("a").alias("component"), F.col("b").alias("node")).distinct().withColumn("_direct", F.lit(True))
    return nodes.join(direct, ["component", "node"], "left").select("component", F.col("node").alias("image_id"), (F.coalesce("_direct", F.lit(False)) | (F.col("node") == F.col("component"))).alias("accepted"))


def visual_groups(edges: DataFrame, manual_threshold: float = 0.7) -> DataFrame:
    """One row a group: id, members, weakest confidence over all edges among accepted members, status, excluded nodes."""
    members = cut(visual_members(edges), "visual-members")
    inside = members.where("accepted").select(F.col("image_id"), F.col("component"))
    among = (
        edges.where("relationship <> 'unknown'")
        .join(inside.select(F.col("image_id").alias("a"), "component"), "a")
        .join(inside.select(F.col("image_id").alias("b"), F.col("component").alias("_cb")), "b")
        .where("component = _cb")
    )
    weakest = among.groupBy("component").agg(F.min("confidence").alias("confidence"), F.count(F.lit(1)).alias("edges"))
    listed = members.groupBy("component").agg(
        F.array_sort(F.collect_list(F.when(F.col("accepted"), F.col("image_id")))).alias("members"),
        F.array_sort(F.collect_list(F.when(~F.col("accepted"), F.col("image_id")))).alias("excluded"),
    )
    return listed.join(weakest, "component").select(
        F.concat(F.lit("grp_v_"), F.substring(F.sha2(F.array_join("members", ","), 256), 1, 24)).alias("group_id"),
        F.lit("visual").alias("kind"),
        "component",
        "members",
        "excluded",
        "edges",
        "confidence",
        F.when(F.col("confidence") < manual_threshold, "ambiguous").otherwise("manual-review").alias("status"),
    )
