"""Human decisions on groups: validation against an audit snapshot and the live groups, application, merging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# What a reviewer may decide.
ACTIONS = ("approve-recommendation", "select-different", "keep-multiple", "not-related", "defer")


def validate(decisions: DataFrame, snapshot: DataFrame, live: DataFrame) -> DataFrame:
    """Decisions with ``verdict`` (valid, invalid, stale) and ``reason``; the first failed test counts.

    ``decisions``: group_id, selected_id, action, note; groups: group_id,
    members (array), recommended_id.
    """
    c = F.col
    snap = snapshot.select("group_id", F.array_sort("members").alias("_ref"), F.col("recommended_id").alias("_rec"), F.lit(True).alias("_known"))
    now = live.select("group_id", F.array_sort("members").alias("_now"), F.lit(True).alias("_alive"))
    times = F.count(F.lit(1)).over(Window.partitionBy("group_id"))
    out = decisions.withColumn("_n", times).join(snap, "group_id", "left").join(now, "group_id", "left")
    text = F.concat
    reason = (
        F.when(c("_n") > 1, text(c("_n").cast("string"), F.lit(" decisions name this group, one is allowed")))
        .when(c("_known").isNull(), "unknown group")
        .when(c("selected_id").isNotNull() & (c("selected_id") != "") & ~F.array_contains("_ref", c("selected_id")), text(c("selected_id"), F.lit(" is in another group or in none")))
        .when((c("action") == "approve-recommendation") & ~c("selected_id").eqNullSafe(c("_rec")), "approval of an image that was not recommended")
        .when(c("_alive").isNull(), "stale: the group is gone")
        .when(c("_ref") != c("_now"), text(F.lit("stale: other members, "), F.size("_ref").cast("string"), F.lit(" then and "), F.size("_now").cast("string"), F.lit(" now")))
    )
    stale = c("reason").startswith("stale: ")
    return out.withColumn("reason", reason).withColumn("verdict", F.when(c("reason").isNull(), "valid").when(stale, "stale").otherwise("invalid")).drop("_n", "_ref", "_rec", "_known", "_now", "_alive")


def review_reason(action, note):
    return F.concat(F.lit("reviewer's decision: "), action, F.when(note.isNotNull() & (note != ""), F.concat(F.lit(" ("), note, F.lit(")"))).otherwise(""))


def apply(groups: DataFrame, decisions: DataFrame) -> DataFrame:
    """Groups after at most one decision each (status, recommendation, score, one reason more)."""
    d = decisions.select("group_id", F.col("selected_id").alias("_sel"), F.col("action").alias("_act"), F.col("note").alias("_note"))
    out = groups.join(d, "group_id", "left")
    act = F.col("_act")
    keep = act.isNull() | act.isin("approve-recommendation", "defer")
    return (
        out.withColumn("status", F.when(act.isin("approve-recommendation", "select-different", "keep-multiple"), "approved").when(act == "not-related", "rejected").otherwise(F.col("status")))
        .withColumn("recommended_id", F.when(keep, F.col("recommended_id")).when(act == "select-different", F.col("_sel")))
        .withColumn("score", F.when(keep, F.col("score")))
        .withColumn("reasons", F.when(act.isNull(), F.col("reasons")).otherwise(F.concat("reasons", F.array(review_reason(act, F.col("_note"))))))
        .drop("_sel", "_act", "_note")
    )


def merge(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """New decisions replace old ones of the same group and keep their place; others follow."""
    old = existing.withColumn("_old", F.col("position"))
    fresh = incoming.join(old.select("group_id", "_old"), "group_id", "left")
    kept = old.join(incoming.select("group_id"), "group_id", "left_anti").withColumn("_set", F.lit(0))
    fresh = fresh.withColumn("_set", F.when(F.col("_old").isNull(), 1).otherwise(0)).withColumn("_old", F.coalesce("_old", "position"))
    out = kept.unionByName(fresh, allowMissingColumns=True)
    return out.withColumn("position", F.col("_set") * F.lit(1 << 40) + F.col("_old")).drop("_set", "_old")


def violations(groups: DataFrame) -> DataFrame:
    """(group_id, problem) of stored groups that break a rule; the first rule broken counts."""
    problem = (
        F.when(F.size("members") < 2, "fewer than two members")
        .when(F.col("recommended_id").isNotNull() & ~F.array_contains("members", F.col("recommended_id")), "winner is no member")
        .when((F.col("status") == "automatic") & F.col("score").isNull(), "automatic without a score")
    )
    return groups.select("group_id", problem.alias("problem")).where("problem is not null")
