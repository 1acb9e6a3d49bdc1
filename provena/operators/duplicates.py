"""Exact-duplicate groups, their members and edges, hard links, wasted bytes, path preferences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.functions.paths import preference_score

Preferences = Sequence[tuple[str, float]]


def path_order(path: str = "relative_path", id_: str = "id") -> Column:
    """Presentation order of records: ICU order of paths, then ids."""
    return F.struct(F.collate(F.col(path), "UNICODE").alias("p"), F.col(id_).alias("i"))


def group_id(sha: Column) -> Column:
    return F.concat(F.lit("grp_"), F.substring(sha, 1, 24))


def duplicate_keys(images: DataFrame, preferences: Preferences = ()) -> DataFrame:
    """One row a content hash that several records share; aggregated map-side, so a hot hash is no hot task."""
    score = preference_score(F.col("relative_path"), preferences)
    first = F.struct(F.col("relative_path").alias("path"), F.col("id"), F.col("size_bytes"))
    return (
        images.withColumn("_score", score)
        .groupBy("sha256")
        .agg(
            F.count(F.lit(1)).alias("members"),
            F.min_by(first, path_order()).alias("_rep"),
            F.max("_score").alias("max_score"),
            F.max_by(F.col("relative_path"), F.col("_score")).alias("_best_path"),
            F.max_by(F.col("id"), F.col("_score")).alias("_best_id"),
        )
        .where("members >= 2")
    )


def exact_groups(images: DataFrame, preferences: Preferences = ()) -> DataFrame:
    """Groups with representative, wasted bytes, and the outcome of the path preferences.

    A preference decides only if its best score is not zero and one member alone has it.
    """
    keys = duplicate_keys(images, preferences)
    scored = images.select("sha256", preference_score(F.col("relative_path"), preferences).alias("max_score"))
    ties = scored.join(keys.select("sha256", "max_score"), ["sha256", "max_score"]).groupBy("sha256").agg(F.count(F.lit(1)).alias("_top"))
    signal = F.lit(bool(preferences)) & (F.col("max_score") != 0)
    won = signal & (F.col("_top") == 1)
    return keys.join(ties, "sha256").select(
        group_id(F.col("sha256")).alias("group_id"),
        "sha256",
        "members",
        F.col("_rep.id").alias("representative_id"),
        ((F.col("members") - 1) * F.col("_rep.size_bytes")).alias("wasted_bytes"),
        F.when(won, F.col("_best_id")).alias("recommended_id"),
        F.when(won, "automatic").otherwise("manual-review").alias("status"),
        F.when(won, 1.0).when(signal, 0.5).otherwise(0.0).alias("confidence"),
        F.concat(F.col("members").cast("string"), F.lit(" files with SHA-256 "), F.substring("sha256", 1, 12), F.lit("…")).alias("reason"),
        F.when(won, F.concat(F.lit("preferred path: "), F.col("_best_path"))).alias("preference_reason"),
        F.when(won, F.lit(None))
        .when(signal, "several paths are preferred alike")
        .otherwise("no path is preferred, so no copy is chosen")
        .alias("warning"),
    )


def exact_members(images: DataFrame) -> DataFrame:
    """(group_id, image_id, representative) of every member."""
    keys = duplicate_keys(images).select("sha256", F.col("_rep.id").alias("_rep_id"))
    return images.join(keys, "sha256").select(group_id(F.col("sha256")).alias("group_id"), F.col("id").alias("image_id"), "relative_path", (F.col("id") == F.col("_rep_id")).alias("representative"))


def exact_edges(images: DataFrame) -> DataFrame:
    """Star edges from the representative to every other member, with confidence 1."""
    keys = duplicate_keys(images).select("sha256", F.col("_rep.id").alias("a"))
    joined = images.join(keys, "sha256").where(F.col("id") != F.col("a"))
    return joined.select(group_id(F.col("sha256")).alias("group_id"), "a", F.col("id").alias("b"), F.lit("exact-duplicate").alias("relationship"), F.lit(1.0).alias("confidence"), F.lit("same SHA-256").alias("reason"))


def hard_links(images: DataFrame) -> DataFrame:
    """Clusters of one inode inside a duplicate group."""
    shared = images.groupBy("sha256").agg(F.count(F.lit(1)).alias("_n")).where("_n >= 2").select("sha256")
    return images.join(shared, "sha256", "left_semi").groupBy("sha256", "device", "inode").agg(F.count(F.lit(1)).alias("members"), F.min("id").alias("first_id")).where("members > 1").select(group_id(F.col("sha256")).alias("group_id"), "device", "inode", "members", "first_id")


def wasted_total(images: DataFrame) -> DataFrame:
    """Totals over all groups; hard links are not subtracted."""
    return exact_groups(images).agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("members"), F.lit(0)).alias("files"), F.coalesce(F.sum("wasted_bytes"), F.lit(0)).alias("wasted_bytes"))
