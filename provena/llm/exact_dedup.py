"""Exact deduplication by progressive refinement, DataFrame functions only.

Rows are grouped by the length of the normalised text, then by a hash of its
prefix, and only rows whose (length, prefix) is shared by another row have
their full text hashed.  Which (length, prefix) classes survive is carried to
the full-text scan as a bitmap of ``2**FILTER_BITS`` buckets: its size is fixed
whatever the corpus, so broadcasting it is safe; a saturated bitmap costs time
and never changes the result.  No text ever crosses a shuffle, and no row is
looked up by its key: the second scan makes the rows of the result.

Edge cases: null text counts as empty; all empty texts form one group; rows
with a null key are never grouped; exact ties on code points go to the smaller
key; rows repeated under one key are grouped by their own texts.  Further
columns of the input are ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS_CHARS, materialise

FILTER_BITS = 20
PREFIX_CHARS = 64


def normalised(text: Column) -> Column:
    """The text without any character of ``[\\x20\\x09-\\x0D]``; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for c in WS_CHARS:  # byte searches; much cheaper than translate() or a regular expression
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def exact_dedup(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    carry: dict[str, Column] | None = None,
    prefix_chars: int = PREFIX_CHARS,
    filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """One row per input row: ``key``, ``keep_id``, ``group_size``, ``kept`` and the ``carry`` columns.

    ``carry`` maps output names to expressions over ``_norm`` (the normalised
    text), ``_text`` and ``_id`` that are evaluated in the second scan; the full
    hash of survivors is the same expression as a carried digest, so Spark makes
    it once.  The row with the most code points in its original text stays, then
    the smallest key.
    """
    carry = carry or {}
    rows = docs.select(F.col(key).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"), normalised(F.col(text)).alias("_norm"))
    prefix = F.xxhash64(F.substring("_norm", 1, prefix_chars)).alias("_prefix")
    # Stages one and two: lengths, then prefixes within lengths, that more than one row has.
    first = rows.where("_id is not null").select(F.char_length("_norm").alias("_len"), prefix)
    by_prefix = materialise(first.groupBy("_len", "_prefix").agg(F.count(F.lit(1)).alias("_n")), "lengths")
    by_length = by_prefix.groupBy("_len").agg(F.sum("_n").alias("_m")).where("_m > 1").select("_len")
    shared = by_prefix.where("_n > 1").join(by_length, "_len", "left_semi")
    bucket = F.pmod(F.xxhash64("_len", "_prefix"), F.lit(1 << filter_bits))
    bitmap = shared.select(bucket.alias("_bucket")).distinct().withColumn("_hit", F.lit(True))  # at most 2**filter_bits rows
    # Stage three: the full hash, computed after the filter, for survivors only.
    marked = rows.withColumn("_len", F.char_length("_norm")).withColumn("_prefix", prefix).withColumn("_bucket", bucket).join(F.broadcast(bitmap), "_bucket", "left")
    full = F.when(F.col("_hit") & F.col("_id").isNotNull(), F.unhex(F.sha2("_norm", 256))).alias("_full")
    second = materialise(marked.select("_id", F.char_length("_text").alias("_chars"), "_len", full, *(c.alias(n) for n, c in carry.items())), "survivors")
    best = materialise(
        second.where("_full is not null")
        .groupBy("_len", "_full")
        .agg(F.min_by("_id", F.struct((-F.col("_chars")).alias("a"), F.col("_id"))).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1"),
        "groups",
    )  # a table of its own, so that the join below is one whose large groups Spark can split
    found = second.where("_full is not null").join(best, ["_len", "_full"], "left")
    alone = second.where("_full is null").withColumn("keep_id", F.col("_id")).withColumn("group_size", F.lit(1).cast("long"))
    return found.unionByName(alone).select(
        F.col("_id").alias(key),
        F.coalesce("keep_id", "_id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("keep_id") == F.col("_id"), F.lit(True)).alias("kept"),
        *carry,
    )
