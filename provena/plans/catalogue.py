"""Query catalogue of the asset-provenance engine over the driver's tables."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.functions import hashes
from provena.functions.paths import by_plainness, matches_any, plain_slug, preference_score, sanitise, slugify
from provena.operators import compare, consolidate, duplicates, groups, hamming, review, scoring, tables
from provena.plans.config import NAMINGS, Review
from provena.plans.oracle_sql import CROP_DISTANCE, LOOSE_SIMILARITY, PAIR_DISTANCE, PREFERENCES, SIMILARITY, TOLERANCE, all_sql
from provena.sources import adapters, discovery

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
REVIEW = Review(automatic_threshold=0.9)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) for c in columns})


def joined(c: str):
    return F.array_join(c, ",").alias(c)


# --- Exact duplicates -----------------------------------------------------------


@query
def exact_duplicate_groups(spark, d):
    return duplicates.exact_groups(adapters.images(spark, d), PREFERENCES).select("group_id", "sha256", "members", "representative_id", "wasted_bytes", "recommended_id", "status", "confidence")


@query
def exact_duplicate_members(spark, d):
    return duplicates.exact_members(adapters.images(spark, d))


@query
def exact_duplicate_edges(spark, d):
    return duplicates.exact_edges(adapters.images(spark, d))


@query
def wasted_bytes_total(spark, d):
    return duplicates.wasted_total(adapters.images(spark, d))


@query
def hard_link_clusters(spark, d):
    return duplicates.hard_links(adapters.images(spark, d))


@query
def path_preference_scores(spark, d):
    return adapters.images(spark, d).select("id", "relative_path", preference_score(F.col("relative_path"), PREFERENCES).alias("score"))


@query
def path_preference_winner(spark, d):
    return duplicates.exact_groups(adapters.images(spark, d), PREFERENCES).where("recommended_id is not null").select("group_id", "recommended_id")


# --- Discovery and cache ----------------------------------------------------------


@query
def discovery_format_sniff(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id")
    heads = {0: "FFD8FFE000104A464946", 1: "89504E470D0A1A0A0000", 2: "47494638396100000000", 3: "524946460000000057454250", 4: "0000001C6674797061766966"}
    head = F.coalesce(*[F.when(F.col("doc_id") % 6 == k, F.lit(v)) for k, v in heads.items()], F.lit("00112233"))
    ext = F.when(F.col("doc_id") % 4 == 0, ".JPG").when(F.col("doc_id") % 4 == 1, ".png").when(F.col("doc_id") % 4 == 2, ".gif").otherwise(".txt")
    files = docs.select("doc_id", F.concat(F.lit("f"), F.col("doc_id").cast("string"), ext).alias("name"), F.unhex(head).alias("head"))
    return discovery.resolve_format(files, "name", "head").select("doc_id", "extension", "by_extension", "by_content", "format", "status")


@query
def discovery_realpath_dedup(spark, d):
    k = F.col("doc_id")
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id")
    files = docs.select("doc_id", (k % 3).alias("input_index"), F.concat(F.lit("/in"), (k % 3).cast("string"), F.lit("/"), k.cast("string")).alias("absolute_path"), F.concat(F.lit("/real/"), F.floor(k / 2).cast("string")).alias("real_path"))
    return discovery.first_real_path(files).select("doc_id", "absolute_path", "status")


def _seen(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("real_path"), F.col("n_chars").alias("size_bytes"))
    known = docs.where("doc_id % 4 <> 0").withColumn("modified_at", F.when(F.col("doc_id") % 10 == 3, "2026-01-02").otherwise("2026-01-01"))
    return known, docs.withColumn("modified_at", F.lit("2026-01-01"))


@query
def cache_reuse_anti_join(spark, d):
    known, seen = _seen(spark, d)
    return tables.changed(known, seen).select("doc_id", "real_path", "size_bytes", "modified_at")


@query
def record_upsert(spark, d):
    known, seen = _seen(spark, d)
    return tables.upsert(known, seen.where("doc_id % 5 = 0"), "real_path").select("doc_id", "real_path", "size_bytes", "modified_at")


# --- Similarity joins ---------------------------------------------------------------


@query
def perceptual_hashes(spark, d):
    return adapters.hashed(spark, d).select("id", "aspect_ratio", "d_hi", "d_lo", "p_hi", "p_lo")


def _pairs(spark, d):
    return hamming.candidate_pairs(adapters.hashed(spark, d), PAIR_DISTANCE, TOLERANCE)


@query
def hamming_pairs_t10(spark, d):
    """The default distance, which is joined by bands: every record beside a copy with up to eleven bits turned."""
    own = adapters.hashed(spark, d)
    return hamming.candidate_pairs(own.unionByName(adapters.near_copies(own)), 10, TOLERANCE).select("a", "b", "d_distance", "p_distance")


@query
def candidate_pairs(spark, d):
    return rounded(_pairs(spark, d), "aspect_delta")


@query
def aspect_bucket_pairs(spark, d):
    return hamming.aspect_partners(adapters.records(spark, d), TOLERANCE).select("id", F.round("aspect_class", 6).alias("aspect_class"), "partners")


@query
def orientation_variant_pairs(spark, d):
    return hamming.candidate_pairs(adapters.hashed(spark, d), PAIR_DISTANCE, TOLERANCE, adapters.variants(spark, d)).select("a", "b", "d_distance", "p_distance")


@query
def crop_candidate_pairs_t28(spark, d):
    return hamming.crop_pairs(adapters.hashed(spark, d), CROP_DISTANCE)


@query
def crop_extra_pairs_anti(spark, d):
    return hamming.crop_pairs_beyond(adapters.hashed(spark, d), CROP_DISTANCE, PAIR_DISTANCE, TOLERANCE)


# --- Confirmation and groups ----------------------------------------------------------


def _compared(spark, d, threshold=SIMILARITY):
    return compare.classify(adapters.pair_features(_pairs(spark, d).select("a", "b"), adapters.records(spark, d)), threshold)


@query
def classify_relationship(spark, d):
    return rounded(_compared(spark, d).select("a", "b", "ssim", "transform", "relationship", "confidence"), "confidence")


@query
def unconfirmed_pairs(spark, d):
    return rounded(_compared(spark, d).where("relationship = 'unknown'").select("a", "b", "ssim", "confidence"), "confidence")


@query
def relationship_counts(spark, d):
    return _compared(spark, d).groupBy("relationship").agg(F.count(F.lit(1)).alias("pairs"))


def _edges(spark, d, threshold=SIMILARITY):
    return tables.cut(_compared(spark, d, threshold).select("a", "b", "relationship", "confidence"), "compared")


@query
def connected_components(spark, d):
    return groups.connected_components(_edges(spark, d).where("relationship <> 'unknown'").select("a", "b"))


def _visual(spark, d):
    return groups.visual_groups(_edges(spark, d))


@query
def visual_groups(spark, d):
    return rounded(_visual(spark, d).select("group_id", joined("members"), "edges", "confidence", "status"), "confidence")


@query
def visual_group_exclusions(spark, d):
    """At a lower threshold, where chains of similar images form."""
    return groups.visual_members(_edges(spark, d, LOOSE_SIMILARITY)).where("not accepted").select("component", "image_id")


# --- Scoring ---------------------------------------------------------------------------


def _scored(spark, d):
    """(groups, members, signals) with the groups cut, since several plans share them."""
    g = tables.cut(_visual(spark, d), "groups")
    members = g.select("group_id", F.explode("members").alias("image_id"))
    return g, members, adapters.signals(members, adapters.records(spark, d))


@query
def member_signals(spark, d):
    return rounded(_scored(spark, d)[2].drop("position"), "retained")


@query
def scoring_context(spark, d):
    return scoring.with_context(_scored(spark, d)[2]).select("group_id", "image_id", "max_detail", "max_pixels", "max_depth", "max_metadata", "any_complete", "any_genuine", "other_alpha")


@query
def candidate_scores(spark, d):
    parts = ("native_detail", "effective_resolution", "completeness", "depth_score", "metadata_score", "total")
    return rounded(scoring.scores(_scored(spark, d)[2]).select("group_id", "image_id", *parts, "disqualified"), *parts)


@query
def disqualified_candidates(spark, d):
    return scoring.scores(_scored(spark, d)[2]).where("disqualified").select("group_id", "image_id", F.size("disqualified_reasons").alias("strikes"))


@query
def top_eligible_per_group(spark, d):
    return rounded(scoring.top_eligible(scoring.scores(_scored(spark, d)[2])).select("group_id", "image_id", "total"), "total")


@query
def score_margin(spark, d):
    return rounded(scoring.margins(scoring.scores(_scored(spark, d)[2])).select("group_id", "best", "second", "margin"), "best", "second", "margin")


def _recommended(spark, d):
    g, members, signals = _scored(spark, d)
    return g, members, scoring.recommend(g, scoring.scores(signals), REVIEW)


@query
def recommendation_confidence(spark, d):
    return rounded(_recommended(spark, d)[2].select("group_id", "confidence"), "confidence")


@query
def group_status_decision(spark, d):
    return rounded(_recommended(spark, d)[2].select("group_id", "status", "recommended_id", "score", "candidate_id"), "score")


@query
def report_summary(spark, d):
    g, _, r = _recommended(spark, d)
    n = lambda s: F.count_if(F.col("status") == s)
    files = adapters.records(spark, d).agg(F.count(F.lit(1)).alias("files"))
    return r.agg(F.count(F.lit(1)).alias("groups"), n("automatic").alias("automatic"), n("manual-review").alias("manual_review"), n("ambiguous").alias("ambiguous")).join(F.broadcast(files)).select("files", "groups", "automatic", "manual_review", "ambiguous")


@query
def report_assets(spark, d):
    _, members, _ = _scored(spark, d)
    return adapters.records(spark, d).select(F.col("id").alias("image_id")).join(members, "image_id", "left_semi")


# --- Review -------------------------------------------------------------------------------


def _decisions(spark, d):
    """(snapshot groups, live groups, decisions) that exercise every verdict."""
    g, members, reco = _recommended(spark, d)
    place = adapters.records(spark, d).select(F.col("id").alias("component"), F.col("vec_id").alias("p"))
    snap = g.select("group_id", "members", "component").join(reco.select("group_id", "recommended_id", "status", "confidence", "score"), "group_id").join(place, "component").drop("component")
    snap = tables.cut(snap.withColumn("reasons", F.array().cast("array<string>")), "snapshot")
    p = F.col("p")
    live = snap.where("p % 7 <> 0").select("group_id", F.when(p % 9 == 0, F.slice("members", 1, F.size("members") - 1)).otherwise(F.col("members")).alias("members"))
    action = F.element_at(F.array(*map(F.lit, ("approve-recommendation", "select-different", "keep-multiple", "not-related", "defer", "select-different"))), (p % 6 + 1).cast("int"))
    chosen = F.when(p % 6 == 0, F.col("recommended_id")).when(p % 6 == 1, F.element_at("members", -1)).when(p % 6 == 5, "img_x")
    none = F.lit(None).cast("string")
    first = snap.select("group_id", chosen.alias("selected_id"), action.alias("action"), F.when(p % 4 == 0, "seen").alias("note"), p.alias("position"))
    again = snap.where("p % 10 = 0").select("group_id", none.alias("selected_id"), F.lit("defer").alias("action"), none.alias("note"), (p + 1000000).alias("position"))
    lost = snap.where("p % 8 = 0").select(F.concat(F.lit("grp_missing_"), p.cast("string")).alias("group_id"), none.alias("selected_id"), F.lit("defer").alias("action"), none.alias("note"), (p + 2000000).alias("position"))
    return snap, live, first.unionByName(again).unionByName(lost), members


def _verdicts(spark, d):
    snap, live, decisions, members = _decisions(spark, d)
    return snap, review.validate(decisions, snap, live), members


@query
def decision_validation(spark, d):
    return _verdicts(spark, d)[1].select("group_id", "position", "action", "verdict", "reason")


@query
def stale_decisions(spark, d):
    return _verdicts(spark, d)[1].where("verdict = 'stale'").select("group_id", "reason")


def _applied(spark, d):
    snap, verdicts, members = _verdicts(spark, d)
    return tables.cut(review.apply(snap.withColumnRenamed("p", "position"), verdicts.where("verdict = 'valid'")), "applied"), members


@query
def decision_apply(spark, d):
    return rounded(_applied(spark, d)[0].select("group_id", "status", "recommended_id", "score", joined("reasons")), "score")


@query
def decision_merge(spark, d):
    decisions = _decisions(spark, d)[2].where("position < 1000000")
    return review.merge(decisions.where("position % 2 = 0"), decisions.where("position % 3 = 0")).select("group_id", "action", "position")


@query
def unresolved_groups(spark, d):
    return consolidate.unresolved(_applied(spark, d)[0])


@query
def group_validator_violations(spark, d):
    """The snapshot with three kinds of damage: members lost, a winner from elsewhere, an automatic group without a score."""
    p = F.col("p")
    snap = _decisions(spark, d)[0].select(
        "group_id", F.when(p % 4 == 0, F.slice("members", 1, 1)).otherwise(F.col("members")).alias("members"), F.when(p % 4 == 1, "img_x").otherwise(F.col("recommended_id")).alias("recommended_id"),
        F.when(p % 4 == 2, "automatic").otherwise(F.col("status")).alias("status"), F.when(p % 4 != 2, F.col("score")).alias("score"),
    )
    return review.violations(snap)


# --- Consolidation -----------------------------------------------------------------------


def _vector_records(spark, d):
    return adapters.records(spark, d).select("id", F.concat(F.lit("vec/"), F.col("vec_id").cast("string")).alias("relative_path"))


@query
def select_originals(spark, d):
    applied, members = _applied(spark, d)
    out = consolidate.select_originals(applied, members, _vector_records(spark, d))
    return rounded(out.select("image_id", "method", "confidence", joined("group_ids"), joined("selected_from")), "confidence")


@query
def standalone_originals(spark, d):
    _, members, _ = _scored(spark, d)
    return consolidate.standalone(_vector_records(spark, d), members).select(F.col("id").alias("image_id"))


def _wanted(spark, d):
    r = adapters.images(spark, d).select("id", "relative_path", "sha256", "format", "width", "height")
    r = r.withColumns({"group_ids": F.array().cast("array<string>"), "capture_date": F.lit(None).cast("string"), "modified_at": F.lit(None).cast("string")})
    return r, r.select(F.col("id").alias("image_id"), "sha256", consolidate.base_path("content-hash").alias("base_path"))


@query
def canonical_paths_content_hash(spark, d):
    return consolidate.plan_paths(_wanted(spark, d)[1]).select("image_id", "canonical_path", "status")


@query
def path_collisions(spark, d):
    return consolidate.plan_paths(_wanted(spark, d)[1]).where("status = 'collision'").select("image_id", "collision_reason")


@query
def append_hash_resolution(spark, d):
    return consolidate.plan_paths(_wanted(spark, d)[1], "append-hash").select("image_id", "canonical_path", "status")


@query
def canonical_paths_sanitised(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_name", "p_type")
    raw = F.concat(F.lit("  "), F.col("p_name"), F.lit(": <"), F.col("p_type"), F.lit(">. "))
    p = by_plainness(p, F.col("p_name"), "slug", plain_slug(F.col("p_name")), slugify(F.col("p_name")))
    return p.select("p_partkey", F.concat("slug", F.lit(".png")).alias("sanitised_filename"), sanitise(raw).alias("component"))


@query
def manifest_rows(spark, d):
    records, wanted = _wanted(spark, d)
    chosen = records.select(F.col("id").alias("image_id"), F.lit("standalone").alias("method"), F.lit(1.0).alias("confidence"), F.col("group_ids").alias("selected_from"))
    return consolidate.manifest(consolidate.plan_paths(wanted), chosen, records).select("canonical_path", "sha256", "width", "height", "format")


@query
def latest_run(spark, d):
    return consolidate.latest_run(adapters.operations(spark, d))


@query
def rollback_eligible(spark, d):
    ops = adapters.operations(spark, d)
    return consolidate.rollback(ops, consolidate.latest_run(ops).first()["run_id"]).where("decision = 'remove'").select("operation_id", "destination")


@query
def rollback_skipped_reasons(spark, d):
    ops = adapters.operations(spark, d)
    return consolidate.rollback(ops, ops.agg(F.min("run_id")).first()[0]).where("decision = 'skip'").select("operation_id", "reason")


@query
def operations_by_status(spark, d):
    return adapters.operations(spark, d).groupBy("run_id", "status").agg(F.count(F.lit(1)).alias("operations"), F.count_distinct("destination").alias("destinations"))


# --- Report and references --------------------------------------------------------------


@query
def audit_summary(spark, d):
    return adapters.images(spark, d).groupBy("format").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"), F.count_if("is_upscale").alias("upscales"), F.count_if("has_alpha").alias("with_alpha")
    )


@query
def scan_errors_ordered(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.coalesce("html", F.lit("")).alias("html"))
    bad = p.where(~F.col("html").contains("</body>"))
    return bad.select(F.concat(F.lit("page/"), F.col("page_id").cast("string")).alias("file_path"), F.lit("cut short").alias("error")).orderBy("file_path", "error")


@query
def reference_extraction(spark, d):
    return adapters.references(spark, d)


@query
def reference_classes(spark, d):
    t = F.col("target")
    kind = F.when(t.startswith("data:"), "data-url").when(t.rlike("^(https?:)?//"), "external").when(t.startswith("#"), "fragment").when(t.startswith("/"), "absolute-path").otherwise("relative-path")
    return adapters.references(spark, d).groupBy(kind.alias("class")).agg(F.count(F.lit(1)).alias("refs"))


# --- Single rules and stored tables -------------------------------------------------------


def _neighbours(df, key, *columns):
    """Rows beside the row with the next key, as a_ and b_ columns."""
    side = lambda p, k: df.select(k.alias("_k"), *(F.col(c).alias(p + c) for c in columns))
    return side("a_", F.col(key)).join(side("b_", F.col(key) - 1), "_k").drop("_k")


@query
def hash_distances(spark, d):
    h = adapters.hashed(spark, d).withColumn("hash", hashes.halves_to_hex(F.col("d_hi"), F.col("d_lo")))
    return _neighbours(h, "order_key", "id", "hash").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.col("a_hash").alias("hash"), hashes.hamming_hex(F.col("a_hash"), F.col("b_hash")).alias("distance"))


@query
def orientation_hashes(spark, d):
    return adapters.variants(spark, d)


@query
def colour_deltas(spark, d):
    e = adapters.records(spark, d).withColumn("means", F.transform(F.slice("embedding", 1, 3 + F.col("vec_id").cast("int") % 2), lambda x: x.cast("double")))
    return _neighbours(e, "vec_id", "id", "means").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.round(compare.mean_colour_delta(F.col("a_means"), F.col("b_means")), 6).alias("delta"))


def _measured(spark, d):
    r = adapters.images(spark, d).withColumn("area", F.col("width") * F.col("height"))
    n = F.col("a_doc_id")
    found = _neighbours(r, "doc_id", "doc_id", "id", "area", "detail_score")
    return found.withColumns({"ssim": (70 + n % 31) / 100, "correlation": (60 + n % 41) / 100, "relation": F.when(n % 5 == 0, "unknown").otherwise("resize")})


@query
def upscale_decisions(spark, d):
    m = _measured(spark, d).where(compare.upscale_gate(F.col("relation"), F.col("a_area"), F.col("b_area")))
    first = F.col("a_area") >= F.col("b_area")
    pick = lambda c, x: F.when(x, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}"))
    return m.select(pick("id", first).alias("large"), pick("id", ~first).alias("small"), compare.is_upscale(F.col("ssim"), pick("detail_score", first), pick("detail_score", ~first)).alias("upscale"))


@query
def crop_decisions(spark, d):
    return _measured(spark, d).select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), compare.is_crop(F.col("correlation"), F.col("ssim")).alias("crop"))


@query
def comparisons_with_placeholders(spark, d):
    found = _edges(spark, d).select("a", "b", "relationship", "confidence")
    extra = hamming.crop_pairs_beyond(adapters.hashed(spark, d), CROP_DISTANCE, PAIR_DISTANCE, TOLERANCE)
    return rounded(compare.with_placeholders(found, extra), "confidence")


@query
def all_groups(spark, d):
    exact = duplicates.exact_groups(adapters.images(spark, d)).select("group_id", F.lit("exact-duplicate").alias("kind"), F.col("members").cast("int").alias("members"))
    return exact.unionByName(_visual(spark, d).select("group_id", "kind", F.size("members").alias("members")))


@query
def exact_group_reasons(spark, d):
    return duplicates.exact_groups(adapters.images(spark, d), PREFERENCES).select("group_id", "reason", "warning")


@query
def recommendation_explanations(spark, d):
    """The last reason is the score, which is a query of its own."""
    g, _, signals = _scored(spark, d)
    scored = tables.cut(scoring.scores(signals), "scores")
    told = scoring.explain(scored, scoring.recommend(g, scored, REVIEW))
    return told.select("group_id", F.array_join(F.slice("reasons", 1, F.size("reasons") - 1), "|").alias("reasons"), F.array_join("warnings", "|").alias("warnings"))


@query
def glob_filter(spark, d):
    path = F.col("relative_path")
    return adapters.images(spark, d).where(matches_any(path, ["src1/**", "*/en/*"]) & ~matches_any(path, ["**/1*.jpg"])).select("id", "relative_path")


@query
def canonical_names(spark, d):
    """Every naming strategy, with a capture date that parses, one that does not, and none."""
    k = F.col("doc_id")
    r = adapters.images(spark, d).select(
        "id", "relative_path", "sha256", "format", F.when(k % 4 == 0, F.array()).otherwise(F.array(F.concat(F.lit("g:"), (k % 10).cast("string")))).cast("array<string>").alias("group_ids"),
        F.when(k % 3 == 0, "2025-03-04T05:06:07").when(k % 3 == 1, "2025:03:04 05:06:07").alias("capture_date"), F.when(k % 5 != 0, "2024-11-30T10:00:00.000Z").alias("modified_at"),
    )
    named = [consolidate.with_base_path(r, n, "{year}/{groupId}/{slug}-{shortHash}-{other}.{ext}").select("id", F.lit(n).alias("naming"), "base_path") for n in NAMINGS]
    return functools.reduce(lambda a, b: a.unionByName(b), named)


@query
def manifest_without_failed(spark, d):
    records, wanted = _wanted(spark, d)
    chosen = records.select(F.col("id").alias("image_id"), F.lit("standalone").alias("method"), F.lit(1.0).alias("confidence"), F.col("group_ids").alias("selected_from"))
    plan = tables.cut(consolidate.plan_paths(wanted), "plan")
    failed = plan.join(records.where("width % 2 = 0").select(F.col("id").alias("image_id")), "image_id", "left_semi").select(F.col("canonical_path").alias("destination"))
    return consolidate.manifest(plan, chosen, records, failed).select("canonical_path", "sha256")


@query
def hash_lookup(spark, d):
    """Hashes found by content where there are any, the stored ones elsewhere."""
    r = adapters.images(spark, d).select("id", "sha256", F.when(F.col("doc_id") % 3 == 0, "old").alias("d_hash"))
    found = r.groupBy("sha256").agg(F.min("id").alias("d_hash")).where("d_hash < 'img_8'")
    return tables.filled(r, found, "sha256", "d_hash").select("id", "d_hash")


@query
def sticky_upscale_flags(spark, d):
    r = adapters.images(spark, d).select("id", "doc_id", "is_upscale")
    return tables.raised(r, r.where("doc_id % 4 = 1").select("id"), "is_upscale").select("id", "is_upscale")


def _workspace(spark):
    return tables.Workspace(spark, f"{tables.shared_dir(spark)}/provena-workspace-{uuid.uuid4().hex}")


@query
def workspace_images(spark, d):
    """Stored in three steps, listed by path."""
    ws, r = _workspace(spark), adapters.images(spark, d).select("doc_id", "id", "relative_path", F.col("relative_path").alias("real_path"), "size_bytes")
    ws.replace("images", r.where("doc_id % 3 = 0"))
    ws.append("images", r.where("doc_id % 3 = 1"))
    ws.append("images", r.where("doc_id % 3 = 2"))
    return ws.read("images").orderBy("relative_path").select("id", "relative_path", "size_bytes")


@query
def workspace_record_by_path(spark, d):
    ws, r = _workspace(spark), adapters.images(spark, d).select("id", "relative_path", F.col("relative_path").alias("real_path"))
    ws.replace("images", r)
    return ws.record(r.agg(F.min("relative_path")).first()[0]).select("id", "relative_path")


@query
def workspace_groups_by_kind(spark, d):
    """Groups of one kind are replaced, those of the other stay."""
    ws, r = _workspace(spark), adapters.images(spark, d).select(F.col("id").alias("group_id"), "doc_id")
    ws.replace_kind("visual", r.where("doc_id % 3 = 0").select("group_id", F.lit("visual").alias("kind")))
    ws.replace_kind("exact-duplicate", r.where("doc_id % 3 = 1").select("group_id", F.lit("exact-duplicate").alias("kind")))
    ws.replace_kind("visual", r.where("doc_id % 3 = 2").select("group_id", F.lit("visual").alias("kind")))
    return ws.read("groups").select("group_id", "kind")


@query
def operations_by_destination(spark, d):
    ops = adapters.operations(spark, d)
    return consolidate.operations_of(ops, destination=ops.agg(F.min("destination")).first()[0]).select("operation_id", "run_id", "destination", "timestamp")


@query
def operations_marked(spark, d):
    ops = adapters.operations(spark, d).withColumn("rolled_back_at", F.lit(None).cast("string"))
    gone = ops.where((F.col("run_id") == ops.agg(F.min("run_id")).first()[0]) & (F.col("status") == "verified")).select("operation_id", F.lit("now").alias("at"))
    return consolidate.marked_rolled_back(ops, gone).select("operation_id", "status", "rolled_back_at")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicate_groups(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return all_sql()


