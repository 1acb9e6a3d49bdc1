"""The audit: discovery to recommendations over real files, with state in a workspace.

Files are read by executors, so on a cluster the inputs must be on a mount that
all machines share.  Every stage that touches pixels ends in a table; a failing
file becomes a row of ``scan_errors`` and the audit goes on.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.functions.hashes import half
from provena.functions.paths import preference_score
from provena.operators import compare, duplicates, groups, hamming, scoring
from provena.operators.tables import Workspace, changed, cut, filled, raised, upsert
from provena.plans.config import Config
from provena.sources import discovery

RECORD = (
    "id string, real_path string, relative_path string, size_bytes bigint, modified_at string, created_at string, inode bigint, device bigint, sha256 string, format string, width int, height int, "
    "aspect_ratio double, orientation int, has_alpha boolean, bit_depth int, channels int, icc boolean, exif boolean, iptc boolean, xmp boolean, capture_date string, camera_make string, "
    "camera_model string, copyright string, creator string, d_hash string, p_hash string, is_upscale boolean, warnings array<string>"
)
ERROR = "phase string, file_path string, operation string, error string, continued boolean"
TEXTS = ("capture_date", "camera_make", "camera_model", "copyright", "creator")


def open_workspace(spark: SparkSession, path: str) -> Workspace:
    return Workspace(spark, path if "://" in path else "file://" + os.path.abspath(path))


def sha256_file(path: str) -> str:
    out = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(1 << 20):
            out.update(part)
    return out.hexdigest()


def read_file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _rows(df: DataFrame, schema: str, fn) -> DataFrame:
    """``fn`` (a dict of a row in, dicts out) over all rows, in small batches: rasters are large."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 16):
                out = [r for row in batch.slice(start, 16).to_pylist() for r in fn(row)]
                yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names}], schema=kinds).slice(0, 0) if not out else pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in out], schema=kinds)

    kinds = pa.schema([(n, _arrow(t)) for n, t in (c.split(" ", 1) for c in schema.split(", "))])
    return df.mapInArrow(run, schema)


def _arrow(kind: str) -> pa.DataType:
    flat = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.list_(flat[kind[6:-1]]) if kind.startswith("array<") else flat[kind]


def _inspect(row: dict) -> list[dict]:
    from provena.sources.metadata import parse_exif, read_header

    path = row["real_path"]
    try:
        data = read_file(path)
        head = read_header(data)
        if head["width"] * head["height"] > row["max_pixels"]:
            raise ValueError(f"{head['width']}x{head['height']} exceeds the limit of {row['max_pixels']} pixels")
        exif = parse_exif(head["exif"])
        out = {k: row[k] for k in ("real_path", "size_bytes", "modified_at", "created_at", "inode", "device")} | {k: exif.get(k) for k in (*TEXTS, "orientation")}
        out |= {k: head.get(k) for k in ("width", "height", "has_alpha", "bit_depth", "channels", "icc", "iptc", "xmp")}
        return [
            out
            | {
                "id": "img_" + hashlib.sha1(path.encode()).hexdigest()[:20], "relative_path": row["path"], "sha256": hashlib.sha256(data).hexdigest(), "format": row["format"],
                "aspect_ratio": head["width"] / head["height"], "exif": bool(head["exif"]), "is_upscale": False, "warnings": [row["reason"]] if row["reason"] else [],
            }
        ]
    except (OSError, ValueError) as e:
        return [{"real_path": path, "error": str(e)}]


def _hash(row: dict) -> list[dict]:
    from provena.sources import pixels

    try:
        r = pixels.decode(read_file(row["real_path"]), row["max_pixels"])
    except (OSError, ValueError) as e:
        return [{"sha256": row["sha256"], "real_path": row["real_path"], "error": str(e)}]
    return [{"sha256": row["sha256"], "real_path": row["real_path"], "variant": k, "d": pixels.difference_hash(r, t), "p": pixels.perceptual_hash(r, t)} for k, t in enumerate(("none", *pixels.TRANSFORMS))]


def _confirm(threshold: float, rotate: bool):
    def run(row: dict) -> list[dict]:
        from provena.sources import pixels

        a, b = (pixels.decode(read_file(row[f"path_{s}"])) for s in "ab")
        ssim, scale, transform = pixels.confirm(a, b, threshold, rotate, (row["orientation_a"], row["orientation_b"]))
        return [{"a": row["a"], "b": row["b"], "ssim": ssim, "scale": scale, "transform": transform, "means_a": pixels.channel_means(a), "means_b": pixels.channel_means(b), "alpha_a": pixels.meaningful_alpha(a), "alpha_b": pixels.meaningful_alpha(b)}]

    return run


def _crop(row: dict) -> list[dict]:
    """The better of both directions, from the frame with at least as many pixels."""
    from provena.sources import pixels

    sides = {s: pixels.decode(read_file(row[f"path_{s}"])) for s in "ab"}
    best = None
    for full, part in (("a", "b"), ("b", "a")):
        f, p = sides[full], sides[part]
        if f.width * f.height < p.width * p.height:
            continue
        found = pixels.find_crop(f, p, compare.CROP_CORRELATION)
        if found and found["ssim"] >= compare.CROP_SSIM:
            sure = max(0.0, min(1.0, found["correlation"], found["ssim"]))
            if best is None or sure > best["crop_confidence"]:
                best = {"a": row["a"], "b": row["b"], "larger": row[full], "cropped": row[part], "retained": found["retained_area"], "crop_confidence": sure} | {f"box_{k}": v for k, v in found["box"].items()}
    return [best] if best else []


def _upscale(row: dict) -> list[dict]:
    from provena.sources import pixels

    large, small = (pixels.decode(read_file(row[k])) for k in ("path_large", "path_small"))
    ssim, big, enlarged = pixels.upscale_features(large, small)
    return [{"id": row["large"], "ssim": ssim, "big": big, "enlarged": enlarged}]


def _detail(row: dict) -> list[dict]:
    from provena.sources import pixels

    r = pixels.decode(read_file(row["real_path"]))
    return [{"image_id": row["id"], "detail_score": pixels.detail_score(r, min(r.width, 512), min(r.height, 512))}]


def hashed_of(images: DataFrame) -> DataFrame:
    """Records in the shape of the similarity joins; the order of records is that of their paths."""
    h = lambda c, i: half(F.col(c), i)
    own = images.select("id", "sha256", "aspect_ratio", F.col("relative_path").alias("order_key"), h("d_hash", 0).alias("d_hi"), h("d_hash", 1).alias("d_lo"), h("p_hash", 0).alias("p_hi"), h("p_hash", 1).alias("p_lo"))
    return cut(own, "hashed")  # so that a join reads numbers, and parses no digits for every pair


def sides(pairs: DataFrame, images: DataFrame) -> DataFrame:
    """Pairs with the paths and measures of both records; pairs without a record are dropped."""
    side = lambda s: images.select(F.col("id").alias(s), F.col("real_path").alias(f"path_{s}"), F.col("orientation").alias(f"orientation_{s}"), F.col("width").alias(f"width_{s}"), F.col("height").alias(f"height_{s}"), F.col("format").alias(f"format_{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b")


def inventory(spark: SparkSession, config: Config, ws: Workspace, force: bool) -> tuple[DataFrame, DataFrame, dict]:
    """(entries, images, counters): inspects new and changed files only."""
    entries = cut(discovery.discover(spark, config.inputs, config.include, config.exclude, config.workspace, config.follow_symlinks), "entries")
    candidates = entries.where("status = 'candidate'")
    known = ws.read("images")
    todo = candidates if known is None or force else changed(known, candidates)
    rows = todo.select("path", "real_path", "format", "reason", "size_bytes", "modified_at", "created_at", "inode", "device", F.lit(config.limits.max_input_pixels).alias("max_pixels"))
    seen = cut(_rows(rows, RECORD + ", error string", _inspect), "inspected")
    good = seen.where("error is null").drop("error")
    images = ws.replace("images", upsert(known, good, "real_path"))
    record_errors(ws, seen.where("error is not null"), "inventory", "inspect image")
    total, fresh = candidates.count(), seen.count()
    return entries, images, {"candidates": total, "inspected": good.count(), "cached": total - fresh}


def record_errors(ws: Workspace, failed: DataFrame, phase: str, operation: str) -> None:
    rows = failed.select(F.lit(phase).alias("phase"), F.col("real_path").alias("file_path"), F.lit(operation).alias("operation"), F.col("error"), F.lit(True).alias("continued"))
    if not rows.isEmpty():
        ws.append("scan_errors", rows)


def hash_images(config: Config, ws: Workspace, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(images with hashes, orientation variants): every distinct content is decoded once, and never again by later audits."""
    one = images.groupBy("sha256").agg(F.min("real_path").alias("real_path")).withColumn("max_pixels", F.lit(config.limits.max_input_pixels))
    known = ws.read("variants")
    todo = one if known is None else one.join(known.select("sha256").distinct(), "sha256", "left_anti")
    fresh = cut(_rows(todo, "sha256 string, real_path string, variant int, d string, p string, error string", _hash), "hashes")
    record_errors(ws, fresh.where("error is not null"), "hashing", "compute perceptual hashes")
    made = ws.append("variants", fresh.where("error is null").select("sha256", "variant", "d", "p"))
    out = ws.replace("images", filled(images, made.where("variant = 0").select("sha256", F.col("d").alias("d_hash"), F.col("p").alias("p_hash")), "sha256", "d_hash", "p_hash"))
    h = lambda c, i: half(F.col(c), i)
    turned = made.where("variant > 0").join(out.select("id", "sha256"), "sha256").select("id", "variant", h("d", 0).alias("d_hi"), h("d", 1).alias("d_lo"), h("p", 0).alias("p_hi"), h("p", 1).alias("p_lo"))
    return out, turned


def confirm_pairs(config: Config, pairs: DataFrame, images: DataFrame) -> DataFrame:
    m = config.matching
    schema = "a string, b string, ssim double, scale int, transform string, means_a array<double>, means_b array<double>, alpha_a boolean, alpha_b boolean"
    joined = sides(pairs.select("a", "b"), images)
    measured = cut(_rows(joined.repartition("a", "b"), schema, _confirm(m.ssim_threshold, m.detect_rotation)), "confirmed").join(joined, ["a", "b"])
    features = measured.select(
        "a", "b", "ssim", "scale", "transform", compare.mean_colour_delta(F.col("means_a"), F.col("means_b")).alias("colour_delta"), (F.col("alpha_a") != F.col("alpha_b")).alias("alpha_mismatch"),
        ((F.col("width_a") == F.col("width_b")) & (F.col("height_a") == F.col("height_b"))).alias("same_size"), (F.col("format_a") == F.col("format_b")).alias("same_format"),
    )
    return compare.classify(features, m.ssim_threshold)


DETAILS = "larger string, cropped string, retained double, box_left double, box_top double, box_width double, box_height double"


def crops_and_upscales(config: Config, compared: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(comparisons with crops relabelled and extra crop pairs added, ids of probable upscales)."""
    base = compared.select("a", "b", "relationship", "confidence", F.col("ssim").alias("ssim_score"), F.col("transform").alias("transform_used"), "reasons", "warnings")
    if config.matching.detect_crops:
        extra = hamming.extra_crop_pairs(hamming.crop_pairs(hashed_of(images)), base).select("a", "b")
        none = F.array().cast("array<string>")
        base = cut(compare.with_placeholders(base, extra), "with-crop-pairs")
        asked = sides(base.where("relationship = 'unknown'").select("a", "b"), images).repartition("a", "b")
        found = cut(_rows(asked, "a string, b string, " + DETAILS + ", crop_confidence double", _crop), "crops")
        base = base.join(found, ["a", "b"], "left")
        is_crop = F.col("cropped").isNotNull()
        said = F.concat(F.lit("crop to "), F.format_string("%.0f", F.col("retained") * 100), F.lit("%"))
        base = (
            base.withColumn("relationship", F.when(is_crop, "crop").otherwise(F.col("relationship")))
            .withColumn("confidence", F.when(is_crop, F.col("crop_confidence")).otherwise(F.col("confidence")))
            .withColumn("reasons", F.when(is_crop, F.array(said)).otherwise(F.col("reasons")))
            .withColumn("warnings", F.when(is_crop, none).otherwise(F.col("warnings")))
            .drop("crop_confidence")
        )
    else:
        base = base.withColumns({c.split()[0]: F.lit(None).cast(c.split()[1]) for c in DETAILS.split(", ")})
    base = cut(base, "comparisons")
    empty = images.select("id").limit(0)
    if not config.quality.detect_upscaling:
        return base, empty
    j = sides(base.select("a", "b", "relationship"), images)
    area = lambda s: F.col(f"width_{s}") * F.col(f"height_{s}")
    first = area("a") >= area("b")
    pick = lambda x, big: F.when(first if big else ~first, F.col(x.replace("?", "a"))).otherwise(F.col(x.replace("?", "b")))
    asked = j.where(compare.upscale_gate(F.col("relationship"), area("a"), area("b"))).select(pick("?", True).alias("large"), pick("path_?", True).alias("path_large"), pick("path_?", False).alias("path_small"))
    measured = _rows(asked.repartition("large"), "id string, ssim double, big double, enlarged double", _upscale)
    return base, cut(measured.where(compare.is_upscale(F.col("ssim"), F.col("big"), F.col("enlarged"))).select("id").distinct(), "upscales")


def recommend_groups(config: Config, visual: DataFrame, compared: DataFrame, images: DataFrame) -> DataFrame:
    """Visual groups with scores, confidence, status and explanations."""
    members = visual.select("group_id", F.posexplode("members").alias("position", "image_id"))
    records = images.withColumnRenamed("id", "image_id")
    inside = members.join(compared.where("relationship = 'crop'").select(F.col("cropped").alias("image_id"), "larger", "retained"), "image_id")
    inside = inside.join(members.select("group_id", F.col("image_id").alias("larger")), ["group_id", "larger"])
    crops = inside.groupBy("group_id", "image_id").agg(F.min_by("retained", "larger").alias("retained"))
    detail = cut(_rows(images.join(members.select(F.col("image_id").alias("id")).distinct(), "id", "left_semi").select("id", "real_path"), "image_id string, detail_score double", _detail), "detail")
    count = lambda *cs: sum((F.col(c).cast("int") for c in cs), F.lit(0))
    signals = members.join(records, "image_id").join(detail, "image_id").join(crops, ["group_id", "image_id"], "left").select(
        "group_id", F.col("position").cast("bigint").alias("position"), "image_id", "detail_score", (F.col("width").cast("bigint") * F.col("height")).alias("pixel_count"), F.coalesce("bit_depth", F.lit(8)).alias("bit_depth"), "has_alpha", "icc",
        count("exif", "iptc", "xmp").alias("metadata_count"), preference_score(F.col("relative_path"), config.path_preferences).alias("path_score"), F.col("retained").isNotNull().alias("is_crop"), "retained", F.coalesce("is_upscale", F.lit(False)).alias("is_upscale"),
    )
    scored = cut(scoring.scores(signals.join(images.select(F.col("id").alias("image_id"), F.col("relative_path").alias("path")), "image_id"), config.scoring), "scores")
    decided = cut(scoring.recommend(visual, scored, config.review), "decided")
    told = scoring.explain(scored, decided, "path")
    out = visual.drop("confidence", "status").join(decided, "group_id").join(told.withColumnRenamed("reasons", "_r").withColumnRenamed("warnings", "_w"), "group_id", "left")
    names = images.select(F.col("id").alias("candidate_id"), F.col("relative_path").alias("_path"))
    out = out.join(names, "candidate_id", "left").join(scored.select("group_id", F.col("image_id").alias("candidate_id"), F.col("total").alias("_total")), ["group_id", "candidate_id"], "left")
    none = F.array().cast("array<string>")
    maybe = F.concat(F.lit("best member: "), F.col("_path"), F.lit(", score "), F.format_string("%.0f", "_total"), F.lit(" of 100"))
    lost = F.concat(F.lit("left out, no direct match with the first member: "), F.array_join("excluded", ", "))
    nobody = F.lit("every member is ruled out")
    reasons = F.when(F.col("status") == "automatic", F.coalesce("_r", none)).when((F.col("status") == "manual-review") & F.col("candidate_id").isNotNull(), F.array(maybe)).otherwise(none)
    warnings = F.array_compact(F.array(F.when(F.size("excluded") > 0, lost)))
    warnings = F.concat(warnings, F.when(F.col("status") == "ambiguous", none).when(F.col("candidate_id").isNull(), F.array(nobody)).otherwise(F.coalesce("_w", none)))
    return out.select("group_id", F.lit("visual").alias("kind"), "members", "recommended_id", "score", "confidence", "status", reasons.alias("reasons"), warnings.alias("warnings"))


def exact_as_groups(images: DataFrame, config: Config) -> DataFrame:
    g = duplicates.exact_groups(images, config.path_preferences)
    m = duplicates.exact_members(images).groupBy("group_id").agg(F.sort_array(F.collect_list(F.struct(F.collate("relative_path", "UNICODE").alias("p"), F.col("image_id").alias("i")))).alias("_m"))
    links = duplicates.hard_links(images).groupBy("group_id").agg(F.array_sort(F.collect_list(F.concat(F.col("members").cast("string"), F.lit(" members are one inode")))).alias("_links"))
    none = F.array().cast("array<string>")
    return g.join(m, "group_id").join(links, "group_id", "left").select(
        "group_id", F.lit("exact-duplicate").alias("kind"), F.transform("_m", lambda x: x["i"]).alias("members"), "recommended_id", F.lit(None).cast("double").alias("score"), "confidence", "status",
        F.array_compact(F.array("reason", "preference_reason")).alias("reasons"), F.concat(F.array_compact(F.array("warning")), F.coalesce("_links", none)).alias("warnings"),
    )


def run_audit(spark: SparkSession, config: Config, force: bool = False) -> dict:
    """Runs all enabled stages, stores their tables, and returns counters.

    Groups of a kind whose stage is switched off stay as the previous audit left
    them; groups are rebuilt, so earlier reviews do not survive an audit.
    """
    ws = open_workspace(spark, config.workspace)
    entries, images, counters = inventory(spark, config, ws, force)
    for r in entries.groupBy("status").count().collect():
        counters[f"discovered_{r['status'].replace('-', '_')}"] = r["count"]
    if config.matching.exact_hash:
        ws.replace_kind("exact-duplicate", exact_as_groups(images, config))
        counters["wasted_bytes"] = duplicates.wasted_total(images).first()["wasted_bytes"]
    if config.matching.perceptual_hash:
        images, turned = hash_images(config, ws, images)
        decodable = images.where("d_hash is not null")
        pairs = hamming.candidate_pairs(hashed_of(decodable), config.matching.distance_threshold, config.matching.aspect_tolerance, turned if config.matching.detect_rotation else None)
        pairs = ws.replace("candidate_pairs", pairs)
        compared, upscales = crops_and_upscales(config, confirm_pairs(config, pairs, images), decodable)
        ws.replace("comparisons", compared)
        images = ws.replace("images", raised(images, upscales, "is_upscale"))
        visual = cut(groups.visual_groups(compared, config.review.manual_threshold), "visual")
        ws.replace_kind("visual", recommend_groups(config, visual, compared, images))
        counters |= {"candidate_pairs": pairs.count(), "confirmed": compared.where("relationship not in ('unknown', 'crop')").count(), "crops": compared.where("relationship = 'crop'").count(), "upscales": images.where("is_upscale").count()}
    stored = ws.read("groups")
    if stored is not None:
        for r in stored.groupBy("kind", "status").count().collect():
            counters[f"{r['kind']}_{r['status']}".replace("-", "_")] = r["count"]
    errors = ws.read("scan_errors")
    counters["errors"] = 0 if errors is None else errors.count()
    return counters
