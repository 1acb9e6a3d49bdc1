"""Entity tables derived from the driver's tables, all by built-in expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.functions.hashes import difference_halves, lower_middle, perceptual_halves
from provena.operators.tables import cut

FORMATS = {"en": "jpeg", "de": "png", "fr": "webp"}  # others: gif


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image records from documents, with flags from labels."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    c = F.col
    path = F.concat_ws("/", "source", "lang", F.concat(c("doc_id").cast("string"), F.lit(".jpg")))
    fmt = F.when(c("lang") == "en", "jpeg").when(c("lang") == "de", "png").when(c("lang") == "fr", "webp").otherwise("gif")
    slim = d.select(
        "doc_id",
        path.alias("relative_path"),
        F.sha2("text", 256).alias("sha256"),
        c("n_chars").alias("size_bytes"),
        fmt.alias("format"),
        (64 + c("n_chars") % 1024).alias("width"),
        (64 + (c("n_chars") * 7) % 768).alias("height"),
    )
    return slim.join(labels, "doc_id", "left").select(
        "doc_id",
        F.concat(F.lit("img_"), F.substring(F.sha1("relative_path"), 1, 20)).alias("id"),
        "relative_path",
        "sha256",
        "size_bytes",
        "format",
        "width",
        "height",
        F.lit(1).cast("long").alias("device"),
        (c("size_bytes") * 2 + c("doc_id") % 2).alias("inode"),
        (c("doc_id") % 5 == 0).alias("has_alpha"),
        (c("doc_id") % 3 == 0).alias("icc"),
        ((c("doc_id") % 2 == 0).cast("int") + (c("doc_id") % 7 == 0).cast("int") + (c("doc_id") % 11 == 0).cast("int")).alias("metadata_count"),
        F.when(c("doc_id") % 4 == 0, 16).otherwise(8).alias("bit_depth"),
        (F.coalesce(c("toxic"), F.lit(0)) == 1).alias("is_upscale"),
        (c("size_bytes") % 101 + F.coalesce(c("quality"), F.lit(0)) * 10).cast("double").alias("detail_score"),
    )


def _halves(df: DataFrame, block: str) -> DataFrame:
    """The halves of both hashes of an 8x8 block; the median is found once a row."""
    own = df.withColumn("_middle", lower_middle(F.col(block)))
    d, p = difference_halves(F.col(block)), perceptual_halves(F.col(block), F.col("_middle"))
    return own.select("*", d[0].alias("d_hi"), d[1].alias("d_lo"), p[0].alias("p_hi"), p[1].alias("p_lo")).drop("_middle")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records from embeddings, without their hashes."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    return e.select(
        "vec_id",
        "label",
        "embedding",
        F.concat(F.lit("img_"), F.substring(F.sha1(F.col("vec_id").cast("string")), 1, 20)).alias("id"),
        F.sha2(F.col("vec_id").cast("string"), 256).alias("sha256"),
        (1.0 + F.col("label") * 0.01).alias("aspect_ratio"),
        F.col("vec_id").alias("order_key"),
    )


HASHED = ("id", "sha256", "aspect_ratio", "order_key", "d_hi", "d_lo", "p_hi", "p_lo")


def hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashed records as a table: the vector is an 8x8 low-frequency block.  Joins read the stored hashes, and never make them again."""
    return cut(_halves(records(spark, sf_dir), "embedding").select(*HASHED), "hashed")


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of the three other orientations as a table: the block turned, mirrored and flipped."""
    e = records(spark, sf_dir).select("id", "embedding")
    turned = {1: [63 - i for i in range(64)], 2: [i // 8 * 8 + 7 - i % 8 for i in range(64)], 3: [(7 - i // 8) * 8 + i % 8 for i in range(64)]}
    grids = [F.struct(F.lit(k).alias("variant"), F.array(*[F.element_at("embedding", i + 1) for i in order]).alias("grid")) for k, order in turned.items()]
    rows = e.select("id", F.explode(F.array(*grids)).alias("v")).select("id", "v.variant", "v.grid")
    return cut(_halves(rows, "grid").select("id", "variant", "d_hi", "d_lo", "p_hi", "p_lo"), "variants")


def near_copies(hashed: DataFrame) -> DataFrame:
    """A copy of every hashed record with zero to eleven of the lowest bits of the difference hash turned, and up to three of the other."""
    n = F.col("order_key") % 12
    return hashed.select(
        F.concat(F.lit("near_"), "id").alias("id"), F.sha2("id", 256).alias("sha256"), "aspect_ratio", (F.col("order_key") + (1 << 40)).alias("order_key"), "d_hi",
        F.col("d_lo").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int")) - 1).alias("d_lo"), F.col("p_hi"), F.col("p_lo").bitwiseXOR(n % 4).alias("p_lo"),
    )


def pair_features(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """Measured features of pairs: similarity from the cosine, the rest from the records."""
    side = lambda p: records.select(F.col("id").alias(p), F.col("vec_id").alias(f"{p}_vec"), F.col("embedding").alias(f"{p}_e"), F.col("label").alias(f"{p}_label"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    a, b = F.col("a_e"), F.col("b_e")
    cosine = dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
    n, m = F.col("a_vec"), F.col("b_vec")
    return pairs.join(side("a"), "a").join(side("b"), "b").select(
        "a",
        "b",
        F.least(F.lit(1.0), F.round(0.85 + 0.3 * cosine, 6)).alias("ssim"),
        F.when((n + m) % 7 == 0, "rotate180").when((n + m) % 7 == 1, "flipHorizontal").otherwise("none").alias("transform"),
        F.abs(n - m).cast("double").alias("_gap"),
        (F.abs(n - m) % 20).cast("double").alias("colour_delta"),
        ((n % 3 == 0) != (m % 3 == 0)).alias("alpha_mismatch"),
        (F.col("a_label") == F.col("b_label")).alias("same_size"),
        (n % 2 == m % 2).alias("same_format"),
    ).drop("_gap")


def signals(members: DataFrame, records: DataFrame) -> DataFrame:
    """Scoring signals of group members (group_id, image_id) over hashed records."""
    v = F.col("vec_id")
    r = records.select(
        F.col("id").alias("image_id"),
        F.col("vec_id").alias("position"),
        (v % 101).cast("double").alias("detail_score"),
        ((64 + v % 1024) * (64 + (v * 7) % 768)).alias("pixel_count"),
        F.when(v % 4 == 0, 16).otherwise(8).alias("bit_depth"),
        (v % 3 == 0).alias("has_alpha"),
        (v % 4 == 1).alias("icc"),
        (v % 4).cast("int").alias("metadata_count"),
        F.when(v % 5 == 0, 10.0).when(v % 5 == 1, -10.0).otherwise(0.0).alias("path_score"),
        (v % 9 == 0).alias("is_crop"),
        F.when(v % 9 == 0, 0.5 + (v % 5) * 0.1).alias("retained"),
        (v % 13 == 0).alias("is_upscale"),
    )
    return members.select("group_id", "image_id").join(r, "image_id")


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journal entries from events."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type")
    status = F.when(F.col("event_id") % 5 == 0, "failed").when(F.col("event_id") % 5 == 1, "skipped-identical").when(F.col("event_id") % 5 == 2, "rolled-back").otherwise("verified")
    run, dest = F.date_format("ts", "yyyy-MM-dd"), F.concat(F.lit("originals/"), F.col("user_id").cast("string"))
    return e.select(
        F.concat(F.lit("op_"), F.substring(F.sha1(F.concat_ws(":", F.col("event_id").cast("string"), run, dest)), 1, 20)).alias("operation_id"),
        run.alias("run_id"),
        dest.alias("destination"),
        status.alias("status"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"),
    )


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and sources of pages, with their place."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    found = F.regexp_extract_all("html", F.lit(r'(href|src|srcset)="([^"]+)"'), F.lit(2))
    return p.select("page_id", F.posexplode(found).alias("position", "target"))
