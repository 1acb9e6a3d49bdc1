"""Similarity joins over 64-bit hashes within aspect-ratio buckets.

``hashed`` tables have: id, sha256, aspect_ratio, order_key (position of the
record) and the halves d_hi, d_lo, p_hi, p_lo.

Two hashes within distance T agree on at least one of T + 1 bands.  Up to
MAX_BANDED_DISTANCE bands are selective enough to join on (aspect bucket, band,
value); beyond it a band has two or three bits and would only repeat the same
pairs, so the join is on the aspect bucket with the distance as a residual.

Rows that share a join key are dealt into tiles of about TILE rows, and every
tile of one side meets every tile of the other under a key of its own: a bucket
that holds all rows is as many tasks as it needs, and nothing is broadcast but
what Spark itself finds small enough.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.functions.hashes import band, hamming_halves

from .tables import cut

MAX_BANDED_DISTANCE = 15
TILE = 4096


def bucket_of(ratio: Column, width: float) -> Column:
    return F.floor(ratio / F.lit(width)).cast("long")


def bucket_width(tolerance: float) -> float:
    return max(tolerance * 4, 0.001)


def _bands(df: DataFrame, threshold: int) -> DataFrame:
    n = threshold + 1
    cuts = [64 * i // n for i in range(n + 1)]
    keys = F.array([F.struct(F.lit(i).alias("no"), band(F.col("d_hi"), F.col("d_lo"), a, b - a).alias("value")) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))])
    return df.withColumn("_band", F.explode(keys)).select("*", F.col("_band.no").alias("_no"), F.col("_band.value").alias("_value")).drop("_band")


def _prefixed(df: DataFrame, p: str) -> DataFrame:
    return df.select([F.col(c).alias(p + c) for c in df.columns])


def tiled(q: DataFrame, m: DataFrame, keys: list[str], q_id: str = "id", m_id: str = "id", rows: int = TILE) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with tile numbers, and the keys to join on: as before, or with the tiles where a key has more than ``rows`` rows."""
    counted = lambda df, n: df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias(n))
    tiles = counted(q, "_nq").join(counted(m, "_nm"), keys).where("_nq > 1 or _nm > 1")
    tiles = cut(tiles, "tiles")
    if tiles.isEmpty():
        return q, m, keys
    own = lambda df, id_, n, mine, other, k: (
        df.join(tiles, keys, "left")
        .withColumn(mine, F.coalesce(F.pmod(F.xxhash64(id_), F.col(n)).cast("int"), F.lit(0)))
        .withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(k), F.lit(1)) - 1)))
        .drop("_nq", "_nm")
    )
    return own(q, q_id, "_nq", "_i", "_j", "_nm"), own(m, m_id, "_nm", "_j", "_i", "_nq"), [*keys, "_i", "_j"]


def hamming_join(queries: DataFrame, pool: DataFrame, threshold: int, tolerance: float | None, rows: int = TILE) -> DataFrame:
    """(query, match) rows with both records' columns prefixed ``q_`` and ``m_``, and both distances.

    With a tolerance, matches are searched in the query's aspect bucket and its
    two neighbours, which is lossless because a bucket is wider than the tolerance.
    """
    q, m = queries, pool
    if tolerance is not None:
        width = bucket_width(tolerance)
        b = bucket_of(F.col("aspect_ratio"), width)
        q = q.withColumn("_bucket", b)
        m = m.withColumn("_bucket", F.explode(F.array(b - 1, b, b + 1)))
    else:
        q, m = q.withColumn("_bucket", F.lit(0).cast("long")), m.withColumn("_bucket", F.lit(0).cast("long"))
    keys = ["_bucket"]
    if threshold <= MAX_BANDED_DISTANCE:
        q, m = _bands(q, threshold), _bands(m, threshold)
        keys += ["_no", "_value"]
    q, m, keys = tiled(q, m, keys, rows=rows)
    q, m = _prefixed(q, "q_"), _prefixed(m, "m_")
    d = hamming_halves(F.col("q_d_hi"), F.col("q_d_lo"), F.col("m_d_hi"), F.col("m_d_lo"))
    p = hamming_halves(F.col("q_p_hi"), F.col("q_p_lo"), F.col("m_p_hi"), F.col("m_p_lo"))
    on = F.col("q_id") != F.col("m_id")
    for k in keys:
        on = on & (F.col(f"q_{k}") == F.col(f"m_{k}"))
    on = on & (F.col("q_sha256") != F.col("m_sha256")) & (d <= threshold)
    out = q.join(m, on).withColumn("d_distance", d).withColumn("p_distance", p)
    if tolerance is not None:
        out = out.withColumn("aspect_delta", F.abs(F.col("q_aspect_ratio") - F.col("m_aspect_ratio"))).where(F.col("aspect_delta") <= tolerance)
    return out


def aspect_partners(records: DataFrame, tolerance: float) -> DataFrame:
    """(id, aspect_class, partners): how many other records are within the tolerance of each record's aspect ratio.

    Records of one ratio are one class; classes meet in their bucket and its
    neighbours, so that no pair of records is ever made.
    """
    classes = records.groupBy("aspect_ratio").agg(F.count(F.lit(1)).alias("n"))
    b = bucket_of(F.col("aspect_ratio"), bucket_width(tolerance))
    x = classes.select(F.col("aspect_ratio").alias("aspect_class"), b.alias("_bucket"))
    y = classes.select(F.col("aspect_ratio").alias("_other"), "n", F.explode(F.array(b - 1, b, b + 1)).alias("_bucket"))
    near = x.join(y, "_bucket").where(F.abs(F.col("aspect_class") - F.col("_other")) <= tolerance)
    total = near.groupBy("aspect_class").agg((F.sum("n") - 1).alias("partners"))
    return records.select("id", F.col("aspect_ratio").alias("aspect_class")).join(total, "aspect_class").select("id", "aspect_class", "partners")


def _pairs(found: DataFrame, *orders: Column) -> DataFrame:
    """One row a pair, smaller id first, with the distances of the first hit in the given order."""
    pick = F.struct("d_distance", "p_distance", "aspect_delta")
    return (
        found.groupBy(F.least("q_id", "m_id").alias("a"), F.greatest("q_id", "m_id").alias("b"))
        .agg(F.min_by(pick, F.struct(*orders)).alias("x"))
        .select("a", "b", F.col("x.d_distance").alias("d_distance"), F.col("x.p_distance").alias("p_distance"), F.col("x.aspect_delta").alias("aspect_delta"))
    )


def _shared_ids(hashed: DataFrame) -> DataFrame:
    """Ids of several records, as a table."""
    return cut(hashed.groupBy("id").count().where("count > 1").select("id"), "shared-ids")


def candidate_pairs(hashed: DataFrame, threshold: int = 10, tolerance: float = 0.015, variants: DataFrame | None = None) -> DataFrame:
    """Pairs whose both hashes and aspect ratios are close.

    ``variants`` (id, variant, d_hi, d_lo, p_hi, p_lo) adds each record's other
    orientations as queries.  Of several hits the first in processing order is
    kept: bucket (by its first record), record, then orientation.
    """
    own = hashed.where("d_hi is not null and p_hi is not null")
    width = bucket_width(tolerance)
    first = own.groupBy(bucket_of(F.col("aspect_ratio"), width).alias("bucket")).agg(F.min("order_key").alias("bucket_order"))
    queries = own.withColumn("variant", F.lit(0))
    if variants is not None:
        turned = variants.join(own.drop("d_hi", "d_lo", "p_hi", "p_lo"), "id").select(*queries.columns)
        queries = queries.unionByName(turned)
    queries = queries.withColumn("bucket", bucket_of(F.col("aspect_ratio"), width)).join(first, "bucket").drop("bucket")
    found = hamming_join(queries, own, threshold, tolerance).where(F.col("p_distance") <= threshold)
    if variants is None and threshold > MAX_BANDED_DISTANCE and _shared_ids(own).isEmpty():
        # Both directions say the same, and either comes once: nothing to group.
        return found.where("q_id < m_id").select(F.col("q_id").alias("a"), F.col("m_id").alias("b"), "d_distance", "p_distance", "aspect_delta")
    return _pairs(found, F.col("q_bucket_order"), F.col("q_order_key"), F.col("q_variant"), F.col("m_order_key"))


def _crop_hits(hashed: DataFrame, threshold: int, rows: int) -> DataFrame:
    """Every unordered pair once, with both records' columns; a tile meets itself and the tiles after it."""
    own = hashed.where("d_hi is not null").withColumn("_bucket", F.lit(0).cast("long"))
    q, m, keys = tiled(own, own, ["_bucket"], rows=rows)
    q, m = ((df.where("_i <= _j") if "_i" in df.columns else df) for df in (q, m))
    q, m = _prefixed(q, "q_"), _prefixed(m, "m_")
    d = hamming_halves(F.col("q_d_hi"), F.col("q_d_lo"), F.col("m_d_hi"), F.col("m_d_lo"))
    on = (F.col("q_sha256") != F.col("m_sha256")) & (d <= threshold)
    for k in keys:
        on = on & (F.col(f"q_{k}") == F.col(f"m_{k}"))
    # Two records of one tile meet twice, those of two tiles once.
    once = F.col("q_id") < F.col("m_id")
    on = on & ((once | ((F.col("q__i") < F.col("m__j")) & (F.col("q_id") != F.col("m_id")))) if "_i" in keys else once)
    return q.join(m, on).withColumn("d_distance", d)


def _crop_rows(found: DataFrame) -> DataFrame:
    return found.select(F.least("q_id", "m_id").alias("a"), F.greatest("q_id", "m_id").alias("b"), "d_distance")


def crop_pairs(hashed: DataFrame, threshold: int = 28, rows: int = TILE) -> DataFrame:
    """Pairs for crop detection: difference hashes alone, any aspect ratio; quadratic by its nature, so done tile by tile."""
    return _crop_rows(_crop_hits(hashed, threshold, rows))


def extra_crop_pairs(crops: DataFrame, compared: DataFrame) -> DataFrame:
    return crops.join(compared.select("a", "b"), ["a", "b"], "left_anti")


def crop_pairs_beyond(hashed: DataFrame, threshold: int, near: int, tolerance: float, rows: int = TILE) -> DataFrame:
    """``crop_pairs`` without the ``candidate_pairs(hashed, near, tolerance)``.

    Whether a pair is a candidate is seen from its own two records where the
    pair is made, so that the pairs, which grow with the square of the table,
    are never shuffled.  Only pairs of ids that several records share are
    looked up among the candidates, since another of those records may be near.
    """
    shared = _shared_ids(hashed)
    p = hamming_halves(F.col("q_p_hi"), F.col("q_p_lo"), F.col("m_p_hi"), F.col("m_p_lo"))
    candidate = (F.col("d_distance") <= near) & (p <= near) & (F.abs(F.col("q_aspect_ratio") - F.col("m_aspect_ratio")) <= tolerance)
    beyond = ~F.coalesce(candidate, F.lit(False))
    if shared.isEmpty():
        return _crop_rows(_crop_hits(hashed, threshold, rows).where(beyond))
    marked = hashed.join(shared.withColumn("_shared", F.lit(True)), "id", "left").withColumn("_shared", F.coalesce("_shared", F.lit(False)))
    found = _crop_hits(marked, threshold, rows).where(beyond)
    asked = F.col("q__shared") | F.col("m__shared")
    return _crop_rows(found.where(~asked)).unionByName(extra_crop_pairs(_crop_rows(found.where(asked)), candidate_pairs(hashed, near, tolerance)))


class BKTree:
    """Metric index for small in-memory sets: search by distance, equal items share a node."""

    def __init__(self, distance):
        self.distance, self.root = distance, None

    def insert(self, item) -> None:
        if self.root is None:
            self.root = ([item], {})
            return
        node = self.root
        while (d := self.distance(item, node[0][0])) and d in node[1]:
            node = node[1][d]
        if d:
            node[1][d] = ([item], {})
        else:
            node[0].append(item)

    def search(self, query, limit: int) -> list[tuple[object, int]]:
        found, open_nodes = [], [self.root] if self.root else []
        while open_nodes:
            items, children = open_nodes.pop()
            d = self.distance(query, items[0])
            if d <= limit:
                found += [(x, d) for x in items]
            open_nodes += [child for at, child in children.items() if d - limit <= at <= d + limit]
        return found
