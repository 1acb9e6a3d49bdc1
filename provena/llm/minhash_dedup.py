"""MinHash near-duplicate detection with exact confirmation.

* Signatures: ``bands * rows`` minima of universal (multiply-add) hashes over a
  document's distinct ``k``-word shingles.
* Documents with equal shingle sets are one class (one aggregation); only class
  representatives take part in banding, each under the number of its row, so
  that rows with one key and different texts are told apart.
* In every bucket of a band members are paired with the bucket's smallest
  member, so pairs grow with the members, not with their square; pairs that
  agree in enough minima are confirmed on the full sets of shingle hashes.
* Members that a bucket's smallest member does not link are not given up: the
  buckets that still hold several components are dealt in chunks, chunks meet
  in tasks, and inside a task signatures are compared; pairs of different
  components that agree in enough minima are confirmed as well, each document's
  likeliest partners first, so that most components have met before the last
  round, which tries every pair that is left.
* Components of confirmed links by alternating large-star and small-star.

At a similarity of 0.85 a pair misses all of 24 bands of 4 rows with
probability 2e-8, agrees in fewer than ``min_agree`` of 96 minima with
probability under 1e-8, and falls short in the last round's sketches, which have
1024 minima, with probability 2e-8.

Edge cases: null and empty texts (or texts without words) have an empty set and
link with nothing; fewer than ``k`` words make one shingle; rows repeated under
one key link by their own texts, and a component is named by the smallest key
in it, so such rows stay or go one by one; rows with a null key are components
of their own; further columns are ignored; an empty table gives an empty result.
Keys are of any type that has an order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import bucketed, gathered, likely, map_arrow, materialise, row_mark
from .words import U, chunks, doc_words, mix, segment_hash, window_hash

SHINGLE = 3
NUMERATOR, DENOMINATOR = 85, 100
BANDS, ROWS = 24, 4
#: Least number of equal minima for a pair that its bucket's smallest member did not settle.
MIN_AGREE = 60
CHUNK = 1024
#: Partners that a document outside its bucket's largest component tries in successive rounds; None: all that are left.
PARTNERS = (4, None)
FILTER_BITS = 20
#: Minima in the sketches that the last round compares before it confirms pairs.
SKETCH = 1024
SEED = 20_240_501


def _coefficients(n: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, n, dtype=U) * U(2) + U(1), rng.integers(0, 1 << 63, n, dtype=U)


def shingle_sets(texts: list[bytes], k: int, lower: bool = True) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of every text."""
    out: list[np.ndarray] = []
    for lo, hi in chunks(texts, 1 << 20):
        h, _, _, counts = doc_words(texts[lo:hi], lower)
        ends = np.cumsum(counts)
        w = window_hash(h, k)
        for e, n in zip(ends.tolist(), counts.tolist(), strict=True):
            if n >= k:
                out.append(np.unique(w[e - n : e - k + 1]))
            elif n:
                whole = segment_hash(h[e - n : e], np.array([0]), np.array([n]))
                out.append(mix(whole ^ U(0x51ED270B0A1F39C1 + n)))
            else:
                out.append(np.zeros(0, U))
    return out


def minima_of(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of every hash a * x + b (its upper half) over every set; 0 for empty sets."""
    out = np.zeros((len(sets), len(a)), np.uint32)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    full = np.flatnonzero(sizes)
    at = 0
    while at < len(full):  # as many sets at a time as fit a processor's cache
        to, held = at, 0
        while to < len(full) and (held == 0 or held + sizes[full[to]] <= 1 << 16):
            held += sizes[full[to]]
            to += 1
        own = full[at:to]
        values = np.concatenate([sets[i] for i in own])
        starts = np.concatenate(([0], np.cumsum(sizes[own])[:-1]))
        for j in range(len(a)):
            out[own, j] = np.minimum.reduceat((values * a[j] + b[j]) >> U(32), starts)
        at = to
    return out


def class_of(shingles: np.ndarray) -> bytes | None:
    """128 bits of a set and its size: equal sets, and for all that can happen only those, have equal classes."""
    if not len(shingles):
        return None
    one, two = mix(shingles * U(3) + U(1)), mix(shingles ^ U(0xA5A5A5A5A5A5A5A5))
    return one.sum().tobytes() + (two.sum() ^ np.bitwise_xor.reduce(one)).tobytes() + len(shingles).to_bytes(4, "little")


def _signatures(k: int, bands: int, rows: int, lower: bool):
    """(key, mark, n, class, signature, band hashes) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _coefficients(bands * rows)
        for batch in batches:
            sets = shingle_sets([t or b"" for t in batch.column(1).to_pylist()], k, lower)
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            minima = minima_of(sets, a, b)
            pairs = minima.astype(U).reshape(len(sets), bands, rows)
            band = np.zeros((len(sets), bands), U)
            for r in range(rows):
                band = mix(band * U(0x9E3779B97F4A7C15) + pairs[:, :, r] + U(r + 1))
            band = band ^ (np.arange(bands, dtype=U) * U(0xD1342543DE82EF95))
            cls = [class_of(s) for s in sets]
            flat = pa.array(band.view(np.int64).ravel())
            offsets = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes), pa.array(cls, pa.binary()), pa.array([m.tobytes() for m in minima.astype(np.uint8)], pa.binary()), pa.ListArray.from_arrays(offsets, flat)],
                ["doc", "mark", "n", "class", "signature", "bands"],
            )

    return run


def _sets(k: int, lower: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets([t or b"" for t in batch.column(1).to_pylist()], k, lower)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([class_of(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc", "class", "shingles"])

    return run


def _sketches(size: int):
    """Low bytes of ``size`` further minima of full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _coefficients(size, SEED + 1)
        for batch in batches:
            sets = [np.frombuffer(x.as_buffer(), U) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m.tobytes() for m in minima_of(sets, a, b).astype(np.uint8)], pa.binary())], ["id", "sketch"])

    return run


def _confirm(numerator: int, denominator: int):
    """Exact comparison of two full sets, which must be those of the classes asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {n: batch.column(n) for n in ("c_a", "c_b", "k_a", "k_b", "x", "y")}
            keep = []
            for i in range(batch.num_rows):
                if cols["c_a"][i] != cols["k_a"][i] or cols["c_b"][i] != cols["k_b"][i]:
                    continue  # another set whose name has the same 64 bits
                x, y = np.frombuffer(cols["x"][i].as_buffer(), U), np.frombuffer(cols["y"][i].as_buffer(), U)
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                both = 0
                if len(small) and denominator * len(small) >= numerator * len(large):
                    pos = np.minimum(np.searchsorted(large, small), len(large) - 1)
                    both = int((large[pos] == small).sum())
                union = len(x) + len(y) - both
                if union and denominator * both >= numerator * union:
                    keep.append(i)
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(take), batch.column("b").take(take)], ["a", "b"])

    return run


FULL = "a bigint, b bigint, at_a bigint, c_a binary, at_b bigint, c_b binary"


class Confirmer:
    """Confirms candidate pairs: by minima first, then on full sets, made only for documents of shared buckets.

    Which documents those are is broadcast as a bitmap of 2**FILTER_BITS
    buckets of their keys, a fixed size; where it saturates, sets of further
    documents are made and never used.  The sets stay in a table bucketed by
    ``at``, 64 bits of key and class; a row that occurs several times (``twins``)
    has its set there once.  ``reps`` are the representatives in shared buckets,
    in a table bucketed by ``id``.
    """

    def __init__(self, docs: DataFrame, reps: DataFrame, twins: bool, k: int, lower: bool, numerator: int, denominator: int, min_agree: int):
        spot = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << FILTER_BITS)).alias("spot")
        wanted = reps.select(spot("doc")).distinct()
        own = docs.where("doc is not null").withColumn("spot", spot("doc")).join(F.broadcast(wanted), "spot", "left_semi")
        kind = docs.schema["doc"].dataType.simpleString()
        made = map_arrow(own.select("doc", "text"), _sets(k, lower), f"doc {kind}, class binary, shingles binary").where("class is not null")
        made = made.select(F.xxhash64("doc", "class").alias("at"), "class", "shingles")
        self.name = bucketed(gathered(made.dropDuplicates(["at", "class"]) if twins else made, "at"), "at", "none")
        self.reps = reps
        self.limit, self.min_agree = (numerator, denominator), min_agree

    def _side(self, side: str, *columns: str) -> DataFrame:
        short = {"id": side, "n": f"n_{side}", "signature": f"s_{side}", "at": f"at_{side}", "class": f"c_{side}"}
        return self.reps.select(*[F.col(c).alias(short[c]) for c in ("id", *columns)])

    def __call__(self, pairs: DataFrame, tag: str) -> DataFrame:
        """Links (a, b) among the pairs (a, b)."""
        n, d = self.limit
        every = ("n", "signature", "at", "class")
        near = pairs.join(self._side("a", *every), "a").join(self._side("b", *every), "b").where(d * F.least("n_a", "n_b") >= n * F.greatest("n_a", "n_b"))
        near = materialise(map_arrow(near.select("a", "b", "at_a", "c_a", "at_b", "c_b", "s_a", "s_b"), _agree(self.min_agree), FULL), f"{tag}-pairs")
        return self.on_sets(near, tag)

    def on_sets(self, pairs: DataFrame, tag: str) -> DataFrame:
        """Links (a, b) among pairs as FULL has them, whose sizes and minima have been compared before."""
        sets = pairs.sparkSession.table(self.name)
        left = sets.select(F.col("at").alias("at_a"), F.col("class").alias("k_a"), F.col("shingles").alias("x"))
        right = sets.select(F.col("at").alias("at_b"), F.col("class").alias("k_b"), F.col("shingles").alias("y"))
        both = pairs.join(left, "at_a").join(right, "at_b").select("a", "b", "c_a", "c_b", "k_a", "k_b", "x", "y")
        return materialise(map_arrow(both, _confirm(*self.limit), "a bigint, b bigint"), f"{tag}-links")

    def sets_of(self, nodes: DataFrame) -> DataFrame:
        """(id, shingles) of nodes."""
        sets = nodes.sparkSession.table(self.name).withColumnRenamed("class", "k")
        return self.reps.join(nodes, "id", "left_semi").select("id", "at", "class").join(sets, "at").where(F.col("class").eqNullSafe(F.col("k"))).select("id", "shingles")


def _agree(min_agree: int):
    """Pairs whose signatures (the last two columns) have enough equal minima (compared by their low bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in (-2, -1))
            take = pa.array(np.flatnonzero((x == y).sum(axis=1) >= min_agree))
            yield pa.RecordBatch.from_arrays([c.take(take) for c in batch.columns[:-2]], batch.schema.names[:-2])

    return run


def _cross_pairs(minima: int, min_agree: int, numerator: int, denominator: int, most: int | None):
    """Pairs of different components in a bucket that agree in enough minima; chunk i meets chunk j.

    With ``most``, only so many likeliest partners of each document that is
    outside the chunks' largest component; without, all whose sketches agree in
    enough minima too.
    """
    least = numerator / denominator
    enough = SKETCH * (least - 5.5 * (least * (1 - least) / SKETCH) ** 0.5)

    def run(table: pa.Table) -> pa.Table:
        ids, comp, part, size = (table.column(c).to_numpy() for c in ("id", "component", "part", "n"))
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        sig = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(-1, minima)
        keys = np.asarray(table.column("bands").combine_chunks().flatten()).reshape(len(ids), -1)
        at, cls = table.column("at").combine_chunks(), table.column("class").combine_chunks()
        bucket = table.column("bucket")[0].as_py()
        sketch = None if most else np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
        names, n = np.unique(comp, return_counts=True)
        largest = names[n.argmax()]
        a, b = [], []
        for one, other in {(i, j), (j, i)}:
            right = np.flatnonzero(part == other)
            for u in np.flatnonzero((part == one) & (comp != largest)).tolist():
                near = right[(comp[right] != comp[u]) & (denominator * np.minimum(size[right], size[u]) >= numerator * np.maximum(size[right], size[u]))]
                agree = (sig[near] == sig[u]).sum(axis=1)
                hit, agree = near[agree >= min_agree], agree[agree >= min_agree]
                # A pair belongs to the first bucket that both are in, so that it is made once.
                first = (keys[hit] == keys[u]).argmax(axis=1) if len(hit) else np.zeros(0, int)
                own = keys[u][first] == bucket
                hit, agree = hit[own], agree[own]
                if sketch is not None:
                    hit = hit[(sketch[hit] == sketch[u]).sum(axis=1) >= enough]
                elif len(hit) > most:
                    hit = hit[np.lexsort((ids[hit], -agree))[:most]]
                a += np.where(ids[hit] < ids[u], hit, u).tolist()
                b += np.where(ids[hit] < ids[u], u, hit).tolist()
        once = pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"]).group_by(["a", "b"]).aggregate([])
        a, b = (once.column(c).combine_chunks() for c in ("a", "b"))  # places in the table
        columns = [pa.array(ids).take(a), pa.array(ids).take(b), at.take(a), cls.take(a), at.take(b), cls.take(b)]
        return pa.table(columns, ["a", "b", "at_a", "c_a", "at_b", "c_b"])

    return run


def merged(found: DataFrame, links: DataFrame, tag: str) -> DataFrame:
    """Components after further links: those of the graph whose nodes are the components so far."""
    side = lambda c: found.select(F.col("id").alias(c), F.col("component").alias(f"c_{c}"))
    joined = links.join(side("a"), "a", "left").join(side("b"), "b", "left").select("a", "b", F.coalesce("c_a", "a").alias("x"), F.coalesce("c_b", "b").alias("y"))
    joined = materialise(joined, f"{tag}-contracted")
    nodes = found.unionByName(joined.select(F.col("a").alias("id"), F.col("x").alias("component"))).unionByName(joined.select(F.col("b").alias("id"), F.col("y").alias("component"))).distinct()
    over = components(joined.select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("id").alias("component"), F.col("component").alias("over"))
    return materialise(nodes.join(over, "component", "left").select("id", F.coalesce("over", "component").alias("component")), f"{tag}-components")


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(id, component) of every node of the edges (a, b): alternating large-star and small-star.

    The labels are exact: rounds go on until every node with a smaller neighbour
    has no other one, when every edge leads to the smallest node of its component.
    """
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        # Large-star: every larger neighbour of a node goes to the smallest of its neighbours and itself.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        seen = Observation()
        near = both.groupBy("u").agg(F.min("v").alias("low"), F.count(F.lit(1)).alias("n"))
        near = near.observe(seen, F.count_if((F.col("low") < F.col("u")) & (F.col("n") > 1)).alias("open"))
        least = materialise(near.select("u", F.least("low", "u").alias("m")), "least")  # a table, so that hubs can be split below
        if not seen.get.get("open"):
            break
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialise(large, "large-star")
        # Small-star: a node and its smaller neighbours go to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = materialise(small.where("u <> v").distinct(), "small-star")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component"))  # settled: one edge a node


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    k: int = SHINGLE,
    numerator: int = NUMERATOR,
    denominator: int = DENOMINATOR,
    bands: int = BANDS,
    rows: int = ROWS,
    min_agree: int = MIN_AGREE,
    lower: bool = True,
    marks: bool = False,
) -> DataFrame:
    """``key, n_shingles, component_id, kept`` (and ``mark`` as row_mark() makes it) of every row; links need denominator * intersection >= numerator * union."""
    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(F.col(key).alias("doc"), F.col(text).cast("binary").alias("text"), (row_mark(key, text) if marks else F.lit(0).cast("long")).alias("mark"))
    made = map_arrow(source, _signatures(k, bands, rows, lower), f"doc {kind}, mark bigint, n bigint, class binary, signature binary, bands array<bigint>")
    signed = materialise(made.withColumn("row", F.monotonically_increasing_id()), "signatures")
    known = signed.where("doc is not null and class is not null")
    # A class is represented by its first row under its smallest key; that row's number is the class's node.
    classes = materialise(known.groupBy("class").agg(F.min("doc").alias("doc"), F.min_by("row", "doc").alias("id")), "classes")
    seen = Observation()
    twins = known.join(classes, ["class", "doc"]).observe(seen, F.count(F.lit(1)).alias("all"), F.count_if(F.col("row") == F.col("id")).alias("own"))
    reps = materialise(twins.where("row = id").select("id", "doc", "class", "n", "signature", "bands"), "representatives")
    banded = reps.select("id", F.explode("bands").alias("bucket"))
    buckets = materialise(banded.groupBy("bucket").agg(F.min("id").alias("pivot"), F.count(F.lit(1)).alias("m")).where("m > 1"), "buckets")
    members = materialise(likely(banded, buckets, "bucket").join(buckets, "bucket"), "members")  # most buckets have one member only
    # Further on only representatives in shared buckets, which stay where their ids are joined.
    reps = gathered(likely(reps, members, "id"), "id").join(members.select("id").distinct(), "id", "left_semi")
    reps = docs.sparkSession.table(bucketed(reps.select("id", "doc", "class", "n", "signature", "bands", F.xxhash64("doc", "class").alias("at")), "id"))
    confirm = Confirmer(source, reps, (seen.get.get("all") or 0) > (seen.get.get("own") or 0), k, lower, numerator, denominator, min_agree)

    # Every member with the first members of its buckets.
    tried = members.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    found = materialise(components(confirm(tried, "stars")), "components")
    # Then buckets that still hold several components, chunk against chunk: likeliest partners first, at last all.
    for most in PARTNERS:
        labelled = members.join(found, "id", "left").select("id", "bucket", F.coalesce("component", "id").alias("component"))
        several = labelled.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo <> hi and m > 2")
        several = materialise(several.select("bucket", F.ceil(F.col("m") / CHUNK).cast("int").alias("chunks")), "open-buckets")
        if several.isEmpty():
            break
        rest = materialise(labelled.join(several, "bucket"), "rest")
        rest = rest.join(reps.select("id", "n", "signature", "bands", "at", "class"), "id")
        kept = ["bucket", "id", "n", "component", "signature", "bands", "at", "class", "part"]
        if most is None:
            sets = confirm.sets_of(rest.select("id").distinct())
            rest = rest.join(materialise(map_arrow(sets, _sketches(SKETCH), "id bigint, sketch binary"), "sketches"), "id")
            kept.append("sketch")
        rest = rest.withColumn("part", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        meet = rest.select(*kept, F.least("part", "with").alias("i"), F.greatest("part", "with").alias("j"))
        extra = meet.groupBy("bucket", "i", "j").applyInArrow(_cross_pairs(bands * rows, min_agree, numerator, denominator, most), FULL)
        extra = materialise(extra.join(tried, ["a", "b"], "left_anti"), "extra")
        tried = tried.unionByName(extra.select("a", "b"))
        more = confirm.on_sets(extra, "rest")
        if not more.isEmpty():
            found = merged(found, more, "rest")
    # A component of nodes is named by the smallest key of its classes.
    node = classes.join(found, "id", "left").select("class", "doc", F.coalesce("component", "id").alias("component"))
    label = node.join(node.groupBy("component").agg(F.min("doc").alias("least")), "component").select("class", "least")
    return signed.select("doc", "n", "class", "mark").join(label, "class", "left").select(
        F.col("doc").alias(key),
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc").isNotNull(), F.coalesce("least", "doc")).alias("component_id"),
        F.coalesce(F.col("doc") == F.coalesce("least", "doc"), F.lit(True)).alias("kept"),
        *(["mark"] if marks else []),
    )
