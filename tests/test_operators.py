"""Single operators on records made in code."""

import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from provena.functions import hashes, paths
from provena.operators import compare, consolidate, duplicates, groups, hamming, review, scoring, tables
from provena.plans import config
from provena.sources import discovery


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# --- Hashes and similarity joins ---------------------------------------------------


def test_hamming_distance(spark):
    pairs = [("0" * 16, "0" * 16, 0), ("f" * 16, "0" * 16, 64), ("8000000000000001", "0" * 16, 2), ("00000000ffffffff", "ffffffff00000000", 64)]
    df = spark.createDataFrame(pairs, "a string, b string, n int")
    assert all(r["d"] == r["n"] for r in df.select("n", hashes.hamming_hex(F.col("a"), F.col("b")).alias("d")).collect())
    with pytest.raises(Exception, match="lengths differ"):
        spark.createDataFrame([("00", "0")], "a string, b string").select(hashes.hamming_hex(F.col("a"), F.col("b"))).collect()


def test_bits_to_hex(spark):
    df = spark.createDataFrame([([1] + [0] * 62 + [1],)], "bits array<int>")
    assert df.select(hashes.bits_to_hex(F.col("bits")).alias("h")).first()["h"] == "8000000000000001"


def hashed(spark, rows):
    """rows: (id, d, p, ratio, sha)"""
    out = [(i, s, r, n, d >> 32, d & 0xFFFFFFFF, p >> 32, p & 0xFFFFFFFF) for n, (i, d, p, r, s) in enumerate(rows)]
    return spark.createDataFrame(out, "id string, sha256 string, aspect_ratio double, order_key bigint, d_hi bigint, d_lo bigint, p_hi bigint, p_lo bigint")


@pytest.mark.parametrize("threshold", [4, 10, 20])
def test_hamming_join_is_the_cross_join(spark, threshold):
    rng = random.Random(threshold)
    centres = [rng.getrandbits(64) for _ in range(8)]
    flip = lambda h: h ^ sum({1 << rng.randrange(64) for _ in range(rng.choice((0, 1, 2, 5, 12)))})
    rows = [(f"i{n:03d}", flip(c := rng.choice(centres)), flip(c), rng.choice((1.0, 1.01, 1.05, 1.5)), f"s{n % 110}") for n in range(120)]
    got = {(r["a"], r["b"]): (r["d_distance"], r["p_distance"]) for r in hamming.candidate_pairs(hashed(spark, rows), threshold).collect()}
    want = {}
    for x, y in itertools.combinations(rows, 2):
        d, p = (x[1] ^ y[1]).bit_count(), (x[2] ^ y[2]).bit_count()
        if d <= threshold and p <= threshold and abs(x[3] - y[3]) <= 0.015 and x[4] != y[4]:
            want[x[0], y[0]] = (d, p)
    assert got == want and want
    tree = hamming.BKTree(lambda a, b: (a[1] ^ b[1]).bit_count())
    for r in rows:
        tree.insert(r)
    for r in rows[:20]:
        assert {m[0] for m, _ in tree.search(r, threshold)} == {x[0] for x in rows if (x[1] ^ r[1]).bit_count() <= threshold}


def test_aspect_partners_of_the_whole_table(spark):
    rng = random.Random(9)
    rows = [(f"i{i:03}", rng.choice([0.66, 0.75, 1.0, 1.33, 1.5]) + rng.choice((0.0, 0.01, 0.02, -0.07))) for i in range(90)]
    got = {r["id"]: r["partners"] for r in hamming.aspect_partners(spark.createDataFrame(rows, "id string, aspect_ratio double"), 0.015).collect()}
    assert got == {a: sum(a != b and abs(x - y) <= 0.015 for b, y in rows) for a, x in rows} and max(got.values()) > 5


@pytest.mark.parametrize("threshold", [10, 24])
def test_tiles_change_nothing(spark, threshold):
    rng = random.Random(4)
    rows = [(f"i{i}", rng.getrandbits(64) if i % 2 else 2**63 + rng.getrandbits(5), i % 3, rng.choice((1.0, 1.01, 1.5)), f"s{i}") for i in range(120)]
    own = hashed(spark, rows)
    found = [sorted((r["q_id"], r["m_id"], r["d_distance"]) for r in hamming.hamming_join(own, own, threshold, tolerance, rows=n).collect()) for n in (4096, 7) for tolerance in (0.015, None)]
    assert found[0] == found[2] and found[1] == found[3] and len(found[0]) > 100


def test_orientation_variants_find_turned_copies(spark):
    rows = [("a", 0, 0, 1.0, "s1"), ("b", 2**64 - 1, 2**64 - 1, 1.0, "s2")]
    turned = spark.createDataFrame([("b", 1, 0, 1, 0, 3)], "id string, variant int, d_hi bigint, d_lo bigint, p_hi bigint, p_lo bigint")
    assert hamming.candidate_pairs(hashed(spark, rows)).count() == 0
    got = hamming.candidate_pairs(hashed(spark, rows), variants=turned).collect()
    assert [(r["a"], r["b"], r["d_distance"], r["p_distance"]) for r in got] == [("a", "b", 1, 2)]


def test_crop_pairs_ignore_ratio_and_skip_compared(spark):
    rows = [("a", 0, 0, 1.0, "s1"), ("b", 7, 0, 9.0, "s2"), ("c", 2**64 - 1, 0, 1.0, "s3"), ("d", 0, 0, 1.0, "s1")]
    crops = hamming.crop_pairs(hashed(spark, rows))
    assert {(r["a"], r["b"]) for r in crops.collect()} == {("a", "b"), ("b", "d")}
    done = spark.createDataFrame([("a", "b")], "a string, b string")
    assert {(r["a"], r["b"]) for r in hamming.extra_crop_pairs(crops, done).collect()} == {("b", "d")}


def test_crop_pairs_beyond_the_candidates_are_not_shuffled(spark):
    """As the anti-join has it, in one tile and in many, without a join on the pairs; ids that two records share are looked up."""
    rng = random.Random(5)
    rows = [(f"r{i:03d}", rng.getrandbits(16), rng.getrandbits(16), 1.0 + i % 4 * 0.01, f"s{i // 2}") for i in range(120)]
    rows += [("odd", 5, 0, float("nan"), "t1"), ("far", 5, 0, 9.0, "t2")]
    for table in (rows, [*rows, ("r003", 2**64 - 1, 0, 7.0, "u"), ("r007", rows[9][1], rows[9][2], 1.01, "v")]):
        own = hashed(spark, table)
        crops = hamming.crop_pairs(own, 9)
        want = sorted(map(tuple, hamming.extra_crop_pairs(crops, hamming.candidate_pairs(own, 7, 0.015)).collect()))
        assert 100 < len(want) < crops.count()
        for tile in (hamming.TILE, 10):
            assert sorted(map(tuple, hamming.crop_pairs(own, 9, tile).collect())) == sorted(map(tuple, crops.collect()))
            got = hamming.crop_pairs_beyond(own, 9, 7, 0.015, tile)
            assert sorted(map(tuple, got.collect())) == want
            if table is rows:
                assert "LeftAnti" not in got._jdf.queryExecution().executedPlan().toString()


# --- Exact duplicates --------------------------------------------------------------------


def images(spark, rows):
    return spark.createDataFrame([(i, p, s, 1000, 1, n) for i, p, s, n in rows], "id string, relative_path string, sha256 string, size_bytes bigint, device bigint, inode bigint")


A = "a" * 64


def test_exact_groups(spark):
    df = images(spark, [("1", "b/x.jpg", A, 5), ("2", "_a/x.jpg", A, 5), ("3", "B/x.jpg", A, 6), ("4", "c.jpg", "b" * 64, 7)])
    g = duplicates.exact_groups(df).collect()
    assert len(g) == 1 and (g[0]["group_id"], g[0]["members"], g[0]["wasted_bytes"], g[0]["status"], g[0]["confidence"]) == ("grp_" + "a" * 24, 3, 2000, "manual-review", 0.0)
    assert g[0]["representative_id"] == "2"  # ICU order: "_a" before "b"
    assert {(r["a"], r["b"]) for r in duplicates.exact_edges(df).collect()} == {("2", "1"), ("2", "3")}
    assert [(r["inode"], r["members"]) for r in duplicates.hard_links(df).collect()] == [(5, 2)]


@pytest.mark.parametrize(
    ("prefs", "want"),
    [
        ([("keep/**", 20.0)], ("automatic", "1", 1.0)),
        ([("keep/**", 20.0), ("drop/**", 20.0)], ("manual-review", None, 0.5)),
        ([("drop/**", -5.0)], ("manual-review", None, 0.0)),  # a best score of zero is no signal
        ([("keep/**", -5.0), ("drop/**", -9.0)], ("automatic", "1", 1.0)),  # a best score below zero is one
        ([("other/**", 3.0)], ("manual-review", None, 0.0)),
    ],
)
def test_preference_winner(spark, prefs, want):
    df = images(spark, [("1", "keep/x.jpg", A, 1), ("2", "drop/x.jpg", A, 2)])
    g = duplicates.exact_groups(df, prefs).first()
    assert (g["status"], g["recommended_id"], g["confidence"]) == want


def test_globs(spark):
    cases = [("**/*.{jpg,png}", "a/b.png", True), ("**/*.{jpg,png}", "b.jpg", True), ("*.jpg", "a/b.jpg", False), ("a/**", "a/b/c", True), ("**/.git/**", "x/.git/y", True), ("a?c", "abc", True), ("[ab].x", "c.x", False), ("a/**/b", "a/b", True)]
    for glob, path, want in cases:
        assert one(spark, paths.matches_any(F.lit(path), [glob])) == want, glob
    assert one(spark, paths.preference_score(F.lit("a\\b.jpg"), [("a/*", 2.0), ("**", 1.0)])) == 3.0


# --- Classification, components, groups ------------------------------------------------------


@pytest.mark.parametrize(
    ("ssim", "transform", "colour", "size", "fmt", "want"),
    [
        (0.95, "none", 0.0, True, True, "unknown"), (0.97, "rotate180", 99.0, True, True, "rotation"), (0.97, "flipVertical", 0.0, True, True, "mirrored"),
        (0.97, "none", 15.1, True, True, "colour-adjusted"), (0.97, "none", 15.0, True, True, "recompression"), (0.999, "none", 0.0, True, True, "metadata-only-difference"),
        (0.97, "none", 0.0, True, False, "format-conversion"), (0.97, "none", 0.0, False, True, "resize"), (0.97, "none", 0.0, False, False, "resize-and-recompression"),
    ],
)
def test_classify(spark, ssim, transform, colour, size, fmt, want):
    df = spark.createDataFrame([("a", "b", ssim, transform, colour, True, size, fmt)], "a string, b string, ssim double, transform string, colour_delta double, alpha_mismatch boolean, same_size boolean, same_format boolean")
    r = compare.classify(df).first()
    assert r["relationship"] == want
    assert r["confidence"] == pytest.approx(ssim if want == "unknown" else ssim - 0.05)
    assert (len(r["reasons"]) == 0) == (want == "unknown")


def test_colour_delta_and_upscale_rules(spark):
    assert one(spark, compare.mean_colour_delta(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit(9.0)), F.array(F.lit(4.0), F.lit(2.0), F.lit(0.0)))) == 2.0
    assert one(spark, compare.is_upscale(F.lit(0.95), F.lit(1.0), F.lit(1.0))) and not one(spark, compare.is_upscale(F.lit(0.95), F.lit(2.0), F.lit(0.0)))
    assert one(spark, compare.upscale_gate(F.lit("resize"), F.lit(120), F.lit(100))) and not one(spark, compare.upscale_gate(F.lit("unknown"), F.lit(120), F.lit(100)))


def edges(spark, *rows):
    return spark.createDataFrame([(a, b, rel, c) for a, b, rel, c in rows], "a string, b string, relationship string, confidence double")


def test_components_of_random_graphs(spark):
    rng = random.Random(9)
    pairs = [(rng.randrange(150), rng.randrange(150)) for _ in range(110)] + [(200 + i, 201 + i) for i in range(30)]
    parent = {n: n for p in pairs for n in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in groups.connected_components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {n: find(n) for p in pairs if p[0] != p[1] for n in p}


def test_visual_groups(spark):
    e = edges(spark, ("a", "b", "resize", 0.95), ("c", "b", "resize", 0.8), ("x", "y", "resize", 0.5), ("y", "z", "unknown", 0.1), ("m", "n", "crop", 0.9), ("m", "o", "crop", 0.9), ("n", "o", "crop", 0.75))
    got = {tuple(r["members"]): r for r in groups.visual_groups(e).collect()}
    assert set(got) == {("a", "b"), ("x", "y"), ("m", "n", "o")}
    assert got["a", "b"]["excluded"] == ["c"] and got["a", "b"]["confidence"] == 0.95 and got["a", "b"]["status"] == "manual-review"
    assert got["x", "y"]["status"] == "ambiguous" and got["m", "n", "o"]["confidence"] == 0.75
    turned = e.select(F.col("b").alias("a"), F.col("a").alias("b"), "relationship", "confidence")
    assert {r["group_id"] for r in groups.visual_groups(turned).collect()} == {r["group_id"] for r in got.values()}


# --- Scoring ------------------------------------------------------------------------------------


def signals(spark, *rows):
    base = {"group_id": "g", "detail_score": 50.0, "pixel_count": 100000, "bit_depth": 8, "has_alpha": False, "icc": False, "metadata_count": 0, "path_score": 0.0, "is_crop": False, "retained": None, "is_upscale": False}
    schema = "group_id string, position bigint, image_id string, detail_score double, pixel_count bigint, bit_depth int, has_alpha boolean, icc boolean, metadata_count int, path_score double, is_crop boolean, retained double, is_upscale boolean"
    out = [base | r | {"position": n, "image_id": r.get("image_id", f"m{n}")} for n, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in out], schema)


def test_scores(spark):
    got = {r["image_id"]: r for r in scoring.scores(signals(spark, {}, {"detail_score": 25.0, "is_crop": True, "retained": 0.5}, {"is_upscale": True, "has_alpha": True, "icc": True, "metadata_count": 2, "path_score": 1.0})).collect()}
    assert got["m0"]["total"] == pytest.approx(30 + 20 + 20 + 5 + 2.5 - 12 - 2)
    assert got["m1"]["total"] == pytest.approx(15 + 10 + 10 + 5 + 2.5 - 20 - 12 - 2)
    assert got["m2"]["total"] == pytest.approx(30 + 20 + 20 + 5 + 8 + 5 + 7 + 5 - 25)
    assert got["m0"]["disqualified_reasons"] == [scoring.TOO_SHORT_OF_ALPHA] and len(got["m1"]["disqualified_reasons"]) == 2 and len(got["m2"]["disqualified_reasons"]) == 1
    assert got["m1"]["warnings"][0] == "crop, shows 50% of the picture"


def test_recommendation(spark):
    s = scoring.scores(signals(spark, {}, {"detail_score": 10.0}))
    g = spark.createDataFrame([("g", 0.95)], "group_id string, confidence double")
    r = scoring.recommend(g, s).first()
    assert r["confidence"] == pytest.approx(1.0) and (r["status"], r["recommended_id"]) == ("automatic", "m0")
    tie = scoring.recommend(g, scoring.scores(signals(spark, {}, {}))).first()
    assert tie["confidence"] == pytest.approx(0.92) and (tie["status"], tie["recommended_id"], tie["candidate_id"]) == ("manual-review", None, "m0")
    low = scoring.recommend(spark.createDataFrame([("g", 0.5)], "group_id string, confidence double"), s).first()
    assert low["status"] == "ambiguous"
    e = scoring.explain(s, scoring.recommend(g, s)).first()
    assert scoring.BEST_DETAIL in e["reasons"] and e["reasons"][-1].startswith("score ")


# --- Review and consolidation ----------------------------------------------------------------------


def test_validate_apply_merge(spark):
    g = "group_id string, members array<string>, recommended_id string, status string, score double, reasons array<string>"
    snap = spark.createDataFrame([(x, ["a", "b"], "a", "automatic", 9.0, ["r"]) for x in ("ok", "gone", "moved", "dup", "far", "app")], g)
    live = spark.createDataFrame([("ok", ["b", "a"]), ("moved", ["a"]), ("dup", ["a", "b"]), ("far", ["a", "b"]), ("app", ["a", "b"])], "group_id string, members array<string>")
    d = "group_id string, selected_id string, action string, note string"
    decisions = spark.createDataFrame(
        [("ok", "b", "select-different", "mine"), ("gone", None, "defer", None), ("moved", None, "defer", None), ("dup", None, "defer", None), ("dup", None, "defer", None), ("far", "z", "select-different", None), ("app", "b", "approve-recommendation", None), ("none", None, "defer", None)], d
    )
    v = {r["group_id"]: (r["verdict"], r["reason"]) for r in review.validate(decisions, snap, live).collect()}
    assert {k: x[0] for k, x in v.items()} == {"ok": "valid", "gone": "stale", "moved": "stale", "dup": "invalid", "far": "invalid", "app": "invalid", "none": "invalid"}
    assert v["moved"][1].endswith("2 then and 1 now")
    out = {r["group_id"]: r for r in review.apply(snap, decisions.where("group_id = 'ok'")).collect()}
    assert (out["ok"]["status"], out["ok"]["recommended_id"], out["ok"]["score"], out["ok"]["reasons"]) == ("approved", "b", None, ["r", "reviewer's decision: select-different (mine)"])
    assert out["gone"]["status"] == "automatic" and out["gone"]["score"] == 9.0
    old = spark.createDataFrame([("a", "defer", 0), ("b", "defer", 1)], "group_id string, action string, position bigint")
    new = spark.createDataFrame([("c", "defer", 0), ("b", "not-related", 1)], "group_id string, action string, position bigint")
    assert [(r["group_id"], r["action"]) for r in review.merge(old, new).orderBy("position").collect()] == [("a", "defer"), ("b", "not-related"), ("c", "defer")]


def select(spark, group_rows, member_rows, ids):
    g = spark.createDataFrame(group_rows, "group_id string, position bigint, status string, recommended_id string, confidence double")
    m = spark.createDataFrame(member_rows, "group_id string, image_id string")
    r = spark.createDataFrame([(i, f"p/{i}") for i in ids], "id string, relative_path string")
    return {x["image_id"]: x for x in consolidate.select_originals(g, m, r).collect()}


def test_select_originals(spark):
    out = select(spark, [("g1", 0, "automatic", "a", 0.9), ("g2", 1, "approved", None, 0.8), ("g3", 2, "manual-review", None, 0.1), ("g4", 3, "rejected", None, 0.3)], [("g1", "a"), ("g1", "b"), ("g2", "b"), ("g2", "c"), ("g3", "d"), ("g4", "e"), ("g4", "c")], "abcdef")
    assert {k: (v["method"], v["confidence"]) for k, v in out.items()} == {"a": ("automatic", 0.9), "c": ("manual", 0.8), "e": ("standalone", 0.3), "f": ("standalone", 1.0)}
    assert out["a"]["selected_from"] == ["p/b"] and out["c"]["group_ids"] == ["g2"]


def test_groups_that_subsume_each_other_select_neither(spark):
    out = select(spark, [("g1", 0, "automatic", "a", 0.9), ("g2", 1, "automatic", "b", 0.9)], [("g1", "a"), ("g1", "b"), ("g2", "a"), ("g2", "b")], "ab")
    assert out == {}


def test_plan_paths(spark):
    sel = spark.createDataFrame([("1", "X.jpg", "aaaaaaaaaaaa"), ("2", "x.JPG", "aaaaaaaaaaaa"), ("3", "x.jpg", "bbbbbbbbbbbb"), ("4", "y.jpg", "cccccccccccc")], "image_id string, base_path string, sha256 string")
    plan = {r["image_id"]: (r["canonical_path"], r["status"]) for r in consolidate.plan_paths(sel).collect()}
    assert [plan[k][1] for k in "1234"] == ["planned", "collision", "collision", "planned"]
    plan = {r["image_id"]: (r["canonical_path"], r["status"]) for r in consolidate.plan_paths(sel, "append-hash").collect()}
    assert plan["1"] == ("X.jpg", "planned") and plan["2"] == ("x-aaaaaaaa.JPG", "planned") and plan["3"] == ("x-bbbbbbbb.jpg", "planned")
    disk = spark.createDataFrame([("y.jpg", "cccccccccccc")], "path string, sha256 string")
    assert {r["image_id"]: r["status"] for r in consolidate.plan_paths(sel, "reuse-identical", disk).collect()}["4"] == "reuse-existing"
    assert {r["image_id"]: r["status"] for r in consolidate.plan_paths(sel, "fail", disk).collect()}["4"] == "collision"


def test_names(spark):
    assert one(spark, paths.sanitise(F.lit('  a<b>:"c"|d?.  '))) == "a-b---c--d-"
    assert one(spark, paths.sanitise(F.lit("..."))) == "untitled"
    assert [one(spark, paths.slugify(F.lit(x))) for x in ("Crème Brûlée!", "***", "A b")] == ["creme-brulee", "image", "a-b"]
    assert one(spark, paths.append_suffix(F.lit("d.x/name.tar.gz"), F.lit("s"))) == "d.x/name.tar-s.gz"
    assert one(spark, paths.append_suffix(F.lit("d/.hidden"), F.lit("s"))) == "d/.hidden-s"
    assert one(spark, paths.collision_key(F.lit("A\\É.jpg"))) == "a/é.jpg"
    rec = spark.createDataFrame([("i", "in/My Pic.JPG", "f" * 64, "jpeg", ["g9"], None, "2026-03-04T05:06:07.000Z")], "id string, relative_path string, sha256 string, format string, group_ids array<string>, capture_date string, modified_at string")
    got = {n: rec.select(consolidate.base_path(n, "{year}/{slug}-{shortHash}-{nope}.{ext}").alias("x")).first()["x"] for n in config.NAMINGS}
    assert got == {
        "original-filename": "My Pic.jpg", "sanitised-filename": "my-pic.jpg", "content-hash": "f" * 16 + ".jpg", "date-slug": "2026/2026-03-04-my-pic.jpg", "group-id": "g9.jpg",
        "template": "2026/my-pic-ffffffff-{nope}.jpg",
    }


def test_rollback_guards(spark):
    ops = spark.createDataFrame(
        [("1", "r1", "d1", "verified", "t1", "h"), ("2", "r1", "d2", "failed", "t1", "h"), ("3", "r1", "d3", "verified", "t1", "h"), ("4", "r2", "d3", "verified", "t2", "h"), ("5", "r1", "d4", "verified", "t1", "h"), ("6", "r1", "d5", "verified", "t1", "h")],
        "operation_id string, run_id string, destination string, status string, timestamp string, destination_hash string",
    )
    disk = spark.createDataFrame([("d1", "h"), ("d3", "h"), ("d4", "other")], "destination string, sha256 string")
    got = {r["operation_id"]: (r["decision"], r["reason"] or "") for r in consolidate.rollback(ops, "r1", disk).collect()}
    assert got["1"][0] == "remove" and "failed" in got["2"][1] and "r2" in got["3"][1] and "was changed" in got["5"][1] and "is missing" in got["6"][1]
    assert consolidate.latest_run(ops).first()["run_id"] == "r2"


# --- Workspace, discovery, configuration ---------------------------------------------------------------


def test_workspace(spark, tmp_path):
    w = tables.Workspace(spark, f"file://{tmp_path}/ws")
    assert w.read("images") is None
    w.replace("images", spark.createDataFrame([("p", 1)], "real_path string, n int"))
    w.replace("images", tables.upsert(w.read("images"), spark.createDataFrame([("p", 2), ("q", 3)], "real_path string, n int"), "real_path"))
    assert {(r["real_path"], r["n"]) for r in w.read("images").collect()} == {("p", 2), ("q", 3)}
    w.replace_kind("visual", spark.createDataFrame([("visual", 1)], "kind string, n int"))
    w.replace_kind("exact-duplicate", spark.createDataFrame([("exact-duplicate", 2)], "kind string, n int"))
    w.replace_kind("visual", spark.createDataFrame([("visual", 3)], "kind string, n int"))
    assert {(r["kind"], r["n"]) for r in w.read("groups").collect()} == {("visual", 3), ("exact-duplicate", 2)}
    w.append("scan_errors", spark.createDataFrame([("e",)], "error string"))
    w.append("scan_errors", spark.createDataFrame([("e",)], "error string"))
    assert w.read("scan_errors").count() == 2


def test_appends_rewrite_nothing_and_old_versions_go(spark, tmp_path):
    w = tables.Workspace(spark, f"file://{tmp_path}/ws")
    w.MAX_FOLDERS = 3
    for i in range(7):
        w.append("scan_errors", spark.createDataFrame([(f"e{i}",)], "error string"))
        assert w.read("scan_errors").count() == i + 1
    assert len(list((tmp_path / "ws/scan_errors/versions").glob("v*"))) == w.KEEP
    listed = {f for v in w._versions("scan_errors") for f in w._folders("scan_errors", v)}
    assert {p.name for p in (tmp_path / "ws/scan_errors").iterdir()} == {"versions", *listed}
    w.append("scan_errors", spark.createDataFrame([("x", 1)], "error string, line int"))
    assert w.read("scan_errors").where("line is null").count() == 7
    (tmp_path / "ws/schema_version").write_text("3")
    (tmp_path / "ws/.schema_version.crc").unlink(missing_ok=True)
    with pytest.raises(tables.WorkspaceError):
        tables.Workspace(spark, f"file://{tmp_path}/ws")


def test_journal_survives_a_crash(spark, tmp_path):
    from provena.plans import consolidation as c

    one, two = tmp_path / "one.png", tmp_path / "two.png"
    one.write_bytes(b"1")
    two.write_bytes(b"2")
    journal = c.Journal(str(tmp_path / "ws"), "run_x")
    for n, (source, done) in enumerate(((one, True), (two, True), (two, False))):
        target = tmp_path / f"out/{n}.png"
        entry = {"operation_id": f"op{n}", "run_id": "run_x", "source": str(source), "destination": str(target), "source_hash": c.sha256_file(str(source))}
        journal.write(entry | {"status": c.STARTED, "timestamp": c.now()})
        if done:
            assert c.copy_verified(str(source), str(target), entry["source_hash"])[0] == "verified"
        if n == 0:
            journal.write(entry | {"destination_hash": entry["source_hash"], "status": "verified", "timestamp": c.now()})
    journal.file.write('{"operation_id": "cut')
    journal.close()
    w = tables.Workspace(spark, f"file://{tmp_path}/ws")
    assert c.recover(spark, w, str(tmp_path / "ws")) == 3 and c.recover(spark, w, str(tmp_path / "ws")) == 0
    assert {r["operation_id"]: r["status"] for r in w.read("operations").collect()} == {"op0": "verified", "op1": "verified", "op2": "failed"}


def test_birth_time_is_no_later_than_changes(tmp_path):
    path = tmp_path / "x"
    path.write_text("x")
    born = discovery.birth_time(str(path), os.stat(path))
    path.chmod(0o600)
    assert 0 < born <= os.stat(path).st_ctime + 1e-3


def test_discovery(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    (a / "sub").mkdir(parents=True)
    b.mkdir()
    (a / "x.JPG").write_bytes(b"\xff\xd8\xff" + b"0" * 20)
    (a / ".hidden.png").write_bytes(b"\x89PNG\r\n\x1a\n" + b"0" * 20)
    (a / "sub" / "wrong.jpg").write_bytes(b"GIF89a" + b"0" * 20)
    (a / "notes.txt").write_text("x")
    (a / "alias.jpg").symlink_to(a / "x.JPG")
    (a / "loop.jpg").symlink_to(a / "loop.jpg")
    (b / "again.jpg").symlink_to(a / "x.JPG")
    (b / "empty.webp").write_bytes(b"")
    include, exclude = ["**/*.{jpg,jpeg,png,webp,avif,gif}"], ["**/node_modules/**"]
    got = {r["path"]: r for r in discovery.discover(spark, [str(a), str(b)], include, exclude).collect()}
    assert {p: r["status"] for p, r in got.items()} == {"x.JPG": "duplicate-path", ".hidden.png": "candidate", "sub/wrong.jpg": "candidate", "alias.jpg": "candidate", "loop.jpg": "symlink-skipped", "again.jpg": "duplicate-path", "empty.webp": "candidate"}
    assert got["sub/wrong.jpg"]["format"] == "gif" and got["sub/wrong.jpg"]["reason"] == "extension suggests jpeg, content is gif"
    strict = {r["path"]: r["status"] for r in discovery.discover(spark, [str(a)], include, exclude, follow_symlinks=False).collect()}
    assert strict["alias.jpg"] == "symlink-skipped" and strict["x.JPG"] == "candidate"


def test_config():
    c = config.load_config(inputs=("x",))
    assert c.matching.distance_threshold == 10 and c.review.automatic_threshold == 0.97
    for bad in (
        {}, {"inputs": ["x"], "nope": 1}, {"inputs": ["x"], "scoring": {"weights": {"native_detail": 31}}}, {"inputs": ["x"], "review": {"manual_threshold": 0.99}},
        {"inputs": ["x"], "consolidation": {"naming": "template"}}, {"inputs": ["x"], "consolidation": {"copy_instead_of_move": False}}, {"inputs": ["x"], "matching": {"ssim_threshold": 2}},
        {"inputs": ["x"], "concurrency": {"metadata": 0}}, {"inputs": ["x"], "references": {"source_extensions": ["html"]}},
    ):
        with pytest.raises(config.ConfigError):
            config.load_config(**bad)
    assert config.fingerprint(c) == config.fingerprint(config.load_config(inputs=("x",)))
