"""DuckDB SQL for the query catalogue, built from shared common table expressions."""

from __future__ import annotations

# Fixed values of the catalogue's queries.
PREFERENCES = (("src1/**", 20.0), ("src2/**", -20.0), ("*/en/*", 5.0))
PAIR_DISTANCE, CROP_DISTANCE, TOLERANCE = 24, 28, 0.015
SIMILARITY, LOOSE_SIMILARITY = 0.96, 0.9

IMG = """
img AS (
  SELECT d.doc_id, 'img_' || substr(sha1(d.relative_path), 1, 20) AS id, d.relative_path, d.sha256, d.size_bytes, d.format, d.width, d.height,
         CAST(1 AS BIGINT) AS device, d.size_bytes * 2 + d.doc_id % 2 AS inode, d.doc_id % 5 = 0 AS has_alpha, d.doc_id % 3 = 0 AS icc,
         coalesce(l.toxic, 0) = 1 AS is_upscale, CAST(d.size_bytes % 101 + coalesce(l.quality, 0) * 10 AS DOUBLE) AS detail_score,
         (CASE WHEN regexp_full_match(d.relative_path, 'src1(/.*)?') THEN 20.0 ELSE 0.0 END
          + CASE WHEN regexp_full_match(d.relative_path, 'src2(/.*)?') THEN -20.0 ELSE 0.0 END
          + CASE WHEN regexp_full_match(d.relative_path, '[^/]*/en/[^/]*') THEN 5.0 ELSE 0.0 END)::DOUBLE AS pref
  FROM (SELECT doc_id, source || '/' || lang || '/' || doc_id || '.jpg' AS relative_path, sha256(text) AS sha256, n_chars AS size_bytes,
               CASE lang WHEN 'en' THEN 'jpeg' WHEN 'de' THEN 'png' WHEN 'fr' THEN 'webp' ELSE 'gif' END AS format,
               64 + n_chars % 1024 AS width, 64 + (n_chars * 7) % 768 AS height FROM documents) d
  LEFT JOIN labels l ON l.doc_id = d.doc_id),
dup AS (
  SELECT *, count(*) OVER w AS n, first_value(id) OVER (PARTITION BY sha256 ORDER BY relative_path, id) AS rep,
         first_value(size_bytes) OVER (PARTITION BY sha256 ORDER BY relative_path, id) AS rep_bytes, max(pref) OVER w AS top
  FROM img WINDOW w AS (PARTITION BY sha256) QUALIFY n >= 2)"""

REC = """
rec AS (
  SELECT vec_id, label, embedding AS e, list_sort(embedding) AS so, 'img_' || substr(sha1(CAST(vec_id AS VARCHAR)), 1, 20) AS id,
         sha256(CAST(vec_id AS VARCHAR)) AS sha256, 1.0::DOUBLE + label * 0.01::DOUBLE AS aspect_ratio
  FROM embeddings),
bits AS (
  SELECT *, list_transform(range(1, 65), lambda i: CAST(e[i] < e[((i - 1) // 8) * 8 + i % 8 + 1] AS BIGINT)) AS db,
            list_transform(range(1, 65), lambda i: CAST(e[i] > so[32] AS BIGINT)) AS pb FROM rec),
h AS (
  SELECT * EXCLUDE (so, db, pb),
         list_reduce(db[1:32], lambda x, y: x * 2 + y) AS d_hi, list_reduce(db[33:64], lambda x, y: x * 2 + y) AS d_lo,
         list_reduce(pb[1:32], lambda x, y: x * 2 + y) AS p_hi, list_reduce(pb[33:64], lambda x, y: x * 2 + y) AS p_lo FROM bits)"""

SPUN = """spin AS (
  SELECT vec_id, 0 AS variant, e FROM rec
  UNION ALL SELECT vec_id, 1, list_transform(range(0, 64), lambda i: e[64 - i]) FROM rec
  UNION ALL SELECT vec_id, 2, list_transform(range(0, 64), lambda i: e[(i // 8) * 8 + (7 - i % 8) + 1]) FROM rec
  UNION ALL SELECT vec_id, 3, list_transform(range(0, 64), lambda i: e[(7 - i // 8) * 8 + i % 8 + 1]) FROM rec),
spun AS (
  SELECT vec_id, variant, list_transform(range(1, 65), lambda i: CAST(e[i] < e[((i - 1) // 8) * 8 + i % 8 + 1] AS BIGINT)) AS db,
         list_transform(range(1, 65), lambda i: CAST(e[i] > list_sort(e)[32] AS BIGINT)) AS pb FROM spin)"""

DIST = "bit_count(xor(x.{0}_hi, y.{0}_hi)) + bit_count(xor(x.{0}_lo, y.{0}_lo))"

PAIRS = REC + f""",
pairs AS (
  SELECT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b, CAST({DIST.format('d')} AS INTEGER) AS d_distance, CAST({DIST.format('p')} AS INTEGER) AS p_distance,
         abs(x.aspect_ratio - y.aspect_ratio) AS aspect_delta
  FROM h x JOIN h y ON x.vec_id < y.vec_id AND x.sha256 <> y.sha256
   AND {DIST.format('d')} <= {PAIR_DISTANCE} AND {DIST.format('p')} <= {PAIR_DISTANCE} AND abs(x.aspect_ratio - y.aspect_ratio) <= {TOLERANCE}::DOUBLE)"""

CROPS = f"""
crops AS (
  SELECT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b, CAST({DIST.format('d')} AS INTEGER) AS d_distance
  FROM h x JOIN h y ON x.vec_id < y.vec_id AND x.sha256 <> y.sha256 AND {DIST.format('d')} <= {CROP_DISTANCE})"""

CMP = PAIRS + """,
feat AS (
  SELECT p.a, p.b, x.vec_id AS n, y.vec_id AS m,
         least(1.0, round(0.85::DOUBLE + 0.3::DOUBLE * (
           list_sum(list_transform(range(1, 65), lambda i: x.e[i]::DOUBLE * y.e[i]::DOUBLE)) /
           sqrt(list_sum(list_transform(range(1, 65), lambda i: x.e[i]::DOUBLE * x.e[i]::DOUBLE)) * list_sum(list_transform(range(1, 65), lambda i: y.e[i]::DOUBLE * y.e[i]::DOUBLE)))), 6))::DOUBLE AS ssim,
         CASE WHEN (x.vec_id + y.vec_id) % 7 = 0 THEN 'rotate180' WHEN (x.vec_id + y.vec_id) % 7 = 1 THEN 'flipHorizontal' ELSE 'none' END AS transform,
         CAST(abs(x.vec_id - y.vec_id) % 20 AS DOUBLE) AS colour_delta, (x.vec_id % 3 = 0) <> (y.vec_id % 3 = 0) AS alpha_mismatch,
         x.label = y.label AS same_size, x.vec_id % 2 = y.vec_id % 2 AS same_format
  FROM pairs p JOIN h x ON x.id = p.a JOIN h y ON y.id = p.b),
cmp AS (
  SELECT *, CASE WHEN ssim < 0.96 THEN 'unknown' WHEN transform = 'rotate180' THEN 'rotation' WHEN transform LIKE 'flip%' THEN 'mirrored'
                 WHEN colour_delta > 15 THEN 'colour-adjusted' WHEN same_size AND same_format THEN CASE WHEN ssim >= 0.999 THEN 'metadata-only-difference' ELSE 'recompression' END
                 WHEN same_size THEN 'format-conversion' WHEN same_format THEN 'resize' ELSE 'resize-and-recompression' END AS relationship,
            CASE WHEN ssim < 0.96 THEN greatest(0.0::DOUBLE, ssim) ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, ssim - CASE WHEN alpha_mismatch THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END)) END AS confidence
  FROM feat)"""

GROUPS = CMP + """,
edge AS (SELECT a, b, confidence FROM cmp WHERE relationship <> 'unknown'),
sides AS (SELECT a AS u, b AS v FROM edge UNION SELECT b, a FROM edge),
walk AS (SELECT u AS node, u AS seen FROM sides UNION SELECT w.node, s.v FROM walk w JOIN sides s ON s.u = w.seen),
comp AS (SELECT node, min(seen) AS component FROM walk GROUP BY node),
vm AS (SELECT c.component, c.node AS image_id, c.node = c.component OR EXISTS (SELECT 1 FROM sides s WHERE s.u = c.component AND s.v = c.node) AS accepted FROM comp c),
weak AS (SELECT x.component, min(e.confidence) AS confidence, count(*) AS edges FROM edge e JOIN vm x ON x.image_id = e.a AND x.accepted JOIN vm y ON y.image_id = e.b AND y.accepted WHERE x.component = y.component GROUP BY 1),
vg AS (
  SELECT 'grp_v_' || substr(sha256(string_agg(image_id, ',' ORDER BY image_id) FILTER (accepted)), 1, 24) AS group_id, vm.component,
         string_agg(image_id, ',' ORDER BY image_id) FILTER (accepted) AS members, list_sort(list(image_id) FILTER (accepted)) AS member_list,
         coalesce(string_agg(image_id, ',' ORDER BY image_id) FILTER (NOT accepted), '') AS excluded, any_value(edges) AS edges, any_value(confidence) AS confidence
  FROM vm JOIN weak USING (component) GROUP BY vm.component),
mem AS (SELECT group_id, unnest(member_list) AS image_id FROM vg)"""

SCORES = GROUPS + """,
sig AS (
  SELECT m.group_id, m.image_id, h.vec_id AS position, CAST(vec_id % 101 AS DOUBLE) AS detail_score, (64 + vec_id % 1024) * (64 + (vec_id * 7) % 768) AS pixel_count,
         CASE WHEN vec_id % 4 = 0 THEN 16 ELSE 8 END AS bit_depth, vec_id % 3 = 0 AS has_alpha, vec_id % 4 = 1 AS icc, CAST(vec_id % 4 AS INTEGER) AS metadata_count,
         CASE WHEN vec_id % 5 = 0 THEN 10.0 WHEN vec_id % 5 = 1 THEN -10.0 ELSE 0.0 END::DOUBLE AS path_score, vec_id % 9 = 0 AS is_crop,
         CASE WHEN vec_id % 9 = 0 THEN 0.5::DOUBLE + (vec_id % 5) * 0.1::DOUBLE END AS retained, vec_id % 13 = 0 AS is_upscale
  FROM mem m JOIN h ON h.id = m.image_id),
ctx AS (
  SELECT *, greatest(0.0::DOUBLE, max(detail_score) OVER w) AS max_detail, greatest(1, max(pixel_count) OVER w) AS max_pixels, greatest(8, max(bit_depth) OVER w) AS max_depth,
         greatest(0, max(metadata_count) OVER w) AS max_metadata, bool_or(NOT is_crop) OVER w AS any_complete, bool_or(NOT is_upscale) OVER w AS any_genuine,
         sum(has_alpha::INT) OVER w - has_alpha::INT > 0 AS other_alpha
  FROM sig WINDOW w AS (PARTITION BY group_id)),
parts AS (
  SELECT *, CASE WHEN max_detail > 0 THEN 30.0::DOUBLE * (detail_score / max_detail) ELSE 30.0::DOUBLE END AS native_detail,
         20.0::DOUBLE * (pixel_count::DOUBLE / max_pixels) * CASE WHEN is_crop THEN coalesce(retained, 1.0::DOUBLE) ELSE 1.0::DOUBLE END AS effective_resolution,
         20.0::DOUBLE * CASE WHEN is_crop THEN coalesce(retained, 0.0::DOUBLE) ELSE 1.0::DOUBLE END AS completeness, 5.0::DOUBLE * (bit_depth::DOUBLE / max_depth) AS depth_score,
         CASE WHEN has_alpha THEN 8.0::DOUBLE ELSE 0 END AS alpha_score, CASE WHEN icc THEN 5.0::DOUBLE ELSE 0 END AS icc_score,
         CASE WHEN max_metadata > 0 THEN 7.0::DOUBLE * (metadata_count::DOUBLE / max_metadata) ELSE 0 END AS metadata_score,
         CASE WHEN path_score > 0 THEN 5.0::DOUBLE WHEN path_score < 0 THEN 0 ELSE 2.5::DOUBLE END AS path_part,
         CASE WHEN is_upscale THEN 25.0::DOUBLE ELSE 0 END AS upscale_penalty, CASE WHEN is_crop THEN 20.0::DOUBLE ELSE 0 END AS crop_penalty,
         CASE WHEN NOT has_alpha AND other_alpha THEN 12.0::DOUBLE ELSE 0 END AS alpha_penalty, CASE WHEN metadata_count = 0 AND max_metadata > 0 THEN 2.0::DOUBLE ELSE 0 END AS metadata_penalty,
         CAST((is_upscale AND any_genuine)::INT + (is_crop AND any_complete)::INT + (NOT has_alpha AND other_alpha)::INT AS INTEGER) AS strikes
  FROM ctx),
sc AS (
  SELECT *, greatest(0.0::DOUBLE, least(100.0::DOUBLE, native_detail + effective_resolution + completeness + depth_score + alpha_score + icc_score + metadata_score + path_part
         - (upscale_penalty + crop_penalty + alpha_penalty + metadata_penalty))) AS total, strikes > 0 AS disqualified FROM parts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY total DESC, position) AS rn FROM sc),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY total DESC, position) AS k FROM sc WHERE NOT disqualified) WHERE k = 1),
marg AS (
  SELECT group_id, max(total) FILTER (rn = 1) AS best, max(total) FILTER (rn = 2) AS second, (max(total) FILTER (rn = 1) - max(total) FILTER (rn = 2)) / 100 AS margin,
         max((crop_penalty > 0)::INT) AS any_crop, max((alpha_penalty > 0)::INT) AS any_alpha, max((native_detail >= 30.0::DOUBLE * 0.99::DOUBLE)::INT) FILTER (rn = 1) AS best_has_detail
  FROM ranked GROUP BY group_id),
reco0 AS (
  SELECT vg.group_id, greatest(0.0::DOUBLE, least(1.0::DOUBLE, vg.confidence + CASE WHEN second IS NULL THEN 0.0::DOUBLE WHEN margin >= 0.15 THEN 0.03::DOUBLE WHEN margin < 0.05 THEN -0.05::DOUBLE ELSE 0.0::DOUBLE END
           - CASE WHEN any_crop = 1 THEN 0.04::DOUBLE ELSE 0.0::DOUBLE END - CASE WHEN any_alpha = 1 THEN 0.03::DOUBLE ELSE 0.0::DOUBLE END
           + CASE WHEN any_crop = 0 AND best_has_detail = 1 THEN 0.02::DOUBLE ELSE 0.0::DOUBLE END)) AS confidence, b.image_id AS candidate_id, b.total AS candidate_score
  FROM vg JOIN marg USING (group_id) LEFT JOIN best b USING (group_id)),
reco1 AS (SELECT *, CASE WHEN confidence < 0.7 THEN 'ambiguous' WHEN confidence >= 0.9 AND candidate_id IS NOT NULL THEN 'automatic' ELSE 'manual-review' END AS status FROM reco0),
reco AS (SELECT group_id, confidence, status, CASE WHEN status = 'automatic' THEN candidate_id END AS recommended_id, CASE WHEN status = 'automatic' THEN candidate_score END AS score, candidate_id FROM reco1)"""

DECISIONS = SCORES + """,
snap AS (SELECT vg.group_id, vg.member_list AS members, reco.recommended_id, reco.status, reco.confidence, reco.score, h.vec_id AS p FROM vg JOIN reco USING (group_id) JOIN h ON h.id = vg.component),
live AS (SELECT group_id, CASE WHEN p % 9 = 0 THEN members[:-2] ELSE members END AS members FROM snap WHERE p % 7 <> 0),
dec AS (
  SELECT group_id, CASE p % 6 WHEN 0 THEN recommended_id WHEN 1 THEN members[-1] WHEN 5 THEN 'img_x' END AS selected_id,
         CASE p % 6 WHEN 0 THEN 'approve-recommendation' WHEN 1 THEN 'select-different' WHEN 2 THEN 'keep-multiple' WHEN 3 THEN 'not-related' WHEN 4 THEN 'defer' ELSE 'select-different' END AS action,
         CASE WHEN p % 4 = 0 THEN 'seen' END AS note, p AS position
  FROM snap
  UNION ALL SELECT group_id, NULL, 'defer', NULL, p + 1000000 FROM snap WHERE p % 10 = 0
  UNION ALL SELECT 'grp_missing_' || p, NULL, 'defer', NULL, p + 2000000 FROM snap WHERE p % 8 = 0),
verdict AS (
  SELECT *, CASE WHEN reason IS NULL THEN 'valid' WHEN reason LIKE 'stale: %' THEN 'stale' ELSE 'invalid' END AS verdict FROM (
    SELECT d.*, CASE WHEN count(*) OVER (PARTITION BY d.group_id) > 1 THEN count(*) OVER (PARTITION BY d.group_id) || ' decisions name this group, one is allowed'
                     WHEN s.group_id IS NULL THEN 'unknown group'
                     WHEN d.selected_id IS NOT NULL AND NOT list_contains(s.members, d.selected_id) THEN d.selected_id || ' is in another group or in none'
                     WHEN d.action = 'approve-recommendation' AND d.selected_id IS DISTINCT FROM s.recommended_id THEN 'approval of an image that was not recommended'
                     WHEN l.group_id IS NULL THEN 'stale: the group is gone'
                     WHEN s.members <> l.members THEN 'stale: other members, ' || len(s.members) || ' then and ' || len(l.members) || ' now' END AS reason
    FROM dec d LEFT JOIN snap s ON s.group_id = d.group_id LEFT JOIN live l ON l.group_id = d.group_id)),
applied AS (
  SELECT s.group_id, CASE WHEN v.action IN ('approve-recommendation', 'select-different', 'keep-multiple') THEN 'approved' WHEN v.action = 'not-related' THEN 'rejected' ELSE s.status END AS status,
         CASE WHEN v.action IS NULL OR v.action IN ('approve-recommendation', 'defer') THEN s.recommended_id WHEN v.action = 'select-different' THEN v.selected_id END AS recommended_id,
         CASE WHEN v.action IS NULL OR v.action IN ('approve-recommendation', 'defer') THEN s.score END AS score, s.confidence, s.p AS position,
         CASE WHEN v.action IS NULL THEN '' ELSE 'reviewer''s decision: ' || v.action || CASE WHEN v.note IS NOT NULL THEN ' (' || v.note || ')' ELSE '' END END AS reasons
  FROM snap s LEFT JOIN verdict v ON v.group_id = s.group_id AND v.verdict = 'valid')"""

SELECTED = DECISIONS + """,
decided AS (SELECT * FROM applied WHERE status NOT IN ('manual-review', 'ambiguous')),
subsumed AS (SELECT DISTINCT m.image_id FROM mem m JOIN decided d USING (group_id) WHERE d.recommended_id IS NOT NULL AND m.image_id <> d.recommended_id),
pass1 AS (
  SELECT d.recommended_id AS image_id, max(d.confidence) AS confidence, CASE WHEN arg_max(d.status, d.position) = 'automatic' THEN 'automatic' ELSE 'manual' END AS method,
         string_agg(DISTINCT d.group_id, ',' ORDER BY d.group_id) AS group_ids
  FROM decided d WHERE d.recommended_id IN (SELECT id FROM h) AND d.recommended_id NOT IN (SELECT image_id FROM subsumed) GROUP BY 1),
froms AS (SELECT d.recommended_id AS image_id, string_agg(DISTINCT 'vec/' || h.vec_id, ',' ORDER BY 'vec/' || h.vec_id) AS selected_from FROM decided d JOIN mem m USING (group_id) JOIN h ON h.id = m.image_id WHERE m.image_id <> d.recommended_id GROUP BY 1),
pass2 AS (
  SELECT m.image_id, arg_min(d.confidence, d.position) AS confidence, CASE WHEN arg_min(d.status, d.position) = 'rejected' THEN 'standalone' ELSE 'manual' END AS method, arg_min(d.group_id, d.position) AS group_ids
  FROM mem m JOIN decided d USING (group_id)
  WHERE d.recommended_id IS NULL AND m.image_id NOT IN (SELECT image_id FROM subsumed) AND m.image_id NOT IN (SELECT image_id FROM pass1) GROUP BY 1),
sel AS (
  SELECT p.image_id, p.method, p.confidence, p.group_ids, coalesce(f.selected_from, '') AS selected_from FROM pass1 p LEFT JOIN froms f USING (image_id)
  UNION ALL SELECT image_id, method, confidence, group_ids, '' FROM pass2
  UNION ALL SELECT id, 'standalone', 1.0::DOUBLE, '', '' FROM h WHERE id NOT IN (SELECT image_id FROM mem))"""

# Paths of all images by content: equal texts collide.
PATHS = IMG + """,
want AS (SELECT id AS image_id, sha256, substr(sha256, 1, 16) || '.jpg' AS base_path FROM img),
placed AS (SELECT *, row_number() OVER (PARTITION BY base_path ORDER BY image_id) AS k FROM want)"""

OPS = """
ops AS (
  SELECT 'op_' || substr(sha1(event_id || ':' || strftime(ts, '%Y-%m-%d') || ':originals/' || user_id), 1, 20) AS operation_id, strftime(ts, '%Y-%m-%d') AS run_id, 'originals/' || user_id AS destination,
         CASE event_id % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'skipped-identical' WHEN 2 THEN 'rolled-back' ELSE 'verified' END AS status, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS timestamp
  FROM events),
early AS (SELECT min(run_id) AS run_id FROM ops),
guard AS (
  SELECT o.*, (SELECT arg_min(l.run_id, l.ts || l.run_id) FROM (SELECT run_id, max(timestamp) AS ts FROM ops x WHERE x.destination = o.destination AND x.run_id <> o.run_id GROUP BY 1) l WHERE l.ts > o.timestamp) AS later
  FROM ops o WHERE o.run_id = (SELECT run_id FROM early)),
roll AS (
  SELECT operation_id, run_id, destination, status, timestamp, CASE WHEN status <> 'verified' OR later IS NOT NULL THEN 'skip' ELSE 'remove' END AS decision,
         CASE WHEN status <> 'verified' THEN 'nothing to remove, status ' || status
              WHEN later IS NOT NULL THEN 'needed by the later run ' || later END AS reason
  FROM guard)"""

MEASURED = IMG + """,
measured AS (
  SELECT x.id AS a, y.id AS b, x.doc_id AS n, x.width * x.height AS area_a, y.width * y.height AS area_b, x.detail_score AS detail_a, y.detail_score AS detail_b,
         (70 + x.doc_id % 31) / 100::DOUBLE AS ssim, (60 + x.doc_id % 41) / 100::DOUBLE AS correlation
  FROM img x JOIN img y ON y.doc_id = x.doc_id + 1)"""

HALVES = ", ".join(f"list_reduce({b}b[{a}:{z}], lambda x, y: x * 2 + y) AS {b}_{n}" for b in "dp" for a, z, n in ((1, 32, "hi"), (33, 64, "lo")))

SEEN = """
known AS (SELECT doc_id, source || '/' || lang || '/' || doc_id AS real_path, n_chars AS size_bytes, CASE WHEN doc_id % 10 = 3 THEN '2026-01-02' ELSE '2026-01-01' END AS modified_at FROM documents WHERE doc_id % 4 <> 0),
now_seen AS (SELECT doc_id, source || '/' || lang || '/' || doc_id AS real_path, n_chars AS size_bytes, '2026-01-01' AS modified_at FROM documents)"""


def _sql(ctes: str, tail: str) -> str:
    return f"WITH RECURSIVE {ctes.strip()}\n{tail}"


def all_sql() -> dict[str, str]:
    r6 = lambda c: f"round({c}, 6) AS {c}"
    return {
        "exact_duplicate_groups": _sql(IMG, """
SELECT 'grp_' || substr(sha256, 1, 24) AS group_id, sha256, count(*) AS members, any_value(rep) AS representative_id, CAST((count(*) - 1) * any_value(rep_bytes) AS BIGINT) AS wasted_bytes,
       CASE WHEN any_value(top) <> 0 AND count(*) FILTER (pref = top) = 1 THEN max(id) FILTER (pref = top) END AS recommended_id,
       CASE WHEN any_value(top) <> 0 AND count(*) FILTER (pref = top) = 1 THEN 'automatic' ELSE 'manual-review' END AS status,
       CASE WHEN any_value(top) = 0 THEN 0.0::DOUBLE WHEN count(*) FILTER (pref = top) = 1 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS confidence
FROM dup GROUP BY sha256"""),
        "exact_duplicate_members": _sql(IMG, "SELECT 'grp_' || substr(sha256, 1, 24) AS group_id, id AS image_id, relative_path, id = rep AS representative FROM dup"),
        "exact_duplicate_edges": _sql(IMG, "SELECT 'grp_' || substr(sha256, 1, 24) AS group_id, rep AS a, id AS b, 'exact-duplicate' AS relationship, 1.0::DOUBLE AS confidence, 'same SHA-256' AS reason FROM dup WHERE id <> rep"),
        "wasted_bytes_total": _sql(IMG, "SELECT count(DISTINCT sha256) AS groups, count(*) AS files, CAST(coalesce(sum(rep_bytes) FILTER (id <> rep), 0) AS BIGINT) AS wasted_bytes FROM dup"),
        "hard_link_clusters": _sql(IMG, "SELECT 'grp_' || substr(sha256, 1, 24) AS group_id, device, inode, count(*) AS members, min(id) AS first_id FROM dup GROUP BY sha256, device, inode HAVING count(*) > 1"),
        "path_preference_scores": _sql(IMG, "SELECT id, relative_path, pref AS score FROM img"),
        "path_preference_winner": _sql(IMG, "SELECT 'grp_' || substr(sha256, 1, 24) AS group_id, max(id) FILTER (pref = top) AS recommended_id FROM dup GROUP BY sha256 HAVING any_value(top) <> 0 AND count(*) FILTER (pref = top) = 1"),
        "discovery_format_sniff": """
SELECT doc_id, substr(name, length(name) - strpos(reverse(name), '.') + 2) AS extension, by_extension, by_content, coalesce(by_content, by_extension) AS format,
       CASE WHEN coalesce(by_content, by_extension) IS NULL THEN 'unsupported' ELSE 'candidate' END AS status
FROM (SELECT doc_id, name, CASE lower(substr(name, length(name) - strpos(reverse(name), '.') + 2)) WHEN 'jpg' THEN 'jpeg' WHEN 'png' THEN 'png' WHEN 'gif' THEN 'gif' END AS by_extension,
             CASE doc_id % 6 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'png' WHEN 2 THEN 'gif' WHEN 3 THEN 'webp' WHEN 4 THEN 'avif' END AS by_content
      FROM (SELECT doc_id, 'f' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.JPG' WHEN 1 THEN '.png' WHEN 2 THEN '.gif' ELSE '.txt' END AS name FROM documents))""",
        "discovery_realpath_dedup": """
SELECT doc_id, absolute_path, CASE WHEN row_number() OVER (PARTITION BY real_path ORDER BY input_index, absolute_path) = 1 THEN 'candidate' ELSE 'duplicate-path' END AS status
FROM (SELECT doc_id, doc_id % 3 AS input_index, '/in' || doc_id % 3 || '/' || doc_id AS absolute_path, '/real/' || doc_id // 2 AS real_path FROM documents)""",
        "cache_reuse_anti_join": _sql(SEEN, "SELECT doc_id, real_path, size_bytes, modified_at FROM now_seen s WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.real_path = s.real_path AND k.size_bytes = s.size_bytes AND k.modified_at = s.modified_at)"),
        "record_upsert": _sql(SEEN, "SELECT doc_id, real_path, size_bytes, modified_at FROM now_seen WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id, real_path, size_bytes, modified_at FROM known WHERE real_path NOT IN (SELECT real_path FROM now_seen WHERE doc_id % 5 = 0)"),
        "perceptual_hashes": _sql(REC, "SELECT id, aspect_ratio, d_hi, d_lo, p_hi, p_lo FROM h"),
        "hamming_pairs_t10": _sql(REC + f""",
both_h AS (
  SELECT id, sha256, vec_id AS k, aspect_ratio, d_hi, d_lo, p_hi, p_lo FROM h
  UNION ALL SELECT 'near_' || id, sha256(id), vec_id + 1099511627776, aspect_ratio, d_hi, xor(d_lo, CAST((1 << CAST(vec_id % 12 AS INTEGER)) - 1 AS BIGINT)), p_hi, xor(p_lo, vec_id % 12 % 4) FROM h)""",
            f"""SELECT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b, CAST({DIST.format('d')} AS INTEGER) AS d_distance, CAST({DIST.format('p')} AS INTEGER) AS p_distance
FROM both_h x JOIN both_h y ON x.k < y.k AND x.sha256 <> y.sha256 AND {DIST.format('d')} <= 10 AND {DIST.format('p')} <= 10 AND abs(x.aspect_ratio - y.aspect_ratio) <= {TOLERANCE}::DOUBLE"""),
        "candidate_pairs": _sql(PAIRS, f"SELECT a, b, d_distance, p_distance, {r6('aspect_delta')} FROM pairs"),
        "aspect_bucket_pairs": _sql(REC + """,
kinds AS (SELECT aspect_ratio, count(*) AS n FROM rec GROUP BY 1)""", f"SELECT r.id, round(r.aspect_ratio, 6) AS aspect_class, CAST((SELECT sum(k.n) FROM kinds k WHERE abs(r.aspect_ratio - k.aspect_ratio) <= {TOLERANCE}::DOUBLE) - 1 AS BIGINT) AS partners FROM rec r"),
        "orientation_variant_pairs": _sql(REC + f""",
{SPUN},
q AS (
  SELECT h.vec_id, h.id, h.sha256, h.aspect_ratio, s.variant, list_reduce(db[1:32], lambda x, y: x * 2 + y) AS d_hi, list_reduce(db[33:64], lambda x, y: x * 2 + y) AS d_lo,
         list_reduce(pb[1:32], lambda x, y: x * 2 + y) AS p_hi, list_reduce(pb[33:64], lambda x, y: x * 2 + y) AS p_lo,
         min(h.vec_id) OVER (PARTITION BY floor(h.aspect_ratio / 0.06::DOUBLE)) AS bucket_order FROM spun s JOIN h USING (vec_id)),
hits AS (
  SELECT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b, CAST({DIST.format('d')} AS INTEGER) AS d_distance, CAST({DIST.format('p')} AS INTEGER) AS p_distance,
         row_number() OVER (PARTITION BY least(x.id, y.id), greatest(x.id, y.id) ORDER BY x.bucket_order, x.vec_id, x.variant, y.vec_id) AS k
  FROM q x JOIN h y ON x.id <> y.id AND x.sha256 <> y.sha256 AND {DIST.format('d')} <= {PAIR_DISTANCE} AND {DIST.format('p')} <= {PAIR_DISTANCE} AND abs(x.aspect_ratio - y.aspect_ratio) <= {TOLERANCE}::DOUBLE)""", "SELECT a, b, d_distance, p_distance FROM hits WHERE k = 1"),
        "crop_candidate_pairs_t28": _sql(REC + "," + CROPS, "SELECT a, b, d_distance FROM crops"),
        "crop_extra_pairs_anti": _sql(PAIRS + "," + CROPS, "SELECT a, b, d_distance FROM crops WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.a = crops.a AND p.b = crops.b)"),
        "classify_relationship": _sql(CMP, f"SELECT a, b, ssim, transform, relationship, {r6('confidence')} FROM cmp"),
        "unconfirmed_pairs": _sql(CMP, f"SELECT a, b, ssim, {r6('confidence')} FROM cmp WHERE relationship = 'unknown'"),
        "relationship_counts": _sql(CMP, "SELECT relationship, count(*) AS pairs FROM cmp GROUP BY 1"),
        "connected_components": _sql(GROUPS, "SELECT node, component FROM comp"),
        "visual_groups": _sql(GROUPS, f"SELECT group_id, members, edges, {r6('confidence')}, CASE WHEN confidence < 0.7 THEN 'ambiguous' ELSE 'manual-review' END AS status FROM vg"),
        "visual_group_exclusions": _sql(GROUPS.replace(f"ssim < {SIMILARITY}", f"ssim < {LOOSE_SIMILARITY}"), "SELECT component, image_id FROM vm WHERE NOT accepted"),
        "member_signals": _sql(SCORES, "SELECT group_id, image_id, detail_score, pixel_count, bit_depth, has_alpha, icc, metadata_count, path_score, is_crop, round(retained, 6) AS retained, is_upscale FROM sig"),
        "scoring_context": _sql(SCORES, "SELECT group_id, image_id, max_detail, max_pixels, max_depth, max_metadata, any_complete, any_genuine, other_alpha FROM ctx"),
        "candidate_scores": _sql(SCORES, f"SELECT group_id, image_id, {r6('native_detail')}, {r6('effective_resolution')}, {r6('completeness')}, {r6('depth_score')}, {r6('metadata_score')}, {r6('total')}, disqualified FROM sc"),
        "disqualified_candidates": _sql(SCORES, "SELECT group_id, image_id, strikes FROM sc WHERE disqualified"),
        "top_eligible_per_group": _sql(SCORES, f"SELECT group_id, image_id, {r6('total')} FROM best"),
        "score_margin": _sql(SCORES, f"SELECT group_id, {r6('best')}, {r6('second')}, {r6('margin')} FROM marg"),
        "recommendation_confidence": _sql(SCORES, f"SELECT group_id, {r6('confidence')} FROM reco"),
        "group_status_decision": _sql(SCORES, f"SELECT group_id, status, recommended_id, {r6('score')}, candidate_id FROM reco"),
        "decision_validation": _sql(DECISIONS, "SELECT group_id, position, action, verdict, reason FROM verdict"),
        "stale_decisions": _sql(DECISIONS, "SELECT group_id, reason FROM verdict WHERE verdict = 'stale'"),
        "decision_apply": _sql(DECISIONS, f"SELECT group_id, status, recommended_id, {r6('score')}, reasons FROM applied"),
        "decision_merge": _sql(DECISIONS, """SELECT group_id, action, position FROM (
  SELECT n.group_id, n.action, coalesce(o.position, n.position + 1099511627776) AS position FROM dec n LEFT JOIN dec o ON o.group_id = n.group_id AND o.position < 1000000 AND o.position % 2 = 0 WHERE n.position < 1000000 AND n.position % 3 = 0
  UNION ALL SELECT group_id, action, position FROM dec WHERE position < 1000000 AND position % 2 = 0 AND position % 3 <> 0)"""),
        "select_originals": _sql(SELECTED, f"SELECT image_id, method, {r6('confidence')}, group_ids, selected_from FROM sel"),
        "standalone_originals": _sql(SELECTED, "SELECT id AS image_id FROM h WHERE id NOT IN (SELECT image_id FROM mem)"),
        "unresolved_groups": _sql(DECISIONS, "SELECT DISTINCT group_id FROM applied WHERE status IN ('manual-review', 'ambiguous')"),
        "canonical_paths_content_hash": _sql(PATHS, "SELECT image_id, base_path AS canonical_path, CASE WHEN k = 1 THEN 'planned' ELSE 'collision' END AS status FROM placed"),
        "path_collisions": _sql(PATHS, """SELECT image_id, 'planned for another image: ' || base_path AS collision_reason FROM placed WHERE k > 1"""),
        "append_hash_resolution": _sql(PATHS, "SELECT image_id, CASE WHEN k = 1 THEN base_path ELSE substr(sha256, 1, 16) || '-' || substr(sha256, 1, least(8 + k - 2, 27)) || '.jpg' END AS canonical_path, CASE WHEN k <= 21 THEN 'planned' ELSE 'collision' END AS status FROM placed"),
        "canonical_paths_sanitised": """
SELECT p_partkey, CASE WHEN slug = '' THEN 'image' ELSE slug END || '.png' AS sanitised_filename, CASE WHEN clean = '' THEN 'untitled' ELSE clean END AS component
FROM (SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
             regexp_replace(regexp_replace(regexp_replace('  ' || p_name || ': <' || p_type || '>. ', '[\\x00-\\x1f<>:"/\\\\|?*]', '-', 'g'), '\\s+', ' ', 'g'), '^[. ]+|[. ]+$', '', 'g') AS clean FROM part)""",
        "manifest_rows": _sql(PATHS, "SELECT p.base_path AS canonical_path, p.sha256, i.width, i.height, i.format FROM placed p JOIN img i ON i.id = p.image_id WHERE k = 1"),
        "latest_run": _sql(OPS, "SELECT run_id, timestamp, operation_id FROM ops ORDER BY timestamp DESC, operation_id DESC LIMIT 1"),
        "rollback_eligible": _sql(OPS.replace("SELECT min(run_id) AS run_id FROM ops", "SELECT run_id FROM ops ORDER BY timestamp DESC, operation_id DESC LIMIT 1"), "SELECT operation_id, destination FROM roll WHERE decision = 'remove'"),
        "rollback_skipped_reasons": _sql(OPS, "SELECT operation_id, reason FROM roll WHERE decision = 'skip'"),
        "operations_by_status": _sql(OPS, "SELECT run_id, status, count(*) AS operations, count(DISTINCT destination) AS destinations FROM ops GROUP BY 1, 2"),
        "scan_errors_ordered": "SELECT 'page/' || page_id AS file_path, 'cut short' AS error FROM pages WHERE NOT contains(coalesce(html, ''), '</body>') ORDER BY 1, 2",
        "audit_summary": _sql(IMG, "SELECT format, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes, count(*) FILTER (is_upscale) AS upscales, count(*) FILTER (has_alpha) AS with_alpha FROM img GROUP BY format"),
        "report_summary": _sql(SCORES, "SELECT (SELECT count(*) FROM h) AS files, count(*) AS groups, count(*) FILTER (status = 'automatic') AS automatic, count(*) FILTER (status = 'manual-review') AS manual_review, count(*) FILTER (status = 'ambiguous') AS ambiguous FROM reco"),
        "report_assets": _sql(GROUPS, "SELECT id AS image_id FROM h WHERE id IN (SELECT image_id FROM mem)"),
        "group_validator_violations": _sql(DECISIONS, """
SELECT * FROM (
  SELECT group_id, CASE WHEN len(members) < 2 THEN 'fewer than two members' WHEN recommended_id IS NOT NULL AND NOT list_contains(members, recommended_id) THEN 'winner is no member'
                        WHEN status = 'automatic' AND score IS NULL THEN 'automatic without a score' END AS problem
  FROM (SELECT group_id, CASE WHEN p % 4 = 0 THEN members[1:1] ELSE members END AS members, CASE WHEN p % 4 = 1 THEN 'img_x' ELSE recommended_id END AS recommended_id,
               CASE WHEN p % 4 = 2 THEN 'automatic' ELSE status END AS status, CASE WHEN p % 4 <> 2 THEN score END AS score FROM snap)) WHERE problem IS NOT NULL"""),
        "reference_extraction": """SELECT page_id, CAST(position - 1 AS INTEGER) AS position, target FROM (SELECT page_id, unnest(regexp_extract_all(html, '(href|src|srcset)="([^"]+)"', 2)) AS target, generate_subscripts(regexp_extract_all(html, '(href|src|srcset)="([^"]+)"', 2), 1) AS position FROM pages)""",
        "reference_classes": """SELECT class, count(*) AS refs FROM (SELECT CASE WHEN t LIKE 'data:%' THEN 'data-url' WHEN regexp_matches(t, '^(https?:)?//') THEN 'external' WHEN t LIKE '#%' THEN 'fragment' WHEN t LIKE '/%' THEN 'absolute-path' ELSE 'relative-path' END AS class FROM (SELECT unnest(regexp_extract_all(html, '(href|src|srcset)="([^"]+)"', 2)) AS t FROM pages)) GROUP BY 1""",
        "hash_distances": _sql(REC, f"SELECT x.id AS a, y.id AS b, lower(lpad(to_hex(x.d_hi), 8, '0') || lpad(to_hex(x.d_lo), 8, '0')) AS hash, CAST({DIST.format('d')} AS INTEGER) AS distance FROM h x JOIN h y ON y.vec_id = x.vec_id + 1"),
        "orientation_hashes": _sql(f"{REC},\n{SPUN}", f"SELECT id, variant, {HALVES} FROM spun JOIN rec USING (vec_id) WHERE variant > 0"),
        "colour_deltas": _sql(REC, """
SELECT x.id AS a, y.id AS b, round((abs(x.e[1]::DOUBLE - y.e[1]::DOUBLE) + abs(x.e[2]::DOUBLE - y.e[2]::DOUBLE) + abs(x.e[3]::DOUBLE - y.e[3]::DOUBLE)) / 3, 6) AS delta FROM rec x JOIN rec y ON y.vec_id = x.vec_id + 1"""),
        "upscale_decisions": _sql(MEASURED, """
SELECT CASE WHEN a_first THEN a ELSE b END AS large, CASE WHEN a_first THEN b ELSE a END AS small,
       ssim >= 0.9 AND CASE WHEN low > 0 THEN high / low WHEN high > 0 THEN 'inf'::DOUBLE ELSE 1.0::DOUBLE END < 1.15::DOUBLE AS upscale
FROM (SELECT *, area_a >= area_b AS a_first, CASE WHEN area_a >= area_b THEN detail_a ELSE detail_b END AS high, CASE WHEN area_a >= area_b THEN detail_b ELSE detail_a END AS low FROM measured)
WHERE n % 5 <> 0 AND greatest(area_a, area_b) >= 1.2::DOUBLE * least(area_a, area_b)"""),
        "crop_decisions": _sql(MEASURED, "SELECT a, b, correlation >= 0.85 AND ssim >= 0.75 AS crop FROM measured"),
        "comparisons_with_placeholders": _sql(CMP + "," + CROPS, f"SELECT a, b, relationship, {r6('confidence')} FROM cmp UNION ALL SELECT a, b, 'unknown', 0.0::DOUBLE FROM crops WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.a = crops.a AND p.b = crops.b)"),
        "all_groups": _sql(GROUPS + "," + IMG, "SELECT 'grp_' || substr(sha256, 1, 24) AS group_id, 'exact-duplicate' AS kind, CAST(count(*) AS INTEGER) AS members FROM dup GROUP BY sha256 UNION ALL SELECT group_id, 'visual', CAST(len(member_list) AS INTEGER) FROM vg"),
        "exact_group_reasons": _sql(IMG, """
SELECT 'grp_' || substr(sha256, 1, 24) AS group_id, count(*) || ' files with SHA-256 ' || substr(sha256, 1, 12) || '…' AS reason,
       CASE WHEN any_value(top) = 0 THEN 'no path is preferred, so no copy is chosen' WHEN count(*) FILTER (pref = top) > 1 THEN 'several paths are preferred alike' END AS warning
FROM dup GROUP BY sha256"""),
        "recommendation_explanations": _sql(SCORES, """
SELECT s.group_id,
       concat_ws('|', CASE WHEN s.native_detail >= 29.7::DOUBLE THEN 'most detail of the group' END, CASE WHEN NOT s.is_crop THEN 'whole picture' END, CASE WHEN s.icc THEN 'has an ICC profile' END, CASE WHEN s.path_score > 0 THEN 'path is preferred' END) AS reasons,
       concat_ws('|', CASE WHEN s.is_crop THEN 'crop, shows ' || CAST(round(s.retained * 100) AS INTEGER) || '% of the picture' END, CASE WHEN s.path_score < 0 THEN 'path is unwanted' END, CASE WHEN s.is_upscale THEN 'enlarged without more detail' END,
                 CASE WHEN NOT s.has_alpha AND s.other_alpha THEN 'opaque, unlike another member' END, CASE WHEN s.metadata_penalty > 0 THEN 'no metadata, unlike another member' END,
                 (SELECT string_agg('ruled out: ' || o.image_id || ' (' || concat_ws('; ', CASE WHEN o.is_upscale AND o.any_genuine THEN 'enlarged, another member is not' END, CASE WHEN o.is_crop AND o.any_complete THEN 'cropped, another member is whole' END,
                                                                                       CASE WHEN NOT o.has_alpha AND o.other_alpha THEN 'opaque, another member is transparent' END) || ')', '|' ORDER BY o.position)
                  FROM sc o WHERE o.group_id = s.group_id AND o.disqualified AND o.image_id <> s.image_id)) AS warnings
FROM sc s JOIN reco r ON r.group_id = s.group_id AND r.candidate_id = s.image_id"""),
        "glob_filter": _sql(IMG, "SELECT id, relative_path FROM img WHERE (regexp_full_match(relative_path, 'src1(/.*)?') OR regexp_full_match(relative_path, '[^/]*/en/[^/]*')) AND NOT regexp_full_match(relative_path, '([^/]+/)*1[^/]*\\.jpg')"),
        "canonical_names": _sql(IMG + """,
named AS (
  SELECT id, CAST(doc_id AS VARCHAR) AS s, sha256, CASE WHEN doc_id % 4 <> 0 THEN 'g:' || doc_id % 10 END AS g,
         CASE WHEN doc_id % 3 = 0 THEN '2025-03-04' WHEN doc_id % 5 <> 0 THEN '2024-11-30' END AS day FROM img)""", """
SELECT id, 'original-filename' AS naming, s || '.jpg' AS base_path FROM named
UNION ALL SELECT id, 'sanitised-filename', s || '.jpg' FROM named
UNION ALL SELECT id, 'content-hash', substr(sha256, 1, 16) || '.jpg' FROM named
UNION ALL SELECT id, 'date-slug', CASE WHEN day IS NULL THEN 'unknown-date/' || s ELSE substr(day, 1, 4) || '/' || day || '-' || s END || '.jpg' FROM named
UNION ALL SELECT id, 'group-id', CASE WHEN g IS NULL THEN 'standalone-' || id ELSE replace(g, ':', '-') END || '.jpg' FROM named
UNION ALL SELECT id, 'template', coalesce(substr(day, 1, 4), 'unknown-date') || '/' || coalesce(replace(g, ':', '-'), 'standalone') || '/' || s || '-' || substr(sha256, 1, 8) || '-{other}.jpg' FROM named"""),
        "manifest_without_failed": _sql(PATHS, "SELECT p.base_path AS canonical_path, p.sha256 FROM placed p WHERE k = 1 AND p.base_path NOT IN (SELECT q.base_path FROM placed q JOIN img i ON i.id = q.image_id WHERE i.width % 2 = 0)"),
        "hash_lookup": _sql(IMG, "SELECT id, CASE WHEN min(id) OVER (PARTITION BY sha256) < 'img_8' THEN min(id) OVER (PARTITION BY sha256) WHEN doc_id % 3 = 0 THEN 'old' END AS d_hash FROM img"),
        "sticky_upscale_flags": _sql(IMG, "SELECT id, is_upscale OR doc_id % 4 = 1 AS is_upscale FROM img"),
        "workspace_images": _sql(IMG, "SELECT id, relative_path, size_bytes FROM img ORDER BY relative_path"),
        "workspace_record_by_path": _sql(IMG, "SELECT id, relative_path FROM img WHERE relative_path = (SELECT min(relative_path) FROM img)"),
        "workspace_groups_by_kind": _sql(IMG, "SELECT id AS group_id, CASE WHEN doc_id % 3 = 1 THEN 'exact-duplicate' ELSE 'visual' END AS kind FROM img WHERE doc_id % 3 > 0"),
        "operations_by_destination": _sql(OPS, "SELECT operation_id, run_id, destination, timestamp FROM ops WHERE destination = (SELECT min(destination) FROM ops) ORDER BY timestamp, operation_id"),
        "operations_marked": _sql(OPS, "SELECT operation_id, CASE WHEN run_id = (SELECT run_id FROM early) AND status = 'verified' THEN 'rolled-back' ELSE status END AS status, CASE WHEN run_id = (SELECT run_id FROM early) AND status = 'verified' THEN 'now' END AS rolled_back_at FROM ops"),
    }
