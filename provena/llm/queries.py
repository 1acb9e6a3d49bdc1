"""The thin contract queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontaminate, exact_dedup, minhash_dedup, pitman_yor, quality, secret_scan, substring_dedup, toxicity, warc
from .common import documents
from .labelled import held_out


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact groups of ``documents`` with the digest of every normalised text."""
    return exact_dedup.exact_dedup(documents(spark, sf_dir), carry={"text_sha256": F.sha2("_norm", 256)}).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    )


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS kept,
       text_sha256
FROM d
"""


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes of ``documents``."""
    import public_tokenizers

    vocab = byte_bpe.vocabulary(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return byte_bpe.encode(documents(spark, sf_dir), vocab, digests=True)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows found in ``documents``."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontaminate.digest(decontaminate.decontaminate(documents(spark, sf_dir), benchmark))


OP2_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
ip AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + 9), ' ') AS s FROM ip),
sizes AS (SELECT DISTINCT n FROM win),
dp AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n),
hit AS (
  SELECT d.doc_id, d.i, d.n, win.item_id
  FROM (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s FROM dp) d JOIN win ON win.n = d.n AND win.s = d.s),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of ``documents``: base spans and those of the lexer."""
    return secret_scan.digest(secret_scan.find_secrets(documents(spark, sf_dir)))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write ``pages`` as WARC files, read them back, report every record."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS keep FROM p)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                CAST(1 + ((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = keep THEN NULL ELSE keep END AS refers_to
FROM k
"""


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of ``documents`` removed as repeats of an earlier window."""
    return substring_dedup.digest(substring_dedup.substring_dedup(documents(spark, sf_dir)))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of ``documents``."""
    return minhash_dedup.near_duplicates(documents(spark, sf_dir))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of ``documents``."""
    docs = documents(spark, sf_dir)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of ``documents``."""
    docs = documents(spark, sf_dir)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op3_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of ``documents``."""
    return pitman_yor.score(documents(spark, sf_dir))


OP4_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS sh
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
both_of AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM both_of JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
side AS (SELECT x AS u, y AS v FROM link UNION SELECT y, x FROM link),
walk AS (SELECT u AS node, u AS seen FROM side UNION SELECT walk.node, side.v FROM walk JOIN side ON side.u = walk.seen),
least_of AS (SELECT node, min(seen) AS component_id FROM walk GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(l.component_id, d.doc_id) AS component_id, d.doc_id = coalesce(l.component_id, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least_of l ON l.node = d.doc_id
"""

OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(list_slice(w, i, i + 19), ' ') ORDER BY doc_id, i) AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM win WHERE k > 1) GROUP BY 1),
word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
removed AS (SELECT doc_id, unnest(ps) AS p FROM gone),
kept AS (
  SELECT word.doc_id, string_agg(word.x, ' ' ORDER BY word.p) AS text, count(*) AS n
  FROM word LEFT JOIN removed r ON r.doc_id = word.doc_id AND r.p = word.p WHERE r.p IS NULL GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM d LEFT JOIN kept k USING (doc_id)
"""


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of ``op6`` that SQL can express: the base spans."""
    return op6_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


# A pattern's matches are between the pieces that it splits the text into, so lengths give places.
BASE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
rule AS (
  SELECT * FROM (VALUES
    ('assign', 0, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+', '^(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?', 8),
    ('access', 1, 'AKIA[A-Z0-9]+', '^', 16), ('hex', 2, '[0-9a-f]+', '^', 32)) r(kind, k, rule, head, least)),
m AS (SELECT doc_id, kind, k, head, least, regexp_extract_all(t, rule) AS found, string_split_regex(t, rule) AS pieces FROM d, rule),
placed AS (
  SELECT doc_id, kind, k, found[i] AS x, length(regexp_replace(found[i], head, '')) >= least AS ok,
         list_sum(list_transform(pieces[1:i], lambda p: length(p))) + coalesce(list_sum(list_transform(found[1:i-1], lambda p: length(p))), 0) AS a
  FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM m WHERE len(found) > 0)),
s AS (SELECT doc_id, kind, k, CAST(a AS BIGINT) AS a, CAST(a + length(x) AS BIGINT) AS b FROM placed WHERE ok)
SELECT d.doc_id, count(*) FILTER (s.kind = 'assign') AS n_assign, count(*) FILTER (s.kind = 'access') AS n_access, count(*) FILTER (s.kind = 'hex') AS n_hex,
       sha256(coalesce(string_agg(s.kind || ':' || s.a || ':' || s.b, ',' ORDER BY s.a, s.k), '')) AS base_sha256
FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id
"""

QUERIES = {
    "op3_pitman_yor": op3_pitman_yor,
    "op1_quality": op1_quality,
    "op7_toxicity": op7_toxicity,
    "op4_minhash": op4_minhash,
    "op8_substring_dedup": op8_substring_dedup,
    "op10_warc": op10_warc,
    "op2_decontaminate": op2_decontaminate,
    "op6_secret_scan": op6_secret_scan,
    "op5_exact_dedup": op5_exact_dedup,
    "op9_byte_bpe": op9_byte_bpe,
    "secret_base_spans": secret_base_spans,
}

ORACLES = {"op4_minhash": OP4_SQL, "op8_substring_dedup": OP8_SQL, "secret_base_spans": BASE_SQL, "op10_warc": OP10_SQL, "op2_decontaminate": OP2_SQL, "op5_exact_dedup": OP5_SQL}
