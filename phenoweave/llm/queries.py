"""The registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from phenoweave.llm import decontaminate, divergence, hard_negatives, line_dedup, near_text, near_vectors, pieces, quotations, sharding, stream_dedup, token_counts, toxicity, warc
from phenoweave.session import text_batches

TOKENIZERS = "/opt/tokenizers"  # folder of vocabulary files; read by the driver


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str, folder: str | None = None) -> bytes:
    """Content of a vocabulary file; by default of the installed public tokenizers."""
    if folder is None:
        try:
            import public_tokenizers

            return Path(public_tokenizers.path(name)).read_bytes()
        except ModuleNotFoundError:
            folder = TOKENIZERS
    return (Path(folder) / name).read_bytes()


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.drop("items")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op3_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.document_shards(_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("curve").alias("hilbert_index"))


def op4_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Pages carry no time of capture; a steady crawl of one page a second stands in.
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html", F.timestamp_seconds(F.coalesce("page_id", F.lit(0)) + 1_700_000_000).alias("time"))
    return warc.capture_index(pages).select(F.col("capture_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "timestamp")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json").decode())


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(_table(spark, sf_dir, "documents"))


def op8_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_text.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(_table(spark, sf_dir, "embeddings"))


def op10_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotations.reply_ordered(_table(spark, sf_dir, "conversations"))


def op11_segment_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    moved = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.hard_negatives(moved, F.col("vec_id") % 100 == 0)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(_table(spark, sf_dir, "documents"))


def op13_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stream_dedup.deduplicate(spark, f"{sf_dir}/documents.parquet")
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha256").alias("text_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_benchmark_decontamination, op2_sentencepiece, op3_hilbert_shards, op4_warc_index, op5_token_counts,
        op6_toxicity, op7_line_dedup, op8_bag_minhash, op9_cross_polytope, op10_quotation_links,
        op11_segment_summaries, op12_source_divergence, op13_stream_dedup,
    )
}

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES = {
    "op1_benchmark_decontamination": f"""
WITH d AS (SELECT row_number() OVER () r, doc_id, {_WORDS.format("coalesce(text, '')")} w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') item, {_WORDS.format("coalesce(text, '')")} w FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(10, len(w)) n, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) i FROM b WHERE len(w) > 0)
),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT r, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) i FROM d, lens WHERE len(w) >= n)
),
hits AS (SELECT r, i, dw.n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
covered AS (SELECT r, count(DISTINCT p) n_hit FROM (SELECT r, unnest(range(i, i + n)) p FROM hits) GROUP BY r),
named AS (SELECT r, count(*) n_items, string_agg(item, ',' ORDER BY item) items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(n_hit, 0) AS BIGINT) n_hit, CAST(coalesce(n_items, 0) AS BIGINT) n_items,
       sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r)""",
    "op4_warc_index": r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') html, CAST(strlen(coalesce(html, '')) AS BIGINT) n, sha1(coalesce(html, '')) h FROM pages),
f AS (SELECT h, max(page_id) m FROM p WHERE n >= 1000 GROUP BY h),
k AS (
  SELECT *, regexp_replace(regexp_replace(lower(coalesce(url, '')), '#.*$', ''), '^[a-z][a-z0-9+.-]*://([^/@]*@)?', '') bare FROM p
),
s AS (
  SELECT *, regexp_replace(regexp_extract(bare, '^([^/?:]*)', 1), '^www[0-9]*\.', '') host, regexp_replace(bare, '^[^/?:]*(:[0-9]+)?', '') rest FROM k
),
u AS (SELECT *, CASE WHEN length(rest) > 1 AND ends_with(rest, '/') THEN rest[:-2] ELSE rest END path FROM s)
SELECT page_id, n payload_bytes, u.h payload_digest,
  CASE WHEN m IS NULL OR m = page_id THEN 'response' ELSE 'revisit' END record_type,
  CASE WHEN m <> page_id THEN m END refers_to,
  CASE WHEN bare = '' THEN '' ELSE array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN path = '' THEN '/' ELSE path END END urlkey,
  strftime(make_timestamp((1700000000 + coalesce(page_id, 0)) * 1000000), '%Y-%m-%dT%H:%M:%SZ') "timestamp"
FROM u LEFT JOIN f ON u.h = f.h""",
    "op7_line_dedup": f"""
WITH d AS (SELECT row_number() OVER () r, doc_id, string_split(coalesce(text, ''), chr(10)) l FROM documents),
e AS (SELECT r, doc_id, i, l[i] line FROM (SELECT r, doc_id, l, unnest(range(1, len(l) + 1)) i FROM d)),
k AS (SELECT r, doc_id, i, line, {_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} key FROM e),
s AS (SELECT key, max(doc_id) m FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT r) >= 5),
j AS (SELECT r, k.doc_id, i, line, s.key IS NOT NULL AND m IS NOT NULL AND m IS DISTINCT FROM k.doc_id OR s.key IS NOT NULL AND m IS NULL AND k.doc_id IS NOT NULL gone FROM k LEFT JOIN s ON k.key = s.key)
SELECT any_value(doc_id) doc_id, count(*) n_lines, count(*) FILTER (gone) n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) kept_sha256
FROM j GROUP BY r""",
    "op9_cross_polytope": """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () r, vec_id, CAST(embedding AS DOUBLE[]) e FROM embeddings
),
g AS (
  SELECT r, vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) u FROM v
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(e, lambda y: y * y)) > 0
),
n AS MATERIALIZED (SELECT a.r a, b.r b FROM g a JOIN g b ON a.r < b.r AND list_inner_product(a.u, b.u) >= 0.95),
l AS MATERIALIZED (SELECT a, b FROM n UNION ALL SELECT b, a FROM n),
reach AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT r, coalesce(least(min(w.vec_id), any_value(v.vec_id)), any_value(v.vec_id)) component_id
      FROM v LEFT JOIN reach ON v.r = reach.a LEFT JOIN (SELECT r rr, vec_id FROM v) w ON w.rr = reach.b GROUP BY r),
d AS (SELECT a r, count(*) n_links FROM l GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n_links, 0) AS BIGINT) n_links, component_id, v.vec_id = component_id kept
FROM v JOIN c USING (r) LEFT JOIN d USING (r)""",
    "op11_segment_summaries": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END l,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS HUGEINT)) e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS MATERIALIZED (
  SELECT a.vec_id a, b.vec_id b, a.l = b.l same, CAST(coalesce(list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])), 0) AS BIGINT) s
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
),
p AS (SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT p.a anchor_id, p.b positive_id, CAST(row_number() OVER w AS INTEGER) AS "rank", n.b negative_id, p.s positive_score, n.s negative_score
FROM p JOIN s n ON n.a = p.a AND NOT n.same AND 30 * p.s <= 100 * n.s AND 100 * n.s <= 90 * p.s
WINDOW w AS (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b) QUALIFY row_number() OVER w <= 10""",
    "op12_source_divergence": f"""
WITH d AS (SELECT row_number() OVER () r, coalesce(lang, '') lang, coalesce(source, '') source, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') terms FROM documents),
t AS (SELECT r, lang, source, unnest(terms) w FROM d),
k AS MATERIALIZED (SELECT lang, w FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, w, count(*) n FROM t GROUP BY ALL),
p AS MATERIALIZED (
  SELECT lang, source, w, n, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) p,
         1 + (1000000000::HUGEINT * (sum(n) OVER (PARTITION BY lang, w) + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v) q
  FROM (SELECT g.lang, g.source, k.w, coalesce(n, 0) n FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.w = k.w) JOIN v USING (lang)
),
s AS (SELECT a.lang, a.source, b.source item, sum(abs(a.p - b.p)) f FROM p a JOIN p b ON a.lang = b.lang AND a.w = b.w AND a.source <> b.source GROUP BY ALL),
o AS (
  SELECT g.lang, g.source, 'pair' part, h.source item, coalesce(f, 0) f FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN s ON s.lang = g.lang AND s.source = g.source AND s.item = h.source
  UNION ALL SELECT lang, source, 'term', w, p - q FROM p WHERE n > 0 AND p > q
)
SELECT * FROM (
  SELECT lang, source, part, item, CAST(f AS BIGINT) AS "value", CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY f DESC, item) AS INTEGER) AS "rank" FROM o
) WHERE part = 'pair' OR "rank" <= 50""",
    "op13_stream_dedup": """
WITH d AS (SELECT row_number() OVER () r, doc_id, coalesce(text, '') t FROM documents),
g AS (SELECT t, max(doc_id) keep_id, count(*) group_size, arg_max(r, coalesce(doc_id, -9223372036854775808)) keeper FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, r = keeper kept, sha256(t) text_sha256 FROM d JOIN g USING (t)""",
}
