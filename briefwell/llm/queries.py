"""The registered queries of the ten operators and of the pipeline, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_fold, table


def toxicity_categories() -> dict:
    """Chain order: abuse in English, abuse in other languages, then any; the first two are told by the documents' lang, in training only."""
    toxic, english = F.col("_label") == 1, F.col("lang") == "en"
    return {"english": toxic & english, "other": toxic & ~english, "any": toxic}


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit_toxicity, score_toxicity

    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), toxicity_categories(), keep=("lang",))
    return score_toxicity(docs, model)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


#: The listed rules of op3.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mining learns from the pages that a listed rule decides: the verdicts are labels of URLs, while ``labels`` are of documents."""
    from .url_filter import filter_urls, listed_labels

    pages = table(spark, sf_dir, "pages")
    return filter_urls(pages, listed_labels(pages, URL_RULES), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_contamination

    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.concat_ws(",", F.array_sort(F.transform("items", lambda x: x.cast("string"))))
    n_hit = F.size("hits").cast("long")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import plan_mix

    return plan_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ctw import score_texts

    return score_texts(table(spark, sf_dir, "documents"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .top_k import exact_top_k

    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_pages, read_records

    index, folder = archive_pages(table(spark, sf_dir, "pages"))
    return read_records(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit_quality, score_quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_fold("doc_id", 4) == 2
    model = fit_quality(docs, table(spark, sf_dir, "labels").filter(~held_out), "quality")
    return score_quality(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import conversation_trie

    return conversation_trie(table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_token_counts": op2_token_counts,
    "op3_url_filter": op3_url_filter,
    "op4_decontaminate": op4_decontaminate,
    "op5_mix_sources": op5_mix_sources,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_lm_scores": op7_lm_scores,
    "op8_top_k": op8_top_k,
    "op9_warc": op9_warc,
    "op10_quality": op10_quality,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_whitening": op12_whitening,
    "op13_prefix_trie": op13_prefix_trie,
    "pipeline": pipeline,
}

ORACLE_SQL: dict[str, str] = {
    "op3_url_filter": """
WITH u AS (SELECT page_id, coalesce(url, '') AS url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages
), l AS (SELECT * FROM (VALUES ('www.example.com', '/en/', 'allow'), ('example.com', '/en/', 'block'), ('net', '/es/', 'block'), ('net', '/fr/', 'block'), ('com', '/', 'allow')) AS v(h, p, v)
), r AS (SELECT u.*, (SELECT max_by({'rule': h || p, 'verdict': v}, length(h || p)) FROM l WHERE (u.host = h OR ends_with(u.host, '.' || h)) AND starts_with(u.path, p)) AS f,
  list_sort(list_distinct(list_filter(list_concat(list_transform(string_split_regex(host, '[.:]'), lambda x: 'host:' || x), list_transform(string_split_regex(lower(path), '[^\\p{L}\\p{N}]+'), lambda x: 'path:' || x), list_transform(regexp_extract_all(url, '[?&]([^=&#]+)', 1), lambda x: 'query:' || lower(x))), lambda x: NOT regexp_matches(x, ':[0-9]*$')))) AS w FROM u
), t AS (SELECT x, count(*) FILTER (WHERE bad) AS nb FROM (SELECT unnest(w) AS x, f.verdict = 'block' AS bad FROM r WHERE f IS NOT NULL) GROUP BY 1
), n AS (SELECT count(*) AS n, CAST(ceil(count(*) * 5 / 1000.0) AS BIGINT) AS least, (SELECT count(*) FROM pages WHERE url IS NOT NULL) AS n_all FROM r WHERE f IS NOT NULL
), k AS (SELECT list(x) AS xs FROM t, n WHERE nb >= least
), s AS (SELECT page_id, f.verdict AS v, list_intersect(w, (SELECT xs FROM k)) AS w FROM r
), g AS (SELECT page_id, v, array_to_string(list_sort(list_filter(w, lambda x, i: (m >> (i - 1)) & 1 = 1)), ' ') AS set FROM (SELECT *, unnest(range(1, CAST(1 << len(w) AS BIGINT))) AS m FROM s)
), q AS (SELECT set FROM g, n GROUP BY set, n, least, n_all HAVING count(*) FILTER (WHERE v = 'block') >= least AND 100 * count(*) FILTER (WHERE v = 'block') >= 80 * count(v) AND count(v) * n_all * 100 >= count(*) * n * 80
), b AS (SELECT DISTINCT page_id FROM g WHERE set IN (SELECT set FROM q))
SELECT page_id, host, path, f.rule AS rule, coalesce(f.verdict, CASE WHEN page_id IN (SELECT page_id FROM b) THEN 'block' ELSE 'allow' END) AS verdict FROM r""",
    "op4_decontaminate": """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), p AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS k FROM i WHERE len(w) > 0)
), q AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM p))
), h AS (SELECT doc_id, item_id, k, q.n FROM q JOIN p ON q.n = p.n AND q.g = p.g
), c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS j FROM h) GROUP BY 1
), s AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS items_sha256 FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)""",
    "op5_mix_sources": """
WITH z AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents
), t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM z GROUP BY 1
), w AS (SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS DOUBLE) AS weight, CAST(source_size AS DOUBLE) * 3 AS cap FROM t
), l AS (SELECT *, (sum(CAST(source_size AS DOUBLE)) OVER () - coalesce(sum(cap) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level FROM w
  WINDOW o AS (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (SELECT source, source_size, least(cap, weight * coalesce((SELECT level FROM l WHERE cap / weight > level ORDER BY cap / weight LIMIT 1), 'infinity'::DOUBLE)) AS target FROM l
), r AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate FROM f
), c AS (SELECT doc_id, size, source_size, target, least(3, CAST(floor(rate) AS BIGINT) + CASE WHEN CAST('0x' || substr(md5(concat_ws('/', '11', CAST(doc_id AS VARCHAR))), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END) AS copies
  FROM z JOIN r ON z.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(size * copies AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies FROM c""",
    "op6_near_duplicates": """
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) END AS s FROM d
), u AS (SELECT doc_id, unnest(s) AS g FROM s
), j AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM u x JOIN u y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2
), l AS (SELECT a, b FROM j JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * i >= 80 * (len(x.s) + len(y.s) - i)
), r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), m AS (SELECT a, min(b) AS component_id FROM r GROUP BY 1)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN m ON doc_id = a""",
    "op8_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op9_warc": """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
  CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS DISTINCT FROM p.page_id THEN first END AS refers_to
FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest""",
    "op13_prefix_trie": """
WITH o AS (
  SELECT conv_id AS c, md5(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS k, strlen(coalesce(text, '')) AS b, turn, coalesce(role, '') AS role FROM conversations WHERE conv_id IS NOT NULL
), q AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, k) AS p FROM o
), h AS (
  SELECT c, c - c % 5 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
    lambda r, x: list_reduce(list_prepend(xor(r, x), list_transform(range(8), lambda i: i)), lambda y, i: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)), 4294967295) % 9 AS h FROM (SELECT DISTINCT c FROM o)
), m AS (SELECT h.c, h, base, (SELECT count(*) FROM q WHERE q.c = h.base AND p <= h) AS n FROM h
), r AS (
  SELECT m.c, p AS d, k, b FROM m JOIN q ON q.c = m.base AND p <= h UNION ALL SELECT m.c, p - h + n, k, b FROM m JOIN q ON q.c = m.c AND p > h
), w AS (SELECT c, 0 AS d, []::VARCHAR[] AS k, 0 AS b FROM m UNION ALL SELECT c, d, list(k) OVER (PARTITION BY c ORDER BY d), b FROM r
), z AS (SELECT c, max(d) AS l FROM w GROUP BY c
), t AS (
  SELECT k, d, min(c) AS conv_id, count(*) AS n, min(b) AS b, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE d = l), '') AS e FROM w JOIN z USING (c) GROUP BY k, d
), s AS (SELECT k, d, conv_id, n, b, e, (SELECT count(*) FROM t x WHERE x.d = t.d + 1 AND x.k[1:t.d] = t.k) AS ch FROM t
), a AS (SELECT k[1:u] AS k, sum(CASE WHEN ch = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n - 1) * b) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS u FROM s) GROUP BY ALL)
SELECT s.conv_id, CAST(s.d AS BIGINT) AS depth, x.conv_id AS parent_conv_id, s.n AS n_convs, s.ch AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(s.e) AS ends_sha256
FROM s JOIN a ON a.k = s.k LEFT JOIN s x ON s.d > 0 AND x.d = s.d - 1 AND x.k = s.k[1:s.d - 1]""",
}
