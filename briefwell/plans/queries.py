"""Registered queries over whole tables. Each has a name, a Spark form built from the operators, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EXPECTED_TYPES, FEEDBACK_COMMANDS, FEEDBACK_PHRASES, OFF_TOPIC_WORDS, TOPIC_HOSTS, TOPIC_WORDS, WRONG_TYPE
from ..functions import dates, text, urls
from ..operators import dedup, events, history, ranking, recall, reports, scoring, tags, vector_index
from ..operators.stored import shared_folder, stored
from ..sources import history_table, landed
from ..streaming import windows
from ..taxonomy import DEFAULT_TAG_SCORE, TAG_DEFAULTS, TAG_SIGNALS
from .adapters import HEADLINED_SQL, POLICY, articles, headlined, table
from .registry import ORACLE_SQL, QUERIES, query  # noqa: F401  the driver reads the registry here

def best() -> list:
    """Score order with a full tie-break."""
    return [F.col("total_score").desc(), F.col("ord")]


def ascending() -> list:
    """The same order as ascending expressions."""
    return [-F.col("total_score"), F.col("ord")]


# --- normalisation -------------------------------------------------------------------------------------------------


@query("SELECT freshness_bucket, count(*) AS n, min(age_hours) AS youngest, max(age_hours) AS oldest FROM a GROUP BY 1")
def freshness_buckets(spark, d):
    return articles(spark, d).groupBy("freshness_bucket").agg(F.count("*").alias("n"), F.min("age_hours").alias("youngest"), F.max("age_hours").alias("oldest"))


@query("SELECT source_domain, source_kind, source_tier, source_priority, count(*) AS n FROM a GROUP BY ALL")
def source_kind_priority(spark, d):
    return articles(spark, d).groupBy("source_domain", "source_kind", "source_tier", "source_priority").agg(F.count("*").alias("n"))


@query("SELECT page_id, regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', '') AS domain FROM pages", over="")
def url_domain(spark, d):
    return table(spark, d, "pages").select("page_id", urls.domain(F.col("url")).alias("domain"))


@query("SELECT page_id, regexp_replace(regexp_replace(trim(coalesce(url, '')), '#.*$', ''), '/+$', '') AS canonical FROM pages", over="")
def url_canonical(spark, d):
    return table(spark, d, "pages").select("page_id", urls.canonical(F.col("url")).alias("canonical"))


@query("SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[ \\t\\n\\r]+', ' ', 'g')) AS title FROM pages", over="")
def page_title(spark, d):
    return table(spark, d, "pages").select("page_id", urls.page_title(F.col("html")).alias("title"))


@query("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + INTERVAL 20 YEAR AS DATE) AS published FROM orders", over="")
def url_date_parse(spark, d):
    path = F.concat(F.lit("https://news.example.com/"), F.date_format(F.add_months(F.col("o_orderdate").cast("date"), 240), "yyyy/MM/dd"), F.lit("/"), F.col("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey", urls.date_in_path(path).alias("published"))


@query("""SELECT event_id, CAST(ts AS DATE) AS day, date_diff('hour', ts, TIMESTAMP '2024-01-31 00:00:00') AS hours FROM events""", over="")
def timestamp_parse(spark, d):
    as_text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    hours = (F.unix_timestamp(F.lit("2024-01-31 00:00:00").cast("timestamp")) / 3600 - F.floor(F.unix_timestamp(F.col("p")) / 3600)).cast("long")
    return table(spark, d, "events").select("event_id", dates.parse_timestamp(as_text).alias("p")).select("event_id", F.col("p").cast("date").alias("day"), hours.alias("hours"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(event_id % 50 AS DOUBLE) WHEN 1 THEN CAST(event_id % 50 AS DOUBLE) * 24 WHEN 2 THEN 24.0 END AS hours FROM events""", over="")
def relative_hints(spark, d):
    n, k = F.col("event_id") % 50, F.col("event_id") % 4
    hint = F.when(k == 0, F.concat(n, F.lit(" hours ago"))).when(k == 1, F.concat(n, F.lit(" days ago"))).when(k == 2, " Yesterday ").otherwise("recently")
    return table(spark, d, "events").select("event_id", dates.hint_hours(hint).alias("hours"))


@query("""SELECT page_id, concat_ws(',', CASE WHEN contains(lower(url), '?utm_') OR contains(lower(url), 'page=') THEN 'search_or_landing_url' END,
  CASE WHEN contains(lower(t), 'trusted by') OR contains(lower(t), 'get started') THEN 'marketing_title' END) AS flags
FROM (SELECT page_id, coalesce(url, '') AS url, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS t FROM pages)""", over="")
def news_candidate_flags(spark, d):
    from dataclasses import replace

    policy = replace(POLICY, landing_parts=("?utm_", "page="), generic_titles=())
    pages = table(spark, d, "pages")
    flags = urls.news_flags(replace(policy, generic_titles=("\u0000",)), urls.domain(F.col("url")), F.col("url"), urls.page_title(F.col("html")))
    return pages.select("page_id", F.concat_ws(",", flags).alias("flags"))


#: Whole titles and contents with letters outside ASCII as _, for the \\b of SQL knows ASCII only.
PLAIN_SQL = """(SELECT ord, source_domain, regexp_replace(regexp_replace(replace(lower(title || ' ' || coalesce(content, '')), 'trí tuệ nhân tạo', 'tri tue nhan tao'), '[^\\x00-\\x7F\\p{L}\\p{N}\\p{M}]', ' ', 'g'), '[^\\x00-\\x7F]', '_', 'g') AS w FROM hl)"""


@query(f"+ {HEADLINED_SQL} SELECT ord, CAST(len(regexp_extract_all(w, '(?i){TOPIC_WORDS}')) AS INTEGER) AS ai_hits, CAST(len(regexp_extract_all(w, '(?i){OFF_TOPIC_WORDS}')) AS INTEGER) AS off_hits FROM {PLAIN_SQL}")
def relevance_hits(spark, d):
    """Hits of the topic's and of other topics' words in whole titles and contents."""
    whole = F.concat_ws(" ", "title", F.coalesce("content", F.lit("")))
    return headlined(spark, d).select("ord", text.hit_count(whole, text.unicode_pattern(TOPIC_WORDS)).alias("ai_hits"), text.hit_count(whole, text.unicode_pattern(OFF_TOPIC_WORDS)).alias("off_hits"))


@query(f"""+ {HEADLINED_SQL}, h AS (SELECT ord, len(regexp_extract_all(w, '(?i){TOPIC_WORDS}')) AS x, len(regexp_extract_all(w, '(?i){OFF_TOPIC_WORDS}')) AS y, source_domain IN {TOPIC_HOSTS} AS k FROM {PLAIN_SQL})
SELECT ord, CAST(x AS INTEGER) AS ai_hits, CAST(y AS INTEGER) AS off_hits, CASE WHEN k OR x >= 2 THEN NOT (y >= 2 AND x < 4) ELSE x = 1 AND y = 0 END AS relevant,
  concat_ws(',', CASE WHEN k THEN 'ai_domain' END, CASE WHEN x > 0 THEN 'ai_hits:' || x END, CASE WHEN y > 0 THEN 'off_topic_hits:' || y END,
  CASE WHEN (k OR x >= 2) AND y >= 2 AND x < 4 THEN 'blocked:offtopic_dominant' WHEN k OR x >= 2 THEN NULL WHEN x = 1 AND y = 0 THEN 'borderline_ai_signal' ELSE 'blocked:weak_ai_signal' END) AS signals FROM h""")
def relevance_decision(spark, d):
    """Relevance of every document by its whole text."""
    return headlined(spark, d).select("ord", scoring.ai_relevance(F.col("source_domain"), F.col("title"), F.col("content")).alias("r")).select("ord", "r.*")


@query("SELECT ord, list_aggregate(list_sort(list_distinct(list_filter(regexp_extract_all(regexp_replace(strip_accents(lower(replace(title, 'ß', ''))), '[^\\x00-\\x7F]', '', 'g'), '[a-z0-9]+'), lambda w: length(w) >= 3 AND w NOT IN $STOPWORDS))), 'string_agg', ' ') AS tokens FROM a")
def title_tokens_all(spark, d):
    """Tokens of the title of every document, whatever its language, also without one."""
    rows = articles(spark, d).select("ord", text.title_tokens(F.col("title")).alias("t"))
    return rows.select("ord", F.when(F.size("t") > 0, F.concat_ws(" ", "t")).alias("tokens"))


@query("SELECT ord, source_domain AS source_key FROM a")
def source_history_keys(spark, d):
    none = F.lit(None).cast("string")
    return articles(spark, d).select("ord", urls.source_history_key(F.col("source_domain"), F.col("url"), F.col("source"), none, none).alias("source_key"))


# --- de-duplication ------------------------------------------------------------------------------------------------


@query("SELECT ord, sha256(url) AS url_hash FROM a WHERE ord NOT IN (SELECT doc_id FROM labels)")
def url_hash_antijoin(spark, d):
    rows = articles(spark, d)
    seen = rows.join(table(spark, d, "labels").select(F.col("doc_id").alias("ord")), "ord", "left_semi").select(urls.url_hash(F.col("url")).alias("url_hash"))
    return dedup.unseen(rows, seen).select("ord", urls.url_hash(F.col("url")).alias("url_hash"))


@query("SELECT ord, sha256(url) AS url_hash FROM a WHERE ord NOT IN (SELECT doc_id FROM labels)")
def url_filter_antijoin(spark, d):
    """The same by a history written in two appends and its Bloom filters."""
    from ..operators import seen
    from ..operators.stored import shared_folder

    rows = articles(spark, d)
    labelled = rows.join(table(spark, d, "labels").select(F.col("doc_id").alias("ord")), "ord", "left_semi")
    path = shared_folder(spark, "seen")
    for half in (0, 1):
        seen.append_seen(labelled.filter(F.col("ord") % 2 == half), path)
    return seen.unseen_by_filter(rows, path).select("ord", urls.url_hash(F.col("url")).alias("url_hash"))


@query("SELECT ord, title FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(regexp_replace(title, '[ \\t\\n\\r]+', ' ', 'g'))) ORDER BY ord) AS k FROM a) WHERE k = 1")
def first_by_title(spark, d):
    return dedup.first_by(articles(spark, d), dedup.title_key(F.col("title")), [F.col("ord")]).select("ord", "title")


@query("SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY sha256(text)", over="")
def exact_text_duplicates(spark, d):
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).drop("h")


@query("""+ f AS (SELECT *, lower(trim(regexp_replace(title, '[ \\t\\n\\r]+', ' ', 'g'))) AS k,
  CASE WHEN NOT coalesce(is_ai_relevant, true) THEN 'not_ai_relevant' WHEN is_old_news THEN 'stale' WHEN total_score < 20 THEN 'weak' END AS rule FROM a
), g AS (SELECT *, coalesce(max(CASE WHEN rule IS NULL AND k <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AND k <> '' AS twin FROM f
), h AS (SELECT *, CASE WHEN twin THEN 'duplicate_title' ELSE rule END AS reason FROM g
), m AS (SELECT greatest(0, (SELECT count(*) FROM h) * 9 // 10 - (SELECT count(*) FROM h WHERE reason IS NULL)) AS missing
), s AS (SELECT ord, row_number() OVER (ORDER BY total_score DESC, ord) AS p FROM h WHERE reason IN ('stale', 'weak'))
SELECT h.ord, s.p IS NOT NULL AND s.p <= missing AS rescued, CASE WHEN s.p IS NOT NULL AND s.p <= missing THEN NULL ELSE reason END AS filter_reason FROM h CROSS JOIN m LEFT JOIN s USING (ord)""")
def early_rule_filter(spark, d):
    rows = articles(spark, d)
    reason = F.when(text.is_false(F.col("is_ai_relevant")), "not_ai_relevant").when(F.col("is_old_news"), "stale").when(F.col("total_score") < 20, "weak")
    done = dedup.early_filter(rows, [F.col("ord")], F.col("title"), reason, best(), rows.count() * 9 // 10, ("not_ai_relevant",))
    return done.select("ord", "rescued", "filter_reason")


@query("""SELECT source, count(*) AS n, sum(CAST(stage AS BIGINT)) AS from_second FROM (
  SELECT source, stage, row_number() OVER (PARTITION BY url ORDER BY stage, ord) AS k FROM (
    SELECT source, url, ord, 0 AS stage FROM a WHERE total_score >= 50 UNION ALL SELECT source, url, ord, 1 AS stage FROM a)
) WHERE k = 1 GROUP BY source""")
def merge_processed(spark, d):
    rows = articles(spark, d).select("source", "url", "ord", "total_score")
    merged = dedup.merge_stages(rows.filter("total_score >= 50").withColumn("stage", F.lit(0)), rows.withColumn("stage", F.lit(1)), "url", [F.col("ord")])
    return merged.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("stage").cast("long")).alias("from_second"))


# --- scoring -------------------------------------------------------------------------------------------------------

@query("""SELECT ord, c1 + CASE WHEN k > 0 AND o1 < k THEN 1 ELSE 0 END AS c1, c2 + CASE WHEN o2 < k THEN 1 ELSE 0 END AS c2, c3 + CASE WHEN o3 < k THEN 1 ELSE 0 END AS c3 FROM (
  SELECT *, CAST(r2 > r1 AS INT) + CAST(r3 > r1 AS INT) AS o1, CAST(r1 >= r2 AS INT) + CAST(r3 > r2 AS INT) AS o2, CAST(r1 >= r3 AS INT) + CAST(r2 >= r3 AS INT) AS o3, s - c1 - c2 - c3 AS k FROM (
    SELECT ord, s, s * 33 // 100 AS c1, s * 33 // 100 AS c2, s * 34 // 100 AS c3, s * 33 % 100 AS r1, s * 33 % 100 AS r2, s * 34 % 100 AS r3 FROM (SELECT ord, least(100, greatest(0, total_score)) AS s FROM a)))""")
def component_scores(spark, d):
    c1, c2, c3 = scoring.split_components(F.col("total_score"))
    return articles(spark, d).select("ord", c1.alias("c1"), c2.alias("c2"), c3.alias("c3"))


@query("""SELECT event_id, user_id, delta, after, after - delta AS before, greatest(0, least(100, after)) AS shown FROM (
  SELECT *, CAST(sum(delta) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS after FROM (SELECT event_id, user_id, ts, event_id % 21 - 10 AS delta FROM events))""", over="")
def ledger_running_total(spark, d):
    entries = table(spark, d, "events").select("event_id", "user_id", "ts", (F.col("event_id") % 21 - 10).alias("delta"))
    return scoring.running_ledger(entries, "user_id", [F.col("ts"), F.col("event_id")], "delta").drop("ts")


# --- ranking -------------------------------------------------------------------------------------------------------


@query("""SELECT ord, primary_type, total_score, CAST(row_number() OVER (ORDER BY g, total_score DESC, ord) AS INTEGER) AS place FROM (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY primary_type ORDER BY total_score DESC, ord) > 1 THEN 1 ELSE 0 END AS g FROM a) ORDER BY place LIMIT 25""")
def diverse_topk(spark, d):
    return ranking.diverse_top(articles(spark, d), "primary_type", best(), 25).select("ord", "primary_type", "total_score", "place")


@query("SELECT ord, primary_type, total_score, k AS place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY primary_type ORDER BY total_score DESC, ord) AS INTEGER) AS k FROM a) WHERE k <= 3")
def per_lane_topk(spark, d):
    return ranking.top_per_group(articles(spark, d), ["primary_type"], best(), 3).select("ord", "primary_type", "total_score", "place")


@query("""+ n AS (SELECT count(*) FILTER (WHERE source_kind <> 'github') AS nm, count(*) FILTER (WHERE source_kind = 'github') AS ng FROM a
), q AS (SELECT least(nm, greatest(1, CASE WHEN ng = 0 THEN 25 ELSE 17 END)) AS mq, ng, nm FROM n
), m AS (SELECT ord, row_number() OVER (ORDER BY g, total_score DESC, ord) AS p FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY primary_type ORDER BY total_score DESC, ord) > 1 THEN 1 ELSE 0 END AS g FROM a WHERE source_kind <> 'github')
), s AS (SELECT ord, row_number() OVER (ORDER BY total_score DESC, ord) AS p FROM a WHERE source_kind = 'github'
), c AS (SELECT ord FROM m, q WHERE p <= mq UNION ALL SELECT ord FROM s, q WHERE p <= least(ng, 25 - mq)
), r AS (SELECT ord, row_number() OVER (ORDER BY total_score DESC, ord) AS p FROM a WHERE ord NOT IN (SELECT ord FROM c)
), e AS (SELECT ord FROM c UNION ALL SELECT ord FROM r WHERE p <= 25 - (SELECT count(*) FROM c))
SELECT source_kind, count(*) AS n, count(*) FILTER (WHERE ord IN (SELECT ord FROM e)) AS selected FROM a GROUP BY 1""")
def quota_candidates(spark, d):
    rows = articles(spark, d).select("ord", "source_kind", "primary_type", "total_score")
    split = ranking.quota_split(rows, F.col("source_kind") == "github", "primary_type", best(), 25)
    return split.groupBy("source_kind").agg(F.count("*").alias("n"), F.count(F.when(F.col("selected"), 1)).alias("selected"))


@query("SELECT count(*) AS n, CAST(CASE WHEN count(*) > 5 THEN list_sort(list(total_score))[CAST(floor(count(*) * 0.7::DOUBLE) AS INTEGER) + 1] ELSE 55 END AS BIGINT) AS cutoff FROM a")
def score_cutoff(spark, d):
    return ranking.score_cutoff(articles(spark, d), "total_score")


@query("""+ n AS (SELECT CAST(floor(count(*) * 0.3::DOUBLE / (1 - 0.3::DOUBLE)) AS BIGINT) AS most FROM a WHERE source_kind <> 'github'
), k AS (SELECT ord, total_score, source_kind FROM a WHERE source_kind <> 'github' UNION ALL SELECT ord, total_score, source_kind FROM (SELECT *, row_number() OVER (ORDER BY total_score DESC, ord) AS p FROM a WHERE source_kind = 'github'), n WHERE p <= most)
SELECT source_kind, count(*) AS n, CAST(sum(total_score) AS BIGINT) AS points FROM k GROUP BY 1""")
def github_share_cap(spark, d):
    kept = ranking.cap_share(articles(spark, d).select("ord", "source_kind", "total_score"), F.col("source_kind") == "github", best())
    return kept.groupBy("source_kind").agg(F.count("*").alias("n"), F.sum("total_score").alias("points"))


# --- events --------------------------------------------------------------------------------------------------------


@query("""+ t AS (SELECT ord, list_sort(list_distinct(list_filter(regexp_extract_all(k, '[a-z0-9]+'), lambda w: length(w) >= 3 AND w NOT IN $STOPWORDS))) AS w, trim(regexp_replace(k, '[^a-z0-9]+', ' ', 'g')) AS s
  FROM (SELECT ord, regexp_replace(strip_accents(lower(replace(title, 'ß', ''))), '[^\\x00-\\x7F]', '', 'g') AS k FROM a)
), g AS (SELECT *, min(ord) OVER (PARTITION BY w, s) AS c FROM t WHERE len(w) > 0), f AS (SELECT * FROM g WHERE ord = c
), p AS (SELECT x.ord AS a, y.ord AS b, len(list_intersect(x.w, y.w)) AS i, len(x.w) AS m, len(y.w) AS n, x.s AS u, y.s AS v FROM f x JOIN f y ON x.ord < y.ord)
SELECT a, b, 'alike' AS kind FROM p WHERE i >= 0.6 * (m + n - i) OR (i >= 3 AND i >= 0.4 * (m + n - i)) OR (i = least(m, n) AND i >= 3) OR (length(u) >= 18 AND length(v) >= 18 AND (CASE WHEN length(u) <= length(v) THEN contains(v, u) ELSE contains(u, v) END))
UNION ALL SELECT c, ord, 'copy' FROM g WHERE ord <> c""")
def event_pair_similarity(spark, d):
    classes = stored(events.title_classes(articles(spark, d)), "classes")
    copies = classes.filter("id <> class_id").select(F.col("class_id").alias("a"), F.col("id").alias("b"), F.lit("copy").alias("kind"))
    return events.class_pairs(classes).withColumn("kind", F.lit("alike")).unionByName(copies)


#: Greedy first-fit clusters over all rows: rows are taken in order and a list of leaders is carried along.
CLUSTERS_SQL = """t AS (SELECT *, list_sort(list_distinct(list_filter(regexp_extract_all(k, '[a-z0-9]+'), lambda w: length(w) >= 3 AND w NOT IN $STOPWORDS))) AS w, trim(regexp_replace(k, '[^a-z0-9]+', ' ', 'g')) AS s, row_number() OVER (ORDER BY total_score DESC, ord) AS p
  FROM (SELECT *, regexp_replace(strip_accents(lower(replace(title, 'ß', ''))), '[^\\x00-\\x7F]', '', 'g') AS k FROM a)
), q AS (SELECT x.p AS pe, y.p AS pl, len(list_intersect(x.w, y.w)) AS i, len(x.w) AS m, len(y.w) AS n, x.s AS u, y.s AS v FROM t x JOIN t y ON x.p < y.p WHERE len(x.w) > 0 AND len(y.w) > 0
), h AS (SELECT pl, list(pe) AS l FROM q WHERE i >= 0.6 * (m + n - i) OR (i >= 3 AND i >= 0.4 * (m + n - i)) OR (i = least(m, n) AND i >= 3) OR (length(u) >= 18 AND length(v) >= 18 AND (CASE WHEN length(u) <= length(v) THEN contains(v, u) ELSE contains(u, v) END)) GROUP BY 1
), nb AS MATERIALIZED (SELECT t.p, t.ord, coalesce(l, []) AS l FROM t LEFT JOIN h ON h.pl = t.p
), rc(k, ld) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT rc.k + 1, CASE WHEN len(list_intersect(rc.ld, nb.l)) > 0 THEN rc.ld ELSE list_append(rc.ld, rc.k + 1) END FROM rc JOIN nb ON nb.p = rc.k + 1
), fin AS (SELECT ld FROM rc ORDER BY k DESC LIMIT 1
), ec AS (SELECT nb.ord, coalesce(list_min(list_intersect(nb.l, fin.ld)), nb.p) AS lp FROM nb, fin
), ev AS (SELECT ec.ord, t.ord AS leader_id FROM ec JOIN t ON t.p = ec.lp)"""


@query(f"+ {CLUSTERS_SQL} SELECT ord, leader_id FROM ev")
def event_clusters(spark, d):
    rows = articles(spark, d)
    return events.event_clusters(rows, None, ascending())


# --- history -------------------------------------------------------------------------------------------------------

HISTORY_SQL = """h AS (
  SELECT CAST(user_id AS VARCHAR) AS source_key, count(DISTINCT CAST(ts AS DATE)) AS runs_seen, count(*) AS raw_articles, count(*) FILTER (WHERE event_type <> 'error') AS scored_articles,
    count(*) FILTER (WHERE event_type = 'purchase' AND value > 50) AS selected_main, count(*) FILTER (WHERE event_type = 'signup' AND value > 80) AS selected_github, 0 AS selected_facebook,
    count(*) FILTER (WHERE event_type = 'error') AS skipped_old, count(*) FILTER (WHERE event_type = 'view' AND value < 10) AS skipped_speculation, 0 AS skipped_promo, count(*) FILTER (WHERE event_type = 'click' AND value < 20) AS skipped_weak
  FROM events GROUP BY user_id
), i AS (SELECT *, selected_main + selected_github + selected_facebook AS st, skipped_old + skipped_speculation + skipped_promo + skipped_weak AS nt FROM h
), j AS (SELECT *, st / greatest(1, scored_articles) AS sr, nt / greatest(1, raw_articles) AS nr FROM i
), k AS (SELECT *, CAST(CASE WHEN runs_seen <= 1 THEN 50 ELSE greatest(0, least(100, 50 + least(20, floor(sr * 45)) + least(22, selected_main * 7 + selected_github * 4) - least(28, floor(nr * 55)) - least(18, skipped_old * 2 + skipped_speculation * 3))) END AS INTEGER) AS q FROM j
), s AS (SELECT *, CASE WHEN runs_seen < 3 THEN 'neutral' WHEN q >= 72 AND st >= 2 THEN 'trusted' WHEN q >= 62 AND sr >= 0.25 THEN 'positive' WHEN q <= 20 THEN 'muted' WHEN q <= 35 OR (q <= 45 AND nr >= 0.35) THEN 'watch' ELSE 'neutral' END AS status FROM k
), z AS (SELECT *, CASE status WHEN 'trusted' THEN 4 WHEN 'positive' THEN 2 ELSE 0 END AS bonus, CASE WHEN status = 'muted' THEN 14 WHEN status = 'watch' AND q <= 35 THEN 8 WHEN status = 'watch' THEN 4 ELSE 0 END AS penalty FROM s)"""


def history_of_events(spark, d, key=None, kept=None) -> DataFrame:
    """Events as outcomes of sources: by default each user is a source."""
    n = lambda test: F.count(F.when(test, 1))
    kind, value = F.col("event_type"), F.col("value")
    events_ = table(spark, d, "events")
    events_ = events_ if kept is None else events_.filter(kept)
    return events_.groupBy((F.col("user_id").cast("string") if key is None else key).alias("source_key")).agg(
        F.count_distinct(F.col("ts").cast("date")).alias("runs_seen"), F.count("*").alias("raw_articles"), n(kind != "error").alias("scored_articles"),
        n((kind == "purchase") & (value > 50)).alias("selected_main"), n((kind == "signup") & (value > 80)).alias("selected_github"), F.lit(0).alias("selected_facebook"),
        n(kind == "error").alias("skipped_old"), n((kind == "view") & (value < 10)).alias("skipped_speculation"), F.lit(0).alias("skipped_promo"), n((kind == "click") & (value < 20)).alias("skipped_weak"),
    )


@query(f"WITH {HISTORY_SQL} SELECT source_key, runs_seen, raw_articles, scored_articles, st AS selection_total, nt AS noise_total, sr AS selection_rate, nr AS noise_rate, q AS quality_score, bonus, penalty, status FROM z", over="")
def source_history_rollup(spark, d):
    return history.with_quality(history_of_events(spark, d)).select("source_key", "runs_seen", "raw_articles", "scored_articles", "selection_total", "noise_total", "selection_rate", "noise_rate", "quality_score", "bonus", "penalty", "status")


@query(f"""WITH {HISTORY_SQL} SELECT * FROM (SELECT 'leader' AS board, CAST(row_number() OVER (ORDER BY q DESC, runs_seen DESC, sr DESC, source_key) AS INTEGER) AS place, source_key, q AS quality_score, penalty FROM z) WHERE place <= 12
UNION ALL SELECT * FROM (SELECT 'risky' AS board, CAST(row_number() OVER (ORDER BY penalty DESC, nt DESC, q, source_key) AS INTEGER) AS place, source_key, q AS quality_score, penalty FROM z WHERE penalty > 0 OR nt > 0) WHERE place <= 12""", over="")
def source_leaders_risky(spark, d):
    return history.leaders_and_risky(history.with_quality(history_of_events(spark, d)))


@query(f"""WITH {HISTORY_SQL} SELECT source_key, 2 * runs_seen AS runs_seen, 2 * raw_articles AS raw_articles, 2 * skipped_old AS skipped_old, '2024-01-31' AS last_selected_at FROM h""", over="")
def source_history_merge(spark, d):
    once = history_of_events(spark, d)
    merged = history.merge_history(once.withColumn("last_selected_at", F.lit("2024-01-31")), once.withColumn("last_selected_at", F.lit("")))
    return merged.select("source_key", "runs_seen", "raw_articles", "skipped_old", "last_selected_at")


@query("""SELECT event_id, user_id FROM (SELECT * FROM (SELECT * FROM events ORDER BY ts DESC, event_id LIMIT 240) WHERE ts >= TIMESTAMP '2024-01-28 00:00:00' ORDER BY ts DESC, event_id LIMIT 80)""", over="")
def history_window(spark, d):
    recent = history.recent_history(table(spark, d, "events"), "ts", F.lit("2024-01-28 00:00:00").cast("timestamp_ntz"), 80, "event_id")
    return recent.select("event_id", "user_id")


def history_layout(spark, d) -> DataFrame:
    """Events as outcomes of sources, a row a source and day, in a bucketed table by day."""
    path = shared_folder(spark, "history")
    name = "history_" + path.rpartition("-")[2]
    days = history_of_events(spark, d, F.struct(F.col("user_id").cast("string").alias("s"), F.col("ts").cast("date").alias("d")))
    history_table.open_history(spark, name, path)
    history_table.write_days(days.select(F.col("source_key.s").alias("source_key"), F.col("source_key.d").alias("day"), *[c for c in days.columns if c != "source_key"], F.lit("").alias("last_selected_at")), name)
    return spark.table(name)


@query("""WITH r AS (SELECT DISTINCT CAST(ts AS DATE) AS run_day FROM events WHERE dayofweek(CAST(ts AS DATE)) = 0)
SELECT run_day, CAST(user_id AS VARCHAR) AS source_key, count(DISTINCT CAST(ts AS DATE)) AS runs_seen, count(*) AS raw_articles, count(*) FILTER (event_type = 'error') AS skipped_old
FROM r JOIN events ON CAST(ts AS DATE) BETWEEN run_day - 2 AND run_day GROUP BY ALL""", over="")
def history_lookback(spark, d):
    """Each Sunday's run looks back on three days."""
    runs = table(spark, d, "events").select(F.col("ts").cast("date").alias("run_day")).filter(F.dayofweek("run_day") == 1)
    return history_table.lookback(history_layout(spark, d), runs, 3).select("run_day", "source_key", "runs_seen", "raw_articles", "skipped_old")


@query("""SELECT c_custkey, n AS raw_articles, e AS skipped_old FROM customer LEFT JOIN (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS e FROM events
WHERE CAST(ts AS DATE) >= DATE '2024-01-18' GROUP BY 1) ON user_id = c_custkey""", over="")
def history_of_customers(spark, d):
    """Customers with what the sources of their number did from a day on."""
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("k"))
    joined = history_table.with_past(rows, history_layout(spark, d), "k", F.lit("2024-01-18").cast("date"))
    return joined.select("c_custkey", "past.raw_articles", "past.skipped_old")


@query("SELECT c_custkey AS user_id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)", over="")
def insert_if_new(spark, d):
    return history.insert_new(table(spark, d, "events").select("user_id"), table(spark, d, "customer").select(F.col("c_custkey").alias("user_id")), "user_id")


# --- feedback, watchlists, reports ---------------------------------------------------------------------------------

#: Marked messages, which stand for every second user message or before every fourth.
MESSAGES = ("@bot cũ", "@bot nguồn yếu", "#feedback: không liên quan", "phản hồi: đáng đọc", "Feedback - đào sâu hơn", "@Bot ưu tiên founder", "@bot không nên lên brief", "khong nen len brief", "@bot sai loại business", "sai loai: research or product", "@bot  sai loại practical", "nguon yeu")


def _holds(words) -> str:
    return " OR ".join(f"contains(t, '{w}')" for w in words)


CASES_SQL = ", ".join(
    [
        "CASE t " + " ".join(f"WHEN '{c}' THEN '{label}'" for c, label in FEEDBACK_COMMANDS.items()) + " END",
        f"CASE WHEN {_holds(WRONG_TYPE)} THEN 'wrong_type' END",
        f"CASE WHEN {_holds(WRONG_TYPE)} THEN CASE " + " ".join(f"WHEN contains(t, '{x}') THEN 'expected_type:{x}'" for x in EXPECTED_TYPES) + " END END",
        *[f"CASE WHEN {_holds(phrases)} THEN '{label}' END" for label, phrases in FEEDBACK_PHRASES.items()],
    ]
)
LABELS_SQL = f"""m AS (SELECT conv_id, turn, coalesce(text, '') AS text, [{", ".join(f"'{m}'" for m in MESSAGES)}][CAST((coalesce(conv_id, 0) + coalesce(turn, 0)) % {len(MESSAGES)} AS INT) + 1] AS told, (coalesce(conv_id, 0) + 3 * coalesce(turn, 0)) % 4 AS k FROM conversations WHERE role = 'user'
), c AS (SELECT conv_id, turn, CASE WHEN k IN (0, 2) THEN told WHEN k = 1 THEN told || ' ' || text ELSE text END AS t FROM m
), c1 AS (SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(t, '^\\s+|\\s+$', '', 'g'), '(?i)@bot\\b', '', 'g'), '^\\s+|\\s+$', '', 'g') AS t FROM c
), c2 AS (SELECT conv_id, turn, lower(trim(regexp_replace(regexp_replace(regexp_replace(t, '(?i)#feedback\\b', '', 'g'), '(?i)^(feedback|phan hoi|phản hồi)\\s*[:-]?\\s*', ''), '\\s+', ' ', 'g'), ' :-')) AS t FROM c1
), l AS (SELECT conv_id, turn, list_sort(list_distinct([{CASES_SQL}])) AS l FROM c2), ls AS (SELECT conv_id, turn, CASE WHEN len(l) = 0 THEN ['general_feedback'] ELSE l END AS l FROM l)"""


def marked_messages(spark, d) -> DataFrame:
    """User messages, some with a command in their place or before them, and their labels."""
    key, turn, said = F.coalesce("conv_id", F.lit(0)), F.coalesce("turn", F.lit(0)), F.coalesce("text", F.lit(""))
    told = F.element_at(F.array(*[F.lit(m) for m in MESSAGES]), ((key + turn) % len(MESSAGES) + 1).cast("int"))
    k = (key + 3 * turn) % 4
    words = F.when(k.isin(0, 2), told).when(k == 1, F.concat(told, F.lit(" "), said)).otherwise(said)
    return table(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", reports.feedback_labels(words, "bot").alias("labels"))


@query(f"WITH {LABELS_SQL} SELECT conv_id, turn, array_to_string(l, ',') AS labels FROM ls", over="")
def feedback_labels(spark, d):
    return marked_messages(spark, d).withColumn("labels", F.array_join(F.array_sort("labels"), ","))


@query(f"""WITH {LABELS_SQL} SELECT *, weak_source >= 2 AS strict_source_review, stale >= 1 AS prefer_freshness, want_more_depth >= 1 AS prefer_depth, founder_lens >= 1 AS prefer_founder_angle,
CASE WHEN promote_delivery > skip_delivery THEN 'promote' WHEN skip_delivery > promote_delivery THEN 'suppress' ELSE 'neutral' END AS delivery_bias,
coalesce(replace((SELECT string_agg(y, ',' ORDER BY n DESC, y) FROM (SELECT y, count(*) AS n FROM (SELECT unnest(l) AS y FROM ls) WHERE y LIKE 'expected_type:%' GROUP BY y ORDER BY n DESC, y LIMIT 3)), 'expected_type:', ''), '') AS preferred_types
FROM (SELECT {", ".join(f"count(*) FILTER (WHERE list_contains(l, '{label}')) AS {label}" for label in [*FEEDBACK_PHRASES, "wrong_type", "general_feedback"])} FROM ls)""", over="")
def feedback_profile(spark, d):
    return reports.feedback_profile(marked_messages(spark, d), "labels").withColumn("preferred_types", F.array_join("preferred_types", ","))


TERMS = [("companies", "OpenAI"), ("companies", "Nvidia"), ("products", "album review"), ("tools", "self-hosted deployment guide"), ("policy", "export controls"), ("topics", "enterprise agents"), ("topics", "clinic scheduling"), ("topics", "OpenAI"), ("topics", " ")]


@query(f"""+ {HEADLINED_SQL}, t(kind, term, ws) AS (VALUES ('companies', 'OpenAI', ['openai']), ('companies', 'Nvidia', ['nvidia']), ('products', 'album review', ['album', 'review']), ('tools', 'self-hosted deployment guide', ['self', 'hosted', 'deployment', 'guide']), ('policy', 'export controls', ['export', 'controls']), ('topics', 'enterprise agents', ['enterprise', 'agents']), ('topics', 'clinic scheduling', ['clinic', 'scheduling']), ('topics', 'OpenAI', ['openai'])
), x AS (SELECT ord, total_score, lower(concat_ws(' ', title, content, github_owner || '/kit', source_domain)) AS w FROM hl
), m AS (SELECT kind, term, ord, total_score FROM x JOIN t ON contains(w, lower(term)) OR len(list_filter(ws, lambda z: contains(w, z))) >= least(2, len(ws))
), p AS (SELECT *, CAST(row_number() OVER (PARTITION BY kind, term ORDER BY total_score DESC, ord) AS INTEGER) AS place, count(*) OVER (PARTITION BY kind, term) AS n_signals, max(total_score) OVER (PARTITION BY kind, term) AS max_score FROM m)
SELECT kind, term, ord, place, n_signals, max_score FROM p WHERE place <= 5""")
def watchlist_match(spark, d):
    """Watchlist terms by kind over whole texts: the five best rows of each, and how many there are."""
    terms = spark.createDataFrame(TERMS, "kind string, term string")
    whole = F.concat_ws(" ", "title", "content", "github_full_name", "source_domain")
    rows = headlined(spark, d)
    matched = reports.watchlist_matches(rows.select("ord", "total_score", "title", "content", "github_full_name", "source_domain"), terms, whole, best())
    return matched.select("kind", "term", "ord", "place", "n_signals", "max_score")


@query(f"""+ {HEADLINED_SQL}, t(kind, grp, k, place, term, ws) AS (VALUES ('companies', 'Company', 0, 0, 'OpenAI', ['openai']), ('companies', 'Company', 0, 1, 'Nvidia', ['nvidia']), ('products', 'Product', 1, 2, 'album review', ['album', 'review']), ('tools', 'Tool', 2, 3, 'self-hosted deployment guide', ['self', 'hosted', 'deployment', 'guide']), ('policy', 'Policy', 3, 4, 'export controls', ['export', 'controls']), ('topics', 'Topic', 4, 5, 'enterprise agents', ['enterprise', 'agents']), ('topics', 'Topic', 4, 6, 'clinic scheduling', ['clinic', 'scheduling']), ('topics', 'Topic', 4, 7, 'OpenAI', ['openai'])
), x AS (SELECT ord, total_score, primary_type, source_domain, lower(concat_ws(' ', title, content, github_owner || '/kit', source_domain)) AS w FROM hl
), m AS (SELECT * EXCLUDE (w, ws) FROM x JOIN t ON contains(w, lower(term)) OR len(list_filter(ws, lambda z: contains(w, z))) >= least(2, len(ws))
), p AS (SELECT *, row_number() OVER (PARTITION BY kind, term ORDER BY total_score DESC, ord) AS r, count(*) OVER (PARTITION BY kind, term) AS n_signals FROM m
), n AS (SELECT kind, term, string_agg(primary_type || '=' || c, ', ' ORDER BY primary_type) AS lanes FROM (SELECT kind, term, primary_type, count(*) AS c FROM p WHERE r <= 5 GROUP BY ALL) GROUP BY ALL
), h AS (SELECT kind, term, string_agg(source_domain, ', ' ORDER BY source_domain) AS hosts FROM (SELECT DISTINCT kind, term, source_domain FROM p WHERE r <= 5) GROUP BY ALL
), g AS (SELECT kind, grp, k, place, term, count(*) AS signal_count, max(n_signals) AS n_signals, max(total_score) AS max_score, string_agg(CAST(ord AS VARCHAR), ',' ORDER BY r) AS articles FROM p WHERE r <= 5 GROUP BY ALL)
SELECT CAST(row_number() OVER (ORDER BY signal_count DESC, max_score DESC, k, place, term) AS INT) AS page, grp AS topic_group, term AS topic, lower(replace(term, ' ', '-')) AS topic_slug, signal_count, n_signals, max_score, lanes, hosts, articles FROM g JOIN n USING (kind, term) JOIN h USING (kind, term) QUALIFY page <= 12""")
def watchlist_pages(spark, d):
    """Topic pages of the watchlist over whole texts."""
    terms = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(TERMS)], "kind string, term string, place int")
    whole = F.concat_ws(" ", "title", "content", "github_full_name", "source_domain")
    rows = headlined(spark, d).select("ord", "total_score", "primary_type", "title", "content", "github_full_name", "source_domain")
    pages = reports.topic_pages(rows, terms, whole, best())
    lanes = F.transform(F.array_sort(F.map_entries("lanes")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    ids = F.transform("articles", lambda a: a["id"].cast("string"))
    return pages.withColumn("lanes", F.array_join(lanes, ", ")).withColumn("hosts", F.array_join("hosts", ", ")).withColumn("articles", F.array_join(ids, ","))


@query("""SELECT primary_type, source_domain, n, max_score, CAST(row_number() OVER (PARTITION BY primary_type ORDER BY n DESC, max_score DESC, source_domain) AS INTEGER) AS place
FROM (SELECT primary_type, source_domain, count(*) AS n, max(total_score) AS max_score FROM a GROUP BY 1, 2) QUALIFY place <= 12""")
def topic_pages(spark, d):
    groups = articles(spark, d).groupBy("primary_type", "source_domain").agg(F.count("*").alias("n"), F.max("total_score").alias("max_score"))
    return ranking.top_per_group(groups, ["primary_type"], [F.col("n").desc(), F.col("max_score").desc(), F.col("source_domain")], 12)


@query("""SELECT w AS token, count(*) AS n FROM (SELECT unnest(list_distinct(list_filter(regexp_extract_all(regexp_replace(strip_accents(lower(replace(title, 'ß', ''))), '[^\\x00-\\x7F]', '', 'g'), '[a-z0-9]+'), lambda x: length(x) >= 4 AND x NOT IN $STOPWORDS))) AS w FROM a) GROUP BY 1 ORDER BY n DESC, token LIMIT 5""")
def weekly_themes(spark, d):
    return reports.themes(articles(spark, d), "title")


@query("SELECT CASE WHEN trim(coalesce(lang, '')) = '' THEN 'unknown' ELSE trim(lang) END AS name, count(*) AS n FROM a GROUP BY 1 ORDER BY n DESC, name LIMIT 12")
def count_by_language(spark, d):
    return reports.count_by(articles(spark, d), F.col("lang"))


@query("SELECT tag, count(*) AS n FROM (SELECT unnest([source_kind, freshness_bucket, source_tier]) AS tag FROM a) GROUP BY 1 ORDER BY n DESC, tag LIMIT 20")
def tag_counts(spark, d):
    return reports.tag_counts(articles(spark, d).withColumn("tags", F.array("source_kind", "freshness_bucket", "source_tier")), "tags")


@query("SELECT event_type AS stage, count(*) AS runs, sum(CAST(floor(value) AS BIGINT))::BIGINT AS total, max(CAST(floor(value) AS BIGINT)) AS longest, min(CAST(floor(value) AS BIGINT)) AS shortest FROM events GROUP BY 1", over="")
def stage_metrics(spark, d):
    return reports.stage_timings(table(spark, d, "events").withColumn("ms", F.floor("value")), "event_type", "ms")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS v FROM events", over="")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.k").try_cast("int").alias("v"))


@query("""SELECT page_id, concat_ws(',', CASE WHEN NOT starts_with(trim(t), '<b>') THEN 'missing_or_wrong_header' END, CASE WHEN regexp_matches(t, '\\[[^\\]]+\\]\\(https?://[^)]+\\)') THEN 'markdown_links_present' END,
  CASE WHEN contains(lower(t), '<br') THEN 'br_tag_present' END, CASE WHEN length(t) > 4096 THEN 'message_too_long' END, CASE WHEN contains(t, chr(10) || '---') OR starts_with(trim(t), '---') THEN 'separator_style_present' END,
  CASE WHEN (length(t) - length(replace(t, '<b>', ''))) / 3 <> (length(t) - length(replace(t, '</b>', ''))) / 4 THEN 'unbalanced_bold_tags' END,
  CASE WHEN (length(t) - length(replace(t, '<a href=', ''))) / 8 <> (length(t) - length(replace(t, '</a>', ''))) / 4 THEN 'unbalanced_anchor_tags' END) AS warnings FROM (SELECT page_id, coalesce(html, '') AS t FROM pages)""", over="")
def validation_warnings(spark, d):
    pages = table(spark, d, "pages").select("page_id", "html")
    tests = reports.message_warnings(F.col("html"))
    return pages.select("page_id", tests.alias("warnings"))


@query("""SELECT o_orderkey, place, CASE WHEN o_totalprice > 300000 OR (place <= 5 AND age <= 2000) THEN 'keep' ELSE 'move' END AS action FROM (
  SELECT o_orderkey, o_totalprice, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS INTEGER) AS place, date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') AS age FROM orders)""", over="")
def retention_plan(spark, d):
    age = F.datediff(F.lit("2000-01-01").cast("date"), F.col("o_orderdate").cast("date"))
    plan = reports.retention_plan(table(spark, d, "orders"), "o_custkey", age, [F.col("o_orderdate").desc(), F.col("o_orderkey")], 5, 2000, F.col("o_totalprice") > 300000)
    return plan.select("o_orderkey", "place", "action")


# --- memo ------------------------------------------------------------------------------------------------------------


@query("""SELECT section, place, ord, title, total_score FROM (
  SELECT 'overall' AS section, CAST(row_number() OVER (ORDER BY total_score DESC, ord) AS INTEGER) AS place, ord, title, total_score FROM a QUALIFY place <= 6
  UNION ALL SELECT primary_type AS section, CAST(row_number() OVER (PARTITION BY primary_type ORDER BY total_score DESC, ord) AS INTEGER) AS place, ord, title, total_score FROM a QUALIFY place <= 3)""")
def weekly_memo(spark, d):
    rows = articles(spark, d).select("ord", "title", "total_score", "primary_type")
    return reports.lane_memo(rows, "primary_type", best()).select("section", "place", "ord", "title", "total_score")


# --- vectors -------------------------------------------------------------------------------------------------------

DISTANCE_SQL = """u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
), p AS (SELECT x.vec_id AS query_id, y.vec_id AS id, round(1 - list_dot_product(x.v, y.v), 4) AS distance FROM u x JOIN u y ON x.vec_id <> y.vec_id WHERE x.vec_id % 50 = 0
), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS place FROM p)"""


#: Cells of the index.
INDEX_CELLS = 16


@query(f"WITH {DISTANCE_SQL} SELECT query_id, place, id, distance FROM k WHERE place <= 5", over="")
def recall_topk(spark, d):
    items = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return recall.recall(items.filter("id % 50 = 0"), items, 5).select("query_id", "place", "id", "distance")


#: Past items: all items, and of each asked one a copy with some components negated, by which distances lie on both sides of the threshold.
RELATED_SQL = """i AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), c AS (SELECT * FROM i UNION ALL SELECT vec_id + 1000000000, list_transform(v, lambda x, n: CASE WHEN n <= vec_id // 50 % 20 + 1 THEN -x ELSE x END) FROM i WHERE vec_id % 50 = 0
), u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM c
), p AS (SELECT x.vec_id AS query_id, y.vec_id AS id, round(1 - list_dot_product(x.v, y.v), 4) AS distance FROM u x JOIN u y ON x.vec_id <> y.vec_id WHERE x.vec_id % 50 = 0 AND x.vec_id < 1000000000
), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS place FROM p)"""


@query(f"WITH {RELATED_SQL} SELECT query_id, place, id, distance FROM k WHERE place <= 3 AND distance < 0.3", over="")
def related_past(spark, d):
    items = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    asked = items.filter("id % 50 = 0")
    negated = F.transform("vector", lambda x, n: F.when(n < F.floor(F.col("id") / 50) % 20 + 1, -x).otherwise(x))
    past = items.unionByName(asked.select((F.col("id") + 1_000_000_000).alias("id"), negated.alias("vector")))
    return recall.recall(asked, past, 3, 0.3).select("query_id", "place", "id", "distance")


def _past_index(spark, d) -> tuple[DataFrame, str]:
    """All items and the index of them: half is built, the other half appended, then all is re-assigned."""
    items = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    path = shared_folder(spark, "index")
    vector_index.build(items.filter("id % 2 = 0"), path, INDEX_CELLS)
    vector_index.append(items.filter("id % 2 <> 0"), path, 1)
    vector_index.reassign(spark, path, INDEX_CELLS)
    return items, path


@query(f"WITH {RELATED_SQL} SELECT query_id, place, id, distance FROM k WHERE place <= 3 AND distance < 0.3", over="")
def related_past_indexed(spark, d):
    """The rows of related_past by the index: cells that cannot hold an item within 0.3 are not read; the copies are a batch of their own."""
    items, path = _past_index(spark, d)
    asked = items.filter("id % 50 = 0")
    negated = F.transform("vector", lambda x, n: F.when(n < F.floor(F.col("id") / 50) % 20 + 1, -x).otherwise(x))
    vector_index.append(asked.select((F.col("id") + 1_000_000_000).alias("id"), negated.alias("vector")), path, 1)
    return vector_index.search(asked, path, 3, max_distance=0.3).select("query_id", "place", "id", "distance")


@query()
def recall_indexed(spark, d):
    """Of each query's five exact neighbours, how many a search finds in as many cells as other rows need."""
    items, path = _past_index(spark, d)
    asked = items.filter("id % 50 = 0")
    return vector_index.measured(vector_index.search(asked, path, 5, vector_index.calibrate(spark, path, 5)), recall.recall(asked, items, 5))


# --- landed files --------------------------------------------------------------------------------------------------


@query("SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\v\\f\\r]+', ' ', 'g'), ' ') AS content FROM documents", over="")
def landed_blocks(spark, d):
    """Every document, written as a block of a social inbox and read by the data source."""
    path = shared_folder(spark, "inbox")
    flat = F.regexp_replace(F.coalesce("text", F.lit("")), "[ \\t\\n\\x0B\\f\\r]+", " ")
    block = F.concat(F.lit("platform: manual\nnote: "), "doc_id", F.lit("\ncontent: "), flat, F.lit("\n---"))
    table(spark, d, "documents").select(block.alias("value")).write.text(path)
    rows = landed.good(landed.read_landed(spark, path, "blocks"))
    return rows.select(F.col("fields")["note"].cast("long").alias("doc_id"), F.col("fields")["content"].alias("content"))


@query("SELECT doc_id % 7 = 3 AS broken, count(*) AS n, CAST(sum(CASE WHEN doc_id % 7 <> 3 THEN doc_id END) AS BIGINT) AS ids FROM documents GROUP BY 1", over="")
def landed_errors(spark, d):
    """Every document as a line of JSON, each seventh cut short: what is read and what is an error."""
    path = shared_folder(spark, "lines")
    line = F.to_json(F.struct("doc_id", "text"))
    cut = F.when(F.col("doc_id") % 7 == 3, F.expr("substring(line, 1, length(line) - 1)")).otherwise(F.col("line"))
    table(spark, d, "documents").select("doc_id", line.alias("line")).select(cut.alias("value")).write.text(path)
    rows = landed.read_landed(spark, path, "json").select(F.col("error").isNotNull().alias("broken"), F.get_json_object(F.col("fields")["json"], "$.doc_id").cast("long").alias("id"))
    return rows.groupBy("broken").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


# --- time windows (extensions) -------------------------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL '6 hours', ts) AS start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2", over="")
def tumbling_counts(spark, d):
    return windows.tumbling(table(spark, d, "events"), "ts", "6 hours", ["event_type"]).agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


@query("""SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '2 hours' THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""", over="")
def sessionised(spark, d):
    return windows.sessions(table(spark, d, "events"), "ts", "2 hours", ["user_id"]).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


# --- messages ------------------------------------------------------------------------------------------------------


@query("""SELECT doc_id, CAST(len(p) AS INTEGER) AS n, CAST(list_max(list_transform(p, lambda x: length(x))) AS INTEGER) AS longest FROM (
  SELECT doc_id, CASE WHEN len(x) = 0 THEN [] ELSE list_reduce(list_transform(x, lambda y: [y]), lambda a, b: CASE WHEN length(a[-1]) + length(b[1]) + 2 <= 4000 THEN list_append(list_slice(a, 1, len(a) - 1), a[-1] || chr(10) || chr(10) || b[1]) ELSE list_append(a, b[1]) END) END AS p FROM (
    SELECT doc_id, list_filter(string_split_regex(replace(coalesce(text, ''), chr(10), chr(10) || chr(10)), '\\n\\n+'), lambda y: y <> '') AS x FROM documents))""", over="")
def message_pieces(spark, d):
    """Long texts cut at blank lines into messages: per document, how many and the longest."""
    pieces = text.message_chunks(F.replace("text", F.lit("\n"), F.lit("\n\n")), 4000)
    rows = table(spark, d, "documents").select("doc_id", pieces.alias("p"))
    return rows.select("doc_id", F.size("p").alias("n"), F.array_max(F.transform("p", F.length)).alias("longest"))


@query("SELECT name, count(*) AS n FROM (SELECT CASE WHEN event_type = 'error' THEN 'stale' WHEN event_type = 'click' THEN 'weak_signal' WHEN event_type = 'view' THEN '' WHEN event_type = 'signup' THEN 'duplicate_event' ELSE 'weak_signal' END AS name FROM events) GROUP BY 1", over="")
def skip_reasons(spark, d):
    raw = F.when(F.col("event_type") == "error", "Old").when(F.col("event_type") == "click", " marketing ").when(F.col("event_type") == "view", "").when(F.col("event_type") == "signup", "duplicate").otherwise("strange")
    return table(spark, d, "events").groupBy(text.skip_reason(raw).alias("name")).agg(F.count("*").alias("n"))


# --- selection and model output ------------------------------------------------------------------------------------


@query("""SELECT event_id, CAST(40 + least(18, CAST(floor(log10(greatest(1, user_id * 37)) * 6) AS INTEGER)) + least(20, 3 * (event_id % 9)) + CASE WHEN event_type = 'purchase' THEN 10 ELSE 0 END + CASE WHEN event_id % 60 <= 3 THEN 14 WHEN event_id % 60 <= 14 THEN 8 WHEN event_id % 60 <= 45 THEN 3 ELSE 0 END AS BIGINT) AS rank FROM events""", over="")
def repository_rank(spark, d):
    from ..operators import selection

    rank = selection.repo_rank(F.col("user_id") * 37, F.col("event_id") % 9, F.col("event_type") == "purchase", F.col("event_id") % 60)
    return table(spark, d, "events").select("event_id", rank.cast("long").alias("rank"))


#: Raw tags as models give them, one added to each second row.
EXTRA_TAGS = ("GPU", "Open-Source", "M&A", "startups", "Việt Nam", "", "red_team")
_EXTRA_SQL = "[" + ", ".join(f"'{t}'" for t in EXTRA_TAGS) + f"][CAST(ord // 2 % {len(EXTRA_TAGS)} AS INT) + 1]"


def _tags_sql() -> str:
    """Tags by the same fixed values: names of raw tags by a list of pairs, words by boundaries, phrases as substrings."""
    quoted = lambda w: "'" + w.replace("'", "''") + "'"
    names = ", ".join(f"({quoted(n)}, {quoted(t)})" for n, t in tags.tag_by_name().items())
    tests = ", ".join(f"CASE WHEN {' OR '.join(f'contains(k, {quoted(w)})' if ' ' in w else f'regexp_matches(k, {quoted(chr(92) + 'b' + w + chr(92) + 'b')})' for w in words)} THEN {quoted(t)} END" for t, words in TAG_SIGNALS.items())
    defaults = " ".join(f"WHEN primary_type = {quoted(lane)} THEN {quoted(t)}" for lane, t in TAG_DEFAULTS.items())
    fold = lambda x: f"regexp_replace(strip_accents(lower(replace({x}, 'ß', ''))), '[^\\x00-\\x7F]', '', 'g')"
    one = lambda x: f"trim(regexp_replace({x}, '[ \\t\\n\\f\\r]+', ' ', 'g'))"
    return f"""+ {HEADLINED_SQL}, names(n, t) AS (VALUES {names}
), r AS (SELECT ord, primary_type, total_score, title, content, source, source_domain, CASE WHEN ord % 2 = 0 THEN list_append(tags, {_EXTRA_SQL}) ELSE [] END AS raw FROM hl
), n AS (SELECT ord, list(t ORDER BY i) AS named FROM (SELECT ord, {one(f"replace({fold('unnest(raw)')}, '_', ' ')")} AS n, generate_subscripts(raw, 1) AS i FROM r) JOIN names USING (n) GROUP BY ord
), f AS (SELECT ord, primary_type, total_score, {one(fold("concat_ws(' ', title, '', '', '', '', '', coalesce(content, ''), '', coalesce(source, ''), coalesce(source_domain, ''), array_to_string(raw, ' '))"))} AS k FROM r
), g AS (SELECT ord, primary_type, total_score, list_concat(coalesce(named, []), list_filter([{tests}], lambda x: x IS NOT NULL)) AS t FROM f LEFT JOIN n USING (ord)
), u AS (SELECT *, list_filter(t, lambda x, i: list_position(t, x) = i) AS u FROM g)
SELECT ord, array_to_string(CASE WHEN len(u) > 0 THEN u[1:3] WHEN total_score >= {DEFAULT_TAG_SCORE} THEN [CASE {defaults} END] ELSE [] END, ',') AS tags FROM u"""


@query(_tags_sql())
def article_tags(spark, d):
    """Taxonomy tags of every document with a headline, from raw tags and the whole text."""
    extra = F.element_at(F.array(*[F.lit(t) for t in EXTRA_TAGS]), (F.floor(F.col("ord") / 2) % len(EXTRA_TAGS) + 1).cast("int"))
    raw = F.when(F.col("ord") % 2 == 0, F.concat("tags", F.array(extra))).otherwise(F.array().cast("array<string>"))
    return tags.with_taxonomy_tags(headlined(spark, d).withColumn("tags", raw)).select("ord", F.concat_ws(",", "tags").alias("tags"))


@query("""SELECT event_id, 'valid_json' AS status, json_extract_string(props, '$.k') AS ref FROM events WHERE event_id % 3 = 0
UNION ALL SELECT event_id, 'repaired_json', json_extract_string(props, '$.k') FROM events WHERE event_id % 3 = 1 UNION ALL SELECT event_id, 'fallback', NULL FROM events WHERE event_id % 3 = 2""", over="")
def model_json_repair(spark, d):
    """Answers as models give them: plain, fenced and cut off, or prose."""
    from ..functions import repair

    k = F.col("event_id") % 3
    raw = F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit("```json\n"), F.expr("substring(props, 1, length(props) - 1)"), F.lit(",}\n```"))).otherwise("No data today.")
    rows = table(spark, d, "events").select("event_id", raw.alias("raw")).withColumn("parsed", repair.repair_json(F.col("raw")))
    status = repair.json_status(F.col("raw"), F.col("parsed"), repair.missing_fields(F.col("parsed"), ["k"]))
    return rows.select("event_id", status.alias("status"), F.get_json_object("parsed", "$.k").alias("ref"))


@query(f"""+ {HEADLINED_SQL} SELECT ord, CASE WHEN ord % 6 = 5 THEN NULL ELSE CAST(ord AS VARCHAR) END AS id, CASE WHEN ord % 6 <> 5 THEN primary_type END AS lane, CASE WHEN ord % 6 NOT IN (4, 5) THEN CAST(total_score AS VARCHAR) END AS score,
CASE WHEN ord % 6 NOT IN (1, 5) THEN 'n' || source END AS note, CASE ord % 6 WHEN 1 THEN 'note' WHEN 4 THEN 'score' ELSE '' END AS lost FROM hl""")
def model_json_fields(spark, d):
    """Answers damaged in six ways, a way a row: whole in an envelope, cut within the last field, loose syntax, curly quotes, a value left out, prose."""
    from ..functions.recovery import recovered

    rows = headlined(spark, d).select("ord", "title", F.struct(F.col("ord").alias("id"), F.col("primary_type").alias("lane"), F.col("total_score").alias("score"), F.concat(F.lit("n"), "source").alias("note")).alias("o"))
    whole, k = F.to_json("o"), F.col("ord") % 6
    raw = (
        F.when(k == 0, F.to_json(F.struct(F.array(F.struct(F.array(F.struct(F.concat(F.lit("```json\n"), whole, F.lit("\n```")).alias("text"))).alias("content"))).alias("output"))))
        .when(k == 1, F.concat(F.lit("Here: "), F.regexp_replace(whole, '"}$', "")))
        .when(k == 2, F.concat(F.regexp_replace(F.regexp_replace(whole, '"(\\w+)":', "$1: "), "}$", ",}"), F.lit(" Done.")))
        .when(k == 3, F.regexp_replace(whole, '"([^"]*)"', "“$1”"))
        .when(k == 4, F.regexp_replace(whole, '"score":[0-9]+', '"score": '))
        .otherwise(F.concat(F.lit("Sorry, no "), "title"))
    )
    got = rows.select("ord", recovered(raw).alias("r"))
    text = lambda name: F.get_json_object(F.concat(F.lit('{"v":'), F.col("r.fields")[name], F.lit("}")), "$.v").alias(name)
    return got.select("ord", *[text(n) for n in ("id", "lane", "score", "note")], F.array_join("r.lost", ",").alias("lost"))


@query("""SELECT user_id, CAST(sum(event_id % 5) AS BIGINT) AS calls, bool_or(event_type = 'error') AS failed, max_by(event_type, ts) AS last_status FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id) AS k FROM events) GROUP BY user_id""", over="")
def merge_observability(spark, d):
    from ..operators import selection

    rows = table(spark, d, "events").select("user_id", "ts", (F.col("event_id") % 5).alias("calls"), (F.col("event_type") == "error").alias("failed"), F.col("event_type").alias("last_status"))
    return selection.merge_counters(rows, "user_id", ["calls"], ["failed"], ["last_status"], "ts")


@query(f"""+ {CLUSTERS_SQL}, e AS (SELECT a.*, ev.leader_id FROM a JOIN ev USING (ord)
), f AS (SELECT *, row_number() OVER (PARTITION BY primary_type, leader_id ORDER BY total_score DESC, ord) AS k FROM e WHERE age_hours <= 168
), g AS (SELECT *, CAST(row_number() OVER (PARTITION BY primary_type ORDER BY total_score DESC, ord) AS INTEGER) AS place FROM f WHERE k = 1
), w AS (SELECT primary_type, CASE WHEN place <= 3 THEN 'top' ELSE 'overflow' END AS part, place, ord, total_score, leader_id FROM g WHERE place <= 3 OR (place <= 5 AND total_score >= 90)
), x AS (SELECT *, row_number() OVER (PARTITION BY primary_type, leader_id ORDER BY total_score DESC, ord) AS k FROM e WHERE age_hours > 168 AND leader_id NOT IN (SELECT leader_id FROM w)
), y AS (SELECT *, row_number() OVER (PARTITION BY primary_type ORDER BY total_score DESC, ord) AS n FROM x WHERE k = 1
), z AS (SELECT y.*, CAST(coalesce(c, 0) + n AS INTEGER) AS place FROM y LEFT JOIN (SELECT primary_type, count(*) AS c FROM w GROUP BY 1) USING (primary_type))
SELECT primary_type, part, place, ord, total_score FROM w UNION ALL SELECT primary_type, 'archive', place, ord, total_score FROM z WHERE place <= 3""")
def section_selection(spark, d):
    """Per lane the best stories of fresh rows, filled from older ones."""
    from ..operators import selection

    rows = articles(spark, d).select("ord", "title", "total_score", "primary_type", "age_hours")
    clustered = rows.join(events.event_clusters(rows, None, ascending()), "ord")
    return selection.select_sections(clustered.filter("age_hours <= 168"), clustered.filter("age_hours > 168"), "primary_type", best()).select("primary_type", "part", "place", "ord", "total_score")


from . import editorial, intake  # noqa: E402, F401  register their queries
