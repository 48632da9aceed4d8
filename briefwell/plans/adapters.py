"""Articles made from the driver's tables, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SourcePolicy
from ..functions.dates import freshness_bucket
from ..functions.urls import kind_priority, source_kind, source_tier

#: The sources of the test tables in the part of known hosts.
POLICY = SourcePolicy(
    official=("src0.example.com", "src1.example.com"),
    strong_media=("src2.example.com", "src3.example.com", "src4.example.com"),
    regional_media=("src5.example.com",),
    tier_a=("src0.example.com", "src1.example.com"),
    tier_b=("src2.example.com", "src3.example.com", "src4.example.com", "src5.example.com"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str, labelled: bool = True) -> DataFrame:
    """One article a document; labels give a three-valued relevance (toxic: false, not toxic: true, none: null). Without them (``labelled``) it is null."""
    # Titles are cut before rows meet labels, so whole texts are shuffled only for those who read them.
    docs = table(spark, sf_dir, "documents").withColumn("title", F.substring("text", 1, 80))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    host = F.concat("source", F.lit(".example.com"))
    known = docs.join(labels, "doc_id", "left") if labelled else docs.withColumns({"quality": F.lit(None).cast("int"), "toxic": F.lit(None).cast("int")})
    base = known.select(
        F.col("doc_id").alias("ord"),
        "source",
        "lang",
        "title",
        F.col("text").alias("content"),
        host.alias("source_domain"),
        F.concat(F.lit("https://"), host, F.lit("/d/"), F.col("doc_id")).alias("url"),
        (F.col("doc_id") * 7 % 1000).cast("double").alias("age_hours"),
        (F.col("n_chars") % 101).cast("int").alias("total_score"),
        F.when(F.col("lang") == "en", "Product").when(F.col("lang") == "es", "Practical").otherwise("Society & Culture").alias("primary_type"),
        (F.col("toxic") == 0).alias("is_ai_relevant"),
        (F.col("quality") == 1).alias("is_news_candidate"),
        (F.col("n_chars") >= 200).alias("content_available"),
        (F.col("n_chars") % 5).cast("int").alias("community_signal_strength"),
    )
    signal = F.when(F.col("source").isin("src6", "src7"), "repository").otherwise("")
    name = F.when(F.col("source") == "src8", "Reddit r/x").when(F.col("source") == "src9", "DuckDuckGo").when(F.col("source") == "src10", "Watchlist seed").otherwise(F.col("source"))
    return (
        base.withColumn("freshness_bucket", freshness_bucket(F.col("age_hours")))
        .withColumn("source_kind", source_kind(POLICY, name, F.col("source_domain"), github_type=signal))
        .withColumn("source_tier", source_tier(POLICY, F.col("source_domain")))
        .withColumn("source_priority", kind_priority(F.col("source_kind")))
        .withColumn("source_verified", F.col("source_tier").isin("a", "b"))
        .withColumn("watchlist_hit", F.col("source_kind") == "watchlist")
        .withColumn("is_old_news", F.col("age_hours") > 720)
        .withColumn("is_stale_candidate", F.col("age_hours") > 336)
    )


#: The same articles, as the CTE ``a``.
ARTICLES_SQL = """b AS (
  SELECT d.doc_id AS ord, d.source, d.lang, substr(d.text, 1, 80) AS title, d.text AS content, d.source || '.example.com' AS source_domain,
    'https://' || d.source || '.example.com/d/' || d.doc_id AS url, CAST(d.doc_id * 7 % 1000 AS DOUBLE) AS age_hours,
    CAST(d.n_chars % 101 AS INTEGER) AS total_score,
    CASE WHEN d.lang = 'en' THEN 'Product' WHEN d.lang = 'es' THEN 'Practical' ELSE 'Society & Culture' END AS primary_type,
    l.toxic = 0 AS is_ai_relevant, l.quality = 1 AS is_news_candidate, d.n_chars >= 200 AS content_available,
    CAST(d.n_chars % 5 AS INTEGER) AS community_signal_strength
  FROM documents d LEFT JOIN labels l USING (doc_id)
), a AS (
  SELECT *, CASE source_kind WHEN 'official' THEN 95 WHEN 'github' THEN 90 WHEN 'strong_media' THEN 85 WHEN 'watchlist' THEN 82 WHEN 'regional_media' THEN 80 WHEN 'community' THEN 74 WHEN 'search' THEN 66 ELSE 45 END AS source_priority,
    source_tier IN ('a', 'b') AS source_verified, source_kind = 'watchlist' AS watchlist_hit, age_hours > 720 AS is_old_news, age_hours > 336 AS is_stale_candidate
  FROM (
    SELECT *, CASE WHEN age_hours <= 24 THEN 'breaking' WHEN age_hours <= 72 THEN 'fresh' WHEN age_hours <= 168 THEN 'recent' WHEN age_hours <= 720 THEN 'aging' ELSE 'stale' END AS freshness_bucket,
      CASE WHEN source IN ('src6', 'src7') THEN 'github' WHEN source IN ('src0', 'src1') THEN 'official' WHEN source IN ('src2', 'src3', 'src4') THEN 'strong_media' WHEN source = 'src5' THEN 'regional_media' WHEN source = 'src10' THEN 'watchlist' WHEN source = 'src8' THEN 'community' WHEN source = 'src9' THEN 'search' ELSE 'unknown' END AS source_kind,
      CASE WHEN source IN ('src0', 'src1') THEN 'a' WHEN source IN ('src2', 'src3', 'src4', 'src5') THEN 'b' ELSE 'c' END AS source_tier
    FROM b
  )
)"""

#: Headlines that the rules have words for, one put before each title in turn; the documents' own texts are invented prose.
HEADLINES = (
    "OpenAI releases new API and SDK for enterprise agents", "Startup launches agent workflow platform with human review", "Regulation and compliance: new safety policy for foundation model licensing", "Personal reflections on what I learned",
    "Register now for the webinar", "Rumor: a new model might leak", "Tutorial and starter kit with examples", "Hospital trial reports patient workflow and clinic scheduling gains",
    "Datacenter infrastructure pricing and compute deployment update", "Smartphone camera roundup", "Football results and weather", "Framework adopted in production, SDK integration and deployment guide released",
    "Startup funding and partnership announced", "How to build a playbook with local deployment", "Security breach and lawsuit investigation", "Benchmark results for inference and training on a new chip",
    "Community education program for students", "", "Observability, reliability and incident response runbook", "Gaming headphones and album review",
    "Hướng dẫn điện thoại mới", "Open source model release with public beta", "Robotics ecosystem competition and market lead", "Edge deployment simulator, self-hosted and cost-aware",
)
TAG_SETS = (("model_release", "api_platform"), ("developer_tools", "ai_agents", "open_source"), ("regulation", "safety"), (), ("funding", "partnership"), ("product_update", "enterprise_ai", "infrastructure"), ("education",), ("healthcare", "vietnam"))
OWNERS = ("openai", "someone", "nvidia", "vercel")


def headlined(spark: SparkSession, sf_dir: str, labelled: bool = True) -> DataFrame:
    """The articles with headlines, tags and repository fields, so that the word lists of the rules meet whole texts."""
    from ..operators.scoring import relevance_level

    pick = lambda values, c: F.element_at(F.array(*values), (c % len(values) + 1).cast("int"))
    tags = [F.array(*[F.lit(t) for t in s]).cast("array<string>") for s in TAG_SETS]
    rows = articles(spark, sf_dir, labelled)
    repository = F.col("source").isin("src6", "src7")
    return (
        rows.withColumn("title", F.concat(pick([F.lit(h) for h in HEADLINES], F.col("ord")), F.lit(" "), F.coalesce("title", F.lit(""))))
        .withColumn("tags", pick(tags, F.floor(F.col("ord") / 3)))
        .withColumn("github_signal_type", F.when(F.col("source") == "src6", "repository").when(F.col("source") == "src7", "release"))
        .withColumn("github_full_name", F.when(repository, F.concat(pick([F.lit(o) for o in OWNERS], F.floor(F.col("ord") / 5)), F.lit("/kit"))))
        .withColumn("github_stars", F.col("ord") * 37 % 9000)
        .withColumn("event_source_count", F.col("ord") % 3 + 1)
        .withColumn("relevance_level", relevance_level(F.col("total_score")))
        .withColumn("freshness_unknown", F.col("ord") % 13 == 0)
    )


def _listed(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


#: The same rows as the CTE ``hl``, which reads ``a``.
HEADLINED_SQL = f"""hl AS (
  SELECT * REPLACE ({_listed(HEADLINES)}[CAST(ord % {len(HEADLINES)} AS INT) + 1] || ' ' || coalesce(title, '') AS title), [{", ".join(f"CAST({_listed(s)} AS VARCHAR[])" for s in TAG_SETS)}][CAST(ord // 3 % {len(TAG_SETS)} AS INT) + 1] AS tags,
    CASE source WHEN 'src6' THEN 'repository' WHEN 'src7' THEN 'release' END AS github_signal_type, CASE WHEN source IN ('src6', 'src7') THEN {_listed(OWNERS)}[CAST(ord // 5 % {len(OWNERS)} AS INT) + 1] END AS github_owner,
    ord * 37 % 9000 AS github_stars, ord % 3 + 1 AS event_source_count, CASE WHEN total_score >= 70 THEN 'High' WHEN total_score >= 40 THEN 'Medium' ELSE 'Low' END AS relevance_level, ord % 13 = 0 AS freshness_unknown
  FROM a
)"""
