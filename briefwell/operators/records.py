"""Records around the brief: scouted results as articles, storage types, sections of notes, small state, memory rows, regression cases."""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import keywords as K
from ..functions.automaton import words_found
from ..functions.dates import parse_timestamp
from ..functions.text import contains_any, is_false
from ..functions.urls import domain, in_domain, kind_priority, source_kind
from .gates import blocked_url
from .signals import LANE_ALIASES, flag, low, with_absent

# Title words that decide where a thin article is stored.
STORED_POLICY = ("law", "regulation", "policy", "governance", "compliance", "safety", "security", "cyberattack", "breach", "hack", "lawsuit", "investigation")
STORED_BUSINESS = ("startup", "funding", "raises", "partnership", "partners with", "market", "competition", "competitive", "race", "lead", "dominance")
STORED_PRODUCT = ("launch", "release", "api", "sdk", "feature", "model", "platform", "capability")
# Hosts of social platforms, and cuts of scouted texts.
SOCIAL_HOSTS = ("x.com", "twitter.com", "facebook.com", "linkedin.com", "threads.net", "reddit.com")
SNIPPET, CONTENT = 500, 4000


def founder_grade(*texts: Column) -> Column:
    """Whether texts together hold a signal that a result must have and none of the noise."""
    whole = F.concat_ws(" ", *[F.when(F.coalesce(c, F.lit("")) != "", c) for c in texts])
    return contains_any(whole, K.FOUNDER_SIGNALS) & ~contains_any(whole, K.FOUNDER_NOISE)


def scout_articles(results: DataFrame, policy) -> DataFrame:
    """Scouted web results (plan, url, title, summary, why_it_matters, published_at) as articles.

    Left out: without URL or title, blocked, repositories and social posts, and what is not of founder grade.
    """
    t = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    snippet = F.concat_ws(" ", F.nullif(t("summary"), F.lit("")), F.nullif(t("why_it_matters"), F.lit("")))
    host = domain(t("url"))
    kept = results.filter((t("url") != "") & (t("title") != "") & ~blocked_url(t("url")) & (host != "github.com") & ~in_domain(host, SOCIAL_HOSTS) & founder_grade(t("title"), snippet, t("url"), host))
    source = F.concat(F.lit("Grok Scout: "), F.col("plan"))
    kind = source_kind(policy, source, host, quality=F.lit("review"))
    shown = F.when(snippet != "", snippet).otherwise(t("title"))
    return kept.select(t("title").alias("title"), t("url").alias("url"), source.alias("source"), F.substring(shown, 1, SNIPPET).alias("snippet"), F.substring(snippet, 1, CONTENT).alias("content"), t("published_at").alias("published"), kind.alias("source_kind"), kind_priority(kind).alias("source_priority"), F.lit(True).alias("grok_scout"), F.col("plan").alias("grok_scout_plan"))


def scout_posts(results: DataFrame, policy) -> DataFrame:
    """Scouted posts (plan, post_url, linked_url, title, summary, why_it_matters, author_handle, published_at) as articles of what they link to, or of themselves."""
    t = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    rows = results.withColumn("_handle", F.regexp_replace(t("author_handle"), "^@+", "")).withColumn("_url", F.when(t("linked_url") != "", t("linked_url")).otherwise(t("post_url")))
    url, handle, host = F.col("_url"), F.col("_handle"), domain(F.col("_url"))
    rows = rows.filter((url != "") & (t("title") != "") & ~blocked_url(url) & founder_grade(t("title"), t("summary"), t("why_it_matters"), handle, t("linked_url"), t("post_url")))
    linked = t("linked_url") != ""
    line = lambda head, c: F.when(c != "", F.concat(F.lit(head), c))
    content = F.concat_ws("\n\n", line("X post by @", handle), line("Summary: ", t("summary")), line("Why it matters: ", t("why_it_matters")), F.when((t("post_url") != "") & (t("post_url") != url), F.concat(F.lit("Original X post: "), t("post_url"))))
    kind = source_kind(policy, F.concat(F.lit("Grok X Scout: "), F.col("plan")), host, quality=F.when(linked, "review").otherwise("manual"), social=~linked)
    source = F.concat(F.lit("Grok X Scout: "), F.col("plan"), F.when(handle != "", F.concat(F.lit(" | @"), handle)).otherwise(""))
    return rows.select(t("title").alias("title"), url.alias("url"), source.alias("source"), F.substring(content, 1, CONTENT).alias("content"), kind.alias("source_kind"), kind_priority(kind).alias("source_priority"), F.lit(4).alias("community_signal_strength"), (~linked).alias("social_signal"), F.lit("x").alias("social_platform"), handle.alias("x_author_handle"))


def handles(configured: list[str], default: list[str]) -> list[str]:
    """Distinct handles without @ and blanks, told apart whatever their case; the default ones where none is configured."""
    cleaned = [h.strip().lstrip("@") for h in configured or default]
    return list({h.lower(): h for h in reversed(cleaned) if h}.values())[::-1]


def watchlist_articles(seeds: DataFrame, pages: DataFrame, results: DataFrame) -> DataFrame:
    """Articles of a watchlist: its URLs (kind url) with their landed ``pages`` (url, title, content), and gated ``results`` (of search_gate(), with term) of its queries."""
    direct = seeds.filter("kind = 'url'").select(F.col("term").alias("url")).filter(~blocked_url(F.col("url"))).distinct().join(pages, "url", "left")
    direct = direct.select(F.coalesce(F.nullif(F.trim("title"), F.lit("")), "url").alias("title"), "url", F.lit("Watchlist Seed").alias("source"), F.substring(F.coalesce("content", F.lit("")), 1, SNIPPET).alias("snippet"), F.coalesce("content", F.lit("")).alias("content"))
    asked = seeds.filter("kind = 'query'").select("term").distinct()
    found = results.filter("gate_reason = ''").join(asked, "term", "left_semi").select("title", "url", F.concat(F.lit("Watchlist Query: "), "term").alias("source"), F.coalesce("snippet", F.lit("")).alias("snippet"), F.coalesce("content", F.lit("")).alias("content"))
    return direct.unionByName(found).withColumn("watchlist_hit", F.lit(True)).withColumn("source_kind", F.lit("watchlist")).withColumn("source_priority", F.lit(82))


def storage_type(articles: DataFrame) -> Column:
    """The type under which an article is stored: its lane, or for a thin article of a weak source what its title tells; call it on rows with the columns of STORAGE_KINDS."""
    now = F.coalesce(F.nullif(F.trim("primary_type"), F.lit("")), F.lit("Practical"))
    renamed = F.when(now.isin("Research", "Business"), "Product").when(now.isin("Policy", "Policy & Ethics", "Society"), LANE_ALIASES["society"]).otherwise(now)
    thin = ~flag("content_available") & F.coalesce(F.lower("source_tier"), F.lit("unknown")).isin("c", "unknown") & (F.coalesce(F.col("total_score"), F.lit(0)) < 40) & low("confidence_label").isin("", "low", "medium")
    title = F.coalesce(F.col("title"), F.lit(""))
    told = F.when(contains_any(title, STORED_POLICY), "Society & Culture").when(contains_any(title, STORED_BUSINESS + STORED_PRODUCT), "Product").otherwise("Practical")
    return F.when(is_false(F.col("is_ai_relevant")), "Practical").when(thin, told).otherwise(renamed)


def storage_tags(most: int = 5) -> Column:
    """The tags with which an article is stored: none for off-topic, old, weak or thin ones; call it on rows with the columns of STORAGE_KINDS."""
    score, content = F.coalesce(F.col("total_score"), F.lit(0)), flag("content_available")
    weak = F.coalesce(F.lower("source_tier"), F.lit("unknown")).isin("c", "unknown") & (~content | (low("confidence_label") == "low") | (score < 55))
    none = is_false(F.col("is_ai_relevant")) | flag("is_old_news") | flag("is_stale_candidate") | (score < 40) | weak
    tags = F.filter(F.transform(F.coalesce(F.col("tags"), F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(none, F.array().cast("array<string>")).otherwise(F.slice(tags, 1, most))


STORAGE_KINDS = {"primary_type": "string", "title": "string", "total_score": "int", "content_available": "boolean", "source_tier": "string", "confidence_label": "string", "is_ai_relevant": "boolean", "is_old_news": "boolean", "is_stale_candidate": "boolean", "tags": "array<string>"}


def with_storage(articles: DataFrame) -> DataFrame:
    rows = with_absent(articles, STORAGE_KINDS)
    return rows.withColumn("storage_type", storage_type(rows)).withColumn("storage_tags", storage_tags())


def markdown_sections(text: Column) -> Column:
    """array<struct<heading, lines>>: a text's lines under its headings; blank lines stay between lines, never first."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), lambda x: F.trim(x))
    fresh = lambda h: F.struct(h.alias("heading"), F.array().cast("array<string>").alias("lines"))
    start = F.struct(F.array().cast("array<struct<heading:string,lines:array<string>>>").alias("done"), fresh(F.lit("")).alias("now"))
    kept = lambda acc: F.when((acc["now"]["heading"] != "") | (F.size(acc["now"]["lines"]) > 0), F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"])
    head = lambda x: F.trim(F.regexp_extract(x, r"^#{1,6}\s+(.*)$", 1))
    longer = lambda acc, x: F.struct(acc["done"].alias("done"), F.struct(acc["now"]["heading"].alias("heading"), F.concat(acc["now"]["lines"], F.array(x)).alias("lines")).alias("now"))
    step = lambda acc, x: F.when(x.rlike(r"^#{1,6}\s+(.*)$"), F.struct(kept(acc).alias("done"), fresh(head(x)).alias("now"))).when((x != "") | (F.size(acc["now"]["lines"]) > 0), longer(acc, x)).otherwise(acc)
    return F.aggregate(lines, start, step, kept)


def date_start(text: Column) -> Column:
    """The day of an ISO time as text, or null."""
    return F.date_format(F.when(F.trim(text).rlike(r"^\d{4}-\d{2}-\d{2}"), parse_timestamp(text)), "yyyy-MM-dd")


def latest_values(table: DataFrame) -> DataFrame:
    """(key, value, updated_at): the newest value of each key of an append-only table; ties go to the greater value."""
    best = table.groupBy("key").agg(F.max(F.struct("updated_at", "value")).alias("x"))
    return best.select("key", F.col("x.value").alias("value"), F.col("x.updated_at").alias("updated_at"))


def value_of(table: DataFrame, key: str, default: str = "") -> str:
    row = latest_values(table.filter(F.col("key") == key)).first()
    return (row["value"] or default) if row else default


def memory_rows(articles: DataFrame, stored_at: str) -> DataFrame:
    """What the memory keeps of articles (id, title, summary, primary_type, score, url): one row an id, with the text that is embedded and clipped fields.

    Of rows with the same id the best by score, then the first by title, stays.
    """
    best = articles.groupBy("id").agg(F.min(F.struct((-F.coalesce("score", F.lit(0))).alias("k"), F.col("title"), F.col("summary"), F.col("primary_type"), F.col("score"), F.col("url"))).alias("x"))
    text = lambda c: F.coalesce(F.col(f"x.{c}"), F.lit(""))
    return best.select("id", F.substring(F.concat(text("title"), F.lit("\n"), text("summary")), 1, 5000).alias("document"), F.substring(text("title"), 1, 500).alias("title"), text("primary_type").alias("primary_type"), F.coalesce("x.score", F.lit(0)).alias("score"), F.substring(text("url"), 1, 2000).alias("url"), F.lit(stored_at).alias("stored_at"))


def upsert_memory(old: DataFrame, new: DataFrame) -> DataFrame:
    """The memory with new rows in place of those of the same id."""
    return old.join(new.select("id"), "id", "left_anti").unionByName(new)


def regression(cases: DataFrame, fields: list[str]) -> DataFrame:
    """Cases (expected_<field>, and the field itself) with ``failures`` (field, expected, actual) and passed. Blank expectations are not tested."""
    e = lambda f: F.trim(F.coalesce(F.col(f"expected_{f}"), F.lit("")))
    tests = [F.when((e(f) != "") & ~F.col(f).cast("string").eqNullSafe(e(f)), F.struct(F.lit(f).alias("field"), e(f).alias("expected"), F.coalesce(F.col(f).cast("string"), F.lit("")).alias("actual"))) for f in fields]
    return cases.withColumn("failures", F.filter(F.array(*tests), lambda x: x.isNotNull())).withColumn("passed", F.size("failures") == 0)


def regression_summary(results: DataFrame, min_pass_rate: float = 80.0) -> DataFrame:
    """One row: total, passed, failed, pass_rate (0 without cases), ok."""
    counts = results.agg(F.count("*").alias("total"), F.count(F.when(F.col("passed"), 1)).alias("passed"))
    rate = F.when(F.col("total") > 0, F.col("passed") / F.col("total") * 100).otherwise(0.0)
    return counts.withColumn("failed", F.col("total") - F.col("passed")).withColumn("pass_rate", F.round(rate, 1)).withColumn("ok", rate >= min_pass_rate)


def run_summary(raw: DataFrame, fresh: DataFrame, scored: DataFrame, reviewed: DataFrame) -> DataFrame:
    """(section, name, n): the funnel of a run, decisions, skip reasons and kinds of source, for its report."""
    sized = lambda rows, name: rows.agg(F.count("*").alias("n")).select(F.lit("funnel").alias("section"), F.lit(name).alias("name"), "n")
    by = lambda rows, c, section: rows.groupBy(F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit("unknown")).alias("name")).agg(F.count("*").alias("n")).select(F.lit(section).alias("section"), "name", "n")
    parts = [sized(raw, "raw"), sized(fresh, "new"), sized(scored, "scored"), by(scored, "source_kind", "source_kind"), by(reviewed, "delivery_decision", "decision"), by(reviewed.filter("delivery_decision <> 'include'"), "delivery_route_reason", "skip_reason")]
    return reduce(DataFrame.unionByName, parts)


def replay(preview: DataFrame, approved: DataFrame, key: str = "url") -> DataFrame:
    """The rows of a preview that were approved (by key), in the order of approval (``place``), each once; keys that the preview lacks are left out."""
    first = approved.groupBy(F.col(key).alias("_key")).agg(F.min("place").alias("place"))
    once = preview.dropDuplicates([key])
    return once.join(first, F.col(key) == F.col("_key")).drop("_key")


# Tags that make an article fit the workspace, and headings at which an analysis is cut for a note.
FIT_TAGS = ("api_platform", "model_release", "funding", "research", "vietnam")
NOTE_ENDS = ("\n## Action For Us", "\n## Recommendation")


def workspace_fit(decision: Column, score: Column, tier: Column, tags: Column) -> Column:
    """High for what is included, scores 75 or more or carries a fitting tag; Medium for deep rows and from 55 points; else Low."""
    n = F.coalesce(score, F.lit(0))
    lowered = F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x)))
    high = (F.lower(F.trim(F.coalesce(decision, F.lit("")))) == "include") | (n >= 75) | F.arrays_overlap(lowered, F.array(*[F.lit(t) for t in FIT_TAGS]))
    return F.when(F.coalesce(high, F.lit(False)), "High").when((F.lower(F.trim(F.coalesce(tier, F.lit("")))) == "deep") | (n >= 55), "Medium").otherwise("Low")


def workspace_status(decision: Column, primary: Column, score: Column) -> Column:
    said = F.lower(F.trim(F.coalesce(decision, F.lit(""))))
    return F.when(said == "include", "Brief").when(said == "review", "Review").when(is_false(primary), "Cluster").when(F.coalesce(score, F.lit(0)) >= 55, "Watch").otherwise("Hold")


def note_excerpt(page: Column, analysis: Column, summary: Column) -> Column:
    """The first text there is, cut before its advice."""
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    text = bare(F.coalesce(*[F.nullif(c, F.lit("")) for c in (page, analysis, summary)], F.lit("")))
    return reduce(lambda acc, end: bare(F.split_part(acc, F.lit(end), F.lit(1))), NOTE_ENDS, text)


def topic_hits(articles: DataFrame, topics: DataFrame, text: Column, id_col: str = "ord") -> DataFrame:
    """(topic, id): articles that hold a topic as a whole, or two of its words of three characters or more (one, if it has but one).

    Topics are a watchlist, any number of them: one pass of an automaton over each text finds all their words (long lists are
    dealt to several), and the words found are joined to topics, so texts are not shuffled. Blank topics match nothing;
    repeated ones count once; a word that a topic repeats counts as often.
    """
    listed = [(r["topic"], r["t"], Counter(w for w in re.findall("[a-z0-9]+", r["t"]) if len(w) >= 3)) for r in topics.select(F.lower(F.trim("topic")).alias("t"), "topic").filter("t <> ''").distinct().orderBy("topic").collect()]
    words = tuple(dict.fromkeys(w for _, t, own in listed for w in (t, *own)))
    place = {w: k for k, w in enumerate(words)}
    uses = [(place[t], topic, True, 0, 0) for topic, t, _ in listed] + [(place[w], topic, False, n, min(2, own.total())) for topic, _, own in listed for w, n in own.items()]
    table = articles.sparkSession.createDataFrame(uses, "w int, topic string, whole boolean, n int, need int")
    met = articles.select(F.col(id_col), F.explode(words_found(F.lower(F.coalesce(text, F.lit(""))), words)).alias("w")).join(table, "w")
    told = met.groupBy("topic", id_col).agg(F.max("whole").alias("whole"), F.sum("n").alias("n"), F.max("need").alias("need"))
    return told.filter(F.col("whole") | (F.col("need") > 0) & (F.col("n") >= F.col("need"))).select("topic", id_col)
