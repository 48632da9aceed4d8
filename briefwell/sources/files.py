"""Readers of landed files: JSON lines, watchlists, social blocks, target lists, API results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import clip, contains_any
from ..functions.urls import domain, kind_priority
from ..operators.gates import blocked_url

# Prefixes of a watchlist line.
WATCHLIST_KINDS = ("url", "repo", "org", "query", "topic", "company", "product", "tool", "policy", "person")
# Platforms of the social inbox.
PLATFORMS = ("facebook", "social", "manual")


def read_cases(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def read_watchlist(spark: SparkSession, path: str) -> DataFrame:
    """(kind, term, place): ``prefix:value`` lines, bare lines are URLs, ``#`` starts a comment. Of equal terms the first stays."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("place", "line")).withColumn("line", F.trim("line"))
    lines = lines.filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    prefix = F.lower(F.regexp_extract("line", "^([A-Za-z]+):", 1))
    known = prefix.isin(*WATCHLIST_KINDS)
    terms = lines.select(F.when(known, prefix).otherwise("url").alias("kind"), F.when(known, F.trim(F.regexp_replace("line", "^[A-Za-z]+:", ""))).otherwise(F.col("line")).alias("term"), "place").filter("term <> ''")
    first = F.row_number().over(Window.partitionBy("kind", F.lower("term")).orderBy("place"))
    return terms.withColumn("k", first).filter("k = 1").drop("k")


def read_social_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks between ``---`` lines of ``key: value`` lines; other lines continue the value before. Unknown platforms are left out."""
    blocks = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", "(?m)^---\\s*$")).alias("block")).filter(F.trim("block") != "")
    keys = ("platform", "group", "author", "title", "url", "posted_at", "note", "content", "comments")
    pick = lambda k: F.trim(F.regexp_replace(F.regexp_extract("block", f"(?ms)^{k}:[ \\t]*(.*?)(?=^[a-z_]+:|\\z)", 1), "\\s+", " "))
    rows = blocks.select(*[pick(k).alias(k) for k in keys]).withColumn("platform", F.lower("platform"))
    return _social(rows)


def social_rows(landed: DataFrame) -> DataFrame:
    """The same from rows that the ``landed`` source read as blocks."""
    keys = ("platform", "group", "author", "title", "url", "posted_at", "note", "content", "comments")
    rows = landed.filter("error IS NULL").select(*[F.coalesce(F.col("fields")[k], F.lit("")).alias(k) for k in keys])
    return _social(rows.withColumn("platform", F.lower("platform")))


def _social(rows: DataFrame) -> DataFrame:
    kept = rows.filter(F.col("platform").isin(*PLATFORMS) & ((F.col("title") != "") | (F.col("content") != "")))
    title = F.when(F.col("title") != "", F.col("title")).otherwise(clip(F.col("content"), 120))
    return kept.withColumn("title", title).withColumn("source", F.concat_ws(" / ", F.initcap("platform"), F.when(F.col("group") != "", F.col("group")))).withColumn("social_signal", F.lit(True)).withColumn("source_kind", F.lit("community"))


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    """``label | url | type`` lines; manual targets score 100 and are active."""
    parts = F.split("value", "\\s*\\|\\s*")
    rows = spark.read.text(path).filter((F.trim("value") != "") & ~F.trim("value").startswith("#"))
    return rows.select(F.trim(F.get(parts, F.lit(0))).alias("label"), F.trim(F.get(parts, F.lit(1))).alias("url"), F.lower(F.trim(F.coalesce(F.get(parts, F.lit(2)), F.lit("page")))).alias("source_type"), F.lit(100).alias("ai_source_score"), F.lit("auto_active").alias("status")).filter("url <> ''")


def merge_targets(first: DataFrame, second: DataFrame, slots: int) -> DataFrame:
    """By URL, the entry of highest score (ties: the first list's); then the ``slots`` best by score and URL."""
    both = first.withColumn("_from", F.lit(0)).unionByName(second.withColumn("_from", F.lit(1)))
    best = F.row_number().over(Window.partitionBy("url").orderBy(F.col("ai_source_score").desc(), "_from"))
    return both.withColumn("_k", best).filter("_k = 1").drop("_k", "_from").orderBy(F.col("ai_source_score").desc(), "url").limit(slots)


def _article(kind: str, **columns: Column) -> list[Column]:
    given = {"source_kind": F.lit(kind), "source_priority": kind_priority(F.lit(kind))} | columns
    return [c.alias(name) for name, c in given.items()]


def hacker_news(hits: DataFrame, now: str, min_points: int = 50, limit: int = 30) -> DataFrame:
    """Stories (title, url, created_at, points, num_comments, objectID) of the last day with more than ``min_points``, best first."""
    at = F.to_timestamp("created_at")
    fresh = hits.filter((F.col("points") > min_points) & (at >= F.lit(now).cast("timestamp") - F.expr("INTERVAL 1 DAY")))
    link = F.coalesce(F.col("url"), F.concat(F.lit("https://news.ycombinator.com/item?id="), "objectID"))
    return fresh.orderBy(F.col("points").desc(), "objectID").limit(limit).select(*_article("community", title=F.col("title"), url=link, source=F.lit("Hacker News"), published=F.col("created_at"), hn_points=F.col("points"), hn_num_comments=F.col("num_comments"), community_signal_strength=F.when(F.col("points") >= 50, 4).otherwise(3)))


def reddit(posts: DataFrame, now_epoch: int, keywords: tuple[str, ...], min_score: int = 100) -> DataFrame:
    """Posts of the last day over ``min_score`` that hold a keyword; strength 3, one more from 250 points, one more from 40 comments."""
    hot = posts.filter((F.col("score") > min_score) & (F.col("created_utc") >= now_epoch - 86400) & contains_any(F.concat_ws(" ", "title", "selftext"), keywords))
    strength = F.least(F.lit(5), 3 + (F.col("score") >= 250).cast("int") + (F.col("num_comments") >= 40).cast("int"))
    link = F.when(F.coalesce(F.col("url"), F.lit("")) != "", F.col("url")).otherwise(F.concat(F.lit("https://www.reddit.com"), "permalink"))
    return hot.select(*_article("community", title=F.col("title"), url=link, source=F.concat(F.lit("Reddit r/"), "subreddit"), reddit_score=F.col("score"), reddit_num_comments=F.col("num_comments"), community_signal_strength=strength))


def repositories(repos: DataFrame, keywords: tuple[str, ...], from_search: bool = False) -> DataFrame:
    """Repository JSON rows to articles; rows from organisations and searches also need a keyword."""
    about = F.concat_ws(" ", "full_name", "description", F.concat_ws(" ", "topics"))
    valid = F.regexp_count(F.col("full_name"), F.lit("^[^/]+/[^/]+$")) == 1
    rows = repos.filter(valid & (contains_any(about, keywords) if from_search else F.lit(True)))
    return rows.select(*_article("github", title=F.concat_ws(" — ", "full_name", F.when(F.trim(F.coalesce("description", F.lit(""))) != "", F.col("description"))), url=F.col("html_url"), source=F.lit("GitHub"), published=F.col("pushed_at"), github_signal_type=F.lit("repository"), github_full_name=F.col("full_name"), github_owner=F.col("owner.login"), github_stars=F.col("stargazers_count")))


def releases(rows: DataFrame) -> DataFrame:
    name = F.when(F.trim(F.coalesce("name", F.lit(""))) != "", F.col("name")).otherwise(F.col("tag_name"))
    return rows.select(*_article("github", title=F.concat(F.col("repo_full_name"), F.lit(" — "), name), url=F.col("html_url"), source=F.lit("GitHub"), published=F.col("published_at"), content=F.col("body"), github_signal_type=F.lit("release"), github_full_name=F.col("repo_full_name")))


def repo_with_release(repos: DataFrame, rows: DataFrame) -> DataFrame:
    """Each repository with its first release by date, if it has one."""
    first = F.row_number().over(Window.partitionBy("github_full_name").orderBy(F.col("published").desc_nulls_last(), "url"))
    newest = rows.withColumn("k", first).filter("k = 1").select("github_full_name", F.col("title").alias("release_title"), F.col("url").alias("release_url"))
    return repos.join(newest, "github_full_name", "left")


def feed_items(items: DataFrame, now: str, per_feed: int = 12, hours: int = 72, blocked: tuple[str, ...] = ()) -> DataFrame:
    """The first items of each feed, undated or of the last hours, from hosts that are not blocked."""
    host = domain(F.col("url"))
    off = reduce(lambda a, b: a | b, [(host == n) | host.endswith("." + n) for n in blocked], F.lit(False))
    top = items.withColumn("k", F.row_number().over(Window.partitionBy("feed").orderBy("place"))).filter(F.col("k") <= per_feed).drop("k")
    since = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {hours} HOURS")
    return top.filter((F.col("published").isNull() | (F.col("published") >= since)) & ~off)


def search_results(rows: DataFrame, per_query: int = 4) -> DataFrame:
    """Landed search results (query, place, href or link, title, body, date): of each query the first ``per_query`` with a URL that is not blocked, with rank."""
    url = F.coalesce(F.nullif(F.col("href"), F.lit("")), F.nullif(F.col("link"), F.lit("")))
    open_ = rows.withColumn("_url", url).filter(F.col("_url").isNotNull() & ~blocked_url(F.col("_url")))
    ranked = open_.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("place"))).filter(F.col("rank") <= per_query)
    return ranked.select("query", "rank", F.col("_url").alias("url"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("body", F.lit("")).alias("snippet"), F.coalesce("date", F.lit("")).alias("published"), F.concat(F.lit("DuckDuckGo: "), "query").alias("source"))


#: Fields of a chat message that are read.
MESSAGE = "message_id long, date double, text string, caption string, chat struct<id: long>, from struct<username: string, first_name: string>, reply_to_message struct<from: struct<is_bot: boolean>>"


def feedback_messages(updates: DataFrame, bot: str = "") -> DataFrame:
    """Every chat update (JSON rows) as a message, with is_feedback: tagged, prefixed, a reply to a bot, or one that names the bot.

    Updates without a message or text are no feedback. An edited message stands for one where there is none.
    """
    landed = F.coalesce(*[F.to_json(c) for c in ("message", "edited_message") if c in updates.columns])  # inferred types may lack fields
    rows = updates.select("update_id", F.from_json(landed, MESSAGE).alias("m"))
    words = F.trim(F.coalesce(F.nullif(F.col("m.text"), F.lit("")), F.col("m.caption"), F.lit("")))
    told = F.lower(words).contains("#feedback") | F.lower(words).rlike("(?U)^(feedback|phan hoi|phản hồi)\\b") | F.coalesce(F.col("m.reply_to_message.from.is_bot"), F.lit(False))
    if bot:
        told |= F.lower(words).rlike(rf"(?U)@\Q{bot.lower()}\E\b")
    name = F.coalesce(F.nullif(F.col("m.from.username"), F.lit("")), F.nullif(F.col("m.from.first_name"), F.lit("")), F.lit("unknown"))
    clean = F.trim(F.regexp_replace(F.regexp_replace(words, "(?i)#feedback\\b", ""), "(?i)^(feedback|phan hoi|phản hồi)\\s*[:-]?\\s*", ""))
    return rows.select("update_id", F.col("m.chat.id").cast("string").alias("chat_id"), F.col("m.message_id").alias("message_id"), name.alias("user_name"), clean.alias("text"), F.timestamp_seconds("m.date").alias("created_at"), (told & (words != "")).alias("is_feedback"))


def feedback_updates(updates: DataFrame, after: int, bot: str = "") -> DataFrame:
    """The messages past an offset that are feedback."""
    return feedback_messages(updates, bot).filter((F.col("update_id") > after) & F.col("is_feedback")).drop("is_feedback")
