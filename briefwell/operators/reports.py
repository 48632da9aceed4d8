"""Reports: counts, tags, themes, watchlists, run health, stage timings, feedback, validation, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EXPECTED_TYPES, FEEDBACK_COMMANDS, FEEDBACK_PHRASES, TOPIC_GROUPS, WRONG_TYPE
from ..functions.text import contains_any, let, title_tokens
from .ranking import top_per_group
from .records import topic_hits
from .signals import with_absent


def count_by(rows: DataFrame, c: Column, k: int = 12) -> DataFrame:
    """(name, n): commonest first, blank and null as ``unknown``."""
    name = F.when(F.trim(F.coalesce(c.cast("string"), F.lit(""))) == "", "unknown").otherwise(F.trim(c.cast("string")))
    return rows.groupBy(name.alias("name")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "name").limit(k)


def tag_counts(rows: DataFrame, tags: str, k: int = 20) -> DataFrame:
    return rows.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "tag").limit(k)


def themes(rows: DataFrame, title: str, k: int = 5) -> DataFrame:
    """The commonest title tokens of at least four characters; ties by token."""
    tokens = rows.select(F.explode(title_tokens(F.col(title))).alias("token")).filter(F.length("token") >= 4)
    return tokens.groupBy("token").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "token").limit(k)


def watchlist_matches(rows: DataFrame, terms: DataFrame, text: Column, order: list[Column], k: int = 5, id_col: str = "ord") -> DataFrame:
    """For each (kind, term): how many rows match the term, their best score and the k first by ``order``.

    A row matches as topic_hits() tells: it holds the whole term, or two of its words. All terms are found in one pass over
    each text, and only ids of rows that match are joined back.
    """
    met = topic_hits(rows, terms.select(F.col("term").alias("topic")), text, id_col).withColumnRenamed("topic", "term")
    kinds = terms.select("kind", "term").distinct()
    totals_of = met.join(kinds, "term").join(rows.select(F.col(id_col), *[c for c in rows.columns if c not in (id_col, "kind", "term")]), id_col)
    totals = totals_of.groupBy("kind", "term").agg(F.count("*").alias("n_signals"), F.max("total_score").alias("max_score"))
    return top_per_group(totals_of, ["kind", "term"], order, k).join(totals, ["kind", "term"])


def topic_pages(rows: DataFrame, terms: DataFrame, text: Column, order: list[Column], topics: int = 12, articles: int = 5, id_col: str = "ord") -> DataFrame:
    """The ``topics`` pages of a watchlist (kind, term, place): (page, topic_group, topic, topic_slug, signal_count, n_signals, max_score, lanes, hosts, articles).

    Terms are taken by kind, then place; of the first ``2 * topics`` those that articles match have a page. A page holds
    the ``articles`` first by ``order``: signal_count, lanes (count of each primary_type) and hosts (distinct, sorted) are of
    these, n_signals and max_score of all that match. Pages are ranked by signal_count, best score, then the terms' order.
    """
    kinds = F.create_map(*[F.lit(x) for k, g in enumerate(TOPIC_GROUPS) for x in (g, k)])
    tidy = F.trim(F.regexp_replace("term", "(?U)\\s+", " "))
    listed = terms.select("kind", tidy.alias("term"), F.element_at(kinds, F.col("kind")).alias("_kind"), "place").filter("term <> '' AND _kind IS NOT NULL")
    first = listed.groupBy("_kind", "kind", "term").agg(F.min("place").alias("place")).orderBy("_kind", "place", "term").limit(2 * topics)
    lane = F.coalesce(F.nullif(F.trim("primary_type"), F.lit("")), F.lit("unknown"))
    kept = watchlist_matches(rows, first.select("kind", "term"), text, order, articles, id_col)
    held = kept.groupBy("kind", "term").agg(
        F.count("*").alias("signal_count"),
        F.first("n_signals").alias("n_signals"),
        F.first("max_score").alias("max_score"),
        F.array_sort(F.collect_list(lane)).alias("_lanes"),
        F.array_sort(F.collect_set(F.nullif(F.trim("source_domain"), F.lit("")))).alias("hosts"),
        F.array_sort(F.collect_list(F.struct("place", F.col(id_col).alias("id"), "title", "total_score"))).alias("articles"),
    )
    lanes = F.map_from_entries(F.transform(F.array_distinct("_lanes"), lambda x: F.struct(x, F.size(F.filter("_lanes", lambda y: y == x)))))
    slug = F.regexp_replace(F.regexp_replace(F.lower("term"), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    ranks = [F.col("signal_count").desc(), F.col("max_score").desc(), F.col("_kind"), F.col("_place"), F.col("term")]
    pages = held.join(first.withColumnRenamed("place", "_place"), ["kind", "term"]).orderBy(*ranks).limit(topics)
    groups = F.create_map(*[F.lit(x) for pair in TOPIC_GROUPS.items() for x in pair])
    page = F.row_number().over(Window.orderBy(*ranks))  # of the few kept
    return pages.select(page.alias("page"), F.element_at(groups, F.col("kind")).alias("topic_group"), F.col("term").alias("topic"), F.when(slug == "", "untitled").otherwise(slug).alias("topic_slug"), "signal_count", "n_signals", "max_score", lanes.alias("lanes"), "hosts", "articles")


def stage_timings(rows: DataFrame, stage: str, duration: str) -> DataFrame:
    return rows.groupBy(F.col(stage).alias("stage")).agg(F.count("*").alias("runs"), F.sum(duration).alias("total"), F.max(duration).alias("longest"), F.min(duration).alias("shortest"))


def run_health(rows: DataFrame, mode: str = "", warnings: int = 0, dead_feeds: int = 0, stale_sources: int = 0) -> DataFrame:
    """One row of counts over judged rows, status (green, yellow or red) and publish_ready by rules over them.

    ``mode`` and ``warnings``: how the summary was made and what is wrong with it; ``dead_feeds``, ``stale_sources``: counts of source health.
    """
    n = lambda test: F.count(F.when(test, 1))
    rows = with_absent(rows, {"source_history_penalty": "int"})
    kind, include = F.col("source_kind"), F.col("delivery_decision") == "include"
    strong = F.col("source_tier").isin("a", "b")
    counts = rows.agg(
        F.count("*").alias("scored_count"),
        F.count_distinct(F.nullif(F.trim(F.col("source_domain")), F.lit(""))).alias("source_diversity"),
        n(kind == "github").alias("github_count"),
        n(strong).alias("strong_count"),
        n(F.col("is_old_news") | F.col("is_stale_candidate")).alias("stale_count"),
        n(F.coalesce(F.col("source_history_penalty"), F.lit(0)) >= 8).alias("penalised_count"),
        *[n(kind == k).alias(f"{k}_count") for k in ("official", "strong_media", "community", "watchlist", "search")],
        n(include).alias("main_candidates"),
        n(include & strong).alias("strong_main"),
        n(include & (kind == "official")).alias("official_main"),
    )
    c = F.col
    part = lambda k: F.floor(c("scored_count") / k)
    some, main = c("scored_count") > 0, c("main_candidates") > 0
    bad = F.lit(mode == "safe_fallback" or warnings > 0)
    red = ~some | ~main | bad | (main & (c("strong_main") == 0))
    yellow = (
        (c("main_candidates") == 1)
        | (some & (c("source_diversity") <= 2))
        | (some & (c("github_count") >= 0.75 * c("scored_count")))
        | (some & (c("strong_count") < F.least(F.lit(3), F.greatest(F.lit(1), part(3)))))
        | (some & (c("stale_count") >= F.greatest(F.lit(3), part(4))))
        | (some & (c("penalised_count") >= F.greatest(F.lit(3), part(5))))
        | (main & (c("official_main") == 0))
        | F.lit(dead_feeds + stale_sources > 0)
    )
    status = F.when(red, "red").when(yellow, "yellow").otherwise("green")
    return counts.withColumn("status", status).withColumn("publish_ready", (F.col("status") == "green") | ((F.col("status") == "yellow") & main & ~bad & (c("strong_main") >= 1)))


def clean_feedback(text: Column, bot: str = "") -> Column:
    """A feedback text without the bot's name, the tag and the prefix that mark it; '' for null."""
    t = F.coalesce(text, F.lit(""))
    bare = lambda c: F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")
    if bot:
        t = F.regexp_replace(bare(t), rf"(?iU)@\Q{bot}\E\b", "")
    t = F.regexp_replace(bare(t), "(?iU)#feedback\\b", "")
    t = F.regexp_replace(t, "(?iU)^(feedback|phan hoi|phản hồi)\\s*[:-]?\\s*", "")
    return F.regexp_replace(F.regexp_replace(t, "(?U)\\s+", " "), "^[ :-]+|[ :-]+$", "")


def feedback_labels(text: Column, bot: str = "") -> Column:
    """Labels of a feedback text, each once: a command's, a wrong type's with the type expected, then those of phrases in a fixed order.

    ``general_feedback`` if none fits.
    """

    def labels(low: Column) -> Column:
        command = F.element_at(F.create_map(*[F.lit(x) for pair in FEEDBACK_COMMANDS.items() for x in pair]), low)
        wrong = contains_any(low, WRONG_TYPE)
        expected = F.coalesce(*[F.when(low.contains(t), f"expected_type:{t}") for t in EXPECTED_TYPES])
        told = [command, F.when(wrong, "wrong_type"), F.when(wrong, expected)]
        told += [F.when(contains_any(low, phrases), label) for label, phrases in FEEDBACK_PHRASES.items()]
        return F.array_distinct(F.array_compact(F.array(*told)))

    found = let(F.lower(clean_feedback(text, bot)), labels)
    return let(found, lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(F.lit("general_feedback"))))


def feedback_profile(rows: DataFrame, labels: str) -> DataFrame:
    """One row: label counts and the preferences that follow; preferred_types are the three types expected most, ties by name."""
    n = lambda label: F.count(F.when(F.array_contains(labels, label), 1))
    counted = [*FEEDBACK_PHRASES, "wrong_type", "general_feedback"]
    types = F.array(*[F.struct((-n(f"expected_type:{t}")).alias("n"), F.lit(t).alias("t")) for t in EXPECTED_TYPES])
    counts = rows.agg(*[n(label).alias(label) for label in counted], types.alias("_types"))
    c = F.col
    bias = F.when(c("promote_delivery") > c("skip_delivery"), "promote").when(c("skip_delivery") > c("promote_delivery"), "suppress").otherwise("neutral")
    return counts.select(
        *counted,
        (c("weak_source") >= 2).alias("strict_source_review"),
        (c("stale") >= 1).alias("prefer_freshness"),
        (c("want_more_depth") >= 1).alias("prefer_depth"),
        (c("founder_lens") >= 1).alias("prefer_founder_angle"),
        bias.alias("delivery_bias"),
        F.transform(F.slice(F.array_sort(F.filter("_types", lambda x: x["n"] < 0)), 1, 3), lambda x: x["t"]).alias("preferred_types"),
    )


def message_warnings(text: Column, limit: int = 4096) -> Column:
    """Codes of what is wrong with an HTML message, joined by commas in a fixed order."""
    t = F.coalesce(text, F.lit(""))
    occurrences = lambda part: (F.length(t) - F.length(F.replace(t, F.lit(part), F.lit("")))) / len(part)
    tests = [
        ("missing_or_wrong_header", ~F.trim(t).startswith("<b>")),
        ("markdown_links_present", t.rlike("\\[[^\\]]+\\]\\(https?://[^)]+\\)")),
        ("br_tag_present", F.lower(t).contains("<br")),
        ("message_too_long", F.length(t) > limit),
        ("separator_style_present", t.contains("\n---") | F.trim(t).startswith("---")),
        ("unbalanced_bold_tags", occurrences("<b>") != occurrences("</b>")),
        ("unbalanced_anchor_tags", occurrences("<a href=") != occurrences("</a>")),
    ]
    return F.concat_ws(",", *[F.when(test, code) for code, test in tests])


def retention_plan(files: DataFrame, group: str, age: Column, newest: list[Column], keep_latest: int, max_age: float, preserved: Column) -> DataFrame:
    """Each file with rank in its group and action: keep if preserved, or among the newest and young enough; else move."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*newest))
    keep = F.coalesce(preserved, F.lit(False)) | ((F.col("place") <= keep_latest) & (age <= max_age))
    return files.withColumn("place", place).withColumn("action", F.when(keep, "keep").otherwise("move"))


def lane_memo(rows: DataFrame, lane: str, order: list[Column], overall: int = 6, each: int = 3) -> DataFrame:
    """The ``overall`` best rows, and the ``each`` best of each lane: (section, place, ...)."""
    top = rows.orderBy(*order).limit(overall).withColumn("place", F.row_number().over(Window.orderBy(*order))).withColumn("section", F.lit("overall"))
    lanes = top_per_group(rows, [lane], order, each).withColumn("section", F.col(lane))
    return top.unionByName(lanes.select(*top.columns))
