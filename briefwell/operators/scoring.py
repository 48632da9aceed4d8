"""Rule-based scores: prefilter with reasons, held-out fallback, freshness and history adjustments, ledger, components."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import keywords as K
from ..config import COMPONENT_CAPS, FRESHNESS_POINTS, OFF_TOPIC_WORDS, TIER_POINTS, TOPIC_HOSTS, TOPIC_WORDS
from ..functions.automaton import count_of, words_found
from ..functions.text import falsy, hit_count, is_false, plain_text, unicode_pattern

# Hosts that editors never take, and hosts that they take only for relevant items.
EDITORIAL_BLOCKED, EDITORIAL_SOFT_BLOCKED = ("jingyan.baidu.com",), ("zhihu.com",)


#: Words that the prefilter counts in titles and in surfaces.
TITLE_LISTS = tuple(dict.fromkeys(K.TOPIC_SIGNALS + K.OFF_SCOPE_WORDS))
TEXT_LISTS = tuple(dict.fromkeys(K.STRATEGIC_SIGNALS + K.NOISE_WORDS))


def clamp(c: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def points_of(c: Column, points: dict[str, int]) -> Column:
    first, *rest = points.items()
    return reduce(lambda acc, kv: acc.when(c == kv[0], kv[1]), rest, F.when(c == first[0], first[1])).otherwise(0)


def prefilter_terms(preferences: dict | None = None) -> list[tuple[str, Column]]:
    """(name, points) of the prefilter over article columns; the score is their sum.

    The columns _title_words and _text_words hold the words found in title and surface (see with_prefilter).
    ``preferences`` of the feedback: strict_source_review, prefer_founder_angle, prefer_depth, prefer_freshness (flags)
    and preferred_types (lane names in lower case).
    """
    from .classify import lane_of_title

    likes = preferences or {}
    kind, tier, host, bucket = F.lower(F.coalesce(F.col("source_kind"), F.lit("unknown"))), F.lower(F.coalesce(F.col("source_tier"), F.lit("unknown"))), F.lower(F.coalesce(F.col("source_domain"), F.lit(""))), F.lower(F.coalesce(F.col("freshness_bucket"), F.lit("unknown")))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    significant = flag("github_significant")
    priority = F.when(F.col("source_priority") >= 90, 4).when(F.col("source_priority") >= 82, 3).when(F.col("source_priority") >= 74, 2).when(F.col("source_priority") >= 60, 1).otherwise(0)
    repository = F.when(significant, 2).otherwise(1)
    capped = F.when(kind == "github", F.least(priority, repository)).when(kind == "community", F.least(priority, F.lit(1))).otherwise(priority)
    strength = F.least(F.lit(4), F.coalesce(F.col("community_signal_strength"), F.lit(0)))
    quality = falsy(F.col("source_history_quality_score"), 50)
    known = F.coalesce(F.col("source_history_runs"), F.lit(0)) >= 3
    past = lambda name, most: F.greatest(F.lit(0), F.least(F.lit(most), F.coalesce(F.col(name), F.lit(0))))
    strategic, noise = (count_of(F.col("_text_words"), TEXT_LISTS, words) for words in (K.STRATEGIC_SIGNALS, K.NOISE_WORDS))
    near, off = (count_of(F.col("_title_words"), TITLE_LISTS, words) for words in (K.TOPIC_SIGNALS, K.OFF_SCOPE_WORDS))
    wanted = [w for w in likes.get("preferred_types", ()) if w]
    lane = F.lower(lane_of_title(F.col("title")))
    forms = (lane, F.replace(lane, F.lit(" & culture"), F.lit("")), F.replace(lane, F.lit(" "), F.lit("_")), F.replace(lane, F.lit(" & "), F.lit("_")))
    on = lambda name, test, points: [(name, F.when(test, points).otherwise(0))] if likes.get(name.removeprefix("feedback:")) else []
    return [
        ("tier", points_of(tier, TIER_POINTS)),
        ("source_priority", capped),
        ("source_history_bonus", F.when(known, past("source_history_bonus", 2)).otherwise(0)),
        ("source_history_penalty", F.when(known, -past("source_history_penalty", 6)).otherwise(0)),
        ("source_history_noise", F.when(known & (quality <= 35) & kind.isin("community", "search"), -4).otherwise(0)),
        ("source_noise_rate", F.when(known & (F.coalesce(F.col("source_history_noise_rate"), F.lit(0.0)) >= 0.35), -2).otherwise(0)),
        ("watchlist_hit", F.when(flag("watchlist_hit"), 2).otherwise(0)),
        ("community_signal", F.when(kind == "github", F.least(strength, repository)).otherwise(strength)),
        ("github_generic", F.when((kind == "github") & ~significant, -3).otherwise(0)),
        ("freshness", points_of(bucket, FRESHNESS_POINTS)),
        ("content", F.when(flag("content_available"), 4).otherwise(-3)),
        ("not_news_candidate", F.when(is_false(F.col("is_news_candidate")), -12).otherwise(0)),
        ("verified", F.when(flag("source_verified"), 3).otherwise(0)),
        ("related_history", F.when(F.coalesce(F.size("related_past"), F.lit(0)) > 0, 1).otherwise(0)),
        ("not_ai_relevant", F.when(is_false(F.col("is_ai_relevant")), -20).otherwise(0)),
        ("ai_relevant", F.when(flag("is_ai_relevant"), 4).otherwise(0)),
        ("ai_hits", F.least(F.lit(8), near * 2)),
        ("strategic_hits", F.when(strategic > 0, F.least(F.lit(6), strategic)).otherwise(0)),
        ("no_strategic_signal_c_source", F.when((strategic == 0) & (tier == "c"), -6).otherwise(0)),
        ("offscope", -F.least(F.lit(10), off * 4)),
        ("editorial_noise", F.when(noise > 0, -F.least(F.lit(18), 8 + noise * 3)).otherwise(0)),
        ("blocked_domain", F.when(host.isin(*EDITORIAL_BLOCKED), -30).otherwise(0)),
        ("soft_blocked_domain", F.when(host.isin(*EDITORIAL_SOFT_BLOCKED) & ~flag("is_ai_relevant"), -18).otherwise(0)),
        ("old_news", F.when(flag("is_old_news"), -8).otherwise(0)),
        ("stale", F.when(flag("is_stale_candidate"), -12).otherwise(0)),
        *on("feedback:strict_source_review", tier.isin("c", "unknown"), -2),
        *on("feedback:prefer_founder_angle", flag("watchlist_hit") | (strategic > 0), 2),
        *on("feedback:prefer_depth", flag("content_available") & tier.isin("a", "b"), 1),
        *on("feedback:prefer_freshness", bucket.isin("breaking", "fresh", "recent"), 1),
        *([("feedback:preferred_types", F.when(reduce(lambda a, b: a | b, [f.isin(*wanted) for f in forms]), 1).otherwise(0))] if wanted else []),
    ]


#: Columns that the prefilter reads; absent ones count as null.
PREFILTER_KINDS = {
    "title": "string", "snippet": "string", "url": "string", "source_domain": "string", "source_kind": "string", "source_tier": "string", "freshness_bucket": "string", "source_priority": "int", "content_available": "boolean", "is_old_news": "boolean", "is_stale_candidate": "boolean",
    "source_history_runs": "int", "source_history_bonus": "int", "source_history_penalty": "int", "source_history_quality_score": "int", "source_history_noise_rate": "double", "community_signal_strength": "int", "watchlist_hit": "boolean", "is_news_candidate": "boolean", "is_ai_relevant": "boolean", "source_verified": "boolean",
    "related_past": "array<string>", "github_significant": "boolean",
}


def with_prefilter(articles: DataFrame, preferences: dict | None = None) -> DataFrame:
    """prefilter_score and prefilter_reasons (``name+points`` of every term that counts). Absent columns count as null.

    github_significant is taken from with_signals(), where that ran before.
    """
    whole = articles.withColumns({c: F.lit(None).cast(k) for c, k in PREFILTER_KINDS.items() if c not in articles.columns})
    terms = prefilter_terms(preferences)
    title = F.lower(F.coalesce(F.col("title"), F.lit("")))
    surface = F.lower(F.concat_ws(" ", *[F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c)) for c in ("title", "snippet", "url", "source_domain")]))
    whole = whole.withColumn("_title_words", words_found(title, TITLE_LISTS)).withColumn("_text_words", words_found(surface, TEXT_LISTS))
    whole = whole.withColumn("_p", F.array(*[p.cast("int") for _, p in terms]))
    points = [F.get("_p", F.lit(k)) for k in range(len(terms))]
    reasons = F.filter(F.array(*[F.when(p != 0, F.concat(F.lit(n), F.when(p > 0, "+").otherwise(""), p.cast("string"))) for (n, _), p in zip(terms, points)]), lambda x: x.isNotNull())
    return whole.withColumn("prefilter_score", reduce(lambda a, b: a + b, points)).withColumn("prefilter_reasons", reasons).drop("_p", "_title_words", "_text_words")


def split_components(total: Column, caps: tuple[int, ...] = COMPONENT_CAPS) -> list[Column]:
    """A total split over the caps by largest remainder; ties go to the earlier component."""
    whole = sum(caps)
    points = clamp(total, 0, whole)
    floors = [F.floor(points * cap / whole).cast("int") for cap in caps]
    rests = [(points * cap) % whole for cap in caps]
    left = points - reduce(lambda a, b: a + b, floors)
    ahead = [reduce(lambda a, b: a + b, [(rests[j] > rests[i]).cast("int") if j > i else (rests[j] >= rests[i]).cast("int") for j in range(len(caps)) if j != i]) for i in range(len(caps))]
    return [(f + (a < left).cast("int")).cast("int") for f, a in zip(floors, ahead)]


def relevance_level(score: Column) -> Column:
    return F.when(score >= 70, "High").when(score >= 40, "Medium").otherwise("Low")


def running_ledger(entries: DataFrame, key: str, order: list[Column], delta: str, low: int = 0, high: int = 100) -> DataFrame:
    """Each adjustment with before and after: running sums by key, from 0; the display values are clamped."""
    own = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = F.sum(delta).over(own)
    return entries.withColumn("after", after).withColumn("before", F.col("after") - F.col(delta)).withColumn("shown", clamp(F.col("after"), low, high))


def ai_relevance(host: Column, title: Column, content: Column) -> Column:
    """struct(ai_hits, off_hits, relevant, signals) of the whole title and content: near the topic or not, and why.

    A host of the topic or two hits let an item through, unless two hits of other topics meet fewer than four; a single
    hit does if there is none of other topics.
    """
    whole = F.concat_ws(" ", plain_text(title), plain_text(content))
    ai, off = hit_count(whole, unicode_pattern(TOPIC_WORDS)), hit_count(whole, unicode_pattern(OFF_TOPIC_WORDS))
    known = F.coalesce(host.isin(*TOPIC_HOSTS), F.lit(False))

    def decided(c: Column) -> Column:
        ai, off, known = c["ai_hits"], c["off_hits"], c["known"]
        close, dominated, single = known | (ai >= 2), (off >= 2) & (ai < 4), (ai == 1) & (off == 0)
        verdict = F.when(close & dominated, "blocked:offtopic_dominant").when(close, F.lit(None)).when(single, "borderline_ai_signal").otherwise("blocked:weak_ai_signal")
        hits = [F.when(known, "ai_domain"), F.when(ai > 0, F.concat(F.lit("ai_hits:"), ai)), F.when(off > 0, F.concat(F.lit("off_topic_hits:"), off))]
        return F.struct(ai.alias("ai_hits"), off.alias("off_hits"), F.when(close, ~dominated).otherwise(single).alias("relevant"), F.concat_ws(",", *hits, verdict).alias("signals"))

    return F.get(F.transform(F.array(F.struct(ai.alias("ai_hits"), off.alias("off_hits"), known.alias("known"))), decided), F.lit(0))
