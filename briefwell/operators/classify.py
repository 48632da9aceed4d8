"""Scoring of articles beside a model: fallbacks, its landed answers, boosts and penalties with a ledger, lanes, breakdowns.

A row carries total_score, base_total_score, analysis_tier (deep, basic, skip) and applied_adjustments; each step moves the
total within 0 to 100 and writes what it did to the ledger.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import keywords as K
from ..functions.text import contains_any, is_false
from .routing import route
from .scoring import clamp, relevance_level, split_components
from .signals import LANE_ALIASES, flag, is_github, low, with_absent, with_signals

LEDGER = "array<struct<kind:string,reason:string,delta:int,before:int,after:int>>"
#: Columns that the steps read; absent ones count as null.
KINDS = {
    "title": "string", "content": "string", "snippet": "string", "summary_vi": "string", "source_domain": "string", "source_tier": "string", "source_kind": "string", "freshness_bucket": "string", "age_hours": "double", "prefilter_score": "int", "prefilter_reasons": "array<string>",
    "is_ai_relevant": "boolean", "content_available": "boolean", "freshness_unknown": "boolean", "is_stale_candidate": "boolean", "is_old_news": "boolean", "github_full_name": "string", "github_signal_type": "string",
    "source_history_runs": "int", "source_history_bonus": "int", "source_history_penalty": "int", "source_history_noise_rate": "double", "primary_type": "string", "relevance_level": "string", "analysis_tier": "string", "total_score": "int", "applied_adjustments": LEDGER,
}
# Title words of each lane, beside the keyword lists.
HOW_TO_WORDS = ("tutorial", "guide", "tool", "workflow", "tips", "playbook", "how to")
SOCIETY_MORE = ("luật", "pháp lý", "quan ly", "jobs", "workforce")
RELEASE_WORDS = ("launch", "launches", "release", "released", "release notes", "api", "model", "feature", "introduces", "ships", "highlights", "ra mắt", "ra mat", "công bố", "cong bo", "paper", "research", "benchmark", "study")
BASIC_WORDS = ("launch", "release", "feature", "api", "model", "highlights", "recap", "glasses", "workflow", "orchestration", "human-in-the-loop", "clinic", "healthcare", "medical", "observability", "reliability", "incident response", "simulation", "scenario", "local deployment", "private deployment", "on-device", "edge deployment")
DEEP_WORDS = ("model", "api", "agent", "agents", "release", "benchmark")
LANDING_WORDS = ("cập nhật tin", "bao", "báo", "khoa hoc", "khoa học", "cong nghe", "công nghệ")
PRODUCT_WORDS = ("product", "feature", "features", "capability", "capabilities", "release notes", "launch", "launched", "model", "api", "sdk", "glasses", "benchmark")
# Hosts whose product news stays product news, and hosts whose strategic news counts as strong.
PRODUCT_HOSTS = ("openai.com", "anthropic.com", "ai.meta.com", "about.fb.com", "blog.google", "deepmind.google", "huggingface.co", "blogs.microsoft.com", "aws.amazon.com")
STRATEGIC_HOSTS = ("reuters.com", "cnbc.com", "bloomberg.com", "techcrunch.com")
#: Model's score fields and their caps.
COMPONENTS = (("c1_score", 33), ("c2_score", 33), ("c3_score", 34))


def lane_of_title(title: Column) -> Column:
    """The lane that a title's words suggest: practical, then society, then product; else society."""
    t = F.coalesce(title, F.lit(""))
    has = lambda *lists: contains_any(t, [w for words in lists for w in words])
    return F.when(has(HOW_TO_WORDS), "Practical").when(has(K.POLICY_WORDS, K.SOCIETY_WORDS, SOCIETY_MORE), "Society & Culture").when(has(RELEASE_WORDS, K.BUSINESS_WORDS), "Product").otherwise("Society & Culture")


def adjusted(rows: DataFrame, new_total: Column, kind: str, reason: Column) -> DataFrame:
    """total_score moved to ``new_total`` (null: stays), held to 0 to 100; a move is added to applied_adjustments."""
    before = clamp(F.coalesce(F.col("total_score"), F.lit(0)), 0, 100)
    rows = rows.withColumn("_to", F.when(new_total.isNull(), before).otherwise(clamp(new_total, 0, 100)).cast("int"))
    ledger = F.coalesce(F.col("applied_adjustments"), F.array().cast(LEDGER))
    entry = F.struct(F.lit(kind).alias("kind"), reason.alias("reason"), (F.col("_to") - before).cast("int").alias("delta"), before.cast("int").alias("before"), F.col("_to").alias("after"))
    rows = rows.withColumn("applied_adjustments", F.when(F.col("_to") != before, F.concat(ledger, F.array(entry).cast(LEDGER))).otherwise(ledger))
    return rows.withColumn("total_score", F.col("_to")).drop("_to")


def from_components(rows: DataFrame, total: Column, shares: list[Column]) -> DataFrame:
    """c1_score, c2_score, c3_score from ``shares`` (from ``total`` where these are all 0), base_total_score and total_score their sum, and an empty ledger."""
    rows = rows.withColumn("_total", clamp(total, 0, 100)).withColumn("_c", F.array(*[clamp(s, 0, cap).cast("int") for s, (_, cap) in zip(shares, COMPONENTS)]))
    empty = (F.aggregate("_c", F.lit(0), lambda a, x: a + x) <= 0) & (F.col("_total") > 0)
    rows = rows.withColumn("_c", F.when(empty, F.array(*split_components(F.col("_total")))).otherwise(F.col("_c")))
    rows = rows.withColumns({name: F.get("_c", F.lit(k)) for k, (name, _) in enumerate(COMPONENTS)})
    whole = reduce(lambda a, b: a + b, [F.col(name) for name, _ in COMPONENTS]).cast("int")
    return rows.withColumn("base_total_score", whole).withColumn("total_score", whole).withColumn("applied_adjustments", F.array().cast(LEDGER)).drop("_total", "_c")


def held_out(articles: DataFrame) -> DataFrame:
    """Rows that were not scored in depth: a capped score from the prefilter, in components; 20 at most if not relevant, 8 if noise.

    Adds primary_type, c1_score to c3_score, base_total_score, total_score, applied_adjustments, analysis_tier, relevance_level.
    """
    rows = with_absent(articles, KINDS)
    reasons = F.coalesce(F.col("prefilter_reasons"), F.array().cast("array<string>"))
    rows = rows.withColumn("_noise", F.exists(reasons, lambda r: r.startswith("editorial_noise") | r.startswith("blocked_domain") | r.startswith("soft_blocked_domain")))
    related = ~is_false(F.col("is_ai_relevant"))
    strong = ~is_github() & related & ~F.col("_noise") & low("source_tier").isin("a", "b") & low("freshness_bucket").isin("breaking", "fresh", "recent") & flag("content_available")
    rows = rows.withColumn("_strong", strong)
    strong = F.col("_strong")
    prefilter = F.coalesce(F.col("prefilter_score"), F.lit(0))
    rows = rows.withColumn("_held", F.when(strong, clamp(prefilter + 16, 0, 52)).otherwise(clamp(prefilter + 12, 0, 36)))
    held = F.col("_held")
    half, quarter = F.floor(held / 2), F.floor(held / 4)
    shares = [F.least(F.when(strong, 20).otherwise(16), half), F.least(F.when(strong, 16).otherwise(10), quarter), F.least(F.when(strong, 16).otherwise(10), quarter)]
    rows = from_components(rows, held, shares)
    rows = rows.withColumn("primary_type", lane_of_title(F.col("title")))
    rows = rows.withColumn("analysis_tier", F.when(related & ~F.col("_noise") & (held >= F.when(strong, 28).otherwise(24)), "basic").otherwise("skip"))
    rows = adjusted(rows, F.when(~related, F.least(F.col("total_score"), F.lit(20))), "held_out_cap", F.lit("not_ai_cap"))
    rows = adjusted(rows, F.when(F.col("_noise"), F.least(F.col("total_score"), F.lit(8))), "held_out_cap", F.lit("editorial_noise_cap"))
    return rows.withColumn("relevance_level", relevance_level(F.col("total_score"))).drop("_noise", "_strong", "_held")


def failure_fallback(articles: DataFrame, min_score: int = 60) -> DataFrame:
    """Rows whose model call failed: a score from the prefilter, raised for strong tiers, in components; and the tier that follows.

    Adds the columns of held_out().
    """
    rows = with_absent(articles, KINDS)
    prefilter, tier, title = F.coalesce(F.col("prefilter_score"), F.lit(0)), low("source_tier"), F.coalesce(F.col("title"), F.lit(""))
    related = ~is_false(F.col("is_ai_relevant"))
    base = clamp(prefilter + 18, 12, 72)
    raised = F.when(tier == "a", F.least(F.lit(78), base + 6)).when(tier == "b", F.least(F.lit(74), base + 3)).otherwise(base)
    rows = rows.withColumn("_total", F.when(related, raised).otherwise(F.least(raised, F.lit(18))))
    total = F.col("_total")
    basic = related & flag("content_available") & tier.isin("a", "b") & contains_any(title, K.BUSINESS_WORDS + K.POLICY_WORDS + BASIC_WORDS)
    deep = (total >= min_score) | ((tier == "a") & (prefilter >= max(26, min_score - 28)) & contains_any(title, DEEP_WORDS))
    chosen = F.when(~related, "skip").when(deep, "deep").when((total >= max(40, min_score - 20)) | (basic & (total >= max(30, min_score - 30))), "basic").otherwise("skip")
    rows = rows.withColumn("analysis_tier", chosen).withColumn("primary_type", lane_of_title(F.col("title")))
    rows = from_components(rows, total, [F.least(F.lit(33), F.floor(total / 2)), F.least(F.lit(24), F.floor(total / 4)), F.least(F.lit(24), F.floor(total / 4))])
    return rows.withColumn("relevance_level", relevance_level(F.col("total_score"))).drop("_total")


def strategic_boost(rows: DataFrame, min_score: int = 60) -> DataFrame:
    """Strategic titles of strong sources go deep from max(40, min_score - 20) points, with up to 8 more if the content is there."""
    rows = with_absent(rows, KINDS)
    hit = contains_any(F.coalesce(F.col("title"), F.lit("")), K.STRATEGIC_WORDS) & ((low("source_tier") == "a") | low("source_domain").isin(*STRATEGIC_HOSTS))
    rows = rows.withColumn("_hit", hit).withColumn("_near", hit & (F.coalesce(F.col("total_score"), F.lit(0)) >= max(40, min_score - 20)))
    rows = rows.withColumn("primary_type", F.when(F.col("_hit") & F.col("primary_type").isin("Policy", "Policy & Ethics", "Business", "Research"), "Product").otherwise(F.col("primary_type")))
    rows = rows.withColumn("analysis_tier", F.when(F.col("_near"), "deep").otherwise(F.col("analysis_tier")))
    rows = rows.withColumn("relevance_level", F.when(F.col("_near"), F.when(F.col("total_score") >= 55, "High").otherwise(F.coalesce("relevance_level", F.lit("Medium")))).otherwise(F.col("relevance_level")))
    boosted = F.when(F.col("_near") & flag("content_available") & (F.col("total_score") < min_score), F.least(F.lit(min_score), F.col("total_score") + 8))
    return adjusted(rows, boosted, "strategic_boost", F.lit("strong_source_strategic_signal")).drop("_hit", "_near")


def freshness_step(rows: DataFrame, min_score: int = 60) -> DataFrame:
    """freshness_status, and the score and tier that follow: stale and old rows lose points, rows of unknown age from weak or thin sources too, rows of two days gain."""
    rows = with_absent(rows, KINDS)
    score, tier = F.coalesce(F.col("total_score"), F.lit(0)), F.col("analysis_tier")
    unknown = flag("freshness_unknown")
    state = F.when(flag("is_stale_candidate"), "stale_candidate").when(flag("is_old_news"), "old_news").when(unknown & (low("source_tier") == "c"), "unknown_weak_source").when(unknown & ~flag("content_available"), "unknown_thin_content").when(F.col("age_hours") <= 48, "fresh_boost").otherwise("ok")
    rows = rows.withColumn("freshness_status", state)
    is_ = lambda name: F.col("freshness_status") == name
    moved = F.when(is_("stale_candidate"), F.greatest(F.lit(0), score - 25)).when(is_("old_news"), F.greatest(F.lit(0), score - 15)).when(is_("unknown_weak_source"), F.greatest(F.lit(0), score - 12)).when(is_("unknown_thin_content"), F.greatest(F.lit(0), score - 10)).when(is_("fresh_boost"), score + 5)
    rows = adjusted(rows, moved, "freshness", F.col("freshness_status"))
    lower = F.when(tier == "deep", "basic").otherwise(tier)
    tier_after = (
        F.when(is_("stale_candidate"), F.when(F.col("total_score") < min_score + 10, "skip").otherwise("basic"))
        .when(is_("fresh_boost"), F.when((tier == "basic") & (F.col("total_score") >= min_score - 5), "deep").otherwise(tier))
        .when(is_("ok"), tier)
        .otherwise(lower)
    )
    return rows.withColumn("analysis_tier", tier_after).withColumn("relevance_level", relevance_level(F.col("total_score")))


def history_step(rows: DataFrame, min_score: int = 60) -> DataFrame:
    """source_history_adjustment, and the score and tier that follow, from three runs on: noisy community and search sources lose, trusted strong ones gain."""
    rows = with_absent(rows, KINDS)
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    kind = low("source_kind")
    loss = F.least(F.lit(8), n("source_history_penalty") + F.when(n("source_history_noise_rate") >= 0.35, 2).otherwise(0))
    gains = kind.isin("official", "strong_media", "watchlist") & ~flag("is_old_news") & ~flag("is_stale_candidate")
    loses = (n("source_history_penalty") > 0) & kind.isin("community", "search")
    delta = F.when(n("source_history_runs") < 3, 0).when(loses, -loss).when((n("source_history_bonus") > 0) & gains, F.least(F.lit(4), n("source_history_bonus"))).otherwise(0)
    rows = rows.withColumn("source_history_adjustment", delta.cast("int"))
    rows = adjusted(rows, F.when(F.col("source_history_adjustment") != 0, F.coalesce(F.col("total_score"), F.lit(0)) + F.col("source_history_adjustment")), "source_history", F.lit("source_history_adjustment"))
    tier, total, moved = F.col("analysis_tier"), F.col("total_score"), F.col("source_history_adjustment")
    eased = F.when((tier == "deep") & (total < min_score), "basic").otherwise(tier)
    dropped = F.when((eased == "basic") & (total < 28), "skip").otherwise(eased)
    after = F.when(moved < 0, dropped).when((moved > 0) & (tier == "basic") & (total >= max(40, min_score - 4)), "deep").otherwise(tier)
    return rows.withColumn("analysis_tier", after).withColumn("relevance_level", F.when(moved != 0, relevance_level(total)).otherwise(F.col("relevance_level")))


def product_words() -> Column:
    """Whether a text from a host of products has words of products; over rows with the columns of KINDS."""
    text = F.concat_ws(" ", *[F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c)) for c in ("title", "snippet", "summary_vi", "content")])
    return low("source_domain").isin(*PRODUCT_HOSTS) & contains_any(text, PRODUCT_WORDS)


def normalised_lane(rows: DataFrame) -> Column:
    """primary_type put right by title and host; call it on rows that have the columns of KINDS. Rows that bring product_words need no text."""
    title = F.coalesce(F.col("title"), F.lit(""))
    product = F.col("product_words") if "product_words" in rows.columns else product_words()
    now = F.coalesce(F.col("primary_type"), F.lit("Practical"))
    now = F.when(now.isin("Research", "Business"), "Product").when(now.isin("Policy", "Policy & Ethics", "Society"), "Society & Culture").otherwise(now)
    deal = contains_any(title, ("startup", "partnership", "partners with"))
    return (
        F.when(~flag("content_available") & (F.coalesce(F.col("total_score"), F.lit(0)) <= 15) & contains_any(title, LANDING_WORDS), "Practical")
        .when(contains_any(title, ("ecosystem", "hệ sinh thái", "he sinh thai")) & ~deal, "Society & Culture")
        .when(contains_any(title, K.POLICY_WORDS), "Society & Culture")
        .when(product, "Product")
        .when(contains_any(title, K.SOCIETY_WORDS) & (now != "Product") & ~deal, "Society & Culture")
        .otherwise(now)
    )


def finalise(articles: DataFrame) -> DataFrame:
    """Scored rows with score, their lane put right, signals and routing, and why they surfaced or were skipped.

    why_surfaced: the first four prefilter reasons, then moves of the ledger, five in all. why_skipped: the brief's
    reason, then prefilter reasons that count against a row.
    """
    rows = with_absent(articles, KINDS)
    rows = rows.withColumn("score", F.coalesce(F.col("total_score"), F.lit(0))).withColumn("primary_type", normalised_lane(rows))
    rows = route(with_signals(rows))
    reasons = F.coalesce(F.col("prefilter_reasons"), F.array().cast("array<string>"))
    moves = F.transform(F.filter(F.slice(F.coalesce(F.col("applied_adjustments"), F.array().cast(LEDGER)), 1, 4), lambda x: x["delta"] != 0), lambda x: F.concat(x["reason"], F.when(x["delta"] > 0, "+").otherwise(""), x["delta"].cast("string")))
    against = ("editorial_noise", "blocked_domain", "soft_blocked_domain", "not_ai_relevant", "stale", "old_news", "source_history")
    bad = F.filter(reasons, lambda r: reduce(lambda a, b: a | b, [r.startswith(p) for p in against]))
    brief = F.when(F.col("main_brief_skip_reason") != "", F.array(F.concat(F.lit("main_brief:"), F.col("main_brief_skip_reason")))).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("why_surfaced", F.slice(F.concat(F.slice(reasons, 1, 4), moves), 1, 5)).withColumn("why_skipped", F.slice(F.concat(brief, bad), 1, 5)).withColumn("score_display", F.when(F.size(moves) > 0, "adjusted").otherwise("base"))


def apply_answers(articles: DataFrame, answers: DataFrame, min_score: int = 60, id_col: str = "ord") -> DataFrame:
    """Rows with a model's landed answers: fields that are there count, the others are filled in, and the status tells which.

    ``answers``: id and the JSON text of an answer (as repair_json() gives it; null: none). Of several answers for a row the least
    text counts. Rows without one get the failure fallback. Adds the columns of held_out(), classify_json_status
    (valid_json, partial_recovery, hard_fallback), classify_json_missing_fields.
    """
    given = answers.groupBy(F.col(id_col).alias("_id")).agg(F.min("answer").alias("_answer"))
    rows = failure_fallback(articles, min_score).join(given, F.col(id_col) == F.col("_id"), "left")
    field = lambda name: F.trim(F.coalesce(F.get_json_object("_answer", f"$.{name}"), F.lit("")))
    number = lambda name: F.when(field(name) == "", F.lit(0)).otherwise(field(name).try_cast("double").cast("int"))
    answered = F.col("_answer").isNotNull()
    bad_numbers = reduce(lambda a, b: a | b, [number(name).isNull() for name, _ in COMPONENTS])
    clamped = [clamp(F.coalesce(number(name), F.lit(0)), 0, cap).cast("int") for name, cap in COMPONENTS]
    seeded = bad_numbers & (reduce(lambda a, b: a + b, clamped) == 0) & (F.coalesce(F.col("prefilter_score"), F.lit(0)) > 0)
    backup = split_components(clamp(F.coalesce(F.col("prefilter_score"), F.lit(0)) + 18, 12, 72))
    rows = rows.withColumn("_parts", F.when(~answered, F.array(*[F.col(name) for name, _ in COMPONENTS])).when(seeded, F.array(*backup)).otherwise(F.array(*clamped)))
    rows = rows.withColumn("_sum", F.aggregate("_parts", F.lit(0), lambda a, x: a + x))
    tier = F.when(F.lower(field("analysis_tier")).isin("deep", "basic", "skip"), F.lower(field("analysis_tier"))).otherwise(F.when(F.col("_sum") >= min_score, "deep").when(F.col("_sum") >= max(40, min_score - 20), "basic").otherwise("skip"))
    level = F.when(field("relevance_level").isin("High", "Medium", "Low"), field("relevance_level")).otherwise(relevance_level(F.col("_sum")))
    missing = F.filter(
        F.array(
            F.when(~F.lower(field("analysis_tier")).isin("deep", "basic", "skip"), "analysis_tier"),
            *[F.when(number(name).isNull(), name) for name, _ in COMPONENTS],
            F.when(field("primary_type") == "", "primary_type"),
            F.when(~field("relevance_level").isin("High", "Medium", "Low"), "relevance_level"),
            F.when(field("summary_vi") == "", "summary_vi"),
            F.when(field("tags") == "", "tags"),
        ),
        lambda x: x.isNotNull(),
    )
    rows = rows.withColumn("classify_json_missing_fields", F.when(answered, missing).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("classify_json_status", F.when(~answered, "hard_fallback").when(F.size("classify_json_missing_fields") > 0, "partial_recovery").otherwise("valid_json"))
    rows = rows.withColumn("primary_type", F.when(answered & (field("primary_type") != ""), field("primary_type")).otherwise(F.col("primary_type")))
    rows = rows.withColumn("analysis_tier", F.when(answered, tier).otherwise(F.col("analysis_tier"))).withColumn("relevance_level", F.when(answered, level).otherwise(F.col("relevance_level")))
    rows = rows.withColumns({name: F.get("_parts", F.lit(k)) for k, (name, _) in enumerate(COMPONENTS)})
    return rows.withColumn("base_total_score", F.col("_sum").cast("int")).withColumn("total_score", F.col("_sum").cast("int")).drop("_id", "_answer", "_parts", "_sum")


def lane_aliases(kind: Column) -> Column:
    """A model's name of a lane by its present name, null if it is none."""
    first, *rest = LANE_ALIASES.items()
    return reduce(lambda acc, kv: acc.when(F.lower(F.trim(kind)) == kv[0], kv[1]), rest, F.when(F.lower(F.trim(kind)) == first[0], first[1]))


def top_articles(rows: DataFrame, order: list[Column], least: int = 3, most: int = 10) -> DataFrame:
    """The rows at or over the score cut-off, or deep, ``most`` at most; if fewer than ``least`` are, the best as they are.

    Only counts and the cut-off come to the driver.
    """
    from .ranking import score_cutoff

    n, cutoff = score_cutoff(rows, "total_score").first()
    good = rows.filter((F.col("total_score") >= (cutoff or 0)) | (F.lower(F.col("analysis_tier")) == "deep"))
    target = min(max(least, 0), n or 0, most)
    if good.limit(target).count() < target:
        return rows.orderBy(*order).limit(target)
    return good.orderBy(*order).limit(most)
