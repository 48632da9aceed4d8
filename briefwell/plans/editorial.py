"""Queries of the editorial rules over whole texts: signals, prefilter, fallbacks, adjustments, routing, judge, selection, gates, delivery."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import keywords as K
from ..operators import classify, reports, routing, scoring, selection, signals
from ..operators.stored import stored
from .adapters import HEADLINED_SQL, headlined
from .registry import query


def hits(words, text: str = "t") -> str:
    """SQL of how many words occur in a text."""
    return "(" + " + ".join("CAST(contains(" + text + ", '" + w.replace("'", "''") + "') AS INT)" for w in words) + ")"


def any_of(words, text: str) -> str:
    return "(" + " OR ".join("contains(" + text + ", '" + w.replace("'", "''") + "')" for w in words) + ")"


def shared(tags) -> str:
    return f"len(list_intersect(tags, [{', '.join(repr(t) for t in tags)}]))"


SIGNALS_SQL = f"""{HEADLINED_SQL}, s0 AS (SELECT *, lower(title || '    ' || coalesce(content, '') || ' ' || source || ' ' || source_domain) AS t, lower(relevance_level) AS fit, freshness_bucket IN ('breaking', 'fresh', 'recent') OR age_hours <= 72 AS fr FROM hl
), s1 AS (SELECT *, {hits(K.NOVELTY_HINTS)} AS h_new, {hits(K.OPERATOR_HINTS)} AS h_op, {hits(K.ADOPTION_HINTS)} AS h_ad, {hits(K.GITHUB_NOISE_HINTS)} AS h_no, {hits(K.SOCIETY_ECOSYSTEM_HINTS)} AS h_ec, {hits(K.CONSEQUENCE_HINTS)} AS h_co, {hits(K.SOCIETY_FILLER_HINTS)} AS h_fi, {hits(K.PROMO_HINTS)} AS h_pr, {hits(K.SPECULATION_HINTS)} AS h_sp,
  {shared(K.ACTIONABLE_TAGS)} AS g_ac, {shared(K.GITHUB_TAGS)} AS g_gi, {shared(K.ECOSYSTEM_TAGS)} AS g_ec, {shared(K.CONSEQUENCE_TAGS)} AS g_co, {shared(K.PROXY_TAGS)} AS g_px FROM s0
), s2 AS (SELECT *, g_ac + least(3, h_op) + CASE fit WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END + CAST(content_available AS INT) + CAST(source_verified AS INT) AS op, least(3, h_new) + CAST(fr AS INT) + CAST(watchlist_hit AS INT) + CAST(github_signal_type IS NOT DISTINCT FROM 'release' AS INT) AS nv,
  g_ec + least(3, h_ec) + CAST(fit = 'high' AS INT) AS ec, g_co + least(3, h_co) + CAST(source_kind IN ('official', 'strong_media') AS INT) AS co, github_owner IS NOT NULL AS gh, coalesce(github_owner IN ('openai', 'nvidia', 'vercel'), false) AS major, primary_type = 'Society & Culture' AS soc FROM s1
), s3 AS (SELECT *, CASE WHEN github_stars >= 5000 THEN 2 WHEN github_stars >= 1500 THEN 1 ELSE 0 END + CAST(watchlist_hit AS INT) + CAST(event_source_count >= 2 AS INT) + least(2, h_ad) + CAST(major AS INT) AS reach FROM s2
), s4 AS (SELECT *, gh AND NOT (h_no > 0 AND h_ad = 0 AND github_stars < 8000) AND g_gi >= 2 AND h_op >= 4 AND ((github_signal_type = 'release' AND major AND (h_new >= 1 OR h_ad >= 2 OR reach >= 4)) OR ((h_ad >= 2 OR reach >= 4) AND h_new >= 1)) AS sig,
  soc AND g_ec = 0 AND h_fi > 0 AS fil, CASE WHEN source_kind = 'regional_media' AND g_px + least(2, h_new) > 0 THEN CASE WHEN source_verified THEN 4 ELSE 5 END ELSE 0 END AS px, h_pr > 0 AS promo, source_kind IN ('community', 'github') AND h_sp > 0 AS spec, fr AND NOT is_stale_candidate AND NOT is_old_news AS fresh, ec >= 3 OR op >= 5 OR co >= 2 AS impact FROM s3
), sg AS (SELECT *, soc AND NOT impact AND (fil OR (op < 5 AND co < 2)) AS weak FROM s4)"""


@query(f"+ {SIGNALS_SQL} SELECT ord, CAST(op AS INT) AS operator_strength, CAST(nv AS INT) AS novelty_strength, CAST(ec AS INT) AS ecosystem_strength, CAST(co AS INT) AS consequence_strength, sig AS github_significant, fil AS society_filler, weak AS weak_society, impact AS ecosystem_impact, CAST(px AS INT) AS proxy_penalty, promo, spec AS speculation, fresh AS fresh_signal, fit AS project_fit FROM sg")
def article_signals(spark, d):
    return signals.with_signals(headlined(spark, d)).select("ord", "operator_strength", "novelty_strength", "ecosystem_strength", "consequence_strength", "github_significant", "society_filler", "weak_society", "ecosystem_impact", F.col("proxy_penalty").cast("int").alias("proxy_penalty"), "promo", "speculation", "fresh_signal", "project_fit")


# --- prefilter and fallbacks ---------------------------------------------------------------------------------------

TITLE = "lower(title)"
SURFACE = "lower(title || ' ' || url || ' ' || source_domain)"
LANE_SQL = f"CASE WHEN {any_of(classify.HOW_TO_WORDS, TITLE)} THEN 'Practical' WHEN {any_of(K.POLICY_WORDS + K.SOCIETY_WORDS + classify.SOCIETY_MORE, TITLE)} THEN 'Society & Culture' WHEN {any_of(classify.RELEASE_WORDS + K.BUSINESS_WORDS, TITLE)} THEN 'Product' ELSE 'Society & Culture' END"
PREFILTER_SQL = f"""p0 AS (SELECT *, {hits(K.TOPIC_SIGNALS, TITLE)} AS k_ai, {hits(K.STRATEGIC_SIGNALS, SURFACE)} AS k_st, {hits(K.OFF_SCOPE_WORDS, TITLE)} AS k_off, {hits(K.NOISE_WORDS, SURFACE)} AS k_no, {LANE_SQL} AS lane_guess FROM sg
), p1 AS (SELECT *, CASE source_tier WHEN 'a' THEN 10 WHEN 'b' THEN 7 WHEN 'c' THEN 3 ELSE 1 END AS x_tier,
  CASE WHEN source_kind = 'github' THEN least(pr, CASE WHEN sig THEN 2 ELSE 1 END) WHEN source_kind = 'community' THEN least(pr, 1) ELSE pr END AS x_pr, CASE WHEN watchlist_hit THEN 2 ELSE 0 END AS x_wa,
  CASE WHEN source_kind = 'github' THEN least(4, community_signal_strength, CASE WHEN sig THEN 2 ELSE 1 END) ELSE least(4, community_signal_strength) END AS x_co, CASE WHEN source_kind = 'github' AND NOT sig THEN -3 ELSE 0 END AS x_ge,
  CASE freshness_bucket WHEN 'breaking' THEN 10 WHEN 'fresh' THEN 8 WHEN 'recent' THEN 5 WHEN 'aging' THEN -3 WHEN 'stale' THEN -8 ELSE 0 END AS x_fr, CASE WHEN content_available THEN 4 ELSE -3 END AS x_te, CASE WHEN is_news_candidate = false THEN -12 ELSE 0 END AS x_ne, CASE WHEN source_verified THEN 3 ELSE 0 END AS x_ve,
  CASE WHEN is_ai_relevant = false THEN -20 ELSE 0 END AS x_na, CASE WHEN is_ai_relevant THEN 4 ELSE 0 END AS x_ai, least(8, k_ai * 2) AS x_hi, least(6, k_st) AS x_st, CASE WHEN k_st = 0 AND source_tier = 'c' THEN -6 ELSE 0 END AS x_ns,
  -least(10, k_off * 4) AS x_of, CASE WHEN k_no > 0 THEN -least(18, 8 + k_no * 3) ELSE 0 END AS x_no, CASE WHEN is_old_news THEN -8 ELSE 0 END AS x_ol, CASE WHEN is_stale_candidate THEN -12 ELSE 0 END AS x_sa
  FROM (SELECT *, CASE WHEN source_priority >= 90 THEN 4 WHEN source_priority >= 82 THEN 3 WHEN source_priority >= 74 THEN 2 WHEN source_priority >= 60 THEN 1 ELSE 0 END AS pr FROM p0)
), pf AS (SELECT *, CAST(x_tier + x_pr + x_wa + x_co + x_ge + x_fr + x_te + x_ne + x_ve + x_na + x_ai + x_hi + x_st + x_ns + x_of + x_no + x_ol + x_sa AS INT) AS prefilter_score FROM p1)"""
TERM_NAMES = {"x_tier": "tier", "x_pr": "source_priority", "x_wa": "watchlist_hit", "x_co": "community_signal", "x_ge": "github_generic", "x_fr": "freshness", "x_te": "content", "x_ne": "not_news_candidate", "x_ve": "verified", "x_na": "not_ai_relevant", "x_ai": "ai_relevant", "x_hi": "ai_hits", "x_st": "strategic_hits", "x_ns": "no_strategic_signal_c_source", "x_of": "offscope", "x_no": "editorial_noise", "x_ol": "old_news", "x_sa": "stale"}
REASONS_SQL = "list_filter([" + ", ".join(f"CASE WHEN {c} <> 0 THEN '{n}' || CASE WHEN {c} > 0 THEN '+' ELSE '' END || CAST({c} AS VARCHAR) END" for c, n in TERM_NAMES.items()) + "], lambda z: z IS NOT NULL)"


def prefiltered(spark, d) -> DataFrame:
    return scoring.with_prefilter(signals.with_signals(headlined(spark, d)))


@query(f"+ {SIGNALS_SQL}, {PREFILTER_SQL} SELECT ord, prefilter_score, array_to_string({REASONS_SQL}, ',') AS reasons FROM pf")
def prefilter_score(spark, d):
    return prefiltered(spark, d).select("ord", "prefilter_score", F.concat_ws(",", "prefilter_reasons").alias("reasons"))


@query(f"""+ {SIGNALS_SQL}, {PREFILTER_SQL} SELECT ord, prefilter_score + CASE WHEN source_tier IN ('c', 'unknown') THEN -2 ELSE 0 END + CASE WHEN watchlist_hit OR k_st > 0 THEN 2 ELSE 0 END + CASE WHEN content_available AND source_tier IN ('a', 'b') THEN 1 ELSE 0 END + CASE WHEN freshness_bucket IN ('breaking', 'fresh', 'recent') THEN 1 ELSE 0 END + CASE WHEN lane_guess IN ('Product', 'Society & Culture') THEN 1 ELSE 0 END AS prefilter_score FROM pf""")
def prefilter_with_feedback(spark, d):
    likes = {"strict_source_review": True, "prefer_founder_angle": True, "prefer_depth": True, "prefer_freshness": True, "preferred_types": ["product", "society"]}
    return scoring.with_prefilter(signals.with_signals(headlined(spark, d)), likes).select("ord", "prefilter_score")


@query(f"+ {HEADLINED_SQL} SELECT ord, {LANE_SQL} AS lane FROM hl")
def title_lane(spark, d):
    return headlined(spark, d).select("ord", classify.lane_of_title(F.col("title")).alias("lane"))


#: c1 to c3 of a total by largest remainder, for totals whose parts would all be 0.
SPLIT_SQL = "CAST(floor(z * 33 / 100) AS INT) + CASE WHEN z * 33 % 100 > 0 AND z - z * 33 // 100 - z * 33 // 100 - z * 34 // 100 > {before} THEN 1 ELSE 0 END"


@query(f"""+ {SIGNALS_SQL}, {PREFILTER_SQL}, h0 AS (SELECT *, coalesce(is_ai_relevant, true) AS rel, k_no > 0 AS noise FROM pf
), h1 AS (SELECT *, NOT gh AND rel AND NOT noise AND source_tier IN ('a', 'b') AND freshness_bucket IN ('breaking', 'fresh', 'recent') AND content_available AS strong FROM h0
), h2 AS (SELECT *, CASE WHEN strong THEN greatest(0, least(52, prefilter_score + 16)) ELSE greatest(0, least(36, prefilter_score + 12)) END AS held FROM h1
), h3 AS (SELECT *, least(CASE WHEN strong THEN 20 ELSE 16 END, held // 2) + 2 * least(CASE WHEN strong THEN 16 ELSE 10 END, held // 4) AS parts FROM h2
), h4 AS (SELECT *, CASE WHEN parts = 0 THEN held ELSE parts END AS base FROM h3
), h5 AS (SELECT *, CASE WHEN noise THEN least(8, CASE WHEN rel THEN base ELSE least(base, 20) END) WHEN rel THEN base ELSE least(base, 20) END AS total FROM h4)
SELECT ord, lane_guess AS primary_type, CAST(base AS INT) AS base_total_score, CAST(total AS INT) AS total_score, CASE WHEN rel AND NOT noise AND held >= CASE WHEN strong THEN 28 ELSE 24 END THEN 'basic' ELSE 'skip' END AS analysis_tier, CASE WHEN total >= 70 THEN 'High' WHEN total >= 40 THEN 'Medium' ELSE 'Low' END AS relevance_level FROM h5""")
def held_out_fallback(spark, d):
    return classify.held_out(prefiltered(spark, d)).select("ord", "primary_type", "base_total_score", "total_score", "analysis_tier", "relevance_level")


FAILED_SQL = f"""f0 AS (SELECT *, coalesce(is_ai_relevant, true) AS rel, greatest(12, least(72, prefilter_score + 18)) AS fb FROM pf
), f1 AS (SELECT *, CASE source_tier WHEN 'a' THEN least(78, fb + 6) WHEN 'b' THEN least(74, fb + 3) ELSE fb END AS up FROM f0
), f2 AS (SELECT *, CASE WHEN rel THEN up ELSE least(up, 18) END AS ft FROM f1
), f3 AS (SELECT *, CASE WHEN NOT rel THEN 'skip' WHEN ft >= 60 OR (source_tier = 'a' AND prefilter_score >= 32 AND {any_of(classify.DEEP_WORDS, TITLE)}) THEN 'deep'
  WHEN ft >= 40 OR (rel AND content_available AND source_tier IN ('a', 'b') AND {any_of(K.BUSINESS_WORDS + K.POLICY_WORDS + classify.BASIC_WORDS, TITLE)} AND ft >= 30) THEN 'basic' ELSE 'skip' END AS ftier, least(33, ft // 2) AS fc1, least(24, ft // 4) AS fc2 FROM f2
), fl AS (SELECT *, CAST(fc1 + 2 * fc2 AS INT) AS fsum FROM f3)"""


@query(f"+ {SIGNALS_SQL}, {PREFILTER_SQL}, {FAILED_SQL} SELECT ord, lane_guess AS primary_type, CAST(fc1 AS INT) AS c1_score, CAST(fc2 AS INT) AS c2_score, fsum AS total_score, ftier AS analysis_tier FROM fl")
def failure_fallback(spark, d):
    return classify.failure_fallback(prefiltered(spark, d)).select("ord", "primary_type", "c1_score", "c2_score", "total_score", "analysis_tier")


# --- adjustments ---------------------------------------------------------------------------------------------------

TIERED = "CASE WHEN total_score >= 66 THEN 'deep' WHEN total_score >= 33 THEN 'basic' ELSE 'skip' END"


def tiered(spark, d) -> DataFrame:
    """Headlined articles with a tier by score and a past by source."""
    s = F.col("total_score")
    tier = F.when(s >= 66, "deep").when(s >= 33, "basic").otherwise("skip")
    n = F.col("ord")
    past = {"source_history_runs": n % 5, "source_history_bonus": n % 4 * 2, "source_history_penalty": n % 3 * 7, "source_history_noise_rate": (n % 10) / 10}
    return headlined(spark, d).withColumn("analysis_tier", tier).withColumns({c: v.cast("double" if c.endswith("rate") else "int") for c, v in past.items()})


@query(f"""+ {HEADLINED_SQL}, b0 AS (SELECT *, {TIERED} AS tier, {any_of(K.STRATEGIC_WORDS, TITLE)} AND source_tier = 'a' AND total_score >= 40 AS near FROM hl)
SELECT ord, CASE WHEN near AND content_available AND total_score < 60 THEN least(60, total_score + 8) ELSE total_score END AS total_score, CASE WHEN near THEN 'deep' ELSE tier END AS analysis_tier,
  CASE WHEN near THEN CASE WHEN total_score >= 55 THEN 'High' ELSE relevance_level END ELSE relevance_level END AS relevance_level FROM b0""")
def strategic_boost(spark, d):
    return classify.strategic_boost(tiered(spark, d)).select("ord", "total_score", "analysis_tier", "relevance_level")


@query(f"""+ {HEADLINED_SQL}, b0 AS (SELECT *, {TIERED} AS tier, CASE WHEN is_stale_candidate THEN 'stale_candidate' WHEN is_old_news THEN 'old_news' WHEN freshness_unknown AND source_tier = 'c' THEN 'unknown_weak_source' WHEN freshness_unknown AND NOT content_available THEN 'unknown_thin_content' WHEN age_hours <= 48 THEN 'fresh_boost' ELSE 'ok' END AS st FROM hl
), b1 AS (SELECT *, greatest(0, least(100, total_score + CASE st WHEN 'stale_candidate' THEN -25 WHEN 'old_news' THEN -15 WHEN 'unknown_weak_source' THEN -12 WHEN 'unknown_thin_content' THEN -10 WHEN 'fresh_boost' THEN 5 ELSE 0 END)) AS after FROM b0)
SELECT ord, st AS freshness_status, CAST(after AS INT) AS total_score, CAST(after - total_score AS INT) AS delta, CASE st WHEN 'stale_candidate' THEN CASE WHEN after < 70 THEN 'skip' ELSE 'basic' END WHEN 'fresh_boost' THEN CASE WHEN tier = 'basic' AND after >= 55 THEN 'deep' ELSE tier END WHEN 'ok' THEN tier ELSE CASE WHEN tier = 'deep' THEN 'basic' ELSE tier END END AS analysis_tier FROM b1""")
def freshness_penalty(spark, d):
    delta = F.coalesce(F.get("applied_adjustments", F.lit(0))["delta"], F.lit(0))
    return classify.freshness_step(tiered(spark, d)).select("ord", "freshness_status", "total_score", delta.alias("delta"), "analysis_tier")


@query(f"""+ {HEADLINED_SQL}, b0 AS (SELECT *, {TIERED} AS tier, CASE WHEN ord % 5 < 3 THEN 0 WHEN ord % 3 * 7 > 0 AND source_kind IN ('community', 'search') THEN -least(8, ord % 3 * 7 + CASE WHEN ord % 10 >= 4 THEN 2 ELSE 0 END) WHEN ord % 4 * 2 > 0 AND source_kind IN ('official', 'strong_media', 'watchlist') AND NOT is_old_news AND NOT is_stale_candidate THEN least(4, ord % 4 * 2) ELSE 0 END AS adj FROM hl
), b1 AS (SELECT *, greatest(0, least(100, total_score + adj)) AS after FROM b0)
SELECT ord, CAST(adj AS INT) AS adjustment, CAST(after AS INT) AS total_score, CASE WHEN adj < 0 THEN CASE WHEN (tier = 'basic' OR (tier = 'deep' AND after < 60)) AND after < 28 THEN 'skip' WHEN tier = 'deep' AND after < 60 THEN 'basic' ELSE tier END WHEN adj > 0 AND tier = 'basic' AND after >= 56 THEN 'deep' ELSE tier END AS analysis_tier FROM b1""")
def history_adjustment(spark, d):
    return classify.history_step(tiered(spark, d)).select("ord", F.col("source_history_adjustment").alias("adjustment"), "total_score", "analysis_tier")


WHOLE = "lower(title || ' ' || coalesce(content, ''))"


RIGHT_SQL = f"""CASE WHEN NOT content_available AND total_score <= 15 AND {any_of(classify.LANDING_WORDS, TITLE)} THEN 'Practical'
  WHEN {any_of(("ecosystem", "hệ sinh thái", "he sinh thai"), TITLE)} AND NOT {any_of(("startup", "partnership", "partners with"), TITLE)} THEN 'Society & Culture' WHEN {any_of(K.POLICY_WORDS, TITLE)} THEN 'Society & Culture'
  WHEN {any_of(K.SOCIETY_WORDS, TITLE)} AND primary_type <> 'Product' AND NOT {any_of(("startup", "partnership", "partners with"), TITLE)} THEN 'Society & Culture' ELSE primary_type END"""


@query(f"+ {HEADLINED_SQL} SELECT ord, {RIGHT_SQL} AS primary_type FROM hl")
def lane_put_right(spark, d):
    rows = signals.with_absent(headlined(spark, d), classify.KINDS)
    return rows.select("ord", classify.normalised_lane(rows).alias("primary_type"))


@query(f"""+ {SIGNALS_SQL}, {PREFILTER_SQL}, {FAILED_SQL}, q0 AS (SELECT *, CASE ord % 3 WHEN 0 THEN NULL ELSE least(33, CAST(ord % 40 AS INT)) END AS a1, CASE ord % 3 WHEN 1 THEN least(33, CAST(ord % 29 AS INT)) ELSE 0 END AS a2 FROM fl)
SELECT ord, CASE WHEN ord % 3 = 0 THEN fsum ELSE CAST(a1 + a2 AS INT) END AS total_score, CASE ord % 3 WHEN 0 THEN 'hard_fallback' WHEN 1 THEN 'valid_json' ELSE 'partial_recovery' END AS status,
  CASE ord % 3 WHEN 2 THEN 'analysis_tier,relevance_level,summary_vi,tags' ELSE '' END AS missing, CASE ord % 3 WHEN 0 THEN ftier WHEN 1 THEN 'deep' ELSE CASE WHEN a1 >= 60 THEN 'deep' WHEN a1 >= 40 THEN 'basic' ELSE 'skip' END END AS analysis_tier, CASE ord % 3 WHEN 0 THEN lane_guess ELSE 'Practical' END AS primary_type FROM q0""")
def model_answers(spark, d):
    """Landed answers: none, whole ones, and ones that lack fields."""
    n = F.col("ord")
    rows = prefiltered(spark, d)
    whole = F.to_json(F.struct(F.lit("Practical").alias("primary_type"), (n % 40).alias("c1_score"), (n % 29).cast("string").alias("c2_score"), F.lit(0).alias("c3_score"), F.lit("deep").alias("analysis_tier"), F.lit("High").alias("relevance_level"), F.lit("x").alias("summary_vi"), F.array(F.lit("safety")).alias("tags")))
    part = F.to_json(F.struct(F.lit("Practical").alias("primary_type"), (n % 40).alias("c1_score")))
    answers = rows.filter(n % 3 != 0).select("ord", F.when(n % 3 == 1, whole).otherwise(part).alias("answer"))
    return classify.apply_answers(rows, answers).select("ord", "total_score", F.col("classify_json_status").alias("status"), F.concat_ws(",", "classify_json_missing_fields").alias("missing"), "analysis_tier", "primary_type")


# --- routing, judge and selection ----------------------------------------------------------------------------------

MOVES_SQL = [
    ("fresh", "4", "fresh_signal"), ("fit = 'high'", "3", "fit:high"), ("fit = 'medium'", "1", "fit:medium"), ("fit NOT IN ('high', 'medium')", "-2", "fit:low"), ("op >= 6", "6", "operator_value:strong"), ("op BETWEEN 3 AND 5", "2", "operator_value:ok"), ("op < 3", "-6", "operator_value:low"),
    ("nv >= 4", "4", "novelty:strong"), ("nv BETWEEN 2 AND 3", "1", "novelty:ok"), ("freshness_unknown", "-3", "time:unknown"), ("NOT content_available", "-4", "content:thin"), ("source_kind IN ('official', 'watchlist')", "6", "source_advantage:official"), ("source_kind = 'strong_media'", "4", "source_advantage:strong_media"),
    ("source_kind = 'regional_media'", "-2", "source_advantage:regional"), ("px > 0", "-px - 2", "source_penalty:proxy"),
]
CODES_SQL = [f"CASE WHEN {test} THEN '{code}' END" for test, _, code in MOVES_SQL] + [
    "CASE WHEN px > 0 THEN 'source_penalty:proxy_strict' END", "CASE WHEN source_kind = 'github' THEN CASE WHEN sig THEN 'github_significant' ELSE 'github_capped' END END", "CASE WHEN source_kind = 'github' AND NOT sig THEN 'github_low_impact' END", "CASE WHEN source_kind = 'community' THEN 'community_capped' END",
    "CASE WHEN met AND weak THEN CASE WHEN fil THEN 'society_filler' ELSE 'society_low_consequence' END END", "CASE WHEN met AND NOT weak AND soc AND co >= 2 THEN 'society_high_consequence' END", "CASE WHEN met AND NOT weak AND soc AND soc_in THEN 'society_ecosystem_implication' END",
    "CASE WHEN met AND NOT weak AND NOT soc AND px > 0 AND px_in THEN 'proxy_exception:high_operator_value' END", "CASE WHEN met AND NOT weak AND NOT soc AND px = 0 AND gh AND gh_in THEN 'github_main_brief_candidate' END",
]
ROUTED_SQL = f"""{SIGNALS_SQL}, r0 AS (SELECT *, total_score + {" + ".join(f"CASE WHEN {test} THEN {points} ELSE 0 END" for test, points, _ in MOVES_SQL)} AS base, is_stale_candidate OR is_old_news AS old, coalesce(NOT is_ai_relevant, false) AS na FROM sg
), r1 AS (SELECT *, CASE WHEN source_kind = 'github' THEN CASE WHEN sig THEN least(base + 2, 76) ELSE least(base, 44) END WHEN source_kind = 'community' THEN least(base, CASE WHEN op >= 4 AND nv >= 3 THEN 56 ELSE 44 END) ELSE base END AS raw, NOT (na OR old OR promo OR spec) AS met, ec >= 2 OR impact AS soc_in FROM r0
), r2 AS (SELECT *, op >= 6 AND raw >= 68 AND fresh AS px_in, sig AND op >= 5 AND nv >= 3 AND fresh AND raw >= 64 AS gh_in, op >= 4 AND nv >= 3 AND fresh AND total_score >= 52 AS com_in, greatest(total_score, raw) AS best,
  CASE WHEN gh THEN 74 ELSE CASE source_kind WHEN 'official' THEN 50 WHEN 'watchlist' THEN 52 WHEN 'strong_media' THEN 56 WHEN 'regional_media' THEN 68 WHEN 'search' THEN 64 ELSE 62 END END AS e1, CASE WHEN gh THEN 68 ELSE CASE source_kind WHEN 'official' THEN 42 WHEN 'watchlist' THEN 44 WHEN 'strong_media' THEN 48 WHEN 'regional_media' THEN 62 WHEN 'search' THEN 56 ELSE 54 END END AS e2,
  CASE WHEN gh THEN 6 ELSE CASE source_kind WHEN 'official' THEN 4 WHEN 'watchlist' THEN 4 WHEN 'strong_media' THEN 4 WHEN 'regional_media' THEN 6 ELSE 5 END END AS e3 FROM r1
), r3 AS (SELECT *, CASE WHEN soc THEN greatest(e1, CASE WHEN co >= 2 THEN 68 ELSE 72 END) ELSE e1 END + CASE WHEN px > 0 THEN 4 ELSE 0 END AS t1, CASE WHEN soc THEN greatest(e2, CASE WHEN co >= 2 THEN 60 ELSE 64 END) ELSE e2 END + CASE WHEN px > 0 THEN 4 ELSE 0 END AS t2, greatest(e3, CASE WHEN soc THEN 5 ELSE 0 END, CASE WHEN px > 0 THEN 6 ELSE 0 END) AS t3,
  CASE WHEN na THEN 'not_ai' WHEN old THEN 'stale' WHEN promo THEN 'promo' WHEN spec THEN 'speculation' WHEN weak THEN 'weak' WHEN soc THEN CASE WHEN soc_in THEN 'main' ELSE 'soc' END WHEN px > 0 THEN CASE WHEN px_in THEN 'main' ELSE 'px' END WHEN gh THEN CASE WHEN gh_in THEN 'main' ELSE 'gh' END WHEN source_kind = 'community' THEN CASE WHEN com_in THEN 'main' ELSE 'com' END ELSE 'main' END AS c FROM r2
), r AS (SELECT *, CASE c WHEN 'main' THEN 'main' WHEN 'gh' THEN 'github' ELSE 'archive_only' END AS lane,
  CASE c WHEN 'main' THEN CASE WHEN raw >= t1 AND op >= t3 THEN 'eligible' WHEN raw >= t2 THEN 'review' ELSE 'ineligible' END WHEN 'soc' THEN CASE WHEN best >= 60 THEN 'review' ELSE 'ineligible' END WHEN 'px' THEN CASE WHEN best >= 64 THEN 'review' ELSE 'ineligible' END WHEN 'gh' THEN CASE WHEN total_score >= 40 THEN 'review' ELSE 'ineligible' END WHEN 'com' THEN CASE WHEN total_score >= 44 THEN 'review' ELSE 'ineligible' END ELSE 'ineligible' END AS elig,
  CASE c WHEN 'main' THEN CASE WHEN raw >= t1 AND op >= t3 THEN '' WHEN op < t3 THEN 'low_operator_value' ELSE 'weak_signal' END WHEN 'soc' THEN CASE WHEN op >= 5 OR ec >= 1 THEN 'low_operator_value' ELSE 'weak_signal' END WHEN 'px' THEN CASE WHEN op >= 5 THEN 'low_operator_value' ELSE 'weak_signal' END WHEN 'gh' THEN CASE WHEN total_score >= 40 THEN 'github_topic_only' ELSE 'weak_signal' END WHEN 'com' THEN CASE WHEN total_score >= 44 THEN 'low_operator_value' ELSE 'weak_signal' END WHEN 'weak' THEN 'weak_signal' ELSE c END AS reason,
  CAST(greatest(0, least(100, raw)) AS INT) AS mb, list_filter(['source_kind:' || source_kind, {", ".join(CODES_SQL)}], lambda z: z IS NOT NULL)[1:12] AS codes FROM r3)"""


#: The same over lanes put right.
FINAL_SQL = ROUTED_SQL.replace("FROM hl\n), s1", f"FROM (SELECT * REPLACE ({RIGHT_SQL} AS primary_type) FROM hl)\n), s1")


def routed(spark, d) -> DataFrame:
    """Routed articles; signals are written first, which cuts the nested rules into two plans."""
    return routing.route(stored(signals.with_signals(headlined(spark, d)).drop("content"), "signals"))


@query(f"+ {ROUTED_SQL} SELECT ord, lane AS delivery_lane_candidate, elig AS main_brief_eligibility, mb AS main_brief_score, reason AS main_brief_skip_reason, array_to_string(codes, ',') AS codes FROM r")
def routing_policy(spark, d):
    return routed(spark, d).select("ord", "delivery_lane_candidate", "main_brief_eligibility", "main_brief_score", "main_brief_skip_reason", F.concat_ws(",", "main_brief_reason_codes").alias("codes"))


def judged(spark, d) -> DataFrame:
    rows = stored(routed(spark, d), "routed")
    sure = routing.confidence(F.col("total_score"), F.col("content_available"), F.col("source_tier"))
    return routing.judge(rows.withColumn("confidence_label", sure).withColumn("event_cluster_size", (F.col("ord") % 3 + 1).cast("int")).withColumn("event_is_primary", F.col("ord") % 7 != 0))


JUDGED_SQL = f"""j0 AS (SELECT *, CASE WHEN total_score >= 70 AND content_available AND source_tier IN ('a', 'b') THEN 4 WHEN total_score >= 45 AND content_available THEN 3 ELSE 2 END AS g0, CASE WHEN is_stale_candidate THEN 0 WHEN freshness_unknown THEN 2 ELSE 4 END AS f0, CASE WHEN mb >= 65 THEN 4 WHEN mb >= 48 THEN 3 WHEN mb >= 36 THEN 2 ELSE 1 END AS l0,
  CASE WHEN na THEN 'not_ai' WHEN ord % 7 = 0 THEN 'duplicate_event' WHEN old OR freshness_bucket IN ('aging', 'stale') OR age_hours > 168 THEN 'stale' WHEN regexp_matches(title, '(?i){routing.PROMO_TITLE}') THEN 'promo' WHEN source_kind IN ('community', 'github') AND regexp_matches(title, '(?i){routing.GUESS_TITLE}') THEN 'speculation'
  WHEN lane = 'github' THEN 'github_lane' WHEN lane = 'archive_only' OR elig = 'ineligible' THEN 'closed' WHEN elig = 'review' THEN 'review' ELSE 'include' END AS k FROM r
), j1 AS (SELECT *, CASE WHEN (source_kind IN ('official', 'watchlist') AND mb >= 46) OR (source_kind = 'strong_media' AND mb >= 50) THEN greatest(l0, 4) WHEN source_kind = 'github' THEN least(l0, 3) ELSE l0 END AS v0, k <> 'not_ai' AND ord % 3 >= 1 AS tog FROM j0
), j2 AS (SELECT *, CASE WHEN tog THEN least(5, g0 + 1) ELSE g0 END AS g1, CASE WHEN k = 'not_ai' THEN 0 WHEN tog THEN least(5, v0 + 1) ELSE v0 END AS v1 FROM j1
), j3 AS (SELECT *, CASE WHEN k = 'speculation' THEN greatest(1, g1 - 1) ELSE g1 END AS gs, CASE WHEN k = 'stale' THEN 0 WHEN k NOT IN ('not_ai', 'duplicate_event', 'promo', 'speculation') AND age_hours <= 72 THEN least(5, f0 + 1) ELSE f0 END AS fs, CASE WHEN k IN ('promo', 'speculation') THEN greatest(0, v1 - 1) ELSE v1 END AS os, CASE WHEN k IN ('include', 'review') THEN k ELSE 'skip' END AS dec,
  CASE WHEN k = 'include' THEN '' WHEN k = 'github_lane' THEN 'github_topic_only' WHEN k IN ('closed', 'review') THEN CASE WHEN reason <> '' THEN reason WHEN fit = 'low' THEN 'low_operator_value' ELSE 'weak_signal' END ELSE k END AS why FROM j2
), j AS (SELECT *, gs + fs + os AS ds FROM j3)"""


@query(f"+ {ROUTED_SQL}, {JUDGED_SQL} SELECT ord, gs AS groundedness_score, fs AS freshness_score, os AS operator_value_score, ds AS delivery_score, dec AS delivery_decision, why AS delivery_route_reason, CASE WHEN dec = 'skip' THEN why ELSE '' END AS delivery_skip_reason FROM j")
def judge_scores(spark, d):
    return judged(spark, d).select("ord", "groundedness_score", "freshness_score", "operator_value_score", "delivery_score", "delivery_decision", "delivery_route_reason", "delivery_skip_reason")


@query(f"""+ {ROUTED_SQL}, {JUDGED_SQL}, o AS (SELECT *, CASE ord % 4 WHEN 1 THEN least(5, CAST(ord % 8 AS INT)) ELSE gs END AS g2, CASE WHEN ord % 4 = 1 THEN CASE ord % 8 WHEN 1 THEN 'include' ELSE 'skip' END ELSE dec END AS d2 FROM j)
SELECT ord, g2 AS groundedness_score, g2 + fs + os AS delivery_score, d2 AS delivery_decision, CASE WHEN d2 = 'skip' THEN why ELSE '' END AS delivery_skip_reason, CASE WHEN d2 <> 'include' THEN why ELSE '' END AS delivery_route_reason FROM o""")
def judge_overlay(spark, d):
    """A model's landed judgement laid over the rules; one answer in two is unreadable and changes nothing."""
    n = F.col("ord")
    rows = judged(spark, d)
    none = F.lit(None).cast("string")
    answers = rows.filter(n % 2 == 1).select("ord", F.when(n % 4 == 1, (n % 8).cast("string")).otherwise("many").alias("groundedness_score"), none.alias("freshness_score"), none.alias("operator_value_score"), F.when(n % 4 == 1, F.when(n % 8 == 1, " Include").otherwise("skip")).otherwise("perhaps").alias("decision"), none.alias("rationale"))
    return routing.merge_judged(rows, answers).select("ord", "groundedness_score", "delivery_score", "delivery_decision", "delivery_skip_reason", "delivery_route_reason")


SELECTION_SQL = f"""k0 AS (SELECT *, array_to_string(codes, ',') AS cs, source_kind IN ('official', 'strong_media') AS pref FROM j WHERE dec = 'include' AND lane = 'main'
), z0 AS (SELECT count(*) AS total, count(*) FILTER (WHERE pref) AS prefd, count(*) FILTER (WHERE source_kind = 'official') AS offi, count(*) FILTER (WHERE source_kind = 'official' AND mb >= 60 AND ds >= 11) AS viable, count(*) FILTER (WHERE source_kind = 'regional_media' OR list_contains(codes, 'source_penalty:proxy')) AS proxy FROM k0
), z1 AS (SELECT count(*) AS n, count(*) FILTER (WHERE source_kind = 'github') AS ghn FROM j
), z AS (SELECT *, viable = 0 AS gap, total > 0 AND (prefd < least(2, total) OR proxy >= greatest(1, total // 3)) AS weakmix, ghn / greatest(1, n) >= 0.30 AS noisy FROM z0, z1
), y AS (SELECT *, gap OR weakmix OR noisy AS cons, CASE WHEN gap AND weakmix THEN 4 WHEN gap THEN 5 ELSE 6 END AS most FROM z
), k1 AS (SELECT k0.*, y.*, list_contains(codes, 'source_penalty:proxy') AS is_px, list_contains(codes, 'society_high_consequence') AS hi, list_contains(codes, 'society_ecosystem_implication') AS eco, {shared(selection.BUILDER_TAGS)} AS bt, {hits(selection.SYSTEM_WORDS, "lower(title)")} AS dh,
  CASE source_kind WHEN 'official' THEN 6 WHEN 'watchlist' THEN 5 WHEN 'strong_media' THEN 4 WHEN 'regional_media' THEN 3 WHEN 'github' THEN 1 WHEN 'community' THEN 0 ELSE 1 END AS rk FROM k0, y
), k2 AS (SELECT *, mb + ds + 2 * rk + CASE source_kind WHEN 'official' THEN 10 WHEN 'strong_media' THEN 6 WHEN 'regional_media' THEN -6 WHEN 'github' THEN -14 ELSE 0 END - CASE WHEN is_px THEN 8 ELSE 0 END + CASE WHEN list_contains(codes, 'github_significant') THEN 10 ELSE 0 END - CASE WHEN list_contains(codes, 'github_low_impact') THEN 8 ELSE 0 END
  + CASE WHEN soc THEN CASE WHEN hi THEN -2 WHEN eco THEN -4 ELSE -8 END ELSE 0 END - CASE WHEN fit = 'low' THEN 6 ELSE 0 END - CASE WHEN cons AND NOT pref THEN 3 ELSE 0 END - CASE WHEN gap AND source_kind IN ('regional_media', 'github') THEN 4 ELSE 0 END - CASE WHEN weakmix AND NOT pref THEN 2 ELSE 0 END AS ss FROM k1
), k3 AS (SELECT *, CASE source_kind WHEN 'official' THEN 60 WHEN 'strong_media' THEN 62 WHEN 'regional_media' THEN 70 WHEN 'github' THEN 76 ELSE 62 END + CASE WHEN soc THEN 6 - CASE WHEN hi THEN 2 ELSE 0 END + CASE WHEN bt = 0 THEN 2 ELSE 0 END ELSE 0 END + CASE WHEN is_px THEN 6 ELSE 0 END + CASE WHEN cons THEN 3 ELSE 0 END + CASE WHEN gap AND NOT pref THEN 3 ELSE 0 END
  + CASE WHEN weakmix AND source_kind IN ('regional_media', 'github', 'community') THEN 3 ELSE 0 END + CASE WHEN noisy AND source_kind IN ('github', 'regional_media') THEN 2 ELSE 0 END AS floor_, greatest(CASE source_kind WHEN 'regional_media' THEN 12 WHEN 'github' THEN 13 ELSE 11 END, CASE WHEN cons AND NOT pref THEN 12 ELSE 0 END) AS least_ FROM k2
), k4 AS (SELECT *, NOT (source_kind = 'github' AND NOT list_contains(codes, 'github_significant')) AND NOT (soc AND ((NOT hi AND NOT eco) OR (bt = 0 AND dh < 2))) AND ds >= least_ AND NOT (fit = 'low' AND NOT pref) AND ss >= floor_ AS good FROM k3
), k5 AS (SELECT *, row_number() OVER (ORDER BY ss DESC, mb DESC, ds DESC, rk DESC, event_source_count DESC, ord) AS p FROM k4
), sd AS (SELECT ord FROM (SELECT *, row_number() OVER (ORDER BY p) AS q FROM k5 WHERE CASE WHEN offi > 0 THEN source_kind = 'official' ELSE pref END) WHERE q = 1 AND good
), k6 AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN ord IN (SELECT ord FROM sd) THEN 0 ELSE 1 END, p) AS q FROM k5 WHERE good OR NOT (SELECT coalesce(bool_or(good), false) FROM k5))"""


@query(f"""+ {ROUTED_SQL}, {JUDGED_SQL}, {SELECTION_SQL} SELECT ord, CAST(ss AS INT) AS selection_score, sel AS selected, CASE WHEN sel THEN NULL WHEN source_kind = 'github' THEN 'github_topic_only' WHEN is_px OR source_kind = 'regional_media' THEN 'weak_signal' WHEN soc AND hi THEN 'low_operator_value' WHEN soc THEN 'weak_signal' WHEN cons AND NOT pref THEN 'weak_signal' WHEN fit = 'low' THEN 'low_operator_value' ELSE 'weak_signal' END AS selection_skip_reason,
  CASE WHEN sel THEN NULL ELSE 'selection_excluded:' || CASE WHEN source_kind = 'github' THEN 'github_quality_floor' WHEN is_px OR source_kind = 'regional_media' THEN 'proxy_recap' WHEN soc AND hi THEN 'society_not_strong_enough' WHEN soc THEN 'society_low_consequence' WHEN cons AND NOT pref THEN 'conservative_quality_floor' WHEN fit = 'low' THEN 'low_operator_value' ELSE 'quality_floor' END END AS selection_code
FROM (SELECT k5.*, ord IN (SELECT ord FROM k6 WHERE q <= most) AS sel FROM k5)""")
def main_brief_selection(spark, d):
    return selection.select_main_brief(stored(judged(spark, d), "judged")).select("ord", F.col("selection_score").cast("int").alias("selection_score"), "selected", "selection_skip_reason", "selection_code")


@query(f"""+ {ROUTED_SQL}, {JUDGED_SQL}, c AS (SELECT count(*) AS scored_count, count(DISTINCT source_domain) AS source_diversity, count(*) FILTER (WHERE source_kind = 'github') AS github_count, count(*) FILTER (WHERE source_tier IN ('a', 'b')) AS strong_count, count(*) FILTER (WHERE is_old_news OR is_stale_candidate) AS stale_count, 0::BIGINT AS penalised_count,
  count(*) FILTER (WHERE source_kind = 'official') AS official_count, count(*) FILTER (WHERE source_kind = 'strong_media') AS strong_media_count, count(*) FILTER (WHERE source_kind = 'community') AS community_count, count(*) FILTER (WHERE source_kind = 'watchlist') AS watchlist_count, count(*) FILTER (WHERE source_kind = 'search') AS search_count,
  count(*) FILTER (WHERE dec = 'include') AS main_candidates, count(*) FILTER (WHERE dec = 'include' AND source_tier IN ('a', 'b')) AS strong_main, count(*) FILTER (WHERE dec = 'include' AND source_kind = 'official') AS official_main FROM j
), s AS (SELECT *, CASE WHEN scored_count = 0 OR main_candidates = 0 OR strong_main = 0 THEN 'red' WHEN main_candidates = 1 OR source_diversity <= 2 OR github_count >= 0.75 * scored_count OR strong_count < least(3, greatest(1, scored_count // 3)) OR stale_count >= greatest(3, scored_count // 4) OR official_main = 0 THEN 'yellow' ELSE 'green' END AS status FROM c)
SELECT *, status = 'green' OR (status = 'yellow' AND strong_main >= 1) AS publish_ready FROM s""")
def run_health_metrics(spark, d):
    return reports.run_health(judged(spark, d))


@query(f"+ {HEADLINED_SQL}, c AS (SELECT ord, primary_type AS now, CASE ord % 3 WHEN 0 THEN 'Product' WHEN 1 THEN 'Society & Culture' ELSE 'Practical' END AS ask, {', '.join(f'{hits(words, TITLE)} + 2 * {shared(signals.LANE_TAGS[lane])} AS n{k}' for k, (lane, words) in enumerate(signals.LANE_WORDS.items()))} FROM hl), e AS (SELECT *, CASE ask WHEN 'Product' THEN n0 WHEN 'Practical' THEN n2 ELSE n1 END AS x, CASE now WHEN 'Product' THEN n0 WHEN 'Practical' THEN n2 ELSE n1 END AS y FROM c) SELECT ord, CAST(n0 AS INT) AS product, CAST(n1 AS INT) AS society, CAST(n2 AS INT) AS practical, CASE WHEN ask <> now AND CASE WHEN ask = 'Product' THEN x >= greatest(2, y) ELSE x >= greatest(1, y + 1) END THEN ask ELSE now END AS lane FROM e")
def lane_signals(spark, d):
    rows = headlined(spark, d)
    counts = signals.lane_counts(F.col("title"), F.col("tags"))
    asked = F.when(F.col("ord") % 3 == 0, "Product").when(F.col("ord") % 3 == 1, "Society & Culture").otherwise("Practical")
    return rows.select("ord", counts["Product"].alias("product"), counts["Society & Culture"].alias("society"), counts["Practical"].alias("practical"), signals.lane_override(F.col("primary_type"), asked, counts).alias("lane"))
