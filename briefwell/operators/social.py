"""Posts of social platforms, as landed rows: age hints, lines, scores of sources, and the judgement of their own lane."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import UNIT_HOURS
from ..functions.text import contains_any, is_false, unicode_pattern
from .scoring import clamp
from .signals import entertainment, low, with_absent

# Lines that are no content, and texts that are not loaded.
METADATA_LINE = "(tác giả|uy tín|người kiểm duyệt|quản trị viên|admin|moderator|người đóng góp nổi bật|top contributor|super contributor|see translation|xem bản dịch|theo dõi|follow|like|comment|share|thích|trả lời|chia sẻ)"
MORE_LINE, LOADING = r"(…\s*)?(xem thêm|see more)", r"\b(đang tải|loading)\b"
# Words of a source's name and text, and their points; a pattern of sources that are off topic.
SOURCE_WORDS = {"ai": 28, "a.i": 28, "artificial intelligence": 24, "chatgpt": 24, "openai": 22, "claude": 20, "grok": 14, "gemini": 14, "openclaw": 20, "llm": 20, "mcp": 18, "agent": 16, "automation": 14, "data": 12, "benchmark": 16, "workflow": 16, "prompt": 10, "model": 14, "machine learning": 14, "nghiện ai": 24, "bình dân học ai": 22, "cộng đồng ai": 18}
GROUP_WORDS = ("ai", "chatgpt", "chat gpt", "openclaw", "claude", "llm", "workflow", "automation")
OFF_SOURCES = r"\b(?:marketplace|watch|gaming|video|messenger|reels|shop|dating|j2team|vật vờ|vat vo studio)\b"
OLD_HINT = r"^\d+\s*(tháng|năm|month|months|year|years)\b"
# Words that tell a post's style, tried in this order; a question mark is speculation.
STYLE_WORDS = {
    "promo": ("webinar", "event", "sự kiện", "đăng ký", "register", "course", "khóa học", "bán", "sale", "giảm giá", "acc", "tài khoản", "tuyển dụng", "hiring"),
    "benchmark": ("vs", "benchmark", "so sánh", "compare", "cost", "chi phí", "latency", "quality", "chất lượng", "điểm", "point", "points"),
    "case_study": ("case study", "production", "triển khai", "workflow", "playbook", "quy trình", "use case", "thực chiến", "mcp", "claude code"),
    "news_recap": ("roundup", "recap", "tổng hợp", "news recap", "tin tháng", "điểm tin"),
}
SPECULATION = ("?", "rumor", "rumour", "leak", "đồn đoán", "tin đồn", "có vẻ", "có thể", "maybe", "sắp ra mắt")
WORKFLOW, OPINION = ("workflow", "playbook", "mcp", "claude code", "quy trình"), ("mình nghĩ", "quan điểm", "ý kiến", "theo mình")
# What a style and words are worth, and the authority of sources by type and origin.
STYLE_POINTS = {"benchmark": 26, "case_study": 18, "workflow": 16, "news_recap": 8, "opinion": 2, "speculation": -18, "promo": -34}
DEPTH_WORDS = (
    (10, (" vs ", " so sánh ")),
    (10, ("openai", "anthropic", "claude", "gpt", "gemini", "minimax", "grok")),
    (10, ("benchmark", "workflow", "case study", "thực chiến", "production", "chi phí")),
    (8, ("bài 1", "bài test", "test 1", "kết quả", "yêu cầu", "module", "codebase")),
)
TYPE_AUTHORITY, OTHER_AUTHORITY = {"group": 42, "page": 52, "profile": 58}, 45
ORIGIN_AUTHORITY = {"manual": 14, "followed": 8, "joined": 5}
#: From its first to its last character that is no blank, a text of at least 180.
LONG_TEXT = r"(?sU)\S.{178,}?\S"
#: Styles of posts with substance.
DEEP_STYLES = ("benchmark", "case_study", "workflow")


def hint_rank(hint: Column) -> Column:
    """Rank of a post by its hint of age: 100 for now, 76 for yesterday, less by minutes, hours, days, weeks, months; 40 without a hint, 35 for an unknown one."""
    t = F.lower(F.trim(F.coalesce(hint, F.lit(""))))
    pattern = "(?U)^([0-9]+)\\s*(" + "|".join(UNIT_HOURS) + ")\\b"
    n, unit = F.regexp_extract(t, pattern, 1).try_cast("int"), F.regexp_extract(t, pattern, 2)
    of = lambda hours: unit.isin(*[u for u, h in UNIT_HOURS.items() if h == hours])
    aged = (
        F.when(of(1 / 60), F.greatest(F.lit(88), 99 - n))
        .when(of(1), F.greatest(F.lit(70), 95 - n))
        .when(of(24), F.greatest(F.lit(48), 72 - n * 4))
        .when(of(168), F.greatest(F.lit(10), 32 - n * 6))
        .when(of(720), F.greatest(F.lit(0), 6 - n))
        .when(of(8760), 0)
        .otherwise(35)
    )
    return F.when(t == "", 40).when(t.isin("vừa xong", "just now"), 100).when(t.isin("hôm qua", "hom qua", "yesterday"), 76).otherwise(aged).cast("int")


def is_loaded(text: Column) -> Column:
    t = F.trim(F.coalesce(text, F.lit("")))
    return (t != "") & ~t.rlike(unicode_pattern(LOADING))


def content_lines(text: Column) -> Column:
    """The lines of a post without blanks, roles, buttons and 'see more'."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), lambda x: F.trim(x))
    return F.filter(lines, lambda x: (x != "") & ~x.rlike(unicode_pattern(f"^{METADATA_LINE}$")) & ~x.rlike(unicode_pattern(f"^{MORE_LINE}$")))


def source_score(label: Column, url: Column, description: Column, source_type: Column) -> Column:
    """0 to 100: how near a social source is to the topic, by words of its label, description and URL, and its type."""
    text = F.lower(F.concat_ws(" ", *[F.when(F.coalesce(c, F.lit("")) != "", c) for c in (label, description, url)]))
    words = F.create_map(*[x for w, n in SOURCE_WORDS.items() for x in (F.lit(w), F.lit(n))])
    points = F.aggregate(F.map_entries(words), F.lit(0), lambda acc, e: acc + F.when(text.contains(e["key"]), e["value"]).otherwise(0))
    kind = F.coalesce(source_type, F.lit(""))
    score = F.lit(10) + points + F.when(kind == "group", 6).when(kind == "page", 10).when(kind == "profile", 12).otherwise(0)
    score += F.when(text.rlike(r"(?U)\bai\b"), 18).otherwise(0) + F.when(text.contains("chat gpt") | text.contains("chatgpt"), 18).otherwise(0) + F.when(text.contains("openclaw"), 22).otherwise(0)
    score += F.when((kind == "group") & contains_any(text, GROUP_WORDS), 12).otherwise(0) + F.when(contains_any(text, ("community", "cộng đồng")), 6).otherwise(0) - F.when(text.rlike(unicode_pattern(OFF_SOURCES)), 35).otherwise(0)
    capped = F.when(contains_any(text, tuple(SOURCE_WORDS)), score).otherwise(F.least(score, F.lit(45)))
    return F.when(text == "", 0).otherwise(clamp(capped, 0, 100)).cast("int")


def source_state(score: Column, origin: Column) -> Column:
    return F.when(F.coalesce(origin, F.lit("")) == "manual", "auto_active").when(score >= 70, "auto_active").when(score >= 50, "candidate").otherwise("ignored")


def _any_in(low: Column, words) -> Column:
    """Whether any of the words occurs in a text that is in lower case already."""
    return reduce(lambda a, b: a | b, [low.contains(w) for w in words])


def content_style(whole: Column, content: Column, low: Column | None = None) -> Column:
    """The style of a post by the words of its whole text: the first of promo, speculation, benchmark, workflow or case_study, news_recap, opinion; else by length.

    ``low``: the text in lower case, if it is there. Patterns, which are slow, are tried only where one of their words occurs at all.
    """
    low = F.lower(whole) if low is None else low
    # Letters that match s and i without case, but stay what they are in lower case.
    word = lambda style: _any_in(low, (*STYLE_WORDS[style], "ſ", "ı")) & whole.rlike(unicode_pattern(r"\b(" + "|".join(STYLE_WORDS[style]) + r")\b"))
    return (
        F.when(word("promo"), "promo")
        .when(_any_in(low, SPECULATION), "speculation")
        .when(word("benchmark"), "benchmark")
        .when(word("case_study"), F.when(_any_in(low, WORKFLOW), "workflow").otherwise("case_study"))
        .when(word("news_recap"), "news_recap")
        .when(_any_in(low, OPINION), "opinion")
        .when(F.length(content) >= 700, "case_study")
        .when(low.contains("tool"), "workflow")
        .otherwise("news_recap")
    )


def post_scores(posts: DataFrame) -> DataFrame:
    """facebook_content_style, facebook_boss_style_score and facebook_authority_score (0 to 100) of posts.

    Depth counts length, digits, names and words of the whole text and the style; authority the source's type, its origin,
    its score and its author. Missing or null columns count as empty; what posts had in these columns is replaced.
    """
    made = ["facebook_content_style", "facebook_boss_style_score", "facebook_authority_score"]
    own = [c for c in posts.columns if c not in made]
    rows = with_absent(posts, {"title": "string", "content": "string", "social_author": "string", "source_type": "string", "ai_source_score": "int", "discovery_origin": "string"})
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = rows.withColumn("_whole", F.concat_ws(" ", F.nullif(text("title"), F.lit("")), F.nullif(text("content"), F.lit(""))))
    rows = rows.withColumn("_low", F.lower("_whole"))
    rows = rows.withColumn("_style", content_style(F.col("_whole"), text("content"), F.col("_low")))
    depth = F.lit(30) + F.least(F.lit(16), F.floor(F.length(text("content")) / 180)) + F.when(F.col("_whole").rlike("[\\p{Nd}²³¹⁰⁴-⁹₀-₉]"), 8).otherwise(0)
    for points, words in DEPTH_WORDS:
        depth += F.when(_any_in(F.col("_low"), words), points).otherwise(0)
    of = lambda c, points, other: F.coalesce(*[F.when(c == k, n) for k, n in points.items()], F.lit(other))
    depth += of(F.col("_style"), STYLE_POINTS, 0) - F.when(text("content").rlike(LONG_TEXT), 0).otherwise(18)
    authority = of(text("source_type"), TYPE_AUTHORITY, OTHER_AUTHORITY) + of(low("discovery_origin"), ORIGIN_AUTHORITY, 0) + F.when(F.lower(text("social_author")).contains("ai"), 6).otherwise(0)
    authority += F.least(F.lit(28), F.floor(F.coalesce(F.col("ai_source_score"), F.lit(0)) / 2))
    return rows.select(*own, F.col("_style").alias(made[0]), clamp(depth, 0, 100).cast("int").alias(made[1]), clamp(authority, 0, 100).cast("int").alias(made[2]))


POST_KINDS = {
    "title": "string", "content": "string", "snippet": "string", "note_summary_vi": "string", "community_reactions": "string", "source_domain": "string", "total_score": "int", "confidence_label": "string", "content_available": "boolean", "freshness_unknown": "boolean", "is_stale_candidate": "boolean", "is_old_news": "boolean",
    "age_hours": "double", "event_is_primary": "boolean", "community_signal_strength": "int", "is_ai_relevant": "boolean", "facebook_boss_style_score": "int", "facebook_authority_score": "int", "facebook_content_style": "string", "facebook_sort_mode": "string", "published_hint": "string", "social_signal": "boolean", "facebook_auto": "boolean",
}


def judge_posts(posts: DataFrame, fresh_hours: int = 72, review_hours: int = 168) -> DataFrame:
    """groundedness_score, freshness_score, operator_value_score, delivery_decision, delivery_skip_reason of social posts.

    Softer than the judge of the main brief: depth of style and authority of the source count, and where the style's score or the
    authority is missing they are estimated. Null flags are false; a null is_ai_relevant or event_is_primary is true.
    """
    own = posts.columns
    rows = with_absent(posts, POST_KINDS)
    has = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    score, content = F.coalesce(F.col("total_score"), F.lit(0)), flag("content_available")
    words = F.lower(F.concat_ws(" ", *[F.when(has(c), F.col(c)) for c in ("title", "content", "note_summary_vi")]))
    told = F.when(contains_any(words, ("benchmark", " vs ", "so sánh", "chi phí", "claude", "gpt", "gemini")), "benchmark").when(contains_any(words, ("workflow", "mcp", "claude code", "quy trình")), "workflow").otherwise("news_recap")
    style = F.when(has("facebook_content_style"), low("facebook_content_style")).otherwise(told)
    guess = F.when((score >= 45) & content, 62).when((score >= 30) & (has("content") | has("note_summary_vi")), 50).otherwise(36)
    guess = F.when(has("community_reactions"), F.least(F.lit(100), guess + 8)).otherwise(guess)
    given = lambda c, default: F.when(F.coalesce(F.col(c), F.lit(0)) <= 0, default).otherwise(F.col(c))
    rows = rows.withColumn("_style", style).withColumn("_boss", given("facebook_boss_style_score", guess)).withColumn("_auth", given("facebook_authority_score", F.when(flag("social_signal"), 64).when(flag("facebook_auto"), 58).otherwise(52)))
    deep = F.col("_style").isin(*DEEP_STYLES)
    rows = rows.withColumn("_boss", F.when(deep & (F.col("_boss") < 58), F.greatest(F.col("_boss"), F.when((score >= 40) & content, 60).otherwise(52))).otherwise(F.col("_boss")))
    boss, authority, age, unknown = F.col("_boss"), F.col("_auth"), F.col("age_hours"), flag("freshness_unknown")
    more = lambda c, test: F.when(test, F.least(F.lit(5), c + 1)).otherwise(c)
    ground = more(more(F.when(content, 4).when(has("content") | has("note_summary_vi"), 3).otherwise(2), has("community_reactions")), F.coalesce(F.lower(F.col("confidence_label")) == "high", F.lit(False)) | (authority >= 75))
    fresh = F.when(unknown, 2).when(age <= 24, 5).when(age <= fresh_hours, 4).when(age <= review_hours, 2).when(age.isNotNull(), 0).otherwise(3)
    fresh = F.when((low("facebook_sort_mode") == "newest") & (fresh >= 4), F.least(F.lit(5), fresh + 1)).otherwise(fresh)
    value = F.when(boss >= 82, 5).when(boss >= 68, 4).when(boss >= 52, 3).when(boss >= 38, 2).otherwise(1)
    value = more(more(value, deep), (authority >= 72) | (F.coalesce(F.col("community_signal_strength"), F.lit(0)) >= 4))
    rows = rows.withColumn("groundedness_score", ground).withColumn("freshness_score", fresh).withColumn("operator_value_score", value)
    total = F.col("groundedness_score") + F.col("freshness_score") + F.col("operator_value_score")
    out = lambda decision, reason: F.struct((decision if isinstance(decision, Column) else F.lit(decision)).alias("decision"), F.lit(reason).alias("reason"))
    if_strong = lambda test: F.when(test, "review").otherwise("skip")
    not_ai = is_false(F.col("is_ai_relevant")) | entertainment(low("source_domain"), F.col("title"))
    verdict = (
        F.when(not_ai, out("skip", "not_ai"))
        .when(is_false(F.col("event_is_primary")), out("skip", "duplicate_event"))
        .when(~has("content") & ~has("note_summary_vi") & ~has("snippet"), out("skip", "weak_signal"))
        .when(F.col("_style") == "promo", out("skip", "promo"))
        .when((F.col("_style") == "speculation") & (boss < 78), out("skip", "speculation"))
        .when(age > review_hours, out("skip", "stale"))
        .when(flag("is_stale_candidate") | (flag("is_old_news") & (authority < 78)) | F.trim(F.coalesce(F.col("published_hint"), F.lit(""))).rlike(unicode_pattern(OLD_HINT)), out(if_strong((authority >= 78) & (boss >= 75) & F.coalesce((age > 0) & (age <= review_hours), F.lit(False))), "stale"))
        .when(unknown, out(if_strong((authority >= 78) & (boss >= 78) & deep), "weak_signal"))
        .when(age > fresh_hours, out(if_strong((authority >= 70) & (boss >= 72)), "stale"))
        .when(deep & (boss >= 58) & (total >= 9) & (score >= 24), out("include", ""))
        .when(deep & (boss >= 48) & (total >= 7.5), out("review", ""))
        .when(deep, out("skip", "weak_signal"))
        .when((total / 3 >= 3.3) & (boss >= 62) & (authority >= 60), out("include", ""))
        .when((total / 3 >= 2.6) & (boss >= 50), out("review", ""))
        .otherwise(out("skip", "weak_signal"))
    )
    rows = rows.withColumn("_v", verdict).withColumn("operator_value_score", F.when(not_ai, 0).otherwise(F.col("operator_value_score")))
    done = rows.withColumn("delivery_decision", F.col("_v.decision")).withColumn("delivery_skip_reason", F.when(F.col("_v.decision") == "skip", F.col("_v.reason")).otherwise("")).withColumn("delivery_score", F.col("groundedness_score") + F.col("freshness_score") + F.col("operator_value_score"))
    made = ["groundedness_score", "freshness_score", "operator_value_score", "delivery_score", "delivery_decision", "delivery_skip_reason"]
    return done.select(*[c for c in own if c not in made], *made)


def post_articles(payloads: DataFrame) -> DataFrame:
    """Loaded posts (text, url, label, published_hint) as articles: author first, then content of at least 50 characters; others are left out."""
    rows = payloads.filter(is_loaded(F.col("text")) & (F.length(F.trim("text")) >= 60)).withColumn("_lines", content_lines(F.col("text")))
    rows = rows.withColumn("content", F.array_join(F.slice("_lines", 2, 1 << 20), "\n")).filter((F.length("content") >= 50) & (F.coalesce(F.col("url"), F.lit("")) != ""))
    author = F.get("_lines", F.lit(0))
    source = F.concat(F.lit("Facebook Auto | "), F.col("label"), F.when(F.lower(author) != F.lower(F.trim("label")), F.concat(F.lit(" | "), author)).otherwise(""))
    return rows.select(F.substring(F.get("_lines", F.lit(1)), 1, 160).alias("title"), "url", source.alias("source"), "content", "published_hint", F.lit(True).alias("social_signal"), F.lit("facebook").alias("social_platform"), author.alias("social_author"), F.lit("facebook_topic").alias("delivery_lane_hint"), F.lit("community").alias("source_kind"), F.lit(76).alias("source_priority"), F.lit(3).alias("community_signal_strength"), F.lit(True).alias("facebook_auto"))
