"""Signals of an article's text and tags: operator value, novelty, consequence, significance of repositories, lanes.

Words are tested as substrings of the lower-cased whole text; every word counts once, however often it occurs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import keywords as K
from ..functions.automaton import count_of, words_found
from ..functions.text import contains_any

# Rank of each kind of source when candidates tie.
SOURCE_RANKS = {"official": 6, "watchlist": 5, "strong_media": 4, "regional_media": 3, "manual": 2, "review": 2, "github": 1, "community": 0}
# Words and tags of each lane.
LANE_WORDS = {
    "Product": ("launch", "launched", "release", "released", "feature", "api", "sdk", "model", "platform", "preview", "beta"),
    "Society & Culture": ("regulation", "policy", "law", "compliance", "governance", "security", "safety", "cyberattack", "cyber attack", "breach", "compromise", "lawsuit", "investigation", "education", "student", "school", "community", "culture", "workforce", "jobs", "hospital", "medical"),
    "Practical": ("tutorial", "guide", "workflow", "how to", "playbook", "best practice", "tooling"),
}
LANE_TAGS = {
    "Product": ("product_update", "api_platform", "model_release", "enterprise_ai", "infrastructure"),
    "Society & Culture": ("regulation", "safety", "government", "education", "healthcare", "vietnam", "southeast_asia"),
    "Practical": ("developer_tools", "ai_agents", "open_source"),
}
# Lanes by older names.
LANE_ALIASES = {"policy": "Society & Culture", "policy & ethics": "Society & Culture", "society": "Society & Culture", "society & culture": "Society & Culture", "practical": "Practical", "business": "Product", "product": "Product", "research": "Product"}
#: Article columns that the signals read; absent ones count as null.
KINDS = {
    "title": "string", "summary_vi": "string", "editorial_angle": "string", "snippet": "string", "content": "string", "source": "string", "source_domain": "string", "source_kind": "string", "primary_type": "string",
    "tags": "array<string>", "project_fit": "string", "relevance_level": "string", "content_available": "boolean", "source_verified": "boolean", "watchlist_hit": "boolean", "freshness_bucket": "string", "age_hours": "double",
    "github_full_name": "string", "github_signal_type": "string", "github_stars": "long", "event_source_count": "long", "is_stale_candidate": "boolean", "is_old_news": "boolean",
}


def with_absent(rows: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """``rows`` with a null column for each of ``kinds`` that they lack."""
    return rows.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items() if c not in rows.columns})


def low(c: str) -> Column:
    """A text column in lower case without outer blanks; empty for null."""
    return F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))


def flag(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def keyword_hits(text: Column, words: tuple[str, ...]) -> Column:
    """How many of the words occur in a lower-cased text. The words are one array in the plan, not an expression each."""
    return F.size(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: text.contains(w)))


def tag_hits(tags: Column, wanted: tuple[str, ...]) -> Column:
    return F.size(F.array_intersect(tags, F.array(*[F.lit(w) for w in wanted])))


def tag_set() -> Column:
    """Distinct non-blank tags in lower case."""
    cleaned = F.transform(F.coalesce(F.col("tags"), F.array().cast("array<string>")), lambda x: F.lower(F.trim(F.coalesce(x, F.lit("")))))
    return F.array_distinct(F.filter(cleaned, lambda x: x != ""))


def project_fit() -> Column:
    """The explicit fit, else the level of relevance, else low."""
    known = ("high", "medium", "low")
    return F.when(low("project_fit").isin(*known), low("project_fit")).when(low("relevance_level").isin(*known), low("relevance_level")).otherwise("low")


def is_github() -> Column:
    return (low("source_domain") == "github.com") | (low("github_full_name") != "") | low("github_signal_type").isin("repository", "release")


def official_or_strong() -> Column:
    return low("source_kind").isin("official", "strong_media")


def source_rank(kind: Column) -> Column:
    first, *rest = SOURCE_RANKS.items()
    return reduce(lambda acc, kv: acc.when(kind == kv[0], kv[1]), rest, F.when(kind == first[0], first[1])).otherwise(1)


def lane_name(kind: Column) -> Column:
    """The lane of a type by its present or an older name; blank is Practical, an unknown name stays."""
    name = F.trim(F.coalesce(kind, F.lit("")))
    first, *rest = LANE_ALIASES.items()
    known = reduce(lambda acc, kv: acc.when(F.lower(name) == kv[0], kv[1]), rest, F.when(F.lower(name) == first[0], first[1]))
    return F.when(name == "", "Practical").otherwise(known.otherwise(name))


def is_fresh() -> Column:
    """Breaking, fresh or recent (or boosted), else at most 72 hours old."""
    bucket = F.lower(F.coalesce(F.col("freshness_bucket"), F.lit("unknown")))
    return bucket.isin("breaking", "fresh", "recent", "fresh_boost") | F.coalesce(F.col("age_hours") <= 72, F.lit(False))


#: Words that the signals count, by list, and all of them.
SIGNAL_LISTS = {"novelty": K.NOVELTY_HINTS, "operator": K.OPERATOR_HINTS, "adoption": K.ADOPTION_HINTS, "noise": K.GITHUB_NOISE_HINTS, "ecosystem": K.SOCIETY_ECOSYSTEM_HINTS, "consequence": K.CONSEQUENCE_HINTS, "filler": K.SOCIETY_FILLER_HINTS, "promo": K.PROMO_HINTS, "speculation": K.SPECULATION_HINTS}
SIGNAL_WORDS = tuple(dict.fromkeys(w for listed in SIGNAL_LISTS.values() for w in listed))


def signal_words() -> Column:
    """Places, in SIGNAL_WORDS, of those that occur in the whole text of rows with the columns of KINDS."""
    return words_found(F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("title", "summary_vi", "editorial_angle", "snippet", "content", "source", "source_domain")])), SIGNAL_WORDS)


def with_signals(articles: DataFrame) -> DataFrame:
    """The columns that routing reads, from the whole text and the tags. Rows that bring signal_words need no text.

    operator_strength, novelty_strength, ecosystem_strength, consequence_strength, github_signal, github_significant,
    society, society_filler, weak_society, ecosystem_impact, proxy_penalty, promo, speculation, fresh_signal,
    project_fit. Absent columns count as null, null texts as empty, null tags as none.
    """
    own = [c for c in articles.columns if c != "project_fit"]
    rows = with_absent(articles, KINDS)
    rows = rows.withColumn("_tags", tag_set()).withColumn("_fit", project_fit())
    tags, fit = F.col("_tags"), F.col("_fit")
    rows = rows.withColumn("_found", F.col("signal_words") if "signal_words" in own else signal_words())
    hits = {name: count_of(F.col("_found"), SIGNAL_WORDS, listed) for name, listed in SIGNAL_LISTS.items()}
    shared = {name: tag_hits(tags, wanted) for name, wanted in (("actionable", K.ACTIONABLE_TAGS), ("github", K.GITHUB_TAGS), ("ecosystem", K.ECOSYSTEM_TAGS), ("consequence", K.CONSEQUENCE_TAGS), ("proxy", K.PROXY_TAGS))}
    # Arrays, not structs: the optimiser would take a struct apart and count a list again for each use.
    rows = rows.withColumn("_h", F.array(*hits.values())).withColumn("_s", F.array(*shared.values()))
    h, s = lambda n: F.get("_h", F.lit(list(hits).index(n))), lambda n: F.get("_s", F.lit(list(shared).index(n)))
    one = lambda test: test.cast("int")
    capped = lambda c, most: F.least(F.lit(most), c)
    kind = low("source_kind")
    operator = s("actionable") + capped(h("operator"), 3) + F.when(fit == "high", 2).when(fit == "medium", 1).otherwise(0) + one(flag("content_available")) + one(flag("source_verified"))
    novelty = capped(h("novelty"), 3) + one(is_fresh()) + one(flag("watchlist_hit")) + one(low("github_signal_type") == "release")
    ecosystem = s("ecosystem") + capped(h("ecosystem"), 3) + one(fit == "high")
    consequence = s("consequence") + capped(h("consequence"), 3) + one(official_or_strong())
    stars = F.coalesce(F.col("github_stars"), F.lit(0))
    major = F.split_part(low("github_full_name"), F.lit("/"), F.lit(1)).isin(*K.MAJOR_OWNERS) & low("github_full_name").contains("/")
    reach = F.when(stars >= 5000, 2).when(stars >= 1500, 1).otherwise(0) + one(flag("watchlist_hit")) + one(F.coalesce(F.col("event_source_count"), F.lit(1)) >= 2) + capped(h("adoption"), 2) + one(major)
    builder = (s("github") >= 2) & (h("operator") >= 4)
    adopted = (h("adoption") >= 2) | (reach >= 4)
    official_release = (low("github_signal_type") == "release") & major
    idle = (h("noise") > 0) & (h("adoption") == 0) & (stars < 8000)
    significant = is_github() & ~idle & builder & ((official_release & ((h("novelty") >= 1) | adopted)) | (adopted & (h("novelty") >= 1)))
    echoed = s("proxy") + capped(h("novelty"), 2)
    society = lane_name(F.col("primary_type")) == "Society & Culture"
    rows = (
        rows.withColumn("operator_strength", operator.cast("int"))
        .withColumn("novelty_strength", novelty.cast("int"))
        .withColumn("ecosystem_strength", ecosystem.cast("int"))
        .withColumn("consequence_strength", consequence.cast("int"))
        .withColumn("github_signal", is_github())
        .withColumn("github_significant", significant)
        .withColumn("society", society)
        .withColumn("society_filler", society & (s("ecosystem") == 0) & (h("filler") > 0))
        .withColumn("proxy_penalty", F.when((kind == "regional_media") & (echoed > 0), F.lit(4) + one(~flag("source_verified"))).otherwise(0))
        .withColumn("promo", h("promo") > 0)
        .withColumn("speculation", kind.isin("community", "github") & (h("speculation") > 0))
        .withColumn("fresh_signal", is_fresh() & ~flag("is_stale_candidate") & ~flag("is_old_news"))
    )
    impact = (F.col("ecosystem_strength") >= 3) | (F.col("operator_strength") >= 5) | (F.col("consequence_strength") >= 2)
    weak = F.col("society") & ~F.col("ecosystem_impact") & (F.col("society_filler") | ((F.col("operator_strength") < 5) & (F.col("consequence_strength") < 2)))
    done = rows.withColumn("ecosystem_impact", impact).withColumn("weak_society", weak).withColumn("project_fit", fit)
    made = ["operator_strength", "novelty_strength", "ecosystem_strength", "consequence_strength", "github_signal", "github_significant", "society", "society_filler", "weak_society", "ecosystem_impact", "proxy_penalty", "promo", "speculation", "fresh_signal", "project_fit"]
    return done.select(*[c for c in own if c not in made], *made)


def lane_counts(text: Column, tags: Column) -> dict[str, Column]:
    """For each lane: words of it that occur, and twice the tags of it."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return {lane: (keyword_hits(lowered, words) + 2 * tag_hits(tags, LANE_TAGS[lane])).cast("int") for lane, words in LANE_WORDS.items()}


def lane_override(current: Column, asked: Column, counts: dict[str, Column]) -> Column:
    """The lane after a request to move: Product needs two signals and no fewer than the present lane has, others one more than it has."""
    of = lambda lane: reduce(lambda acc, kv: acc.when(lane == kv[0], kv[1]), list(counts.items())[1:], F.when(lane == "Product", counts["Product"])).otherwise(0)
    target, now = lane_name(asked), lane_name(current)
    enough = F.when(target == "Product", of(target) >= F.greatest(F.lit(2), of(now))).otherwise(of(target) >= F.greatest(F.lit(1), of(now) + 1))
    return F.when((target != now) & enough, target).otherwise(now)


def entertainment(host: Column, title: Column) -> Column:
    """Whether a title of the one host with much beside the topic is about entertainment or gadgets."""
    return (host == "theverge.com") & contains_any(F.coalesce(title, F.lit("")), K.SHOW_WORDS)
