"""URL columns: host, canonical form, dates in paths, kind of source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import KIND_PRIORITY, SourcePolicy
from ..keywords import ARTICLE_URL_PARTS
from .text import let

# Hosts of vendors whose pages are news only under some paths; words of financial news on one host.
VENDOR_HOSTS, MACRO_WORDS = ("aws.amazon.com", "cloud.google.com"), ("iran", "oil", "hormuz", "saudi", "wall street", "stocks", "ukraine", "troops")


def domain(url: Column) -> Column:
    """Lower-cased host without a leading ``www.``; empty if there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), "^www\\.", "")


def canonical(url: Column) -> Column:
    """Scheme and host lower-cased, fragment and trailing slashes dropped."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), "#.*$", ""), "/+$", "")
    head = F.regexp_extract(bare, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1)
    return F.concat(F.lower(head), F.substring(bare, F.length(head) + 1, F.length(bare)))


def url_hash(url: Column) -> Column:
    return F.sha2(F.coalesce(url, F.lit("")), 256)


def in_domain(host: Column, names) -> Column:
    """Whether the host is one of the names or below one; the host is worked out once, whatever it takes."""
    below = lambda h: F.exists(F.array(*[F.lit(n) for n in names]), lambda n: (h == n) | h.endswith(F.concat(F.lit("."), n)))
    return let(F.coalesce(host, F.lit("")), below) if names else F.lit(False)


def date_in_path(url: Column) -> Column:
    """The date of a /yyyy/mm/dd/ path, else of the first yymmdd (2020 to 2039) or yyyymmdd in a run of six digits or more, or null.

    A run is read from each of its places in turn, six digits before eight.
    """
    low = F.lower(F.coalesce(url, F.lit("")))
    pattern = "/(20[0-9]{2})/(0[1-9]|1[0-2])/(0[1-9]|[12][0-9]|3[01])(?:/|$)"
    parts = [F.regexp_extract(low, pattern, k) for k in (1, 2, 3)]
    runs = F.regexp_extract_all(low, F.lit("[0-9]{6,}"), F.lit(0))
    short = lambda r, k: F.when(F.substr(r, k, F.lit(6)).rlike("^(2[0-9]|3[0-9])[0-9]{4}$"), F.try_to_date(F.concat(F.lit("20"), F.substr(r, k, F.lit(6))), "yyyyMMdd"))
    long = lambda r, k: F.when(F.substr(r, k, F.lit(8)).rlike("^20[0-9]{6}$"), F.try_to_date(F.substr(r, k, F.lit(8)), "yyyyMMdd"))
    tried = F.flatten(F.transform(runs, lambda r: F.flatten(F.transform(F.sequence(F.lit(1), F.length(r) - 5), lambda k: F.array(short(r, k), long(r, k))))))
    first = F.get(F.filter(tried, lambda x: x.isNotNull()), F.lit(0))
    # A path that has the form of a date but is none (31 June) gives null, as no other place is read then.
    return F.when(parts[0] != "", F.try_to_date(F.concat(*parts), "yyyyMMdd")).otherwise(first)


def page_title(html: Column) -> Column:
    """Text of the first title element, white space collapsed; entities stay escaped."""
    found = F.regexp_extract(F.coalesce(html, F.lit("")), "(?is)<title[^>]*>(.*?)</title>", 1)
    return F.trim(F.regexp_replace(found, "[ \\t\\n\\r]+", " "))


def source_kind(policy: SourcePolicy, source: Column, host: Column, quality: Column | None = None, social: Column | None = None, github_type: Column | None = None) -> Column:
    """The first kind that fits, from social signals down to unknown."""
    none = F.lit("")
    name, quality, github_type = F.lower(F.trim(F.coalesce(source, none))), F.lower(F.coalesce(quality if quality is not None else none, none)), F.lower(F.coalesce(github_type if github_type is not None else none, none))
    starts = lambda *p: reduce(lambda a, b: a | b, [name.startswith(x) for x in p])
    return (
        F.when(F.coalesce(social, F.lit(False)) if social is not None else F.lit(False), "community")
        .when((host == "github.com") | github_type.isin("repository", "release"), "github")
        .when(host.isin(*policy.official), "official")
        .when(host.isin(*policy.strong_media), "strong_media")
        .when(host.isin(*policy.regional_media), "regional_media")
        .when(name.startswith("watchlist") | (quality == "high"), "watchlist")
        .when(starts("reddit", "hacker news", "hn", "telegram"), "community")
        .when(name.startswith("duckduckgo"), "search")
        .when(name.startswith("manual"), "manual")
        .when(quality == "review", "review")
        .otherwise("unknown")
    )


def kind_priority(kind: Column) -> Column:
    return reduce(lambda acc, kv: acc.when(kind == kv[0], kv[1]), list(KIND_PRIORITY.items())[1:], F.when(kind == "official", KIND_PRIORITY["official"])).otherwise(KIND_PRIORITY["unknown"])


def source_tier(policy: SourcePolicy, host: Column) -> Column:
    return F.when(F.coalesce(host, F.lit("")) == "", "unknown").when(host.isin(*policy.tier_a), "a").when(host.isin(*policy.tier_b), "b").otherwise("c")


def source_history_key(host: Column, url: Column, source: Column, github_name: Column, platform: Column, page_url: Column | None = None, handle: Column | None = None) -> Column:
    """The first name under which a source's past is kept: repository, page, handle, platform and host, host, source, URL."""
    low = lambda c: F.lower(F.trim(F.coalesce(c if c is not None else F.lit(""), F.lit(""))))
    own, page, bare = F.coalesce(F.nullif(low(host), F.lit("")), domain(url)), low(page_url), F.regexp_replace(low(handle), "^@+", "")
    return (
        F.when(low(github_name) != "", F.concat(F.lit("github:"), low(github_name)))
        .when((low(platform) == "facebook") & (page != ""), F.concat(F.lit("facebook:"), domain(page), F.lit(":"), page))
        .when((low(platform) == "x") & (bare != ""), F.concat(F.lit("x:@"), bare))
        .when((low(platform) != "") & (own != ""), F.concat(low(platform), F.lit(":"), own))
        .when(own != "", own)
        .when(low(source) != "", low(source))
        .when(low(url) != "", low(url))
        .otherwise("unknown")
    )


def news_flags(policy: SourcePolicy, host: Column, url: Column, title: Column) -> Column:
    """Why a page is no news: an array of flags, empty for a candidate."""
    low = F.lower(F.coalesce(url, F.lit("")))
    name = F.trim(F.lower(F.coalesce(title, F.lit(""))))
    any_of = lambda c, parts: reduce(lambda a, b: a | b, [c.contains(p) for p in parts], F.lit(False))
    flags = [
        (host.isin(*policy.blocked_hosts) if policy.blocked_hosts else F.lit(False), "blocked_domain"),
        (any_of(low, policy.landing_parts), "search_or_landing_url"),
        (host.isin(*VENDOR_HOSTS) & ~any_of(low, ARTICLE_URL_PARTS), "vendor_landing_page"),
        (name.isin(*policy.generic_titles), "generic_or_offscope_title"),
        (any_of(name, policy.marketing_phrases), "marketing_title"),
        ((host == "cnbc.com") & any_of(name, MACRO_WORDS), "offtopic_macro_story"),
    ]
    return F.filter(F.array(*[F.when(test, flag) for test, flag in flags]), lambda x: x.isNotNull())
