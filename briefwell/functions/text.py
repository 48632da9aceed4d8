"""Text columns: keys, tokens, cleaning, clipping."""

from __future__ import annotations

import html
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..config import TITLE_STOPWORDS


def falsy(c: Column, default) -> Column:
    """``c``, or the default for null and 0 alike."""
    return F.when(c.isNull() | (c == 0), F.lit(default)).otherwise(c)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used: chains of such uses would else grow the plan many times over."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def is_false(c: Column) -> Column:
    """True only for false; null is not false."""
    return c.eqNullSafe(F.lit(False))


def contains_any(c: Column, parts) -> Column:
    """Whether any part occurs in the lower-cased text; a plain substring test. Null for a null text.

    Many parts are one array in the plan, not an expression each.
    """
    if len(parts) > 8:
        return let(F.lower(c), lambda low: F.exists(F.array(*[F.lit(p) for p in parts]), lambda p: low.contains(p)))
    low = F.lower(c)
    return reduce(lambda a, b: a | b, [low.contains(p) for p in parts], F.lit(False))


def unicode_pattern(pattern: str) -> str:
    """A pattern that folds case and classifies characters as Unicode does."""
    return f"(?iU){pattern}"


def hit_count(c: Column, pattern: str) -> Column:
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(pattern))


def _fold(values: pa.Array) -> pa.Array:
    return pc.ascii_lower(pc.replace_substring_regex(pc.utf8_normalize(values, form="NFKD"), "[^\\x00-\\x7F]+", ""))


def ascii_key(c: Column) -> Column:
    """The ASCII part of the text's compatibility decomposition (NFKD), in lower case; letters without one are dropped."""
    return F.arrow_udf(_fold, StringType())(F.coalesce(c, F.lit("")))


def title_tokens(c: Column) -> Column:
    """Distinct runs of a-z and 0-9 of at least three characters, without stop words, sorted."""
    return F.array_sort(_told(F.regexp_extract_all(ascii_key(c), F.lit("[a-z0-9]+"), F.lit(0))))


def _told(words: Column) -> Column:
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*TITLE_STOPWORDS)))


def title_slug(c: Column) -> Column:
    return F.trim(F.regexp_replace(ascii_key(c), "[^a-z0-9]+", " "))


def slug_tokens(slug: Column) -> Column:
    """The title_tokens() of a title_slug(), as they come."""
    return _told(F.split(slug, " "))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "[ \\t\\n\\r]+", " "))


#: Texts that are Python strings at once.
UNPACKED = 256


def _plain(values: pa.Array) -> pa.Array:
    plain = lambda some: pa.array([" ".join(html.unescape(v).split()) for v in some.to_pylist()], pa.string())
    return pa.concat_arrays([plain(values.slice(k, UNPACKED)) for k in range(0, max(1, len(values)), UNPACKED)])


def plain_text(c: Column) -> Column:
    """The whole text with entities unescaped and white space collapsed; empty for null."""
    return F.arrow_udf(_plain, StringType())(F.coalesce(c, F.lit("")))


def clip(c: Column, limit: int) -> Column:
    """At most ``limit`` characters, cut after a whole word where there is one, with an ellipsis."""
    text = collapse(c)
    cut = F.regexp_replace(F.substring(text, 1, limit - 1), " [^ ]*$", "")
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(cut, F.lit("…")))


def message_chunks(c: Column, limit: int) -> Column:
    """Paragraphs joined to pieces of at most ``limit`` characters; a longer paragraph is a piece of its own."""
    parts = F.filter(F.split(F.coalesce(c, F.lit("")), "\n\n+"), lambda p: p != "")
    start = F.array().cast("array<string>")
    fits = lambda acc, p: (F.size(acc) > 0) & (F.length(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(""))) + F.length(p) + 2 <= limit)
    return F.aggregate(parts, start, lambda acc, p: F.when(fits(acc, p), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")), F.lit("\n\n"), p)))).otherwise(F.concat(acc, F.array(p))))


# Sentences that say that nothing was found.
NO_COMMUNITY = ("không tìm thấy phản ứng cộng đồng", "chưa có dữ liệu cộng đồng", "khong tim thay phan ung cong dong")


def missing_community(c: Column) -> Column:
    """Whether a text on community reactions is empty or says that there are none."""
    return (F.coalesce(c, F.lit("")) == "") | contains_any(F.coalesce(c, F.lit("")), NO_COMMUNITY)


# Skip reasons, and older names of some.
SKIP_REASONS = ("duplicate_event", "weak_signal", "stale", "not_ai", "promo", "speculation", "github_topic_only", "low_operator_value")
SKIP_ALIASES = {"old": "stale", "aging": "stale", "duplicate": "duplicate_event", "thin": "weak_signal", "unknown_time": "weak_signal", "filtered_out": "weak_signal", "review_threshold": "weak_signal"}


def skip_reason(c: Column) -> Column:
    """A reason by its canonical name; unknown names are weak_signal, empty stays empty."""
    name = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    first, *rest = SKIP_ALIASES.items()
    mapped = reduce(lambda acc, kv: acc.when(name == kv[0], kv[1]), rest, F.when(name == first[0], first[1])).otherwise(name)
    return F.when(name == "", "").when(mapped.isin(*SKIP_REASONS), mapped).otherwise("weak_signal")
