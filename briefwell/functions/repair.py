"""Model output: JSON repair, checks of fields, prose salvage. Repair runs in Arrow batches; the rest are column functions."""

from __future__ import annotations

import json
import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import contains_any

# Typographic characters and what they stand for in JSON.
STRAIGHT = str.maketrans({"“": '"', "”": '"', "‘": "'", "’": "'", "：": ":", "，": ",", "｛": "{", "｝": "}"})


def balanced(text: str) -> str:
    """From the first bracket to its partner; missing partners are added at the end."""
    start = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=-1)
    if start < 0:
        return ""
    open_, quoted, escaped = [], False, False
    for i, c in enumerate(text[start:], start):
        if quoted:
            quoted, escaped = (c != '"' or escaped), (c == "\\" and not escaped)
        elif c == '"':
            quoted = True
        elif c in "{[":
            open_.append("}" if c == "{" else "]")
        elif c in "}]" and open_:
            open_.pop()
            if not open_:
                return text[start : i + 1]
    return text[start:] + '"' * quoted + "".join(reversed(open_))


def _quoted_keys(text: str) -> str:
    return re.sub(r",\s*([}\]])", r"\1", re.sub(r"([{,]\s*)([A-Za-z_]\w*)\s*:", r'\1"\2":', text))


def _literals(text: str) -> str:
    for word, json_word in (("None", "null"), ("True", "true"), ("False", "false")):
        text = re.sub(rf"\b{word}\b", json_word, text)
    return re.sub(r"'([^'\"]*)'", r'"\1"', text)


def repaired(text: str | None) -> str | None:
    """The JSON text inside a model's answer, in canonical form, or null: fences off, quotes straight, keys quoted, no trailing commas."""
    bare = re.sub(r"```(?:json)?", "", text or "")
    for candidate in (bare, bare.translate(STRAIGHT)):
        part = balanced(candidate)
        for fixed in (part, _quoted_keys(part), _quoted_keys(_literals(part))):
            try:
                return json.dumps(json.loads(fixed), ensure_ascii=False)
            except ValueError:
                continue
    return None


def repair_json(text: Column) -> Column:
    @F.arrow_udf("string")
    def fix(texts: pa.Array) -> pa.Array:
        return pa.array([repaired(t) for t in texts.to_pylist()], pa.string())

    return fix(text)


# Names under which models put the list of answers.
LIST_NAMES = ("articles", "Articles", "items", "Items", "results", "data")


def answers_in(parsed: Column, hints: tuple[str, ...] = ("item_id",)) -> Column:
    """The answers, as an array of JSON texts, in a parsed batch: a list, a list or one answer under a usual name (also as quoted JSON), or one bare answer, told by the fields of ``hints``; else empty."""
    at = lambda name: F.trim(F.get_json_object(parsed, f"$.{name}"))
    as_list = lambda c: F.when(c.startswith("["), F.from_json(c, "array<string>")).when(c.startswith("{"), F.array(c))
    bare = F.when(reduce(lambda a, b: a | b, [at(h).isNotNull() for h in hints]), F.array(parsed))
    one = F.when(at("article").startswith("{"), F.array(at("article")))
    return F.coalesce(F.when(F.trim(parsed).startswith("["), F.from_json(parsed, "array<string>")), *[as_list(at(n)) for n in LIST_NAMES], one, bare, F.array().cast("array<string>"))


def type_from_prose(text: Column, hints: dict[str, tuple[str, ...]], fallback: Column) -> Column:
    """The first lane of ``hints`` of which a word occurs in a prose answer, else the fallback."""
    first, *rest = hints.items()
    return reduce(lambda acc, kv: acc.when(contains_any(F.coalesce(text, F.lit("")), kv[1]), kv[0]), rest, F.when(contains_any(F.coalesce(text, F.lit("")), first[1]), first[0])).otherwise(fallback)


def sentences(text: Column) -> Column:
    """Sentences of a prose answer, without blanks around them, fences and bullets."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), "```(?:json)?|(?m)^\\s*[-*•]+\\s*", "")
    return F.filter(F.transform(F.split(bare, "(?<=[.!?…])\\s+|\\n+"), lambda s: F.trim(s)), lambda s: s != "")


def missing_fields(parsed: Column, names: list[str]) -> Column:
    """Names, sorted, of fields of a JSON text that are absent or null."""
    return F.filter(F.array(*[F.when(F.get_json_object(parsed, f"$.{n}").isNull(), n) for n in sorted(names)]), lambda x: x.isNotNull())


def json_status(raw: Column, parsed: Column, missing: Column) -> Column:
    straight = F.get_json_object(raw, "$").isNotNull()
    return F.when(parsed.isNull(), "fallback").when(F.size(missing) > 0, "recovered_json").when(straight, "valid_json").otherwise("repaired_json")


def looks_like_prose(text: Column) -> Column:
    t = F.trim(F.coalesce(text, F.lit("")))
    return (F.length(t) > 40) & ~t.contains("{") & (F.regexp_count(t, F.lit("[.!?](\\s|$)")) >= 1)
