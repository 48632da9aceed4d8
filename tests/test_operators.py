"""Operators on small fixtures, with nulls and ties."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from briefwell.config import TITLE_STOPWORDS
from briefwell.functions import dates, text, urls
from briefwell.operators import dedup, events, history, ranking, reports, routing, scoring
from briefwell.plans.adapters import POLICY


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize("age, bucket", [(-5.0, "breaking"), (24.0, "breaking"), (24.1, "fresh"), (168.0, "recent"), (720.0, "aging"), (721.0, "stale"), (None, "unknown")])
def test_freshness(spark, age, bucket):
    assert one(spark, dates.freshness_bucket(F.lit(age).cast("double"))) == bucket


def test_falsy_zero_and_three_valued_flags(spark):
    assert one(spark, text.falsy(F.lit(0), 50)) == 50
    assert one(spark, text.falsy(F.lit(None).cast("int"), 50)) == 50
    assert one(spark, text.falsy(F.lit(7), 50)) == 7
    assert one(spark, text.is_false(F.lit(None).cast("boolean"))) is False


@pytest.mark.parametrize("url, host", [("https://WWW.Example.com/a", "example.com"), ("no url", ""), (None, ""), ("http://a.b.c:80/x", "a.b.c:80")])
def test_domain(spark, url, host):
    assert one(spark, urls.domain(F.lit(url).cast("string"))) == host


def test_source_kind_order(spark):
    kind = lambda source, host, **k: one(spark, urls.source_kind(POLICY, F.lit(source), F.lit(host), **k))
    assert kind("x", "src0.example.com") == "official"
    assert kind("x", "github.com") == "github"
    assert kind("x", "src0.example.com", social=F.lit(True)) == "community"
    assert kind("Hacker News", "news.ycombinator.com") == "community"
    assert kind("DuckDuckGo: q", "a.b") == "search"
    assert kind("x", "a.b", quality=F.lit("high")) == "watchlist"


def test_dates(spark):
    for url, day in (("https://a.b/2024/01/05/x", "2024-01-05"), ("https://a.b/2024/13/05/x", None), ("https://a.b/2023/02/30/x", None), ("https://a.b/n-20240105.html", "2024-01-05"), ("https://a.b/x240105y", "2024-01-05"), ("https://a.b/199912", None), ("https://a.b/id-99240105", "2024-01-05"), (None, None)):
        assert str(one(spark, urls.date_in_path(F.lit(url).cast("string")))) == str(day), url
    for given, moment in (("2024-01-05T10:00:00+07:00", "2024-01-05 03:00:00"), ("2024-01-05T10:00:00.250Z", "2024-01-05 10:00:00.250000"), ("2024-01-05 10:00:00-0530", "2024-01-05 15:30:00"), ("Fri, 05 Jan 2024 10:00:00 GMT", "2024-01-05 10:00:00"), ("5 Jan 2024 10:00:00 +0700", "2024-01-05 03:00:00"), ("Fri, 05 Jan 2024 10:00:00 EST", "2024-01-05 15:00:00"), ("2024-01-05", "2024-01-05 00:00:00"), ("05/01/2024 07:30", "2024-01-05 07:30:00"), ("05/01/2024", "2024-01-05 00:00:00"), (" 2024-01-05T10:00 ", "2024-01-05 10:00:00"), ("2024-13-05", None), ("", None), (None, None)):
        assert str(one(spark, dates.parse_timestamp(F.lit(given).cast("string")))) == str(moment), given
    assert str(one(spark, dates.parse_timestamp(F.lit("2024-01-05T10:00:00Z")))) == "2024-01-05 10:00:00"
    assert one(spark, dates.parse_timestamp(F.lit("soon"))) is None
    assert one(spark, dates.hint_hours(F.lit("2 days ago"))) == 48.0
    assert one(spark, dates.hint_hours(F.lit("1 năm"))) == 8760.0
    assert [one(spark, dates.hint_hours(F.lit(h).cast("string"))) for h in ("hôm qua", "vừa xong", "Yesterday at noon", "about 3 days", "3 daylight", "30 mins", None)] == [24.0, 0.0, None, None, None, 0.5, None]


def test_component_split_sums_up(spark):
    parts = scoring.split_components(F.col("id").cast("int"))
    for r in spark.range(0, 101).select("id", *[p.alias(f"c{k}") for k, p in enumerate(parts)]).collect():
        assert r.c0 + r.c1 + r.c2 == r.id and r.c0 <= 33 and r.c1 <= 33 and r.c2 <= 34


def test_prefilter_reasons_sum_to_score(spark):
    rows = spark.createDataFrame([("a", "official", 95, "fresh", True, None, False), ("c", "community", 74, "stale", False, 5, None)], "source_tier string, source_kind string, source_priority int, freshness_bucket string, content_available boolean, community_signal_strength int, is_ai_relevant boolean")
    for r in scoring.with_prefilter(rows).collect():
        assert r.prefilter_score == sum(int(re.search(r"[+-]\d+$", x).group()) for x in r.prefilter_reasons)


@pytest.mark.parametrize("n", [1, 5, 6, 10, 90])
def test_cutoff(spark, n):
    scores = [random.Random(n).randrange(100) for _ in range(n)]
    rows = spark.createDataFrame([(s,) for s in scores], "s int")
    assert ranking.score_cutoff(rows, "s").first()["cutoff"] == (sorted(scores)[int(n * 0.7)] if n > 5 else 55)
    assert ranking.score_cutoff(rows.limit(0), "s").first()["cutoff"] == 55


def test_early_filter_twins_and_rescue(spark):
    rows = spark.createDataFrame([(1, "A", 5), (2, "a ", 50), (3, "a", 60), (4, "", 40), (5, None, 3), (6, "b", 7)], "ord int, title string, score int")
    out = dedup.early_filter(rows, [F.col("ord")], F.col("title"), F.when(F.col("score") < 10, "weak"), [F.col("score").desc(), F.col("ord")], 3, ())
    got = {r.ord: (r.filter_reason, r.rescued) for r in out.collect()}
    assert got[1] == ("weak", False) and got[2] == (None, False) and got[3] == ("duplicate_title", False) and got[4] == (None, False)
    assert got[6] == (None, True) and got[5] == ("weak", False)


def test_history_quality_and_merge(spark):
    counts = "runs_seen int, raw_articles int, scored_articles int, selected_main int, selected_github int, selected_facebook int, skipped_old int, skipped_speculation int, skipped_promo int, skipped_weak int"
    rows = spark.createDataFrame([("s", "2024-01-01", 5, 18, 14, 0, 0, 0, 5, 3, 2, 4), ("new", "", 1, 3, 3, 3, 0, 0, 0, 0, 0, 0)], "source_key string, last_selected_at string, " + counts)
    got = {r.source_key: r for r in history.with_quality(rows).collect()}
    assert got["s"].penalty >= 8 and got["s"].quality_score <= 35 and got["new"].quality_score == 50
    merged = {r.source_key: r for r in history.merge_history(rows, rows.withColumn("last_selected_at", F.lit(""))).collect()}
    assert merged["s"].runs_seen == 10 and merged["s"].last_selected_at == "2024-01-01"


def test_routing_cases(spark):
    base = dict(source_kind="official", total_score=62, is_ai_relevant=True, is_stale_candidate=False, is_old_news=False, freshness_unknown=False, content_available=True, fresh_signal=True, project_fit="high", operator_strength=6, novelty_strength=3, github_significant=False, promo=False, speculation=False)
    schema = "source_kind string, total_score int, is_ai_relevant boolean, is_stale_candidate boolean, is_old_news boolean, freshness_unknown boolean, content_available boolean, fresh_signal boolean, project_fit string, operator_strength int, novelty_strength int, github_significant boolean, promo boolean, speculation boolean"
    cases = [({}, "main", "eligible", ""), ({"is_ai_relevant": False}, "archive_only", "ineligible", "not_ai"), ({"is_ai_relevant": None}, "main", "eligible", ""), ({"is_stale_candidate": True}, "archive_only", "ineligible", "stale"), ({"source_kind": "github", "total_score": 66}, "github", "review", "github_topic_only")]
    rows = spark.createDataFrame([tuple((base | change).values()) for change, *_ in cases], schema)
    for r, (_, lane, state, why) in zip(routing.route(rows).collect(), cases):
        assert (r.delivery_lane_candidate, r.main_brief_eligibility, r.main_brief_skip_reason) == (lane, state, why)


STOP = set(TITLE_STOPWORDS)


def tokens_and_slug(title):
    key = re.sub("[^\x00-\x7f]", "", unicodedata.normalize("NFKD", title)).lower()
    return {w for w in re.findall("[a-z0-9]+", key) if len(w) >= 3 and w not in STOP}, re.sub("[^a-z0-9]+", " ", key).strip()


def alike(a, b):
    (x, u), (y, v) = tokens_and_slug(a), tokens_and_slug(b)
    if not x or not y:
        return False
    both = len(x & y)
    j = both / len(x | y)
    if j >= 0.6 or (both >= 3 and j >= 0.4) or (both == min(len(x), len(y)) and both >= 3):
        return True
    return len(u) >= 18 and len(v) >= 18 and (u in v or v in u)


def test_event_clusters_are_greedy(spark):
    rng = random.Random(5)
    names = "openai mistral launch model agent chip cloud fund raises million bench score tool code open".split()
    rows = [(i, " ".join(rng.sample(names, rng.randint(1, 6))), rng.randrange(20)) for i in range(150)] + [(150, "", 5), (151, None, 5), (152, rng.choice(names) * 4, 3)]
    frame = spark.createDataFrame(rows, "ord int, title string, total_score int")
    order = [-F.col("total_score"), F.col("ord")]
    got = {r.ord: r.leader_id for r in events.event_clusters(frame, events.event_pairs(frame), order).collect()}
    leaders, expected = [], {}
    for ord_, title, _ in sorted(rows, key=lambda r: (-r[2], r[0])):
        first = next((n for n, t in leaders if alike(title or "", t or "")), None)
        if first is None:
            leaders.append((ord_, title))
        expected[ord_] = ord_ if first is None else first
    assert got == expected


def test_labels_and_warnings(spark):
    assert one(spark, reports.feedback_labels(F.lit("this is STALE, go deeper"))) == ["stale", "want_more_depth"]
    assert one(spark, reports.feedback_labels(F.lit(None).cast("string"))) == ["general_feedback"]
    assert one(spark, reports.message_warnings(F.lit("<b>x</b>"))) == ""
    assert one(spark, reports.message_warnings(F.lit("x<br><b>"))) == "missing_or_wrong_header,br_tag_present,unbalanced_bold_tags"


def test_message_chunks(spark):
    whole = "\n\n".join("x" * n for n in (10, 20, 30, 100, 5))
    pieces = one(spark, text.message_chunks(F.lit(whole), 40))
    assert [len(p) for p in pieces] == [32, 30, 100, 5] and "\n\n".join(pieces) == whole
    assert one(spark, text.message_chunks(F.lit(None).cast("string"), 40)) == []


@pytest.mark.parametrize("raw, fixed", [('{"a": 1}', {"a": 1}), ('```json\n{"a": [1, 2,],}\n```', {"a": [1, 2]}), ("{a: 'x', b: None, c: True", {"a": "x", "b": None, "c": True}), ("{“a”： 1｝", {"a": 1}), ('Sure: [{"a": "}"}] done', [{"a": "}"}]), ("no json", None), (None, None)])
def test_json_repair(raw, fixed):
    import json

    from briefwell.functions.repair import repaired

    got = repaired(raw)
    assert (json.loads(got) if got is not None else None) == fixed


def test_members_of_a_large_event_meet_its_leader_only(spark, monkeypatch):
    """Clusters without pairs of all classes: batch by batch, with as many pairs as members and not as their square."""
    written = []
    monkeypatch.setattr(events, "stored", lambda df, name, plain=events.stored: written.append((name, plain(df, name))) or written[-1][1])
    monkeypatch.setattr(events, "BATCH", 20)
    rng = random.Random(7)
    names = "openai mistral agent chip cloud fund raises million bench score tool code open".split()
    rows = [(i, "quick brown foxes jump over lazy dogs " + "".join(rng.sample("abcdefghij", 8)), rng.randrange(20)) for i in range(150)]
    rows += [(150 + i, " ".join(rng.sample(names, rng.randint(1, 6))), rng.randrange(20)) for i in range(100)] + [(250, "", 5), (251, None, 5)]
    frame = spark.createDataFrame(rows, "ord int, title string, total_score int")
    got = {r.ord: r.leader_id for r in events.event_clusters(frame, None, [-F.col("total_score"), F.col("ord")]).collect()}
    leaders, expected = [], {}
    for ord_, title, _ in sorted(rows, key=lambda r: (-r[2], r[0])):
        first = next((n for n, t in leaders if alike(title or "", t or "")), None)
        if first is None:
            leaders.append((ord_, title))
        expected[ord_] = ord_ if first is None else first
    assert got == expected
    assert sum(df.count() for name, df in written if name == "edges") < 1500
