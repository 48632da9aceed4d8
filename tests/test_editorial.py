"""Editorial rules against plain versions: text for delivery, judgement, gates, recall, answers."""

import json
import math
import re

import pytest
from pyspark.sql import functions as F

from briefwell.functions import repair
from briefwell.operators import classify, delivery, gates, recall, routing, scoring, selection, signals


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


# --- delivery ------------------------------------------------------------------------------------------------------


def sentence(t):
    t = re.sub(delivery.DANGLING, "", t, flags=re.I).strip(" ,;:-")
    return delivery.NO_TEXT if not t else t if t[-1] in ".!?…" else t + "."


def cleaned(t, most):
    t = re.sub(r"\s+", " ", t or "").strip()
    return t if len(t) <= most else t[: most - 1].rstrip() + "…"


def sanitised(t, most):
    t = re.sub(delivery.NOTE_PREFIX, "", cleaned(t, most * 2), flags=re.I)
    parts = [s.strip() for s in re.split(r"(?<=[.!?…])\s+", cleaned(t, 900)) if s.strip()]
    t = " ".join(s for s in parts if not any(re.search(p, s.lower()) for p in delivery.ADVICE))
    t = re.sub(delivery.CJK_STOP, " ", re.sub(delivery.CJK, " ", t))
    for pattern, by in delivery.INTERNAL:
        t = re.sub(pattern, by, t, flags=re.I)
    t = sentence(re.sub(r"\s+", " ", t).strip())
    return t if len(t) <= most else sentence(t[:most].rsplit(" ", 1)[0].rstrip(" ,;:-"))


TEXTS = [None, "", "  ", "Một tin ngắn", "Ý chính của tin này là: OpenAI ra mắt model mới. Team nên thử ngay. Giá giảm 20%", "Cập nhật 任务管理器 mới。 Xong", "Bài dài " * 80, "Kết quả tốt nhưng", "Đây là tín hiệu yếu và mơ hồ. Tin chính ở đây!", "Cần theo dõi thêm. Chỉ câu này còn lại", "Doanh nghiệp vừa nên cân nhắc. Giữ lại", "Nguồn tin còn yếu. Vẫn còn", "x" * 400]


def test_sanitised_text_equals_a_plain_version(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    for most in (60, 260):
        got = {r.i: r.x for r in rows.select("i", delivery.sanitised(F.col("t"), most).alias("x")).collect()}
        assert got == {i: sanitised(t, most) for i, t in enumerate(TEXTS)}


def test_copy_prefers_the_blurb_then_facts(spark):
    rows = spark.createDataFrame([(1, "Title", "Blurb here", None, None), (2, "Title", None, "facts stand", "nhưng giá tăng"), (3, "Title", None, "same words", "Same words"), (4, "Only a title", "", None, None), (5, None, None, None, None)], "i int, title string, telegram_blurb_vi string, factual_summary_vi string, why_it_matters_vi string")
    got = {r.i: r.delivery_copy for r in delivery.with_copy(rows).collect()}
    assert got == {1: "Blurb here.", 2: "Facts stand, nhưng giá tăng.", 3: "Same words.", 4: "Only a title.", 5: ""}
    weak = rows.withColumn("telegram_blurb_vi", F.when(F.col("i") == 1, "Bài này là tín hiệu sơ bộ và chưa có gì thêm để nói ở đây").otherwise("Một bản tin đủ dài để gửi đi cho người đọc hôm nay"))
    assert {r.i for r in delivery.eligible(weak).collect()} == {2, 3, 4, 5}


def test_messages_are_checked_and_gated(spark):
    good = '<b>🚀 Product | 31/01</b>\n\n<b>A</b>\nText\n<a href="https://a.b/x">Đọc thêm</a>'
    messages = spark.createDataFrame([(1, good), (2, "plain https://x.y"), (3, good.replace("a.b", "evil.c")), (4, None)], "id int, message string")
    links = spark.createDataFrame([("HTTPS://A.b/x/#top",)], "url string")
    got = {r.id: r.warnings for r in delivery.checked_messages(messages, links, False, "31/01").collect()}
    assert got == {1: [], 2: ["missing_or_wrong_header", "raw_urls_present"], 3: ["unknown_links_present"], 4: ["missing_or_wrong_header"]}
    safe = messages.limit(0).unionByName(spark.createDataFrame([(9, "safe")], "id int, message string"))
    for kept, mode in (([1], "deterministic_sections"), ([1, 3], "safe_fallback"), ([], "safe_fallback")):
        some = messages.filter(F.col("id").isin(*kept)) if kept else messages.limit(0)
        out = delivery.gated_messages(some, safe, delivery.checked_messages(some, links, False, "31/01")).collect()
        assert {r.summary_mode for r in out} == {mode} and len(out) == 1


# --- judgement -----------------------------------------------------------------------------------------------------

ROW = dict(source_kind="official", source_domain="a.com", title="New API", main_brief_score=66, delivery_lane_candidate="main", main_brief_eligibility="eligible", main_brief_skip_reason="", is_ai_relevant=True, is_stale_candidate=False, is_old_news=False, freshness_bucket="fresh", age_hours=30.0, freshness_unknown=False, project_fit="high", confidence_label="medium", event_cluster_size=1, event_is_primary=True)
KINDS = "source_kind string, source_domain string, title string, main_brief_score int, delivery_lane_candidate string, main_brief_eligibility string, main_brief_skip_reason string, is_ai_relevant boolean, is_stale_candidate boolean, is_old_news boolean, freshness_bucket string, age_hours double, freshness_unknown boolean, project_fit string, confidence_label string, event_cluster_size int, event_is_primary boolean"


@pytest.mark.parametrize(
    "change, scores, decision, reason",
    [
        ({}, (3, 5, 4), "include", ""),
        ({"is_ai_relevant": False}, (3, 4, 0), "skip", "not_ai"),
        ({"source_domain": "theverge.com", "title": "Album review"}, (3, 4, 0), "skip", "not_ai"),
        ({"event_cluster_size": 3}, (4, 5, 5), "include", ""),
        ({"event_is_primary": False}, (3, 4, 4), "skip", "duplicate_event"),
        ({"age_hours": 200.0}, (3, 0, 4), "skip", "stale"),
        ({"title": "AI Summit: get your ticket"}, (3, 4, 3), "skip", "promo"),
        ({"source_kind": "community", "title": "Is it a leak?"}, (2, 4, 3), "skip", "speculation"),
        ({"delivery_lane_candidate": "github"}, (3, 5, 4), "skip", "github_topic_only"),
        ({"main_brief_eligibility": "ineligible", "project_fit": "low"}, (3, 5, 4), "skip", "low_operator_value"),
        ({"main_brief_eligibility": "review", "main_brief_skip_reason": "weak_signal"}, (3, 5, 4), "review", "weak_signal"),
        ({"is_ai_relevant": None, "event_is_primary": None, "age_hours": None, "freshness_unknown": True}, (3, 2, 4), "include", ""),
    ],
)
def test_judge_cases(spark, change, scores, decision, reason):
    r = routing.judge(spark.createDataFrame([tuple((ROW | change).values())], KINDS)).first()
    assert ((r.groundedness_score, r.freshness_score, r.operator_value_score), r.delivery_decision, r.delivery_route_reason) == (scores, decision, reason)


def test_selection_of_few(spark):
    judged = spark.createDataFrame([(1, "official", 90, 14, "high"), (2, "unknown", 90, 14, "high"), (3, "unknown", 10, 11, "low")], "ord int, source_kind string, main_brief_score int, delivery_score int, project_fit string")
    judged = judged.withColumn("delivery_decision", F.lit("include")).withColumn("delivery_lane_candidate", F.lit("main")).withColumn("primary_type", F.lit("Product")).withColumn("main_brief_reason_codes", F.array().cast("array<string>"))
    assert {r.ord: r.selected for r in selection.select_main_brief(judged).collect()} == {1: True, 2: True, 3: False}
    only = judged.filter("ord = 3")  # nothing passes the floor: the best as they are
    assert [r.selected for r in selection.select_main_brief(only).collect()] == [True]
    assert selection.select_main_brief(judged.limit(0)).count() == 0


def test_ledger_adds_up(spark):
    rows = spark.createDataFrame([(i, i * 7 % 101, ["deep", "basic", "skip"][i % 3], float(i * 11 % 300), i % 4 == 0) for i in range(60)], "ord int, total_score int, analysis_tier string, age_hours double, is_old_news boolean")
    for r in classify.history_step(classify.freshness_step(classify.strategic_boost(rows))).collect():
        total = r.ord * 7 % 101
        for move in r.applied_adjustments:
            assert move.before == total and move.after - move.before == move.delta != 0
            total = move.after
        assert total == r.total_score and 0 <= total <= 100


def test_answers_fill_in(spark):
    rows = scoring.with_prefilter(spark.createDataFrame([(i, "OpenAI launches API") for i in range(4)], "ord int, title string"))
    answers = spark.createDataFrame([(0, json.dumps({"c1_score": 99, "c2_score": "x", "summary_vi": "s"})), (1, "not json"), (2, json.dumps({"c1_score": 20, "c2_score": 20, "c3_score": 25, "analysis_tier": "Deep", "relevance_level": "High", "primary_type": "Practical", "summary_vi": "s", "tags": []}))], "ord int, answer string")
    got = {r.ord: r for r in classify.apply_answers(rows, answers).collect()}
    assert got[0].total_score == 33 and got[0].classify_json_status == "partial_recovery" and "c2_score" in got[0].classify_json_missing_fields
    assert got[2].total_score == 65 and got[2].classify_json_status == "valid_json" and got[2].analysis_tier == "deep" and got[2].primary_type == "Practical"
    assert got[3].classify_json_status == "hard_fallback" and got[3].total_score > 0


def test_top_articles(spark):
    rows = spark.createDataFrame([(i, i * 10, "deep" if i == 0 else "basic") for i in range(10)], "ord int, total_score int, analysis_tier string")
    order = [F.col("total_score").desc(), F.col("ord")]
    assert {r.ord for r in classify.top_articles(rows, order).collect()} == {0, 7, 8, 9}
    assert {r.ord for r in classify.top_articles(rows.filter("ord < 4 and ord > 0"), order).collect()} == {1, 2, 3}
    assert classify.top_articles(rows.limit(0), order).count() == 0


def test_signals_of_empty_rows(spark):
    r = signals.with_signals(spark.createDataFrame([(1,)], "ord int")).first()
    assert (r.operator_strength, r.novelty_strength, r.github_significant, r.society, r.project_fit) == (0, 0, False, False, "low")


# --- gates, recall, answers ----------------------------------------------------------------------------------------


@pytest.mark.parametrize("url, trusted, is_article", [("https://a.b/", False, False), ("https://a.b/news", False, False), ("https://a.b/tag/ai-x", True, False), ("https://a.b/story-1", False, True), ("https://a.b/abc", False, False), ("https://a.b/abc", True, True), ("https://a.b/en/ab-1", True, False), (None, True, False)])
def test_article_urls(spark, url, trusted, is_article):
    assert one(spark, gates.article_url(F.lit(url).cast("string"), F.lit(trusted))) is is_article


def test_recall_equals_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(recall, "BLOCK_VALUES", 12)
    vectors = {i: [math.sin(i * k + 1) for k in range(1, 5)] for i in range(60)} | {60: [0.0] * 4, 61: None, 62: [1.0, None, 0.0, 0.0], 63: [float("nan")] * 4, 64: vectors_of_zero()}
    items = spark.createDataFrame(list(vectors.items()), "id long, vector array<double>").repartition(3)
    good = {i: v for i, v in vectors.items() if i < 60}
    unit = {i: [x / math.sqrt(sum(y * y for y in v)) for x in v] for i, v in good.items()}
    got = {}
    for r in recall.recall(items.filter("id % 9 = 0"), items, 3).collect():
        got.setdefault(r.query_id, []).append((r.place, r.id, r.distance))
    for q in [i for i in good if i % 9 == 0]:
        near = sorted((round(1 - sum(a * b for a, b in zip(unit[q], v)), 4), i) for i, v in unit.items() if i != q)[:3]
        assert [(p, i) for p, i, _ in sorted(got[q])] == [(k + 1, i) for k, (_, i) in enumerate(near)]
    assert set(got) == {i for i in good if i % 9 == 0} and recall.recall(items.limit(0), items, 3).count() == 0


def vectors_of_zero():
    return []


@pytest.mark.parametrize("raw, ids", [('{"articles": [{"item_id": 1}, {"item_id": 2}]}', ["1", "2"]), ('{"articles": "[{\\"item_id\\": 3}]"}', ["3"]), ('{"data": {"item_id": 4}}', ["4"]), ('[{"item_id": 5}]', ["5"]), ('{"item_id": 6}', ["6"]), ('{"x": 1}', []), (None, [])])
def test_answers_in_any_shape(spark, raw, ids):
    found = repair.answers_in(F.lit(raw).cast("string"))
    assert one(spark, F.transform(found, lambda x: F.get_json_object(x, "$.item_id"))) == ids


def test_a_whole_run(spark, sf):
    from briefwell.plans.queries import QUERIES

    rows = QUERIES["brief_run"](spark, sf).collect()
    assert len({r.ord for r in rows}) == len(rows) >= 8
    shown = [r for r in rows if r.selected]
    assert len(shown) <= 6 and all(r.delivery_decision == "include" and r.delivery_lane_candidate == "main" for r in shown)
    assert all((r.delivery_skip_reason != "") == (r.delivery_decision == "skip") for r in rows)
