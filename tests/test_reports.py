"""Feedback commands and preferences, and topic pages of a watchlist, against cases worked out by hand."""

from pyspark.sql import functions as F

from briefwell.operators import reports

CASES = {
    "@bot cũ": ["stale"],
    " @BOT  tin cũ ": ["stale"],
    "#feedback: nguồn yếu": ["weak_source"],
    "Phản hồi - dang doc": ["good_pick"],
    "không nên lên brief": ["skip_delivery", "promote_delivery"],
    "@bot sai loại: a product, no research": ["wrong_type", "expected_type:research"],
    "sai loai": ["wrong_type"],
    "@botany": ["general_feedback"],
    "": ["general_feedback"],
    None: ["general_feedback"],
    "deeper, deeper for founder": ["want_more_depth", "founder_lens"],
}


def test_feedback_labels(spark):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(CASES)], "k int, t string")
    got = {r["t"]: r["l"] for r in rows.select("t", reports.feedback_labels(F.col("t"), "bot").alias("l")).collect()}
    assert got == CASES
    assert {r["c"] for r in rows.select(reports.clean_feedback(F.col("t"), "bot").alias("c")).collect()} >= {"cũ", "tin cũ", "nguồn yếu", "dang doc", ""}


def test_feedback_profile(spark):
    labels = [["weak_source"], ["weak_source", "skip_delivery"], ["expected_type:product", "wrong_type"], ["expected_type:policy"], ["expected_type:policy"], ["expected_type:business"], ["expected_type:society"]]
    p = reports.feedback_profile(spark.createDataFrame([(x,) for x in labels], "labels array<string>"), "labels").first()
    assert p["strict_source_review"] and p["delivery_bias"] == "suppress" and p["wrong_type"] == 1 and not p["prefer_depth"]
    assert p["preferred_types"] == ["policy", "business", "product"]
    none = reports.feedback_profile(spark.createDataFrame([], "labels array<string>"), "labels").first()
    assert none["delivery_bias"] == "neutral" and none["preferred_types"] == [] and none["stale"] == 0


def test_topic_pages(spark):
    kind = "ord int, total_score int, primary_type string, source_domain string, title string"
    rows = [(i, 50 + i, "Product" if i % 2 else "Business", f"h{i % 3}.com", "Agent Kit released") for i in range(8)]
    rows += [(20, 99, None, " ", "export controls"), (21, 10, "Policy", "a.com", "controls on EXPORT"), (22, 10, "Policy", None, None)]
    terms = [("topics", "agent  kit", 0), ("tools", "agent kit", 1), ("policy", "Export Controls", 2), ("companies", "Nobody", 3), ("other", "agent kit", 4), ("topics", " ", 5), ("topics", "agent kit", 6), ("topics", None, 7)]
    order = [F.col("total_score").desc(), F.col("ord")]
    terms = spark.createDataFrame(terms, "kind string, term string, place int")
    pages = reports.topic_pages(spark.createDataFrame(rows, kind), terms, F.col("title"), order, articles=5).orderBy("page").collect()
    assert [(p["page"], p["topic_group"], p["topic_slug"], p["signal_count"], p["n_signals"], p["max_score"]) for p in pages] == [(1, "Tool", "agent-kit", 5, 8, 57), (2, "Topic", "agent-kit", 5, 8, 57), (3, "Policy", "export-controls", 2, 2, 99)]
    assert pages[0]["lanes"] == {"Product": 3, "Business": 2} and pages[0]["hosts"] == ["h0.com", "h1.com", "h2.com"]
    assert [a["id"] for a in pages[0]["articles"]] == [7, 6, 5, 4, 3]
    assert pages[2]["lanes"] == {"unknown": 1, "Policy": 1} and pages[2]["hosts"] == ["a.com"]
    one = reports.topic_pages(spark.createDataFrame(rows, kind), terms, F.col("title"), order, topics=1)
    assert [p["topic_group"] for p in one.collect()] == ["Tool"]
    assert reports.topic_pages(spark.createDataFrame([], kind), terms, F.col("title"), order).count() == 0


def test_post_scores(spark):
    from briefwell.operators import social

    long = "Chúng tôi thử từng bước một và ghi lại. " * 20
    rows = [
        (0, "Bài test GPT vs Claude", long + "kết quả 9", "An AI fan", "profile", 80, " Manual "),
        (1, "Khóa học mới", "x", None, "group", None, None),
        (2, "Is it true?", "benchmark", "b", "page", 11, "joined"),
        (3, None, None, None, None, None, None),
        (4, "Quy trình production", "y" * 200, "", "other", 500, "followed"),
        (5, "bánh mì", long, "", "page", -500, ""),
        (6, "theo mình", "ok", "", "page", 0, ""),
    ]
    posts = spark.createDataFrame(rows, "ord int, title string, content string, social_author string, source_type string, ai_source_score int, discovery_origin string")
    got = {r["ord"]: (r["facebook_content_style"], r["facebook_boss_style_score"], r["facebook_authority_score"]) for r in social.post_scores(posts).collect()}
    # 30 + length // 180 + digit 8 + vs 10 + names 10 + tests 8 + style 26
    assert got[0] == ("benchmark", 30 + 4 + 8 + 10 + 10 + 8 + 26, 100)
    assert got[1] == ("promo", 0, 42) and got[2] == ("speculation", 4, 62) and got[3] == ("news_recap", 20, 45)
    assert got[4] == ("workflow", 30 + 1 + 10 + 16, 81)
    assert got[5][0] == "case_study" and got[5][2] == 0 and got[6] == ("opinion", 14, 52)
    again = social.post_scores(social.post_scores(posts.select("ord", "title")))
    assert again.columns == ["ord", "title", "facebook_content_style", "facebook_boss_style_score", "facebook_authority_score"] and again.count() == 7
    assert social.post_scores(posts.limit(0)).count() == 0
