"""Scores of posts read each text as seldom as they need, with the same results."""

import pytest
from pyspark.sql import functions as F

from briefwell.operators import social


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_posts_are_lowered_once_and_not_rewritten(spark):
    posts = spark.createDataFrame([(1, "t", "c")], "ord int, title string, content string")
    text = plan(social.post_scores(posts))
    assert "regexp_replace" not in text and text.count("lower(_whole") == 1


@pytest.mark.parametrize("content, short", [("x" * 179, True), ("x" * 180, False), ("  " + "x" * 179 + "\n\n" * 200, True), (" a" + "\n" * 178 + "b ", False), (" " * 900, True), ("😀" * 179, True), ("😀" * 180, False), (None, True)])
def test_blanks_around_a_post_do_not_count(spark, content, short):
    text = F.coalesce(F.lit(content).cast("string"), F.lit(""))
    assert spark.range(1).select(text.rlike(social.LONG_TEXT)).first()[0] is not short


@pytest.mark.parametrize("text, style", [("a caſe ſtudy", "case_study"), ("Regıster", "promo"), ("ĐĂNG KÝ ngay", "promo"), ("preregistered", "news_recap"), ("Points of it", "benchmark"), ("K8 SALE", "promo")])
def test_styles_by_patterns_only_where_a_word_occurs(spark, text, style):
    assert spark.range(1).select(social.content_style(F.lit(text), F.lit(""))).first()[0] == style
