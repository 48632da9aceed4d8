"""Cases in which an operator once did less than its whole job."""

import re
import unicodedata

from pyspark.sql import functions as F

from briefwell.config import TITLE_STOPWORDS
from briefwell.functions import text
from briefwell.operators import events, scoring


def reference_key(title):
    return unicodedata.normalize("NFKD", title or "").encode("ascii", "ignore").decode("ascii").lower()


def reference_tokens(title):
    return sorted({t for t in re.findall("[a-z0-9]+", reference_key(title)) if len(t) >= 3 and t not in TITLE_STOPWORDS})


def test_keys_fold_letters_of_every_language(spark):
    titles = ["Việt Nam điện", "TRÍ TUỆ NHÂN TẠO Ở HÀ NỘI", "Škoda ćevap, Žižkov a Dvořák", "Łódź źdźbło", "Ağrı İstanbul", "ﬁne ½ ²", "a\x01bcd", "straße ærø", "日本 2026", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "ord int, title string")
    got = rows.select("ord", text.ascii_key(F.col("title")).alias("k"), text.title_tokens(F.col("title")).alias("t"), text.title_slug(F.col("title")).alias("s")).orderBy("ord").collect()
    assert [r["k"] for r in got] == [reference_key(t) for t in titles]
    assert [r["t"] for r in got] == [reference_tokens(t) for t in titles]
    assert [r["s"] for r in got] == [re.sub("[^a-z0-9]+", " ", reference_key(t)).strip() for t in titles]


def test_vietnamese_titles_meet_their_plain_forms(spark):
    rows = spark.createDataFrame([(1, "Việt Nam phát triển trí tuệ nhân tạo"), (2, "Viet Nam phat trien tri tue nhan tao 2026"), (3, "Škoda představila nový elektromobil"), (4, "Skoda predstavila novy elektromobil")], "ord int, title string")
    assert {(r["a"], r["b"]) for r in events.event_pairs(rows).collect()} == {(1, 2)}
    assert {(r["id"], r["class_id"]) for r in events.title_classes(rows).collect()} == {(1, 1), (2, 2), (3, 3), (4, 3)}


def test_relevance_reads_whole_texts(spark):
    far = "word " * 2000
    cases = [
        ("openai.com", "", "", True, "ai_domain"),
        ("openai.com", "oil", far + "troops", False, "ai_domain,off_topic_hits:2,blocked:offtopic_dominant"),
        ("x.com", "GPT", far + "agents", True, "ai_hits:2"),
        ("x.com", "", far + "Trí tuệ nhân tạo", True, "ai_hits:1,borderline_ai_signal"),
        ("x.com", "chip", far + "oil", False, "ai_hits:1,off_topic_hits:1,blocked:weak_ai_signal"),
        ("x.com", "chip gpu robot", far + "oil stocks", False, "ai_hits:3,off_topic_hits:2,blocked:offtopic_dominant"),
        ("x.com", "chip gpu robot", far + "oil stocks llm", True, "ai_hits:4,off_topic_hits:2"),
        ("x.com", "artificial\n&#105;ntelligence", "chipé said", True, "ai_hits:1,borderline_ai_signal"),
        (None, None, None, False, "blocked:weak_ai_signal"),
    ]
    rows = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "n int, host string, title string, content string")
    got = rows.select("n", scoring.ai_relevance(F.col("host"), F.col("title"), F.col("content")).alias("r")).orderBy("n").collect()
    assert [(r["r"]["relevant"], r["r"]["signals"]) for r in got] == [c[3:] for c in cases]


def test_title_tokens_of_every_document(spark, sf):
    from briefwell.plans.adapters import articles
    from briefwell.plans.queries import QUERIES

    got = {r["ord"]: r["tokens"] for r in QUERIES["title_tokens_all"](spark, sf).collect()}
    titles = {r["ord"]: r["title"] for r in articles(spark, sf).select("ord", "title").collect()}
    assert got == {k: " ".join(reference_tokens(t)) or None for k, t in titles.items()}
