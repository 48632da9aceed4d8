"""Pairs of titles are tested where they meet: no candidate is shuffled, no pair is lost or found twice."""

import random

from pyspark.sql import functions as F

from briefwell.operators import events
from briefwell.plans.adapters import articles


def test_pairs_of_common_tokens_and_cut_slugs(spark, monkeypatch):
    monkeypatch.setattr(events, "TILE", 3)
    monkeypatch.setattr(events, "BATCH", 20)
    rng = random.Random(11)
    titles = [" ".join(f"w{int(rng.random() ** 2 * 40)}x" for _ in range(1 + i % 13)) for i in range(160)]
    titles += [t[a : a + rng.choice((18, 25, 36, 40, 72))] for t in titles[60:] if len(t) > 40 for a in (rng.randrange(9),)]
    titles += ["of it to us in at by on", "it to us in at by on so new chip", "a-b c-d e-f g-h i-j k-l", "so a b c d e f g h i j k l thing"]
    frame = spark.createDataFrame([(i, t, i * 7 % 30) for i, t in enumerate(titles)], "ord int, title string, total_score int")
    classes = {r.id: (set(r.tokens), r.slug) for r in events.title_classes(frame).filter("id = class_id").collect()}

    def same(p, q):
        (a, x), (b, y) = sorted((classes[p], classes[q]), key=lambda c: len(c[1]))
        both = len(a & b)
        share, least = both / len(a | b), min(len(a), len(b))
        return share >= 0.6 or (both >= 3 and share >= 0.4) or (both == least >= 3) or (len(x) >= 18 and x in y)

    pairs = events.event_pairs(frame)
    got = [(r.a, r.b) for r in pairs.collect()]
    assert len(set(got)) == len(got) > 200
    assert set(got) == {(p, q) for p in classes for q in classes if p < q and same(p, q)}
    assert "hashpartitioning(a#" not in pairs._jdf.queryExecution().executedPlan().toString()
    order = [-F.col("total_score"), F.col("ord")]
    assert sorted(map(tuple, events.event_clusters(frame, None, order).collect())) == sorted(map(tuple, events.event_clusters(frame, pairs, order).collect()))


def test_titles_are_cut_before_rows_meet_labels(spark, sf):
    plan = articles(spark, sf).select("ord", "title", "is_ai_relevant")._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.index("Join LeftOuter") < plan.index("substring(text")
