"""Words in whole texts by the automaton, tags, topics, and cut-offs that grow with the table, against plain versions."""

import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from briefwell.functions import automaton
from briefwell.operators import dedup, ranking, records, reports, tags

RNG = random.Random(4)


def plain_found(text, words, bounded):
    hit = lambda w: re.search(rf"(?<![A-Za-z0-9_]){re.escape(w)}(?![A-Za-z0-9_])", text) if w in bounded else w in text
    return [k for k, w in enumerate(words) if w and hit(w)]


def test_automaton_finds_all_words(monkeypatch):
    words = tuple(dict.fromkeys("".join(RNG.choice("abé ") for _ in range(RNG.randrange(1, 7))) for _ in range(120)))
    bounded = frozenset(w for w in words[::2] if w.isascii() and " " not in w)
    texts = ["".join(RNG.choice("abé .") for _ in range(n)) for n in (0, 1, 2, 7, 1023, 1024, 1025, 1030, 5000) for _ in range(6)] + ["ab" * 5000, "a" * 3000]
    for room in (32 << 20, 1024 * 90):  # one automaton, then many
        monkeypatch.setattr(automaton, "MOST_BYTES", room)
        automaton.automata.cache_clear()
        got = {k: set() for k in range(len(texts))}
        for machine in automaton.automata(words, bounded):
            for row, word in zip(*machine.found(pa.array(["x", *texts])[1:])):
                got[row].add(int(word))
        assert [sorted(got[k]) for k in range(len(texts))] == [plain_found(t, words, bounded) for t in texts]
    assert len(automaton.automata(words, bounded)) > 1
    automaton.automata.cache_clear()


def test_automaton_over_piece_ends(monkeypatch):
    monkeypatch.setattr(automaton, "PIECE", 5)
    monkeypatch.setattr(automaton, "ABREAST", 3)
    words, texts = ("abcab", "cab", "bca", "zz"), ["".join(RNG.choice("abc") for _ in range(n)) for n in range(60)]
    machine = automaton.Automaton([(k, w.encode(), w == "cab") for k, w in enumerate(words)])
    found = set(zip(*(x.tolist() for x in machine.found(pa.array(texts)))))
    assert found == {(r, k) for r, t in enumerate(texts) for k in plain_found(t, words, {"cab"})}


def test_words_found_odd_rows(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "z" * 100_000 + " agent"), (4, "agents")], "id int, t string")
    words = ("agent", "", "agents", "é")
    got = {r.id: r.w for r in rows.select("id", automaton.words_found(F.col("t"), words, frozenset(["agent"])).alias("w")).collect()}
    assert got == {1: [], 2: [], 3: [0], 4: [2]}
    assert rows.filter("id > 9").select(automaton.words_found(F.col("t"), words)).collect() == []
    assert [r[0] for r in rows.filter("id = 1").select(automaton.words_found(F.col("t"), ())).collect()] == [[]]


def test_taxonomy_tags(spark):
    title = "AI startup raises $1 billion to expand GPU data center capacity in Vietnam"
    cases = [
        (1, title, "", ["tech", "infrastructure", "startups", "1bn"], "Business", 74, ["infrastructure", "funding", "vietnam"]),
        (2, None, None, None, "Product", 34, []),
        (3, None, None, None, "Product", 35, ["product_update"]),
        (4, "x", None, [], "Business", 90, []),
        (5, "capital rapid embankment", None, [None, " Open-Source ", "open_source", "M&A"], None, None, ["open_source", "acquisition"]),  # parts of words are no signals
        (6, "x", "far " * 40_000 + "Series  A in Hà Nội, Việt\nNam", None, None, 0, ["funding", "vietnam"]),
        (7, "open-source red\tteam llm sdk", None, [], None, 0, ["safety", "model_release", "api_platform"]),
    ]
    rows = spark.createDataFrame([c[:6] for c in cases], "ord int, title string, content string, tags array<string>, primary_type string, total_score int")
    got = {r.ord: r.tags for r in tags.with_taxonomy_tags(rows).collect()}
    assert got == {c[0]: c[6] for c in cases}
    assert tags.with_taxonomy_tags(rows).columns == [*[c for c in rows.columns if c != "tags"], "tags"]
    assert tags.with_taxonomy_tags(rows.select("ord")).select("tags").distinct().collect() == [([],)]


def test_topics_of_any_number(spark):
    rows = spark.createDataFrame([(1, "GPU clusters for agent workflow"), (2, "an agent"), (3, "topic 12345 here"), (4, None)], "ord int, t string")
    many = [(f"topic {k}",) for k in range(12_000)] + [("agent workflow tools",), ("agent",), (" ",), (None,), ("agent",), ("a b",)]
    got = {(r.topic, r.ord) for r in records.topic_hits(rows, spark.createDataFrame(many, "topic string"), F.col("t")).collect()}
    assert ("agent workflow tools", 1) in got and ("agent workflow tools", 2) not in got and {("agent", 1), ("agent", 2)} <= got
    assert ("topic 1234", 3) in got and ("topic 123", 3) in got and ("topic 999", 3) not in got and ("topic 2", 3) in got and not any(t.strip() in ("", "a b") for t, _ in got)
    scored = rows.withColumn("total_score", F.col("ord"))
    terms = spark.createDataFrame([("x", "agent"), ("y", "agent"), ("y", "none of it")], "kind string, term string")
    best = reports.watchlist_matches(scored, terms, F.col("t"), [F.col("total_score").desc()], 1)
    assert {(r.kind, r.term, r.ord, r.n_signals, r.max_score) for r in best.collect()} == {("x", "agent", 2, 2, 2), ("y", "agent", 2, 2, 2)}


def test_first_rows(spark):
    values = [(k, RNG.randrange(20)) for k in range(500)]
    rows = spark.createDataFrame(values, "id int, v int").repartition(3)
    order = [F.col("v").desc(), F.col("id")]
    ranked = [i for i, _ in sorted(values, key=lambda x: (-x[1], x[0]))]
    for n in (0, 1, 250, 499, 500, 900):
        assert {r.id for r in ranking.first_rows(rows, order, n).collect()} == set(ranked[:n])
        assert ranking.first_rows(rows, order, n, ["id"]).columns == ["id"]
    tied = ranking.first_rows(rows, [F.col("v").desc()], 123)
    assert sorted(-r.v for r in tied.collect()) == sorted(-v for _, v in values)[:123]
    assert ranking.first_rows(rows.filter("id < 0"), order, 5).collect() == []


def test_rescue_of_a_share(spark):
    rows = spark.createDataFrame([(k, f"t{k % 40}", k % 7, k % 11) for k in range(300)], "ord int, title string, r int, s int")
    reason = F.when(F.col("r") == 0, "hard").when(F.col("r") < 4, "soft")
    got = {x.ord: (x.filter_reason, x.rescued) for x in dedup.early_filter(rows, [F.col("ord")], F.col("title"), reason, [F.col("s").desc(), F.col("ord")], 100, ("hard",)).collect()}
    first, told = {}, {}
    for k in range(300):
        rule = "hard" if k % 7 == 0 else "soft" if k % 7 < 4 else None
        told[k] = "duplicate_title" if first.get(k % 40, k) < k else rule
        if rule is None:
            first.setdefault(k % 40, k)
    missing = 100 - sum(v is None for v in told.values())
    back = set(sorted((k for k, v in told.items() if v == "soft"), key=lambda k: (-(k % 11), k))[:missing])
    assert got == {k: (None if k in back else v, k in back) for k, v in told.items()}


def test_places_within_hot_keys(spark):
    values = [(k, RNG.choice(["hot"] * 8 + ["a", "b", None]), RNG.randrange(30)) for k in range(900)]
    rows = spark.createDataFrame(values, "id int, key string, v int").repartition(5)
    got = {r.id: (r.key, r.place) for r in ranking.numbered(rows, "key", [F.col("v").desc(), F.col("id")], "place", ["id", "key"]).collect()}
    want = {}
    for key in ("hot", "a", "b"):
        own = sorted((x for x in values if x[1] == key), key=lambda x: (-x[2], x[0]))
        want |= {i: (key, place) for place, (i, _, _) in enumerate(own, 1)}
    assert got == want
    assert ranking.numbered(rows.limit(0), "key", [F.col("id")], "place", ["id"]).collect() == []
