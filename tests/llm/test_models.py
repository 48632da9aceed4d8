"""The two fitted classifiers against plain versions on small fixtures, and odd inputs of several operators."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from briefwell.llm import decontaminate, mixing, quality, token_counts, toxicity, url_filter, warc
from briefwell.llm.queries import URL_RULES

RNG = random.Random(4)


# --- toxicity chain ------------------------------------------------------------------------------------------------


def plain_terms(rows, least_docs=4, least_ratio=30.0):
    pos, neg = Counter(), Counter()
    for text, label in rows:
        (pos if label else neg).update({t for w in set(re.findall(r"[^\W\d_]+", text.lower())) for t in [w, *(w[:k] + "*" for k in (4, 5, 6) if len(w) > k)]})
    share = sum(label for _, label in rows) / len(rows)
    out = []
    for t, p in pos.items():
        n = neg[t]
        ratio = 2 * (p * math.log(p / ((p + n) * share)) + (n * math.log(n / ((p + n) * (1 - share))) if n else 0.0))
        if p >= least_docs and p > (p + n) * share and ratio >= least_ratio:
            out.append((-ratio, t))
    return [t for _, t in sorted(out)]


def plain_features(text, terms):
    words = re.findall(r"[^\W\d_]+", text.lower())
    counts = Counter(t for w in words for t in [w, *(w[:k] + "*" for k in (4, 5, 6) if len(w) > k)])
    there = [float(counts[t] > 0) for t in terms]
    n = sum(counts[t] for t in terms)
    return [*there, math.log1p(sum(there)), math.log1p(n), min(10.0, 100.0 * n / max(20, len(words)))]


def plain_logistic(x, y, ridge):
    """Newton's method for mean log loss plus ridge / 2 * |w|^2, the intercept free."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(z.shape[1]), np.append(np.full(x.shape[1], ridge), 0.0)
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ w))
        step = np.linalg.lstsq(z.T @ (z * (p * (1 - p))[:, None]) / len(x) + np.diag(penalty), z.T @ (p - y) / len(x) + penalty * w, rcond=None)[0]
        w -= step
    return w


def test_chain_equals_a_plain_version(spark):
    bad, good = ["scumbag", "idiots", "loathing"], ["weather", "gardens", "reading", "mountains", "bread"]
    rows = []
    for i in range(150):
        toxic = i % 3 == 0
        words = [RNG.choice(good) for _ in range(12)] + ([RNG.choice(bad) for _ in range(3)] if toxic and i % 7 else []) + ([RNG.choice(bad)] if i % 31 == 1 else [])
        RNG.shuffle(words)
        rows.append((i, " ".join(words), "en" if i % 2 else "de", int(toxic)))
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    categories = {"english": (F.col("_label") == 1) & (F.col("lang") == "en"), "any": F.col("_label") == 1}
    model = toxicity.fit_toxicity(docs, labels, categories, keep=("lang",), regularisation=0.05)
    fold = {r.doc_id: r.f for r in docs.select("doc_id", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(3)).alias("f")).collect()}
    texts, y = [r[1] for r in rows], {"english": np.array([float(r[3] == 1 and r[2] == "en") for r in rows]), "any": np.array([float(r[3]) for r in rows])}
    folds = np.array([fold[r[0]] for r in rows])
    terms = plain_terms([(r[1], r[3]) for r in rows])
    assert list(model.terms) == terms and terms
    early = np.zeros(len(rows))
    for f in range(3):
        inside = [t for t, k in zip(texts, folds) if k != f]
        own = plain_terms([(r[1], r[3]) for r, k in zip(rows, folds) if k != f])  # chosen without the fold
        w = plain_logistic(np.array([plain_features(t, own) for t in inside]), y["english"][folds != f], 0.05)
        x = np.array([plain_features(t, own) for t, k in zip(texts, folds) if k == f])
        early[folds == f] = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    x = np.array([plain_features(t, terms) for t in texts])
    first = plain_logistic(x, y["english"], 0.05)
    last = plain_logistic(np.hstack([x, early[:, None]]), y["any"], 0.05)
    p = 1 / (1 + np.exp(-(x @ first[:-1] + first[-1])))
    q = 1 / (1 + np.exp(-(np.hstack([x, p[:, None]]) @ last[:-1] + last[-1])))
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    for i in range(len(rows)):
        assert got[i].p_english == pytest.approx(p[i], abs=0.01) and got[i].p_any == pytest.approx(q[i], abs=0.01) and got[i].toxic == (got[i].p_any >= 0.5)


def test_labels_and_documents_that_repeat(spark):
    docs = spark.createDataFrame([(i // 2, "scumbag idiots " * (i % 2) + "fine words here " * 9 + "x" * 30_000 * (i == 3)) for i in range(80)], "doc_id long, text string")
    labels = spark.createDataFrame([(i // 3, int(i % 2)) for i in range(120)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels, {"any": F.col("_label") == 1})
    assert len(toxicity.score_toxicity(docs, model).collect()) == 80
    rules = quality.fit_quality(docs, labels, "toxic")
    assert len(quality.score_quality(docs, rules).collect()) == 80


# --- rule ensemble -------------------------------------------------------------------------------------------------


def plain_statistics(text):
    t = text or ""
    words = [w for w in re.split("[ \t\n\x0b\f\r]+", t) if w]
    per = lambda n: n / max(1, len(t))
    return {"log_chars": math.log1p(len(t)), "upper": per(sum(c.isupper() for c in t)), "symbols": per(sum(c in "*#%$&|<>{}[]=+~^_@\\" for c in t)), "bars": per(t.count("|")), "bangs": per(sum(c in "!?" for c in t)), "digits": per(sum(c in "0123456789" for c in t)), "lines": per(t.count("\n")), "n_words": float(len(words)), "word_chars": (len(t) - len(words)) / max(1, len(words)), "distinct": len(set(words)) / max(1, len(words))}


def fires(rule, stats):
    return float(all(stats[s] > v if above else stats[s] <= v for s, above, v in rule))


def test_rules_weights_and_scores_equal_a_plain_version(spark):
    rows = []
    for i in range(300):
        good = i % 3 > 0
        text = " ".join(RNG.choice(["apple", "pear", "plum", "Fig", "lime"]) + ("." if RNG.random() < 0.2 else "") for _ in range(RNG.randint(20, 60))) if good else " | ".join(RNG.choice(["$$$", "BUY!!", "99", "x"]) for _ in range(RNG.randint(5, 60)))
        rows.append((i, text if RNG.random() > 0.05 else text[:15], int(good)))
    rows += [(900, None, 0), (901, "", 0)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, label int")
    lasso = 0.002
    model = quality.fit_quality(docs, labels, lasso=lasso)
    stats = {r[0]: plain_statistics(r[1]) for r in rows}
    assert model.rules and all(1 <= len(rule) <= 3 for rule, _ in model.rules)
    plain = {i: 1 / (1 + math.exp(-(model.intercept + sum(w * fires(rule, s) for rule, w in model.rules)))) for i, s in stats.items()}
    got = {r.doc_id: (r.score, r.predicted) for r in quality.score_quality(docs, model).collect()}
    for i, p in plain.items():
        assert got[i] == (pytest.approx(p, abs=1e-9), int(got[i][0] >= 0.7))
    # The weights are the optimum of the lasso: the gradient of the mean log loss is -lasso * sign of each kept weight.
    y, p = np.array([float(r[2]) for r in rows]), np.array([plain[r[0]] for r in rows])
    for rule, w in model.rules:
        gradient = float(np.mean((p - y) * np.array([fires(rule, stats[r[0]]) for r in rows])))
        assert gradient == pytest.approx(-lasso * math.copysign(1, w), abs=lasso / 3)
    assert float(np.mean(p - y)) == pytest.approx(0.0, abs=1e-3)


# --- URL rules -----------------------------------------------------------------------------------------------------


def test_mined_verdicts_equal_plain_apriori(spark):
    parts = ["news", "shop", "ad", "win", "blog"]
    rows = [(i, "https://%s.site%d.org/%s/%s/%d" % (RNG.choice(["www", "m"]), RNG.randrange(3), RNG.choice(parts), RNG.choice(parts), i)) for i in range(400)]
    rows += [(400 + i, "https://hot.example/" + "/".join("longpath%d" % chr_ for chr_ in range(97, 137)) + f"/{i}") for i in range(30)]  # one long URL, very often
    bad = {i: "ad" in u.split("/")[3:] and "win" in u.split("/")[3:] or "hot." in u or RNG.random() < 0.05 for i, u in rows}
    urls, labels = spark.createDataFrame(rows, "id long, url string"), spark.createDataFrame([(i, bad[i]) for i, _ in rows if i % 2 == 0], "id long, bad boolean")
    tokens = {i: set(t) for i, t in [(r.id, r.t) for r in urls.select("id", url_filter.url_tokens(F.col("url")).alias("t")).collect()]}
    labelled = [(tokens[i], bad[i]) for i, _ in rows if i % 2 == 0]
    least, confidence = math.ceil(len(labelled) * 0.02), 0.7
    short = {i: t for i, t in tokens.items() if len(t) < 12}
    kept = set()
    for t, b in labelled:
        if b and len(t) < 12:
            kept |= {frozenset(x for k, x in enumerate(sorted(t)) if m >> k & 1) for m in range(1, 1 << len(t))}
    known = lambda s: 100 * sum(s <= t for t, _ in labelled) * len(rows) >= 80 * len(labelled) * sum(s <= t for t in tokens.values())
    kept = {s for s in kept if sum(b for t, b in labelled if s <= t) >= least and sum(b for t, b in labelled if s <= t) >= confidence * sum(s <= t for t, _ in labelled) and known(s)}
    assert kept
    found = {r.url for r in url_filter.matched_rules(urls, *url_filter.mine_block_rules(urls, labels, 0.02, confidence)).collect()}
    url = dict(rows)
    for i, t in short.items():
        assert (url[i] in found) == any(s <= t for s in kept), url[i]
    assert all(url[i] in found for i in range(400, 430))


def test_mined_rules_are_known_where_they_act(spark):
    """All labels of a host are of one bad folder: its other folders, of which nothing is known, stay allowed."""
    rows = [(i, f"https://a.net/{'bad' if i < 40 else 'other'}/{i}") for i in range(200)] + [(i, f"https://b.com/fine/{i}") for i in range(200, 300)]
    labels = spark.createDataFrame([(i, i < 40) for i in [*range(0, 40, 2), *range(200, 300, 2)]], "id long, bad boolean")
    out = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), labels, []).collect()
    assert {r.page_id for r in out if r.verdict == "block"} == set(range(40))
    loose = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), labels, [], min_known=0.0).collect()
    assert {r.page_id for r in loose if r.verdict == "block"} == set(range(200))


def test_listed_rules_label_pages(spark):
    pages = spark.createDataFrame([(1, "https://a.example.com/en/x"), (2, "https://b.com/"), (3, "https://b.org/"), (4, None), (5, "http://x.net/es/1")], "page_id long, url string")
    assert {(r.id, r.bad) for r in url_filter.listed_labels(pages, URL_RULES).collect()} == {(1, True), (2, False), (5, True)}


# --- odd inputs ----------------------------------------------------------------------------------------------------


def test_many_empty_texts_end_segments(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SEGMENT_DOCS", 7)
    docs = spark.createDataFrame([(i, None if i % 2 else "") for i in range(60)] + [(60, "one two three")], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(1, "two three")], "item_id long, text string")
    index = decontaminate.build_index(docs)
    assert index.count() >= 8 and max(max(r.bases) for r in index.select("bases").collect()) <= 7 * (decontaminate.GAP + 3)
    got = {r.doc_id: list(r.hits) for r in decontaminate.find_contamination(docs, items, width=2).collect()}
    assert got == {i: [] for i in range(60)} | {60: [1, 2]}


def test_mix_keeps_clashing_names(spark):
    rows = spark.createDataFrame([(i, "w " * (i + 1), "ab"[i % 2], 9, "s", "k") for i in range(20)], "doc_id long, text string, source string, copy_no int, _salt string, row string")
    out = mixing.mix(rows)
    assert out.columns == ["doc_id", "text", "source", "_salt", "row", "copy_no"] and {r["row"] for r in out.collect()} == {"k"} and min(r.copy_no for r in out.collect()) == 1
    model = quality.RuleEnsemble(0.0, (((("n_words", True, 3.0),), 1.0),))
    scored = quality.score_quality(rows.withColumn("Score", F.lit("x")).withColumn("stats", F.lit(1)), model)
    assert scored.columns == ["doc_id", "text", "source", "copy_no", "_salt", "row", "stats", "score", "predicted"] and scored.count() == 20


def test_warc_takes_string_ids_and_hot_payloads(spark, tmp_path):
    body = "é" * 80
    rows = [("b", body), ("a", body), ("ü\n'", body), ("c", "tiny"), ("d", "tiny"), (None, None)] + [(f"x{k:03}", body) for k in range(40)]
    pages = spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id string, url string, html string")
    index, folder = warc.archive_pages(pages, f"file://{tmp_path}/w")
    got = {r.page_id: r for r in warc.read_records(index, folder, id_type="string").collect()}
    assert set(got) == {i for i, _ in rows} and got["a"].record_type == "response" and got["c"].record_type == got["d"].record_type == "response"
    assert all(got[i].refers_to == "a" and got[i].payload_digest == hashlib.sha256(body.encode()).hexdigest() for i in got if i and i not in "acd")
    with pytest.raises(ValueError):
        warc.archive_pages(pages.withColumn("page_id", F.lit(1.5)), f"file://{tmp_path}/v")


def test_other_tokenizers_are_refused_and_long_words_not_kept(tmp_path):
    import json

    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = public_tokenizers.path("word_bpe_49k.json")
    spec = json.loads(open(path, encoding="utf-8").read())
    spec["normalizer"]["normalizers"].pop()
    (tmp_path / "other.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        token_counts.CountingTransducer(str(tmp_path / "other.json"))
    own = token_counts.CountingTransducer(path)
    long = "中文abc" * 40_000
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(path)
    assert own.count(long) == len(library.encode(long, add_special_tokens=False).ids) and max(map(len, own.words), default=0) <= token_counts.LONGEST_KEPT


@pytest.mark.parametrize("long, part, fan", [(10, 7, 2), (30, 1, 3), (10, 1000, 2)])
def test_long_texts_are_counted_by_parts(spark, monkeypatch, long, part, fan):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = public_tokenizers.path("word_bpe_49k.json")
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(path)
    for name, value in (("LONG_CHARS", long), ("PART_CHARS", part), ("FAN", fan)):
        monkeypatch.setattr(token_counts, name, value)
    rng = random.Random(part)
    texts = ["".join(rng.choice("aàbé'ssStre  0123\t\n\x1c\u3000中文A!?.<|endoftext|>🙂Σ") for _ in range(rng.randint(0, 90))) for _ in range(60)] + [None, "", "x" * 80, "<|endoftext|>" * 6, "a <|endoftext|> b" * 4, "e\u0301" * 30, " " * 50]
    docs = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(docs, path).collect())
    assert got == Counter((i // 2, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts))
