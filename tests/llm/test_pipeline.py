"""The corpus pipeline, stage by stage, against plain versions; and cases in which an operator once did less than its whole job."""

import re


def test_url_rules_of_five_tokens_block(spark):
    from briefwell.llm.url_filter import filter_urls

    words = ["ant", "bee", "cat", "dog", "elk"]
    paths = [words] * 40 + [[w for w in words if w != gone] for gone in words for _ in range(40)]
    pages = spark.createDataFrame([(i, f"https://h/{'/'.join(p)}/{i}") for i, p in enumerate(paths)], "page_id long, url string")
    labels = spark.createDataFrame([(i, len(p) == 5) for i, p in enumerate(paths)], "id long, bad boolean")
    got = {r["page_id"]: r["verdict"] for r in filter_urls(pages, labels, []).collect()}
    assert got == {i: "block" if len(p) == 5 else "allow" for i, p in enumerate(paths)}


def test_pipeline_stages_equal_plain_versions(spark, sf, monkeypatch):
    import hashlib
    import math

    import corpus_pipeline as pipe
    from briefwell.llm.quality import fit_quality, score_quality
    from briefwell.llm.queries import toxicity_categories
    from briefwell.llm.toxicity import fit_toxicity, score_toxicity

    stages, write = {}, pipe.materialize
    monkeypatch.setattr(pipe, "materialize", lambda df, name: stages.setdefault(name, write(df, name)))
    out = pipe.run(spark, sf).collect()
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    ids = {name: {r.doc_id for r in df.select("doc_id").collect()} for name, df in stages.items()}
    texts = {r.doc_id: r.text for r in docs.collect()}

    scores = score_quality(docs, fit_quality(docs, labels, "quality")).select("doc_id", "score").collect()
    assert ids["stage-quality"] == {r.doc_id for r in scores if r.score >= 0.7}

    good = stages["stage-quality"]
    chances = score_toxicity(good, fit_toxicity(good, labels, toxicity_categories(), keep=("lang",))).collect()
    assert ids["stage-toxicity"] == {r.doc_id for r in chances if not r.toxic}

    def runs(text):
        w = re.findall("[^ \t-\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    left = sorted(ids["stage-toxicity"])
    sets, head = {i: runs(texts[i]) for i in left}, {i: i for i in left}
    for i in left:
        for j in left:
            if i < j and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and head[i] != head[j]:
                low, high = sorted((head[i], head[j]))
                head = {k: low if h == high else h for k, h in head.items()}
    assert ids["stage-near_duplicates"] == {i for i in left if head[i] == i}

    words = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())
    tens = lambda w: {tuple(w[i : i + 10]) for i in range(len(w) - 9)}
    leaks = set().union(*[tens(words(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])
    assert ids["stage-decontamination"] == {i for i in ids["stage-near_duplicates"] if not tens(words(texts[i])) & leaks}

    rows = stages["stage-decontamination"].collect()
    size = {}
    for r in rows:
        size[r.source] = size.get(r.source, 0) + len(re.findall("[^ \t-\r]+", r.text or ""))
    weight = {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(sorted(size, key=lambda s: (s is None, s)))}
    target, total = {}, float(sum(size.values()))
    while len(target) < len(size):
        rest = [s for s in size if s not in target]
        level = (total - sum(target.values())) / sum(weight[s] for s in rest)
        full = [s for s in rest if 3.0 * size[s] <= weight[s] * level]
        target |= {s: 3.0 * size[s] for s in full} if full else {s: weight[s] * level for s in rest}
    expected = set()
    for r in rows:
        rate = target[r.source] / size[r.source] if size[r.source] else 0.0
        chance = int(hashlib.md5(f"11/{r.doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        expected |= {(r.doc_id, k + 1) for k in range(min(3, math.floor(rate) + (chance < rate - math.floor(rate))))}
    assert len(out) == len(expected) and {(r.doc_id, r.copy_no) for r in out} == expected


def test_pipeline_samples_labels_of_its_own_documents(spark, sf, tmp_path, monkeypatch):
    import corpus_pipeline as pipe
    from briefwell.llm.common import labelled_sample

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    own = docs.selectExpr("doc_id", "1 AS quality", "0 AS toxic")
    own.union(spark.range(10**6, 10**6 + 60000).selectExpr("id", "1", "0")).write.parquet(f"{tmp_path}/labels.parquet")
    given = {}
    monkeypatch.setattr(pipe, "fit_toxicity", lambda docs, labels, *a, **k: given.setdefault("labels", labels))
    monkeypatch.setattr(pipe, "drop_toxic", lambda docs, model: docs)
    pipe.toxicity(spark, docs, str(tmp_path))
    assert labelled_sample(docs, given["labels"], "doc_id", "toxic", "text", 16_000).count() == docs.count()


def test_stated_loss_of_near_duplicates():
    import math
    from pathlib import Path

    from briefwell.llm.near_dup import BATCH, least_matches

    alive, lost = {0: 1.0}, 0.0
    for need in least_matches(0.8, 1e-5):
        step = {}
        for m, p in alive.items():
            for k in range(BATCH + 1):
                step[m + k] = step.get(m + k, 0.0) + p * math.comb(BATCH, k) * 0.8**k * 0.2 ** (BATCH - k)
        lost += sum(p for m, p in step.items() if m < need)
        alive = {m: p for m, p in step.items() if m >= need}
    assert f"{lost:.1e}" == "3.3e-05" and "3.3e-5" in (Path(__file__).parents[2] / "README.md").read_text()
