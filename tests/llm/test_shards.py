"""Operators 11 to 13 against brute force; nulls, empty tables, ties, repeated rows, long texts, extra columns."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from briefwell.llm import prefix_trie, suffix_array, suffix_dedup, whitening
from briefwell.llm.queries import ORACLE_SQL, QUERIES

RNG = random.Random(13)
DOCS = "doc_id long, text string, first string, own int, span int"

# --- 11 ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("names", [500, 3])
@pytest.mark.parametrize("small", [1024, 8])
def test_suffix_array(monkeypatch, names, small):
    monkeypatch.setattr(suffix_array, "DIGIT_NAMES", names)
    monkeypatch.setattr(suffix_array, "SMALL", small)
    for n in (1, 2, 3, 10, 60, 400):
        for k in (1, 2, 3, 40, 1500):
            t = [RNG.randrange(1, k + 1) for _ in range(n)] + [0]
            order = suffix_array.suffix_array(np.array(t), k + 1).tolist()
            assert order == sorted(range(n + 1), key=lambda i: t[i:])


@pytest.mark.parametrize("kind", [np.uint8, np.int16])
def test_permuted_prefixes(kind):
    t = np.array([RNG.randrange(1, 3) for _ in range(300)] + [0], kind)
    starts = np.array([i for i in suffix_array.suffix_array(t.astype(np.int64), 3) if i % 3])
    got = suffix_array.permuted_prefixes(t, starts, 9).tolist()
    same = lambda a, b: next((k for k in range(9) if max(a, b) + k >= len(t) or t[a + k] != t[b + k]), 9)
    assert got == [0, *(same(a, b) for a, b in zip(starts[1:], starts))]


def plain_removal(rows, length):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1 if i is not None else 0):
            s = b[p : p + length]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1 if i is not None else 0):
            if first[b[p : p + length]] < i:
                gone[p : p + length] = True
        rest = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((i, len(b), int(gone.sum()), int(np.count_nonzero(np.diff(gone, prepend=False) & gone)), hashlib.sha256(rest).hexdigest(), rest))
    return sorted(out, key=repr)


def removed(spark, rows, length=50, **how):
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], DOCS)
    return sorted(((*r[:5], bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs, length, **how).collect()), key=repr)


PASSAGES = ["".join(RNG.choice("abcdé ") for _ in range(n)) for n in (49, 50, 51, 70, 140, 300)]


def shuffled_texts(n):
    filler = lambda: "".join(RNG.choice("efgh ") for _ in range(RNG.randrange(40)))
    return [(k, filler() + "".join(RNG.choice(PASSAGES)[RNG.randrange(3) :] + filler() for _ in range(RNG.randrange(4)))) for k in RNG.sample(range(1000), n)]


def test_repeats_as_brute_force(spark):
    odd = [(-5, None), (-4, ""), (None, PASSAGES[5]), (None, PASSAGES[5]), (2000, PASSAGES[5] * 2), (2000, PASSAGES[5]), (2001, "a" * 700), (2002, "ab" * 400), (2003, "a" * 60 + PASSAGES[2]), (2003, "a" * 60 + PASSAGES[2])]
    rows = shuffled_texts(80) + odd
    assert removed(spark, rows) == plain_removal(rows, 50)


@pytest.mark.parametrize("length", [3, 9, 24])
def test_repeats_of_other_lengths(spark, length):
    rows = [(k, "".join(RNG.choice("ab c") for _ in range(RNG.randrange(30)))) for k in range(40)]
    assert removed(spark, rows, length) == plain_removal(rows, length)


def test_repeats_in_small_shards_and_cut_anchors(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 300)
    monkeypatch.setattr(suffix_dedup, "ANCHOR_BYTES", 200)  # most anchors are cut into their strings
    monkeypatch.setattr(suffix_dedup, "LEAST_COMMON", 3)  # and many runs are joined by broadcast
    monkeypatch.setattr(suffix_dedup, "COMMON", 10**9)
    rows = shuffled_texts(60)
    assert removed(spark, rows) == plain_removal(rows, 50)


def test_repeats_in_long_texts(spark):
    long = "".join(RNG.choice("abcdefgh") for _ in range(2_300_000))  # over a piece's bound
    rows = [(1, "x" * 10 + long[2_000_000:2_200_000]), (2, long), (3, "ab" * 1_100_000), (4, "b" + "ab" * 200)]
    got = {r[0]: r[1:5] for r in removed(spark, rows)}
    assert got[1][1:3] == (0, 0) and got[2][:3] == (2_300_000, 200_000, 1) and got[3][1] == 0 and got[4][1:3] == (401, 1)
    assert got[2][3] == hashlib.sha256((long[:2_000_000] + long[2_200_000:]).encode()).hexdigest()


def test_repeats_empty_tables_and_other_ids(spark):
    assert removed(spark, []) == [] and removed(spark, [(None, None), (1, "short")])[0][1:4] == (5, 0, 0)
    named = spark.createDataFrame([("b", PASSAGES[4]), ("a", PASSAGES[4] + "!"), ("c", None)], "doc_id string, text string")
    assert {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(named).collect()} == {"a": 0, "b": len(PASSAGES[4].encode()), "c": 0}


def test_repeats_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in QUERIES["op11_suffix_dedup"](spark, sf).collect()), key=repr)
    assert got == [x[:5] for x in plain_removal(rows, 50)] and sum(r[2] for r in got) > 0


# --- 12 ------------------------------------------------------------------------------------------------------------


def plain_whitening(vectors, k):
    x = np.floor(np.array(vectors, np.float64) * 64).astype(np.int64) + 1_000_000
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(axis=0)
    v = np.cov(u.T, bias=True).reshape(u.shape[1], u.shape[1])
    e, w = np.linalg.eigh(v)
    e, w = e[::-1], w[:, ::-1]
    return n, [int(d) for d in ((n * x - s) ** 2).sum(axis=1)], (x - s / n) @ w[:, :k] / np.sqrt(e[:k]), e[:k] / np.trace(v)


def test_whitening_as_numpy(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(300, 6)) * [40, 9, 3, 1, 0.2, 0.05] + rng.normal(size=(300, 1))
    vectors[100:150] = vectors[:50]
    bad = [None, [None] * 6, [1.0] * 5 + [float("nan")], [float("inf")] + [0.0] * 5, [1.0] * 5, [], [1e300] + [0.0] * 5]
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(vectors)] + [(1000 + k, v) for k, v in enumerate(bad)] + [(None, [float(c) for c in vectors[3]])]
    got = whitening.whiten(spark.createDataFrame([(*r, 0, 1) for r in rows], "vec_id long, embedding array<double>, n int, component int"), components=4).collect()
    n, deviation, white, explained = plain_whitening([v for _, v in rows[:300]], 4)
    assert len(got) == 301 * 4 and {r.n for r in got} == {n} and {r.vec_id for r in got} == {None, *range(300)}
    mine = {(r.vec_id, r.component): r for r in got}
    signs = [np.sign(mine[0, c + 1].whitened * white[0, c]) for c in range(4)]
    for i in range(300):
        for c in range(4):
            r = mine[i, c + 1]
            assert r.deviation == deviation[i] and r.whitened * signs[c] == pytest.approx(white[i, c], abs=1e-7)
            assert r.explained == pytest.approx(explained[c], rel=1e-9) and r.identity_error < 1e-9


def test_whitening_of_flat_and_empty_tables(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert whitening.whiten(frame([])).collect() == [] and whitening.whiten(frame([(1, None), (2, [])])).collect() == []
    one = whitening.whiten(frame([(1, [0.5, 2.0])])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(one)] == [(1, 1, 0, None, 0.0, 0.0), (2, 1, 0, None, 0.0, 0.0)]
    flat = whitening.whiten(frame([(k, [float(k), 7.0, float(-k)]) for k in range(9)])).collect()  # rank one
    assert [r.whitened is None for r in sorted(flat)] == [False, True, True] * 9
    wide = whitening.whiten(frame([(k, [k * 2.0**40]) for k in range(3)])).collect()
    assert {r.deviation for r in wide if r.vec_id == 1} == {0} and {r.deviation for r in wide if r.vec_id == 0} == {None}  # passes 64 bits


def test_jacobi_keeps_small_eigenvalues():
    rng = np.random.default_rng(5)
    q, _ = np.linalg.qr(rng.normal(size=(12, 12)))
    scale = np.diag(10.0 ** -np.arange(12))
    a = scale @ (q @ np.diag(np.linspace(1, 2, 12)) @ q.T) @ scale  # well conditioned up to scaling
    values, basis = whitening.jacobi(a)
    assert np.all(np.diff(values) <= 0) and np.abs(basis.T @ basis - np.eye(12)).max() < 1e-13
    assert np.prod(values) == pytest.approx(np.prod(np.linspace(1, 2, 12)) * 10.0 ** (-2 * sum(range(12))), rel=1e-9)
    assert whitening.jacobi(np.zeros((2, 2)))[0].tolist() == [0, 0] and whitening.jacobi(np.zeros((0, 0)))[0].size == 0


# --- 13 ------------------------------------------------------------------------------------------------------------


def plain_trie(rows):
    own, nodes = {}, {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own.setdefault(c, []).append((turn is not None, turn or 0, role, digest, text))
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        take = lambda x, a, b: [(t[2], t[4]) for t in sorted(own.get(x, []))[a:b]]
        paths[c] = tuple(take(base, 0, h) + take(c, h, None))
    for c, p in paths.items():
        for d in range(len(p) + 1):
            nodes.setdefault(p[:d], []).append(c)
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        ends = ",".join(str(c) for c in sorted(members) if len(paths[c]) == len(p))
        children = lambda q: [x for x in nodes if len(x) == len(q) + 1 and x[: len(q)] == q]
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        parent = min(nodes[p[:-1]]) if p else None
        out.append((min(members), len(p), parent, len(members), len(children(p)), sum(not children(q) for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


TURNS = "conv_id long, turn long, role string, text string, depth int, conv string"


def trie_of(spark, rows):
    made = prefix_trie.conversation_trie(spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS).repartition(3))
    return sorted(map(tuple, made.collect()), key=repr)


@pytest.mark.parametrize("stride, packed", [(4096, 1 << 14), (2, 2)])
def test_trie_as_brute_force(spark, monkeypatch, stride, packed):
    monkeypatch.setattr(prefix_trie, "STRIDE", stride)
    monkeypatch.setattr(prefix_trie, "PACKED", packed)
    rows = []
    for c in [*range(-7, 45), 100, 10**12 + 3]:
        for t in range(RNG.randrange(1, 13)):
            rows.append((c, RNG.choice([t, t, t, 2, None]), RNG.choice(["user", "assistant", None]), RNG.choice(["a", "bé", None, "c" * 30])))
    rows += [(60, 1, "u", "same"), (60, 1, "u", "same"), (None, 1, "u", "x")] + [(c, 1, "u", "same") for c in range(200, 260)]
    assert trie_of(spark, rows) == plain_trie(rows)


def test_trie_of_a_conversation_over_many_partitions(spark):
    rows = [(7, k, "u", "t%d" % (k % 5)) for k in range(600)] + [(c, k, "u", "t%d" % (k % 5)) for c in (5, 6, 9) for k in range(c)]
    assert trie_of(spark, rows) == plain_trie(rows)


def test_trie_of_few_rows(spark):
    assert trie_of(spark, []) == [] and trie_of(spark, [(None, 1, "u", "x")]) == []
    only = (3, None, None, None)  # its first turn is taken from conversation 0, which is absent
    assert trie_of(spark, [only]) == plain_trie([only])


def test_trie_query_and_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    frame = QUERIES["op13_prefix_trie"](spark, sf)
    want = con.execute(ORACLE_SQL["op13_prefix_trie"]).fetchall()
    assert frame.columns == [c[0] for c in con.description]
    assert sorted(map(tuple, frame.collect()), key=repr) == sorted(want, key=repr)
    assert not frame.filter(F.col("n_convs") < 1).count()
