"""Recall by tiles of distances: the same neighbours as one product, and no matrix that grows with the queries."""

import numpy as np

from briefwell.operators import recall


def test_tiles_find_what_one_product_finds(monkeypatch):
    rng = np.random.default_rng(3)
    there = rng.integers(-2, 3, size=(300, 6)) + 0.5
    there /= np.sqrt((there * there).sum(axis=1))[:, None]
    own, ids = np.arange(300) * 7 % 301, np.arange(0, 300, 3) * 7 % 301
    vectors = there[::3]
    expected = []
    distance = np.round(1 - there @ vectors.T, 4) + 0.0
    for q, asked in enumerate(ids.tolist()):
        expected.append(sorted((d, i) for d, i in zip(distance[:, q].tolist(), own.tolist()) if i != asked)[:4])
    held = []

    def watched(best, some, *rest, plain=recall.nearer):
        held.append(some.base.size if some.base is not None else some.size)
        return plain(best, some, *rest)

    monkeypatch.setattr(recall, "nearer", watched)
    monkeypatch.setattr(recall, "TILE_VALUES", 64)
    monkeypatch.setattr(recall, "QUERIES", 16)
    best = [[] for _ in ids]
    for part in (slice(0, 130), slice(130, 300)):
        recall.nearest(best, np.arange(len(ids)), ids, vectors, own[part], there[part], 4)
    assert best == expected and max(held) <= 64
