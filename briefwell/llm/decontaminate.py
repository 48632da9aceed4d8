"""Benchmark decontamination by a positional inverted index.

The index is cut by documents: a segment holds the postings of a bounded run of documents, term by term, as positions on
one axis on which documents lie one after another with gaps wider than any phrase. It is stored as a table, one row a
segment. A phrase is found inside a segment by intersecting its terms' lists, each moved by the term's offset, from the
shortest list on; a proximity match by looking around each posting of the rarest term. Segments never depend on each
other, so search needs no shuffle, and a phrase that many documents share only makes longer lists inside their segments.
Test phrases are taken in blocks of a fixed size, so what tasks are sent is bounded.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize

#: A segment ends at so many words or documents, so that positions, a gap a document included, fit in 32 bits.
SEGMENT_WORDS, SEGMENT_DOCS = 500_000, 50_000
#: Words between the documents of a segment; longer than any phrase plus slop.
GAP = 4096
#: Phrases of one block.
BLOCK_PHRASES = 100_000
#: A test set of at most so many bytes restricts the index to the terms that it uses.
VOCABULARY_BYTES = 32 << 20
#: A-Z to a-z; digits, a-z and every byte of a character above U+007F stay; the rest becomes a blank.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def phrases_of(words: list[bytes], width: int) -> list[tuple[bytes, ...]]:
    """Every run of ``width`` words; all words as one phrase if there are fewer, none if there is no word."""
    if not words:
        return []
    return [tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: list[bytes] | None = None) -> DataFrame:
    """The stored index: segment, docs, bases, lengths, terms, term_starts, positions.

    With a ``vocabulary``, postings of other terms are left out: no phrase over that vocabulary can use them. Null and
    empty texts are documents of length 0.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = docs.schema[id_col].dataType
    known = spark.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)}) if vocabulary is not None else None
    schema = f"segment long, docs array<{kind.simpleString()}>, bases array<int>, lengths array<int>, terms array<binary>, term_starts array<int>, positions array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        fresh = lambda: (known.value if known else {}, [], [], [], [])
        table, docs_, bases, lengths, found = fresh()
        base = 0

        def segment() -> pa.RecordBatch:
            terms, positions = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int32) for k in (0, 1))
            order = np.argsort(terms, kind="stable")
            used, starts = np.unique(terms[order], return_index=True)
            names = list(table)
            as_list = lambda x, t: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, t))
            ids = pa.concat_arrays(docs_)
            return pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | made], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), as_list(bases, pa.int32()), as_list(lengths, pa.int32()), as_list([names[t] for t in used], pa.binary()), as_list(starts.astype(np.int32), pa.int32()), as_list(positions[order], pa.int32())],
                ["segment", "docs", "bases", "lengths", "terms", "term_starts", "positions"],
            )

        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for k in range(batch.num_rows):
                words = words_of(texts[k].as_py() or b"")
                if known:
                    ids = np.fromiter(map(table.get, words, repeat(-1)), np.int32, len(words))
                else:
                    ids = np.fromiter((table.setdefault(w, len(table)) for w in words), np.int32, len(words))
                at = np.flatnonzero(ids >= 0).astype(np.int32)
                found.append((ids[at], at + np.int32(base)))
                docs_.append(batch.column(0).slice(k, 1))
                bases.append(base)
                lengths.append(len(words))
                base += len(words) + GAP
                if base >= SEGMENT_WORDS + GAP * len(docs_) or len(docs_) >= SEGMENT_DOCS:
                    yield segment()
                    table, docs_, bases, lengths, found = fresh()
                    base, made = 0, made + 1
        if docs_:
            yield segment()

    return materialize(docs.select(id_col, text_col).mapInArrow(run, schema), "postings")


class Segment:
    """One segment's postings in memory."""

    def __init__(self, row: dict):
        self.bases, self.lengths = np.asarray(row["bases"]), np.asarray(row["lengths"])
        self.place = {t: i for i, t in enumerate(row["terms"])}
        self.cuts = np.append(np.asarray(row["term_starts"], np.int64), len(row["positions"]))
        self.positions = np.asarray(row["positions"])

    def sizes(self, vocabulary: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Of each term: its place here (-1: absent), and the length of its list."""
        places = np.fromiter(map(self.place.get, vocabulary, repeat(-1)), np.int64, len(vocabulary))
        lengths = np.where(places >= 0, self.cuts[places + 1] - self.cuts[places], 0) if len(self.place) else np.zeros(len(vocabulary), np.int64)
        return places, lengths

    def list_of(self, place: int) -> np.ndarray:
        return self.positions[self.cuts[place] : self.cuts[place + 1]]

    def phrase(self, places: list[int], lengths: list[int]) -> np.ndarray:
        """Positions at which the phrase starts."""
        order = sorted(range(len(places)), key=lengths.__getitem__)
        starts = self.list_of(places[order[0]]) - order[0]
        for k in order[1:]:
            postings = self.list_of(places[k])
            at = np.searchsorted(postings, starts + k)
            starts = starts[(at < len(postings)) & (postings[np.minimum(at, len(postings) - 1)] == starts + k)]
            if not len(starts):
                break
        return starts

    def near(self, places: list[int], lengths: list[int], reach: int) -> list[tuple[int, int]]:
        """Shortest stretches (start, end) of at most ``reach`` words that hold every term as often as asked for, one at most for each posting of the rarest."""
        need = Counter(places)
        rare = places[min(range(len(places)), key=lengths.__getitem__)]
        found = set()
        for p in self.list_of(rare).tolist():
            near = []
            for t, n in need.items():
                postings = self.list_of(t)
                a, b = np.searchsorted(postings, [p - reach + 1, p + reach])
                if b - a < n:
                    break
                near += [(int(x), t) for x in postings[a:b]]
            else:
                near.sort()
                have: Counter = Counter()
                missing, left, best = len(need), 0, None
                for x, t in near:
                    have[t] += 1
                    missing -= have[t] == need[t]
                    while not missing:
                        start, first = near[left]
                        if start <= p <= x and x - start < reach and (best is None or x - start < best[1] - best[0] - 1):
                            best = (start, x + 1)
                        missing += have[first] == need[first]
                        have[first] -= 1
                        left += 1
                if best:
                    found.add(best)
        return sorted(found)


def search(index: DataFrame, phrases: list[tuple[int, tuple[bytes, ...]]], items: list, item_kind: str, slop: int | None = None) -> DataFrame:
    """Matches of a block of (place in ``items``, words) phrases in each document that the index holds.

    One row a document: segment, place (in its segment), doc, n_words, hits (places of words inside matches), items
    (those of which a phrase occurs). ``slop`` None: exact phrases; else every word of a phrase within
    its length plus ``slop`` words, in any order.
    """
    spark = index.sparkSession
    vocabulary = sorted({w for _, words in phrases for w in words})
    number = {w: i for i, w in enumerate(vocabulary)}
    width = max([1, *(len(words) for _, words in phrases)])
    if width + (slop or 0) > GAP:
        raise ValueError(f"phrases and slop reach over {GAP} words")
    matrix = np.full((len(phrases), width), -1, np.int32)
    for row, (_, words) in enumerate(phrases):
        matrix[row, : len(words)] = [number[w] for w in words]
    sent = spark.sparkContext.broadcast((vocabulary, matrix, np.array([n for n, _ in phrases], np.int64), items))
    kind = index.schema["docs"].dataType.elementType.simpleString()
    out_items = pa.list_({"string": pa.string(), "int": pa.int32()}.get(item_kind, pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, matrix, numbers, items = sent.value
        counts = (matrix >= 0).sum(axis=1)
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(i)[k].values for i, name in enumerate(batch.schema.names) if name != "segment"}
                docs = row.pop("docs")
                seg = Segment({n: v.to_pylist() if n == "terms" else v.to_numpy(zero_copy_only=False) for n, v in row.items()})
                places, lengths = seg.sizes(vocabulary)
                least = np.where(matrix >= 0, lengths[matrix], 1).min(axis=1) if len(matrix) else np.zeros(0)
                spans, which = [], []
                for p in np.flatnonzero(least > 0):
                    terms = matrix[p, : counts[p]]
                    own, sizes = places[terms].tolist(), lengths[terms].tolist()
                    if slop is None:
                        starts = seg.phrase(own, sizes)
                        ends = starts + counts[p]
                    else:
                        pairs = seg.near(own, sizes, int(counts[p]) + slop)
                        starts, ends = np.array([a for a, _ in pairs], np.int64), np.array([b for _, b in pairs], np.int64)
                    if len(starts):
                        spans.append(np.stack([starts, ends], axis=1))
                        which.append(np.full(len(starts), numbers[p]))
                hits, found = [None] * len(docs), [None] * len(docs)
                if spans:
                    edges, which = np.concatenate(spans).astype(np.int64), np.concatenate(which)
                    owner = np.searchsorted(seg.bases, edges[:, 0], side="right") - 1
                    long = edges[:, 1] - edges[:, 0]
                    covered = np.unique(np.repeat(edges[:, 0] - np.cumsum(long) + long, long) + np.arange(long.sum()))
                    of = np.searchsorted(seg.bases, covered, side="right") - 1
                    pairs = np.unique(np.stack([owner, which], axis=1), axis=0)
                    for d in np.unique(owner):
                        hits[d] = covered[np.searchsorted(of, d) : np.searchsorted(of, d, side="right")] - seg.bases[d]
                        found[d] = pairs[np.searchsorted(pairs[:, 0], d) : np.searchsorted(pairs[:, 0], d, side="right"), 1]
                empty = np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0)[k].as_py()] * len(docs), pa.int64()), pa.array(range(len(docs)), pa.int32()), docs, pa.array(seg.lengths, pa.int64()), pa.array([empty if h is None else h for h in hits], pa.list_(pa.int32())), pa.array([[] if f is None else [items[i] for i in f] for f in found], out_items)],
                    ["segment", "place", "doc", "n_words", "hits", "items"],
                )

    return index.mapInArrow(run, f"segment long, place int, doc {kind}, n_words long, hits array<int>, items array<{item_kind}>")


def phrase_blocks(tests: DataFrame, width: int, id_col: str, text_col: str) -> Iterator[tuple[list, list[tuple[int, tuple[bytes, ...]]]]]:
    """(items, phrases) blocks of the test set, read piece by piece; phrases carry their item's place in the block's items."""
    items: list = []
    phrases: list[tuple[int, tuple[bytes, ...]]] = []
    for row in tests.select(id_col, text_col).toLocalIterator():
        seen: set = set()
        own = [p for p in phrases_of(words_of((row[1] or "").encode()), width) if not (p in seen or seen.add(p))]
        for i in range(0, len(own), BLOCK_PHRASES):
            if phrases and len(phrases) + len(own[i : i + BLOCK_PHRASES]) > BLOCK_PHRASES:
                yield items, phrases
                items, phrases = [], []
            items.append(row[0])
            phrases += [(len(items) - 1, p) for p in own[i : i + BLOCK_PHRASES]]
    yield items, phrases


def find_contamination(docs: DataFrame, tests: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", slop: int | None = None) -> DataFrame:
    """One row a document: id, n_words, hits (places of words inside a match), items (test items that occur, distinct).

    Words: A-Z lower-cased, then runs of digits, a-z and characters above U+007F. A null or empty text has no words; an
    item without words matches nothing; repeated documents are told apart; an empty test set hits nothing.
    """
    n_bytes = tests.agg(F.sum(F.octet_length(F.col(item_text_col)))).first()[0] or 0
    vocabulary = None
    if n_bytes <= VOCABULARY_BYTES:
        vocabulary = sorted({w for r in tests.select(item_text_col).toLocalIterator() for w in words_of((r[0] or "").encode())})
    index = build_index(docs, id_col, text_col, vocabulary)
    kind = tests.schema[item_col].dataType
    results = []
    for items, phrases in phrase_blocks(tests, width, item_col, item_text_col):
        results.append(search(index, phrases, items, kind.simpleString(), slop))
    if len(results) == 1:
        whole = results[0]
    else:
        parts = materialize(_union(results), "contamination")
        whole = parts.groupBy("segment", "place", "doc", "n_words").agg(F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    return whole.select(F.col("doc").alias(id_col), "n_words", "hits", F.array_distinct("items").alias("items"))


def _union(frames: Iterable[DataFrame]) -> DataFrame:
    frames = list(frames)
    whole = frames[0]
    for f in frames[1:]:
        whole = whole.unionByName(f)
    return whole


def drop_contaminated(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """``docs`` without the documents (by id) in which a test phrase occurs."""
    hit = materialize(find_contamination(docs, tests, id_col=id_col, **how).filter(F.size("items") > 0).select(F.col(id_col).alias("_hit")).distinct(), "contaminated")
    return docs.join(hit, docs[id_col].eqNullSafe(hit["_hit"]), "left_anti")
