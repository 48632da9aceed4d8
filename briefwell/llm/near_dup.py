"""MinHash near-duplicates with sequential Bayesian verification.

1. One pass over the texts gives each document the identity of its shingle set and a signature. Documents with equal
   sets form a class, represented by its smallest id; everything below works on classes.
2. Banding puts classes into buckets. Within a bucket each class is paired with the first one and with the one before,
   in an order of the bucket's own, so pairs grow with the rows, whatever a bucket's size.
3. Pairs are compared a batch of hash values at a time and dropped as soon as the posterior probability of a similarity
   at or over the threshold falls under the chosen miss probability.
4. Each class's most similar surviving partners are verified on whole shingle sets; links are joined to components.
5. What is left lies between components. Survivors of step 3, and buckets that hold more than one component (all their
   pairs, compared in arrays), tell which components come near each other: such components form a region.
6. A region's classes are brought together with their sets, cut into blocks, block against block: every pair between
   two components that survives the comparison is verified there. A block gives a spanning forest of what it finds, so
   rows grow with the classes, not with the pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, discard, materialize

HASHES, BAND_ROWS, BATCH = 128, 4, 32
BANDS = HASHES // BAND_ROWS
BLOCK = 256
#: Partners of a class that are verified first.
FIRST_PARTNERS = 3
MAX_WORDS = 500_000
#: Least and largest size of the bitmap that sifts texts before a join: 1 to 64 MB, about 16 bits a wanted key between.
SIEVE_BITS, MOST_SIEVE_BITS = 1 << 23, 1 << 29
#: Rows of one bucket or region are dealt to this many salted keys when its figures are joined back.
SALTS = 16
#: A-Z to a-z, all other bytes as they are; bytes.split() then cuts at the space and U+0009 to U+000D.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class _WordHashes(dict):
    """64-bit hashes of words, kept for the words of a worker's recent texts."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _WordHashes()
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of runs of ``width`` words; all words as one run if there are fewer; empty without words."""
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    span = min(width, len(words))
    mixed = np.full(len(words) - span + 1, span, np.uint64)
    for k in range(span):
        mixed = (mixed ^ each[k : len(each) - span + 1 + k]) * _GOLD
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(1, 1 << 63, (HASHES, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, (HASHES, 1), dtype=np.uint64)


def signature(shingles: np.ndarray) -> bytes:
    """The least of HASHES hash functions over a set, 16 bits of each."""
    factor, shift = _multipliers_once
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 2048):
        least = np.minimum(least, (factor * shingles[i : i + 2048] + shift).min(axis=1))
    return ((least * _GOLD) >> np.uint64(48)).astype("<u2").tobytes()


_multipliers_once = _multipliers()


def sketches(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """id, n (size of the shingle set), key (128-bit identity of the set), sig (null for an empty set)."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, sigs = [], [], []
            for value in batch.column(1).cast(pa.binary()):
                shingles = shingle_hashes(value.as_py() or b"", width)
                sizes.append(len(shingles))
                keys.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None)
                sigs.append(signature(shingles) if len(shingles) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], ["id", "n", "key", "sig"])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, n long, key binary, sig binary")


def least_matches(threshold: float, miss: float) -> list[int]:
    """After each batch, the fewest equal hash values with which a pair stays in.

    With a uniform prior, m of n equal values leave P(similarity >= t) = P(Binomial(n + 1, t) <= m).
    ``miss`` bounds each look; over all four, a pair of similarity 0.8 is dropped with probability 3.3e-5 at miss 1e-5.
    """
    kept = []
    for n in range(BATCH, HASHES + 1, BATCH):
        tail, m = 0.0, -1
        while tail <= miss:
            m += 1
            tail += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(threshold) + (n + 1 - m) * math.log1p(-threshold)) if threshold < 1 else float(m > n)
        kept.append(min(m, n))
    return kept


def matches(left: np.ndarray, right: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Of row pairs of two signature arrays: which survive every batch, and their equal values."""
    alive, equal = np.arange(len(left)), np.zeros(len(left), np.int32)
    for k, need in enumerate(least):
        cut = slice(k * BATCH, (k + 1) * BATCH)
        equal = equal + (left[alive, cut] == right[alive, cut]).sum(axis=1, dtype=np.int32)
        keep = equal >= need
        alive, equal = alive[keep], equal[keep]
    return alive, equal


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, HASHES)


def compare_pairs(pairs: DataFrame, classes: DataFrame, threshold: float, miss: float) -> DataFrame:
    """(a, b, equal) of the (a, b) pairs that survive the comparison of their signatures."""
    least = least_matches(threshold, miss)
    joined = pairs.join(classes.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a").join(classes.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, equal = matches(_signatures(batch.column(2)), _signatures(batch.column(3)), least)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), pa.array(equal)], ["a", "b", "equal"])

    kind = classes.schema["node"].dataType.simpleString()
    return joined.select("a", "b", "sig_a", "sig_b").mapInArrow(run, f"a {kind}, b {kind}, equal int")


def buckets(classes: DataFrame) -> DataFrame:
    """(bucket, node) for each band of each class."""
    piece = lambda k: F.xxhash64(F.lit(k), F.substring("sig", k * BAND_ROWS * 2 + 1, BAND_ROWS * 2))
    return classes.select("node", F.explode(F.array(*[piece(k) for k in range(BANDS)])).alias("bucket")).select("bucket", "node")


def candidate_pairs(members: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b: each member of a bucket with the bucket's first and with the one before it."""
    order = Window.partitionBy("bucket").orderBy(F.xxhash64("node", "bucket"), "node")
    placed = members.withColumn("first", F.first("node").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("before", F.lag("node").over(order)).filter(F.col("before").isNotNull() & (F.col("before") != F.col("node")))
    both = placed.select("node", "first").unionByName(placed.filter("before != first").select("node", F.col("before").alias("first")))
    return both.filter("node != first").select(F.least("node", "first").alias("a"), F.greatest("node", "first").alias("b")).distinct()


def _dealt(rows: DataFrame, run, schema: str) -> DataFrame:
    """Run a function over the rows of each ``group``, which come together but never all at once to Python."""

    def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            groups = np.asarray(held.column("group").combine_chunks())
            cuts = np.flatnonzero(np.diff(groups)) + 1
            for start, end in zip([0, *cuts], cuts):
                yield run(held.slice(start, end - start))
            if len(cuts):
                held = held.slice(cuts[-1])
        if held is not None and held.num_rows:
            yield run(held)

    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(partitions, "group").sortWithinPartitions("group").mapInArrow(whole_groups, schema)


class Forest:
    """Union-find over component ids; ``join`` tells whether two were apart."""

    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, x, y) -> bool:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def _columns(rows: pa.Table, *names: str) -> list[np.ndarray]:
    return [np.asarray(rows.column(c).combine_chunks()) for c in names]


def in_blocks(members: DataFrame, key: str) -> DataFrame:
    """Members (key, comp, node, ...) with ``group`` and ``own``: every two rows of a key whose components differ meet in some group.

    Keys with one component are left out. The rows of a key's largest component meet the
    blocks of the others; these meet all blocks, their own too. So a key with one large component costs about its rows,
    whatever its size, and no group has more than two blocks.
    """
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")
    sizes = members.groupBy(key, "comp").agg(F.count("*").alias("m"))
    whole = sizes.groupBy(key).agg(F.sum("m").alias("all"), F.count("*").alias("comps"), F.max(F.struct("m", "comp")).alias("top")).filter("comps > 1")
    n = lambda m: F.ceil(m / F.lit(BLOCK)).cast("int")
    blocks = whole.select(key, F.col("top.comp").alias("top"), n(F.col("top.m")).alias("n_top"), n(F.col("all") - F.col("top.m")).alias("n_rest"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = members.withColumn("salt", salt).join(blocks, [key, "salt"])
    in_top = F.col("comp") == F.col("top")
    own = F.when(in_top, F.pmod(F.xxhash64("node"), F.col("n_top"))).otherwise(-1 - F.pmod(F.xxhash64("node"), F.col("n_rest"))).cast("int")
    rest_blocks = F.transform(F.sequence(F.lit(1), F.col("n_rest")), lambda k: -k)
    others = F.when(in_top, rest_blocks).otherwise(F.concat(rest_blocks, F.sequence(F.lit(0), F.col("n_top") - 1)))
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(others))
    return dealt.withColumn("group", F.xxhash64(key, F.least("own", "other"), F.greatest("own", "other"))).drop("salt", "top", "n_top", "n_rest", "other")


def bucket_edges(members: DataFrame, classes: DataFrame, labels: DataFrame, threshold: float, miss: float) -> DataFrame:
    """(a, b): components between which some pair of a common bucket survives, as a spanning forest of each block.

    Only buckets of more than three classes (in smaller ones every pair was formed before) that hold more than one
    component, block against block.
    """
    least = least_matches(threshold, miss)
    kind = classes.schema["node"].dataType.simpleString()
    labelled = members.join(labels, "node", "left").select("bucket", "node", F.coalesce("comp", "node").alias("comp"))
    mixed = labelled.groupBy("bucket").agg(F.count("*").alias("m"), F.min("comp").alias("low"), F.max("comp").alias("high")).filter("m > 3 and low < high")
    open_ = labelled.join(mixed.select("bucket", "m"), "bucket").join(classes.select("node", "sig"), "node")
    n_blocks = F.ceil(F.col("m") / F.lit(BLOCK)).cast("int")
    dealt = open_.withColumn("own", F.pmod(F.xxhash64("node"), n_blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
    dealt = dealt.withColumn("group", F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other"))).select("group", "own", "comp", "sig")

    def run(rows: pa.Table) -> pa.RecordBatch:
        comps, own = _columns(rows, "comp", "own")
        sigs = _signatures(rows.column("sig"))
        left, right = np.triu_indices(len(comps), 1)
        keep = comps[left] != comps[right]
        if len(np.unique(own)) > 1:
            keep &= own[left] != own[right]  # pairs inside a block are those of the block's own group
        left, right = left[keep], right[keep]
        alive, _ = matches(sigs[left], sigs[right], least)
        x, y = comps[left[alive]], comps[right[alive]]
        pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
        forest = Forest()
        kept = [k for k, (i, j) in enumerate(pairs.tolist()) if forest.join(i, j)]
        return pa.RecordBatch.from_arrays([pa.array(pairs[kept, 0]), pa.array(pairs[kept, 1])], ["a", "b"])

    return _dealt(dealt, run, f"a {kind}, b {kind}").distinct()


def common_sizes(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of set pairs; many pairs are counted by a product of membership matrices, in pieces."""
    if len(left) < 4 * len(sets):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(left, right)], np.int64)
    all_, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place, n = np.unique(all_, return_inverse=True, return_counts=True)
    shared = n[place] > 1
    owner, (_, place) = owner[shared], np.unique(place[shared], return_inverse=True)
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for first in range(0, int(place[-1]) + 1 if len(place) else 0, 4096):
        a, b = np.searchsorted(place, [first, first + 4096])
        held = np.zeros((len(sets), 4096), np.float32)
        held[owner[a:b], place[a:b] - first] = 1
        total += held @ held.T
    return total[left, right].astype(np.int64)


def region_links(comps: DataFrame, edges: DataFrame, classes: DataFrame, text_of: DataFrame, width: int, threshold: float, miss: float) -> DataFrame:
    """Links (a, b) between components that ``edges`` join into regions, verified on whole sets; a spanning forest of each block.

    Every class of a region comes with its set. The region's largest component is compared with the others, and those
    among themselves, block against block.
    """
    least = least_matches(threshold, miss)
    percent = round(threshold * 100)
    kind = classes.schema["node"].dataType.simpleString()
    regions = components(edges).select(F.col("node").alias("comp"), F.col("comp").alias("region"))
    inside = comps.join(regions, "comp", "right").select("region", "comp", F.coalesce("node", "comp").alias("node"))
    inside = materialize(inside, "regions")

    def as_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_hashes(t.as_py(), width).tobytes() for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "set"])

    sets = sifted(text_of, "node", inside, inside.count()).join(inside.select("node"), "node", "left_semi").mapInArrow(as_set, f"node {kind}, set binary")
    dealt = in_blocks(inside, "region").join(classes.select("node", "sig"), "node").join(sets, "node").select("group", "own", "node", "comp", "sig", "set")

    def run(rows: pa.Table) -> pa.RecordBatch:
        nodes, comps, own = _columns(rows, "node", "comp", "own")
        sigs = _signatures(rows.column("sig"))
        sets = [np.frombuffer(x, np.uint64) for x in rows.column("set").to_pylist()]
        left, right = np.triu_indices(len(nodes), 1)
        keep = comps[left] != comps[right]
        if len(np.unique(own)) > 1:
            keep &= own[left] != own[right]
        left, right = left[keep], right[keep]
        alive, equal = matches(sigs[left], sigs[right], least)
        order = np.argsort(-equal, kind="stable")
        left, right = left[alive][order], right[alive][order]
        both, size = common_sizes(sets, left, right), np.array([len(x) for x in sets], np.int64)
        true = np.flatnonzero(100 * both >= percent * (size[left] + size[right] - both))
        forest = Forest()
        kept = [k for k in true if forest.join(comps[left[k]].item(), comps[right[k]].item())]
        x, y = nodes[left[kept]], nodes[right[kept]]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    return _dealt(dealt, run, f"a {kind}, b {kind}")


def sieve(key: str, wanted: DataFrame, n_wanted: int) -> Column:
    """Whether a key may be among the ``wanted`` keys (always, if it is), by a bitmap of key hashes, its size bounded."""
    spark = wanted.sparkSession
    size = min(MOST_SIEVE_BITS, max(SIEVE_BITS, 1 << (16 * n_wanted).bit_length()))
    place = F.pmod(F.xxhash64(key), F.lit(size))
    marks = wanted.select((place + 1).alias("n")).groupBy(F.bitmap_bucket_number("n").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("n")).alias("m"))
    bits = np.zeros(size // 8, np.uint8)
    for b, m in marks.collect():  # size / 32768 rows of 4 KB at most
        bits[(b - 1) * 4096 : b * 4096] = np.frombuffer(m, np.uint8)
    sent = spark.sparkContext.broadcast(bits)

    @F.arrow_udf("boolean")
    def may(hashes: pa.Array) -> pa.Array:
        x = np.asarray(hashes)
        return pa.array((sent.value[x >> 3] >> (x & 7).astype(np.uint8)) & 1 == 1)

    return may(place)


def sifted(rows: DataFrame, key: str, wanted: DataFrame, n_wanted: int) -> DataFrame:
    """Those of ``rows`` whose key may be among the ``wanted`` keys.

    It keeps the texts that a later join would drop anyway from being shuffled; what passes is still joined exactly.
    """
    return rows.filter(sieve(key, wanted, n_wanted))


def verified(pairs: DataFrame, texts: DataFrame, width: int, threshold: float) -> DataFrame:
    """The (a, b) pairs whose whole shingle sets have 100 * intersection >= 100 * threshold * union."""
    percent = round(threshold * 100)
    kind = texts.schema["node"].dataType.simpleString()
    joined = pairs.select("a", "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k, (x, y) in enumerate(zip(batch.column(2).cast(pa.binary()), batch.column(3).cast(pa.binary()))):
                left, right = shingle_hashes(x.as_py(), width), shingle_hashes(y.as_py(), width)
                both = len(np.intersect1d(left, right, assume_unique=True))
                if 100 * both >= percent * (len(left) + len(right) - both):
                    keep.append(k)
            rows = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows)], ["a", "b"])

    return joined.select("a", "b", "text_a", "text_b").mapInArrow(run, f"a {kind}, b {kind}")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node that has an edge (a, b); comp is the least node that can be reached.

    Large-star and small-star steps in turn, each written out, until the edges are the stars themselves.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        ways = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = ways.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        if large:
            moved = ways.filter("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        else:
            down = ways.filter("v < u").join(least, "u")
            moved = down.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(down.select(F.col("m").alias("a"), F.col("u").alias("b")))
        return moved.filter("a != b").distinct()

    state = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    edges, last = materialize(edges.distinct(), "edges"), None
    while True:
        large = materialize(star(edges, True), "edges")
        small = materialize(star(large, False), "edges")
        for old in (edges, large):
            discard(old)
        edges = small
        now = state(edges)
        if now == last:
            break
        last = now
    stars = edges.select(F.col("b").alias("node"), F.col("a").alias("comp"))
    return stars.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("comp"))).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, threshold: float = 0.8, miss: float = 1e-5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_shingles, component_id (smallest id that links reach, the own included), kept (own id is that).

    Words: A-Z lower-cased, split at the space and U+0009 to U+000D. A link: equal sets, or sets whose similarity is at
    least the threshold. Null and blank texts have an empty set and no links. Ids are expected to be distinct: rows that
    share one count as linked; rows with a null id join the component of an equal text, else have none. ``miss``:
    the probability allowed for dropping a pair before its sets are compared.
    """
    sk = materialize(sketches(docs, width, id_col, text_col), "sketches")
    full = sk.filter(F.col("key").isNotNull())
    grouped = materialize(full.groupBy("key").agg(F.min("id").alias("node"), F.first("sig").alias("sig")).filter(F.col("node").isNotNull()), "classes")
    classes = grouped.select("node", "sig")
    members = materialize(buckets(classes), "buckets")
    survivors = materialize(compare_pairs(candidate_pairs(members), classes, threshold, miss), "survivors")
    text_of = docs.select(F.col(id_col).alias("node"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def texts_for(pairs: DataFrame) -> DataFrame:
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        return materialize(sifted(text_of, "node", nodes, 2 * pairs.count()).join(nodes, "node", "left_semi"), "texts")

    ways = survivors.select(F.col("a").alias("u"), "a", "b", "equal").unionByName(survivors.select(F.col("b").alias("u"), "a", "b", "equal"))
    nearest = F.row_number().over(Window.partitionBy("u").orderBy(F.col("equal").desc(), F.xxhash64("a", "b")))
    first = materialize(ways.withColumn("place", nearest).filter(F.col("place") <= FIRST_PARTNERS).select("a", "b").distinct(), "first-pairs")
    texts = texts_for(first)
    links = materialize(verified(first, texts, width, threshold), "links")
    for done in (first, texts):
        discard(done)
    labels = materialize(components(links), "labels")
    of = lambda side: labels.select(F.col("node").alias(side), F.col("comp").alias(f"{side}_comp"))
    apart = survivors.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b")).filter("a != b")
    edges = materialize(apart.unionByName(bucket_edges(members, classes, labels, threshold, miss)).distinct(), "region-edges")
    more = region_links(labels, edges, classes, text_of, width, threshold, miss)
    final = components(labels.filter("node != comp").select(F.col("comp").alias("a"), F.col("node").alias("b")).unionByName(more))
    for done in (members, survivors, links, labels, edges):  # ``final`` is written, so no plan reads these again
        discard(done)
    reached = grouped.select("key", "node").join(final, "node", "left").select("key", F.coalesce("comp", "node").alias("comp"))
    placed = sk.select("id", "n", "key").join(reached, "key", "left")
    component = F.coalesce("comp", "id")
    return placed.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """``docs`` with one document of each component: that with the smallest id. Rows that share that id all stay."""
    gone = materialize(near_duplicates(docs, id_col=id_col, **how).filter(~F.col("kept")).select(F.col(id_col).alias("_gone")), "duplicates")
    return docs.join(gone, docs[id_col].eqNullSafe(gone["_gone"]), "left_anti")
