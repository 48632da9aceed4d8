"""Language-model scoring by context-tree weighting over bytes.

A text is lower-cased (A-Z) and its words joined by single spaces; DEPTH marker bytes stand before it and one after it,
which counts as a byte to predict. Each byte is split into eight binary decisions. Every decision (known by the bits
before it) has a context tree of its own over the preceding bytes; a node holds how often 0 and 1 followed its context
in training, its Krichevsky-Trofimov estimate, and the mixture of that, half and half, with the product over its
children. What the finished trees predict next mixes the estimates of all depths by the weights that training left.

Training counts and predictions both go through segments: runs of documents of bounded size, as a task reads them. A
segment contributes its distinct words and byte runs with counts, gets back their values, and scores its own texts (kept
packed beside the counts); no task holds the corpus's dictionary, and what is gathered grows with the corpus. Byte runs
travel as arrays, one for each segment and pair of last context bytes: a pair's trees down to depth 2 stand alone, and
what is above has at most 256 x 255 nodes. A pair whose runs grow too many is told apart by a third byte; its nodes at
depth 2 are then summed from those of its parts. Finished values go to the segments that ask for them, and no others.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, crc_fold, discard, materialize

#: Preceding bytes that a context reaches back, at most 6.
DEPTH = 5
MARK = 0xFF
SEGMENT_BYTES = 32 << 20
PIECE = 1 << 20
#: Lists of byte runs that are merged at once.
FAN = 64
#: A pair with a merged list over so many bytes is split by a third context byte before the next merge.
SPLIT_BYTES = 16 << 20
#: Keys of split pairs are third, second and last byte under this mark; others are second and last byte.
SPLIT = 1 << 24
#: Bytes of runs that one task looks up in a key's list, at least.
ASK_BYTES = 256 << 20
HALF = np.log(0.5)
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Runs of bytes other than the space and U+0009 to U+000D, A-Z lower-cased."""
    return text.translate(LOWER).split()


def byte_runs(sequences: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte to predict: its context and itself as one number, and the sequence it belongs to."""
    lengths = np.array([len(s) + 1 for s in sequences], np.int64)
    mark = bytes([MARK])
    raw = np.frombuffer(b"".join(mark * depth + s + mark for s in sequences), np.uint8)
    starts = np.cumsum(lengths + depth) - lengths  # of the bytes to predict
    at = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
    run = np.zeros(len(at), np.int64)
    for k in range(depth, -1, -1):
        run = (run << 8) | raw[at - k]
    return run, np.repeat(np.arange(len(sequences)), lengths)


def pieces(sequences: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of sequences of about PIECE bytes, with the place of the first. A longer sequence is a piece of its own."""
    first, size = 0, 0
    for k, s in enumerate(sequences):
        if size and size + len(s) > PIECE:
            yield first, sequences[first:k]
            first, size = k, 0
        size += len(s)
    if first < len(sequences):
        yield first, sequences[first:]


def log_estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of a sequence with so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x >= 0.5: Stirling's series at x + 8, taken back by the recurrence."""
    x = np.asarray(x, np.float64)
    down = sum(np.log(x + k) for k in range(8))
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - down


def gather(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys, each row's place among them, and sums of values by key."""
    distinct, place = np.unique(keys, return_inverse=True)
    return distinct, place, [np.bincount(place, v, len(distinct)) for v in values]


class Bit:
    """The trees of one bit place over a set of byte runs that share their last ``shared`` context bytes."""

    def __init__(self, runs: np.ndarray, counts: np.ndarray, depth: int, shared: int, bit: int):
        byte = runs & 0xFF
        self.ones = (byte >> (7 - bit)) & 1
        node = (1 << bit) | (byte >> (8 - bit))
        keys, self.place, (zero, one) = gather(((runs >> 8) << 8) | node, counts * (1 - self.ones), counts * self.ones)
        estimate = log_estimate(zero, one)
        #: Deepest level first: counts, log estimate, log mixture, and each node's parent in the next level.
        self.levels = [[zero, one, estimate, estimate, None]]
        self.keys = keys
        for d in range(depth - 1, shared - 1, -1):
            up = ((self.keys >> 8) & ((1 << (8 * d)) - 1)) << 8 | (self.keys & 0xFF)
            below = self.levels[-1]
            self.keys, parent, (zero, one, product) = gather(up, below[0], below[1], below[3])
            below[4] = parent
            estimate = log_estimate(zero, one)
            self.levels.append([zero, one, estimate, np.logaddexp(HALF + estimate, HALF + product), None])

    def top(self) -> tuple[np.ndarray, list]:
        """Keys (context and decision) and values of the shallowest level."""
        return self.keys, self.levels[-1]

    def predict_one(self) -> tuple[np.ndarray, np.ndarray]:
        """For each run: the probability of a 1 mixed over the levels here, and its place in the shallowest level."""
        zero, one = self.levels[0][:2]
        p, at = (one + 0.5) / (zero + one + 1), np.arange(len(zero))
        for k in range(1, len(self.levels)):
            at = self.levels[k - 1][4][at]
            zero, one, estimate, mixture = (x[at] for x in self.levels[k][:4])
            weight = np.exp(HALF + estimate - mixture)
            p = weight * (one + 0.5) / (zero + one + 1) + (1 - weight) * p
        return p[self.place], at[self.place]


def upper_tables(rows) -> dict[int, np.ndarray]:
    """Weight and estimate of the nodes at depths 1 and 0 from depth-1 sums (byte, decision, zeros, ones, product).

    At most 256 x 255 rows. Result: depth to an array by [context byte or 0, decision] of (weight, chance of a 1).
    """
    data = np.array(rows, np.float64).reshape(-1, 5)
    out = {1: np.zeros((256, 256, 2)), 0: np.zeros((1, 256, 2))}
    out[1][..., 1] = out[0][..., 1] = 0.5
    context, node = data[:, 0].astype(int), data[:, 1].astype(int)
    estimate = log_estimate(data[:, 2], data[:, 3])
    mixture = np.logaddexp(HALF + estimate, HALF + data[:, 4])
    out[1][context, node] = np.stack([np.exp(HALF + estimate - mixture), (data[:, 3] + 0.5) / (data[:, 2] + data[:, 3] + 1)], axis=1)
    nodes, _, (zero, one, product) = gather(node, data[:, 2], data[:, 3], mixture)
    estimate = log_estimate(zero, one)
    mixture = np.logaddexp(HALF + estimate, HALF + product)
    out[0][0, nodes] = np.stack([np.exp(HALF + estimate - mixture), (one + 0.5) / (zero + one + 1)], axis=1)
    return out


def _added(rows: np.ndarray) -> np.ndarray:
    """Rows (context, node, zeros, ones, product) summed by context and node."""
    keys, _, sums = gather(rows[:, 0].astype(np.int64) << 8 | rows[:, 1].astype(np.int64), rows[:, 2], rows[:, 3], rows[:, 4])
    return np.stack([(keys >> 8).astype(np.float64), (keys & 0xFF).astype(np.float64), *sums], axis=1)


def middle_table(rows: np.ndarray) -> tuple[dict[int, int], np.ndarray, np.ndarray]:
    """Depth 2 of split pairs from the sums of their parts (pair, decision, zeros, ones, product).

    Each pair's place, (weight, chance of a 1) by place and decision, and the rows that depth 1 sums up.
    """
    estimate = log_estimate(rows[:, 2], rows[:, 3])
    mixture = np.logaddexp(HALF + estimate, HALF + rows[:, 4])
    places = {p: i for i, p in enumerate(np.unique(rows[:, 0]).astype(int).tolist())}
    out = np.zeros((max(1, len(places)), 256, 2))
    out[..., 1] = 0.5
    at = np.array([places[int(p)] for p in rows[:, 0]], np.int64)
    out[at, rows[:, 1].astype(int)] = np.stack([np.exp(HALF + estimate - mixture), (rows[:, 3] + 0.5) / (rows[:, 2] + rows[:, 3] + 1)], axis=1)
    above = np.stack([rows[:, 0].astype(int) & 0xFF, rows[:, 1], rows[:, 2], rows[:, 3], mixture], axis=1).astype(np.float64)
    return places, out, above


def _blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _merged(runs: list[bytes], counts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs of several sorted lists, and their summed counts."""
    run, _, (n,) = gather(np.concatenate([np.frombuffer(r, np.int64) for r in runs]), np.concatenate([np.frombuffer(c, np.int64) for c in counts]))
    return run, n.astype(np.int64)


def split_lists(lists: DataFrame, pairs: set[int]) -> DataFrame:
    """``lists`` (last, runs, ...) with the rows of some pairs split by the third context byte."""
    if not pairs:
        return lists
    sent = lists.sparkSession.sparkContext.broadcast(np.array(sorted(pairs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.column("last").to_numpy()
            hot = np.isin(last, sent.value)
            yield batch.filter(pa.array(~hot))
            for k in np.flatnonzero(hot).tolist():
                runs = np.frombuffer(batch.column("runs")[k].as_py(), np.int64)
                third = (runs >> 24) & 0xFF
                order = np.argsort(third, kind="stable")
                kinds, starts = np.unique(third[order], return_index=True)
                for kind, at in zip(kinds.tolist(), np.split(order, starts[1:])):
                    columns = []
                    for field in batch.schema:
                        value = batch.column(field.name)[k].as_py()
                        if field.name == "last":
                            value = SPLIT | kind << 16 | value
                        elif pa.types.is_binary(field.type):
                            value = _blob(np.frombuffer(value, np.int64)[at])
                        columns.append(pa.array([value], field.type))
                    yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return lists.mapInArrow(run, lists.schema)


def merged_runs(lists: DataFrame, n_segments: int, depth: int) -> tuple[DataFrame, set[int]]:
    """(last, runs, counts): one row for each key, from one for each segment and pair; and the pairs that were split.

    Lists are merged FAN at a time, so no task holds more than FAN of them, however many segments there are; lists that
    grow too long are split between two rounds, so a merged list has at most FAN * SPLIT_BYTES (unless three bytes of context
    alone have more).
    """

    def merge(table: pa.Table) -> pa.Table:
        run, n = _merged(table.column("runs").to_pylist(), table.column("counts").to_pylist())
        return pa.table({"last": table.column("last").slice(0, 1), "part": table.column("part").slice(0, 1), "runs": pa.array([_blob(run)], pa.binary()), "counts": pa.array([_blob(n)], pa.binary())})

    schema, left, split = "last int, part long, runs binary, counts binary", n_segments, set()
    while True:
        if depth > 2:  # at most 65,536 pairs
            long = lists.filter(F.col("last") < SPLIT).groupBy("last").agg(F.max(F.octet_length("runs")).alias("b")).filter(F.col("b") > SPLIT_BYTES)
            now = {r["last"] for r in long.collect()}
            lists, split = split_lists(lists, now), split | now
        left = -(-left // FAN)
        merged = lists.withColumn("part", F.pmod("part", F.lit(left))).groupBy("last", "part").applyInArrow(merge, schema)
        if left == 1:
            return merged.select("last", "runs", "counts"), split
        lists = materialize(merged, "lm-merged")


def run_probabilities(model: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(last, runs, chances) of (last, runs, counts): log10 of the model's probability of each run's last byte after its context.

    ``counts`` are those of training; runs that training did not have are there with 0.
    """

    def trees(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for last, run, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            yield last, np.frombuffer(run, np.int64), np.frombuffer(n, np.int64).astype(np.float64)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for last, run, n in trees(batch):
                shared = 3 if last & SPLIT else 2
                for bit in range(8):
                    keys, (zero, one, _, mixture, _) = Bit(run, n, depth, shared, bit).top()
                    context = (keys >> 8) & (0xFFFF if shared == 3 else 0xFF)
                    parts.append((context, keys & 0xFF, zero, one, mixture, np.full(len(keys), shared == 3)))
            if parts:
                names = ["context", "node", "zeros", "ones", "product", "of_part"]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts)], names)

    sums = materialize(model.mapInArrow(summed, "context long, node long, zeros double, ones double, product double, of_part boolean"), "lm-sums")
    added = lambda rows: np.array([tuple(r) for r in rows.groupBy("context", "node").agg(F.sum("zeros"), F.sum("ones"), F.sum("product")).collect()], np.float64).reshape(-1, 5)
    # Nodes at depth 2 of split pairs (255 for each of them), then 256 context bytes by 255 decisions at most.
    middle, rows = added(sums.filter("of_part")), added(sums.filter("not of_part"))
    discard(sums)
    pairs, middle_tables, above = middle_table(middle)
    upper = upper_tables(_added(np.concatenate([rows, above])))

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chances = []
            for last, run, n in trees(batch):
                total = np.zeros(len(run))
                shared = 3 if last & SPLIT else 2
                for bit in range(8):
                    tree = Bit(run, n, depth, shared, bit)
                    p, _ = tree.predict_one()
                    node = (1 << bit) | ((run & 0xFF) >> (8 - bit))
                    if shared == 3:
                        weight, chance = middle_tables[pairs[last & 0xFFFF], node].T
                        p = weight * chance + (1 - weight) * p
                    for d, context in ((1, (run >> 8) & 0xFF), (0, np.zeros(len(run), np.int64))):
                        weight, chance = upper[d][context, node].T
                        p = weight * chance + (1 - weight) * p
                    total += np.log10(np.where(tree.ones == 1, p, 1 - p))
                chances.append(_blob(total))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(chances, pa.binary())], ["last", "runs", "chances"])

    return model.mapInArrow(predicted, "last int, runs binary, chances binary")


def looked_up(lists: DataFrame, chances: DataFrame) -> DataFrame:
    """(segment, runs, chances) of the lists (segment, last, runs): their runs' values in the key's list of ``chances``.

    A key's list comes first in its task and is kept while the lists that ask are answered one by one. Keys that very many
    ask for are dealt to several tasks, each with a copy of the list; a copy answers at least four times its own size, so
    copies never outweigh what is asked.
    """
    asked = lists.groupBy("last").agg(F.sum(F.octet_length("runs")).alias("asked"))
    sized = chances.select("last", (F.octet_length("runs") * 2).cast("long").alias("own")).join(asked, "last")
    # One row a key: at most 65,536 pairs, and 256 keys for each pair that was split. Sent, so that no list is shuffled for it.
    shares = F.broadcast(materialize(sized.select("last", F.ceil(F.col("asked") / F.greatest(F.lit(ASK_BYTES), 4 * F.col("own"))).cast("int").alias("n")), "lm-shares"))
    known = chances.join(shares, "last").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("last", "share", F.lit(None).cast("long").alias("segment"), "runs", "chances")
    asks = lists.join(shares, "last").select("last", F.pmod(F.xxhash64("segment"), F.col("n")).cast("int").alias("share"), "segment", "runs", F.lit(None).cast("binary").alias("chances"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = chance = None
        for batch in batches:
            segments, found, answers = [], [], []
            for segment, asked_runs, values in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4)):
                if segment is None:
                    runs, chance = np.frombuffer(asked_runs.as_py(), np.int64), np.frombuffer(values.as_py(), np.float64)
                else:
                    segments.append(segment)
                    found.append(asked_runs.as_py())
                    answers.append(_blob(chance[np.searchsorted(runs, np.frombuffer(found[-1], np.int64))]))
            yield pa.RecordBatch.from_arrays([pa.array(segments, pa.int64()), pa.array(found, pa.binary()), pa.array(answers, pa.binary())], ["segment", "runs", "chances"])

    both = known.unionByName(asks).repartition("last", "share").sortWithinPartitions("last", "share", F.col("segment").asc_nulls_first())
    return both.mapInArrow(run, "segment long, runs binary, chances binary")


class _SegmentCounts:
    """What one segment contributes: its texts, its words and its byte runs."""

    def __init__(self, depth: int):
        self.depth, self.size = depth, 0
        self.ids: list[pa.Array] = []
        self.texts: list[bytes] = []
        self.held: list[bool] = []
        self.words: Counter = Counter()
        self.found: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = self.counted = 0

    def add(self, doc_id: pa.Array, text: bytes, held: bool) -> None:
        words = words_of(text)
        if held:
            for w in set(words):
                self.words.setdefault(w, 0)
        else:
            self.words.update(words)
            self.words[b""] += 1  # the end token
        self.ids.append(doc_id)
        self.texts.append(b" ".join(words))
        self.held.append(held)
        self.size += len(text) + 64
        self.waiting += len(self.texts[-1])
        if self.waiting >= PIECE:
            self.count()

    def count(self) -> None:
        """Runs of the texts that were not counted yet."""
        texts, held = self.texts[self.counted :], np.array(self.held[self.counted :], bool)
        if not texts:
            return
        run, owner = byte_runs(texts, self.depth)
        train = ~held[owner]
        for rows, weight in ((run[train], 1), (run[~train], 0)):
            distinct, n = np.unique(rows, return_counts=True)
            self.found.append((distinct, n * weight))
        self.waiting, self.counted = 0, len(self.texts)
        if len(self.found) >= 16:
            self.merge()

    def merge(self) -> None:
        run, _, (n,) = gather(np.concatenate([f[0] for f in self.found]), np.concatenate([f[1] for f in self.found]))
        self.found = [(run, n.astype(np.int64))]

    def rows(self, segment: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        def batch(rows: int, **columns) -> pa.RecordBatch:
            columns["segment"] = pa.array([segment] * rows, pa.int64())
            return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(rows, f.type) for f in schema], schema=schema)

        self.count()
        self.merge()
        run, n = self.found[0]
        last = (run >> 8) & 0xFFFF
        order = np.argsort(last, kind="stable")
        run, n, last = run[order], n[order], last[order]
        kinds, starts = np.unique(last, return_index=True)
        ends = [*starts[1:], len(run)]
        for i in range(0, len(kinds), 2000):
            cuts = list(zip(starts[i : i + 2000], ends[i : i + 2000]))
            yield batch(len(cuts), last=pa.array(kinds[i : i + 2000].astype(np.int32)), runs=pa.array([_blob(run[a:b]) for a, b in cuts], pa.binary()), counts=pa.array([_blob(n[a:b]) for a, b in cuts], pa.binary()))
        words = list(self.words)
        for i in range(0, len(words), 50_000):
            cut = words[i : i + 50_000]
            yield batch(len(cut), word=pa.array(cut, pa.binary()), n=pa.array([self.words[w] for w in cut], pa.int64()))
        for first, some in pieces(self.texts):
            ids = pa.concat_arrays(self.ids[first : first + len(some)])
            listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            held = pa.array([self.held[first : first + len(some)]], pa.list_(pa.bool_()))
            yield batch(1, ids=listed, held=held, texts=pa.array([zstandard.ZstdCompressor(1).compress(b"\n".join(some))], pa.binary()))


def score_texts(docs: DataFrame, folds: int = 5, held_out_fold: int = 1, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    Learns from the rows whose crc32(id as text) modulo ``folds`` is not ``held_out_fold``. Tokens are the text's words
    and one end. base_score: log10 probability under add-half unigrams; score: under the context trees. A null or blank
    text is one end token. An empty table gives no rows; without training rows every count is 0. n_bytes: of the
    lower-cased words joined by single spaces, without the end.
    """
    if not 2 <= depth <= 6:
        raise ValueError("depth is from 2 to 6")
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"), (crc_fold(id_col, folds) == held_out_fold).alias("held_out"))

    def collected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, current, schema = TaskContext.get().partitionId(), 0, None, None
        for batch in batches:
            if schema is None:
                fields = [("segment", pa.int64()), ("last", pa.int32()), ("runs", pa.binary()), ("counts", pa.binary()), ("word", pa.binary()), ("n", pa.int64()), ("ids", pa.list_(batch.schema.field(0).type)), ("held", pa.list_(pa.bool_())), ("texts", pa.binary())]
                schema = pa.schema(fields)
            held = batch.column(2).to_pylist()
            for k, text in enumerate(batch.column(1)):
                current = current or _SegmentCounts(depth)
                current.add(batch.column(0).slice(k, 1), text.as_py() or b"", bool(held[k]))
                if current.size >= SEGMENT_BYTES:
                    yield from current.rows(part << 32 | made, schema)
                    current, made = None, made + 1
        if current:
            yield from current.rows(part << 32 | made, schema)

    stats = materialize(own.mapInArrow(collected, f"segment long, last int, runs binary, counts binary, word binary, n long, ids array<{kind}>, held array<boolean>, texts binary"), "lm-counts")
    words = stats.filter(F.col("word").isNotNull()).select("segment", "word", "n")
    lists = stats.filter(F.col("runs").isNotNull()).select("segment", "last", "runs", "counts")
    texts = stats.filter(F.col("texts").isNotNull()).select(F.col("segment").alias("of"), "ids", "held", "texts")
    n_segments = max(1, texts.agg(F.countDistinct("of")).first()[0])
    totals = materialize(words.groupBy("word").agg(F.sum("n").alias("c")), "lm-words")
    n_all, n_distinct = totals.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    hashed = F.pmod(F.xxhash64("segment"), F.lit(1 << 40))
    model, split = merged_runs(lists.select("last", hashed.alias("part"), "runs", "counts"), n_segments, depth)
    model = materialize(model, "lm-model")
    chances = materialize(run_probabilities(model, depth), "lm-chances")
    discard(model)
    answers = looked_up(split_lists(lists.select("segment", "last", "runs"), split), chances)
    nothing = lambda t: F.lit(None).cast(t)
    back = words.select("segment", "word").join(totals, "word").select("segment", "word", "c", nothing("binary").alias("runs"), nothing("binary").alias("chances"))
    back = back.unionByName(answers.select("segment", nothing("binary").alias("word"), nothing("long").alias("c"), "runs", "chances"))

    def scored(table: pa.Table, dictionary: pa.Table) -> pa.Table:
        is_word = dictionary.column("word").is_valid()
        counts = dict(zip(dictionary.column("word").filter(is_word).to_pylist(), dictionary.column("c").filter(is_word).to_pylist()))
        rest = dictionary.filter(dictionary.column("runs").is_valid())
        runs = np.concatenate([np.frombuffer(r, np.int64) for r in rest.column("runs").to_pylist()])
        chance = np.concatenate([np.frombuffer(r, np.float64) for r in rest.column("chances").to_pylist()])
        order = np.argsort(runs)
        runs, chance = runs[order], chance[order]
        out = []
        for row in range(table.num_rows):
            ids, held = table.column("ids")[row].values, table.column("held")[row].values
            sequences = zstandard.ZstdDecompressor().decompress(table.column("texts")[row].as_py()).split(b"\n")
            n_tokens, n_known, base = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), np.zeros(len(ids))
            for k, sequence in enumerate(sequences):
                words = sequence.split()
                c = np.fromiter(map(counts.__getitem__, words), np.float64, len(words))
                c = np.append(c, counts.get(b"", 0.0))
                n_tokens[k], n_known[k] = len(c), (c > 0).sum()
                base[k] = np.log10((c + 0.5) / (n_all + 0.5 * (n_distinct + 1))).sum()
            score = np.zeros(len(ids))
            for first, some in pieces(sequences):
                run, owner = byte_runs(some, depth)
                order = np.argsort(run)  # in order, so that neighbouring lookups read neighbouring places
                score[first : first + len(some)] = np.bincount(owner[order], chance[np.searchsorted(runs, run[order])], len(some))
            out.append(pa.table({"id": ids, "held_out": held, "n_tokens": n_tokens, "n_known": n_known, "base_score": base, "score": score, "n_bytes": np.array([len(s) for s in sequences], np.int64)}))
        return pa.concat_tables(out)

    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long"
    parts = max(n_segments, int(spark.conf.get("spark.sql.shuffle.partitions")))  # about a segment each
    result = texts.repartition(parts, "of").groupBy("of").cogroup(back.repartition(parts, "segment").groupBy("segment")).applyInArrow(scored, schema)
    bits = -F.col("score") * F.lit(float(np.log2(10))) / (F.col("n_bytes") + 1)
    return result.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(int(n_all)).cast("long").alias("train_tokens"), "base_score", "score", "n_bytes", bits.alias("bits_per_byte"))
