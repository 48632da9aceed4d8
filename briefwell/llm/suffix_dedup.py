"""Removal of repeated byte strings by suffix arrays over shards.

1. Anchors: of the grams inside every string of the set length, the one of smallest hash. Equal strings have equal anchors,
   and neighbours mostly share theirs. A bitmap, built by hash ranges from compressed lists, tells which anchors of long
   grams may occur in two documents.
2. Strings with such anchors are cut out of the texts, in runs that share an anchor of short grams (which makes runs
   longer and so fewer bytes common to two of them). Equal runs of a batch send their bytes once.
3. Runs are sharded by anchor, so that equal strings always meet. Each shard of whole anchors, a few MB, gets its suffix
   array by induced sorting and its permuted common prefixes; neighbours that share the set length are one string, and
   the smallest document of each is known. An anchor with too many different runs for one shard is cut into its strings,
   which Spark groups.
4. Runs take their strings' smallest documents back, documents their runs', and lose the bytes that are covered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, materialize, release
from .near_dup import sieve
from .suffix_array import permuted_prefixes, suffix_array

#: Bytes of the grams that tell repeated strings, and of those that shard them; at most.
TOLD_BY, DEALT_BY = 24, 12
#: Strings of one piece of a text.
PART = 2 << 20
#: Strings of one run, at most; runs of periodic texts would be longer.
RUN = 64
#: Bits of the anchors' bitmap (64 MB), the hash ranges it is built by, and the finer bits that tell whether an anchor was seen before.
BITS, RANGES, FINE = 29, 4096, 35
#: Bytes of a shard, and of the runs of one anchor that are sorted in one shard.
SHARD_BYTES, ANCHOR_BYTES = 3 << 19, 4 << 20
#: Runs that at least one in so many occurrences shows are joined by broadcast, which bounds their number.
COMMON, LEAST_COMMON = 4096, 1024
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _A
    return x ^ (x >> np.uint64(29))


def words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one number; bytes past the end are 0."""
    x = np.zeros(len(text) + 7, np.uint64)
    x[: len(text)] = text
    for size in (1, 2, 4):
        x = x[:-size] | x[size:] << np.uint64(8 * size)
    return x


def gram_hashes(eight: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes from each position, from the words there."""
    n = len(eight) - gram + 1
    out = np.full(n, np.uint64(gram))
    for at in [*range(0, gram - 7, 8), *([gram - 8] if gram % 8 and gram > 8 else [])] or [0]:
        out ^= eight[at : at + n] if gram >= 8 else eight[:n] & np.uint64((1 << 8 * gram) - 1)
        out *= _B
        out ^= out >> np.uint64(32)
    return out


def anchors(eight: np.ndarray, length: int, gram: int) -> np.ndarray:
    """The anchor of the string from each position."""
    gram = min(gram, length)
    least, size, width = gram_hashes(eight, gram), 1, length - gram + 1
    while size < width:
        step = min(size, width - size)
        least = np.minimum(least[: len(least) - step], least[step:])
        size += step
    return least


def slots(told: np.ndarray, bits: int) -> np.ndarray:
    """Places of anchors among 2^bits; least hashes are small numbers, so they are mixed again."""
    return (_mixed(told * _B) >> np.uint64(64 - bits)).astype(np.int64)


def runs(dealt: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last positions (exclusive) of runs of wanted strings with one anchor, of RUN strings at most."""
    edge = np.ones(len(dealt), bool)
    edge[1:] = (dealt[1:] != dealt[:-1]) | (wanted[1:] != wanted[:-1])
    starts = np.flatnonzero(edge)
    ends = np.append(starts[1:], len(dealt))
    keep = wanted[starts]
    starts, ends = starts[keep], ends[keep]
    if len(starts) and (ends - starts).max() > RUN:
        pieces = -(-(ends - starts) // RUN)
        within = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts, ends = np.repeat(starts, pieces) + within * RUN, np.repeat(ends, pieces)
        ends = np.minimum(ends, starts + RUN)
    return starts, ends


def hashed(pieces: list[bytes]) -> pa.Array:
    return pa.array(np.fromiter(map(xxhash.xxh3_64_intdigest, pieces), np.uint64, len(pieces)).view(np.int64))


def parts(text: bytes, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """A text in pieces that bound memory, each with its start: every string of the set length lies in one of them."""
    for start in range(0, len(text) - length + 1, PART):
        yield start, np.frombuffer(text, np.uint8)[start : start + PART + length - 1]


def repeated_anchors(docs: DataFrame, length: int) -> np.ndarray:
    """Bitmap of the anchor hashes that may occur in two rows of ``docs`` (text): never misses one, and is 64 MB whatever the input.

    Only anchors seen twice by 35 bits of their hash are marked, so that anchors of one document seldom pass.
    """
    spark = docs.sparkSession
    share, fine = (1 << BITS) // RANGES, (1 << FINE) // RANGES

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for batch in batches:
            found = []
            for value in batch.column(0).cast(pa.binary()):
                own = []
                for _, part in parts(value.as_py() or b"", length):
                    told = anchors(words(part), length, TOLD_BY)
                    own.append(np.unique(slots(told[np.append(True, told[1:] != told[:-1])], FINE)))
                found += own if len(own) < 2 else [np.unique(np.concatenate(own))]
            if not found:
                continue
            places = np.sort(np.concatenate(found))
            third = np.zeros(len(places), bool)
            third[2:] = places[2:] == places[:-2]
            places = places[~third]
            cuts = np.searchsorted(places, np.arange(RANGES + 1) * fine)
            pieces = [(r, np.diff(places[a:b], prepend=r * fine).astype("<u4").tobytes()) for r, (a, b) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in pieces], pa.int32()), pa.array([len(x) for _, x in pieces], pa.int64()), pa.array([codec.compress(x, asbytes=True) for _, x in pieces])], ["range", "size", "steps"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, at, once, twice = pa.Codec("zstd"), None, None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(twice, bitorder="little").tobytes()])], ["range", "bits"])

        for batch in batches:
            for r, size, steps in zip(*(c.to_pylist() for c in batch.columns)):
                if r != at:
                    if at is not None:
                        yield done()
                    at, once, twice = r, np.zeros(fine, bool), np.zeros(share, bool)
                places = np.cumsum(np.frombuffer(codec.decompress(steps, size, asbytes=True), "<u4").astype(np.int64))
                again = np.concatenate([places[once[places]], places[1:][places[1:] == places[:-1]]])
                twice[again >> (FINE - BITS)] = True
                once[places] = True
        if at is not None:
            yield done()

    lists = docs.select("text").mapInArrow(listed, "range int, size long, steps binary")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = lists.repartition(partitions, "range").sortWithinPartitions("range").mapInArrow(merged, "range int, bits binary")
    bits = np.zeros(1 << (BITS - 3), np.uint8)
    for r, found in ranged.collect():  # RANGES rows of 16 KB
        bits[r * (share // 8) : (r + 1) * (share // 8)] = np.frombuffer(found, np.uint8)
    return bits


def cut_runs(docs: DataFrame, length: int, bits: np.ndarray, kind: str) -> DataFrame:
    """Runs of docs (doc, own, text) whose anchor may be repeated: anchor, h (hash of the bytes), doc, own, start; and, once for equal runs of a batch, bytes, first and last document, count."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)
    names = ["anchor", "h", "doc", "own", "start", "bytes", "first", "last", "n"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards, firsts, owner, pieces = [], [], [], []
            for k, value in enumerate(batch.column(2).cast(pa.binary())):
                text = value.as_py() or b""
                for start, part in parts(text, length):
                    eight = words(part)
                    told, dealt = anchors(eight, length, TOLD_BY), anchors(eight, length, DEALT_BY)
                    cuts = np.flatnonzero(np.append(True, told[1:] != told[:-1]))
                    place = slots(told[cuts], BITS)
                    may = sent.value[place >> 3] >> (place & 7).astype(np.uint8) & 1 == 1
                    begin, end = runs(dealt, np.repeat(may, np.diff(np.append(cuts, len(told)))))
                    shards.append(dealt[begin].view(np.int64))
                    firsts.append(begin + start)
                    owner.append(np.full(len(begin), k))
                    pieces += [text[a:b] for a, b in zip((begin + start).tolist(), (end + (start + length - 1)).tolist())]
            if not pieces:
                continue
            hashes = np.asarray(hashed(pieces))
            anchor, owner = np.concatenate(shards), np.concatenate(owner)
            ids = batch.column(0)
            place = np.empty(batch.num_rows, np.int64)
            place[np.asarray(pa.compute.sort_indices(ids))] = np.arange(batch.num_rows)  # orders documents as their ids
            order = np.lexsort((place[owner], hashes, anchor))
            a, h = anchor[order], hashes[order]
            begins = np.concatenate([[0], np.flatnonzero((a[1:] != a[:-1]) | (h[1:] != h[:-1])) + 1])
            last = np.append(begins[1:], len(order)) - 1
            heads = order[begins]
            to = np.full(len(pieces), -1)
            to[heads] = np.arange(len(heads))
            none = pa.array(to, mask=to < 0)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(anchor), pa.array(hashes), ids.take(pa.array(owner)), batch.column(1).take(pa.array(owner)), pa.array(np.concatenate(firsts), pa.int32()),
                    pa.array([pieces[i] for i in heads]).take(none), ids.take(pa.array(owner[heads])).take(none), ids.take(pa.array(owner[order[last]])).take(none), pa.array(last - begins + 1).take(none),
                ],
                names,
            )

    return docs.select("doc", "own", "text").mapInArrow(cut, f"anchor long, h long, doc {kind}, own long, start int, bytes binary, first {kind}, last {kind}, n long")


def smallest_documents(pieces: list[bytes], first: np.ndarray, length: int) -> np.ndarray:
    """For each string of each piece, in order, the least of ``first`` over the pieces that hold it: one shard's suffix array."""
    sizes = np.array([len(p) for p in pieces], np.int32)
    owner = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
    inside = np.arange(len(owner), dtype=np.int32) + owner
    flat = np.zeros(len(owner) + len(pieces) + 1, np.uint8)
    flat[inside] = np.frombuffer(b"".join(pieces), np.uint8)
    text = np.ones(len(flat), np.int16)  # 1 parts the pieces, 0 ends the text
    text[inside] = flat[inside].astype(np.int16) + 2
    text[-1] = 0
    strings = sizes - length + 1
    of = np.repeat(np.arange(len(pieces), dtype=np.int32), strings)
    at = np.repeat(np.cumsum(sizes + 1) - sizes - 1, strings) + np.arange(len(of)) - np.repeat(np.cumsum(strings) - strings, strings)
    number = np.full(len(text), -1, np.int32)
    number[at] = np.arange(len(at), dtype=np.int32)
    order = suffix_array(text, 258)
    order = order[number[order] >= 0]
    begins = np.flatnonzero(permuted_prefixes(flat, order, length) < length)  # no string holds a parting mark
    rows = number[order]
    least = np.minimum.reduceat(first[of[rows]], begins)
    out = np.empty(len(at), first.dtype)
    out[rows] = np.repeat(least, np.diff(np.append(begins, len(rows))))
    return out


def run_owners(cut: DataFrame, length: int, kind: str) -> DataFrame:
    """(anchor, h, n, ends, firsts): for each run that some later document shows, the smallest document of each of its strings, as runs of equal values."""
    spark = cut.sparkSession
    names = ["anchor", "h", "n", "ends", "firsts", "string", "k", "first", "last"]
    schema = f"anchor long, h long, n long, ends array<int>, firsts array<{kind}>, string binary, k int, first {kind}, last {kind}"

    def nulls(rows: int, *kinds: pa.DataType) -> list[pa.Array]:
        return [pa.nulls(rows, k) for k in kinds]

    def sorted_shard(shard: pa.Table) -> pa.RecordBatch:
        anchor = np.asarray(shard.column("anchor"))
        ids, rank = np.unique(shard.column("first").to_numpy(zero_copy_only=False), return_inverse=True)
        last = shard.column("last").combine_chunks()
        own = np.asarray(pa.compute.equal(shard.column("first"), last))
        begins = np.concatenate([[0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1])
        size = np.diff(np.append(begins, len(anchor)))
        alone = np.minimum.reduceat(rank, begins) == np.maximum.reduceat(rank, begins)
        alone &= np.minimum.reduceat(own, begins)
        use = np.flatnonzero(~np.repeat(alone, size))  # the bitmap also lets anchors of one document through
        if not len(use):
            return pa.RecordBatch.from_pylist([], schema=result)
        pieces = shard.column("bytes").take(pa.array(use)).to_pylist()
        least = smallest_documents(pieces, rank[use], length)
        strings = np.array([len(p) for p in pieces]) - length + 1
        edge = np.concatenate([[True], least[1:] != least[:-1]])
        starts = np.cumsum(strings) - strings
        edge[starts] = True
        value = np.flatnonzero(edge)
        piece = np.repeat(np.arange(len(use)), strings)[value]
        ends = np.append(value[1:], len(least)) - starts[piece]
        offsets = np.searchsorted(piece, np.arange(len(use) + 1))
        firsts = pa.array(ids[least[value]]).cast(result.field("first").type)
        lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), x) for x in (pa.array(ends, pa.int32()), firsts)]
        rows = pa.array(use)
        top = np.asarray(shard.column("last").to_numpy(zero_copy_only=False), dtype=ids.dtype)[use]
        wanted = pa.array(np.flatnonzero(ids[np.minimum.reduceat(least, starts)] < top))
        full = [shard.column("anchor").combine_chunks().take(rows), hashed(pieces), shard.column("n").combine_chunks().take(rows), *lists]
        m = len(wanted)
        return pa.RecordBatch.from_arrays([x.take(wanted) for x in full] + nulls(m, pa.binary(), pa.int32(), firsts.type, firsts.type), schema=result)

    def in_strings(group: pa.Table) -> pa.RecordBatch:
        pieces = group.column("bytes").to_pylist()
        rows = np.repeat(np.arange(len(pieces)), [len(p) - length + 1 for p in pieces])
        given = {"h": hashed(pieces)} | {c: group.column(c).combine_chunks() for c in ("anchor", "n", "first", "last")}
        take = [given[c].take(pa.array(rows)) for c in ("anchor", "h", "n", "first", "last")]
        strings = pa.array([p[k : k + length] for p in pieces for k in range(len(p) - length + 1)])
        k = pa.array([k for p in pieces for k in range(len(p) - length + 1)], pa.int32())
        m = len(rows)
        return pa.RecordBatch.from_arrays([*take[:3], *nulls(m, result.field("ends").type, result.field("firsts").type), strings, k, *take[3:]], schema=result)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        large = None  # the anchor that is being cut into its strings

        def flushed(rows: pa.Table, at_end: bool) -> Iterator[pa.RecordBatch]:
            """Whole anchors of the rows, which are in order; the last anchor may go on and is held back."""
            nonlocal large, held
            anchor = np.asarray(rows.column("anchor"))
            begins = np.concatenate([[0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, [len(anchor)]])
            bytes_ = np.append(0, np.cumsum(np.asarray(pa.compute.binary_length(rows.column("bytes")).cast(pa.int64()))))
            held, start = [], 0  # ``start``: first group of the shard that grows
            for g in range(len(begins) - 1):
                a, b = begins[g], begins[g + 1]
                ends_here = at_end or g < len(begins) - 2
                size = bytes_[b] - bytes_[a]
                if anchor[a] == large or size > ANCHOR_BYTES:
                    if begins[start] < a:
                        yield sorted_shard(rows.slice(begins[start], a - begins[start]))
                    large = anchor[a]
                    for at in range(a, b, 4096):
                        yield in_strings(rows.slice(at, min(4096, b - at)))
                    start = g + 1
                elif not ends_here:
                    if begins[start] < a:
                        yield sorted_shard(rows.slice(begins[start], a - begins[start]))
                    held, start = [rows.slice(a)], g + 1
                elif bytes_[b] - bytes_[begins[start]] >= SHARD_BYTES or g == len(begins) - 2:
                    yield sorted_shard(rows.slice(begins[start], b - begins[start]))
                    start = g + 1

        waiting = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            waiting += batch.nbytes
            if waiting >= SHARD_BYTES:
                yield from flushed(pa.concat_tables(held).combine_chunks(), False)
                waiting = sum(x.nbytes for x in held)
        if held:
            yield from flushed(pa.concat_tables(held).combine_chunks(), True)

    ids = pa.array([], type=pa.int64()) if kind == "bigint" else None
    id_type = ids.type if ids is not None else {"int": pa.int32(), "string": pa.string()}[kind]
    result = pa.schema([("anchor", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("ends", pa.list_(pa.int32())), ("firsts", pa.list_(id_type)), ("string", pa.binary()), ("k", pa.int32()), ("first", id_type), ("last", id_type)])
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = cut.filter(F.col("bytes").isNotNull()).select("anchor", "bytes", "first", "last", "n").repartition(partitions, "anchor")
    distinct = texts.groupBy("anchor", "bytes").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
    stored = materialize(distinct.sortWithinPartitions("anchor").select("anchor", "bytes", "first", "last", "n").mapInArrow(shards, schema).select(*names), "run-owners")
    owners = stored.filter(F.col("string").isNull()).select("anchor", "h", "n", "ends", "firsts")
    cut_up = stored.filter(F.col("string").isNotNull())
    least = cut_up.groupBy("string").agg(F.min("first").alias("f"))
    joined = cut_up.join(least, "string").groupBy("anchor", "h", "n", "last").agg(F.array_sort(F.collect_list(F.struct("k", "f"))).alias("s"), F.min("f").alias("f")).filter(F.col("f") < F.col("last"))
    return owners.unionByName(joined.select("anchor", "h", "n", F.transform("s", lambda x: x["k"] + 1).alias("ends"), F.transform("s", lambda x: x["f"]).alias("firsts")))


def covered(cut: DataFrame, owners: DataFrame, length: int) -> DataFrame:
    """(doc, own, spans): the byte ranges of each document that strings of smaller documents cover, unmerged."""
    owners = owners.withColumnRenamed("n", "seen")
    total = owners.agg(F.sum("seen")).first()[0] or 0
    often = max(LEAST_COMMON, total // COMMON)
    light = cut.select("anchor", "h", "doc", "own", "start")
    common = owners.filter(F.col("seen") >= often)  # at most COMMON rows
    rest = light.join(F.broadcast(common.select("anchor", "h")), ["anchor", "h"], "left_anti").join(owners.filter(F.col("seen") < often), ["anchor", "h"])
    both = light.join(F.broadcast(common), ["anchor", "h"]).unionByName(rest)
    span = F.transform("ends", lambda e, i: F.struct((F.col("start") + F.when(i > 0, F.get("ends", i - 1)).otherwise(0)).alias("a"), (F.col("start") + e + (length - 1)).alias("b"), F.get("firsts", i).alias("f")))
    gone = F.filter(span, lambda s: s["f"] < F.col("doc"))
    return both.select("doc", "own", F.explode(F.transform(gone, lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b")))).alias("span")).groupBy("doc", "own").agg(F.collect_list("span").alias("spans"))


def remove_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_bytes, n_removed, n_spans (maximal removed ranges), kept_sha256, kept (the bytes left; binary).

    Bytes are those of UTF-8. A byte goes if a string of ``length`` bytes that covers it also starts in a document with a
    smaller id, both as given, within documents. Null texts are empty. Rows that share an id are not smaller than each
    other; rows without an id lose nothing and take nothing. Other columns are ignored. Ids are long, int or string.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit("")).cast("string")
    rows = docs.select(F.col(id_col).alias("doc"), text.alias("text"), F.xxhash64(text).alias("own"))
    named = rows.filter(F.col("doc").isNotNull() & (F.octet_length("text") >= length))
    cut = materialize(cut_runs(named, length, repeated_anchors(named, length), kind), "runs")
    release(spark)
    owners = run_owners(cut, length, kind)
    release(spark)
    marks = materialize(covered(cut, owners, length), "marks")
    discard(cut)
    discard(owners)
    release(spark)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, ranges, hashes, left = [], [], [], [], []
            for value, spans in zip(batch.column(1).cast(pa.binary()), batch.column(2)):
                text = value.as_py()
                edges = np.zeros(len(text) + 1, np.int32)
                if spans.is_valid:
                    pairs = spans.values.flatten()
                    np.add.at(edges, np.asarray(pairs[0]), 1)
                    np.add.at(edges, np.asarray(pairs[1]), -1)
                gone = np.cumsum(edges[:-1]) > 0
                rest = np.frombuffer(text, np.uint8)[~gone].tobytes()
                sizes.append(len(text))
                removed.append(len(text) - len(rest))
                ranges.append(int(np.count_nonzero(np.diff(gone, prepend=False) & gone)))
                hashes.append(hashlib.sha256(rest).hexdigest())
                left.append(rest)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, removed, ranges)), pa.array(hashes, pa.string()), pa.array(left, pa.binary())], [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    may = F.coalesce(sieve("doc", marks.filter(F.col("doc").isNotNull()), marks.count()), F.lit(False)) & F.col("doc").isNotNull()
    whole = rows.filter(~may).select(F.col("doc").alias(id_col), F.octet_length("text").cast("long").alias("n_bytes"), *(F.lit(0).cast("long").alias(c) for c in ("n_removed", "n_spans")), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), F.col("text").cast("binary").alias("kept"))
    some = rows.filter(may).join(marks, ["doc", "own"], "left").select("doc", "text", "spans").mapInArrow(kept, f"{id_col} {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return whole.unionByName(some)
