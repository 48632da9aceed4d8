"""Prefix trie of conversations by smallest-member ownership.

A node is a distinct sequence of first turns; the smallest conversation that starts with it owns it. Along a path the
members only get fewer, so what a conversation owns is a suffix of its path: one number, the depth from which it owns.

1. Turns become digests; texts go no further. A running pass over turns in order gives each its position, the bytes so far
   and the fingerprint of the sequence so far. Fingerprints are polynomials, so a conversation may span partitions: each
   partition works alone, and the part before it is joined on by one multiplication.
2. Windows over the members of each node mark its owner and the longest member, salted first, then among the salts' owners.
3. Of each member of a node, the sums over the node's subtree follow from its own path alone: the bytes from there on less
   those of the nodes it owns, whether it owns a leaf, whether it owns the next node. One group-by over nodes adds them.
4. Lists of ids are packed in blocks by sorted ranges and hashed as a stream, so no list is ever held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, discard, materialize

#: Fingerprints: polynomials over the digests' halves, at two points, modulo this prime. With depth they are a node's key.
PRIME = (1 << 61) - 1
POINTS = (0x1B8D3A5C96E7F241, 0x0F3C5B7A91D2E86D)
#: Depths of one conversation that share a key when its figures are joined back, and ids packed in one block.
STRIDE, PACKED = 4096, 1 << 14
#: Parents with children of other owners are dealt to this many keys.
SALTS = 16
KEY = ["depth", "k1", "k2"]


def running(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Rows (conv, ..., digest, bytes) with pos (from 1), upto (bytes so far), k1, k2 (fingerprint so far) and b1, b2 (before this row).

    Range partitions in order of conv and ``order``; a conversation that passes a boundary is put right by what the
    partitions before hold of it: at most two rows a partition, which the driver adds up.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    names = rows.columns
    at = {c: names.index(c) for c in ("conv", "digest", "bytes")}
    extra = "pos long, upto long, k1 long, k2 long, b1 long, b2 long"
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + f", {extra}, part int, edge boolean"

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, conv, first, state = TaskContext.get().partitionId(), None, None, (0, 0, 0, 0)
        held: pa.RecordBatch | None = None  # one batch behind, as only the end tells the last conversation

        def marked(batch: pa.RecordBatch, last) -> pa.RecordBatch:
            edge = [c == first or c == last for c in batch.column(at["conv"]).to_pylist()]
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), pa.array(edge)], [*batch.schema.names, "part", "edge"])

        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                yield marked(held, None)
            out: list[tuple] = []
            for c, digest, size in zip(*(batch.column(at[k]).to_pylist() for k in ("conv", "digest", "bytes"))):
                if c != conv:
                    first = c if conv is None else first
                    conv, state = c, (0, 0, 0, 0)
                pos, upto, k1, k2 = state
                state = (pos + 1, upto + size, (k1 * POINTS[0] + int.from_bytes(digest[:8]) + 1) % PRIME, (k2 * POINTS[1] + int.from_bytes(digest[8:]) + 1) % PRIME)
                out.append((*state, k1, k2))
            held = pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.int64()) for x in zip(*out))], [*batch.schema.names, "pos", "upto", "k1", "k2", "b1", "b2"])
        if held is not None:
            yield marked(held, conv)

    # A batch that is not the last may hold rows of the last conversation; their edge is told by the later row of greatest position.
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "conv", *order).sortWithinPartitions("conv", *order)
    stored = materialize(dealt.mapInArrow(local, schema), "running")
    before: dict[tuple[int, int], tuple[int, int, int, int]] = {}
    ends = stored.filter("edge").groupBy("conv", "part").agg(F.max(F.struct("pos", "upto", "k1", "k2")).alias("s"))
    total: dict[int, tuple[int, int, int, int]] = {}
    for conv, part, s in sorted(ends.collect()):  # two rows a partition
        pos, upto, k1, k2 = total.get(conv, (0, 0, 0, 0))
        if pos:
            before[conv, part] = (pos, upto, k1, k2)
        total[conv] = (pos + s[0], upto + s[1], (k1 * pow(POINTS[0], s[0], PRIME) + s[2]) % PRIME, (k2 * pow(POINTS[1], s[0], PRIME) + s[3]) % PRIME)
    known = {c for c, _ in before}
    keep = [*names, "pos", "upto", "k1", "k2", "b1", "b2"]
    if not before:
        return stored.select(*keep)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = [keep.index(c) for c in ("pos", "upto", "k1", "k2", "b1", "b2")]
        for batch in batches:
            columns = list(batch.columns)[:-1]
            convs = batch.column(at["conv"]).to_pylist()
            if not known.isdisjoint(convs):
                values = [columns[i].to_pylist() for i in where]
                for i, (conv, part) in enumerate(zip(convs, batch.column(len(keep)).to_pylist())):
                    if (start := before.get((conv, part))) is not None:
                        n = values[0][i]
                        values[0][i], values[1][i] = n + start[0], values[1][i] + start[1]
                        for k in (0, 1):
                            values[2 + k][i] = (start[2 + k] * pow(POINTS[k], n, PRIME) + values[2 + k][i]) % PRIME
                            values[4 + k][i] = (start[2 + k] * pow(POINTS[k], n - 1, PRIME) + values[4 + k][i]) % PRIME
                for i, v in zip(where, values):
                    columns[i] = pa.array(v, pa.int64())
            yield pa.RecordBatch.from_arrays(columns, keep)

    return stored.select(*keep, "part").mapInArrow(joined, schema.rsplit(", part int", 1)[0])


def turn_rows(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turn, role, digest, bytes): null role and text are empty; rows without an id have no conversation and are left out."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    return conversations.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))


def rebuilt(turns: DataFrame, block: int, most: int) -> DataFrame:
    """(conv, depth, digest, bytes): the first h turns of the block's first conversation, then the own turns after the first h; h = crc32(id) % most."""
    numbered = running(turns, [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")])
    convs = numbered.groupBy("conv").agg(F.max("pos").alias("n_own")).withColumn("h", F.crc32(F.col("conv").cast("string").cast("binary")) % most)
    heads = numbered.filter(F.col("pos") < most).groupBy(F.col("conv").alias("base")).agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "bytes"))).alias("head"))  # fewer than ``most`` turns
    plan = convs.withColumn("base", F.col("conv") - F.col("conv") % block).join(heads, "base", "left")
    taken = F.slice(F.coalesce("head", F.array().cast("array<struct<pos:bigint,digest:binary,bytes:bigint>>")), F.lit(1), F.col("h").cast("int"))
    plan = plan.select("conv", "h", "n_own", F.when(F.col("h") > 0, taken).alias("head")).withColumn("n_head", F.greatest(F.size("head"), F.lit(0)))
    plan = materialize(plan, "paths")
    lent = plan.select("conv", F.explode("head").alias("t")).select("conv", F.col("t.pos").alias("depth"), "t.digest", "t.bytes")
    stride = plan.filter("n_own > h").select("conv", "h", "n_head", F.explode(F.sequence(F.lit(0), F.floor(F.col("n_own") / STRIDE).cast("int"))).alias("stride"))
    own = numbered.withColumn("stride", F.floor(F.col("pos") / STRIDE).cast("int")).join(stride, ["conv", "stride"]).filter("pos > h")
    rows = lent.unionByName(own.select("conv", (F.col("pos") - F.col("h") + F.col("n_head")).alias("depth"), "digest", "bytes"))
    # a conversation that keeps no turn has the root alone
    return rows, plan.select("conv", (F.col("n_head") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("length"))


def list_hashes(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256): SHA-256 over the ids that end at a node, ascending, comma-joined.

    Ids are packed into blocks by the tasks of sorted ranges. A hash is a chain, so one task reads the blocks of one node,
    one after the other; it holds one at a time.
    """
    spark = ends.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids, out = None, [], []

        def flush() -> pa.RecordBatch:
            rows = [pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            out.clear()
            return pa.RecordBatch.from_arrays(rows, [*KEY, "first", "ids"])

        for batch in batches:
            for depth, k1, k2, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if (depth, k1, k2) != node or len(ids) == PACKED:
                    if ids:
                        out.append((*node, ids[0], ",".join(map(str, ids))))
                    node, ids = (depth, k1, k2), []
                ids.append(conv)
            if out:
                yield flush()
        if ids:
            out.append((*node, ids[0], ",".join(map(str, ids))))
            yield flush()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        names = [*KEY, "ends_sha256"]
        for batch in batches:
            out = []
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids"))):
                if key != node:
                    if node is not None:
                        out.append((*node, sha.hexdigest()))
                    node, sha = key, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in out])
        if node is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(names, (*node, sha.hexdigest())))])

    key = "depth long, k1 long, k2 long"
    packed = ends.select(*KEY, "conv").repartitionByRange(partitions, *KEY, "conv").sortWithinPartitions(*KEY, "conv").mapInArrow(pack, f"{key}, first long, ids string")
    return packed.repartition(partitions, *KEY).sortWithinPartitions(*KEY, "first").mapInArrow(digest, f"{key}, ends_sha256 string")


def trie(paths: DataFrame, lengths: DataFrame) -> DataFrame:
    """The nodes of paths (conv, depth, digest, bytes), with depths from 1 on without gaps, and lengths (conv, length); see ``conversation_trie``."""
    spark = paths.sparkSession
    numbered = running(paths, [F.col("depth")])
    top = lengths.select("conv", *(F.lit(0).cast("long").alias(c) for c in ("depth", "bytes", "upto", "k1", "k2", "b1", "b2")))
    rows = materialize(numbered.select("conv", "depth", "bytes", "upto", "k1", "k2", "b1", "b2").unionByName(top), "path-nodes")
    discard(numbered)

    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stride = F.floor(F.col("depth") / STRIDE).cast("int")
    salted = Window.partitionBy(*KEY, "salt")
    spread = lengths.withColumn("stride", F.explode(F.sequence(F.lit(0), F.floor(F.col("length") / STRIDE).cast("int"))))
    placed = rows.withColumn("stride", stride).join(spread, ["conv", "stride"]).withColumn("salt", F.pmod(F.xxhash64("conv"), F.lit(salts)).cast("int"))
    marked = placed.select("conv", *KEY, "salt", "bytes", "length").withColumn("least", F.min("conv").over(salted)).withColumn("longest", F.max("length").over(salted)).filter("conv = least")
    node = Window.partitionBy(*KEY)  # a row a salt
    owned = marked.withColumn("owner", F.min("conv").over(node)).withColumn("longest", F.max("longest").over(node)).filter("conv = owner")
    owners = owned.groupBy("conv").agg(F.min("depth").alias("from"), F.sum("bytes").alias("own_bytes"), F.max((F.col("longest") == F.col("depth")).cast("int")).alias("leaf"))
    totals = rows.groupBy("conv").agg(F.sum("bytes").alias("all_bytes"))
    figures = lengths.join(totals, "conv").join(owners, "conv", "left").select("conv", "length", "all_bytes", F.coalesce("from", F.col("length") + 1).alias("from"), F.coalesce("own_bytes", F.lit(0)).alias("own_bytes"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    figures = materialize(figures, "figures")

    dealt = figures.withColumn("stride", F.explode(F.sequence(F.lit(0), F.floor(F.col("length") / STRIDE).cast("int"))))
    each = rows.withColumn("stride", stride).join(dealt, ["conv", "stride"])
    owns = F.col("depth") >= F.col("from")
    extra = F.when(owns, 0).otherwise(F.col("all_bytes") - (F.col("upto") - F.col("bytes")) - F.col("own_bytes"))
    next_owned = ((F.col("depth") < F.col("length")) & (F.col("depth") + 1 >= F.col("from"))).cast("long")
    entry = F.when(owns, F.struct((F.col("depth") == F.col("from")).alias("enters"), "b1", "b2", (F.col("depth") < F.col("length")).alias("goes_on")))
    nodes = each.groupBy(*KEY).agg(
        F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.sum(next_owned).alias("n_children"), F.sum(F.col("leaf").cast("long")).alias("n_leaves"),
        F.sum(extra).cast("long").alias("saved_tokens"), F.max(entry).alias("entry"), F.max((F.col("depth") == F.col("length")).cast("int")).alias("ended"),
    )
    nodes = materialize(nodes, "nodes")

    enters = (F.col("depth") > 0) & F.col("entry.enters")
    child = nodes.filter(enters).select(F.col("depth").alias("d"), F.col("k1").alias("c1"), F.col("k2").alias("c2"), (F.col("depth") - 1).alias("depth"), F.col("entry.b1").alias("k1"), F.col("entry.b2").alias("k2"), F.pmod(F.xxhash64("k1", "k2"), F.lit(SALTS)).cast("int").alias("salt"))
    parent = nodes.filter(F.col("n_children") > F.col("entry.goes_on").cast("int")).select(*KEY, F.col("conv_id").alias("parent_conv_id"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    found = child.join(parent, [*KEY, "salt"]).select(F.col("d").alias("depth"), F.col("c1").alias("k1"), F.col("c2").alias("k2"), "parent_conv_id")
    ends = list_hashes(each.filter("depth = length"))
    out = nodes.join(found, KEY, "left").join(ends, KEY, "left")
    inner = F.when((F.col("depth") > 0) & ~F.col("entry.enters"), F.col("conv_id"))
    return out.select("conv_id", "depth", F.coalesce("parent_conv_id", inner).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, block: int = 5, most: int = 9, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn (null first), then role, then the MD5 digest of role and text, so ties and repeated rows have
    one order; repeated rows are turns of their own. Null role and text are empty. Rows without an id are left out; other
    columns are ignored. Every conversation is rebuilt: the first h turns of conversation id - id % ``block`` (fewer if it
    has fewer, none if it does not exist), then its own after its first h; h = crc32(id) % ``most``. A conversation
    without turns left is a member of the root. An empty table has no node. Nodes are told apart by 122-bit fingerprints.
    """
    paths, lengths = rebuilt(turn_rows(conversations, id_col, turn_col, role_col, text_col), block, most)
    return trie(paths, lengths)
