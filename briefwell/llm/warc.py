"""WARC archives: write, normalise from one gzip stream a file to one member a record, index, and read back.

Executors write archives straight to the cluster's shared folder, through pyarrow's file systems. A file gets a name of
its own for each attempt and is moved into place when complete; the manifest table names the files that count, so a
task that is run again leaves at most an unused file. Every file is handled as a stream.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, scratch_path

ARCHIVE_BYTES = 64 << 20
PIECE = 1 << 18
LEVEL = 4
SALTS = 32
GZIP = zlib.MAX_WBITS | 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def with_roles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least_bytes: int = 100) -> DataFrame:
    """page_id, url, digest, size, record_type, refers_to, payload (null for revisits).

    Of records with equal payloads of at least ``least_bytes`` bytes, that with the smallest id is the response and the
    others revisit it. A null payload is empty. Rows with the smallest id are all responses if it occurs twice; rows
    with a null id revisit any other, and are responses where there is none. Ids and digests alone decide who revisits
    whom, by salted keys; payloads meet the outcome by id and digest, so copies of one payload are spread out.
    """
    body = F.coalesce(F.col(body_col), F.lit("")).cast("binary")
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), body.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    narrow = materialize(own.select("page_id", "digest", F.octet_length("payload").cast("long").alias("size")).filter(F.col("size") >= least_bytes).select("page_id", "digest"), "warc-digests")
    groups = narrow.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    groups = groups.select("digest", "first").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = narrow.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    again = salted.join(groups, ["digest", "salt"]).filter(~F.col("first").eqNullSafe(F.col("page_id")))
    again = again.select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), F.col("first").alias("refers_to")).distinct()
    joined = own.join(again, (F.col("digest") == F.col("_digest")) & F.col("page_id").eqNullSafe(F.col("_id")), "left")
    revisit = F.col("_digest").isNotNull() & F.col("refers_to").isNotNull()
    return joined.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("size"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), "refers_to", F.when(~revisit, F.col("payload")).alias("payload"))


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{page_id}')}>"


def record_bytes(row: dict, date: str) -> bytes:
    """One WARC record: header, HTTP message, two line ends."""
    body = row["payload"] if row["record_type"] == "response" else b""
    message = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row["size"] + (body or b"")
    fields = {"WARC-Type": row["record_type"], "WARC-Record-ID": record_id(row["page_id"]), "WARC-Date": date}
    if row["url"] is not None:
        fields["WARC-Target-URI"] = "".join(c for c in row["url"] if c >= " ")
    if row["record_type"] == "revisit":
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(row["refers_to"]), "X-Refers-To-Page": json.dumps(row["refers_to"])}
    if row["page_id"] is not None:
        fields["X-Page-Id"] = json.dumps(row["page_id"])
    fields |= {"WARC-Payload-Digest": f"sha256:{row['digest']}", "Content-Type": "application/http; msgtype=response", "Content-Length": len(message)}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n" + message + b"\r\n\r\n"


def write_monolithic(records: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write ``records`` (of with_roles) as archives that are one gzip stream each; the manifest: archive, n_records."""
    id_type = records.schema["page_id"].dataType.simpleString()
    if id_type not in ID_TYPES:
        raise ValueError(f"page ids are integers or strings, not {id_type}")
    bounded_batches(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        out = None

        def close() -> pa.RecordBatch:
            out.write(packer.flush())
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["archive", "n_records"])

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name, n, size = f"pages-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out, packer = fs.open_output_stream(f"{root}/{name}", compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
                data = record_bytes(row, date)
                out.write(packer.compress(data))
                n, size = n + 1, size + len(data)
                if size >= ARCHIVE_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return materialize(records.mapInArrow(run, "archive string, n_records long"), "warc-manifest")


class Inflating:
    """Reads the text of a gzip file as a stream, through any number of members."""

    def __init__(self, source):
        self.source, self.unpacker, self.held, self.over = source, zlib.decompressobj(GZIP), b"", False

    def more(self) -> bool:
        while not self.over:
            rest = self.unpacker.unconsumed_tail or self.source.read(PIECE)
            if self.unpacker.eof:
                rest = self.unpacker.unused_data or rest
                if rest:
                    self.unpacker = zlib.decompressobj(GZIP)
            if not rest:
                self.over = True
                return False
            got = self.unpacker.decompress(rest, PIECE)
            if got:
                self.held += got
                return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        """What comes up to and with ``mark``; None at the end."""
        at, seen = self.held.find(mark), 0
        while at < 0:
            seen = max(0, len(self.held) - len(mark))
            if not self.more():
                return None
            at = self.held.find(mark, seen)
        cut, self.held = self.held[: at + len(mark)], self.held[at + len(mark) :]
        return cut

    def pieces(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes."""
        while n:
            if not self.held and not self.more():
                raise EOFError("the archive ends inside a record")
            cut, self.held = self.held[:n], self.held[n:]
            n -= len(cut)
            yield cut


def header_fields(header: bytes) -> dict[str, str]:
    lines = header.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


def normalise_archive(fs: pafs.FileSystem, source: str, target: str) -> list[dict]:
    """Rewrite the archive ``source`` with a gzip member of its own for each record, and write the sidecar ``target``.idx.

    The source is inflated once, whatever its members are. Returns the index: offset and length of each member.
    """
    index, offset, tried = [], 0, f"{target}.{uuid.uuid4().hex}"
    with fs.open_input_stream(source, compression=None) as raw, fs.open_output_stream(tried, compression=None) as out:
        stream = Inflating(raw)
        while (header := stream.until(b"\r\n\r\n")) is not None:
            fields = header_fields(header.lstrip(b"\r\n"))
            packer = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
            start = offset
            offset += out.write(packer.compress(header.lstrip(b"\r\n"))) or 0
            for piece in stream.pieces(int(fields["content-length"]) + 4):
                offset += out.write(packer.compress(piece)) or 0
            offset += out.write(packer.flush()) or 0
            index.append({"offset": start, "length": offset - start, "record_id": fields.get("warc-record-id"), "record_type": fields.get("warc-type"), "uri": fields.get("warc-target-uri"), "digest": fields.get("warc-payload-digest")})
    fs.move(tried, target)
    with fs.open_output_stream(f"{tried}.idx", compression=None) as out:
        for row in index:
            out.write(json.dumps(row, ensure_ascii=False).encode() + b"\n")
    fs.move(f"{tried}.idx", f"{target}.idx")
    return index


#: Types of page ids that a header can carry.
ID_TYPES = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "long": pa.int64(), "bigint": pa.int64(), "string": pa.string()}
INDEX_SCHEMA = "archive string, record_no long, offset long, length long, record_id string, record_type string, uri string, digest string"


def normalise_archives(manifest: DataFrame, folder: str, delete_source: bool = True) -> DataFrame:
    """Normalise every archive of the manifest; the index table (also beside each archive as a sidecar of JSON lines)."""
    n = max(1, manifest.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                target = "records-" + name.removeprefix("pages-")
                rows = normalise_archive(fs, f"{root}/{name}", f"{root}/{target}")
                for i in range(0, len(rows), 5000):
                    yield pa.RecordBatch.from_pylist([{"archive": target, "record_no": i + k, **r} for k, r in enumerate(rows[i : i + 5000])], pa.schema([(c, pa.int64() if k == "long" else pa.string()) for c, k in (x.split() for x in INDEX_SCHEMA.split(", "))]))

    index = materialize(manifest.select("archive").repartition(n).mapInArrow(run, INDEX_SCHEMA), "warc-index")
    if delete_source:  # the index is complete, so no task will read the streams again
        def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, root = pafs.FileSystem.from_uri(folder)
            for batch in batches:
                for name in batch.column(0).to_pylist():
                    if fs.get_file_info(f"{root}/{name}").type != pafs.FileType.NotFound:
                        fs.delete_file(f"{root}/{name}")
            yield from ()

        manifest.select("archive").mapInArrow(remove, "archive string").write.format("noop").mode("overwrite").save()
    return index


def read_records(index: DataFrame, folder: str, keep_payload: bool = False, id_type: str = "long") -> DataFrame:
    """Read each record through the index by its offset, inflating only its own member.

    page_id, url, record_type, payload_bytes, payload_digest, refers_to, and the payload (null for revisits) if asked
    for. A response's size and digest are computed from the payload that was read; a revisit's are those in its header.
    ``id_type``: that of the page ids, an integer type or string.
    """
    if id_type not in ID_TYPES:
        raise ValueError(f"page ids are integers or strings, not {id_type}")
    bounded_batches(index.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        name, file = None, None
        for batch in batches:
            rows = []
            for archive, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if archive != name:
                    if file:
                        file.close()
                    name, file = archive, fs.open_input_file(f"{root}/{archive}")
                file.seek(offset)
                stream = Inflating(_Part(file, length))
                fields = header_fields(stream.until(b"\r\n\r\n"))
                http = stream.until(b"\r\n\r\n")
                size = int(header_fields(http)["content-length"])
                digest = fields["warc-payload-digest"].removeprefix("sha256:")
                kept = None
                if fields["warc-type"] == "response":
                    sha, size, parts = hashlib.sha256(), 0, []
                    for piece in stream.pieces(int(fields["content-length"]) - len(http)):
                        sha.update(piece)
                        size += len(piece)
                        if keep_payload:
                            parts.append(piece)
                    digest, kept = sha.hexdigest(), b"".join(parts) if keep_payload else None
                as_id = lambda v: None if v is None else json.loads(v)
                rows.append((as_id(fields.get("x-page-id")), fields.get("warc-target-uri"), fields["warc-type"], size, digest, as_id(fields.get("x-refers-to-page")), kept))
            columns = list(zip(*rows)) if rows else [()] * 7
            kinds = [ID_TYPES[id_type], pa.string(), pa.string(), pa.int64(), pa.string(), ID_TYPES[id_type], pa.binary()]
            names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
        if file:
            file.close()

    schema = f"page_id {id_type}, url string, record_type string, payload_bytes long, payload_digest string, refers_to {id_type}, payload binary"
    read = index.select("archive", "offset", "length").mapInArrow(run, schema)
    return read if keep_payload else read.drop("payload")


class _Part:
    """The next ``left`` bytes of an open file."""

    def __init__(self, file, left: int):
        self.file, self.left = file, left

    def read(self, n: int) -> bytes:
        got = self.file.read(min(n, self.left))
        self.left -= len(got)
        return got


def archive_pages(pages: DataFrame, folder: str | None = None, **columns) -> tuple[DataFrame, str]:
    """Write, normalise and index ``pages``; the index and the folder. An empty table makes no archive."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    manifest = write_monolithic(with_roles(pages, **columns), folder)
    return normalise_archives(manifest, folder), folder
