"""WARC archives from and to a chunked record table.

A record of any size is a run of rows (record, chunk, data) of at most ``CHUNK_BYTES`` each. Every
row carries the SHA-1 digest and the size of the payload up to its end, so the last row of a
record has the digest of the whole, and no step after the first needs the payload in one piece.

Writing: payloads are cut into chunks; of records with equal payloads (digest and size) that with
the largest page_id becomes a response, the others revisits that refer to it. Decisions are narrow
rows that meet the chunks by record, so copies of one payload, however many, are spread like all
other records. Chunk rows are sorted by record and chunk and written by Spark's text writer, one
row a WARC record: the first chunk of a response is the response itself, further chunks are
continuation records with their segment number, as the format has it for large records. Each row
ends with an empty line, which is the writer's line separator, so files are plain gzipped WARC
wherever Spark can write, and a lost task leaves nothing behind.

Reading: a gzipped file is one task, which streams its lines through a small state machine. Sizes
come from Content-Length alone, so payloads may hold anything, line breaks and WARC headers
included. Chunk rows come out again, digests carried through the segments of a record, and each
response's digest is held against the one its header declares (``intact``).

Defined cases: a null payload is empty; a null page_id or url has no header line and comes back
null, and a null page_id is the response only among null ones; repeated rows are records of their
own; equal page_ids of equal payloads are settled by the order of the input; empty tables give no
records; other columns are ignored. ``pages`` must be a scan or a stored table, so that a task
that runs again numbers the same rows alike.
"""

import base64
import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from pricemill.llm.common import stored
from pricemill.session import scratch_path

CHUNK_BYTES = 1 << 16
BATCH_BYTES = 1 << 22
DATE = "1970-01-01T00:00:00Z"
# Fixed values of the format
VERSION = "WARC/1.1"
LINE = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "urn:page-record:"

CHUNKS = "record long, page_id long, url string, chunk int, last boolean, data binary," \
         " bytes long, digest string"
READ = "record string, page_id long, url string, record_type string, refers_to long, chunk int," \
       " last boolean, data binary, bytes long, digest string, intact boolean"


def base32(hasher):
    return base64.b32encode(hasher.digest()).decode()


class RowBuffer:
    """Rows on their way out, as record batches of bounded bytes."""

    def __init__(self, schema, size_of):
        fields = [field.rsplit(" ", 1) for field in schema.split(", ")]
        kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(),
                 "boolean": pa.bool_(), "binary": pa.binary()}
        self.schema = pa.schema([(name.strip(), kinds[kind]) for name, kind in fields])
        self.size_of, self.rows, self.size = size_of, [], 0

    def add(self, row):
        self.rows.append(row)
        self.size += 200 + self.size_of(row)
        if self.size >= BATCH_BYTES:
            yield from self.flush()

    def flush(self):
        if self.rows:
            columns = zip(*self.rows)
            yield pa.record_batch(
                [pa.array(c, f.type) for c, f in zip(columns, self.schema)], schema=self.schema
            )
        self.rows, self.size = [], 0


def cut(data, chunk_bytes=CHUNK_BYTES):
    """(piece, last) of bytes in UTF-8; no piece ends inside a character."""
    view, at = memoryview(data), 0
    while len(view) - at > chunk_bytes:
        end = at + chunk_bytes
        while end > at + 1 and view[end] & 0xC0 == 0x80:
            end -= 1
        yield bytes(view[at:end]), False
        at = end
    yield bytes(view[at:]), True


def chunked(pages, payload="html", chunk_bytes=CHUNK_BYTES):
    """The chunked record table of ``pages``: digests and sizes so far, whole in the last row."""

    def chunk(batches):
        record = TaskContext.get().partitionId() << 33
        out = RowBuffer(CHUNKS, lambda row: len(row[5]))
        for batch in batches:
            for page, url, text in zip(*(batch.column(i) for i in range(3))):
                hasher, size = hashlib.sha1(), 0
                data = text.as_py()
                data = data.encode() if data else b""
                for i, (piece, last) in enumerate(cut(data, chunk_bytes)):
                    hasher.update(piece)
                    size += len(piece)
                    yield from out.add(
                        (record, page.as_py(), url.as_py(), i, last, piece, size, base32(hasher))
                    )
                record += 1
        yield from out.flush()

    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.col(payload).cast("string").alias("payload"),
    ).mapInArrow(chunk, CHUNKS)


def facts(chunks, least_bytes=0, salts=512):
    """One narrow row a record: total, whole digest, and for a revisit the original and its page_id.

    Groups of equal payloads are added up by (digest, salt) and then by digest; the result goes
    back to the same (digest, salt), so a payload with a third of all records is spread.
    """
    whole = chunks.where("last").select(
        "record", "page_id", F.col("digest").alias("whole_digest"), F.col("bytes").alias("total"),
        F.pmod(F.xxhash64("record"), F.lit(salts)).cast("int").alias("salt"),
    )
    whole = stored(whole)
    key = ["whole_digest", "total"]
    own = F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", "record")
    parts = whole.where(F.col("total") >= least_bytes).groupBy(*key, "salt").agg(
        F.max(own).alias("part")
    )
    best = parts.groupBy(*key).agg(F.max("part").alias("best"))
    spread = parts.select(*key, "salt").join(best, key)
    original = F.col("best.record")
    repeats = original.isNotNull() & (original != F.col("record"))
    return whole.join(spread, [*key, "salt"], "left").select(
        "record", "whole_digest", "total",
        F.when(repeats, original).alias("original"),
        F.when(repeats, F.col("best.page_id")).alias("refers_to"),
    )


def _header(name, value):
    return F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(LINE))


def _if_known(name, value):
    return F.coalesce(_header(name, value), F.lit(""))


def record_text(date=DATE):
    """One WARC record without its last line end, from a chunk row and its record's facts."""
    data = F.col("data").cast("string")
    revisit = F.col("original").isNotNull()
    http = F.concat(
        F.lit(LINE.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", ""])),
        _header("Content-Length", F.col("total")), F.lit(LINE),
    )
    urn = F.concat(F.lit(f"<{RECORD_ID}"), F.col("record").cast("string"))
    # a line break in a url would end its header line
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    common = F.concat(
        _header("WARC-Date", F.lit(date)), _if_known("WARC-Target-URI", url),
        _if_known("Page-ID", F.col("page_id")),
    )
    declared = F.concat(
        F.lit(f"Content-Type: application/http;msgtype=response{LINE}"),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("whole_digest"))),
    )

    def record(kind, own, block):
        return F.concat(
            F.lit(f"{VERSION}{LINE}WARC-Type: {kind}{LINE}"), *own, common,
            _header("Content-Length", F.octet_length(block)), F.lit(LINE), block, F.lit(LINE),
        )

    name = _header("WARC-Record-ID", F.concat(urn, F.lit(">")))
    first_of_many = F.when(~F.col("last"), F.lit(f"WARC-Segment-Number: 1{LINE}")).otherwise("")
    response = record("response", [name, declared, first_of_many], F.concat(http, data))
    further = record(
        "continuation",
        [
            _header("WARC-Record-ID", F.concat(urn, F.lit("-"), F.col("chunk").cast("string"), F.lit(">"))),
            _header("WARC-Segment-Origin-ID", F.concat(urn, F.lit(">"))),
            _header("WARC-Segment-Number", F.col("chunk") + 1),
            F.when(
                F.col("last"),
                _header("WARC-Segment-Total-Length", F.octet_length(http) + F.col("total")),
            ).otherwise(""),
        ],
        data,
    )
    again = record(
        "revisit",
        [
            name, declared, F.lit(f"WARC-Profile: {PROFILE}{LINE}"),
            _header("WARC-Refers-To", F.concat(
                F.lit(f"<{RECORD_ID}"), F.col("original").cast("string"), F.lit(">"))),
            _if_known("Refers-To-Page-ID", F.col("refers_to")),
        ],
        http,
    )
    return F.when(revisit, again).when(F.col("chunk") == 0, response).otherwise(further)


def write_archives(pages, path, payload="html", least_bytes=0, date=DATE, chunk_bytes=CHUNK_BYTES):
    """Write ``pages`` as gzipped WARC files below ``path``."""
    chunks = stored(chunked(pages, payload, chunk_bytes))
    decided = facts(chunks, least_bytes).hint("shuffle_hash")  # narrow; the chunks are streamed by
    records = chunks.join(decided, "record").where(F.col("original").isNull() | F.col("last"))
    records.sortWithinPartitions("record", "chunk").select(
        record_text(date).alias("value")
    ).write.text(path, compression="gzip", lineSep=LINE)


class Reader:
    """Chunk rows from the lines of one archive after the other; lines come without their ends."""

    def __init__(self, out, chunk_bytes=CHUNK_BYTES, with_data=True):
        self.out, self.chunk_bytes, self.with_data = out, chunk_bytes, with_data
        self.record = None  # headers of the record whose segments are read
        self.file_ends()

    def file_ends(self):
        """Whatever is open is a record cut short."""
        rows = list(self.finish()) if self.record else []
        self.state, self.headers, self.left, self.http = "between", {}, 0, False
        return rows

    def line(self, line):
        if self.state == "block":
            yield from self.block(line)
        elif self.state == "headers":
            if line:
                name, _, value = line.decode(errors="replace").partition(":")
                self.headers[name.lower()] = value.removeprefix(" ")
            else:
                yield from self.begin()
        elif line.startswith(b"WARC/"):
            self.state, self.headers = "headers", {}

    def begin(self):
        """All header lines of a record, or of a segment of the record at hand, are there."""
        of = self.headers
        kind = of.get("warc-type", "")
        self.left = int(of.get("content-length") or 0)
        self.state = "block"
        mine = self.record and of.get("warc-segment-origin-id") == self.record["warc-record-id"]
        self.skip = not (mine if kind == "continuation" else kind in ("response", "revisit"))
        if self.skip:
            self.http = False
        elif kind == "continuation":
            self.more = "warc-segment-total-length" not in of
        else:
            if self.record:
                yield from self.finish()
            self.record, self.hasher, self.size = of, hashlib.sha1(), 0
            self.more = "warc-segment-number" in of
            self.http = of.get("content-type", "").replace(" ", "").startswith("application/http")
            self.length, self.pending, self.chunk = None, bytearray(), 0
        if not self.left:
            yield from self.end_block()

    def block(self, line):
        size = len(line)
        whole = self.left >= size + 2  # the line's end belongs to the block too
        part = line + b"\r\n" if whole else line[:self.left]
        self.left -= len(part)
        if self.skip:
            pass
        elif self.http:
            if not line:
                self.http = False
            elif line.lower().startswith(b"content-length:"):
                self.length = int(line.split(b":")[1])
        else:
            self.pending += part
            while len(self.pending) > self.chunk_bytes:
                piece = bytes(self.pending[:self.chunk_bytes])
                del self.pending[:self.chunk_bytes]
                yield from self.give(piece, False)
        if not self.left:
            yield from self.end_block()

    def end_block(self):
        self.state = "between"
        if not self.skip and not self.more:
            yield from self.finish(whole=True)

    def finish(self, whole=False):
        """The last chunk row of the record, or the only one of a revisit."""
        piece, self.pending = bytes(self.pending), bytearray()
        yield from self.give(piece, True, whole)
        self.record = None

    def give(self, piece, last, whole=True):
        of = self.record
        declared = of.get("warc-payload-digest", "").removeprefix("sha1:") or None
        page, refers = of.get("page-id"), of.get("refers-to-page-id")
        self.size += len(piece)
        self.hasher.update(piece)
        size, digest, intact = self.size, base32(self.hasher), None
        if of["warc-type"] == "revisit":
            size, digest = self.length, declared
        elif last:
            intact = whole and digest == (declared or digest)
        yield from self.out.add((
            of["warc-record-id"].strip("<>"), page and int(page), of.get("warc-target-uri"),
            of["warc-type"], refers and int(refers), self.chunk, last,
            piece if self.with_data else None, size, digest, intact,
        ))
        self.chunk += 1


def read_archives(spark, path, with_data=True, chunk_bytes=CHUNK_BYTES):
    """The chunk rows of the responses and revisits in the WARC files below ``path``.

    ``data`` is null if not asked for. A record cut short, or one whose payload has another digest
    than its header says, comes with ``intact`` false; other kinds of records are passed over.
    """
    lines = spark.read.option("lineSep", LINE).text(path).select(
        F.xxhash64(F.input_file_name()).alias("file"), F.col("value").cast("binary").alias("line")
    )

    def parse(batches):
        out = RowBuffer(READ, lambda row: len(row[7] or b""))
        reader, file = Reader(out, chunk_bytes, with_data), None
        for batch in batches:
            for at, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if at != file:
                    yield from reader.file_ends()
                    file = at
                yield from reader.line(line)
        yield from reader.file_ends()
        yield from out.flush()

    return lines.mapInArrow(parse, READ)


def archived(pages, payload="html", least_bytes=0):
    """Write ``pages`` to archives in the shared folder and read every record back."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, payload, least_bytes)
    return read_archives(spark, path, with_data=False).where("last").select(
        "page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        "record_type", "refers_to", "intact",
    )
