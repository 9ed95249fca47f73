"""WARC as chunked record tables.

An archive is a byte stream of WARC/1.1 records, kept as rows (archive, chunk, data)
of at most ``CHUNK`` bytes, so that any store that Spark reads holds it and no row
grows with a payload.  The writer cuts records into the stream; the reader parses
the stream chunk by chunk, carrying header text, the count of payload bytes still
due and a running SHA-256, and gives rows (record_id, chunk, payload, size and
digest so far): memory follows the chunk, not the record.  Records are
gzip members of their own, as usual, inflated piece by piece.  Archives close at the
first record end after ``ARCHIVE`` bytes.

Of records with equal payloads of 100 bytes or more the one with the smallest id is
a response; the others are revisits that refer to it and carry no payload.

Defined cases: an id of any characters, empty or not, is percent-encoded in its record's
name, and a null one has a name of its own; a null payload is empty; a null or repeated id
is written as often as it comes (of repeated smallest ids one row is the response; a null
id counts after all others, and rows with equal payloads without any id are all responses,
as nothing could refer to one); an empty table gives no archive; payloads of any length
are written and read in chunks; extra columns are not written, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from concord.llm.store import materialize

CHUNK, ARCHIVE = 256 << 10, 16 << 20
REVISIT_BYTES = 100
BROADCAST_ROWS = 200_000
ID_PREFIX, NULL_ID, PROFILE = "urn:record:", "urn:no-id", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def planned(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, payload binary, digest, refers_to, revisit) of every row."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    large = rows.where(F.length("payload") >= least).groupBy("digest", "page_id").agg(F.count(F.lit(1)).alias("n"))
    first = large.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.sum("n").alias("n"), F.min_by("n", "page_id").alias("leads")).where("n > 1").drop("n")
    # payloads aren't shuffled for this where few are repeated
    first = materialize(first, "repeated")
    count, tied = first.agg(F.count(F.lit(1)), F.coalesce(F.max("leads"), F.lit(0))).first()
    out = rows.join(F.broadcast(first) if count <= BROADCAST_ROWS else first, "digest", "left")
    lead = F.col("first_id").isNull() | (F.length("payload") < least) | F.coalesce(F.col("page_id") == F.col("first_id"), F.lit(False))
    out = out.withColumn("revisit", ~lead)
    if tied > 1:  # rows that share the smallest id too: one of them is the response
        shared = F.coalesce(~F.col("revisit") & (F.col("leads") > 1) & (F.length("payload") >= least), F.lit(False))
        again = F.row_number().over(W.partitionBy("digest", "page_id").orderBy("url")) > 1
        out = out.where(~shared).unionByName(out.where(shared).withColumn("revisit", again))
    return out.select("page_id", "url", "payload", "digest", F.when(F.col("revisit"), F.col("first_id")).alias("refers_to"), "revisit")


def record_name(page_id) -> str:
    return f"<{NULL_ID}>" if page_id is None else f"<{ID_PREFIX}{quote(str(page_id), safe='')}>"


def record_id(name: str | None) -> str | None:
    """The id in a record's name."""
    name = (name or "").strip("<>")
    return unquote(name.removeprefix(ID_PREFIX)) if name.startswith(ID_PREFIX) else None


def record_header(page_id, url, digest, refers_to, revisit, size: int) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_name(page_id)}", f"WARC-Date: {DATE}"]
    lines += [f"WARC-Target-URI: {''.join(url.split())}"] if url is not None else []
    lines += [f"WARC-Refers-To: {record_name(refers_to)}", f"WARC-Profile: {PROFILE}"] if revisit else []
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/octet-stream", f"Content-Length: {size}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def write_chunks(batches, chunk: int = CHUNK, archive: int = ARCHIVE):
    """Rows (archive, chunk, data) from rows (page_id, url, payload, digest, refers_to, revisit)."""
    from pyspark import TaskContext

    part, number, index, written, waiting = TaskContext.get().partitionId(), 0, 0, 0, bytearray()

    def row(data):
        return pa.RecordBatch.from_arrays([pa.array([part << 32 | number], pa.int64()), pa.array([index], pa.int64()), pa.array([bytes(data)], pa.binary())], names=["archive", "chunk", "data"])

    for batch in batches:
        for i in range(batch.num_rows):
            page_id, url, digest, refers_to, revisit = (batch.column(k)[i].as_py() for k in (0, 1, 3, 4, 5))
            body = memoryview(b"" if revisit else batch.column(2)[i].as_buffer())
            gzip = zlib.compressobj(1, wbits=31)
            pieces = (record_header(page_id, url, digest, refers_to, revisit, len(body)), *(body[k : k + chunk] for k in range(0, len(body), chunk)), b"\r\n\r\n")
            for k, piece in enumerate(pieces):
                waiting += gzip.compress(piece)
                if k == len(pieces) - 1:
                    waiting += gzip.flush()
                while len(waiting) >= chunk:
                    yield row(waiting[:chunk])
                    index, written, waiting = index + 1, written + chunk, waiting[chunk:]
            if written + len(waiting) >= archive:
                if waiting:
                    yield row(waiting)
                number, index, written, waiting = number + 1, 0, 0, bytearray()
    if waiting:
        yield row(waiting)


def write_archives(rows: DataFrame, name: str = "warc") -> DataFrame:
    """Archives of ``planned`` rows in the shared folder, read back as (archive, chunk, data)."""
    return materialize(rows.mapInArrow(write_chunks, "archive long, chunk long, data binary"), name)


def inflated(state: list, data, most: int = CHUNK):
    """Pieces of at most ``most`` bytes of successive gzip members; ``state`` holds the open member between calls."""
    while len(data):
        if not state:
            state.append(zlib.decompressobj(wbits=31))
        yield state[0].decompress(data, most)
        data = state[0].unconsumed_tail or state[0].unused_data
        if state[0].eof:
            state.clear()


class Parser:
    """Records from successive pieces of a WARC stream."""

    def __init__(self):
        self.member: list = []
        self.text, self.header, self.due, self.tail = bytearray(), None, 0, 0

    def read(self, data):
        """``feed`` over compressed data."""
        for piece in inflated(self.member, data):
            yield from self.feed(piece)

    def feed(self, data):
        """Yields (header, chunk number, payload piece, size so far, SHA-256 so far, whether the record ends)."""
        at, view = 0, memoryview(data)
        while at < len(view) or (self.header is not None and self.due == 0 and self.tail == 0):
            if self.header is None:
                if self.tail:  # the blank lines after a record
                    step = min(self.tail, len(view) - at)
                    if bytes(view[at : at + step]).strip(b"\r\n"):
                        raise ValueError("a WARC record doesn't end where its Content-Length says")
                    at, self.tail = at + step, self.tail - step
                    continue
                known = len(self.text)
                self.text += view[at:]
                end = self.text.find(b"\r\n\r\n", max(0, known - 3))
                if end < 0:
                    return
                lines = bytes(self.text[:end]).decode().split("\r\n")
                if not lines[0].startswith("WARC/"):
                    raise ValueError(f"no WARC record: {lines[0][:40]!r}")
                self.header = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
                at += end + 4 - known
                self.text = bytearray()
                self.due, self.size, self.number, self.digest = int(self.header["content-length"]), 0, 0, hashlib.sha256()
            piece = view[at : at + self.due]
            at, self.due, self.size = at + len(piece), self.due - len(piece), self.size + len(piece)
            self.digest.update(piece)
            if piece or self.due == 0:
                yield self.header, self.number, piece, self.size, self.digest.hexdigest(), self.due == 0
                self.number += 1
            if self.due == 0:
                self.header, self.tail = None, 4
            elif at >= len(view):
                return


RECORDS = "archive long, record long, record_id string, record_type string, target_uri string, refers_to string, payload_digest string, chunk long, payload binary, bytes_so_far long, digest_so_far string, last boolean"


def parse_chunks(keep_payload: bool, only_last: bool):
    """Function over sorted (archive, chunk, data) rows that gives rows of RECORDS."""
    names = [x.split()[0] for x in RECORDS.split(", ")]
    types = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}[x.split()[1]] for x in RECORDS.split(", ")]

    def parse(batches):
        archive, parser, record = None, None, 0
        for batch in batches:
            for i in range(batch.num_rows):
                if (own := batch.column(0)[i].as_py()) != archive:
                    archive, parser, record = own, Parser(), 0
                rows = []
                for header, number, piece, size, digest, last in parser.read(batch.column(2)[i].as_buffer()):
                    if last or not only_last:
                        said = header.get("warc-payload-digest", "").partition(":")[2] or None
                        rows.append((archive, record, record_id(header.get("warc-record-id")), header.get("warc-type"), header.get("warc-target-uri"), record_id(header.get("warc-refers-to")), said, number, bytes(piece) if keep_payload else None, size, digest, last))
                    record += last
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return parse


def record_chunks(archives: DataFrame, keep_payload: bool = True, only_last: bool = False) -> DataFrame:
    """The chunked record table (RECORDS) of archives (archive, chunk, data); ``only_last``: each record's last row."""
    number = max(archives.select("archive").distinct().count(), 1)  # about one archive a task, whatever their number
    ordered = archives.repartition(number, "archive").sortWithinPartitions("archive", "chunk")
    return ordered.mapInArrow(parse_chunks(keep_payload, only_last), RECORDS)


def archived(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), read back from the archives written of ``pages``."""
    kind = pages.schema["page_id"].dataType.simpleString()
    back = materialize(record_chunks(write_archives(planned(pages)), False, True).select("record_id", "record_type", "refers_to", F.col("bytes_so_far").alias("size"), F.col("digest_so_far").alias("digest"), "payload_digest"), "records")
    typed = lambda c: F.col(c).cast(kind)
    responses = back.where("record_type = 'response'")
    revisits = back.where("record_type = 'revisit'")
    # what a revisit says of its payload is what its response holds
    held = responses.select(F.col("record_id").alias("refers_to"), F.col("digest").alias("payload_digest"), F.col("size").alias("full")).distinct()
    full = revisits.join(held, ["refers_to", "payload_digest"])
    out = responses.select(typed("record_id").alias("page_id"), F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.lit(None).cast(kind).alias("refers_to"))
    return out.unionByName(full.select(typed("record_id").alias("page_id"), F.col("full").alias("payload_bytes"), "payload_digest", "record_type", typed("refers_to").alias("refers_to")))
