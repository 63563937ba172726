"""WARC 1.1 archives compressed record by record with an embedded dictionary.

An archive begins with a skippable frame that holds a Zstandard dictionary, built from the
first records of that archive; then each record is a frame of its own, so any record can be
read from its offset alone. A record's block is an HTTP message with the payload as its body.
Records whose payload (of at least ``LEAST_BYTES``) occurred in a record with a smaller id are
revisits: they name it and carry the message's head alone. A task begins a new archive where
one has grown to ``ARCHIVE_BYTES``.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from datetime import UTC, datetime
from itertools import chain

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerwatch.llm.common import file_system, per_row_task, shared_folder, text_of, unique_name
from ledgerwatch.session import materialise, require_columns

#: Magic number of the skippable frame for dictionaries, and bounds of the dictionary and its sample.
SKIPPABLE = 0x184D2A5D
DICTIONARY_BYTES, SAMPLE_BYTES, SAMPLE_RECORDS = 112 << 10, 8 << 20, 4000
LEAST_BYTES = 100
LEVEL = 6
#: Stored bytes at which an archive ends, and pages with one payload that one task joins at most.
ARCHIVE_BYTES, HOT_ROWS = 1 << 30, 1_000_000
#: Rows that a task turns into Python values together.
TOGETHER = 64
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "name string, records long, plain_bytes long, stored_bytes long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def record(page_id, url: str, digest: str, n_bytes: int, refers_to, payload: bytes, name: str = "", date: str = "", refers_url: str = "") -> bytes:
    """One record: headers, an empty line, an HTTP message (its head alone for a revisit), two empty lines.

    ``name`` tells it from all other records, ``date`` is the time of its capture; both have
    values of their own where they are not given.
    """
    date = date or _time(None)
    revisit = refers_to is not None
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{name or uuid.uuid4()}>",
             f"WARC-Date: {date}", f"WARC-Target-URI: {_one_line(url)}", f"WARC-Payload-Digest: sha256:{digest}"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To-Target-URI: {_one_line(refers_url)}", f"WARC-Refers-To-Date: {date}",
                  f"X-Refers-To-Page-ID: {refers_to}"]
    body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode() + (b"" if revisit else payload)
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(lines).encode() + body + b"\r\n\r\n"


def _time(at: datetime | None) -> str:
    """A time as WARC writes it; now if there is none."""
    return (at or datetime.now(UTC)).astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def _one_line(url: str) -> str:
    """A URL with line ends and per cent signs escaped, so that it stays one header."""
    return url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])


def parsed(raw: bytes) -> dict:
    """Headers and payload of a record; checks the payload of a response against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = _fields(head)
    http, _, body = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    digest, n_bytes = fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(_fields(http)["Content-Length"])
    if fields["WARC-Type"] != "revisit" and (hashlib.sha256(body).hexdigest() != digest or len(body) != n_bytes):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't match its digest")
    page, refers = (fields.get(k) for k in ("X-Page-ID", "X-Refers-To-Page-ID"))
    url = fields["WARC-Target-URI"].replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    return {"page_id": int(page) if page else None, "url": url, "payload_bytes": n_bytes, "payload_digest": digest,
            "record_type": fields["WARC-Type"], "refers_to": int(refers) if refers else None, "payload": body}


def dictionary(records: list[bytes]) -> bytes:
    """A dictionary from sample records, of at most a tenth of their size; empty if they are too few to learn from."""
    size = min(DICTIONARY_BYTES, sum(map(len, records)) // 10)
    if len(records) < 8 or size < 1024:
        return b""
    try:
        return zstandard.train_dictionary(size, records, threads=0).as_bytes()
    except zstandard.ZstdError:  # too little in common
        return b""


def write_archive(out, records, limit: int | None = None) -> tuple[int, int, int]:
    """Write records to a binary stream until they end, or ``limit`` stored bytes are reached (by the dictionary's sample at
    the earliest); holds only that sample. Gives records, plain and stored bytes."""
    held, size, packer, n, plain, stored = [], 0, None, 0, 0, 0

    def begin():
        raw = dictionary(held)
        out.write(struct.pack("<II", SKIPPABLE, len(raw)) + raw)
        known = zstandard.ZstdCompressionDict(raw) if raw else None
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=True), 8 + len(raw)

    def put(raw: bytes):
        frame = packer.compress(raw)
        out.write(frame)
        return len(frame)

    for raw in records:
        n, plain = n + 1, plain + len(raw)
        if packer is None:
            held.append(raw)
            size += len(raw)
            if size < SAMPLE_BYTES and len(held) < SAMPLE_RECORDS:
                continue
            packer, stored = begin()
            stored += sum(put(x) for x in held)
            held = []
        else:
            stored += put(raw)
        if limit is not None and stored >= limit:
            return n, plain, stored
    if packer is None:
        packer, stored = begin()
        stored += sum(put(x) for x in held)
    return n, plain, stored


def read_archive(stream):
    """Records of an archive, one after the other; holds one record and a read buffer."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != SKIPPABLE:
        raise ValueError("an archive must begin with its dictionary's frame")
    raw = stream.read(size)
    known = zstandard.ZstdCompressionDict(raw) if raw else None
    unpacker = zstandard.ZstdDecompressor(dict_data=known)
    rest = b""
    while True:
        frame, parts = unpacker.decompressobj(), []
        while not frame.eof:
            if not rest and not (rest := stream.read(1 << 16)):
                if parts or frame.unused_data:
                    raise ValueError("the archive ends inside a record")
                return
            parts.append(frame.decompress(rest))
            rest = frame.unused_data if frame.eof else b""
        yield b"".join(parts)


def revisits(pages: DataFrame, id_col: str, url_col: str, html_col: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``page_id, digest, refers_to, refers_url`` of pages whose payload a page with a smaller id has too.

    Works on ids, URLs and digests alone, stored once. The first ids are partly aggregated
    before the shuffle, and only payloads that occur twice are joined again. A payload with more
    than ``hot_rows`` pages is dealt over slices; as each has that many rows, there are at most
    rows / ``hot_rows`` of them, which bounds what is broadcast (40 bytes each).
    """
    small = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), text_of(url_col).alias("url"), text_of(html_col).cast("binary").alias("b"))
    small = small.filter("page_id is not null").filter(F.length("b") >= LEAST_BYTES).select("page_id", "url", F.sha2("b", 256).alias("digest"))
    small = materialise(small, "warc-digests")
    first = small.groupBy("digest").agg(F.min(F.struct("page_id", "url")).alias("first"), F.max("page_id").alias("last"), F.count("*").alias("rows"))
    first = first.filter("last > first.page_id").select("digest", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_url"),
                                                        F.ceil(F.col("rows") / hot_rows).cast("long").alias("slices"))
    first = materialise(first, "warc-first")
    hot = F.broadcast(first.filter("slices > 1").select("digest", "slices"))
    dealt = small.join(hot, "digest", "left").select("page_id", "digest", F.pmod(F.xxhash64("page_id"), F.coalesce("slices", F.lit(1).cast("long"))).alias("slice"))
    heads = first.select("digest", "refers_to", "refers_url", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"))
    return dealt.join(heads, ["digest", "slice"]).filter("page_id > refers_to").drop("slice").distinct()


def write(pages: DataFrame, id_col: str, url_col: str, html_col: str, folder: str, date: datetime | None = None,
          archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write archives of about ``archive_bytes``; the manifest has a row per archive: name, records, plain and stored bytes.

    ``date`` is the time of capture; without it, the time of this call. Null payloads and URLs
    are empty. A page without an id is a response without a page id. Repeated pages each have a
    record with an id of its own; those with the smallest page id of their payload are all
    responses. Only the three columns are read, so others may have any name. An empty table
    gives no archive.
    """
    require_columns(pages, id_col, url_col, html_col)
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), text_of(url_col).alias("url"), text_of(html_col).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    rows = rows.join(revisits(pages, id_col, url_col, html_col), ["page_id", "digest"], "left")
    when = _time(date)

    def run(batches):
        def records():
            for batch in batches:
                for at in range(0, batch.num_rows, TOGETHER):
                    part = batch.slice(at, TOGETHER)
                    for page_id, digest, url, payload, refers, refers_url in zip(*(c.to_pylist() for c in part.columns)):
                        yield record(page_id, url, digest, len(payload), refers, payload, str(uuid.uuid4()), when, refers_url)

        source = records()
        system, inner = file_system(folder)
        while (first := next(source, None)) is not None:
            name = unique_name(TaskContext.get().partitionId(), ".warc.zst")
            with system.open_output_stream(f"{inner}/{name}") as out:
                n, plain, stored = write_archive(out, chain([first], source), archive_bytes)
            yield pa.RecordBatch.from_pydict({"name": [name], "records": [n], "plain_bytes": [plain], "stored_bytes": [stored]})

    return rows.select("page_id", "digest", "url", "payload", "refers_to", "refers_url").mapInArrow(run, MANIFEST)


def read(spark: SparkSession, folder: str, manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the archives that the manifest names; each archive in a task of its own."""
    names = sorted(r.name for r in manifest.select("name").collect())  # a row per archive
    schema = RECORD if payloads else RECORD.rpartition(", ")[0]
    if not names:
        return spark.createDataFrame([], schema)
    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(),
             "record_type": pa.string(), "refers_to": pa.int64()} | ({"payload": pa.binary()} if payloads else {})

    def run(name):
        system, inner = file_system(folder)
        with system.open_input_stream(f"{inner}/{name}") as stream:
            held, size = [], 0
            for raw in read_archive(stream):
                held.append(parsed(raw))
                size += len(raw) if payloads else 200
                if size > 4 << 20:
                    yield _batch(held, kinds)
                    held, size = [], 0
            if held:
                yield _batch(held, kinds)

    return per_row_task(spark, names, run, schema)


def _batch(rows: list[dict], kinds: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], list(kinds))


def round_trip(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Write archives below the shared folder and read all records back, without payloads."""
    spark = pages.sparkSession
    folder = shared_folder(spark, "warc")
    return read(spark, folder, materialise(write(pages, id_col, url_col, html_col, folder), "warc-manifest"), payloads=False)
