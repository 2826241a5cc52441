"""WARC archives with Zstandard compression under a dictionary.

Each archive begins with a skippable frame that holds the dictionary, and every record is a frame of its own, so
that a record can be read alone (IIPC, "Zstandard compression in WARC files"). Equal payloads are stored once;
the other records revisit that one.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from datetime import datetime, timezone

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanline.llm.common import bounded_sample, keep, shared_dir, table
from gleanline.llm.common import files as files_of

#: Fixed by the format: the magic number of the skippable frame that holds a dictionary.
DICTIONARY_FRAME = 0x184D2A5D
DICTIONARY_BYTES = 1 << 16
#: The dictionary is trained on about so many payloads, chosen by a hash among those up to so many bytes.
SAMPLE = 1000
SAMPLE_BYTES = 1 << 16
LEVEL = 3
#: Payloads below this many bytes are stored each time.
LEAST_REVISIT = 1000
_BREAK = re.compile(rb"[\x00-\x20\x7f]+")


def with_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """pages (page_id, url, html) with payload_bytes, payload_digest and refers_to.

    Of rows with equal payloads of at least least bytes the greatest page_id is the response (null: refers_to is
    null), and the others name it. Rows that share that page_id are all responses. Only keys and digests are
    grouped; the pages themselves are shuffled once, and adaptive execution splits a payload that is very common.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    own = pages.select("page_id", "url", "html", F.octet_length(body).cast("long").alias("payload_bytes"), F.sha1(body).alias("payload_digest"))
    same = own.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    same = keep(same.where("n > 1").select("payload_digest", "first"))
    out = own.join(same, "payload_digest", "left")
    return out.withColumn("refers_to", F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("first")), F.col("first"))).drop("first")


def train(pages: DataFrame, size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from a bounded sample of the archived payloads; empty if they are too few to train on."""
    own = pages.select("html").where(F.octet_length("html").between(1, SAMPLE_BYTES))
    samples = sorted(r["html"].encode("utf-8", "replace") for r in bounded_sample(own, min(1.0, SAMPLE / max(own.count(), 1)), 2 * SAMPLE).collect())
    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if len(samples) > 7 else b""
    except zstandard.ZstdError:  # the library's word for too little to learn from
        return b""


def _header(fields: list[tuple[str, object]]) -> bytes:
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + b"\r\n"


def _name(page_id, nth=None) -> str:
    """A record's id: the page, and a number of its own unless it is what revisits refer to by the page alone."""
    return f"<urn:page:{'' if page_id is None else page_id}{'' if nth is None else f':{nth}'}>"


def record(page_id, url, html, digest: str, size: int, refers_to, nth=None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """A response record, or a revisit without payload that names the record it repeats; nth tells records of one page apart."""
    payload = (html or "").encode("utf-8", "replace")
    target = _BREAK.sub(b"%20", (url or "about:blank").encode()).decode()
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _name(page_id, nth)), ("WARC-Target-URI", target), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload
    if refers_to is not None:
        block = http
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _name(refers_to))]
    return _header([*head, ("Content-Length", len(block))]) + block + b"\r\n\r\n"


def write(pages: DataFrame, folder: str, dictionary: bytes) -> DataFrame:
    """Writes the rows of with_revisits() to archives, one for each task, and returns (path, records, bytes).

    Record ids are the pages' where a page has one row; the rows of a page that repeats, or has no id, get a further
    number of their own, so that ids are unique. The date is that of the call.

    A task attempt writes a file of its own and names it only when it is whole; files of failed attempts are in no
    result. The result is kept, so that it names what was written even if an executor is lost later.
    """

    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches):
        files, path = files_of(folder)
        files.create_dir(path, recursive=True)
        context = TaskContext.get()
        name = f"{path}/part-{context.partitionId():05d}-{context.taskAttemptId()}.warc.zst"
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        n = size = 0
        out = None
        for batch in batches:
            for row in batch.itertuples(index=False):
                if out is None:
                    out = files.open_output_stream(name, compression=None)
                    out.write(struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary)
                page_id, *rest, lone = (None if x is None or x is pd.NA else x for x in row)
                frame = packer.compress(record(page_id, *rest, None if lone else uuid.uuid4().hex, date))
                out.write(frame)
                n, size = n + 1, size + len(frame)
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [name], "records": [n], "bytes": [size]})

    # ids as text: they stay whole numbers beside nulls
    again = keep(pages.groupBy("page_id").agg(F.count("*").alias("n")).where("n > 1 and page_id is not null").select("page_id", F.lit(True).alias("again")))
    rows = pages.join(again, "page_id", "left") if not again.isEmpty() else pages.withColumn("again", F.lit(None).cast("boolean"))
    lone = F.col("page_id").isNotNull() & F.col("again").isNull()
    rows = rows.select(F.col("page_id").cast("string"), "url", "html", "payload_digest", "payload_bytes", F.col("refers_to").cast("string").alias("refers_to"), lone.alias("lone"))
    return keep(rows.mapInPandas(run, "path string, records long, bytes long"))


def frames(stream, chunk: int = 1 << 20):
    """The decompressed records of an archive one by one, with the dictionary of its leading frame."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("no dictionary frame")
    dictionary = stream.read(size)
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    held = b""
    frame, parts = unpacker.decompressobj(), []
    while held or (held := stream.read(chunk)):
        parts.append(frame.decompress(held))
        held = b""
        if frame.eof:
            yield b"".join(parts)
            held, parts, frame = frame.unused_data, [], unpacker.decompressobj()
    if any(parts):
        raise ValueError("the archive ends within a record")


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields of a record, lower-case names, and its payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    fields["http-length"] = re.search(rb"Content-Length: (\d+)", http)[1].decode()
    return fields, payload


def read(archives: DataFrame, folder: str) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload) of every record of the archives.

    Of a response size and digest are those of what is read; of a revisit they are those that its record states.
    """

    def page(name: str | None) -> int | None:
        own = name[len("<urn:page:") : -1].partition(":")[0] if name else ""
        return int(own) if own else None

    def run(batches):
        files, _ = files_of(folder)
        for batch in batches:
            for path in batch["path"]:
                with files.open_input_stream(path, compression=None) as stream:
                    rows, held = [], 0
                    for raw in frames(stream):
                        fields, payload = parse(raw)
                        own = fields["warc-type"] == "response"
                        rows.append((page(fields["warc-record-id"]), fields["warc-target-uri"], fields["warc-type"], len(payload) if own else int(fields["http-length"]), hashlib.sha1(payload).hexdigest() if own else fields["warc-payload-digest"].removeprefix("sha1:"), page(fields.get("warc-refers-to")), payload if own else None))
                        held += len(raw)
                        if held > 1 << 23:
                            yield _frame(rows)
                            rows, held = [], 0
                    if rows:
                        yield _frame(rows)

    return archives.select("path").repartition(max(1, archives.count()), "path").mapInPandas(run, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def _frame(rows) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"])
    return out.assign(page_id=pd.array([r[0] for r in rows], dtype="Int64"), refers_to=pd.array([r[5] for r in rows], dtype="Int64"))


def archive(pages: DataFrame, folder: str) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html) under folder and returns the archives, (path, records, bytes).

    Null html has an empty payload, a null url is about:blank; repeated rows give a record each; an empty table no archive.
    """
    plain = pages.select("page_id", "url", "html")
    return write(with_revisits(plain), folder, train(plain))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of pages, repeated ones and those without page_id too."""
    folder = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    made = archive(table(spark, sf_dir, "pages"), folder)
    return read(made, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
