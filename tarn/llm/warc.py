"""WARC archives written and read as tables of chunks.

A payload over ``CHUNK`` bytes is never one row of an archive: it is written as a segmented record, a ``response`` and its ``continuation`` records, which the
WARC format has for this, and each carries the digest of the payload up to its end. Archives are Spark text files whose line separator is the start of
the next record, so any task can read any split, one row for each segment: record identifier, chunk number and some bytes. Whole records
are hashed where they are read; the chunks of segmented ones meet by record identifier in the order of their numbers and pass a hash one after the other, so no
task holds more of a payload than a batch of chunks.

No segment holds the separator: a payload that has it is cut within it. Records with equal payloads of ``LEAST`` bytes or more are revisits of the
first; equal payloads are found by their SHA-256, first within salts of a digest and then over them, so a payload that a third of all pages have is no hot key.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.common import blobs, materialize, pieces, remove, scratch, shared_root, small_batches

#: Bytes of a payload in one segment, and those from which equal payloads are stored once.
CHUNK, LEAST = 64 << 10, 100
#: Parts of a digest's records that are counted apart before they meet.
SALTS = 64
#: Bytes and rows of one batch of records on their way to an archive.
OUT_BYTES, OUT_ROWS = 4 << 20, 1_000
BREAK = "\r\n\r\n"
#: What one record ends and the next begins with, whichever 1.x version it has.
SEPARATOR = BREAK + "WARC/1."
# Fixed value: the profile of a revisit whose payload is the same.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:tarn:"


def record_id(key: Column, digest: Column) -> Column:
    """An identifier that tells key and payload; a null key has none of its ``k``."""
    return F.concat(F.lit(URN), F.coalesce(F.concat(F.lit("k"), F.url_encode(key.cast("string"))), F.lit("")), F.lit(":"), digest)


def key_of(identifier: Column) -> Column:
    """The key of ``record_id``, as a string."""
    part = F.split_part(F.substring(identifier, len(URN) + 1, 1 << 30), F.lit(":"), F.lit(1))
    return F.when(part.startswith("k"), F.url_decode(F.substring(part, 2, 1 << 30)))


def cuts(body: bytes, size: int) -> list[int]:
    """Ends of a payload's segments of some ``size`` bytes: between characters, and never so that a segment has the separator or makes one with the break before it."""
    ends, at = [], 0
    inside = [m.end() - 4 for m in re.finditer(rb"(?:\A|\r\n)WARC/1\.", body)]
    for stop in [*inside, len(body)]:
        while stop - at > size:
            end = at + size
            while end > at + 1 and body[end] & 0xC0 == 0x80:
                end -= 1
            if body[end : end + 7] == b"WARC/1.":
                end += 3
            ends.append(end)
            at = end
        if stop > at:
            ends.append(stop)
            at = stop
    return ends or [0]


def segments(identifier: str, url: str | None, body: bytes, digest: str, refers_to: str | None, date: str, size: int = CHUNK) -> Iterator[bytes]:
    """The record of a payload, without the break behind each segment."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}{BREAK}".encode()
    ends = [0] if refers_to else cuts(body, size)
    link = "".join(c for c in url or "" if c >= " ")
    shared = [f"WARC-Date: {date}"] + [f"WARC-Target-URI: {link}"] * bool(link)
    running, at = hashlib.sha256(), 0
    for n, end in enumerate(ends, 1):
        part, own = memoryview(body)[at:end], []
        if n == 1:
            own = [f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{identifier}>", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response"]
            own += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"] if refers_to else []
        else:
            own = ["WARC-Type: continuation", f"WARC-Record-ID: <{identifier}:{n}>", f"WARC-Segment-Origin-ID: <{identifier}>"]
        if len(ends) > 1:
            running.update(part)
            own += [f"WARC-Segment-Number: {n}", f"Running-Payload-Digest: sha256:{running.hexdigest()}"]
            own += [f"WARC-Segment-Total-Length: {len(http) + len(body)}"] * (n == len(ends))
        block = b"".join((http if n == 1 else b"", part))
        head = "\r\n".join(["WARC/1.1", *own, *shared, f"Content-Length: {len(block)}"])
        yield b"".join((head.encode(), BREAK.encode(), block))
        at = end


def revisits(pages: DataFrame, key: str, payload: str, least: int = LEAST) -> DataFrame:
    """(record_id, refers_to) of the records whose payload an earlier key has, by their identifiers."""
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    facts = materialize(pages.select(F.col(key).alias("key"), F.sha2(body, 256).alias("digest"), F.octet_length(body).alias("n")), "facts").where(F.col("n") >= least)
    salted = facts.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)))
    local = salted.groupBy("digest", "salt").agg(F.min("key").alias("low"), F.count("*").alias("n"))
    first = local.groupBy("digest").agg(F.min("low").alias("first"), F.sum("n").alias("n")).where("n > 1").select("digest", "first")
    # one row for each salt of a digest meets the digest; its records meet their salt's row
    held = local.select("digest", "salt").join(first, "digest")
    later = salted.join(held, ["digest", "salt"]).where(~F.col("key").eqNullSafe(F.col("first")))
    return later.select(record_id(F.col("key"), F.col("digest")).alias("record_id"), record_id(F.col("first"), F.col("digest")).alias("refers_to")).distinct()


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST, size: int = CHUNK) -> None:
    """A gzip archive for each partition of ``pages``, a record for each row; a null payload is empty, a null key a record without one.

    Of rows with equal payloads of ``least`` bytes or more those with the smallest key are responses, the others revisits of it; a row that repeats key and payload is
    what the first is. Rows whose key is null come after all others. Other columns are not read; no rows give no archive.
    """
    spark = pages.sparkSession
    small_batches(spark)
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    digest = F.sha2(body, 256)
    rows = pages.select(record_id(F.col(key), digest).alias("record_id"), F.col(url).cast("string").alias("url"), digest.alias("digest"), body.alias("_text"))
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        # a text goes through as the slices of its batch's buffer that its segments are
        for part in pieces(batches, "_text"):
            head = zip(*(c.to_pylist() for c in part.columns[:-1]))
            for (identifier, link, sha, refers_to), body in zip(head, blobs(part.column(4))):
                for record in segments(identifier, link, body, sha, refers_to, date, size):
                    out.append(record)
                    held += len(record)
                    if held > OUT_BYTES or len(out) >= OUT_ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).view(pa.string())], names=["value"])
                        out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).view(pa.string())], names=["value"])

    with scratch(spark):
        again = materialize(revisits(pages, key, payload, least), "revisits")
        # adaptive execution sends the revisits to all tasks if they are few; else both sides meet by identifier, of which no one is frequent
        rows = rows.join(again, "record_id", "left").select("record_id", "url", "digest", "refers_to", "_text")
        rows.mapInArrow(run, "value string").write.option("lineSep", BREAK).option("compression", "gzip").text(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, chunk, record_type, refers_to, url, digest, running, payload_bytes, whole, data): a row for each segment in the archives.

    ``chunk`` is null for a record that is not segmented; ``digest`` and ``running`` are those that the segment names. ``payload_bytes`` is the length that the
    HTTP head names, if it does; ``whole`` is false where a block is shorter than its own length (a damaged or a foreign archive whose payload has the separator).
    """
    raw = spark.read.option("lineSep", SEPARATOR).text(path)
    head = F.substring_index("value", BREAK, 1)
    field = lambda name: F.nullif(F.regexp_extract("head", rf"(?im)^{name}:[ \t]*(.*?)[ \t]*$", 1), F.lit(""))
    urn = lambda name: F.regexp_replace(field(name), r"^<|>$", "")
    rows = raw.select(head.alias("head"), F.col("value").cast("binary").alias("value")).where(F.col("head").contains("WARC-Type:"))
    size = field("Content-Length").cast("int")
    block = F.substring("value", F.octet_length("head") + 4 + 1, F.col("size"))
    rows = rows.withColumn("size", size).select("*", block.alias("block"), field("Content-Type").startswith("application/http").alias("http"))
    # a continuation has no head of its own
    inner = F.when(F.col("http"), F.concat(F.substring_index(F.col("block").cast("string"), BREAK, 1), F.lit(BREAK)))
    rows = rows.withColumn("inner", inner)
    sha = lambda name: F.lower(F.regexp_extract(field(name), r"(?i)^sha256:(.*)$", 1))
    return rows.select(
        F.coalesce(urn("WARC-Segment-Origin-ID"), urn("WARC-Record-ID")).alias("record_id"), field("WARC-Segment-Number").cast("int").alias("chunk"), F.lower(field("WARC-Type")).alias("record_type"),
        urn("WARC-Refers-To").alias("refers_to"), field("WARC-Target-URI").alias("url"), sha("WARC-Payload-Digest").alias("digest"), sha("Running-Payload-Digest").alias("running"),
        F.regexp_extract("inner", r"(?im)^Content-Length:[ \t]*(\d+)", 1).try_cast("bigint").alias("payload_bytes"), (F.octet_length("block") == F.col("size")).alias("whole"),
        F.when(F.col("inner").isNull(), F.col("block")).otherwise(F.expr("substring(block, octet_length(inner) + 1)")).alias("data"),
    )


def running_digests(chunks: DataFrame) -> DataFrame:
    """(record_id, chunk, payload_bytes, sha256, intact, copies, last) of segmented records: bytes and SHA-256 of the payload up to each chunk's end.

    Chunks come by record and number and pass one hash; a record that is in the archives several times is hashed once and counted. ``intact`` is false from the first
    chunk on that is missing, short or other than its digest says.
    """
    small_batches(chunks.sparkSession)
    rows = chunks.where("chunk is not null").select("record_id", "chunk", "running", "whole", "data")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_id", "chunk", "payload_bytes", "sha256", "intact", "copies", "last"]
        now, before, size, copies, intact, state, waiting = None, 0, 0, 1, True, hashlib.sha256(), None
        for batch in batches:
            out = []
            for identifier, chunk, running, whole, data in zip(*(c.to_pylist() for c in batch.columns)):
                if identifier == now and chunk == before:  # the same record once more
                    if chunk == 1:
                        copies += 1
                        waiting[5] = copies
                    continue
                if waiting:
                    waiting[6] = identifier != now
                    out.append(waiting)
                if identifier != now:
                    now, before, size, copies, intact, state = identifier, 0, 0, 1, True, hashlib.sha256()
                state.update(data)
                size += len(data)
                sha = state.copy().hexdigest()
                intact &= chunk == before + 1 and bool(whole) and sha == running
                before = chunk
                waiting = [identifier, chunk, size, sha, intact, copies, False]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=names)
        if waiting:
            waiting[6] = True
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(waiting, kinds)], names=names)

    kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.bool_(), pa.int32(), pa.bool_()]
    dealt = rows.repartition("record_id").sortWithinPartitions("record_id", "chunk")
    return dealt.mapInArrow(run, "record_id string, chunk int, payload_bytes bigint, sha256 string, intact boolean, copies int, last boolean")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, record_type, refers_to, payload_bytes, payload_digest, n_chunks, intact) of the responses and revisits in the archives.

    Digests and lengths of responses are those of the bytes that were read; a revisit has none of its own and gives what it names. ``intact`` tells whether the
    payload is as its record says.
    """
    chunks = read_chunks(spark, path)
    data = F.col("data")
    revisit = F.col("record_type") == "revisit"
    one = chunks.where("chunk is null and record_type in ('response', 'revisit')").select(
        "record_id", "record_type", "refers_to", F.when(revisit, F.col("payload_bytes")).otherwise(F.octet_length(data).cast("bigint")).alias("payload_bytes"),
        F.when(revisit, F.col("digest")).otherwise(F.sha2(data, 256)).alias("payload_digest"), F.lit(1).alias("n_chunks"), (F.col("whole") & (revisit | (F.sha2(data, 256) == F.col("digest")))).alias("intact"),
    )
    last = running_digests(chunks).where("last")
    times = F.explode(F.sequence(F.lit(1), "copies"))
    many = last.select("record_id", F.lit("response").alias("record_type"), F.lit(None).cast("string").alias("refers_to"), "payload_bytes", F.col("sha256").alias("payload_digest"), F.col("chunk").alias("n_chunks"), "intact", times.alias("copy")).drop("copy")
    return one.unionByName(many)


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST, size: int = CHUNK) -> DataFrame:
    """(key, payload_bytes, payload_digest, record_type, refers_to, n_chunks, intact): ``pages`` written to archives (see ``write_archives``) and read back, a row for each page.

    The archives are deleted once they were read; what was read of them is kept as a table. No rows give no rows.
    """
    spark = pages.sparkSession
    path = f"{shared_root(spark)}/archives-{uuid.uuid4().hex}"
    kind = pages.schema[key].dataType
    try:
        write_archives(pages, path, key, url, payload, least, size)
        found = read_records(spark, path)
        out = found.select(key_of(F.col("record_id")).cast(kind).alias(key), "payload_bytes", "payload_digest", "record_type", key_of(F.col("refers_to")).cast(kind).alias("refers_to"), "n_chunks", "intact")
        return materialize(out, "records")
    finally:
        remove(spark, path)
