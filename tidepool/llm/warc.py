"""WARC archives with revisit resolution.

Only headers (page, payload length, payload digest) are shuffled: the smallest page of each digest
is the original response, and the others' headers are joined to it to become revisit records. The
archives are then written in one more pass over the pages by Spark's text writer, whose record
separator is the two line ends that close a WARC record, so any file system that Spark knows takes
them. A revisit record has no payload. Archives are read back as bounded binary files and cut by
``Content-Length``, so payloads may hold any text, record headers included.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm.common import ddl, partitions_for, table, text_of
from tidepool.session import scratch_folder

cloudpickle.register_pickle_by_value(sys.modules[__name__])

END = "\r\n\r\n"
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                     ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_id", pa.string()),
                     ("payload", pa.string())])
#: About the length of a record without its payload.
HEADER_BYTES = 512
HOT_SLOTS = 1 << 14
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public namespace for URLs


def base32(sha1_hex: str) -> str:
    """A digest as WARC headers have it: bare upper-case base32."""
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def page_headers(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(page_id, url, payload_bytes, payload_sha1): what revisit resolution needs of each page."""
    raw = text_of(payload_col)
    return pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.octet_length(raw).cast("bigint").alias("payload_bytes"), F.sha1(raw).alias("payload_sha1"))


def resolve_revisits(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Adds ``record_type`` and ``refers_to`` (the response's page) to the headers.

    Of equal payloads (digest and length) of at least ``min_bytes`` the smallest page is the
    response. A digest that a third of all pages share is one row of the pre-aggregated side, and
    the join's other side is headers alone, whose large partitions Spark splits.
    """
    keys = ["payload_sha1", "payload_bytes"]
    first = headers.filter(F.col("payload_bytes") >= min_bytes).groupBy(*keys).agg(F.min("page_id").alias("first_id"))
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return (headers.join(first, keys, "left")
            .select(*headers.columns, F.when(revisit, "revisit").otherwise("response").alias("record_type"),
                    F.when(revisit, F.col("first_id")).alias("refers_to")))


def hot_slots(headers: DataFrame, archive_bytes: int) -> tuple[int, DataFrame]:
    """Bytes of all payloads, and (slot, ways): over how many archives to deal the rows of a page and
    payload that repeat until they exceed an archive. Pages share slots, so that the table has at most
    :data:`HOT_SLOTS` rows; a cold page in a hot slot is dealt alike."""
    size = F.col("payload_bytes") + HEADER_BYTES
    slots = (headers.groupBy(_slot(), "page_id", "payload_sha1").agg(F.sum(size).alias("held"), F.sum("payload_bytes").alias("payload"))
             .groupBy("slot").agg(F.sum("payload").alias("payload"), F.max("held").alias("held")))
    rows = [(r["slot"], r["payload"], r["held"]) for r in slots.collect()]
    hot = [(slot, -(-held // archive_bytes)) for slot, _, held in rows if held > archive_bytes]
    return sum(payload for _, payload, _ in rows), headers.sparkSession.createDataFrame(hot, "slot bigint, ways bigint")


def _slot() -> Column:
    return F.pmod(F.xxhash64("page_id", "payload_sha1"), F.lit(HOT_SLOTS)).alias("slot")


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}:{digest}')}>"


def _header_lines(page_id, url, payload_bytes, digest, kind, refers_to, date: str) -> str:
    """The header of one record; line ends and other control characters in a URL are percent-encoded."""
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Date: {date}",
             f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {payload_bytes}", "Content-Type: text/html; charset=utf-8"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if kind == "revisit":
        lines += [f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join([*lines, f"Content-Length: {0 if kind == 'revisit' else payload_bytes}"])


def _format(date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("page_id", "url", "payload_bytes", "payload_sha1", "record_type", "refers_to", "payload")
        for batch in batches:
            out = []
            for page_id, url, n, sha1, kind, refers_to, payload in zip(*(batch.column(c).to_pylist() for c in names)):
                head = _header_lines(page_id, url, n, base32(sha1), kind, refers_to, date)
                out.append(f"{VERSION.decode()}{head}{END}{'' if kind == 'revisit' else payload}")
            yield pa.record_batch([pa.array(out, pa.string())], names=["value"])

    return run


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   min_bytes: int = 0, archive_bytes: int = 16 << 20, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write one WARC record per page below ``path``, repeated payloads as revisits.

    ``archive_bytes`` is the aimed-at size of a file before compression. A null payload is empty, a
    null URL or page id has no header line. A page id that is null sorts after all others. Rows
    repeated with the response's page id and payload are captures of their own: each is a response,
    and where they exceed an archive they are dealt to several. An empty table writes no record.
    """
    spark = pages.sparkSession
    headers = page_headers(pages, id_col, url_col, payload_col)
    total, hot = hot_slots(headers, archive_bytes)
    hot = F.broadcast(hot)
    kinds = resolve_revisits(headers, min_bytes).select("page_id", "payload_sha1", "payload_bytes", "record_type", "refers_to").distinct()
    raw = text_of(payload_col)
    full = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), raw.alias("payload"),
                        F.sha1(raw).alias("payload_sha1"))
    # one shuffle of the payloads, by page: it serves the join and deals the pages to archives. Rows of
    # a hot slot get one of its numbers each, the kind of their record gets all of them
    ways = F.coalesce("ways", F.lit(1))
    dealt = full.withColumn("slot", _slot()).join(hot, "slot", "left").withColumn("way", F.pmod(F.monotonically_increasing_id(), ways))
    copied = kinds.withColumn("slot", _slot()).join(hot, "slot", "left").withColumn("way", F.explode(F.sequence(F.lit(0), ways - 1)))
    key = F.coalesce("page_id", F.lit(-(1 << 63)))
    files, by = partitions_for(spark, total, archive_bytes), ["page", "payload_sha1", "way"]
    joined = (dealt.withColumn("page", key).drop("slot", "ways").repartition(files, *by)
              .join(copied.withColumn("page", key).drop("page_id", "slot", "ways").repartition(files, *by), by))
    (joined.mapInArrow(_format(date), "value string")
     .write.option("lineSep", END).option("compression", "gzip").text(path))


def _headers_of(block: bytes) -> dict[str, str]:
    lines = (line.split(": ", 1) for line in block.decode().split("\r\n"))
    return {name: value for name, value in lines}


def parse_archive(content: bytes) -> Iterator[tuple]:
    """The records of one archive, cut by their Content-Length."""
    at = 0
    while at < len(content):
        if content[at:at + len(VERSION)] != VERSION:
            raise ValueError(f"no record starts at byte {at}")
        end = content.index(END.encode(), at)
        head = _headers_of(content[at + len(VERSION):end])
        start = end + len(END)
        stop = start + int(head["Content-Length"])
        if content[stop:stop + len(END)] != END.encode():
            raise ValueError(f"the record at byte {at} does not end where its Content-Length says")
        number = lambda name: int(head[name]) if name in head else None
        kind = head["WARC-Type"]
        digest, payload = head["WARC-Payload-Digest"].removeprefix("sha1:"), content[start:stop]
        if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"the payload at byte {start} does not match its digest")
        yield (number("X-Page-Id"), head.get("WARC-Target-URI"), kind, number("X-Refers-To-Page-Id"),
               number("X-Payload-Length"), digest, head["WARC-Record-ID"], None if kind == "revisit" else payload.decode())
        at = stop + len(END)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zlib

    for batch in batches:
        for content in batch.column("content").to_pylist():
            rows = list(parse_archive(zlib.decompress(content, wbits=31) if content else b""))
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(RECORDS), RECORDS)], schema=RECORDS)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: its page, URL, type, response, payload length and digest, id and payload
    (null for a revisit). A payload that does not match its digest, or a torn record, is an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(_parse, ddl(RECORDS))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back."""
    path = scratch_folder(spark) + "/archives"
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _base32_sql(payload: str) -> str:
    def letter(i: int, k: int) -> str:
        return f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(sha1({payload}), {i + 1}, 10))::bigint >> {35 - 5 * k}) & 31) + 1)::integer, 1)"

    return " || ".join(letter(i, k) for i in range(0, 40, 10) for k in range(8))


SQL = f"""
with p as (select page_id, coalesce(html, '') as payload from pages),
f as (select *, min(page_id) over (partition by payload) as original from p)
select page_id, octet_length(encode(payload)) as payload_bytes, {_base32_sql('payload')} as payload_digest,
       case when page_id = original then 'response' else 'revisit' end as record_type,
       case when page_id <> original then original end as refers_to from f"""
