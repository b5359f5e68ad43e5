"""WARC archives: segmented records written, reassembled and decoded.

write_pages() makes a record per page, in DataFrame operations alone: an HTTP response
in chunked framing, cut into an origin record and continuation records where it is
longer than a segment. Of pages with equal payloads one is a response and the others are
revisit records without a body. Records go to gzip-compressed files through Spark's
text writer, whose line separator is the blank lines that end a record; so archives can
lie in any store that Spark writes.

read_archives() reads files member by member and record by record, by their Content-Length, groups continuation
records by the identifier of their origin, orders them by segment number, checks
that the numbers are complete and the total length right, and decodes the chunked
framing. Records in one piece are not shuffled. A record that fails a check has a null
payload and says why in `error`. So does damage to a file: a member that is cut short or can't be
inflated, a Content-Length that is missing, no number or too large; reading goes on at the next member or
record that can be found, so other records are not lost.

A file holds at most `records_per_file` records of a segment each, which bounds what a
task holds while it reads one. Rows are told apart by their place in df's files; what isn't read
straight from Parquet files is written to some first.

Edge cases: a null payload counts as empty, a null id gives a record of its own with a
null id; repeated rows get a record each (the last of those with the largest id is the
response); other columns are ignored; no rows give an archive of no records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, joined_by_key, placed, stored

CRLF = "\r\n"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(raw: Column) -> Column:
    """Upper-case base32 of the SHA-1: eight digits for each five bytes."""
    digits = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
    rfc = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    hexes = F.sha1(raw)
    groups = [F.lpad(F.conv(F.substring(hexes, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*groups), digits, rfc)


def revisits(df: DataFrame, payload: Column, least_bytes: int) -> DataFrame:
    """(same_id, row, target_id, target_row) of df's rows (id, row, ...) whose payload another row's record holds."""
    keys = df.select("id", "row", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("n"))
    keys = keys.where(F.col("n") >= least_bytes).select("id", "row", F.unhex("digest").alias("digest"))
    # of the rows of the largest id the last is the response; nulls come first
    best = keys.groupBy("digest").agg(F.max(F.struct("id", "row")).alias("target"), F.count("*").alias("n")).where("n > 1").withColumnRenamed("digest", "d")
    keys, best = stored(keys, "payload-keys"), stored(best, "repeated-payloads")
    joined = joined_by_key(keys, best, {"d": "digest"}, "n", keys.count())
    return joined.where("row <> target.row").select(F.col("id").alias("same_id"), "row", F.col("target.id").alias("target_id"), F.col("target.row").alias("target_row"))


def write_pages(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", segment_bytes: int = 8_192, chunk_bytes: int = 4_096, least_revisit_bytes: int = 0, records_per_file: int = 8_000, date: str = "2000-01-01T00:00:00Z", broadcast_rows: int = 200_000) -> None:
    """Write df's rows as archives in the folder path."""
    url = F.regexp_replace(F.coalesce(F.col(url_col).cast("string"), F.lit("about:blank")), r"[\x00-\x20]", "%20")
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    pages = placed(df.select(F.col(id_col).cast("long").alias("id"), url.alias("url"), payload.alias("payload")), "_row")
    # Few revisits are broadcast; to many the payloads are shuffled.
    again = bounded(stored(revisits(pages.withColumnRenamed("_row", "row"), F.col("payload"), least_revisit_bytes), "revisits"), broadcast_rows)
    pages = pages.join(again, (F.col("_row") == F.col("row")) & F.col("id").eqNullSafe(F.col("same_id")), "left").withColumn("digest", base32_sha1(F.col("payload")))
    text = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts)).cast("binary")
    name = lambda i, r: F.concat(F.lit("<urn:pages:"), F.coalesce(i.cast("string"), F.lit("")), F.lit(":"), r.cast("string"), F.lit(">"))
    chunk = lambda part: F.concat(text(F.hex(F.octet_length(part).cast("long")), CRLF), part, text(CRLF))
    chunks = F.transform(
        F.sequence(F.lit(0), F.floor((F.octet_length("payload") - 1) / chunk_bytes).cast("int")),
        lambda k: chunk(F.substring(F.col("payload"), k * chunk_bytes + 1, F.lit(chunk_bytes))).cast("string"),
    )
    body = F.when(F.octet_length("payload") > 0, F.array_join(chunks, "")).otherwise("")
    block = F.when(F.col("row").isNull(), F.concat(text(HTTP_HEAD), body.cast("binary"), text("0\r\n\r\n"))).otherwise(text(HTTP_HEAD))
    blocks = pages.select("id", "url", "digest", "_row", "target_id", "target_row", F.octet_length("payload").alias("n_payload"), block.alias("block")).withColumn("total", F.octet_length("block"))
    segments = F.transform(F.sequence(F.lit(0), F.floor((F.col("total") - 1) / segment_bytes).cast("int")), lambda k: F.substring(F.col("block"), k * segment_bytes + 1, F.lit(segment_bytes)))
    parts = blocks.withColumn("segments", segments).withColumn("n_segments", F.size("segments")).drop("block")
    parts = parts.select("*", F.posexplode("segments").alias("k", "part")).drop("segments")
    own, many, later = name(F.col("id"), F.col("_row")), F.col("n_segments") > 1, F.col("k") > 0
    line = lambda label, value: F.concat(F.lit(f"{label}: "), value, F.lit(CRLF))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(later, "continuation").when(F.col("target_row").isNotNull(), "revisit").otherwise("response")),
        line("WARC-Record-ID", F.when(later, name(F.col("id"), F.concat(F.col("_row"), F.lit(":"), F.col("k") + 1))).otherwise(own)),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.col("url")),
        F.when(later, F.lit("")).otherwise(F.concat(line("Content-Type", F.lit("application/http;msgtype=response")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))))),
        F.when(F.col("target_row").isNotNull(), F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", name(F.col("target_id"), F.col("target_row"))))).otherwise(""),
        F.when(many, line("WARC-Segment-Number", (F.col("k") + 1).cast("string"))).otherwise(""),
        F.when(later, line("WARC-Segment-Origin-ID", own)).otherwise(""),
        F.when(later & (F.col("k") + 1 == F.col("n_segments")), line("WARC-Segment-Total-Length", F.col("total").cast("string"))).otherwise(""),
        line("Content-Length", F.octet_length("part").cast("string")),
        F.lit(CRLF),
    )
    records = parts.select(F.concat(head.cast("binary"), F.col("part")).cast("string").alias("value"))
    records.write.options(lineSep="\r\n\r\n", compression="gzip", maxRecordsPerFile=str(records_per_file)).text(path)


GZIP = b"\x1f\x8b\x08"


def inflated(data: bytes, step: int = 1 << 14, most: int = 1 << 20) -> Iterator[bytes | None]:
    """A file's bytes in pieces, its gzip members inflated; None where a member is damaged or cut short."""
    view, at = memoryview(data), 0
    if data[:2] != GZIP[:2]:
        yield from (bytes(view[k : k + most]) for k in range(0, len(view), most))
        return
    while at < len(view):
        member = zlib.decompressobj(31)
        try:
            while not member.eof:
                piece = view[at : at + step]
                out = member.decompress(piece, most)
                at += len(piece) - len(member.unconsumed_tail) - len(member.unused_data)
                if out:
                    yield out
                elif not len(piece):
                    yield None
                    return
        except zlib.error:
            yield None
            at = data.find(GZIP, at + 1)
            if at < 0:
                return


def records_in(data: bytes, longest_head: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes | None, str | None]]:
    """(headers with names in lower case, block, error) of each record of an archive, gzip or plain.

    Where the archive is damaged, the block is null and error says why; reading goes on at the
    next record that can be found.
    """
    source, held = inflated(data), bytearray()
    state = "more"  # or "cut": a member ended early, or "over"

    def until(n: int) -> bool:
        """Whether n bytes are held, after more are read if need be."""
        nonlocal state
        while len(held) < n and state == "more":
            piece = next(source, b"")
            if piece:
                held.extend(piece)
            else:
                state = "cut" if piece is None else "over"
        return len(held) >= n

    def to_next_record() -> None:
        del held[:1]
        while (k := held.find(b"\r\n\r\nWARC/")) < 0:
            del held[:-8]
            if not until(len(held) + 1):
                held.clear()
                return
        del held[: k + 4]

    while True:
        while until(2) and held[:2] == b"\r\n":
            del held[:2]
        looked = 0
        while (end := held.find(b"\r\n\r\n", max(0, looked - 3))) < 0:
            looked = len(held)
            if looked > longest_head or not until(looked + 1):
                break
        if end < 0:
            if held.strip():
                yield {}, None, "a record ends within its headers"
            elif state == "cut":
                yield {}, None, "a member is damaged"
            if looked > longest_head:
                to_next_record()
                continue
            held.clear()
            if state == "over":
                return
            state = "more"
            continue
        if held[:5] != b"WARC/":
            yield {}, None, "no record where one should begin"
            to_next_record()
            continue
        lines = held[:end].decode("utf-8", "replace").split("\r\n")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = head.get("content-length", "")
        if not (length.isascii() and length.isdigit()):
            yield head, None, "Content-Length missing or no number"
            del held[:end]
            to_next_record()
        elif until(end + 4 + int(length)):
            yield head, bytes(held[end + 4 : end + 4 + int(length)]), None
            del held[: end + 4 + int(length)]
        else:
            yield head, None, "the record ends early"
            del held[:end]
            to_next_record()


def dechunked(raw: bytes) -> bytes:
    """A body without its chunked transfer framing."""
    out, at = [], 0
    while True:
        end = raw.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk header missing")
        size = int(raw[at:end].split(b";")[0].strip(), 16)
        if not size:
            return b"".join(out)
        at = end + 2
        if raw[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk length wrong")
        out.append(raw[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """The body of an HTTP message, its transfer framing decoded."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("HTTP headers missing")
    return dechunked(body) if re.search(rb"\r\ntransfer-encoding:[^\r]*chunked", head, re.I) else body


_PARSED = "type string, record_id string, origin_id string, segment int, total long, digest string, refers_to string, url string, block binary, error string"


def parsed(spark: SparkSession, path: str, batch_records: int = 2_000, batch_bytes: int = 16 << 20) -> DataFrame:
    """A row per record of the archives in the folder path; of damaged places too, with an error and no block."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").select("content")
    names = [x.split()[0] for x in _PARSED.split(", ")]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.string()]

    def row_of(head: dict[str, str], block: bytes | None, error: str | None) -> tuple:
        number = {}
        for name, most in (("warc-segment-number", 1 << 31), ("warc-segment-total-length", 1 << 63)):
            text = head.get(name)
            good = text is not None and text.isascii() and text.isdigit() and int(text) < most
            number[name] = int(text) if good else None
            if text is not None and not good:
                block, error = None, f"{name} is no number"
        own = head.get("warc-record-id")
        return (head.get("warc-type"), own, head.get("warc-segment-origin-id", own), *number.values(), head.get("warc-payload-digest"), head.get("warc-refers-to"), head.get("warc-target-uri"), block, error)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows, size = [], 0
                for record in records_in(batch.column(0)[i].as_py()):
                    rows.append(row_of(*record))
                    size += len(record[1] or b"")
                    if len(rows) >= batch_records or size >= batch_bytes:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return files.mapInArrow(run, _PARSED)


def decoded(pieces: list[tuple[int | None, bytes]], totals: list[int], digest: str | None, revisit: bool) -> tuple[bytes | None, str | None, str | None]:
    """Payload, its digest and what is wrong, for a record's segments in order."""
    numbers = [n for n, _ in pieces]
    if numbers != [None] and numbers != list(range(1, len(numbers) + 1)):
        return None, None, "segments missing or repeated"
    block = b"".join(b for _, b in pieces)
    if numbers != [None] and totals != [len(block)]:
        return None, None, "total length wrong"
    if revisit:
        return None, None, None
    try:
        payload = payload_of(block)
    except ValueError as e:
        return None, None, str(e)
    own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if digest and digest.upper() != f"SHA1:{own}":
        return None, None, "payload digest wrong"
    return payload, own, None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row per response or revisit: type, record_id, refers_to, url, payload binary, payload_digest, error.

    A revisit's payload and digest are null: it has those of the record it refers to. A
    damaged place has a row of its own, with what is known of the record.
    """
    records = parsed(spark, path).where("error is not null or type in ('response', 'revisit', 'continuation')")
    piece = F.struct(F.col("segment"), "type", "record_id", "refers_to", "url", "digest", "total", "block", "error")
    # Records of one piece pass as they are; only segmented ones are grouped.
    keyed = records.select("origin_id", "segment", piece.alias("piece"))
    grouped = keyed.where("segment is not null and piece.error is null").groupBy("origin_id").agg(F.sort_array(F.collect_list("piece")).alias("pieces"))
    whole = keyed.where("segment is null or piece.error is not null").select("origin_id", F.array("piece").alias("pieces"))
    rows = whole.unionByName(grouped)
    names = ["type", "record_id", "refers_to", "url", "payload", "payload_digest", "error"]
    kinds = [pa.string()] * 4 + [pa.binary(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                out: list[list] = [[] for _ in names]
                for pieces in batch.column(1).slice(at, 1_000).to_pylist():
                    first = pieces[0]
                    if first["error"]:
                        for column, value in zip(out, (first["type"], first["record_id"], first["refers_to"], first["url"], None, None, first["error"])):
                            column.append(value)
                        continue
                    payload, own, error = decoded([(p["segment"], p["block"]) for p in pieces], [p["total"] for p in pieces if p["total"] is not None], first["digest"], first["type"] == "revisit")
                    if first["type"] == "continuation":
                        payload, own, error = None, None, "origin record missing"
                    for column, value in zip(out, (first["type"], first["record_id"], first["refers_to"], first["url"], payload, own, error)):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    return rows.mapInArrow(run, "type string, record_id string, refers_to string, url string, payload binary, payload_digest string, error string")
