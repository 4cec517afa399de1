"""WARC archives: written by Spark's text writer, read back by a reader that salvages damaged files."""

from __future__ import annotations

import base64
import hashlib
import logging
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellgraph.llm.common import broadcast_if_small, fresh_path, materialize, prepare

VERSION = b"WARC/1.1"
#: An archive file holds about so many bytes, and no more than the bound unless it is a single record.
FILE_BYTES, FILE_BOUND = 16 << 20, 1 << 30
#: Records up to each size are written together, those above the last one by one.
SIZE_CLASSES = (64 << 10, 1 << 20, 16 << 20)
#: A gzip member that unpacks to more than this is quarantined; bytes that are unpacked at once.
MEMBER_BOUND, SLICE = 1 << 30, 1 << 20
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_NEXT = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
#: The end of a header, or a version line that stands where none may.
_END = re.compile(rb"\r\n(?:\r\n|WARC/1\.[01]\r\n)")
_LOG = logging.getLogger(__name__)


def base32_sha1(value: Column) -> Column:
    """Bare upper-case base32 of the SHA-1, five bits to a letter."""
    digits = F.sha1(value)
    letters = []
    for part in range(4):
        number = F.conv(F.substring(digits, 10 * part + 1, 10), 16, 10).cast("bigint")
        letters += [F.substr(F.lit(_BASE32), (F.shiftright(number, 35 - 5 * i).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for i in range(8)]
    return F.concat(*letters)


def records(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """(record, size_class): the WARC record of each page as text, without the line feed that ends it.

    Of pages with equal payloads of at least least_bytes the one with the smallest key is a response and
    the others are revisits that refer to it; other pages are responses. A null payload is empty. Rows
    that repeat the smallest key are responses too. A null key is written as an empty name; such a row
    revisits the smallest non-null key, and is a response if there is none.
    """
    rows = pages.select(F.col(key).cast("string").alias("id"), F.col(key).alias("key"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).alias("payload"))
    rows = rows.withColumns({"digest": base32_sha1(F.col("payload").cast("binary")), "bytes": F.octet_length("payload")})
    groups = rows.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = broadcast_if_small(materialize(groups.select("digest", "first"), "firsts"))
    told = rows.join(firsts, "digest", "left")
    revisit = F.coalesce((F.col("bytes") >= least_bytes) & F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first")), F.lit(False))
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    end = "\r\n"
    head = F.concat(
        F.lit(VERSION.decode() + end + "WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{end}WARC-Record-ID: <urn:page:"), F.coalesce("id", F.lit("")), F.lit(f">{end}WARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", ""),
        F.lit(f"{end}WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit(f"{end}X-Payload-Length: "), F.col("bytes").cast("string"),
        F.when(revisit, F.concat(F.lit(f"{end}WARC-Refers-To: <urn:page:"), F.col("first").cast("string"), F.lit(">"))).otherwise(F.lit("")),
        F.lit(f"{end}Content-Type: text/html{end}Content-Length: "), F.octet_length(body).cast("string"), F.lit(end + end),
    )
    size = F.col("bytes") + F.octet_length(F.coalesce("url", F.lit(""))) + 1000
    number = sum(((size > bound).cast("int") for bound in SIZE_CLASSES), F.lit(0))
    return told.select(F.concat(head, body, F.lit(end)).alias("record"), number.alias("size_class"))


def write(pages: DataFrame, path: str, **names) -> None:
    """Write the pages' records below path, in files that no reader of whole files has to fear.

    Records are written by classes of their size, so that the largest possible file is known; the text
    writer works on any store. Files hold about FILE_BYTES, FILE_BOUND at most, or one record. An empty
    table leaves one folder without records.
    """
    html, url = names.get("html", "html"), names.get("url", "url")
    size = F.coalesce(F.octet_length(html), F.lit(0)) + F.coalesce(F.octet_length(F.col(url).cast("string")), F.lit(0)) + 1000
    number = sum(((size > bound).cast("int") for bound in SIZE_CLASSES), F.lit(0))
    found = {r["k"]: r["m"] for r in pages.groupBy(number.alias("k")).agg(F.avg(size).alias("m")).collect()}
    made = records(pages, **names)
    for k, mean in sorted(found.items()) or [(0, 1000.0)]:
        most = 1 if k == len(SIZE_CLASSES) else max(1, int(min(FILE_BYTES / mean, FILE_BOUND / SIZE_CLASSES[k])))
        made.where(F.col("size_class") == k).select("record").write.option("lineSep", "\r\n").option("maxRecordsPerFile", most).text(f"{path}/size-{k}")


def parse(data: bytes) -> tuple[list[tuple[dict[str, str], bytes]], list[tuple[int, int, str]]]:
    """((headers, body) of the records, (start, end, reason) of the gaps) of a file's bytes.

    Records stand plainly or in gzip members, one or more to a member. Where a header, a length, a
    member or a response's digest fails its check, the bytes up to the next version line or member that
    does pass are a gap, and reading goes on there.
    """
    found: list[tuple[dict[str, str], bytes]] = []
    gaps: list[tuple[int, int, str]] = []
    at, bad, why = 0, None, ""
    while at < len(data):
        got, end, reason = _member(data, at) if data[at : at + 2] == b"\x1f\x8b" else _plain(data, at)
        if reason:
            if bad is None:
                bad, why = at, reason
            after = _NEXT.search(data, at + 1)
            at = after.start() if after else len(data)
            continue
        if bad is not None:
            gaps.append((bad, at, why))
            bad = None
        found += got
        at = end
    if bad is not None:
        gaps.append((bad, len(data), why))
    return found, gaps


def _member(data: bytes, at: int) -> tuple[list, int, str]:
    unzip, view, i, parts, size = zlib.decompressobj(31), memoryview(data), at, [], 0
    try:
        while not unzip.eof and i < len(data):
            part = unzip.decompress(view[i : i + SLICE], SLICE)
            i += min(SLICE, len(data) - i)
            while True:
                parts.append(part)
                size += len(part)
                if size > MEMBER_BOUND:
                    return [], at, "gzip: unpacks to too much"
                if unzip.eof or not unzip.unconsumed_tail:
                    break
                part = unzip.decompress(unzip.unconsumed_tail, SLICE)
    except zlib.error as e:
        return [], at, f"gzip: {e}"
    if not unzip.eof:
        return [], at, "gzip: cut short"
    text, out, k = b"".join(parts), [], 0
    while k < len(text):
        got, k, reason = _plain(text, k)
        if reason:
            return [], at, reason
        out += got
    return out, i - len(unzip.unused_data), ""


def _plain(data: bytes, at: int) -> tuple[list, int, str]:
    if not _VERSION.match(data, at):
        return [], at, "no version line"
    # A header has any length; what is searched for it ends at the next version line, where reading would go on.
    end_of_header = _END.search(data, at)
    if not end_of_header or end_of_header.end() - end_of_header.start() > 4:
        return [], at, "header without end"
    head = end_of_header.start()
    headers: dict[str, str] = {}
    for line in data[at:head].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return [], at, "bad header line"
        headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    length = headers.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,18}", length):
        return [], at, "bad length"
    end = head + 4 + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        return [], at, "length doesn't lead to the record's end"
    body = data[head + 4 : end]
    digest = headers.get("warc-payload-digest", "")
    if headers.get("warc-type") == "response" and digest.startswith("sha1:") and digest[5:] != base64.b32encode(hashlib.sha1(body).digest()).decode():
        return [], at, "digest differs"
    return [(headers, body)], end + 4, ""


def read(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """The records (file, headers map, body) and the quarantined gaps (file, start, end, reason) of a folder of archives.

    Each file is read by one task, as bytes from any store; an empty folder or file has no records.
    """
    prepare(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch], gap: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, (found, gaps) = batch.column(0)[i].as_py(), parse(batch.column(1)[i].as_py())
                if gap:
                    columns = [[name] * len(gaps), *([g[k] for g in gaps] for k in range(3))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["file", "start", "end", "reason"])
                    continue
                for lo in range(0, len(found), 500):
                    part = found[lo : lo + 500]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array([list(h.items()) for h, _ in part], pa.map_(pa.string(), pa.string())), pa.array([b for _, b in part], pa.binary())], ["file", "headers", "body"])

    whole = files.mapInArrow(lambda x: run(x, False), "file string, headers map<string,string>, body binary")
    return whole, files.mapInArrow(lambda x: run(x, True), "file string, start bigint, end bigint, reason string")


def round_trip(pages: DataFrame, **names) -> DataFrame:
    """Write the pages' archives, read them back, and tell of each record page_id, payload_bytes, payload_digest, record_type, refers_to.

    One row per page, as records says for null keys, null payloads and repeated rows; an empty table gives
    no rows. Size and digest of a response are of the payload that was read, those of a revisit stand in its
    header, for it has none. Gaps that the reader had to leave out are written beside the archives, and a
    warning tells of them.
    """
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write(pages, path, **names)
    found, gaps = read(spark, f"{path}/*")
    lost = materialize(gaps, "gaps")
    if left_out := lost.count():
        _LOG.warning("%d gaps in %s", left_out, path)
    kind = pages.schema[names.get("key", "page_id")].dataType
    name = lambda header: F.expr(f"nullif(regexp_extract(headers['{header}'], '^<urn:page:(.*)>$', 1), '')").cast(kind)
    own = F.col("headers")["warc-type"] == "response"
    return found.select(
        name("warc-record-id").alias("page_id"),
        F.when(own, F.octet_length("body").cast("bigint")).otherwise(F.col("headers")["x-payload-length"].cast("bigint")).alias("payload_bytes"),
        F.when(own, base32_sha1(F.col("body"))).otherwise(F.regexp_replace(F.col("headers")["warc-payload-digest"], "^sha1:", "")).alias("payload_digest"),
        F.col("headers")["warc-type"].alias("record_type"),
        name("warc-refers-to").alias("refers_to"),
    )
