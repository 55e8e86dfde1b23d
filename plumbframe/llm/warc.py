"""WARC archives: writing with revisit records, segmentation and chunked transfer framing, and reassembly when reading.

Writing: one record for each page. Of pages with equal payloads the one with the largest id is the response, the others are
revisits that refer to it. Blocks above segment_bytes are cut into a first record and continuations, which carry the
origin's identifier and their number, the last one also the total length. Spark's text writer puts records into files in the
shared folder, with the two line ends that close a record as its separator, so a lost task is written again as a whole.

Reading: files are parsed by Content-Length; continuation records are grouped by origin identifier, ordered by number, checked for gaps
and against the total length, joined, and the chunk framing decoded.

Edge cases: a null payload is empty; empty payloads are equal to each other; a null id counts as smaller than any; of equal pages with
equal ids each is a response, all but one with a number of its own in its record identifier; a very long page is cut into segments, joined in one row when read; a
missing URL becomes an empty header; incomplete segment groups give a null payload and complete = false; without pages there are no records; other columns aren't read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbframe.llm.common import discard, durable, fresh_path, remove, table

END = "\r\n\r\n"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2024-01-01T00:00:00Z"


def base32(hex40: Column) -> Column:
    """Upper-case base32 of 40 hexadecimal digits: of each 20 bits 4 characters."""
    parts = []
    for g in range(8):
        bits = F.conv(F.substring(hex40, 5 * g + 1, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(ALPHABET), F.shiftright(bits, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*parts)


def _cuts(data: bytes, size: int) -> Iterator[bytes]:
    """Parts of about size bytes that end between characters of UTF-8."""
    at = 0
    while at < len(data):
        stop = min(at + size, len(data))
        while stop < len(data) and data[stop] & 0xC0 == 0x80:
            stop += 1
        yield data[at:stop]
        at = stop


def chunked(payload: bytes, size: int) -> bytes:
    """payload in chunked transfer framing."""
    return b"".join([*(b"%x\r\n%b\r\n" % (len(c), c) for c in _cuts(payload, size)), b"0\r\n\r\n"])


def unchunked(framed: bytes) -> bytes:
    """The payload of chunked transfer framing; chunk extensions and trailers are dropped."""
    out, at = [], 0
    while True:
        line = framed.index(b"\r\n", at)
        n = int(framed[at:line].split(b";")[0].strip() or b"0", 16)
        if n == 0:
            return b"".join(out)
        out.append(framed[line + 2 : line + 2 + n])
        if len(out[-1]) != n or framed[line + 2 + n : line + 4 + n] != b"\r\n":
            raise ValueError("a chunk is cut short")
        at = line + 4 + n


def record_id(kind: str, key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'plumbframe:{kind}:{key}')}>"


def _record(headers: list[tuple[str, str]], block: bytes) -> str:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines) + END + block.decode("utf-8")


def page_records(page_id: int | None, url: str | None, html: str | None, digest: str, refers_to: int | None, copy: int = 1, *, segment_bytes: int, chunk_bytes: int) -> Iterator[str]:
    """The records of one page, without the line ends that close them. copy: its number among pages of equal id and payload."""
    clean = "".join(c for c in (url or "") if c >= " ")
    own = record_id("page", f"{'null' if page_id is None else page_id}:{digest}" + (f":{copy}" if copy > 1 else ""))
    common = [("WARC-Target-URI", clean), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{digest}")]
    mine = [] if page_id is None else [("Page-Id", str(page_id))]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is not None:
        first = [("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common, *mine, ("WARC-Refers-To", record_id("page", f"{refers_to}:{digest}")), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("Content-Type", "application/http; msgtype=response")]
        yield _record(first, http + b"\r\n")
        return
    block = http + b"Transfer-Encoding: chunked\r\n\r\n" + chunked((html or "").encode("utf-8"), chunk_bytes)
    parts = list(_cuts(block, segment_bytes))
    kind = ("Content-Type", "application/http; msgtype=response")
    first = [("WARC-Type", "response"), ("WARC-Record-ID", own), *common, *mine, kind]
    yield _record(first + ([("WARC-Segment-Number", "1")] if len(parts) > 1 else []), parts[0])
    for i, part in enumerate(parts[1:], 2):
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", record_id("segment", f"{own}:{i}")), ("WARC-Target-URI", clean), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", str(i))]
        yield _record(more + ([("WARC-Segment-Total-Length", str(len(block)))] if i == len(parts) else []), part)


def write_archives(pages: DataFrame, path: str, *, page_id: str = "page_id", url: str = "url", html: str = "html", segment_bytes: int = 8192, chunk_bytes: int = 4096, records_per_file: int = 2048) -> None:
    """Write pages as WARC files of at most records_per_file records below path."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html")).withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    # Written out, so that its size is known when the join is planned: few repeated payloads are broadcast, many are shuffled.
    per_id = rows.groupBy("sha1", "page_id").agg(F.count(F.lit(1)).alias("n"))
    payloads = durable(per_id.groupBy("sha1").agg(F.max("page_id").alias("newest"), F.sum("n").alias("n"), F.max("n").alias("copies")).filter("n > 1").drop("n"), "payloads")
    repeated = payloads.withColumnRenamed("sha1", "_sha1")
    same = F.col("sha1") == F.col("_sha1")
    # Pages that one id has more than once are written out with a number of their own; no group of them meets in one task.
    numbered = durable(rows.join(repeated.filter("copies > 1"), same).withColumn("at", F.monotonically_increasing_id()), "twins")
    first = durable(numbered.groupBy(F.col("sha1").alias("_first_sha1"), F.col("page_id").alias("_first_id")).agg(F.min("at").alias("first")), "first")
    twins = numbered.join(first, (F.col("sha1") == F.col("_first_sha1")) & F.col("page_id").eqNullSafe(F.col("_first_id"))).withColumn("copy", F.when(F.col("at") == F.col("first"), 1).otherwise(F.col("at") + 2))
    rows = rows.join(repeated, same, "left").filter("copies IS NULL OR copies = 1").withColumn("copy", F.lit(1).cast("long")).unionByName(twins.select(*rows.columns, *repeated.columns, "copy"))
    older = F.col("page_id").isNull() | (F.col("page_id") < F.col("newest"))
    rows = rows.select("page_id", "url", "html", base32(F.col("sha1")).alias("digest"), F.when(older, F.col("newest")).alias("refers_to"), "copy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[str] = []
            for p, u, h, d, r, n in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to", "copy")), strict=True):
                out += page_records(p, u, h, d, r, n, segment_bytes=segment_bytes, chunk_bytes=chunk_bytes)
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
                    out = []
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    rows.mapInArrow(run, "value string").write.option("lineSep", END).option("maxRecordsPerFile", records_per_file).text(path)
    discard(payloads, numbered, first)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of a file."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:stop].decode("utf-8").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        n = int(headers["content-length"])
        yield headers, data[stop + 4 : stop + 4 + n]
        at = stop + 4 + n
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"the record that ends at byte {at} isn't closed")
        at += 4


_RECORD = pa.schema([("record_id", pa.string()), ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("refers_to", pa.string()), ("block", pa.binary())])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives below path, as they stand; segment is 0 for whole records."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                rows: list[tuple] = []
                for h, block in parse_records(content.as_py()):
                    total = h.get("warc-segment-total-length")
                    rows.append((h["warc-record-id"], h.get("warc-segment-origin-id", h["warc-record-id"]), int(h.get("warc-segment-number", 0)), int(total) if total else None, h["warc-type"], int(h["page-id"]) if "page-id" in h else None, h.get("warc-target-uri"), h.get("warc-refers-to"), block))
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _RECORD.types, strict=True)], schema=_RECORD)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _RECORD.types, strict=True)], schema=_RECORD)

    return files.mapInArrow(run, "record_id string, origin string, segment int, total bigint, record_type string, page_id bigint, url string, refers_to string, block binary")


def reassemble(records: DataFrame) -> DataFrame:
    """One row for each record that isn't a continuation: record_id, record_type, page_id, url, refers_to, block, complete."""
    whole = records.filter("segment = 0").select("record_id", "record_type", "page_id", "url", "refers_to", "block", F.lit(True).alias("complete"))
    # A group is one record's segments; only cut records are shuffled.
    groups = records.filter("segment > 0").groupBy("origin").agg(
        F.array_sort(F.collect_list(F.struct("segment", "total", "block"))).alias("parts"),
        *[F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in ("record_type", "page_id", "url", "refers_to")],
    )
    joined = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p.block))
    numbered = F.transform("parts", lambda p: p.segment) == F.sequence(F.lit(1), F.size("parts"))
    length = F.element_at("parts", -1).total
    cut = groups.withColumn("joined", joined).withColumn("complete", F.coalesce(numbered & (length == F.octet_length("joined")), F.lit(False)))
    return whole.unionByName(cut.select(F.col("origin").alias("record_id"), "record_type", "page_id", "url", "refers_to", F.when(F.col("complete"), F.col("joined")).alias("block"), "complete"))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """reassemble(read_records) with the payload in place of the block: what follows the HTTP header, chunk framing decoded."""
    whole = reassemble(read_records(spark, path))
    names = [c for c in whole.columns if c != "block"]

    def payload(block: bytes | None) -> bytes | None:
        if block is None:
            return None
        head, _, body = block.partition(b"\r\n\r\n")
        return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array([payload(x.as_py()) for x in b.column("block")], pa.binary())], [*names, "payload"])

    return whole.mapInArrow(run, whole.drop("block").schema.add("payload", "binary"))


def op4_warc(spark, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    # Digests are written out: both sides of the join below come from one reading.
    read = read_archives(spark, path).select("record_id", "record_type", "page_id", "refers_to", F.octet_length("payload").cast("long").alias("n"), base32(F.sha1("payload")).alias("digest"))
    read = durable(read, "digests")
    remove(path)
    responses = read.filter("record_type = 'response'").select(F.col("record_id").alias("_id"), F.col("page_id").alias("_page"), F.col("n").alias("_n"), F.col("digest").alias("_digest")).dropDuplicates(["_id"])
    out = read.filter("record_type = 'response'").select("page_id", F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    back = read.filter("record_type = 'revisit'").join(responses, F.col("refers_to") == F.col("_id")).select("page_id", F.col("_n").alias("payload_bytes"), F.col("_digest").alias("payload_digest"), "record_type", F.col("_page").alias("refers_to"))
    return out.unionByName(back)


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
m AS (SELECT x, max(page_id) AS newest FROM p GROUP BY x)
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('{ALPHABET}', 1 + ((('0x' || substr(p.x, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1)), '') AS payload_digest,
       CASE WHEN newest IS NOT NULL AND (page_id IS NULL OR page_id < newest) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN newest IS NOT NULL AND (page_id IS NULL OR page_id < newest) THEN newest END AS refers_to
FROM p JOIN m ON p.x = m.x
"""
