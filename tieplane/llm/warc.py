"""WARC archives: writing pages, reading them back, reassembly of segments and chunked bodies."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, lookup

#: Bytes of a record's block from which it is cut into segments, and bytes of a chunk of a body.
SEGMENT, CHUNK = 16 << 10, 4 << 10
#: Records of a file, which one task reads whole: 33 MB at most, as a record has up to SEGMENT bytes and its headers.
PER_FILE = 2_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def chunked(body: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%s\r\n" % (len(c), c) for c in (body[i : i + size] for i in range(0, len(body), size))]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(data: bytes) -> bytes:
    """The body of chunked framing; extensions and trailers are skipped, anything cut short is an error."""
    out, at = [], 0
    while True:
        end = data.index(b"\r\n", at)
        size = int(data[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        chunk = data[end + 2 : end + 2 + size]
        if len(chunk) != size or data[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk is cut short")
        out.append(chunk)
        at = end + 4 + size


def body_of(block: bytes) -> bytes:
    """The payload of an HTTP response."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("a response has no end of its headers")
    fields = dict(line.lower().split(b":", 1) for line in head.split(b"\r\n")[1:] if b":" in line)
    return unchunked(body) if b"chunked" in fields.get(b"transfer-encoding", b"") else body


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(kind: str, name: str, block: bytes, **fields: str | None) -> bytes:
    own = {"WARC-Type": kind, "WARC-Record-ID": f"<{name}>", "WARC-Date": "1970-01-01T00:00:00Z", **{"WARC-" + k.replace("_", "-"): v for k, v in fields.items() if v is not None}, "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in own.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def records_of(name: str, uri: str, payload: bytes | None, digest: str, refers_to: str | None, segment: int = SEGMENT) -> Iterator[bytes]:
    """A response in one or more segments, or a revisit."""
    if refers_to is not None:
        yield _record("revisit", name, HEAD + b"\r\n", Target_URI=uri, Payload_Digest=f"sha1:{digest}", Profile=PROFILE, Refers_To=f"<{refers_to}>")
        return
    block = HEAD + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload or b"")
    if len(block) <= segment:
        yield _record("response", name, block, Target_URI=uri, Payload_Digest=f"sha1:{digest}")
        return
    cuts = range(0, len(block), segment)
    for k, at in enumerate(cuts, 1):
        total = str(len(block)) if k == len(cuts) else None
        if k == 1:
            yield _record("response", name, block[:segment], Target_URI=uri, Payload_Digest=f"sha1:{digest}", Segment_Number="1")
        else:
            yield _record("continuation", f"{name}/{k}", block[at : at + segment], Target_URI=uri, Segment_Number=str(k), Segment_Origin_ID=f"<{name}>", Segment_Total_Length=total)


def inflate(data: bytes) -> Iterator[bytes]:
    """Pieces of a file's content: as it is, or of all gzip members one after the other."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    while data.strip(b"\0"):
        z = zlib.decompressobj(31)
        while not z.eof:
            piece = z.decompress(data, 4 << 20)
            yield piece
            if not piece and not z.eof and not z.unconsumed_tail:
                raise ValueError("a gzip member is cut short")
            data = z.unconsumed_tail
        data = z.unused_data


def parse(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record, holding one record and one piece at a time."""
    buffer, at = bytearray(), 0

    def fill(n: int) -> bool:
        """Has n bytes from ``at`` on, dropping what lies before it."""
        nonlocal at
        while len(buffer) < at + n:
            if (piece := next(pieces, None)) is None:
                return False
            del buffer[:at]
            at = 0
            buffer.extend(piece)
        return True

    while True:
        while fill(1) and buffer[at] in b"\r\n":
            at += 1
        if at >= len(buffer):
            return
        while (end := buffer.find(b"\r\n\r\n", at)) < 0:
            if not fill(len(buffer) - at + 1):
                raise ValueError("a record's headers are cut short")
        lines = bytes(buffer[at:end]).decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        size, at = int(fields["content-length"]), end + 4
        if not fill(size):
            raise ValueError("a record's block is cut short")
        yield fields, bytes(buffer[at : at + size])
        at += size


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, segment: int = SEGMENT) -> None:
    """Writes gzipped WARC files, a record per row, through Spark's own writer, so any store will do.

    Of rows with equal payloads of at least ``min_bytes`` bytes the one with the largest id is the response,
    the others revisit it. Rows that repeat id and payload of the largest are responses too.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload")).withColumn("bytes", F.octet_length("payload"))
    same = rows.select("page_id", "sha", "bytes").filter(F.col("bytes") >= min_bytes)
    groups = (
        same.groupBy("sha", "page_id").agg(F.count(F.lit(1)).alias("n")).groupBy("sha")
        .agg(F.max(F.struct("page_id", "n")).alias("top"), F.sum("n").alias("copies")).filter("copies > 1")
        .select("sha", F.col("top.page_id").alias("keep"), F.col("top.n").alias("repeats"), "copies")
    )
    told = lookup(rows, groups, ["sha"], "copies", pages.count())
    revisit = (F.col("copies").isNotNull() & (F.col("bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("keep")))
    told = told.select("page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "sha", revisit.alias("revisit"), "keep", F.coalesce("repeats", F.lit(1)).alias("repeats"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count = TaskContext.get().partitionId(), 0
        for batch in (b.slice(lo, 256) for b in batches for lo in range(0, b.num_rows, 256)):
            out, size = [], 0
            for page, url, payload, sha, again, keep, repeats in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                count += 1
                name = f"urn:x-page:{page}:{sha}" + (f":{task}.{count}" if repeats > 1 and not again else "")
                uri = "".join(c if c > " " else f"%{ord(c):02X}" for c in url) if url else f"urn:x-page:{page}"
                for record in records_of(name, uri, payload, base64.b32encode(bytes.fromhex(sha)).decode(), f"urn:x-page:{keep}:{sha}" if again else None, segment):
                    out.append(record[:-1])  # the writer ends each with the last line feed
                    size += len(record)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    lines = told.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    lines.write.option("compression", "gzip").option("lineSep", "\n").option("maxRecordsPerFile", PER_FILE).text(path)


PARSED = "name string, kind string, refers_to string, digest string, origin string, number int, total long, payload_bytes long, block binary"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record but continuations: name, kind, refers_to, digest, payload_bytes, payload.

    Complete records are decoded where they are read. Segments are grouped by the record they continue,
    ordered by number, checked to be gapless and as long in total as the last one says, then decoded. A
    payload whose digest is not the one of its record is an error.
    """
    parsed, payload_of = _parsed(spark, path, keep=True), "payload binary"
    return _whole(parsed, payload_of)


def _parsed(spark: SparkSession, path: str, keep: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 5 + [pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        names = [c.split(" ")[0] for c in PARSED.split(", ")]

        def batch_of(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for fields, block in parse(inflate(content.as_buffer().to_pybytes())):
                    bare = lambda k, f=fields: f[k].strip("<>") if k in f else None
                    name, kind, number = bare("warc-record-id"), fields.get("warc-type"), fields.get("warc-segment-number")
                    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    if number:
                        total = fields.get("warc-segment-total-length")
                        rows.append((name, kind, None, digest, bare("warc-segment-origin-id") or name, int(number), int(total) if total else None, None, block))
                    elif kind == "response":
                        body = body_of(block)
                        if digest and digest_of(body) != digest:
                            raise ValueError(f"{name}: payload and digest differ")
                        rows.append((name, kind, None, digest_of(body), None, None, None, len(body), body if keep else None))
                    else:
                        rows.append((name, kind, bare("warc-refers-to"), digest, None, None, None, None, None))
                    size += len(block)
                    if size > 4 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, PARSED)


def reassemble(name: str, parts: list[tuple]) -> tuple[bytes, str]:
    """The payload of segments (number, total, digest, block) in the order of their numbers, and its digest."""
    block = b"".join(p[3] for p in parts)
    if [p[0] for p in parts] != [*range(1, len(parts) + 1)] or parts[-1][1] != len(block):
        raise ValueError(f"{name}: segments are missing, repeated or of another length")
    body = body_of(block)
    if parts[0][2] and digest_of(body) != parts[0][2]:
        raise ValueError(f"{name}: payload and digest differ")
    return body, digest_of(body)


def _whole(parsed: DataFrame, also: str = "") -> DataFrame:
    """Segments come sorted by origin and number, so that a task holds the segments of one record at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        names = ["name", "kind", "refers_to", "digest", "payload_bytes", "payload"]
        origin, parts = None, []

        def record() -> pa.RecordBatch:
            body, digest = reassemble(origin, parts)
            row = (origin, "response", None, digest, len(body), body)[: 6 if also else 5]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=False)], names[: len(row)])

        for batch in (b.slice(lo, 64) for b in batches for lo in range(0, b.num_rows, 64)):
            for key, *part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != origin and parts:
                    yield record()
                    parts = []
                origin = key
                parts.append(part)
        if parts:
            yield record()

    schema = "name string, kind string, refers_to string, digest string, payload_bytes long" + (", " + also) * bool(also)
    segments = parsed.filter("origin IS NOT NULL").select("origin", "number", "total", "digest", "block")
    parts = int(parsed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    joined = segments.repartition(parts, "origin").sortWithinPartitions("origin", "number").mapInArrow(run, schema)
    single = parsed.filter("origin IS NULL").select("name", "kind", "refers_to", "digest", "payload_bytes", *([F.col("block").alias("payload")] if also else []))
    return single.unionByName(joined)


def warc_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Writes a record per page, reads the archives back and describes what they hold.

    Returns page_id, payload_bytes, payload_digest (base32 SHA-1), record_type, refers_to. Null html is an
    empty payload, null urls get a URN, a null page_id loses against any other. A revisit's length and digest
    are those of the response that it refers to. Very long payloads are cut into segments and joined again; repeated rows
    are records of their own, one of which the others revisit; an empty table gives no rows; other columns are ignored.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    write_archives(pages, scratch.path("archives"), id_col, url_col, html_col, min_bytes)
    parsed = scratch.keep(_parsed(spark, scratch.path("archives"), keep=False), "parsed")
    rows = scratch.keep(_whole(parsed), "rows")
    scratch.drop("archives", "parsed")
    scratch.release()
    part = lambda c, i: F.split(c, ":")[i]
    number = lambda c: F.expr(f"try_cast(split({c}, ':')[2] AS long)")
    responses = rows.filter("kind = 'response'")
    revisits = rows.filter("kind = 'revisit'").select("name", "refers_to")
    stored = responses.select(F.concat_ws(":", *(part("name", i) for i in range(4))).alias("refers_to"), "payload_bytes", "digest").distinct()
    targets = revisits.groupBy("refers_to").agg(F.count(F.lit(1)).alias("copies")).join(stored, "refers_to")
    found = lookup(revisits, targets, ["refers_to"], "copies", rows.count())
    columns = [F.col("payload_bytes"), F.col("digest").alias("payload_digest")]
    return responses.select(number("name").alias("page_id"), *columns, F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")).unionByName(
        found.select(number("name").alias("page_id"), *columns, F.lit("revisit").alias("record_type"), number("refers_to").alias("refers_to"))
    )


_BITS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(sha, {5 * i + 1}, 5))::BIGINT >> {s}) & 31)::INT + 1, 1)" for i in range(8) for s in (15, 10, 5, 0)
)
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS sha, max(page_id) OVER (PARTITION BY html) AS keep FROM p)
SELECT page_id, payload_bytes, {_BITS} AS payload_digest, CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keep THEN keep END AS refers_to
FROM d
"""
