"""WARC archives: writing pages as records and reading them back with segment reassembly.

Writing: payloads are compared by SHA-1; of equal ones (of at least
``min_revisit_bytes``) the page with the smallest page_id becomes a response
record, the others revisit records that refer to it. A response's block is an
HTTP message whose body is in chunked transfer framing. A block longer than
``segment_bytes`` is split: the first segment is the response record, the rest
are continuation records that name it as WARC-Segment-Origin-ID. Spark's text
writer puts the records, a line each, into gzip files in the shared folder;
``records_per_file`` bounds a file, since no record is much longer than a
segment.

Reading: files, gzip with a member for each record or for all, or plain, are
parsed record by record; segments are grouped by origin identifier, ordered by
segment number and checked against the total length that the last one states;
then the chunked framing is undone, and the payload's SHA-1 is held against
the record's, where that has one. Records of other archives are read too: only
identifiers made here give a page_id, others (UUIDs) are in ``record_id`` and
``refers_to_id``; other kinds of record (warcinfo, request) are passed over.

Defined results: null html is an empty payload; a null url is given as a URN;
a null page_id is written as ``null`` and read back as null, and ranks last
among equal payloads; repeated rows give a row each; an empty table gives no
rows; other columns play no part. A damaged record raises an error.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import scratch

CRLF = b"\r\n"
CHUNK = 16 << 10
SEGMENT = 32 << 10
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
HTTP_REVISIT = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
RAW = "page_id long, kind string, segment int, origin string, total long, refers_to long, refers_to_id string, digest string, bytes long, block binary"


# --- one record -----------------------------------------------------------


def frame_chunks(body: bytes, size: int = CHUNK) -> bytes:
    out = []
    for at in range(0, len(body), size):
        part = body[at : at + size]
        out += [b"%x" % len(part), CRLF, part, CRLF]
    return b"".join([*out, b"0\r\n\r\n"])


def unframe_chunks(framed: bytes) -> bytes:
    """The body of chunked transfer framing; extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        line = framed.index(CRLF, at)
        size = int(framed[at:line].split(b";")[0], 16)
        at = line + 2
        if not size:
            return b"".join(out)
        if framed[at + size : at + size + 2] != CRLF:
            raise ValueError("a chunk does not end where its size says")
        out.append(framed[at : at + size])
        at += size + 2


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without its last line end, which the text writer adds."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + CRLF


def members(content: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a plain or gzip file piece by piece, one gzip member after another."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    at = 0
    while at < len(content):
        inflate = zlib.decompressobj(31)
        while not inflate.eof and at < len(content):
            yield inflate.decompress(content[at : at + step])
            at += step
        if not inflate.eof:
            raise ValueError("a gzip member ends too early")
        at = min(at, len(content)) - len(inflate.unused_data)
        while content[at : at + 1] == b"\0":  # padding between members
            at += 1


def parse_records(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by name in lower case, block) of each record of some bytes that come in pieces."""
    held, at, passed = bytearray(), 0, 0
    pieces = iter(pieces)

    def fill(until) -> bool:
        """Take more pieces until there is what is looked for."""
        nonlocal at, passed
        del held[:at]
        passed, at = passed + at, 0
        while not until():
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while fill(lambda: re.search(rb"[^\r\n]", held)):
        at = re.search(rb"[^\r\n]", held).start()
        if not fill(lambda: held.find(b"\r\n\r\n") >= 0):
            raise ValueError(f"the record at byte {passed} has no end of its headers")
        end = held.find(b"\r\n\r\n")
        lines = re.sub(r"\r\n[ \t]+", " ", held[:end].decode()).split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {passed}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        at = end + 4
        size = int(headers["content-length"])
        if not fill(lambda: len(held) >= size + 4) or held[size : size + 4] != b"\r\n\r\n":
            raise ValueError(f"the record before byte {passed + size} does not end where its length says")
        yield headers, bytes(held[:size])
        at = size + 4


def _urn(page_id, digest: str) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}:{digest[:8]}>"


def _page(urn: str) -> int | None:
    own = re.fullmatch(r"<urn:page:(-?[0-9]+):[0-9A-Z]+>", urn)
    return int(own[1]) if own else None


def page_records(page_id, url, payload: bytes, refers_to, revisit: bool, segment_bytes: int) -> Iterator[bytes]:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    urn = _urn(page_id, digest)
    target = quote(url, safe=":/?#[]@!$&'()*+,;=%~") if url else urn.strip("<>")
    head = [("WARC-Record-ID", urn), ("WARC-Date", DATE), ("WARC-Target-URI", target), ("Content-Type", "application/http; msgtype=response")]
    about = [("WARC-Payload-Digest", f"sha1:{digest}")]
    if revisit:
        more = [("WARC-Type", "revisit"), ("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(refers_to, digest)), ("X-Payload-Length", str(len(payload)))]
        yield record([*more, *head, *about], HTTP_REVISIT)
        return
    block = HTTP_HEAD + frame_chunks(payload)
    if len(block) <= segment_bytes:
        yield record([("WARC-Type", "response"), *head, *about], block)
        return
    cuts = range(0, len(block), segment_bytes)
    for k, at in enumerate(cuts, 1):
        part = block[at : at + segment_bytes]
        if k == 1:
            yield record([("WARC-Type", "response"), *head, *about, ("WARC-Segment-Number", "1")], part)
            continue
        own = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{urn[1:-1]}:{k}>"), ("WARC-Date", DATE), ("WARC-Target-URI", target)]
        own += [("WARC-Segment-Origin-ID", urn), ("WARC-Segment-Number", str(k))]
        if k == len(cuts):
            own.append(("WARC-Segment-Total-Length", str(len(block))))
        yield record(own, part)


# --- writing --------------------------------------------------------------


def write(pages: DataFrame, path: str, min_revisit_bytes: int = 0, segment_bytes: int = SEGMENT, records_per_file: int = 2000) -> None:
    """Write ``pages`` (page_id, url, html) as WARC files under ``path``."""
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    ids = pages.select("page_id", F.sha1(F.col("html")).alias("digest"), F.octet_length("html").alias("size"))
    ids = ids.where(F.col("size") >= min_revisit_bytes)
    firsts = ids.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # Only later pages of equal payloads; a page that comes twice itself stays a response.
    later = ids.join(firsts, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    later = later.select(F.col("page_id").alias("later_id"), "digest", "refers_to").dropDuplicates(["later_id", "digest"])
    decided = pages.join(
        later,
        pages["page_id"].eqNullSafe(later["later_id"]) & (F.sha1(F.col("html")) == later["digest"]),
        "left",
    ).select("page_id", "url", "html", "refers_to", later["digest"].isNotNull().alias("revisit"))

    def render(batches):
        for batch in batches:
            out, size = [], 0
            for row in range(batch.num_rows):
                page_id, url, html, refers_to, revisit = (batch.column(c)[row].as_py() for c in range(5))
                for data in page_records(page_id, url, html.encode(), refers_to, revisit, segment_bytes):
                    out.append(data)
                    size += len(data)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    records = decided.mapInArrow(render, "value binary").select(F.col("value").cast("string"))
    # A string column carries any bytes to the text writer; level 1 of gzip is enough for markup.
    options = {"compression": "gzip", "lineSep": "\r\n", "maxRecordsPerFile": records_per_file, "zlib.compress.level": "BEST_SPEED"}
    records.write.options(**options).text(path)


# --- reading --------------------------------------------------------------


KINDS_READ = ("response", "revisit", "resource", "continuation")


def _parsed(batches):
    names = [c.split()[0] for c in RAW.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def flush(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    for batch in batches:
        for content in batch.column("content"):
            rows, size = [], 0
            for h, block in parse_records(members(content.as_py())):
                kind = h["warc-type"]
                if kind not in KINDS_READ:
                    continue
                origin = h.get("warc-segment-origin-id", h["warc-record-id"])
                segment = int(h.get("warc-segment-number", 0))
                total = h.get("warc-segment-total-length")
                refers = h.get("warc-refers-to")
                length = h.get("x-payload-length")
                digest = h.get("warc-payload-digest", "sha1:").removeprefix("sha1:").upper() or None
                row = (_page(origin), kind, segment, origin, total and int(total), refers and _page(refers), refers, digest, length and int(length), block)
                rows.append(row)
                size += len(block)
                if size > 8 << 20:
                    yield flush(rows)
                    rows, size = [], 0
            if rows:
                yield flush(rows)


def _decoded(batches):
    for batch in batches:
        col = {n: batch.column(n).to_pylist() for n in ("page_id", "kind", "origin", "refers_to", "refers_to_id", "digest", "bytes")}
        blocks = batch.column("parts")
        sizes, payloads = [], []
        for i, kind in enumerate(col["kind"]):
            if kind == "revisit":
                sizes.append(col["bytes"][i])
                payloads.append(None)
                continue
            payload = b"".join(blocks[i].as_py())
            if kind == "response":
                head, _, payload = payload.partition(b"\r\n\r\n")
                if re.search(rb"(?im)^transfer-encoding:[^\r\n]*chunked", head):
                    payload = unframe_chunks(payload)
            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if col["digest"][i] not in (None, digest):
                raise ValueError(f"the payload of record {col['origin'][i]} does not match its digest")
            col["digest"][i] = digest
            sizes.append(len(payload))
            payloads.append(payload)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(col["page_id"], pa.int64()),
                pa.array(sizes, pa.int64()),
                pa.array(col["digest"], pa.string()),
                pa.array(col["kind"], pa.string()),
                pa.array(col["refers_to"], pa.int64()),
                pa.array(col["origin"], pa.string()),
                pa.array(col["refers_to_id"], pa.string()),
                pa.array(payloads, pa.binary()),
            ],
            ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "refers_to_id", "payload"],
        )


def reassemble(raw: DataFrame) -> DataFrame:
    """Records with their block as ``parts``: one, or the segments in order, checked for gaps and total length."""
    names = ["page_id", "kind", "origin", "refers_to", "refers_to_id", "digest", "bytes"]
    plain = raw.where("segment = 0").select(*names, F.array("block").alias("parts"))
    own = F.col("segment") == 1  # the origin record: it alone has the record's kind and digest
    grouped = raw.where("segment > 0").groupBy("origin").agg(
        F.sort_array(F.collect_set(F.struct("segment", "block"))).alias("parts"),
        F.max("total").alias("total"),
        *(F.max(F.when(own, F.col(n))).alias(n) for n in names if n != "origin"),
        F.sum(own.cast("int")).alias("times"),
    )
    numbered = F.forall(F.transform("parts", lambda p, i: p["segment"] == i + 1), lambda ok: ok)
    length = F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + F.octet_length(p["block"]))
    sound = numbered & F.coalesce(length == F.col("total"), F.lit(False))
    checked = F.when(sound, F.col("parts.block")).otherwise(F.raise_error(F.concat(F.lit("segments missing of "), F.col("origin"))))
    joined = grouped.select(*names, checked.alias("parts"), "times")
    joined = joined.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times", "time")
    return plain.unionByName(joined)


def read(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, refers_to_id, payload (null for revisits).

    A file is one row of a task, a record's block another: files of other
    origin should be of the usual size, a gigabyte at most.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    raw = files.mapInArrow(_parsed, RAW)
    out = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, refers_to_id string, payload binary"
    return reassemble(raw).mapInArrow(_decoded, out)


def op4_warc(spark, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read(spark, path).drop("payload", "record_id", "refers_to_id")


#: DuckDB has no base32; tests hold the result against hashlib.
ORACLE_SQL: dict = {}
QUERIES = {"op4_warc": op4_warc}
