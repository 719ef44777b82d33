"""WARC archives: writing pages as records, and reading archives back into payloads.

Writing: each page is one record with an HTTP response in chunked transfer coding. A response
longer than ``SEGMENT`` bytes is cut into a first record and continuation records, all carrying the
segment number, the continuations the identifier of the first, and the last the total length. Of
pages with equal payloads of at least ``LEAST_REVISIT`` bytes, the one with the largest page_id is
stored and the others become revisit records that refer to it. Records end with two line breaks,
which is what Spark's text writer puts after each row, so it writes whole archives, gzipped, into
the shared folder; ``RECORDS`` bounds the records, and so the bytes, of a file.

Reading: files are parsed record by record along their content lengths. Unsegmented records are
decoded at once; segments are grouped by the identifier of their first record, put in order of
segment number and joined, their total length is verified, and the chunked coding is undone. A
record that is incomplete or does not add up raises an error, as does a payload whose SHA-1 differs
from the one its record states.

Nulls: a null html is an empty payload, a null url an empty target, and a null page_id stays null
(it is never referred to). Repeated rows are records of their own; of equal payloads, all rows with the
largest page_id are responses. Empty tables give no rows. Other columns are ignored. Payload groups
are compared by SHA-1 and length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from hashlib import sha1

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, scratch_path, table

LEAST_REVISIT, SEGMENT, CHUNK, RECORDS = 1000, 32_768, 8_192, 500
BREAK = "\r\n\r\n"
_URN = re.compile(r"<urn:page:(-?[0-9]+|null)(?::[0-9]+)?>")


def chunked(text: str) -> str:
    """text in chunked transfer coding, cut between characters; sizes count bytes."""
    parts = (text[i : i + CHUNK // 4] for i in range(0, len(text), CHUNK // 4)) if len(text) * 4 > CHUNK else ([text] if text else [])
    return "".join(f"{len(p.encode()):x}\r\n{p}\r\n" for p in parts) + "0" + BREAK


def unchunk(raw: bytes) -> bytes:
    """The payload of a body in chunked transfer coding; chunk extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = raw.index(b"\r\n", at)
        size = int(raw[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        at = end + 2 + size
        if raw[at : at + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        out.append(raw[end + 2 : at])
        at += 2


def segments(block: str, most: int = SEGMENT) -> list[str]:
    """block cut between characters into pieces of at most ``most`` bytes."""
    if len(block) * 4 <= most or len(raw := block.encode()) <= most:
        return [block]
    out, at = [], 0
    while at < len(raw):
        end = min(at + most, len(raw))
        while end < len(raw) and raw[end] & 0xC0 == 0x80:
            end -= 1
        out.append(raw[at:end].decode())
        at = end
    return out


def record(kind: str, name: str, block: str, *fields: tuple[str, object]) -> str:
    """One record without the two line breaks that follow it."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Date", "2024-01-01T00:00:00Z"), *fields, ("Content-Length", len(block.encode()))]
    return "WARC/1.1\r\n" + "\r\n".join(f"{k}: {v}" for k, v in head) + BREAK + block


def page_records(page: object, url: str, html: str, digest: str, refers: object, serial: int) -> list[str]:
    """The records of one page. serial tells the records of repeated rows apart."""
    name = f"<urn:page:{'null' if page is None else page}:{serial}>"
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    about = [("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", len(html.encode()))]
    if refers is not None:
        block = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8" + BREAK
        return [record("revisit", name, block, *about, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers}>"), ("Content-Type", "application/http; msgtype=response"))]
    block = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked" + BREAK + chunked(html)
    parts = segments(block)
    kind = ("Content-Type", "application/http; msgtype=response")
    if len(parts) == 1:
        return [record("response", name, block, *about, kind)]
    out = [record("response", name, parts[0], *about, ("WARC-Segment-Number", 1), kind)]
    for k, part in enumerate(parts[1:], 2):
        last = [("WARC-Segment-Total-Length", len(block.encode()))] if k == len(parts) else []
        out.append(record("continuation", f"{name[:-1]}-{k}>", part, ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", k), *last))
    return out


def write_archives(pages: DataFrame, path: str) -> None:
    """Writes ``pages`` (page_id, url, html) as archives under path."""
    full = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    full = full.select("*", F.sha1("html").alias("digest"), F.octet_length("html").alias("size"))
    large = full.where(f"size >= {LEAST_REVISIT}")
    first = large.groupBy("digest", "size").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "size", "first")
    refers = large.select("page_id", "digest", "size").join(first, ["digest", "size"]).where("page_id < first or page_id is null").select("page_id", "digest", F.col("first").alias("refers"))
    # One refers_to for each page and content: the thin side of the join below.
    refers = table(refers.distinct(), "revisits")
    full = full.join(refers, (full.page_id.eqNullSafe(refers.page_id)) & (full.digest == refers.digest), "left").select(full.page_id, "url", "html", full.digest, "refers")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        serial = TaskContext.get().partitionId() << 33
        for b in batches:
            for at in range(0, len(b), 500):
                out = []
                for row in zip(*(c.to_pylist() for c in b.slice(at, 500).columns), strict=True):
                    out += page_records(*row, serial)
                    serial += 1
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    full.transform(map_arrow, run, "value string").write.option("lineSep", BREAK).option("compression", "gzip").option("maxRecordsPerFile", RECORDS).text(path)


def parse(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields in lower case, block) of the records of an archive."""
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        lines = raw[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no record where one must begin")
        fields = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
        at = end + 4 + int(fields["content-length"])
        if raw[at : at + 4] != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        yield fields, raw[end + 4 : at]
        at += 4


def _page(urn: str) -> int | None:
    found = _URN.fullmatch(urn)
    if not found:
        raise ValueError(f"no page is named by {urn}")
    return None if found[1] == "null" else int(found[1])


def _decoded(fields: dict[str, str], block: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url) of a whole record."""
    head, _, body = block.partition(b"\r\n\r\n")
    digest, size = fields["warc-payload-digest"].removeprefix("sha1:"), int(fields["x-payload-length"])
    refers = None
    if fields["warc-type"] == "revisit":
        refers = _page(fields["warc-refers-to"])
    else:
        payload = unchunk(body) if b"transfer-encoding: chunked" in head.lower() else body
        if sha1(payload).hexdigest() != digest or len(payload) != size:
            raise ValueError(f"the payload of {fields['warc-record-id']} is not the one stated")
    return _page(fields["warc-record-id"]), size, digest, fields["warc-type"], refers, fields["warc-target-uri"]


_PAGE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
_PAGE_ARROW = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())]
_PIECE = pa.schema([("origin", pa.string()), ("number", pa.int64()), ("total", pa.int64()), ("head", pa.map_(pa.string(), pa.string())), ("block", pa.binary())])


def _parsed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole pages, and the segments of the others, from the bytes of archives."""
    for b in batches:
        for raw in b.column(0):
            data = raw.as_py()
            if data[:2] == b"\x1f\x8b":
                data = zlib.decompress(data, 47)
            pages, pieces = [], []
            for fields, block in parse(data):
                if "warc-segment-number" in fields:
                    kind = fields.get("warc-segment-origin-id", fields["warc-record-id"])
                    pieces.append((kind, int(fields["warc-segment-number"]), int(fields.get("warc-segment-total-length", -1)), list(fields.items()) if fields["warc-type"] != "continuation" else None, block))
                else:
                    pages.append(_decoded(fields, block))
            if not pages and not pieces:
                continue
            page = pa.StructArray.from_arrays([pa.array([*(r[i] for r in pages), *[None] * len(pieces)], t) for i, (_, t) in enumerate(_PAGE_ARROW)], fields=[pa.field(*f) for f in _PAGE_ARROW], mask=pa.array([False] * len(pages) + [True] * len(pieces)))
            piece = pa.StructArray.from_arrays([pa.array([*[None] * len(pages), *(r[i] for r in pieces)], f.type) for i, f in enumerate(_PIECE)], fields=list(_PIECE), mask=pa.array([True] * len(pages) + [False] * len(pieces)))
            yield pa.RecordBatch.from_arrays([page, piece], names=["page", "piece"])


def _joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages out of segments that come in order of origin and number."""
    held: list[dict] = []

    def whole() -> pa.RecordBatch:
        numbers = [x["number"] for x in held]
        if numbers != list(range(1, len(held) + 1)) or held[0]["head"] is None or held[-1]["total"] < 0:
            raise ValueError(f"segments {numbers} of {held[0]['origin']} are not a whole record")
        block = b"".join(x["block"] for x in held)
        if len(block) != held[-1]["total"]:
            raise ValueError(f"the segments of {held[0]['origin']} have {len(block)} bytes, not {held[-1]['total']}")
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip(_decoded(dict(held[0]["head"]), block), _PAGE_ARROW, strict=True)], names=[n for n, _ in _PAGE_ARROW])

    for b in batches:
        for x in b.to_pylist():
            if held and x["origin"] != held[0]["origin"]:
                yield whole()
                held = []
            held.append(x)
    if held:
        yield whole()


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url of all archives under path."""
    raw = spark.read.format("binaryFile").load(path).select("content")
    both = raw.transform(map_arrow, _parsed, f"page struct<{_PAGE.replace(' ', ':').replace(',:', ',')}>, piece struct<origin:string,number:bigint,total:bigint,head:map<string,string>,block:binary>".replace("long", "bigint"))
    both = table(both, "records")
    pieces = both.where("piece is not null").select("piece.*").repartition("origin").sortWithinPartitions("origin", "number")
    return both.where("page is not null").select("page.*").unionByName(pieces.transform(map_arrow, _joined, _PAGE))


def archive_round_trip(pages: DataFrame) -> DataFrame:
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path).drop("url")


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS n FROM pages),
m AS (SELECT *, CASE WHEN n >= {LEAST_REVISIT} THEN max(page_id) OVER (PARTITION BY html) END AS first FROM p)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < first THEN first END AS refers_to FROM m
"""
