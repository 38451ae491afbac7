"""WARC records, and derived metadata and plain-text conversion records (operator 5)."""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as entities
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, saved

CRLF = "\r\n"
#: Date of records that have none of their own.
EPOCH = "1970-01-01T00:00:00Z"
_DROPPED = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.I | re.S)
_BLOCK = re.compile(r"</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>", re.I)
_TAG = re.compile(r"</?[A-Za-z!?][^>]*>")
_SPACE = re.compile(r"[^\S\n]+")
_LINES = re.compile(r" ?\n[ \n]*")
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.I | re.S)
_LINK = re.compile(r"""<a\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_CHARSET = re.compile(r"""charset\s*=\s*["']?([^\s"';,]+)""", re.I)
_LANG = re.compile(r"""<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z-]+)""", re.I)

def _schema(strings: str, **others: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, others.get(name, T.StringType())) for name in strings.split()])


RESPONSE = _schema("page_id record_id target_uri warc_date warc_headers http_headers body", page_id=T.LongType(), body=T.BinaryType())
RECORD = _schema(
    "page_id record_type record_id refers_to target_uri warc_date content_type source_headers source_digest block_digest content_length content",
    page_id=T.LongType(),
    content_length=T.LongType(),
)


def digest(data: bytes) -> str:
    """A labelled digest as WARC files carry it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    """A record id that follows from its parts alone, so that reruns agree."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join('' if p is None else str(p) for p in parts))}>"


def plain_text(source: str) -> str:
    """Visible text of a page: a line for each block, entities decoded, spaces collapsed."""
    text = _TAG.sub("", _BLOCK.sub("\n", _DROPPED.sub(" ", source)))
    text = _SPACE.sub(" ", entities.unescape(text))
    return _LINES.sub("\n", text).strip()


def _header_map(lines: str | None) -> dict[str, str]:
    pairs = (x.partition(":") for x in (lines or "").split(CRLF) if ":" in x)
    return {a.strip(): b.strip() for a, _, b in pairs}


def decoded(body: bytes, http_headers: str | None) -> str:
    """Text of a body, without its content coding and in the charset that the headers name; UTF-8 without one, bad bytes replaced.

    A body that isn't in the coding that is named is taken as it is.
    """
    fields = {k.lower(): v for k, v in _header_map(http_headers).items()}
    coding = fields.get("content-encoding", "").lower()
    if coding in ("gzip", "x-gzip", "deflate"):
        for wbits in (47, -15):
            try:
                body = zlib.decompressobj(wbits).decompress(body)
                break
            except zlib.error:
                continue
    charset = _CHARSET.search(fields.get("content-type", ""))
    try:
        return body.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def metadata(source: str, http_headers: str | None, warc_headers: str | None) -> str:
    """JSON of the source's headers and of the page's title, language and links."""
    title, lang = _TITLE.search(source), _LANG.search(source)
    links = [a or b or c for a, b, c in _LINK.findall(_DROPPED.sub(" ", source))]
    status = (http_headers or "").split(CRLF, 1)[0]
    page = {"Title": entities.unescape(title[1]).strip() if title else None, "Lang": lang[1] if lang else None, "Links": [entities.unescape(x) for x in links]}
    envelope = {"WARC-Header-Metadata": _header_map(warc_headers), "Payload-Metadata": {"HTTP-Response-Metadata": {"Response-Message": status, "Headers": _header_map(http_headers), "HTML-Metadata": page}}}
    return json.dumps({"Envelope": envelope}, ensure_ascii=False)


def responses(pages: DataFrame, broadcast_rows: int = 100_000) -> DataFrame:
    """A response record for every row of (page_id, url, html); a null page has an empty body.

    A record's id follows from its page, and for a page that is there several times from the copy's number too.  Repeated pages are told by their
    digests; beyond ``broadcast_rows`` of them they are found by a shuffle.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    names = ["page_id", "url", "digest"]
    keys = rows.select("page_id", "url", F.sha2(F.coalesce("html", F.lit("")), 256).alias("digest"))
    often = saved(keys.groupBy(*names).agg(F.count("*").alias("copies")).where("copies > 1"))
    once = rows.withColumn("copy", F.lit(0).cast("long"))
    n = often.count()
    if n:
        told = often.select(F.struct(*names).alias("_key"), "copies")
        told = F.broadcast(told) if n <= broadcast_rows else told
        own = F.struct("page_id", "url", F.sha2(F.coalesce("html", F.lit("")), 256).alias("digest"))
        marked = rows.withColumn("_own", own).join(told, F.col("_own").eqNullSafe(F.col("_key")), "left")
        # copies are all alike, so that one of them is numbered as often as there are copies
        one = marked.where("copies is not null").dropDuplicates(["_own"]).select("page_id", "url", "html", F.explode(F.expr("sequence(0L, copies - 1)")).alias("copy"))
        once = marked.where("copies is null").select("page_id", "url", "html", F.lit(0).cast("long").alias("copy")).union(one)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page, url, source, copy in zip(*(batch.column(i).to_pylist() for i in range(4))):
                raw = (source or "").encode("utf-8", "replace")
                own = record_id("response", page, url, digest(raw), *[copy] * (copy > 0))
                http = CRLF.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(raw)}"])
                fields = [f"WARC-Payload-Digest: {digest(raw)}", f"WARC-Block-Digest: {digest((http + CRLF + CRLF).encode() + raw)}"]
                out.append((page, own, url, EPOCH, CRLF.join(fields), http, raw))
            yield from _batches(out, RESPONSE)

    return once.mapInArrow(lean(run), RESPONSE)


def _batches(rows: list[tuple], schema: T.StructType) -> Iterator[pa.RecordBatch]:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    arrays = [pa.array(c, kinds[f.dataType.typeName()]) for c, f in zip(columns, schema)]
    yield pa.RecordBatch.from_arrays(arrays, schema.names)


def derive(source: DataFrame) -> DataFrame:
    """A metadata and a conversion record for every response record.

    Both carry the response's id in ``refers_to`` (and the same target and date), its WARC and HTTP
    headers in ``source_headers`` and the digest of its body's bytes in ``source_digest``; the digest and length of
    their own block follow.  Ids depend on the response's id alone.  A body of any length is read whole, without its content coding and
    in the charset that its headers name.  A null body counts as empty
    and gives an empty conversion, a null url stays null, repeated responses give repeated records, an
    empty table gives none; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for page, own, url, date, warc, http, body in zip(*(batch.column(i).to_pylist() for i in range(7))):
                headers = CRLF.join(x for x in (warc, http) if x)
                payload = digest(body or b"")
                text = decoded(body or b"", http)
                for kind, mime, content in (("metadata", "application/json", metadata(text, http, warc)), ("conversion", "text/plain", plain_text(text))):
                    block = content.encode("utf-8", "replace")
                    rows.append((page, kind, record_id(kind, own), own, url, date, mime, headers, payload, digest(block), len(block), block.decode()))
                    size += len(block)
                if size > 8 << 20:
                    yield from _batches(rows, RECORD)
                    rows, size = [], 0
            yield from _batches(rows, RECORD)

    return source.select(*RESPONSE.names).mapInArrow(lean(run), RECORD)


def _one_line(value: object) -> str:
    return re.sub(r"[\r\n]+", " ", str(value))


def as_bytes(kind: str, own: str, fields: list[tuple[str, object]], block: bytes) -> bytes:
    """One record, with the two line ends that close it."""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {own}", *[f"{k}: {_one_line(v)}" for k, v in fields if v is not None], f"Content-Length: {len(block)}"]
    return (CRLF.join(head) + CRLF + CRLF).encode("utf-8", "replace") + block + (CRLF + CRLF).encode()


def _member(record: bytes) -> bytes:
    """A gzip member without its last byte, which is a zero: the top of the record's length, or, for one of 16 MB or more, that of an empty member."""
    data = gzip.compress(record, 6, mtime=0)
    return data[:-1] if data[-1] == 0 else data + gzip.compress(b"", 6, mtime=0)[:-1]


def write_warc(df: DataFrame, path: str, compression: str = "gzip") -> None:
    """Writes response or derived records as WARC files, one for each partition, by Spark's own writer.

    With ``gzip`` each record is a member of its own.
    """
    derived = "record_type" in df.columns
    names = RECORD.names if derived else RESPONSE.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(len(names)))):
                r = dict(zip(names, row))
                common = [("WARC-Target-URI", r["target_uri"]), ("WARC-Date", r["warc_date"]), ("X-Page-ID", r["page_id"])]
                if derived:
                    lines = [("WARC-Refers-To", r["refers_to"]), *common, ("Content-Type", r["content_type"]), ("WARC-Block-Digest", r["block_digest"]), ("X-Source-Digest", r["source_digest"]), ("X-Source-Headers", json.dumps(r["source_headers"]))]
                    record = as_bytes(r["record_type"], r["record_id"], lines, r["content"].encode())
                else:
                    lines = [*common, ("Content-Type", "application/http; msgtype=response"), *_header_map(r["warc_headers"]).items()]
                    record = as_bytes("response", r["record_id"], lines, ((r["http_headers"] or "") + CRLF + CRLF).encode() + (r["body"] or b""))
                # the writer's separator is the end of a record or of a member
                out.append(_member(record) if compression == "gzip" else record[:-4])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    # the cast keeps the bytes as they are, and the text writer writes them so
    lines = df.select(*names).mapInArrow(lean(run), "value binary").select(F.col("value").cast("string").alias("value"))
    lines.write.option("lineSep", "\0" if compression == "gzip" else CRLF + CRLF).text(path)


def _members(data: bytes) -> Iterator[bytes]:
    """The parts of a gzip file; a plain one is one part."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    view = memoryview(data)
    at = 0
    while at < len(view):
        member = zlib.decompressobj(31)
        parts, piece = [], b""
        while not member.eof:
            piece = member.unconsumed_tail or view[at : at + (1 << 20)]
            if not len(piece):
                raise ValueError("a gzip member does not end")
            if not member.unconsumed_tail:
                at += len(piece)
            parts.append(member.decompress(piece))
        at -= len(member.unused_data)
        yield b"".join(parts)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a WARC file, plain or gzipped; blocks are cut by their length.

    A file whose members are records is decompressed record by record; others are joined as far as a record needs.
    """
    left, parts, ended = b"", _members(data), False
    while True:
        at = left.find(b"WARC/")
        end = left.find(b"\r\n\r\n", at) if at >= 0 else -1
        size = int(_header_map(left[at:end].decode("utf-8", "replace"))["Content-Length"]) if end >= 0 else None
        if size is None or end + 4 + size > len(left):
            if not ended:
                more = next(parts, None)
                ended = more is None
                left += more or b""
                continue
            if at < 0:
                return
            raise ValueError("a record's header does not end" if end < 0 else "a record is shorter than its length")
        yield _header_map(left[at:end].decode("utf-8", "replace")), left[end + 4 : end + 4 + size]
        left = left[end + 4 + size :]


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """The response records of WARC files, read through Spark's file systems; a file is one task's, and is held compressed."""
    not_own = ("WARC-Type", "WARC-Record-ID", "WARC-Target-URI", "WARC-Date", "X-Page-ID", "Content-Type", "Content-Length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for h, block in parse(content.as_py()):
                    if h.get("WARC-Type") != "response":
                        continue
                    head, _, body = block.partition(b"\r\n\r\n")
                    rest = CRLF.join(f"{k}: {v}" for k, v in h.items() if k not in not_own)
                    page = h.get("X-Page-ID")
                    rows.append((int(page) if page else None, h["WARC-Record-ID"], h.get("WARC-Target-URI"), h.get("WARC-Date"), rest, head.decode("utf-8", "replace"), body))
                    size += len(body)
                    if size > 8 << 20:
                        yield from _batches(rows, RESPONSE)
                        rows, size = [], 0
                yield from _batches(rows, RESPONSE)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(lean(run), RESPONSE)
