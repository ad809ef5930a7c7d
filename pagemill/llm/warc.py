"""WARC derivatives: from response records to linked metadata records and plain-text conversion records.

A record is its named fields, in order and as often as they stand, and a block. responses() makes response records of pages
(HTTP head and body); parse() reads records of WARC/1.1 bytes, plain or one gzip member each; derive() turns one response into

- a metadata record (application/warc-fields): title, language, charset, outlinks, the HTTP status and headers of the source;
- a conversion record (text/plain): the visible text of an HTML body, any other text as it is, in UTF-8. A body that is no text
  (an image, say) has no conversion record.

Both refer to the response by WARC-Refers-To, WARC-Refers-To-Target-URI and WARC-Refers-To-Date, keep its target URI, date
and payload digest (as Source-Payload-Digest and Source-Block-Digest), and carry digests of their own block. Identifiers
are name-based, so reruns give the same records. Digests are sha1 in base 32. Bodies sent in chunks or compressed by gzip or
deflate are unpacked for their text; digests are of what was sent.

Bad input never ends a job: a record without a usable length, head or gzip member gives one row of type `unreadable` and
reading goes on at the next record; a body that cannot be unpacked or decoded is read as far as it goes, with replacement
characters. Unclosed comments, scripts and titles run to the end, and all searches are linear in the length of the body.

Nulls: a null body is an empty one, a null address leaves the target fields out, a null page id is carried through, null
bytes hold no record. Repeated pages give repeated records of the same identifiers. Very long bodies are converted whole.
Columns beside the named ones are not read, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import lean, slices

DATE = "2024-01-01T00:00:00Z"
_HIDDEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<(script|style|template|noscript)\b(?:.*?</\1\s*>|.*\Z)|<title\b(?:.*?</title\s*>|.*\Z)|<!doctype[^>]*(?:>|\Z)", re.I | re.S)
_BREAK = re.compile(r"</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)\b[^>]*>", re.I)
_TAG = re.compile(r"</?[a-z][^>]*>", re.I)
_TITLE = re.compile(r"<title\b[^>]*>(.*?)(?:</title\s*>|\Z)", re.I | re.S)
_HTML, _ANCHOR = re.compile(r"<html\b[^>]*>", re.I), re.compile(r"<a\b[^>]*>", re.I)
_LANG = re.compile(r"\blang\s*=\s*[\"']?([\w-]+)", re.I)
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)
_HREF = re.compile(r"\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_LOOKS_LIKE_HTML = re.compile(r"\s*(?:<!doctype\s+html|<(?:html|head|body|title|p|div|a|h1|table|script|meta)\b)", re.I)
_TEXTUAL = re.compile(r"text/|application/(?:[\w.+-]*(?:xml|json|javascript))", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def identifier(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(10).join(parts))}>"


@dataclass
class Record:
    """Named fields (names in any case, repeated ones kept) and a block; broken: what could not be read."""

    fields: list[tuple[str, str]] = field(default_factory=list)
    block: bytes = b""
    broken: bool = False

    def get(self, name: str, default: str | None = None) -> str | None:
        return next((v for k, v in self.fields if k.lower() == name.lower()), default)

    def dump(self) -> bytes:
        head = "".join(f"{k}: {v}\r\n" for k, v in self.fields)
        return f"WARC/1.1\r\n{head}\r\n".encode() + self.block + b"\r\n\r\n"


def response(url: str | None, body: bytes, date: str = DATE, content_type: str = "text/html; charset=utf-8") -> Record:
    block = f"HTTP/1.1 200 OK\r\nContent-Type: {content_type}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
    names = {"WARC-Type": "response", "WARC-Record-ID": identifier("response", url or "", date, digest(block)), "WARC-Date": date}
    if url is not None:
        names["WARC-Target-URI"] = re.sub(r"[\r\n]+", " ", url)
    names |= {"WARC-Payload-Digest": digest(body), "WARC-Block-Digest": digest(block), "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return Record(list(names.items()), block)


def _members(data: bytes) -> Iterator[bytes | None]:
    """The contents of gzip members one after another; None for one that cannot be unpacked, after which the next is looked for."""
    while data:
        one = zlib.decompressobj(31)
        try:
            part = one.decompress(data) + one.flush()
            yield part if one.eof else None
            data = one.unused_data
        except zlib.error:
            yield None
            at = data.find(b"\x1f\x8b\x08", 1)
            data = data[at:] if at > 0 else b""


def parse(data: bytes) -> Iterator[Record]:
    """All records of WARC bytes; what is none, or has no usable length, gives a broken record as far as the next one."""
    if data[:2] == b"\x1f\x8b":
        for part in _members(data):
            yield from [Record(broken=True)] if part is None else parse(part)
        return
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = re.sub(r"\r\n[ \t]+", " ", data[at:end].decode("utf-8", "replace")).split("\r\n") if end >= 0 else [""]
        names = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:])]
        size = next((v for k, v in names if k.lower() == "content-length"), "")
        if lines[0].startswith("WARC/") and re.fullmatch(r"[0-9]{1,18}", size) and end + 4 + int(size) <= len(data):
            yield Record(names, data[end + 4 : end + 4 + int(size)])
            at = end + 4 + int(size)
            while data[at : at + 2] == b"\r\n":
                at += 2
        else:
            yield Record(broken=True)
            after = data.find(b"\r\n\r\nWARC/", at)
            at = after + 4 if after >= 0 else len(data)


def _unchunked(body: bytes) -> bytes:
    """The chunks of a body put together; as far as they can be read."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        size = body[at:end].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9a-fA-F]{1,15}", size) or not int(size, 16):
            break
        out.append(body[end + 2 : end + 2 + int(size, 16)])
        at = end + 2 + int(size, 16) + 2
    return b"".join(out)


def _inflated(body: bytes, how: str) -> bytes:
    for bits in (31, 15, -15) if how == "deflate" else (31,):
        one = zlib.decompressobj(bits)
        try:
            return one.decompress(body) + one.flush()
        except zlib.error:
            continue
    return body


def http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and body, as sent, of an HTTP message."""
    head, _, body = block.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    return lines[0], [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:])], body


def content(headers: list[tuple[str, str]], body: bytes) -> bytes:
    """The body without chunks and compression."""
    named = lambda name: next((v.lower() for k, v in headers if k.lower() == name), "")
    if "chunked" in named("transfer-encoding"):
        body = _unchunked(body)
    for how in reversed([x.strip() for x in named("content-encoding").split(",")]):
        body = _inflated(body, "deflate" if how == "deflate" else "gzip") if how in ("gzip", "x-gzip", "deflate") else body
    return body


def _folded(line: str) -> str:
    return " ".join(line.split())


def visible(text: str) -> str:
    """Text of HTML: no scripts, styles, comments or title; block elements break lines; entities resolved; blanks folded."""
    text = _HIDDEN.sub(" ", text)
    last = text.rfind(">") + 1  # no tag ends behind it, so none is looked for
    text = _TAG.sub("", _BREAK.sub("\n", text[:last])) + text[last:]
    return "\n".join(filter(None, map(_folded, html.unescape(text).split("\n"))))


def derive(source: Record) -> list[Record]:
    """The metadata record of a response and, if its body is text, the conversion record."""
    status, headers, sent = http(source.block)
    body = content(headers, sent)
    kind = next((v for k, v in headers if k.lower() == "content-type"), "")
    charset = (_CHARSET.search(kind) or _CHARSET.search(body[:2048].decode("ascii", "replace")) or [None, "utf-8"])[1]
    try:
        text = body.decode(charset, "replace")
    except (LookupError, UnicodeError):
        text = body.decode("utf-8", "replace")
    is_html = "html" in kind.lower() or not kind and bool(_LOOKS_LIKE_HTML.match(text))
    of, date = source.get("WARC-Record-ID", identifier("unnamed", digest(source.block))), source.get("WARC-Date", DATE)
    lines = [("http-status", status), *((f"http-header-{k.lower()}", v) for k, v in headers), ("charset", charset)]
    if is_html:
        tags = text[: text.rfind(">") + 1]
        if (top := _HTML.search(tags)) and (lang := _LANG.search(top[0])):
            lines.append(("language", lang[1]))
        if title := _TITLE.search(tags):
            lines.append(("title", _folded(html.unescape(title[1]))))
        found = (_HREF.search(m[0]) for m in _ANCHOR.finditer(tags))
        lines += [("outlink", html.unescape(next(filter(None, m.groups()), ""))) for m in found if m]
    meta = "".join(f"{k}: {v.replace(chr(13), ' ').replace(chr(10), ' ')}\r\n" for k, v in lines).encode("utf-8", "replace")
    uri = source.get("WARC-Target-URI")
    where = [("WARC-Target-URI", uri)] if uri is not None else []
    back = [("WARC-Refers-To", of), ("WARC-Refers-To-Date", date)] + [("WARC-Refers-To-Target-URI", uri) for _ in where]
    digests = [("Source-Payload-Digest", source.get("WARC-Payload-Digest") or digest(sent)), ("Source-Block-Digest", source.get("WARC-Block-Digest") or digest(source.block))]

    def made(what: str, content_type: str, block: bytes) -> Record:
        names = [("WARC-Type", what), ("WARC-Record-ID", identifier(what, of)), ("WARC-Date", date), *where, *back, *digests]
        return Record([*names, ("WARC-Block-Digest", digest(block)), ("Content-Type", content_type), ("Content-Length", str(len(block)))], block)

    out = [made("metadata", "application/warc-fields", meta)]
    if is_html or not kind or _TEXTUAL.match(kind):
        out.append(made("conversion", "text/plain; charset=utf-8", (visible(text) if is_html else text).encode("utf-8", "replace")))
    return out


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> DataFrame:
    """One response record for each page: id, record (WARC bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            made = [response(u, (x or "").encode("utf-8", "surrogatepass"), date).dump() for u, x in zip(b.column("url").to_pylist(), b.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(made, pa.binary())], ["id", "record"])

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(run), "id long, record binary").withColumnRenamed("id", id_col)


FIELDS = ["record_type", "record_id", "refers_to", "target_uri", "warc_date", "source_payload_digest", "source_block_digest", "block_digest", "content_type"]


def derivatives(records: DataFrame, id_col: str = "page_id", record_col: str = "record", keep_record: bool = True, level: int = 3) -> DataFrame:
    """The derived records of each response among the WARC bytes of a row: named fields, n_bytes, block and record (a gzip member).

    Records of other types give nothing; one that cannot be read gives a row of record_type `unreadable`, all else null.
    """
    names = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To", "target_uri": "WARC-Target-URI", "warc_date": "WARC-Date", "source_payload_digest": "Source-Payload-Digest", "source_block_digest": "Source-Block-Digest", "block_digest": "WARC-Block-Digest", "content_type": "Content-Type"}
    kinds = [pa.int64(), *[pa.string()] * len(FIELDS), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "record"):
            rows = []
            for i, data in zip(b.column("id").to_pylist(), b.column("record").to_pylist(), strict=True):
                for source in parse(data or b""):
                    if source.broken:
                        rows.append((i, "unreadable", *[None] * (len(kinds) - 2)))
                    elif source.get("WARC-Type") == "response":
                        rows += [(i, *[r.get(names[c]) for c in FIELDS], len(r.block), r.block.decode() if keep_record else None, gzip.compress(r.dump(), level, mtime=0) if keep_record else None) for r in derive(source)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["id", *FIELDS, "n_bytes", "block", "record"])

    schema = "id long, " + ", ".join(f"{c} string" for c in FIELDS) + ", n_bytes long, block string, record binary"
    out = records.select(F.col(id_col).cast("long").alias("id"), F.col(record_col).cast("binary").alias("record")).mapInArrow(lean(run), schema)
    return (out if keep_record else out.drop("block", "record")).withColumnRenamed("id", id_col)
