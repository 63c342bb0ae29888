"""Derived WARC records: of each response a metadata record and a plain-text conversion, linked to it.

A response has an id, a record id, a target URI, a date, its HTTP headers (a list of
names and values, in order, repeated ones as they are), its payload and, if it says so
itself, the payload's digest. ``responses`` reads them from WARC files (plain or gzipped,
with chunked or compressed bodies), ``from_pages`` makes them of a table of pages, with
record ids derived from the page and the date of the capture as a parameter, as such a
table has none.

Each derived record has an id derived from the response's and its own type,
``WARC-Refers-To`` with the response's id, the response's URI and date, the digest of its
own block and, as ``WARC-Source-Payload-Digest``, that of the payload. Metadata blocks
(``application/warc-fields``) hold the title, the language, the source's headers as
``source-<name>``, values unchanged, and the links out, absolute, in order.

The text: one pass over the page, every character read a fixed number of times; without
comments, scripts, styles, templates and the head; a line for each block element; character
references resolved (all that HTML names, and numbers); runs of white space as one space, no
empty lines. What stands in ``noscript`` is text, as no script runs. A tag that the page ends
within is no text.

Rows: a null or empty payload gives an empty conversion and a metadata block of what
is known; headers whose name or value is null are left out, as is a null URI; a null date
stands as 1970; line breaks and spaces in a URI are percent-encoded, those in a header's value
become spaces; repeated rows (and ties) give repeated records with equal ids; a script, style or
template that is never closed ends with the text, a head where what may not stand in it begins;
very long pages take time in proportion; an empty table gives an empty one; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.bpe import small_batches
from quire.llm.common import modest_batches

#: HTML's block elements, what may stand in a head, and elements whose content is no markup.
BLOCKS = "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
IN_HEAD = "base basefont bgsound head html link meta noframes noscript script style template title".split()
HIDDEN, PLAIN = ("script", "style", "iframe", "noembed", "noframes"), ("title", "textarea")
#: A date for responses without one.
EPOCH = "1970-01-01T00:00:00Z"
_BLOCK, _IN_HEAD = frozenset(BLOCKS), frozenset(IN_HEAD)
_CLOSE = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in HIDDEN + PLAIN}
_NAME, _SKIP, _KEY, _IS, _BARE = (re.compile(x) for x in (r"[a-zA-Z][^\s/>]*", r"[\s/]*", r"[^\s/>][^\s/>=]*", r"\s*=\s*", r"[^\s>]*"))
_COMMENT_END, _SPACE = re.compile(r"--!?>"), re.compile(r"[^\S\n]+")
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)


@dataclass
class Page:
    text: str = ""
    title: str | None = None
    language: str | None = None
    base: str | None = None
    links: list[str] = field(default_factory=list)


def _attributes(text: str, at: int) -> tuple[dict[str, str], int] | None:
    """A tag's attributes (of repeated ones the first) and where it ends; None where the text ends within it."""
    found: dict[str, str] = {}
    while True:
        at = _SKIP.match(text, at).end()
        if at >= len(text):
            return None
        if text[at] == ">":
            return found, at + 1
        key = _KEY.match(text, at)
        at, value = key.end(), ""
        if sign := _IS.match(text, at):
            at = sign.end()
            if text[at : at + 1] in ('"', "'"):
                end = text.find(text[at], at + 1)
                if end < 0:
                    return None
                value, at = text[at + 1 : end], end + 1
            else:
                bare = _BARE.match(text, at)
                value, at = bare[0], bare.end()
        found.setdefault(key[0].lower(), value)


def read(markup: str) -> Page:
    """What a reader sees of a page, a line for each block, and what it says of itself."""
    page, out = Page(), []
    at, size, head, templates = 0, len(markup), False, 0
    unclosed: set[str] = set()

    def put(data: str) -> None:
        nonlocal head
        if head and data.strip():
            head = False  # text ends a head
        if not head and not templates:
            out.append(html.unescape(data))

    while at < size:
        begin = markup.find("<", at)
        if begin != at:
            put(markup[at : begin if begin >= 0 else size])
        if begin < 0:
            break
        closing = markup.startswith("/", begin + 1)
        name = _NAME.match(markup, begin + 1 + closing)
        if not name:
            if markup.startswith("<!--", begin):
                short = 5 if markup.startswith(">", begin + 4) else 6 if markup.startswith("->", begin + 4) else 0
                end = None if short else _COMMENT_END.search(markup, begin + 4)
                at = begin + short if short else end.end() if end else size
            elif closing or markup[begin + 1 : begin + 2] in ("!", "?"):
                at = markup.find(">", begin + 1) + 1 or size
            else:
                put("<")
                at = begin + 1
            continue
        tag = name[0].lower()
        if markup.startswith(">", name.end()):
            attributes, at = {}, name.end() + 1
        elif (rest := _attributes(markup, name.end())) is not None:
            attributes, at = rest
        else:
            break
        if head and (tag not in _IN_HEAD if not closing else tag in ("head", "body", "html", "br")):
            head = False
        if tag == "template":
            templates = max(0, templates + (-1 if closing else 1))
        if tag in _BLOCK and not head and not templates:
            out.append("\n")
        if closing or templates:
            if not closing and tag in HIDDEN:
                at = _content(markup, at, tag, unclosed)[1]
            continue
        if tag in _CLOSE:
            content, at = _content(markup, at, tag, unclosed)
            if tag == "title" and page.title is None:
                page.title = " ".join(html.unescape(content).split())
            elif tag == "textarea":
                put(content)
        elif tag == "head":
            head = not any(x.strip() for x in out)
        elif tag == "html" and page.language is None and "lang" in attributes:
            page.language = html.unescape(attributes["lang"]).strip().lower() or None
        elif tag == "base" and page.base is None and "href" in attributes:
            page.base = html.unescape(attributes["href"]).strip()
        elif tag == "a" and "href" in attributes:
            page.links.append(html.unescape(attributes["href"]).strip())
    lines = (_SPACE.sub(" ", x).strip() for x in "".join(out).replace("\r", "\n").split("\n"))
    page.text = "\n".join(x for x in lines if x)
    return page


def _content(markup: str, at: int, tag: str, unclosed: set[str]) -> tuple[str, int]:
    """What an element without markup inside holds, and where that ends; one that is never closed goes to the end, a title or text area to the next tag."""
    end = None if tag in unclosed else _CLOSE[tag].search(markup, at)
    if end:
        return markup[at : end.start()], end.start()
    unclosed.add(tag)  # it isn't looked for again
    stop = markup.find("<", at) if tag in PLAIN else -1
    stop = stop if stop >= 0 else len(markup)
    return markup[at:stop], stop


def plain_text(markup: str) -> str:
    return read(markup).text


def facts(page: Page, uri: str | None) -> list[tuple[str, str]]:
    """Title, language and links of a page, as fields."""
    out = [(k, v) for k, v in (("title", page.title), ("language", page.language)) if v is not None]
    base = uri or ""
    for i, link in enumerate([page.base or "", *page.links]):
        try:
            link = urljoin(base, link)
        except ValueError:
            pass  # a malformed URL stays as it is written
        if i:
            out.append(("outlink", " ".join(link.split())))
        else:
            base = link
    return out


def record_id(*parts: str) -> str:
    """A URN that depends on nothing but the parts."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(chr(0).join(parts).encode()).digest()[:16], version=5)}>"


def digest_of(block: bytes) -> str:
    return "sha256:" + hashlib.sha256(block).hexdigest()


_RESPONSE = "record_id string, uri string, date string, headers array<struct<name:string,value:string>>, payload binary, payload_digest string"


def from_pages(pages: DataFrame, date: str = EPOCH) -> DataFrame:
    """Responses of a table ``page_id, url, html``, captured at ``date``."""
    make = "concat('<urn:uuid:', regexp_replace(substr(sha2(concat_ws('|', 'response', coalesce(cast(page_id as string), ''), coalesce(url, ''), sha2(coalesce(html, ''), 256)), 256), 1, 32), '^(.{8})(.{4}).(.{3}).(.{3})(.{12})$', '$1-$2-5$3-a$4-$5'), '>')"
    headers = "array(struct('Content-Type' as name, 'text/html; charset=utf-8' as value), struct('Content-Length' as name, cast(octet_length(coalesce(html, '')) as string) as value))"
    return pages.select(F.col("page_id").alias("id"), F.expr(make).alias("record_id"), F.col("url").alias("uri"), F.lit(date).alias("date"), F.expr(headers).alias("headers"), F.col("html").cast("binary").alias("payload"), F.lit(None).cast("string").alias("payload_digest"))


def _fields(head: bytes) -> list[tuple[str, str]]:
    """Names and values of header lines; a line that begins with white space goes on with the one before."""
    out: list[tuple[str, str]] = []
    for line in head.decode("utf-8", "replace").replace("\r\n", "\n").split("\n"):
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            name, value = line.split(":", 1)
            out.append((name.strip(), value.strip()))
    return out


def _parts(data: bytes) -> tuple[bytes, bytes]:
    """A head and what follows its empty line."""
    at = min((i, n) for n, i in ((4, data.find(b"\r\n\r\n")), (2, data.find(b"\n\n")), (0, len(data))) if i >= 0)
    return data[: at[0]], data[at[0] + at[1] :]


def records(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """Fields and block of each record of a WARC file; reading ends where the file is broken."""
    if data.startswith(b"\x1f\x8b"):
        plain = []
        while data:
            member = zlib.decompressobj(31)
            try:
                plain.append(member.decompress(data))
            except zlib.error:
                break
            data = member.unused_data
        data = b"".join(plain)
    at = 0
    while (begin := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", begin)
        if end < 0:
            return
        fields = _fields(data[begin:end].split(b"\r\n", 1)[-1])
        length = next((int(v) for k, v in fields if k.lower() == "content-length" and v.isdigit()), None)
        if length is None:
            return
        yield fields, data[end + 4 : end + 4 + length]
        at = end + 4 + length


def _body(headers: list[tuple[str, str]], raw: bytes) -> bytes:
    """A body without its transfer and content coding; one that can't be decoded stays as it is."""
    of = {k.lower(): v.lower() for k, v in headers}
    if "chunked" in of.get("transfer-encoding", ""):
        out, at = [], 0
        while (end := raw.find(b"\r\n", at)) >= 0:
            try:
                size = int(raw[at:end].split(b";")[0], 16)
            except ValueError:
                break
            if not size:
                break
            out.append(raw[end + 2 : end + 2 + size])
            at = end + 4 + size
        raw = b"".join(out)
    if of.get("content-encoding") in ("gzip", "x-gzip", "deflate"):
        for bits in (47, -15):
            try:
                return zlib.decompressobj(bits).decompress(raw)
            except zlib.error:
                continue
    return raw


def responses(files: DataFrame) -> DataFrame:
    """The responses of WARC files (``path, content``, as the source ``binaryFile`` gives them), ids being path and place.

    The payload's digest is the record's own; a file is read within one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            path, rows = batch.column(0)[0].as_py(), []
            for place, (fields, block) in enumerate(records(batch.column(1)[0].as_py() or b"")):
                of = {k.lower(): v for k, v in fields}
                if of.get("warc-type") != "response":
                    continue
                head, raw = _parts(block)
                headers = _fields(head.split(b"\n", 1)[-1])
                rows.append({"id": f"{path}#{place}", "record_id": of.get("warc-record-id"), "uri": of.get("warc-target-uri", "").strip("<>") or None, "date": of.get("warc-date"), "headers": [{"name": k, "value": v} for k, v in headers], "payload": _body(headers, raw), "payload_digest": of.get("warc-payload-digest")})
                if len(rows) == 256:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, schema)

    pair = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
    schema = pa.schema([(n, pa.string()) for n in ("id", "record_id", "uri", "date")] + [("headers", pair), ("payload", pa.binary()), ("payload_digest", pa.string())])
    return modest_batches(files).select("path", "content").mapInArrow(run, "id string, " + _RESPONSE)


FIELDS = ["id", "type", "record_id", "refers_to", "uri", "date", "content_type", "content_length", "block_digest", "source_digest", "record"]


def _decoded(payload: bytes, headers: list[dict]) -> str:
    """The payload as text: by the charset of its headers or of its first part, or as UTF-8."""
    said = [h["value"] for h in headers if h["name"] and h["value"] and h["name"].lower() == "content-type"]
    for source in (*said, payload[:1024].decode("latin-1")):
        if m := _CHARSET.search(source):
            try:
                return payload.decode(m[1], "replace")
            except LookupError:
                continue
    return payload.decode("utf-8", "replace")


def _uri(uri: str | None) -> str | None:
    return None if uri is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri)


def derive(found: DataFrame) -> DataFrame:
    """FIELDS of two records for each response: ``record`` is the whole record as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 128):
            rows = []
            for row in batch.to_pylist():
                payload, uri, headers, date = row["payload"] or b"", _uri(row["uri"]), row["headers"] or [], row["date"] or EPOCH
                source = row["payload_digest"] or digest_of(payload)
                page = read(_decoded(payload, headers))
                kept = [(f"source-{h['name'].lower()}", re.sub(r"[\r\n]+", " ", h["value"])) for h in headers if h["name"] and h["value"] is not None]
                meta = "".join(f"{k}: {v}\r\n" for k, v in (*facts(page, uri), *kept)).encode()
                for kind, mime, block in (("metadata", "application/warc-fields", meta), ("conversion", "text/plain; charset=utf-8", page.text.encode())):
                    own = record_id(kind, row["record_id"] or "")
                    head = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Refers-To", row["record_id"]), ("WARC-Target-URI", uri), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", row["date"]), ("WARC-Source-Payload-Digest", source), ("WARC-Block-Digest", digest_of(block)), ("Content-Type", mime), ("Content-Length", str(len(block)))]
                    record = ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head if v is not None) + "\r\n").encode() + block + b"\r\n\r\n"
                    rows.append((row["id"], kind, own, row["record_id"], uri, date, mime, len(block), digest_of(block), source, record))
            kinds = [batch.schema.field("id").type, *[pa.string()] * 6, pa.int64(), pa.string(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], FIELDS)

    kind = found.schema["id"].dataType.simpleString()
    return modest_batches(found).select("id", "record_id", "uri", "date", "headers", "payload", "payload_digest").mapInArrow(run, f"id {kind}, type string, record_id string, refers_to string, uri string, date string, content_type string, content_length bigint, block_digest string, source_digest string, record binary")


def digest(made: DataFrame) -> DataFrame:
    return made.select(F.col("id").alias("page_id"), "type", "record_id", "refers_to", "uri", "date", "content_type", "content_length", "block_digest", "source_digest", F.sha2("record", 256).alias("record_sha256"))
