"""WARC derivatives: metadata and plain-text conversion records of response records, linked to them.

Each response gives two records that refer to it (WARC-Refers-To): a metadata record, a JSON object with
the source's headers, digests, title and links, and a conversion record with the page's plain text.
Work is row by row on the executors; `write_warc` stores records through Spark's own writers, so it works
on any file system that Spark does, and `read_warc` reads them back.
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelyard.llm.words import chunks

RESPONSE = "record_id string, target_uri string, warc_date string, http_headers string, payload binary"
RECORD = ("source long, warc_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, "
          "content_length long, block_digest string, source_payload_digest string, headers string, content string")

#: Elements without text, and tags that end a line.
_NO_TEXT = re.compile(r"<(script|style|noscript|template|head)\b.*?</\1\s*>|<!--.*?-->|<![^>]*>", re.I | re.S)
_LINE_TAG = re.compile(r"</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|figcaption|figure|footer|form|h[1-6]|header|hr|html|li|main|nav"
                       r"|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul)\b[^>]*>", re.I)
_TAG = re.compile(r"<[^>]*>")
_SPACES = re.compile(r"[ \t\r\f\v]+")
_BLANK = re.compile(r" ?\n[ \n]*")
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.I | re.S)
_LINK = re.compile(r"<(a|link|img|script|iframe)\b[^>]*?\s(href|src)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)


def page_text(page: str) -> str:
    """Text of a page: one line for each block, entities resolved, runs of spaces as one, no empty lines."""
    text = _TAG.sub("", _LINE_TAG.sub("\n", _NO_TEXT.sub("\n", page)))
    text = html.unescape(text) if "&" in text else text
    return _BLANK.sub("\n", _SPACES.sub(" ", text)).strip(" \n")


def page_title(page: str) -> str | None:
    found = _TITLE.search(page)
    return " ".join(html.unescape(_TAG.sub("", found[1])).split()) if found else None


def page_links(page: str) -> list[dict]:
    """Links in page order: element, attribute, unresolved target."""
    out = []
    for tag, attribute, target in _LINK.findall(page):
        target = target[1:-1] if target[:1] in "\"'" else target
        out.append({"path": f"{tag.lower()}@{attribute.lower()}", "url": html.unescape(target)})
    return out


def digest(block: bytes) -> str:
    """A labelled digest as WARC headers carry it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def derived_id(record_id: str, kind: str) -> str:
    """Identifier of a derivative: a name-based UUID, so that a repeated run names it alike."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}:{record_id}')}>"


def parse_headers(block: str) -> tuple[str, dict[str, str]]:
    """Status line and fields of an HTTP header block; a repeated field's values are joined by a comma."""
    lines = [x for x in block.replace("\r\n", "\n").split("\n") if x]
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if colon:
            fields[name.strip()] = f"{fields[name.strip()]}, {value.strip()}" if name.strip() in fields else value.strip()
    return lines[0] if lines else "", fields


def _record(kind: str, source, record_id: str, uri: str | None, date: str, content_type: str, content: str, source_digest: str) -> tuple:
    block = content.encode("utf-8", "replace")
    own = derived_id(record_id, kind)
    fields = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Refers-To", record_id), ("WARC-Target-URI", uri), ("WARC-Date", date),
              ("WARC-Block-Digest", digest(block)), ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    headers = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return (source, kind, own, record_id, uri, date, content_type, len(block), digest(block), source_digest, headers, content)


def derive(responses: DataFrame, source_col: str | None = None) -> DataFrame:
    """Two rows for each response (see RECORD): its metadata record and its conversion record.

    `responses` has the columns of RESPONSE; others are ignored, but `source_col` (a whole number that
    names the row) is passed on as `source`. A null record id is made from the other values, a null URI
    is left out of the headers, a null or empty payload is an empty page, bytes that aren't UTF-8 are
    replaced in the text while the digest is over the bytes. Repeated rows give repeated records.
    """
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "payload"):
                rows = []
                for source, record_id, uri, date, http, payload in zip(*[c.to_pylist() for c in part.columns]):
                    body, http, date = payload or b"", http or "", date or "1970-01-01T00:00:00Z"
                    own = digest(body)
                    record_id = record_id or f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{uri}|{date}|{own}')}>"
                    page = body.decode("utf-8", "replace")
                    status, fields = parse_headers(http)
                    text = page_text(page)
                    about = {"source": {"record_id": record_id, "target_uri": uri, "payload_digest": own,
                                        "block_digest": digest(http.encode() + b"\r\n" + body), "payload_length": len(body)},
                             "http": {"status_line": status, "headers": fields},
                             "html": {"title": page_title(page), "links": page_links(page)},
                             "conversion": {"record_id": derived_id(record_id, "conversion"), "length": len(text.encode())}}
                    rows.append(_record("metadata", source, record_id, uri, date, "application/json", json.dumps(about, ensure_ascii=False), own))
                    rows.append(_record("conversion", source, record_id, uri, date, "text/plain; charset=utf-8", text, own))
                columns = list(zip(*rows))
                kinds = [pa.int64() if c.split()[1] == "long" else pa.string() for c in RECORD.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in RECORD.split(", ")])

    source = F.col(source_col).cast("long") if source_col else F.lit(None).cast("long")
    own = [F.col(c.split()[0]).cast(c.split()[1]) for c in RESPONSE.split(", ")]
    return responses.select(source.alias("source"), *own).mapInArrow(build, RECORD)


def responses_from_pages(pages: DataFrame, warc_date: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Response rows (RESPONSE and the page's id) of stored pages, with the headers of a plain HTML answer."""
    name = F.md5(F.concat_ws("|", F.lit("response"), F.col(id_col).cast("string"), F.col(url_col)))
    dashed = F.concat_ws("-", *[F.substring(name, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    length = F.coalesce(F.octet_length(html_col), F.lit(0)).cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), length, F.lit("\r\n"))
    return pages.select(F.col(id_col), F.concat(F.lit("<urn:uuid:"), dashed, F.lit(">")).alias("record_id"), F.col(url_col).alias("target_uri"),
                        F.lit(warc_date).alias("warc_date"), http.alias("http_headers"), F.col(html_col).cast("binary").alias("payload"))


def write_warc(records: DataFrame, path: str) -> None:
    """Write records as WARC files, one for each partition. Contents must be text without an empty CRLF line, as `derive` makes."""
    line = F.concat("headers", F.lit("\r\n"), "content")
    records.select(line.alias("value")).write.option("lineSep", "\r\n\r\n").text(path)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of an uncompressed file."""
    at = 0
    while at < len(data):
        head = data.index(b"\r\n\r\n", at)
        _, fields = parse_headers(data[at:head].decode())
        n = int(fields["Content-Length"])
        yield fields, data[head + 4:head + 4 + n]
        at = head + 4 + n + 4


def read_warc(spark, path: str) -> DataFrame:
    """Rows (fields map, block binary) of the records under `path`; a file is read by one task."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                found = list(parse_warc(blob.as_py()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([list(f.items()) for f, _ in found], pa.map_(pa.string(), pa.string())), pa.array([b for _, b in found], pa.binary())],
                    names=["fields", "block"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("content")
    return files.mapInArrow(scan, "fields map<string, string>, block binary")
