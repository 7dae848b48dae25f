"""WARC derivatives: metadata and plain-text conversion records from response records.

A response is a row of record id, target URI, date, HTTP header lines and payload. For each, a metadata
record (title, language, links, the source's header lines and digests) and a conversion record (the
page's plain text) are built; both refer to the response by WARC-Refers-To, and name its digests.
Record ids are made from the response's id and the record's type, so a task that runs again makes the
same records. write() and read() go through Spark's own writers and readers, so a folder may be on any file system that
Spark knows, a task that runs again leaves one file, and an older run's files go if ``mode`` says so. A file is one gzip
stream of WARC records (not a member for each record, which the format recommends).

Null payloads count as empty, null URIs and dates leave their header out, null keys pass through, and
repeated rows give their records again. No rows give no records (and no files).
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import re
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import map_rows

VERSION, SPACE = "WARC/1.1", uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
#: Records in a file that write() makes; read() takes a file as a whole.
RECORDS_PER_FILE = 20_000
RECORD = "page_id long, record_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, block_digest string, payload_digest string, source_block_digest string, source_payload_digest string, headers string, block binary"

_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_HEAD = re.compile(r"<head\b[^>]*>.*?</head\s*>|<title\b[^>]*>.*?</title\s*>", re.S | re.I)
_TAG = re.compile(r"""<(?:/?([a-zA-Z][a-zA-Z0-9]*)|[/!?a-zA-Z])(?:(?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+>)""")  # a > inside quotes doesn't end a tag, unless a quote is left open
#: What stands for a tag in the text, if not nothing.
_SHOWS = dict.fromkeys("p div br hr li ul ol dl dt dd tr table thead tbody section article header footer nav aside main h1 h2 h3 h4 h5 h6 pre blockquote form figure figcaption option body html".split(), "\n") | {"td": " ", "th": " "}
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.S | re.I)
_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", re.I)
_LINK = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def plain_text(page: str) -> str:
    """The visible text: one line a block, white space made single spaces."""
    return _lines(_HIDDEN.sub(" ", page))


def _lines(shown: str) -> str:
    t = " ".join(_HEAD.sub(" ", shown).split())
    t = _TAG.sub(lambda m: _SHOWS.get(m[1].lower(), "") if m[1] else "", t)
    lines = (" ".join(line.split()) for line in html.unescape(t).split("\n"))
    return "\n".join(line for line in lines if line)


def facts(page: str) -> list[tuple[str, str]]:
    """Title, language and links of a page as warc-fields."""
    return _facts(_HIDDEN.sub(" ", page))


def _facts(shown: str) -> list[tuple[str, str]]:
    out = []
    if m := _TITLE.search(shown):
        out.append(("title", " ".join(html.unescape(m[1]).split())))
    if m := _LANG.search(shown):
        out.append(("language", m[1].lower()))
    out += [("outlink", " ".join(html.unescape(a or b or c).split())) for a, b, c in _LINK.findall(shown)]
    return out


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, '|'.join(map(str, parts)))}>"


def header(fields: list[tuple[str, str | None]]) -> str:
    return f"{VERSION}\r\n" + "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in fields if v is not None)


def derive(key, response_id: str | None, uri: str | None, date: str | None, http: str | None, payload: str | None) -> list[tuple]:
    """The two records of a response, as tuples in the order of RECORD."""
    body = (payload or "").encode("utf-8", "replace")
    head = (http or "").replace("\r\n", "\n").strip("\n").replace("\n", "\r\n")
    block = (head + "\r\n\r\n").encode() + body if head else body
    source = response_id or record_id("response", uri, date, digest(body))
    source_block, source_payload = digest(block), digest(body)
    out = []
    shown = _HIDDEN.sub(" ", payload or "")
    fields = _facts(shown) + [("source-record-id", source), ("source-block-digest", source_block), ("source-payload-digest", source_payload)]
    fields += [("source-header", line) for line in head.split("\r\n") if line]
    made = (
        ("metadata", "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "replace")),
        ("conversion", "text/plain; charset=utf-8", _lines(shown).encode("utf-8", "replace")),
    )
    for kind, mime, data in made:
        own, d = record_id(kind, source), digest(data)
        lines = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Refers-To", source), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date), ("WARC-Target-URI", uri), ("WARC-Date", date), ("WARC-Block-Digest", d), ("WARC-Payload-Digest", d), ("WARC-Source-Payload-Digest", source_payload), ("Content-Type", mime), ("Content-Length", str(len(data)))]
        out.append((key, kind, own, source, uri, date, mime, d, d, source_block, source_payload, header(lines), data))
    return out


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response rows of a table of pages (page_id, url, html), as a crawler would have stored them."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\nContent-Type: text/html; charset=utf-8\nContent-Length: "), F.octet_length(F.coalesce("html", F.lit(""))).cast("string"))
    return pages.select(F.col("page_id").cast("long").alias("key"), F.col("html").alias("payload"), F.lit(None).cast("string").alias("record_id"), F.col("url").alias("uri"), F.lit(date).alias("date"), http.alias("http"))


def derivatives(source: DataFrame) -> DataFrame:
    """Two records for each response row (key, payload, record_id, uri, date, http); a map without a shuffle."""

    def run(lists):
        for rows in lists:
            yield [r for k, payload, rid, uri, date, http in rows for r in derive(k, rid, uri, date, http, payload)]

    return map_rows(source.select("key", "payload", "record_id", "uri", "date", "http"), run, RECORD)


def write(records: DataFrame, folder: str, records_per_file: int = RECORDS_PER_FILE, mode: str = "errorifexists") -> None:
    """Write records as gzip files of at most ``records_per_file`` records into ``folder``."""
    crlf = lambda s: F.lit(s).cast("binary")
    whole = F.concat(F.col("headers").cast("binary"), crlf("\r\n"), F.col("block"), crlf("\r\n\r"))  # the writer ends it with a line feed
    records.select(whole.cast("string").alias("value")).write.mode(mode).option("compression", "gzip").option("lineSep", "\n").option("maxRecordsPerFile", records_per_file).text(folder)


def parse(data: bytes) -> Iterator[tuple[str, bytes]]:
    """(header, block) of each record of a gzip file (of one member or many), in order."""
    with gzip.open(io.BytesIO(data)) as f:
        while line := f.readline():
            if not line.strip():
                continue
            head = [line]
            while (line := f.readline()).strip():
                head.append(line)
            size = next(int(x.split(b":", 1)[1]) for x in head if x.lower().startswith(b"content-length:"))
            yield b"".join(head).decode(), f.read(size)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """``headers`` (a map of lower-case names) and ``block`` of all records of the gzip files in ``folder``; a task holds the files it was given, packed."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("path", "content")

    def run(lists):
        for rows in lists:
            for _, data in rows:
                out, size = [], 0
                for head, block in parse(data):
                    fields = dict((k.strip().lower(), v.strip()) for k, v in (x.split(":", 1) for x in head.splitlines()[1:]))
                    out.append((list(fields.items()), block))
                    size += len(block)
                    if len(out) == 100 or size > 4_000_000:
                        yield out
                        out, size = [], 0
                yield out

    return map_rows(files, run, "headers map<string,string>, block binary", text=0)


def op3(pages: DataFrame) -> DataFrame:
    out = derivatives(responses(pages))
    return out.select("page_id", "record_type", "record_id", "refers_to", "target_uri", "block_digest", "source_payload_digest", F.sha2("headers", 256).alias("headers_sha256"), F.octet_length("block").cast("long").alias("content_length"))
