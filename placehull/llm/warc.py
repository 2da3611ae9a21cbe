"""WARC derivatives: metadata and plain-text conversion records of response records.

Each response gives two records that refer to it (WARC-Refers-To, WARC-Refers-To-Target-URI, WARC-Refers-To-Date): ``metadata`` (warc-fields with
the source's HTTP status line, headers, payload digest and length, and the counts taken from its page) and ``conversion``
(its visible text, one line per block). Ids of derived records are name-based UUIDs of the source's id and the record's type, so a
rerun writes the same records. Digests are ``sha256:`` and lower-case hex, over the record's block. A row is converted by itself: nothing
is shuffled.

Nulls and ties: a null payload is an empty one, a null URI or header is left out of the record; responses with equal ids give records with equal ids.
Header line breaks inside values are folded to spaces. An empty table gives no records. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placehull.llm.base import table

CRAWLED = "2024-01-01T00:00:00Z"
SCHEMA = (
    "record_id string, record_type string, refers_to string, target_uri string, date string, content_type string, "
    "content_length long, block_digest string, source_digest string, record binary"
)
_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>", re.S | re.I)
_BREAK = re.compile(r"<(?:br|hr|/?(?:p|div|section|article|main|nav|header|footer|aside|form|ul|ol|li|table|tr|h[1-6]|title|pre|blockquote|dl|dt|dd))\b[^>]*>", re.I)
_TAG = re.compile(r"<[a-zA-Z/][^>]*>")
_LINK = re.compile(r"<a\b[^>]*\bhref\s*=", re.I)
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title", re.S | re.I)


def visible_text(page: str) -> str:
    """Text of a page without markup, scripts and styles: one line per block, white space squeezed."""
    page = _TAG.sub("", _BREAK.sub("\n", _HIDDEN.sub(" ", page).replace("\n", " ")))
    lines = (" ".join(entities.unescape(line).split()) for line in page.split("\n"))
    return "".join(f"{line}\n" for line in lines if line)


def derived_id(source: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{source} {kind}')}>"


def digest_of(block: bytes) -> str:
    return f"sha256:{hashlib.sha256(block).hexdigest()}"


def fields(pairs: list[tuple[str, str | None]]) -> bytes:
    return "".join(f"{k}: {' '.join(v.splitlines())}\r\n" for k, v in pairs if v is not None).encode()


def record_of(kind: str, source: dict, content_type: str, block: bytes) -> dict:
    """One derived record, its headers and its bytes."""
    own, digest = derived_id(source["record_id"], kind), digest_of(block)
    head = fields(
        [
            ("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Date", source["date"]), ("WARC-Target-URI", source["target_uri"]),
            ("WARC-Refers-To", source["record_id"]), ("WARC-Refers-To-Target-URI", source["target_uri"]), ("WARC-Refers-To-Date", source["date"]),
            ("WARC-Block-Digest", digest), ("Content-Type", content_type), ("Content-Length", str(len(block))),
        ]
    )
    return {
        "record_id": own, "record_type": kind, "refers_to": source["record_id"], "target_uri": source["target_uri"], "date": source["date"],
        "content_type": content_type, "content_length": len(block), "block_digest": digest, "source_digest": source["digest"],
        "record": b"WARC/1.1\r\n" + head + b"\r\n" + block + b"\r\n\r\n",
    }


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(headers["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("record length is wrong")
    return headers, block


def derive_both(source: dict) -> list[dict]:
    payload = source["payload"] or b""
    source = {**source, "digest": digest_of(payload)}
    page = payload.decode("utf-8", "replace")
    text = visible_text(page).encode()
    title = _TITLE.search(page)
    facts = fields(
        [
            ("source-status-line", source["status"]), *((f"source-header-{k.lower()}", v) for k, v in (source["headers"] or [])),
            ("source-payload-digest", source["digest"]), ("source-content-length", str(len(payload))),
            ("title", " ".join(entities.unescape(title[1]).split()) if title else None), ("outlinks", str(len(_LINK.findall(page)))),
            ("conversion-id", derived_id(source["record_id"], "conversion")), ("conversion-digest", digest_of(text)),
        ]
    )
    return [record_of("metadata", source, "application/warc-fields", facts), record_of("conversion", source, "text/plain", text)]


def _derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64() if n == "content_length" else pa.binary() if n == "record" else pa.string() for n in names]
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            rows = [r for source in batch.slice(at, 256).to_pylist() for r in derive_both(source)]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names=names)


def derivatives(responses: DataFrame) -> DataFrame:
    """Metadata and conversion records of response records.

    ``responses``: record_id, target_uri, date, status (HTTP status line), headers (map of strings), payload (binary).
    """
    rows = responses.select("record_id", "target_uri", "date", "status", "headers", F.col("payload").cast("binary").alias("payload"))
    return rows.mapInArrow(_derive, SCHEMA)


def responses_of(pages: DataFrame, date: str = CRAWLED) -> DataFrame:
    """Captured pages (page_id, url, html) as response records; the id follows from page_id, url and html."""
    digest = F.md5(F.concat_ws("\n", F.col("page_id").cast("string"), F.col("url"), F.md5(F.coalesce("html", F.lit("")).cast("binary"))).cast("binary"))
    parts = [F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    payload = F.col("html").cast("binary")
    headers = F.create_map(F.lit("Content-Type"), F.lit("text/html; charset=utf-8"), F.lit("Content-Length"), F.coalesce(F.octet_length(payload), F.lit(0)).cast("string"))
    return pages.select(
        F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">")).alias("record_id"),
        F.col("url").alias("target_uri"), F.lit(date).alias("date"), F.lit("HTTP/1.1 200 OK").alias("status"), headers.alias("headers"), payload.alias("payload"),
    )


def op3_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivatives(responses_of(table(spark, sf_dir, "pages")))
