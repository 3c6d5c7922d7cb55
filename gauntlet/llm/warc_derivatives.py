"""WARC derivatives: linked metadata and plain-text conversion records of response records.

Each response gives a ``metadata`` record (JSON: source HTTP headers, title,
links, digests) and a ``conversion`` record (extracted text).  Both carry
``WARC-Refers-To`` with the id of the response, and each names the other.
Digests are ``sha1:`` with base32, as crawl archives write them.

Cases: null html or url is treated as empty (an empty payload has the digest
of no bytes); a null page id keeps its two records with a null id.  Equal
rows give repeated records, with the same ids; rows that share id and url but
not html give records of their own.  Only the named columns are
read, so other columns cannot clash.  An empty table gives no record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
BREAKS = (r"(?i)</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|footer|h[1-6]|head|header|hr|li|main|nav|ol|p|pre"
          r"|section|table|td|th|title|tr|ul)\b[^>]*>")
ENTITIES = (("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))
CRLF = "\r\n"


def sha1_base32(text: Column) -> Column:
    """``sha1:`` and the base32 form of the digest of a text's UTF-8 bytes."""
    digest = F.sha1(text.cast("binary"))
    letters = []
    for group in range(8):                       # 5 hex digits are 4 base32 letters
        bits = F.conv(F.substring(digest, 5 * group + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(bits, shift).bitwiseAND(31) + 1, F.lit(1))
                    for shift in (15, 10, 5, 0)]
    return F.concat(F.lit("sha1:"), *letters)


def record_id(*parts: Column) -> Column:
    """A ``urn:uuid`` that is the same in every run, from the md5 of its parts."""
    h = F.md5(F.concat_ws("|", *parts).cast("binary"))
    pieces = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *pieces), F.lit(">"))


def page_responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of a table of pages: page_id, record_id, target_uri, date, http_head, payload.

    The id is made from page id, url and payload digest, so captures of one
    page that differ have ids of their own.
    """
    url, html = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.octet_length(html).cast("string"))
    return pages.select("page_id", record_id(F.col("page_id").cast("string"), url, sha1_base32(html)).alias("record_id"),
                        url.alias("target_uri"), F.lit(date).alias("date"), head.alias("http_head"), html.alias("payload"))


def plain_text(html: Column) -> Column:
    """Visible text: no comments, scripts or styles; a line break for each block tag; entities undone."""
    text = F.regexp_replace(html, HIDDEN, " ")
    text = F.regexp_replace(text, BREAKS, "\n")
    text = F.regexp_replace(text, "<[^>]*>", "")
    for entity, character in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(character))
    text = F.regexp_replace(text, r"[ \t\r\f]+", " ")
    text = F.regexp_replace(text, r"[ \n]*\n[ \n]*", "\n")
    return F.btrim(text, F.lit(" \n"))


def derive_records(responses: DataFrame) -> DataFrame:
    """Two records per response: page_id, warc_type, record_id, refers_to, concurrent_to, target_uri,
    content_type, content_length, block_digest, source_digest, header and block."""
    base = responses.select(
        "page_id", "target_uri", "date", F.col("record_id").alias("refers_to"),
        record_id("record_id", F.lit("metadata")).alias("metadata_id"),
        record_id("record_id", F.lit("conversion")).alias("conversion_id"),
        sha1_base32(F.col("payload")).alias("source_digest"), "http_head",
        F.regexp_extract("payload", r"(?is)<title[^>]*>(.*?)</title", 1).alias("title"),
        F.regexp_extract_all("payload", F.lit(r'(?i)<a\s[^>]*href\s*=\s*"([^"]*)"'), F.lit(1)).alias("links"),
        plain_text(F.col("payload")).alias("text"))
    metadata = F.to_json(F.struct(
        "target_uri", "refers_to", F.col("conversion_id").alias("conversion"),
        F.split("http_head", CRLF).alias("http_head"), F.col("source_digest").alias("payload_digest"),
        F.octet_length("text").alias("text_length"), "title", "links"))
    one = lambda kind, own, other, mime, block: F.struct(
        F.lit(kind).alias("warc_type"), F.col(own).alias("record_id"), F.col(other).alias("concurrent_to"),
        F.lit(mime).alias("content_type"), block.alias("block"))
    made = base.withColumn("made", F.explode(F.array(
        one("metadata", "metadata_id", "conversion_id", "application/json", metadata),
        one("conversion", "conversion_id", "metadata_id", "text/plain; charset=utf-8", F.col("text")))))
    rows = made.select("page_id", "made.warc_type", "made.record_id", "refers_to", "made.concurrent_to", "target_uri",
                       "made.content_type", F.octet_length("made.block").cast("long").alias("content_length"),
                       sha1_base32(F.col("made.block")).alias("block_digest"), "source_digest", "date", "made.block")
    fields = (("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Date", "date"),
              ("WARC-Target-URI", "target_uri"), ("WARC-Refers-To", "refers_to"),
              ("WARC-Concurrent-To", "concurrent_to"), ("WARC-Block-Digest", "block_digest"),
              ("WARC-Source-Payload-Digest", "source_digest"), ("Content-Type", "content_type"),
              ("Content-Length", "content_length"))
    header = F.concat(F.lit("WARC/1.1"), *(x for name, column in fields
                                           for x in (F.lit(f"{CRLF}{name}: "), F.col(column).cast("string"))))
    return rows.withColumn("header", header).drop("date").select(
        *(c for c in rows.columns if c not in ("date", "block")), "header", "block")


def write_warc(records: DataFrame, path: str) -> None:
    """Write records as gzipped WARC files, one per partition, through Spark's own writer.

    A record ends with two line breaks, which is the writer's line separator.
    """
    whole = records.select(F.concat("header", F.lit(CRLF + CRLF), "block"))
    whole.write.option("lineSep", CRLF + CRLF).option("compression", "gzip").text(path)
