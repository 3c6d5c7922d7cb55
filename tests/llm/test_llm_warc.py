import base64
import glob
import gzip
import hashlib
import json

from gauntlet.llm.warc_derivatives import derive_records, page_responses, write_warc

HTML = """<html><head><title>T &amp; x</title><style>p{}</style></head><body><script>var a="</p>";</script><!-- gone -->
<p>One <b>two</b>&nbsp;three</p><div>four<br>five &lt;six&gt;</div><a href="/l">link</a></body></html>"""


def sha1(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def parse(data):
    """Records of a WARC file: (headers, block)."""
    out, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        headers = dict(x.split(": ", 1) for x in lines)
        start, size = end + 4, int(headers["Content-Length"])
        assert version == "WARC/1.1" and data[start + size:start + size + 4] == b"\r\n\r\n"
        out.append((headers, data[start:start + size]))
        at = start + size + 4
    return out


def test_records_are_linked_and_survive_a_file(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/é", HTML, "x"), (2, None, None, "x"), (3, "http://b/", "", "x"), (None, "u", "<p>q", "x"),
                                   (1, "http://a/é", HTML, "x")], "page_id long, url string, html string, record_id string")
    responses = page_responses(pages)
    records = derive_records(responses)
    rows = records.collect()
    assert len(rows) == 10 and len({r.record_id for r in rows}) == 8           # the repeated page repeats its ids
    source = {r.record_id: r for r in responses.collect()}
    by_id = {r.record_id: r for r in rows}
    for r in rows:
        assert by_id[r.concurrent_to].concurrent_to == r.record_id and by_id[r.concurrent_to].warc_type != r.warc_type
        assert r.source_digest == sha1(source[r.refers_to].payload.encode()) and r.block_digest == sha1(r.block.encode())
        if r.warc_type == "metadata":
            block = json.loads(r.block)
            assert block["refers_to"] == r.refers_to and block["conversion"] == r.concurrent_to
            assert block["http_head"] == source[r.refers_to].http_head.split("\r\n")
    text = {r.page_id: r.block for r in rows if r.warc_type == "conversion"}
    assert text[1] == "T & x\nOne two three\nfour\nfive <six>\nlink" and text[2] == text[3] == "" and text[None] == "q"
    meta = json.loads(next(r.block for r in rows if r.warc_type == "metadata" and r.page_id == 1))
    assert meta["title"] == "T &amp; x" and meta["links"] == ["/l"]
    write_warc(records, str(tmp_path / "out"))
    found = [x for f in glob.glob(str(tmp_path / "out/*.gz")) for x in parse(gzip.open(f).read())]
    assert sorted((h["WARC-Record-ID"], b) for h, b in found) == sorted((r.record_id, r.block.encode()) for r in rows)
    assert all(h["WARC-Refers-To"] == by_id[h["WARC-Record-ID"]].refers_to for h, _ in found)
    assert derive_records(page_responses(pages.limit(0))).count() == 0


def test_captures_of_one_page_have_ids_of_their_own(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<p>one"), (1, "http://a/", "<p>two"), (1, "http://a/", None), (1, "http://a/", ""),
                                   (None, "http://a/", "<p>one")], "page_id long, url string, html string")
    responses = page_responses(pages)
    payload = {(r.record_id, r.payload) for r in responses.collect()}
    assert len(payload) == len({i for i, _ in payload}) == 4              # null and empty html are the same capture
    rows = derive_records(responses).collect()
    assert len(rows) == 10 and len({r.record_id for r in rows}) == 8
    source = dict(payload)
    for r in rows:
        assert r.source_digest == sha1(source[r.refers_to].encode())
