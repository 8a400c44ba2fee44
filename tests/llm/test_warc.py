"""WARC derivatives: links between records, digests, text, exact round trip."""

import base64
import hashlib
import json
from html.parser import HTMLParser

from pyspark.sql import functions as F

from funnelyard.llm import warc as W
from funnelyard.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
FIELDS = "record_id string, target_uri string, warc_date string, http_headers string, payload binary"


class Plain(HTMLParser):
    """Words of a page's text by a parser, without script, style and head."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "head")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "head")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def sha1(block):
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def test_query_over_all_pages(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = QUERIES["op3_warc_derivatives"](spark, SF).collect()
    assert len(rows) == 2 * len(pages) and len({r.record_id for r in rows}) == len(rows)
    by = {(r.page_id, r.warc_type): r for r in rows}
    for page_id, page in pages.items():
        meta, text = by[page_id, "metadata"], by[page_id, "conversion"]
        assert meta.refers_to == text.refers_to and meta.target_uri == text.target_uri == page.url
        about = json.loads(meta.content)
        assert about["source"]["record_id"] == text.refers_to and about["conversion"]["record_id"] == text.record_id
        assert about["source"]["payload_digest"] == text.source_payload_digest == sha1(page.html.encode())
        assert about["http"]["headers"]["Content-Length"] == str(len(page.html.encode()))
        parser = Plain()
        parser.feed(page.html)
        assert "".join(text.content.split()) == "".join("".join(parser.parts).split())
        for r in (meta, text):
            raw = r.content.encode()
            assert (r.content_length, r.block_digest) == (len(raw), sha1(raw))
            assert f"WARC-Refers-To: {r.refers_to}\r\n" in r.headers and f"WARC-Block-Digest: {r.block_digest}\r\n" in r.headers


def test_written_files_give_the_records_back(spark, tmp_path):
    records = QUERIES["op3_warc_derivatives"](spark, SF)
    W.write_warc(records, str(tmp_path / "warc"))
    got = sorted((r.fields["WARC-Record-ID"], r.fields["WARC-Refers-To"], bytes(r.block).decode()) for r in W.read_warc(spark, str(tmp_path / "warc")).collect())
    assert got == sorted((r.record_id, r.refers_to, r.content) for r in records.collect())


def test_page_text_title_and_links():
    page = ("<!DOCTYPE html><head><title>A &amp;\n B</title><script>x</script></head><p>one<b> two</b>  three<br>four &lt;5&gt;"
            "<a class=x href='/a?b&amp;c'>l</a><img src=p.png><!-- <p>no --><STYLE>q</STYLE><li>five")
    assert W.page_text(page) == "one two three\nfour <5>l\nfive"
    assert W.page_title(page) == "A & B"
    assert W.page_links(page) == [{"path": "a@href", "url": "/a?b&c"}, {"path": "img@src", "url": "p.png"}]
    assert W.page_text("") == "" and W.page_title("x") is None and W.page_links("a < b") == []


def test_headers():
    assert W.parse_headers("HTTP/1.1 404 No\r\nA: b:c\r\nSet: 1\r\nSet: 2\r\nbad\r\n") == ("HTTP/1.1 404 No", {"A": "b:c", "Set": "1, 2"})
    assert W.parse_headers("") == ("", {})


def test_nulls_bytes_that_are_no_utf8_repeated_rows_and_long_pages(spark):
    long = ("<p>" + "word " * 200_000).encode()
    rows = [(None, None, None, None, None), ("<urn:x>", "http://a", "2020-01-01T00:00:00Z", "HTTP/1.1 200 OK\r\n", b"\xff<p>ok"),
            ("<urn:x>", "http://a", "2020-01-01T00:00:00Z", "HTTP/1.1 200 OK\r\n", b"\xff<p>ok"), ("<urn:l>", "", "2020-01-01T00:00:00Z", "", long)]
    got = W.derive(spark.createDataFrame(rows, FIELDS)).collect()
    assert len(got) == 8
    empty, odd, again, big = (got[i + 1] for i in (0, 2, 4, 6))
    assert empty.content == "" and "WARC-Target-URI" not in empty.headers and empty.refers_to.startswith("<urn:uuid:")
    assert odd == again and odd.content == "�\nok" and odd.source_payload_digest == sha1(b"\xff<p>ok")
    assert big.content_length == 200_000 * 5 - 1


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([("<urn:x>", "u", "d", "", b"<p>t", 4, 9)], FIELDS + ", content int, warc_type int").withColumn("n", F.lit(3))
    assert [(r.source, r.content) for r in W.derive(df, source_col="n").collect()][1] == (3, "t")
    assert W.derive(df.limit(0)).count() == 0
