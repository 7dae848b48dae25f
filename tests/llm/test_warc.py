import base64
import hashlib
from html.parser import HTMLParser

from weftline.llm import warc

PAGE = '<!DOCTYPE html><html lang="de"><head><title>A &amp; B</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><a href="/x?a=1&amp;b=2">X</a></nav><!-- ad --><p>Hello <b>wor</b>ld &eacute; 1 &lt; 2</p><table><tr><td>a</td><td>b</td></tr></table><br>end</body></html>'


class Plain(HTMLParser):
    """An independent reading of a well-formed page."""

    def __init__(self):
        super().__init__()
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "head")
        self.out.append("\n" if tag in ("p", "tr", "br", "nav", "body", "table", "div", "li", "ul", "h1") else " " if tag == "td" else "")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "head")
        self.out.append("\n" if tag in ("p", "tr", "nav", "body", "table", "div", "li", "ul", "h1") else " " if tag == "td" else "")

    def handle_data(self, data):
        self.out.append("" if self.skip else " ".join(("|" + data + "|").split())[1:-1])


def plain(page):
    p = Plain()
    p.feed(page)
    return "\n".join(x for line in "".join(p.out).split("\n") if (x := " ".join(line.split())))


def test_text_and_links():
    assert warc.plain_text(PAGE) == plain(PAGE) == "X\nHello world é 1 < 2\na b\nend"
    assert warc.facts(PAGE) == [("title", "A & B"), ("language", "de"), ("outlink", "/x?a=1&b=2")]
    assert warc.plain_text("<script>never closed") == "" and warc.plain_text("a < b and c > d") == "a < b and c > d"


def test_records_and_round_trip(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = [(1, "http://a/", PAGE), (2, None, None), (3, "http://é/\nx", ""), (None, "http://a/", PAGE), (1, "http://a/", PAGE), (5, "http://long/", "<p>x</p>" * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    clash = pages.withColumn("key", F.lit(1)).withColumn("payload", F.lit(2)).withColumn("headers", F.lit("h"))
    out = warc.derivatives(warc.responses(clash)).collect()
    assert len(out) == 12
    ids = {r.record_id for r in out if r.page_id not in (None, 1)}
    assert len(ids) == 6
    for r in out:
        data = next((h or "") for k, u, h in rows if k == r.page_id).encode()
        want = "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert r.source_payload_digest == want and r.block_digest == warc.digest(r.block)
        assert f"WARC-Refers-To: {r.refers_to}\r\n" in r.headers and f"Content-Length: {len(r.block)}\r\n" in r.headers
        if r.record_type == "metadata":
            assert f"source-payload-digest: {want}" in r.block.decode() and "source-header: HTTP/1.1 200 OK" in r.block.decode()
        elif data.decode() == PAGE:
            assert r.block.decode() == plain(PAGE)
    pairs = {}
    for r in out:
        pairs.setdefault(r.refers_to, set()).add(r.record_type)
    assert all(v == {"metadata", "conversion"} for v in pairs.values())
    df = warc.derivatives(warc.responses(pages))
    warc.write(df, str(tmp_path / "w"), records_per_file=5)
    warc.write(df.repartition(3), str(tmp_path / "w"), records_per_file=5, mode="overwrite")
    assert len(list((tmp_path / "w").glob("*.gz"))) >= 3
    back = warc.read(spark, str(tmp_path / "w")).collect()
    assert sorted((r.headers["warc-record-id"], bytes(r.block)) for r in back) == sorted((r.record_id, bytes(r.block)) for r in out)
    assert warc.op3(pages).count() == 12 and warc.op3(pages.limit(0)).count() == 0


def test_tags_with_quotes():
    assert warc.plain_text('<p title="a > b">x</p><a href=\'q>"r\'>y</a>z <img alt="1 > 0">w') == "x\nyz w"
    assert warc.plain_text('<p title="open>x</p> y') == "x\ny" and warc.plain_text("a <b 'c") == "a <b 'c"


def test_derivatives_against_a_plain_reading(spark):
    """Records of a table built by formula: ids, digests, headers and blocks, without the code under test but for the page's text."""
    import uuid

    pages = [(7, "http://x/7", PAGE), (8, None, None)]
    out = warc.derivatives(warc.responses(spark.createDataFrame(pages, "page_id long, url string, html string"))).collect()
    sha = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    space = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
    date = "2024-01-01T00:00:00Z"
    for key, url, html in pages:
        body = (html or "").encode()
        lines = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
        block = "\r\n".join(lines).encode() + b"\r\n\r\n" + body
        source = f"<urn:uuid:{uuid.uuid5(space, f'response|{url}|{date}|{sha(body)}')}>"
        facts = ["title: A & B", "language: de", "outlink: /x?a=1&b=2"] if html else []
        meta = facts + [f"source-record-id: {source}", f"source-block-digest: {sha(block)}", f"source-payload-digest: {sha(body)}"] + [f"source-header: {x}" for x in lines]
        want = {"metadata": "".join(x + "\r\n" for x in meta).encode(), "conversion": plain(html or "").encode()}
        for r in (r for r in out if r.page_id == key):
            assert bytes(r.block) == want[r.record_type] and r.refers_to == source and r.source_block_digest == sha(block)
            assert r.record_id == f"<urn:uuid:{uuid.uuid5(space, f'{r.record_type}|{source}')}>" and r.block_digest == sha(want[r.record_type])
            assert ("WARC-Target-URI" in r.headers) == (url is not None) and r.headers.startswith("WARC/1.1\r\nWARC-Type: " + r.record_type)
