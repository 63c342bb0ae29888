import hashlib
from html.parser import HTMLParser

from quire.llm import warc


class Reader(HTMLParser):
    """A plain reading of small, well-formed pages."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "template", "head")
        self.out += "\n" * (tag in warc.BLOCKS)

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "template", "head")
        self.out += "\n" * (tag in warc.BLOCKS)

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def brute_text(page):
    r = Reader()
    r.feed(page)
    r.close()
    lines = (" ".join(x.split()) for x in "".join(r.out).split("\n"))
    return "\n".join(x for x in lines if x)


def test_text_by_a_parser(spark, small):
    for row in spark.read.parquet(f"{small}/pages.parquet").collect():
        assert warc.plain_text(row.html) == brute_text(row.html), row.page_id


def test_heads_without_an_end():
    begin = "<html><head><title>t</title><meta charset=x><!-- <p>no --><script>var a = '<p>no</p>'</script>"
    for page in (begin + "<body><p>hello</p>", begin + "<p>hello</p>", begin + "hello", begin + "</head>hello", begin + "<header>hello</header>", begin + "<div>hello<pre>&lt;/head></pre></div>"):
        assert warc.plain_text(page).startswith("hello"), page
    assert warc.plain_text("<head><title>t<p>hello</p>") == "hello" and warc.plain_text("<p>a</p><noscript><p>b</p>") == "a\nb"
    assert warc.plain_text("<head><title>t</title></head><p>a</p><p>b</head>c</p>") == "a\nbc"
    assert warc.plain_text("<html><head><title>x</title><body><p>Hello world</p></body></html>") == "Hello world"
    assert warc.plain_text("<p>a</p><script>b<p>c</p>") == "a" and warc.plain_text("<head><style>b<p>c</p>") == ""


def test_broken_pages_by_a_parser():
    """Pages with loose ends, read alike by the parser of the standard library."""
    pages = [
        '<p title="a > b">Hello</p>',
        "<p title='a > b' class=x/y>Hello<br/>you</p>",
        "a < b & c <3 &lt;d&gt; &#x41;&#66; &amp;amp;",
        "<div><p>one<div>two</span>three</b></div>four",
        "<!doctype html><!-- a > b -- c --><p>x</p><?php echo 1 ?><p>y</p><!bogus><p>z</p>",
        "<ul><li>a<li>b<LI>c</UL>d",
        "<table><tr><td>1<td>2</table>",
        "x</>y",
        "<a\nhref=/x\n>l</a\n>m",
    ]
    for page in pages:
        assert warc.plain_text(page) == brute_text(page), page
    assert warc.plain_text("y</ p>z") == "yz"  # a comment by HTML's standard, a tag for that parser


def test_links_and_language():
    page = warc.read('<html lang=" EN "><base href="http://b.example/d/"><a data-x="1>2" href="/y">l</a><a href=z>m</a><a name=q>n</a><template><a href=no>o</a></template><!-- <a href=no> --><area href=no>')
    assert warc.facts(page, "http://h.example/") == [("language", "en"), ("outlink", "http://b.example/y"), ("outlink", "http://b.example/d/z")]


def test_long_and_unclosed_pages_take_time_in_proportion():
    import time

    for piece in ("<script ", "<script>", "<title>", "<textarea>", "<a href='", "<!--", "</", "<", "<p", "<template>", "<x a=", "<style><title>", "&", "<head>", "a<b "):
        began = time.perf_counter()
        warc.plain_text(piece * (4_000_000 // len(piece)))
        assert time.perf_counter() - began < 8, piece
    began = time.perf_counter()
    assert warc.plain_text("<script " * 500_000) == "" and time.perf_counter() - began < 1


def read_back(data):
    """Records as heads and blocks, by the lengths that their heads tell."""
    out = []
    while data:
        head, rest = data.split(b"\r\n\r\n", 1)
        first, *lines = head.decode().split("\r\n")
        fields = [tuple(x.split(": ", 1)) for x in lines]
        size = int(dict(fields)["Content-Length"])
        assert first == "WARC/1.1" and rest[size : size + 4] == b"\r\n\r\n"
        out.append((fields, rest[:size]))
        data = rest[size + 4 :]
    return out


def test_files_of_responses(spark):
    """Real records: repeated headers, chunks, compression, a digest and a date of their own; two files, one gzipped by record."""
    import gzip

    page = "<p>één</p>".encode("latin-1")
    coded = gzip.compress(b"<p>packed</p>")
    bodies = [
        (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=iso-8859-1\r\nSet-Cookie: a=1\r\nSet-Cookie: b=2;  c\r\nX-Long: one\r\n two\r\n\r\n" + page, "één"),
        (b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nContent-Encoding: gzip\r\n\r\n" + b"%x\r\n" % 5 + coded[:5] + b"\r\n%x;x=y\r\n" % len(coded[5:]) + coded[5:] + b"\r\n0\r\n\r\n", "packed"),
    ]
    made = [b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\na:b\r\n\r\n"]
    for i, (body, _) in enumerate(bodies):
        made.append(f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x:{i}>\r\nWARC-Date: 2020-01-0{i + 1}T00:00:00Z\r\nWARC-Target-URI: <http://h.example/{i}>\r\nWARC-Payload-Digest: sha1:D{i}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n")
    files = spark.createDataFrame([("plain", bytearray(b"".join(made))), ("packed", bytearray(b"".join(map(gzip.compress, made)))), ("none", None), ("broken", bytearray(b"WARC/1.0\r\nno end"))], "path string, content binary")
    got = warc.derive(warc.responses(files)).collect()
    assert len(got) == 8
    for r in got:
        i = int(r.refers_to[-2])
        (fields, block), = read_back(bytes(r.record))
        fields = dict(fields)
        assert fields["WARC-Date"] == fields["WARC-Refers-To-Date"] == f"2020-01-0{i + 1}T00:00:00Z" and fields["WARC-Source-Payload-Digest"] == f"sha1:D{i}" == r.source_digest
        assert fields["WARC-Target-URI"] == f"http://h.example/{i}" and fields["WARC-Refers-To"] == f"<urn:x:{i}>"
        if r.type == "conversion":
            assert block.decode() == bodies[i][1]
        elif i == 0:
            assert block.decode() == "source-content-type: text/html; charset=iso-8859-1\r\nsource-set-cookie: a=1\r\nsource-set-cookie: b=2;  c\r\nsource-x-long: one two\r\n"


def test_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "http://h.example/a b\nWARC-Type: x", "<p>t", "r", "u", "d", "h", "p")] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_id string, uri string, date string, headers string, payload string")
    got = warc.derive(warc.from_pages(pages, "2024-05-06T07:08:09Z")).collect()
    assert len(got) == 4 and len({r.record_id for r in got}) == 2 and {r.date for r in got} == {"2024-05-06T07:08:09Z"}
    heads = [dict(read_back(bytes(r.record))[0][0]) for r in got]
    assert {h["WARC-Target-URI"] for h in heads} == {"http://h.example/a%20b%0AWARC-Type:%20x"}


def test_records(spark):
    page = '<html lang="EN"><head><title>A &amp; B</title><style>p{}</style></head><body><!-- <a href="/no"> --><p>one<br>two &#233;&#x4e;<script>x</script></p><a href="/x?a=1&amp;b=2">l</a><a href=\'#y\'>m</a></body></html>'
    pages = spark.createDataFrame([(1, "http://h.example/d/", page), (2, None, None), (3, "http://h.example/e", "")], "page_id long, url string, html string")
    rows = {(r.id, r.type): r for r in warc.derive(warc.from_pages(pages)).collect()}
    source = {r.id: r.record_id for r in warc.from_pages(pages).collect()}
    assert len(rows) == 6
    for (i, kind), r in rows.items():
        head, block = bytes(r.record).split(b"\r\n\r\n", 1)
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        block = block[: r.content_length]
        assert bytes(r.record).endswith(block + b"\r\n\r\n") and int(fields["Content-Length"]) == len(block)
        assert fields["WARC-Date"] == warc.EPOCH == r.date and fields["WARC-Refers-To"] == source[i] == r.refers_to and fields["WARC-Type"] == kind
        assert fields["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(block).hexdigest()
        assert fields.get("WARC-Target-URI") == {1: "http://h.example/d/", 3: "http://h.example/e"}.get(i)
    assert b"one\ntwo \xc3\xa9N\nl" in bytes(rows[1, "conversion"].record)
    meta = bytes(rows[1, "metadata"].record).decode()
    assert "title: A & B\r\n" in meta and "language: en\r\n" in meta and "outlink: http://h.example/x?a=1&b=2\r\n" in meta and "/no" not in meta and "source-content-type: text/html; charset=utf-8\r\n" in meta
    assert rows[2, "conversion"].content_length == 0
    assert warc.derive(warc.from_pages(pages.limit(0))).count() == 0
