import datetime
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from quire.plans.jobs import Job
from quire.plans.sanitizer import Sanitizer
from quire.sources import content, datasource, filters, pixels, tables, xmp
from quire.sources.canvas import Canvas, Content, helvetica_width
from quire.sources.document import Document
from quire.sources.edit import Editor, page_numbers
from quire.sources.values import Malformed, Name, Real, Ref, Stream, from_json, parse, to_json, unparse
from quire.sources.writer import Builder, Options

N = Name
names = st.text(min_size=1, max_size=8).map(lambda s: N("/" + s.replace("\0", "x"))).filter(lambda n: "\ud800" not in n)
scalars = st.one_of(st.booleans(), st.integers(-(2**63), 2**63 - 1), st.binary(max_size=60), names, st.builds(Ref, st.integers(1, 999), st.integers(0, 9)), st.decimals(-(10**9), 10**9, places=3, allow_nan=False).map(lambda d: Real(str(d))))
values = st.recursive(scalars, lambda inner: st.one_of(st.lists(inner, max_size=4), st.dictionaries(names, inner, max_size=4)), max_leaves=12)


@settings(max_examples=300, deadline=None)
@given(values)
def test_values_round_trip(value):
    assert parse(unparse(value)) == value
    assert from_json(to_json(value)) == value


@pytest.mark.parametrize("raw", [b"", b"[", b"<<", b"<< /A >>", b"(", b"<4", b"1 2", b"]", b"<< 1 2 >>"])
def test_malformed_values(raw):
    if raw == b"[" or raw == b"<<":
        parse(raw)  # ends with the data
        return
    with pytest.raises(Malformed):
        parse(raw)


def test_strings():
    assert parse(rb"(a\(b\)\\ \101\n(c) \
d)") == b"a(b)\\ A\n(c) d"
    assert parse(b"<4 1 4>") == b"A@" and parse(b"/A#20b") == "/A b"
    assert unparse(1.5) == b"1.5" and unparse(2.0) == b"2"
    with pytest.raises(ValueError):
        unparse(float("nan"))


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=400))
def test_filters(data):
    import base64

    for name, coded in (("/FlateDecode", zlib.compress(data)), ("/ASCIIHexDecode", data.hex().encode() + b">"), ("/ASCII85Decode", base64.a85encode(data) + b"~>"), ("/Fl", zlib.compress(data))):
        assert filters.decode({N("/Filter"): N(name)}, coded) == (data, [])
    both = base64.a85encode(zlib.compress(data)) + b"~>"
    head = {N("/Filter"): [N("/ASCII85Decode"), N("/FlateDecode"), N("/DCTDecode")]}
    assert filters.decode(head, both) == (data, [(N("/DCTDecode"), {})])
    assert filters.decode(head, both, "none")[0] == both


def test_more_filters():
    assert filters.decode({N("/Filter"): N("/RunLengthDecode")}, bytes([2, 1, 2, 3, 254, 9, 128]), "all")[0] == bytes([1, 2, 3, 9, 9, 9])
    # The example of the standard for LZW.
    assert filters.decode({N("/Filter"): N("/LZWDecode")}, bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01]))[0] == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
    rows = b"".join(bytes([k]) + body for k, body in ((0, b"\x01\x02\x03"), (1, b"\x01\x01\x01"), (2, b"\x01\x01\x01"), (3, b"\x01\x01\x01"), (4, b"\x01\x01\x01")))
    head = {N("/Filter"): N("/FlateDecode"), N("/DecodeParms"): {N("/Predictor"): 15, N("/Columns"): 3}}
    assert filters.decode(head, zlib.compress(rows))[0] == bytes([1, 2, 3, 1, 2, 3, 2, 3, 4, 2, 3, 4, 3, 4, 5])
    assert filters.decode({N("/Filter"): N("/FlateDecode")}, zlib.compress(b"x" * 9000)[:-6])[0]
    with pytest.raises(Malformed):
        filters.decode({N("/Filter"): N("/FlateDecode")}, b"nothing of the kind")


def sample(n=4):
    b = Builder()
    font = b.add({N("/Type"): N("/Font"), N("/Subtype"): N("/Type1"), N("/BaseFont"): N("/Helvetica")})
    for i in range(n):
        b.page(f"q 1 0 0 1 {i} 0 cm BT /F1 12 Tf (page {i}) Tj ET Q".encode(), {N("/Font"): {N("/F1"): font}}, Annots=[])
    b.info = {N("/Title"): b"A title", N("/Author"): "Ünï"}
    return b


def test_write_and_read():
    doc = Document(sample().bytes())
    assert not doc.rebuilt and doc.version == "1.7" and not doc.warnings and len(doc.pages()) == 4
    assert b"(page 2) Tj" in doc.content(doc.pages()[2][1])
    assert sample().bytes() == sample().bytes()
    again = Editor(sample().bytes()).bytes()
    assert Editor(again).bytes() == again  # writing what was read changes nothing more


def test_rebuilt_where_broken():
    data = sample().bytes()
    for broken in (data[: data.rfind(b"startxref")], data.replace(b"startxref\n", b"startxref\n9"), data.replace(b"0000000015", b"0000000099"), b"junk\n" + data):
        doc = Document(broken)
        assert len(doc.pages()) == 4 and (doc.warnings or not doc.rebuilt)
    with pytest.raises(Malformed):
        Document(data[: data.rfind(b"startxref")], recover=False)
    with pytest.raises(Malformed):
        Document(b"nothing")


def packed_file():
    """A file with an object stream and a cross-reference stream."""
    inner = [(1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Type /Pages /Kids [ 3 0 R ] /Count 1 /MediaBox [ 0 0 100 50 ] /Rotate 90 >>"), (3, b"<< /Type /Page /Parent 2 0 R >>")]
    places, body = [], b""
    for n, raw in inner:
        places.append(f"{n} {len(body)}")
        body += raw + b" "
    first = " ".join(places).encode() + b" "
    out = b"%PDF-1.5\n"
    at4 = len(out)
    coded = zlib.compress(first + body)
    out += b"4 0 obj\n<< /Type /ObjStm /N 3 /First %d /Filter /FlateDecode /Length %d >>\nstream\n" % (len(first), len(coded)) + coded + b"\nendstream\nendobj\n"
    at5 = len(out)
    rows = [(0, 0, 255), (2, 4, 0), (2, 4, 1), (2, 4, 2), (1, at4, 0), (1, at5, 0)]
    body = b"".join(bytes([k]) + a.to_bytes(2, "big") + bytes([b]) for k, a, b in rows)
    coded = zlib.compress(body)
    out += b"5 0 obj\n<< /Type /XRef /Size 6 /W [ 1 2 1 ] /Root 1 0 R /Filter /FlateDecode /Length %d >>\nstream\n" % len(coded) + coded + b"\nendstream\nendobj\n"
    return out + b"startxref\n%d\n%%%%EOF\n" % at5


def test_object_streams():
    for data in (packed_file(), packed_file().replace(b"startxref", b"startxxxx")):
        (ref, page), = Document(data).pages()
        assert page["/MediaBox"] == [0, 0, 100, 50] and page["/Rotate"] == 90 and ref == Ref(3)


def test_content_streams():
    data = b"q 1 0 0 1 5 5 cm /Im0 Do Q\nBI /W 2 /H 1 /BPC 8 /CS /G ID \x01EI EI\n[(a) -20 (b)] TJ 7 (dangling)"
    rows = list(content.instructions(data))
    assert [op for _, op in rows] == ["q", "cm", "Do", "Q", "INLINE IMAGE", "TJ"]
    assert rows[4][0] == [{"/W": 2, "/H": 1, "/BPC": 8, "/CS": "/G"}, b"\x01EI"]
    assert list(content.instructions(content.unparse_instructions(rows))) == rows
    assert [op for _, op in content.instructions(data, "q")] == ["q", "Q"] and [op for _, op in content.instructions(data, "BI ID EI")] == ["INLINE IMAGE"]
    assert content.expanded(rows[4][0][0])["/ColorSpace"] == "/DeviceGray"
    assert b"".join(raw for _, raw in content.tokens(data)) == data
    assert content.filter_tokens(b"1 0 0 rg % c\n(x) Tj", lambda k, raw: None if k == "comment" else raw) == b"1 0 0 rg \n(x) Tj"


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=120))
def test_any_bytes_as_content(data):
    list(content.instructions(data))
    assert b"".join(raw for _, raw in content.tokens(data)) == data


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300))
def test_any_bytes_as_a_file(data):
    assert isinstance(tables.rows_of("x", b"%PDF-1.4\n1 0 obj " + data, "docs"), list)


@settings(max_examples=60, deadline=None)
@given(st.sampled_from([1, 2, 4, 8, 16]), st.integers(1, 16), st.integers(1, 16), st.sampled_from(["/DeviceGray", "/DeviceRGB", "/DeviceCMYK"]), st.randoms())
def test_random_images(bits, width, height, space, rng):
    n = pixels.CHANNELS[space]
    row = (width * n * bits + 7) // 8
    raw = bytes(rng.randrange(256) for _ in range(row * height))
    got = pixels.samples(raw, width, height, n, bits)
    for y in range(height):
        line = int.from_bytes(raw[y * row : (y + 1) * row], "big")
        for i in range(width * n):
            want = line >> (row * 8 - (i + 1) * bits) & ((1 << bits) - 1)
            assert got[y].ravel()[i] == (want >> 8 if bits == 16 else want)
    assert pixels.extract(raw, width, height, bits, space, [])[1].startswith(b"\x89PNG")
    with pytest.raises(Malformed):
        pixels.samples(raw[:-1], width, height, n, bits)


def test_image_files():
    assert pixels.extract(b"\xff\xd8", 1, 1, 8, "/DeviceRGB", ["/DCTDecode"]) == (".jpg", b"\xff\xd8")
    kind, tiff = pixels.extract(b"abc", 8, 3, 1, "/DeviceGray", ["/CCITTFaxDecode"], {"/K": -1})
    assert kind == ".tif" and tiff.endswith(b"abc") and tiff.startswith(b"II*\0")
    with pytest.raises(Malformed):
        pixels.extract(b"", 1, 1, 8, "/DeviceRGB", ["/JBIG2Decode"])
    import numpy as np

    assert pixels.decoded(np.array([[[0], [255]]]), [1, 0]).ravel().tolist() == [255, 0]
    assert pixels.colorkey(np.array([[[1, 2], [9, 2]]]), [0, 3, 0, 3]).tolist() == [[0, 255]]
    assert pixels.through_palette(np.array([[[1], [5]]]), bytes(range(6)), "/DeviceRGB").tolist() == [[[3, 4, 5], [3, 4, 5]]]


def test_xmp():
    props = {"dc:title": ["T & <t>"], "dc:creator": ["A", "B"], "dc:subject": ["z", "a"], "pdfaid:part": ["2"], "xmp:CreatorTool": [""]}
    assert dict(xmp.properties(xmp.packet(props))) == props | {"dc:subject": ["a", "z"]}
    bad = xmp.packet(props).replace(b"<pdfaid:part>2", b"<pdfaid:part>\x0b2")
    assert dict(xmp.properties(bad))["pdfaid:part"] == ["2"]
    assert list(xmp.properties(b'<!DOCTYPE x [<!ENTITY a "b">]><x/>')) == [] and list(xmp.properties(b"no xml")) == []


def test_canvas():
    c = Canvas((200, 100)).text(10, 10, "Hi", 10).line(0, 0, 5, 5).rect(1, 1, 2, 2, True).image(b"\x80", 1, 1, 8, "/DeviceGray", 0, 0, 20, 20)
    doc = Document(c.to_file())
    body = doc.content(doc.pages()[0][1])
    assert b"(Hi) Tj" in body and b"/Im0 Do" in body and doc.pages()[0][1]["/MediaBox"] == [0, 0, 200, 100]
    assert Content().push().cm(1, 0, 0, 1, 0, 0).pop().build() == b"q\n1 0 0 1 0 0 cm\nQ"
    assert helvetica_width("AB", 10) == (667 + 667) / 100


def rich():
    """Actions in every slot, attachments, labels, fields, outline with a circle."""
    b = sample(2)
    js = lambda text=b"x": {N("/S"): N("/JavaScript"), N("/JS"): text}
    uri = {N("/S"): N("/URI"), N("/URI"): b"http://e.example"}
    loop = b.add(None)
    b.objects[loop.obj, 0] = {N("/S"): N("/Named"), N("/N"): N("/NextPage"), N("/Next"): [b.add(js() | {N("/Next"): b.add({N("/S"): N("/Named"), N("/N"): N("/LastPage"), N("/Next"): loop})}), uri]}
    link = b.add({N("/Subtype"): N("/Link"), N("/Rect"): [0, 0, 1, 1], N("/A"): loop, N("/F"): 4})
    dest = b.add({N("/Subtype"): N("/Link"), N("/Rect"): [0, 0, 1, 1], N("/Dest"): b"chapter"})
    widget = b.add({N("/Subtype"): N("/Widget"), N("/A"): js(), N("/AA"): {N("/E"): js()}})
    file = b.add({N("/Type"): N("/Filespec"), N("/F"): b"a.txt", N("/EF"): {N("/F"): b.add(Stream({N("/Subtype"): N("/text/plain")}, b"attached"))}})
    page = b.objects[b.kids[0].obj, 0]
    page[N("/Annots")], page[N("/AA")], page[N("/AF")], page[N("/Thumb")] = [link, dest, widget], {N("/O"): js()}, [file], b.add(Stream({}, b"t"))
    child = b.add({N("/T"): b"b", N("/V"): b"v", N("/AA"): {N("/K"): js()}})
    parent = b.add({N("/T"): b"a", N("/FT"): N("/Tx"), N("/Ff"): 2, N("/Kids"): [child]})
    b.objects[child.obj, 0][N("/Parent")] = parent
    item = b.add({N("/Title"): b"One", N("/A"): js()})
    b.objects[item.obj, 0][N("/Next")] = item
    b.root |= {
        N("/OpenAction"): js(), N("/AA"): {N("/WC"): js()}, N("/AcroForm"): {N("/Fields"): [parent]}, N("/Outlines"): {N("/First"): item},
        N("/Names"): {N("/JavaScript"): {N("/Names"): [b"s", js()]}, N("/EmbeddedFiles"): {N("/Names"): [b"a.txt", file]}, N("/Dests"): {N("/Names"): [b"chapter", [b.kids[1], N("/Fit")]]}},
        N("/PageLabels"): {N("/Nums"): [0, {N("/S"): N("/r"), N("/St"): 4}, 1, {N("/S"): N("/A"), N("/P"): b"P-"}]}, N("/Collection"): {},
        N("/Metadata"): b.add(Stream({}, xmp.packet({"dc:title": ["x"]}))),
    }
    return b.bytes()


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([("rich", bytearray(rich())), ("four", bytearray(sample().bytes())), ("packed", bytearray(packed_file())), ("bad", bytearray(b"junk")), ("none", None)], "path string, content binary")


def rows(df, path="rich"):
    return [r.asDict() for r in df.where(f"path = '{path}'").collect()]


def test_tables(files):
    docs = {r.path: r for r in tables.tables(files, "docs").collect()}
    assert docs["rich"].n_pages == 2 and docs["four"].n_pages == 4 and docs["packed"].n_pages == 1 and docs["bad"].problem and docs["none"].problem
    for name in tables.SCHEMAS:
        got = tables.tables(files, name)
        assert got.where("path = 'rich'").count() > 0 or name in ("images", "image_files", "problems"), name
        assert got.limit(0).count() == 0
    assert [(r["page_index"], r["label"]) for r in rows(tables.tables(files, "pages"))] == [(0, "iv"), (1, "P-A")]
    assert [(r["full_name"], r["type"], r["flags"], r["is_terminal"]) for r in rows(tables.tables(files, "fields"))] == [("a", "/Tx", 2, False), ("a.b", "/Tx", 2, True)]
    link = [r for r in rows(tables.tables(files, "actions")) if r["holder"] == "annotation 0.0"]
    assert [r["subtype"] for r in link] == ["Named", "JavaScript", "Named", "URI"]
    assert [(r["title"], r["place"]) for r in rows(tables.tables(files, "outline"))] == [("One", [0])]
    assert rows(tables.tables(files, "attachments"))[0]["data"] == b"attached"
    assert {r["key"]: r["value"] for r in rows(tables.tables(files, "docinfo"))} == {"/Title": "A title", "/Author": "Ünï"}
    assert rows(tables.tables(files, "xmp"))[0]["values"] == ["x"]
    assert {r["operator"] for r in rows(tables.tables(files, "instructions", operators="q"), "four")} == {"q", "Q"}


def test_ctm_over_files(files):
    from pyspark.sql import functions as F
    from quire.operators.content import ctm

    data = Canvas().image(b"\x80", 1, 1, 8, "/DeviceGray", 3, 4, 20, 30).to_file()
    one = files.sparkSession.createDataFrame([("c", bytearray(data))], "path string, content binary")
    got = tables.tables(one, "instructions").select("path", "page_index", "seq", "operator", F.col("numbers").alias("operands"), F.get("operands", F.lit(0)).alias("name"))
    assert [(r.name, r.ctm) for r in ctm(got, ("path", "page_index")).collect()] == [("/Im0", [20.0, 0.0, 0.0, 30.0, 3.0, 4.0])]


def test_sources(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(rich())
    (tmp_path / "b.pdf").write_bytes(sample().bytes())
    datasource.register(spark)
    got = spark.read.format("pages").option("path", str(tmp_path)).option("table", "pages").load()
    assert got.count() == 6 and tables.read(spark, str(tmp_path / "*.pdf"), "pages").count() == 6
    tables.read(spark, str(tmp_path / "b.pdf"), "docs").createOrReplaceTempView("d")
    spark.createDataFrame([(bytearray(b"q 1 0 0 1 0 0 cm Q"),)], "content binary").createOrReplaceTempView("c")
    assert [r.operator for r in spark.sql("SELECT i.operator FROM c, LATERAL content_instructions(c.content, 'q') i").collect()] == ["q", "Q"]


def test_objects_to_files_and_json(files):
    good = files.where("path in ('rich', 'four', 'packed')")
    objects, roots = tables.tables(good, "objects"), tables.tables(good, "docs").select("path", "trailer")
    again = datasource.to_files(objects, roots)
    assert {r.path: r.n_pages for r in tables.tables(again, "docs").collect()} == {"rich": 2, "four": 4, "packed": 1}
    back = datasource.from_json_rows(datasource.to_json_rows(objects)).select("path", "obj", "gen", "value", "raw")
    assert sorted(map(str, back.collect())) == sorted(map(str, objects.select("path", "obj", "gen", "value", "raw").collect()))
    with pytest.raises(ValueError):
        datasource.to_files(objects, roots, Options(normalize=True, linearize=True))


def subtypes(df):
    return {r["subtype"] for r in rows(tables.tables(df.drop("problem"), "actions"))}


def test_sanitizer(files):
    clean = Sanitizer().remove_javascript().remove_external_access().remove_multimedia().remove_attachments().remove_thumbnails().remove_collection().remove_private_app_data().remove_web_capture().remove_search_index()
    once = clean.apply(files)
    assert {r.path for r in once.where("problem is not null").collect()} == {"bad", "none"}
    good = once.where("problem is null")
    assert subtypes(good) == {"Named"} and not rows(tables.tables(good, "attachments"))
    link = [r for r in rows(tables.tables(good, "actions")) if r["holder"] == "annotation 0.0"]
    assert [r["pos"] for r in link] == [0, 1]  # the survivor of the removed action took its place
    assert {r.path: bytes(r.content) for r in clean.apply(good).collect()} == {r.path: bytes(r.content) for r in good.collect()}
    assert subtypes(Sanitizer().remove_javascript().apply(files)) == {"Named", "URI"}
    same = {r.path: bytes(r.content) for r in Sanitizer().apply(files).where("problem is null").collect()}
    assert same["four"] == Editor(sample().bytes()).bytes()


def texts(data):
    doc = Document(bytes(data))
    return [doc.content(p).split(b"(")[1].split(b")")[0].decode()[5:] for _, p in doc.pages()]


def test_jobs(files):
    four = files.where("path = 'four'")
    run = lambda job: job.run(four).first()
    assert texts(run(Job().pages("r1,1-2")).content) == ["3", "0", "1"] and texts(run(Job().pages("z-1")).content) == ["3", "2", "1", "0"]
    turned = Document(bytes(run(Job().rotate(90, "2").rotate(180, "2")).content))
    assert [p.get("/Rotate", 0) for _, p in turned.pages()] == [0, 270, 0, 0]
    parts = Job().split(3).run(four).orderBy("part").collect()
    assert [texts(r.content) for r in parts] == [["0", "1", "2"], ["3"]]
    assert run(Job().pages("9")).problem and not run(Job().pages("9")).content
    labelled = files.sparkSession.createDataFrame([("x", run(Job().set_page_labels([(0, "r", "", 1), (2, "D", "S-", 5)])).content)], "path string, content binary")
    assert [r.label for r in tables.tables(labelled, "pages").orderBy("page_index").collect()] == ["i", "ii", "S-5", "S-6"]
    attached = Document(bytes(run(Job().attach("n.txt", b"data", "text/plain").attach("m", b"")).content))
    assert len(attached.tree(attached.get(attached.get(attached.trailer["/Root"])["/Names"])["/EmbeddedFiles"], "/Names")) == 2
    stamp = Canvas().text(1, 1, "stamp").to_file()
    for under in (False, True):
        doc = Document(bytes(run(Job().overlay(stamp, under)).content))
        assert b"/Fx0 Do" in doc.content(doc.pages()[3][1])
    plain = bytes(run(Job().uncompressed().coalesce_contents()).content)
    assert b"(page 1) Tj" in plain and b"%PDF-1.9" in bytes(run(Job().force_version("1.9")).content)
    assert "/Info" not in Document(bytes(run(Job().remove("info", "metadata")).content)).trailer
    for bad in (Job().linearize().normalize_content(), Job().rotate(45), Job({"nonsense": 1}), Job().compress(11), Job().split(0)):
        with pytest.raises(ValueError):
            bad.run(four)
    spec = Job().pages("1").rotate(90).to_json()
    assert Job(spec).to_json() == spec


def test_merge(spark):
    data = [("m", 2, bytearray(sample(1).bytes())), ("m", 1, bytearray(sample(3).bytes())), ("bad", 1, bytearray(b"x"))]
    df = spark.createDataFrame(data, "target string, seq long, content binary")
    got = {r.target: r for r in Job().merge(df).collect()}
    assert texts(got["m"].content) == ["0", "1", "2", "0"] and got["bad"].problem
    assert texts(Job().collate(1).merge(df.where("target = 'm'")).first().content) == ["0", "0", "1", "2"]


def test_page_copy():
    target, source = Editor(rich()), Editor(rich())
    got = target.copy_pages(source, [0, 1])
    doc = Document(target.bytes())
    assert got["renamed_dests"] == {"chapter": "chapter.1"} and not got["dropped_dests"] and len(doc.pages()) == 4
    dests = dict(doc.tree(doc.get(doc.get(doc.trailer["/Root"])["/Names"])["/Dests"], "/Names"))
    assert doc.get(dests[b"chapter.1"])[0] == doc.pages()[3][0] and doc.get(dests[b"chapter"])[0] == doc.pages()[1][0]
    alone = Editor()
    assert alone.copy_pages(source, [0])["dropped_dests"] == ["chapter"]
    with pytest.raises(IndexError):
        alone.copy_pages(source, [-3])
    with pytest.raises(IndexError):
        alone.copy_pages(source, [0], at=9)


def test_page_numbers():
    assert page_numbers("1,r1,z,2-3,3-2", 4) == [0, 3, 3, 1, 2, 2, 1]
    for bad in ("0", "5", "r5", "x"):
        with pytest.raises(ValueError):
            page_numbers(bad, 4)


def test_streaming(spark, tmp_path):
    from quire import streaming

    src = tmp_path / "in"
    src.mkdir()
    go = lambda: streaming.ingest(spark, str(src), str(tmp_path / "out"), str(tmp_path / "ck"), "pages").awaitTermination()
    (src / "a.pdf").write_bytes(sample().bytes())
    go()
    (src / "b.pdf").write_bytes(rich())
    go()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6


def test_dates_and_strings(spark):
    from pyspark.sql import functions as F
    from quire.functions import text

    given_ = ["D:20240229123045+05'30'", "D:20240229123045Z00'00'", "20240229", "2024", "D:2024022912304", "x", None, "D:20241399"]
    df = spark.createDataFrame([(i, g) for i, g in enumerate(given_)], "i int, d string")
    got = [r.t for r in df.select(text.parse_pdf_date(F.col("d")).alias("t"), "i").orderBy("i").collect()]
    at = datetime.datetime(2024, 2, 29, 12, 30, 45)
    assert got == [at, at, datetime.datetime(2024, 2, 29), datetime.datetime(2024, 1, 1), None, None, None, None]
    raw = spark.createDataFrame([(bytearray(b),) for b in (b"caf\xe9 \x92", b"\xfe\xff\x04\x16", b"\xef\xbb\xbf\xc3\xa9")], "raw binary")
    assert [r.t for r in raw.select(text.text_string(F.col("raw")).alias("t")).collect()] == ["café ™", "Ж", "é"]
    words = spark.createDataFrame([("Ŝ",), ("plain",), ("• €",)], "t string")
    assert [(r.a, r.b) for r in words.select(text.pdfdoc_encodable(F.col("t")).alias("a"), text.pdfdoc_decode(text.pdfdoc_encode(F.col("t"))).alias("b")).collect()] == [(False, "?"), (True, "plain"), (True, "• €")]
    assert [bytes(r.x) for r in words.select(text.docinfo_bytes(F.col("t")).alias("x")).collect()][:2] == [b"\xfe\xff\x01\x5c", b"plain"]


def test_rules(spark):
    from pyspark.sql import functions as F
    from quire.functions import values

    df = spark.createDataFrame([(2, False, False), (1, False, False), (3, True, False), (6, False, False), (6, True, True), (4, False, True)], "r int, aes boolean, meta boolean")
    got = [r[0] for r in df.select(values.encryption_problem(F.col("r"), F.col("aes"), F.col("meta"))).collect()]
    assert [x is None for x in got] == [True, False, False, False, True, False]
    pairs = spark.createDataFrame([("boolean", "true", "integer", "1"), ("real", "1.0", "integer", "1"), ("string", "1", "integer", "1"), ("name", "/A", "name", "/A")], "a string, b string, c string, d string")
    assert [r[0] for r in pairs.select(values.known_equal(*map(F.col, "abcd"))).collect()] == [True, True, False, True]
    typed = spark.createDataFrame([("integer", "3"), ("real", "2.5"), ("name", "/x")], "t string, v string")
    one = typed.select(values.as_int(F.col("t"), F.col("v"), F.lit(None).cast("long")), values.as_float(F.col("t"), F.col("v"), F.lit(-1.0)), values.as_bool(F.col("t"), F.col("v"), F.lit(False)))
    assert [tuple(r) for r in one.collect()] == [(3, 3.0, False), (None, 2.5, False), (None, -1.0, False)]


def test_graft(spark):
    from quire.operators.actions import graft

    tree = [(1, 1, None, 0, "A"), (1, 2, 1, 0, "X"), (1, 3, 2, 0, "B"), (1, 4, 2, 1, "X"), (1, 5, 4, 0, "C"), (1, 6, 1, 1, "D")]
    got = graft(spark.createDataFrame(tree, "holder int, node int, parent int, pos int, subtype string"), ["X"])
    assert sorted((r.node, r.parent, r.pos) for r in got.collect()) == [(1, None, 0), (3, 1, 0), (5, 1, 1), (6, 1, 2)]


def test_written_object_streams():
    from quire.sources.crypt import Encryption

    b = Builder()
    for i in range(250):
        b.page(b"q Q", None, (0, 0, 100 + i, 100))
    b.info = {N("/Title"): b"t"}
    plain = Document(b.bytes())
    for options, password in ((Options(object_streams=True), b""), (Options(object_streams=True, encrypt=Encryption(owner="o", user="u", revision=4)), b"u")):
        made = Document(b.bytes(options), password=password)
        assert not made.rebuilt and [p["/MediaBox"] for _, p in made.pages()] == [p["/MediaBox"] for _, p in plain.pages()]
        assert made.content(made.pages()[249][1]).strip() == b"q Q" and made.get(made.trailer["/Info"])["/Title"] == b"t"
    with pytest.raises(ValueError):
        b.bytes(Options(object_streams=True, force_version="1.4"))


def test_graft_of_any_depth(spark):
    """A chain of 200 nodes of which every second goes, a run of 120 that goes as a whole, and a circle."""
    from quire.operators.actions import graft

    chain = [(1, i, i - 1 if i else None, 0, "X" if i % 2 else "A") for i in range(200)]
    run = [(2, i, i - 1 if i else None, 0, "A" if i in (0, 121) else "X") for i in range(122)]
    circle = [(3, 0, None, 0, "A"), (3, 1, 2, 0, "X"), (3, 2, 1, 0, "X"), (3, 3, 2, 0, "A")]
    got = graft(spark.createDataFrame(chain + run + circle, "holder int, node int, parent int, pos int, subtype string"), ["X"]).collect()
    of = lambda k: sorted((r.node, r.parent) for r in got if r.holder == k)
    assert of(1) == [(i, i - 2 if i else None) for i in range(0, 200, 2)]
    assert of(2) == [(0, None), (121, 0)] and of(3) == [(0, None)]


def test_long_chains_of_actions_stay(spark):
    from quire.operators.actions import prune_chains

    rows = [(1, "A", i, "JavaScript" if i % 10 == 5 else "GoTo") for i in range(200)]
    got = prune_chains(spark.createDataFrame(rows, "holder int, slot string, pos int, subtype string"), ["JavaScript"]).collect()
    assert sorted(r.pos for r in got) == list(range(180)) and {r.subtype for r in got} == {"GoTo"}


def test_long_closure(spark):
    from quire.operators.graph import closure

    edges = spark.createDataFrame([(i, i + 1) for i in range(70)], "src int, dst int")
    assert closure(edges, spark.createDataFrame([(0,)], "node int")).count() == 71


def test_source_lists_any_store(tmp_path):
    from quire.sources.datasource import _matching

    for name in ("a.pdf", "b.pdf", "c.txt", "d/e.pdf", "d/f.pdf"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"")
    short = lambda path: [x[len(str(tmp_path)) + 1 :] for x in _matching(path)]
    for root in (str(tmp_path), f"file://{tmp_path}"):
        assert short(root) == ["a.pdf", "b.pdf"] and short(root + "/a.pdf") == ["a.pdf"]
        assert short(root + "/*.txt") == ["c.txt"] and short(root + "/*/*.pdf") == ["d/e.pdf", "d/f.pdf"] and short(root + "/[ab].pdf") == ["a.pdf", "b.pdf"]
        assert short(root + "/none") == []


def test_namespaces_can_be_registered():
    xmp.register_namespace("own", "http://own.example/ns/")
    assert dict(xmp.properties(xmp.packet({"own:thing": ["x"], "pdfuaid:part": ["1"]}))) == {"own:thing": ["x"], "pdfuaid:part": ["1"]}
    with pytest.raises(ValueError):
        xmp.register_namespace("own", "http://other.example/")


def test_masks_become_alpha():
    import numpy as np

    values = np.arange(12, dtype=np.uint8).reshape(2, 2, 3)
    alpha = np.array([[0, 255]], np.uint8)
    assert pixels.with_alpha(values, alpha)[..., 3].tolist() == [[0, 255], [0, 255]]
    kind, made = pixels.extract(values.tobytes(), 2, 2, 8, "/DeviceRGB", [], alpha=alpha)
    assert kind == ".png" and made[25] == 6
    assert zlib.decompress(made[41:-16]) == b"".join(b"\0" + bytes([*values[y, 0], 0, *values[y, 1], 255]) for y in range(2))
    assert pixels.extract(bytes(8), 2, 2, 16, "/DeviceGray", [])[1][24] == 16
    assert pixels.extract(bytes([5, 50]), 2, 1, 8, "/DeviceGray", [], keys=[0, 9])[1][25] == 4


def test_insert_past_the_end_is_told(spark):
    from quire.operators import pages

    own = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "doc_id int, page_index int")
    new = spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "doc_id int, page_index int")
    assert sorted(map(tuple, pages.insert_problems(own, 2, new).collect())) == [(2, "insert at 2 of 1 pages"), (3, "insert at 2 of 0 pages")]


def test_closure_ends_on_circles(spark):
    from quire.operators.graph import closure

    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "src int, dst int")
    got = closure(edges, spark.createDataFrame([(1,), (4,)], "node int"))
    assert sorted(map(tuple, got.collect())) == [(1, 1), (1, 2), (1, 3), (4, 4), (4, 5)]


def test_more_edits():
    b = Builder()
    state = lambda: b.add(Stream({N("/BBox"): [0, 0, 1, 1]}, b"0 0 1 1 re f"))
    widget = {N("/Subtype"): N("/Widget"), N("/Rect"): [10, 10, 60, 30], N("/F"): 4}
    text = b.add(widget | {N("/T"): b"name", N("/FT"): N("/Tx"), N("/MaxLen"): 5})
    box = b.add(widget | {N("/T"): b"ok", N("/FT"): N("/Btn"), N("/AP"): {N("/N"): {N("/On"): state(), N("/Off"): state()}}})
    pick = b.add(widget | {N("/T"): b"pick", N("/FT"): N("/Ch"), N("/Opt"): [b"a", b"b"]})
    b.root[N("/AcroForm")] = {N("/Fields"): [text, box, pick]}
    b.page(b"BI /W 1 /H 1 /BPC 8 /CS /G ID \x80\nEI /Used gs", {N("/ExtGState"): {N("/Used"): {}, N("/Unused"): {}}}, (0, 0, 100, 50), Annots=[text, box, pick], Rotate=90)
    e = Editor(b.bytes())
    assert e.set_field("name", "Jo\nhn Doe") == "cut to 5 characters" and e.fields()["name"]["field"]["/V"] == b"John "
    e.set_field("ok", True)
    assert e.fields()["ok"]["field"]["/AS"] == "/On"
    e.set_field("pick", "b")
    for name, value in (("pick", "c"), ("ok", "/Maybe")):
        with pytest.raises(ValueError):
            e.set_field(name, value)
    assert e.externalize_inline_images() == 1
    e.remove_unused_resources()
    e.flatten_annotations()
    e.flatten_rotation()
    doc = Document(e.bytes())
    (_, page), = doc.pages()
    body = doc.content(page)
    assert body.count(b" Do") == 4 and b"BI" not in body and "/Annots" not in page and "/Rotate" not in page
    assert set(doc.get(doc.get(page["/Resources"])["/ExtGState"])) == {"/Used"}
    assert [float(x) for x in page["/MediaBox"]] == [0, 0, 50, 100]
    with pytest.raises(ValueError):
        e.add_resource(e.get(e.pages()[0]), "/XObject", 1, "/Used")


def test_fonts():
    from quire.sources.fonts import SimpleFont, character, differences, lines_of

    assert [character(n) for n in ("/A", "/eacute", "/uni20AC", "/space", "/germandbls", "/g123")] == ["A", "é", "€", " ", "ß", None]
    assert differences([65, N("/B"), N("/strange"), 200, N("/ccedilla")]) == ({65: "B", 200: "ç"}, ["/strange"])
    f = SimpleFont(65, [500, 600], 100, changed={1: "ç"})
    assert f.encode("Aç€") == b"A\x01\x80" and f.width("AB\nA?", 10) == 11 and f.leading(10) == 10
    assert lines_of("aa bb cc\nd", 5, len) == ["aa bb", "cc", "d"]


def test_form_functions(spark):
    from pyspark.sql import functions as F
    from quire.functions import forms

    df = spark.createDataFrame([("a\nbcd", 0, 3), ("a\nbcd", 1 << 12, None), ("ab", 0, 3)], "v string, f long, n int")
    v, f, n = map(F.col, "vfn")
    assert [r[0] for r in df.select(forms.text_value(v, f, n)).collect()] == ["abc", "a\nbcd", "ab"]
    assert [r[0] for r in df.select(forms.was_cut(v, f, n)).collect()] == [True, False, False]
    kinds = spark.createDataFrame([("/Tx", 0), ("/Btn", 1 << 16), ("/Btn", 1 << 15), ("/Btn", 0), ("/Ch", 0), ("/Sig", 0), ("/X", 0)], "t string, f long")
    assert [r[0] for r in kinds.select(forms.field_kind(F.col("t"), F.col("f"))).collect()] == ["text", "button", "radio", "checkbox", "choice", "signature", None]
    one = spark.createDataFrame([("b", ["a", "b"], "/Helv 9 Tf 0 g /Cour 0 Tf", ["3 0 R", "/FitR", "1", "2", "3", "4"])], "v string, o array<string>, da string, d array<string>")
    r = one.select(forms.choice_value(F.col("v"), F.col("o"), F.lit(0)), forms.choice_value(F.lit("z"), F.col("o"), F.lit(0)), forms.default_appearance(F.col("da")), forms.destination(F.col("d")), forms.comb_positions(F.lit("abc"), 100, 4)).first()
    assert r[0] == "b" and r[1] is None and tuple(r[2]) == ("/Cour", 11.0) and tuple(r[3]) == ("3 0 R", "FitR", 1.0, 2.0, 3.0, 4.0, None) and r[4] == [12.5, 37.5, 62.5]
    path = forms.Path("Root").Kids[-1]["/Name"]
    assert path == forms.Path("/Root", "Kids", -1, "Name")
    tree = spark.createDataFrame([('{"/Root":{"/Kids":[{"/Name":"u:x"},{"/Name":"u:y"}]}}',), ("{}",)], "j string")
    assert [x[0] for x in tree.select(path.of(F.col("j"))).collect()] == ["u:y", None]


def test_ciphers():
    from quire.sources import crypt

    # The examples of the standards.
    assert crypt.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    plain = bytes.fromhex("00112233445566778899aabbccddeeff")
    for key, coded in (("000102030405060708090a0b0c0d0e0f", "69c4e0d86a7b0430d8cdb78070b4c55a"), ("000102030405060708090a0b0c0d0e0f101112131415161718191a1b1c1d1e1f", "8ea2b7ca516745bfeafc49904b496089")):
        assert crypt.aes_encrypt(bytes.fromhex(key), bytes(16), plain).hex() == coded
        assert crypt.aes_decrypt(bytes.fromhex(key), bytes(16), bytes.fromhex(coded)) == plain
    data = bytes(range(256)) * 3
    assert crypt.aes_decrypt(b"k" * 16, b"i" * 16, crypt.aes_encrypt(b"k" * 16, b"i" * 16, data)) == data


@pytest.mark.parametrize(("revision", "aes"), [(2, False), (3, False), (4, False), (4, True), (5, True), (6, True)])
def test_encrypted_files(spark, revision, aes):
    from quire.sources.crypt import Encryption, WrongPassword

    rules = Encryption("boss", "me", revision, aes, True, frozenset({"extract"}))
    data = sample().bytes(Options(encrypt=rules, static_id=True))
    assert b"A title" not in data and b"page 2" not in data
    for password, owner in ((b"me", False), (b"boss", True)):
        doc = Document(data, password=password)
        assert b"(page 2) Tj" in doc.content(doc.pages()[2][1]) and doc.get(doc.get(doc.trailer["/Info"])["/Title"]) == b"A title"
        assert doc.handler.by_owner == owner and doc.handler.allowed()["extract"] == owner and doc.handler.allowed()["print_highres"]
    with pytest.raises(WrongPassword):
        Document(data, password=b"other")
    if revision == 6:
        df = spark.createDataFrame([("x", bytearray(data))], "path string, content binary")
        assert tables.tables(df, "docs").first().problem and tables.tables(df, "pages").count() == 0
        assert tables.tables(df, "docs", password="me").first().encryption.streams == "aes256" and tables.tables(df, "pages", password="me").count() == 4
        plain = Job().password("boss").run(df).first()
        assert len(Document(bytes(plain.content)).pages()) == 4 and not Document(bytes(plain.content)).encrypted
        again = Job().password("boss").encrypt(user="new", revision=4).run(df).first()
        assert Document(bytes(again.content), password=b"new").handler.streams == "aes128"


def test_encryption_rules():
    from quire.sources.crypt import Encryption

    for bad in (Encryption(revision=1), Encryption(revision=3, aes=True), Encryption(revision=6, aes=False), Encryption(revision=3, aes=False, metadata=False), Encryption(denied=frozenset({"x"}))):
        with pytest.raises(ValueError):
            sample().bytes(Options(encrypt=bad))
    with pytest.raises(ValueError):
        sample().bytes(Options(encrypt=Encryption(), normalize=True))


def test_fields_renamed_and_removed():
    e = Editor(rich())
    assert e.orphaned_widgets() == 1 and set(e.fields()) == {"a.b"}
    e.rename_field("a.b", "c")
    assert set(e.fields()) == {"a.c"}
    e.remove_fields(["a.c"])
    assert not e.fields() and not Document(e.bytes()).get(Document(e.bytes()).get(e.root["/AcroForm"])["/Fields"])
    b = Builder()
    signed = b.add({N("/Subtype"): N("/Widget"), N("/T"): b"s", N("/FT"): N("/Sig"), N("/V"): {}})
    b.root[N("/AcroForm")] = {N("/Fields"): [signed], N("/SigFlags"): 3}
    b.page(b"0 0 5 5 re f", Annots=[signed])
    e = Editor(b.bytes())
    with pytest.raises(ValueError):
        e.set_field("s", "x")
    e.disable_signatures()
    assert e.fields()["s"].get("/FT") is None and "/SigFlags" not in e.root["/AcroForm"]
    assert e.get(e.as_form(0)).raw == b"0 0 5 5 re f"
    e.remove_fields(["s"])
    assert e.get(e.pages()[0])["/Annots"] == []


def test_long_chains_are_pruned_whole(spark):
    from quire.operators.actions import prune_chains

    kind = lambda i: "X" if i % 3 == 1 else "keep"
    rows = [(1, "A", i, kind(i)) for i in range(200)]
    got = prune_chains(spark.createDataFrame(rows, "holder int, slot string, pos int, subtype string"), ["X"]).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(133)) and [r.next_pos for r in got] == [*range(1, 133), None]


def test_long_chains_in_files():
    n, editor = 3000, Editor(sample(1).bytes())
    refs = [editor.add({N("/S"): N("/JavaScript" if i % 3 == 1 else "/Named"), N("/N"): i}) for i in range(n)]
    for a, b in zip(refs, refs[1:] + refs[:1], strict=True):
        editor.get(a)[N("/Next")] = b
    editor.root[N("/OpenAction")] = refs[0]
    editor.remove_actions({"JavaScript"})
    at, left = refs[0], []
    while at is not None:
        left.append(editor.get(at)["/N"])
        at = editor.get(at).get("/Next")
    assert left == [i for i in range(n) if i % 3 != 1]


def test_closure_of_a_long_chain(spark):
    from quire.operators.graph import closure

    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(200, 150)], "src int, dst int")
    got = closure(edges, spark.createDataFrame([(0,)], "node int"))
    assert sorted(r.node for r in got.collect()) == list(range(201))


def test_deeply_nested_images_and_destinations():
    b = Builder()
    inner = b.add(Stream({N("/Subtype"): N("/Image"), N("/Width"): 1, N("/Height"): 1, N("/BitsPerComponent"): 8, N("/ColorSpace"): N("/DeviceGray")}, b"x"))
    for _ in range(60):
        inner = b.add(Stream({N("/Subtype"): N("/Form"), N("/BBox"): [0, 0, 1, 1], N("/Resources"): {N("/XObject"): {N("/X"): inner}}}, b"/X Do"))
    b.page(b"/X Do", {N("/XObject"): {N("/X"): inner}}, Annots=[])
    assert [r[2] for r in tables.rows_of("f", b.bytes(), "images")] == ["/X" * 61]
    editor = Editor(b.bytes())
    refs = [editor.add({N("/S"): N("/GoTo"), N("/D"): b"d%d" % i}) for i in range(120)]
    for one, after in zip(refs, refs[1:] + refs[:1], strict=True):
        editor.get(one)[N("/Next")] = after
    page = editor.pages()[0]
    editor.get(page)[N("/Annots")] = [editor.add({N("/Subtype"): N("/Link"), N("/A"): refs[0]})]
    assert [h["/D"] for h, key in editor._holders([page]) if key == "/D"] == [b"d%d" % i for i in range(120)]
