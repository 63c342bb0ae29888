"""Queries on files that are made of the driver's tables, and the same in SQL on the tables.

A conversation becomes a file: a page for each turn, with content, an image, a link with a
chain of actions, a form field and an outline item; labels, names, an attachment, metadata.
What the reader, the editor, the sanitizer and jobs make of these files is told by SQL on the
conversations themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import images
from quire.operators import actions, metadata
from quire.plans.jobs import Job
from quire.plans.sanitizer import Sanitizer, edited
from quire.session import batched, kept, shared_folder, shipped, spread, table
from quire.sources import datasource, tables, xmp
from quire.sources.edit import Editor
from quire.sources.values import Name, Stream
from quire.sources.writer import Builder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str) -> Callable:
    """Registers a function under its name, with its SQL over ``t``: a row for each turn, ``i`` its place, ``n`` how many there are."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = f"WITH RECURSIVE t AS (SELECT CAST(conv_id AS VARCHAR) AS path, conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) {sql}"
        return f

    return add


def _named(**entries) -> dict:
    return {Name("/" + k): v for k, v in entries.items()}


def chat_file(conv: int, turns: list[tuple[int, str]]) -> bytes:
    """A conversation's file."""
    b = Builder()
    items, kids, dests, fields = [], {}, [], []
    parent = b.add(_named(T=b"form", FT=Name("/Tx")))
    for i, (turn, role) in enumerate(turns):
        said = role.encode()
        image = b.add(Stream(_named(Type=Name("/XObject"), Subtype=Name("/Image"), Width=2, Height=i + 1, BitsPerComponent=8, ColorSpace=Name("/DeviceGray")), bytes(range(2 * (i + 1)))))
        after = [b.add(_named(S=Name("/URI"), URI=b"http://h.example/%d" % turn)), b.add(_named(S=Name("/GoTo"), D=b"d%d" % i)), b.add(_named(S=Name("/JavaScript"), JS=b"x()"))]
        link = b.add(_named(Type=Name("/Annot"), Subtype=Name("/Link"), Rect=[10, i, 50, 60 + i], F=4 * turn + i % 2, T=said, A=b.add(_named(S=Name("/GoTo"), D=b"d0", Next=after))))
        field = b.add(_named(T=b"t%d" % i, V=said, Ff=turn, Subtype=Name("/Widget"), Rect=[0, 0, 40, 20], F=4, Parent=parent))
        thumb = b.add(Stream({}, b"thumb"))
        content = f"q 1 0 0 1 {turn} {i} cm /Im0 Do Q\nBT /F1 12 Tf ({role}) Tj ET".encode()
        page = b.page(content, _named(XObject=_named(Im0=image)), (0, 0, 300 + 10 * turn, 400), Rotate=90 * (i % 4), Annots=[link, field], Thumb=thumb, PieceInfo=_named(App=_named(Private=1)))
        dests += [b"d%d" % i, [page, Name("/XYZ"), 0, i, None]]
        items.append(b.add(_named(Title=said, F=i % 4) | (_named(Dest=b"d%d" % i) if i % 3 else _named(A=_named(S=Name("/GoTo"), D=[page, Name("/Fit")])))))
        kids.setdefault(i // 2 - 1 if i >= 2 else None, []).append(i)
        fields.append(field)
    outlines = b.add(_named(Type=Name("/Outlines")))
    for over, under in kids.items():
        top = b.objects[(outlines if over is None else items[over]).obj, 0]
        top |= _named(First=items[under[0]], Last=items[under[-1]], Count=len(under) * (-1 if over is not None and over % 2 else 1))
        for k, at in enumerate(under):
            own = b.objects[items[at].obj, 0]
            own[Name("/Parent")] = outlines if over is None else items[over]
            if k:
                own[Name("/Prev")] = items[under[k - 1]]
            if k + 1 < len(under):
                own[Name("/Next")] = items[under[k + 1]]
    b.objects[parent.obj, 0][Name("/Kids")] = fields
    told = _named(Size=conv, CreationDate=b"D:20200101", ModDate=b"D:20210101", CheckSum=hashlib.md5(b"data of %d" % conv).digest())
    data = b.add(Stream(_named(Type=Name("/EmbeddedFile"), Subtype=Name("/text/plain"), Params=told), b"data of %d" % conv))
    spec = b.add(_named(Type=Name("/Filespec"), F=b"a.txt", UF=b"a%d.txt" % conv, Desc=b"one", EF=_named(F=data), AFRelationship=Name("/Data")))
    script = b.add(_named(S=Name("/JavaScript"), JS=b"y()"))
    b.root |= _named(
        Extensions=_named(ADBE=_named(BaseVersion=Name("/1.7"), ExtensionLevel=conv % 9)),
        Outlines=outlines,
        AcroForm=b.add(_named(Fields=[parent])),
        Names=_named(Dests=_named(Names=dests), EmbeddedFiles=_named(Names=[b"a", spec]), JavaScript=_named(Names=[b"s", script])),
        PageLabels=_named(Nums=[0, _named(S=Name(("/D", "/r", "/A")[conv % 3]), P=b"p", St=conv % 4 + 1)]),
        Metadata=b.add(Stream(_named(Type=Name("/Metadata"), Subtype=Name("/XML")), xmp.packet({"dc:title": [f"Conversation {conv}"], "dc:creator": [r for _, r in turns], "pdf:Producer": ["quire"]}))),
    )
    b.info = _named(Title=b"Conversation %d" % conv, Author=turns[0][1].encode())
    return b.bytes()


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, content``: a file for each conversation, its path the id. A file is one value, so its turns meet in one row."""
    turns = spread(table(spark, sf_dir, "conversations"), "conv_id").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((str(conv), chat_file(conv, [(t["turn"], t["role"]) for t in own])) for batch in batches for conv, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        yield from batched(rows, pa.schema([("path", pa.string()), ("content", pa.binary())]))

    return shipped(turns).mapInArrow(run, "path string, content binary")


def _read(spark: SparkSession, sf_dir: str, name: str, **options) -> DataFrame:
    return tables.tables(files(spark, sf_dir), name, **options)


def _by_page(made: DataFrame, name: str, columns: tuple[str, ...], *pages: str) -> DataFrame:
    """``columns`` of a table's rows of pages' objects, with ``page_index`` and more of the pages' columns."""
    rows = tables.several(made, {"pages": ("obj", "page_index", *pages), name: ("obj", *columns)})
    own = Window.partitionBy("path", F.coalesce("pages_obj", f"{name}_obj"))
    for column in ("page_index", *pages):
        rows = rows.withColumn(column, F.max(f"pages_{column}").over(own))
    return rows.where(F.col("table") == name).where("page_index is not null").select("path", "page_index", *pages, *(F.col(f"{name}_{c}").alias(c) for c in columns))


def _long(*names: str) -> list:
    return [F.col(n).cast("long").alias(n.rpartition(".")[2]) for n in names]


@query("SELECT path, conv_id % 9 AS extension, '1.7' AS version, false AS encrypted, false AS linearized, false AS rebuilt, n AS n_pages, 0 AS n_warnings, CAST(NULL AS VARCHAR) AS problem FROM t WHERE i = 0")
def file_documents(spark, sf_dir):
    return _read(spark, sf_dir, "docs").select("path", "version", "encrypted", "linearized", "rebuilt", *_long("n_pages", "extension"), F.size("warnings").cast("long").alias("n_warnings"), "problem")


_LABEL = "CASE conv_id % 3 WHEN 0 THEN CAST(k AS VARCHAR) WHEN 1 THEN ['i','ii','iii','iv','v','vi','vii','viii','ix','x','xi','xii','xiii','xiv','xv','xvi','xvii','xviii','xix','xx'][k] ELSE chr(CAST(64 + k AS INT)) END"


@query(f"SELECT path, i AS page_index, CAST(300 + 10 * turn AS DOUBLE) AS width, CAST(400 AS DOUBLE) AS height, 90 * (i % 4) AS rotate, 'p' || {_LABEL} AS label FROM (SELECT *, i + conv_id % 4 + 1 AS k FROM t)")
def file_pages(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("path", *_long("page_index"), F.col("mediabox")[2].alias("width"), F.col("mediabox")[3].alias("height"), *_long("rotate"), "label")


@query("SELECT path, i AS page_index, seq, operator, operands FROM t, LATERAL (VALUES (0, 'cm', '1 0 0 1 ' || turn || ' ' || i), (1, 'Do', '/Im0'), (2, 'Tj', '(' || role || ')')) AS v(seq, operator, operands)")
def file_instructions(spark, sf_dir):
    got = _read(spark, sf_dir, "instructions", operators="cm Do Tj")
    return got.select("path", *_long("page_index", "seq"), "operator", F.array_join("operands", " ").alias("operands"))


@query("SELECT path, i AS page_index, seq, operator FROM t, LATERAL (VALUES (0, 'q'), (1, 'cm'), (2, 'Do'), (3, 'Q'), (4, 'BT'), (5, 'Tf'), (6, 'Tj'), (7, 'ET')) AS v(seq, operator)")
def file_table_function(spark, sf_dir):
    datasource.register(spark)
    rows = tables.several(Job().uncompressed().run(files(spark, sf_dir)), {"objects": ("obj", "tag", "value", "raw"), "refs": ("obj", "at", "to_obj"), "pages": ("obj", "page_index")})
    rows = kept(rows.where("table = 'pages' or refs_at = '/Contents' or objects_tag = 'stream' and objects_value not like '%/Subtype%' and objects_raw is not null and cast(objects_raw as string) like 'q %'").drop("objects_tag", "objects_value"))
    raw = rows.where("table = 'objects'").select("path", F.col("objects_obj").alias("obj"), F.col("objects_raw").alias("raw"))
    parent = rows.where("table = 'refs'").select("path", F.col("refs_obj").alias("page"), F.col("refs_to_obj").alias("obj"))
    pages = rows.where("table = 'pages'").select("path", F.col("pages_page_index").alias("page_index"), F.col("pages_obj").alias("page"))
    raw.select("path", "obj", "raw").join(parent, ["path", "obj"]).join(pages, ["path", "page"]).createOrReplaceTempView("quire_contents")
    got = spark.sql("SELECT path, page_index, f.* FROM quire_contents, LATERAL content_instructions(raw, '') AS f")
    return got.select("path", *_long("page_index", "seq"), "operator")


@query("SELECT path, i AS page_index, 0 AS seq, 'Link' AS subtype, 4 * turn + i % 2 AS flags, CAST(60 + i AS DOUBLE) AS top, role AS name FROM t UNION ALL SELECT path, i, 1, 'Widget', 4, 20, 't' || i FROM t")
def file_annotations(spark, sf_dir):
    got = _read(spark, sf_dir, "annotations")
    return got.select("path", *_long("page_index", "seq"), F.ltrim(F.col("subtype"), F.lit("/")).alias("subtype"), *_long("flags"), F.col("rect")[3].alias("top"), "name")


_PLACES = ", d AS (SELECT path, i, CAST(i AS VARCHAR) AS place FROM t WHERE i < 2 UNION ALL SELECT t.path, t.i, d.place || '.' || (t.i % 2) FROM d JOIN t ON t.path = d.path AND t.i >= 2 AND t.i // 2 - 1 = d.i)"
_ACTIONS = _PLACES + " SELECT path, 'annotation ' || i || '.0' AS holder, '/A' AS slot, pos, subtype FROM t, LATERAL (VALUES (0, 'GoTo'), (1, 'URI'), (2, 'GoTo'), (3, 'JavaScript')) AS v(pos, subtype)"


@query(f"{_ACTIONS} UNION ALL SELECT path, 'outline ' || place, '/A', 0, 'GoTo' FROM d WHERE i % 3 = 0 UNION ALL SELECT path, 'names', '/JavaScripts', 0, 'JavaScript' FROM t WHERE i = 0")
def file_actions(spark, sf_dir):
    return _read(spark, sf_dir, "actions").select("path", "holder", "slot", *_long("pos"), "subtype")


@query("SELECT path, i AS page, pos, CASE pos WHEN 1 THEN 'http://h.example/' || turn END AS uri, CASE pos WHEN 0 THEN 'd0' WHEN 2 THEN 'd' || i END AS dest, CASE pos WHEN 3 THEN 'x()' END AS script FROM t, (VALUES (0), (1), (2), (3)) v(pos)")
def file_action_arguments(spark, sf_dir):
    got = actions.uris(_read(spark, sf_dir, "actions").where("holder like 'annotation%'"))
    return got.select("path", F.regexp_extract("holder", r"(\d+)[.]", 1).cast("long").alias("page"), *_long("pos"), "uri", "dest", "script")


@query(", d AS (SELECT path, i, role, 1 AS depth, CAST(i AS VARCHAR) AS place FROM t WHERE i < 2 UNION ALL SELECT t.path, t.i, t.role, d.depth + 1, d.place || '.' || (t.i % 2) FROM d JOIN t ON t.path = d.path AND t.i >= 2 AND t.i // 2 - 1 = d.i) SELECT d.path, place, depth, role AS title, EXISTS (SELECT 1 FROM t WHERE t.path = d.path AND t.i >= 2 AND t.i // 2 - 1 = d.i) AND d.i % 2 = 1 AS closed, d.i % 4 & 1 = 1 AS italic, d.i % 4 & 2 = 2 AS bold, d.i AS page FROM d")
def file_outline(spark, sf_dir):
    return _read(spark, sf_dir, "outline").select("path", F.array_join(F.col("place").cast("array<string>"), ".").alias("place"), *_long("depth"), "title", "closed", "italic", "bold", *_long("page"))


@query("SELECT path, 'form.t' || i AS full_name, '/Tx' AS type, role AS value, turn AS flags, true AS is_terminal FROM t UNION ALL SELECT path, 'form', '/Tx', NULL, 0, false FROM t WHERE i = 0")
def file_fields(spark, sf_dir):
    return _read(spark, sf_dir, "fields").select("path", "full_name", "type", "value", *_long("flags"), "is_terminal")


@query("SELECT path, '/Dests' AS tree, i AS seq, 'd' || i AS key FROM t UNION ALL SELECT path, '/EmbeddedFiles', 0, 'a' FROM t WHERE i = 0 UNION ALL SELECT path, '/JavaScript', 0, 's' FROM t WHERE i = 0 UNION ALL SELECT path, '/PageLabels', 0, NULL FROM t WHERE i = 0")
def file_name_trees(spark, sf_dir):
    return _read(spark, sf_dir, "names").select("path", "tree", *_long("seq"), "key")


@query("SELECT path, '/Title' AS key, 'Conversation ' || conv_id AS value FROM t WHERE i = 0 UNION ALL SELECT path, '/Author', role FROM t WHERE i = 0")
def file_docinfo(spark, sf_dir):
    return _read(spark, sf_dir, "docinfo")


@query("SELECT path, 'dc:title' AS name, 'Conversation ' || conv_id AS value FROM t WHERE i = 0 UNION ALL SELECT path, 'dc:creator', string_agg(role, ';' ORDER BY i) FROM t GROUP BY path UNION ALL SELECT path, 'pdf:Producer', 'quire' FROM t WHERE i = 0")
def file_xmp(spark, sf_dir):
    return _read(spark, sf_dir, "xmp").select("path", "name", F.array_join("values", ";").alias("value"))


@query("SELECT path, 'a' AS key, 'a' || conv_id || '.txt' AS filename, 'one' AS description, 'text/plain' AS mime, md5('data of ' || conv_id) AS digest, conv_id AS size, 'D:20200101' AS created, 'D:20210101' AS modified, md5('data of ' || conv_id) AS checksum, 'Data' AS relationship FROM t WHERE i = 0")
def file_attachments(spark, sf_dir):
    return _read(spark, sf_dir, "attachments").select("path", "key", "filename", "description", "mime", F.md5("data").alias("digest"), "size", "created", "modified", "checksum", "relationship")


@query("SELECT path, i AS page_index, '/Im0' AS name, 2 AS width, i + 1 AS height, 8 AS bits, '/DeviceGray' AS colorspace, '/FlateDecode' AS filters, false AS is_mask FROM t")
def file_images(spark, sf_dir):
    return _read(spark, sf_dir, "images").select("path", *_long("page_index"), "name", *_long("width", "height", "bits"), "colorspace", F.array_join("filters", ",").alias("filters"), "is_mask")


@query("SELECT path, i AS page_index, string_agg(lpad(printf('%X', b), 2, '0'), '' ORDER BY b) AS pixels FROM (SELECT path, i, unnest(generate_series(0, 2 * i + 1)) AS b FROM t) GROUP BY path, i")
def file_image_bytes(spark, sf_dir):
    got = tables.tables(Job().uncompressed().run(files(spark, sf_dir)), "images")
    return got.select("path", *_long("page_index"), F.hex("raw").alias("pixels"))


@query("SELECT path, 3 * n + 2 AS n_streams, 11 * n + 10 AS n_objects FROM t WHERE i = 0")
def file_objects(spark, sf_dir):
    got = _read(spark, sf_dir, "objects")
    return got.groupBy("path").agg(F.count(F.when(F.col("tag") == "stream", 1)).alias("n_streams"), F.count("*").alias("n_objects"))


@query("SELECT path, i AS page_index, '/Contents' AS at FROM t UNION ALL SELECT path, i, '/Thumb' FROM t UNION ALL SELECT path, i, '/Annots[' || k || ']' FROM t, (VALUES (0), (1)) v(k) UNION ALL SELECT path, i, '/Resources/XObject/Im0' FROM t UNION ALL SELECT path, i, '/Parent' FROM t")
def file_references(spark, sf_dir):
    return _by_page(files(spark, sf_dir), "refs", ("at",)).select("path", *_long("page_index"), "at")


@query("SELECT path, true AS rebuilt, n AS n_pages FROM t WHERE i = 0")
def file_rebuilt(spark, sf_dir):
    """Files whose cross-reference table is gone are searched for their objects."""
    broken = files(spark, sf_dir).withColumn("content", F.expr("encode(substring_index(decode(content, 'ISO-8859-1'), 'xref\n0 ', 1), 'ISO-8859-1')"))
    return tables.tables(broken, "docs").select("path", "rebuilt", *_long("n_pages"))


@query("SELECT path, true AS told, CAST(NULL AS BIGINT) AS n_pages FROM t WHERE i = 0")
def file_unreadable(spark, sf_dir):
    """What is no file gives a row that says so."""
    broken = files(spark, sf_dir).withColumn("content", F.encode(F.concat(F.lit("no file at all "), "path"), "UTF-8"))
    return tables.tables(broken, "docs").select("path", F.col("problem").isNotNull().alias("told"), *_long("n_pages"))


@query(f"{_PLACES} SELECT path, 'annotation ' || i || '.0' AS holder, pos, 'GoTo' AS subtype FROM t, (VALUES (0), (1)) v(pos) UNION ALL SELECT path, 'outline ' || place, 0, 'GoTo' FROM d WHERE i % 3 = 0")
def sanitized_actions(spark, sf_dir):
    clean = Sanitizer().remove_javascript().remove_external_access().apply(files(spark, sf_dir))
    return tables.tables(clean, "actions").select("path", "holder", *_long("pos"), "subtype")


@query("SELECT path, n AS n_pages, 0 AS thumbs, 0 AS attached, 0 AS private, n AS images FROM t WHERE i = 0")
def sanitized_structure(spark, sf_dir):
    clean = Sanitizer().remove_attachments().remove_thumbnails().remove_private_app_data().apply(files(spark, sf_dir))
    rows, at = tables.several(clean, {"docs": ("n_pages",), "refs": ("at",), "objects": ("value",)}), F.col("refs_at")
    got = rows.groupBy("path").agg(F.max("docs_n_pages").alias("n_pages"), F.count_if(at == "/Thumb").alias("thumbs"), F.count_if(at.contains("/EF")).alias("attached"), F.count_if(at == "/Resources/XObject/Im0").alias("images"), F.count_if(F.col("objects_value").contains("PieceInfo")).alias("private"))
    return got.select("path", *_long("n_pages"), "thumbs", "attached", "images", "private")


@query("SELECT path || '/' || (i // 2) AS path, i % 2 AS page_index, (90 * (i % 4) + 90) % 360 AS rotate, CAST(300 + 10 * turn AS DOUBLE) AS width FROM t")
def job_rotate_split(spark, sf_dir):
    parts = Job().rotate(90).split(2).run(files(spark, sf_dir)).withColumn("path", F.concat("path", F.lit("/"), F.col("part")))
    return tables.tables(parts, "pages").select("path", *_long("page_index", "rotate"), F.col("mediabox")[2].alias("width"))


@query("SELECT path, n - 1 - i AS page_index, CAST(300 + 10 * turn AS DOUBLE) AS width FROM t")
def job_page_order(spark, sf_dir):
    turned = Job().pages("z-1").run(files(spark, sf_dir))
    return tables.tables(turned, "pages").select("path", *_long("page_index"), F.col("mediabox")[2].alias("width"))


def _merged(spark, sf_dir, job):
    pairs = files(spark, sf_dir).select(F.floor(F.col("path").cast("long") / 2).alias("target"), F.col("path").cast("long").alias("seq"), "content")
    return job.merge(pairs).withColumnRenamed("target", "path")


@query("SELECT CAST(conv_id // 2 AS VARCHAR) AS path, row_number() OVER (PARTITION BY conv_id // 2 ORDER BY conv_id, i) - 1 AS page_index, CAST(300 + 10 * turn AS DOUBLE) AS width FROM t")
def job_merge(spark, sf_dir):
    return tables.tables(_merged(spark, sf_dir, Job()), "pages").select("path", *_long("page_index"), F.col("mediabox")[2].alias("width"))


@query("SELECT CAST(conv_id // 2 AS VARCHAR) AS path, row_number() OVER (PARTITION BY conv_id // 2 ORDER BY i, conv_id) - 1 AS page_index, CAST(300 + 10 * turn AS DOUBLE) AS width FROM t")
def job_collate(spark, sf_dir):
    return tables.tables(_merged(spark, sf_dir, Job().collate(1)), "pages").select("path", *_long("page_index"), F.col("mediabox")[2].alias("width"))


@query("SELECT path, i AS page_index, 'x' || ['iii','iv','v','vi','vii','viii','ix','x','xi','xii','xiii','xiv','xv','xvi'][i + 1] AS label FROM t")
def job_labels(spark, sf_dir):
    made = Job().set_page_labels([(0, "r", "x", 3)]).run(files(spark, sf_dir))
    return tables.tables(made, "pages").select("path", *_long("page_index"), "label")


@query("SELECT path, k AS key, CASE k WHEN 'new' THEN md5('more') ELSE md5('data of ' || conv_id) END AS digest FROM t, (VALUES ('a'), ('new')) v(k) WHERE i = 0")
def job_attach(spark, sf_dir):
    made = Job().attach("new", b"more", "text/plain").run(files(spark, sf_dir))
    return tables.tables(made, "attachments").select("path", "key", F.md5("data").alias("digest"))


@query("SELECT path, n AS n_pages, 0 AS infos, 0 AS properties, 0 AS fields, 0 AS labels FROM t WHERE i = 0")
def job_remove(spark, sf_dir):
    made = Job().remove("info", "metadata", "acroform", "page_labels").run(files(spark, sf_dir))
    rows, of = tables.several(made, {"docs": ("n_pages",), "docinfo": (), "xmp": (), "fields": (), "names": ("tree",)}), F.col("table")
    got = rows.groupBy("path").agg(F.max("docs_n_pages").alias("n_pages"), *(F.count_if(of == source).alias(name) for name, source in (("infos", "docinfo"), ("properties", "xmp"), ("fields", "fields"))), F.count_if(F.col("names_tree") == "/PageLabels").alias("labels"))
    return got.select("path", *_long("n_pages"), "infos", "properties", "fields", "labels")


@query("SELECT path, true AS encrypted, n AS n_pages, 4 AS revision, 128 AS bits, true AS by_user, false AS by_owner, false AS extract FROM t WHERE i = 0")
def job_encrypt(spark, sf_dir):
    made = Job().encrypt("owner", "user", revision=4, denied=("extract",)).run(files(spark, sf_dir))
    e = F.col("encryption")
    return tables.tables(made, "docs", password="user").select("path", "encrypted", *_long("n_pages", "encryption.revision", "encryption.bits"), e.by_user.alias("by_user"), e.by_owner.alias("by_owner"), F.array_contains(e.allowed, "extract").alias("extract"))


@query("SELECT path, i AS page_index, '(' || role || ')' AS shown FROM t")
def job_decrypt(spark, sf_dir):
    made = Job().encrypt("owner", "user", revision=4).run(files(spark, sf_dir))
    plain = Job().password("owner").run(made.select("path", "content"))
    return tables.tables(plain, "instructions", operators="Tj").select("path", *_long("page_index"), F.col("operands")[0].alias("shown"))


@query("SELECT path, '2.0' AS version, n AS n_pages FROM t WHERE i = 0")
def job_version(spark, sf_dir):
    return tables.tables(Job().min_version("2.0").run(files(spark, sf_dir)), "docs").select("path", "version", *_long("n_pages"))


@query("SELECT path, i AS page_index, 2 AS drawn FROM t")
def job_overlay(spark, sf_dir):
    stamp = Builder()
    stamp.page(b"0 0 10 10 re f")
    made = Job().overlay(stamp.bytes()).run(files(spark, sf_dir))
    return tables.tables(made, "instructions", operators="Do").groupBy("path", F.col("page_index").cast("long").alias("page_index")).agg(F.count("*").alias("drawn"))


@query("SELECT path, i AS page_index, md5('q' || chr(10) || '1 0 0 1 ' || turn || ' ' || i || ' cm' || chr(10) || '/Im0 Do' || chr(10) || 'Q' || chr(10) || 'BT' || chr(10) || '/F1 12 Tf' || chr(10) || '(' || role || ') Tj' || chr(10) || 'ET') AS digest FROM t")
def job_normalize(spark, sf_dir):
    """A line for each instruction, read back as rows and put together."""
    made = Job().normalize_content().uncompressed().run(files(spark, sf_dir))
    got = tables.tables(made, "instructions")
    line = F.concat_ws(" ", F.when(F.size("operands") > 0, F.array_join("operands", " ")), F.col("operator"))
    lines = F.array_sort(F.collect_list(F.struct("seq", line.alias("line"))))
    return got.groupBy("path", F.col("page_index").cast("long").alias("page_index")).agg(F.md5(F.array_join(F.transform(lines, lambda x: x.line), "\n")).alias("digest"))


@query("SELECT path, n AS n_pages, sum(300 + 10 * turn) OVER (PARTITION BY path) AS widths FROM t QUALIFY i = 0")
def file_json_round_trip(spark, sf_dir):
    """Objects to JSON and back to files."""
    made = files(spark, sf_dir)
    rows = datasource.from_json_rows(datasource.to_json_rows(tables.tables(made, "objects")))
    again = datasource.to_files(rows, tables.tables(made, "docs").select("path", "trailer"))
    return tables.tables(again, "pages").groupBy("path").agg(F.count("*").alias("n_pages"), F.sum(F.col("mediabox")[2]).cast("long").alias("widths"))


def _set_fields(e: Editor) -> None:
    for name in e.fields():
        e.set_field(name, "set " + name)
    e.rename_field("form.t0", "first")


@query("SELECT path, CASE WHEN i = 0 THEN 'form.first' ELSE 'form.t' || i END AS full_name, 'set form.t' || i AS value FROM t")
def form_set_and_rename(spark, sf_dir):
    return tables.tables(edited(files(spark, sf_dir), _set_fields), "fields").where("is_terminal").select("path", "full_name", "value")


def _remove_field(e: Editor) -> None:
    e.remove_fields(["form.t0"])


@query("SELECT path, 'form.t' || i AS full_name FROM t WHERE i > 0")
def form_remove(spark, sf_dir):
    return tables.tables(edited(files(spark, sf_dir), _remove_field), "fields").where("is_terminal").select("path", "full_name")


@query("SELECT path, i AS page_index, 0 AS rotate, CAST(CASE WHEN i % 2 = 0 THEN 300 + 10 * turn ELSE 400 END AS DOUBLE) AS width FROM t")
def page_flatten_rotation(spark, sf_dir):
    made = edited(files(spark, sf_dir), Editor.flatten_rotation)
    return tables.tables(made, "pages").select("path", *_long("page_index", "rotate"), F.round(F.col("mediabox")[2] - F.col("mediabox")[0], 6).alias("width"))


def _with_looks(e: Editor) -> None:
    _set_fields(e)
    e.flatten_annotations()


@query("SELECT path, i AS page_index, 2 AS drawn, 0 AS notes FROM t")
def page_flatten_annotations(spark, sf_dir):
    """Fields get appearances, which are drawn into the pages; links have none and go."""
    made = edited(files(spark, sf_dir), _with_looks)
    rows, of = tables.several(made, {"instructions": ("page_index",), "annotations": ("page_index",)}, operators="Do"), F.col("table")
    page = F.coalesce("instructions_page_index", "annotations_page_index").cast("long").alias("page_index")
    return rows.groupBy("path", page).agg(F.count_if(of == "instructions").alias("drawn"), F.count_if(of == "annotations").alias("notes")).where("drawn > 0")


@query("SELECT path, i AS page_index, CAST(turn AS DOUBLE) AS x, CAST(i AS DOUBLE) AS y FROM t")
def file_ctm(spark, sf_dir):
    """Where each image is drawn."""
    from quire.operators import content

    got = _read(spark, sf_dir, "instructions", operators="q Q cm Do")
    steps = got.select(F.col("path").alias("doc_id"), "page_index", "seq", "operator", F.col("numbers").alias("operands"), F.when(F.col("operator") == "Do", F.col("operands")[0]).alias("name"))
    return content.ctm(steps).select(F.col("doc_id").alias("path"), *_long("page_index"), F.col("ctm")[4].alias("x"), F.col("ctm")[5].alias("y"))


def _unused(e: Editor) -> None:
    for ref in e.pages():
        e.add_resource(e.get(ref), "/XObject", e.add(Stream({}, b"")), "/Unused")
    e.remove_unused_resources()


@query("SELECT path, i AS page_index, '/Resources/XObject/Im0' AS at FROM t")
def page_remove_unused(spark, sf_dir):
    made = edited(files(spark, sf_dir), _unused)
    return _by_page(made, "refs", ("at",)).where("at like '/Resources/%'").select("path", *_long("page_index"), "at")


@query("SELECT path, i AS page_index, 0 AS rotate, 2 AS drawn FROM t")
def job_flatten(spark, sf_dir):
    """Appearances made, drawn into the pages, and the pages turned upright, in one job."""
    made = Job().generate_appearances().flatten_annotations().flatten_rotation().run(files(spark, sf_dir))
    rows = tables.several(made, {"pages": ("page_index", "rotate"), "instructions": ("page_index",)}, operators="Do")
    got = rows.groupBy("path", F.coalesce("pages_page_index", "instructions_page_index").alias("page_index")).agg(F.max("pages_rotate").alias("rotate"), F.count_if(F.col("table") == "instructions").alias("drawn"))
    return got.where("rotate is not null and drawn > 0").select("path", *_long("page_index", "rotate"), "drawn")


@query("SELECT path, k AS key, CASE k WHEN 'a' THEN md5('data of ' || conv_id) ELSE md5('other') END AS digest FROM t, (VALUES ('a'), ('x-b')) v(k) WHERE i = 0")
def job_copy_attachments(spark, sf_dir):
    other = Editor()
    other.attach("b", b"other")
    made = Job().copy_attachments_from(other.bytes(), "x-").run(files(spark, sf_dir))
    return tables.tables(made, "attachments").select("path", "key", F.md5("data").alias("digest"))


@query("SELECT path, 'cannot' AS told FROM t WHERE i = 0")
def job_attachment_taken(spark, sf_dir):
    """A key that is taken is a problem of that file."""
    other = Editor()
    other.attach("a", b"other")
    made = Job().copy_attachments_from(other.bytes()).run(files(spark, sf_dir))
    return made.select("path", F.when(F.col("problem").contains("there is an attachment a") & F.col("content").isNull(), "cannot").alias("told"))


@query("SELECT path, n AS n_pages, 3 * n + 2 AS loose_streams, 8 * n + 8 AS in_streams, false AS rebuilt, false AS longer FROM t WHERE i = 0")
def job_object_streams(spark, sf_dir):
    """Objects within object streams, read back by a cross-reference stream; smaller than the plain file."""
    plain = Job().run(files(spark, sf_dir))
    made = Job().object_streams().run(files(spark, sf_dir))
    rows = tables.several(made, {"docs": ("n_pages", "rebuilt"), "objects": ("tag", "value", "kind", "stream")})
    both = rows.unionByName(plain.select("path", F.lit("plain").alias("table"), F.length("content").cast("long").alias("n_bytes")), allowMissingColumns=True)
    counts = F.expr("objects_value not like '%/ObjStm%' and objects_value not like '%/XRef%'")
    size = lambda table: F.max(F.when(F.col("table") == table, F.col("n_bytes")))
    got = both.groupBy("path").agg(F.max("docs_n_pages").alias("n_pages"), F.max("docs_rebuilt").alias("rebuilt"), F.count_if(counts & (F.col("objects_tag") == "stream")).alias("loose_streams"), F.count_if(counts & F.col("objects_stream").isNotNull() & (F.col("objects_kind") == 2)).alias("in_streams"), (size("docs") >= size("plain")).alias("longer"))
    return got.select("path", *_long("n_pages"), "rebuilt", "loose_streams", "in_streams", "longer")


def _by_path(e: Editor) -> None:
    e.set_path(["/Pages", "/Kids", 0, "/Rotate"], 180)
    e.delete_path(["/Pages", "/Kids", -1, "/PieceInfo"])


@query("SELECT path, i AS page_index, CASE i WHEN 0 THEN 180 ELSE 90 * (i % 4) END AS rotate, i < n - 1 AS private FROM t")
def edit_by_path(spark, sf_dir):
    made = edited(files(spark, sf_dir), _by_path)
    return _by_page(made, "objects", ("value",), "rotate").select("path", *_long("page_index", "rotate"), F.col("value").contains("PieceInfo").alias("private"))


def _added(e: Editor) -> None:
    for ref in e.pages():
        e.contents_add(ref, b"1 w", True)
        e.contents_add(ref, b"2 w")
    e.contents_coalesce(e.pages()[0])


@query("SELECT path, i AS page_index, first, last, 10 AS n_instructions, CASE i WHEN 0 THEN 1 ELSE 3 END AS streams FROM t, (VALUES ('1', '2')) v(first, last)")
def page_contents_add(spark, sf_dir):
    made = edited(files(spark, sf_dir), _added)
    rows = tables.several(made, {"pages": ("page_index", "obj"), "refs": ("obj", "at"), "instructions": ("page_index", "seq", "operands")})
    own = Window.partitionBy("path", F.coalesce("pages_obj", "refs_obj"))
    rows = rows.withColumn("streams", F.count_if(F.col("refs_at").like("/Contents%")).over(own)).where("table != 'refs'")
    told, seq = F.get("instructions_operands", F.lit(0)), F.col("instructions_seq")
    got = rows.groupBy("path", F.coalesce("pages_page_index", "instructions_page_index").alias("page_index")).agg(F.min_by(told, seq).alias("first"), F.max_by(told, seq).alias("last"), F.count(seq).alias("n_instructions"), F.max(F.when(F.col("table") == "pages", F.col("streams"))).alias("streams"))
    return got.where("n_instructions > 0 and streams > 0").select("path", *_long("page_index"), "first", "last", "n_instructions", "streams")


def _lost(e: Editor) -> None:
    e.at_path(["/Pages", "/Kids", 0, "/None", "/More"])


@query("SELECT path, 'KeyError: ' || chr(39) || 'there is no /None after /Pages/Kids[0]' || chr(39) AS problem FROM t WHERE i = 0")
def edit_path_ends_early(spark, sf_dir):
    return edited(files(spark, sf_dir), _lost).select("path", "problem")


def _swapped(e: Editor) -> None:
    kids = e.pages()
    e.swap(kids[0], kids[-1])


@query("SELECT path, CASE i WHEN 0 THEN n - 1 WHEN n - 1 THEN 0 ELSE i END AS page_index, CAST(300 + 10 * turn AS DOUBLE) AS width FROM t")
def edit_swap(spark, sf_dir):
    return tables.tables(edited(files(spark, sf_dir), _swapped), "pages").select("path", *_long("page_index"), F.col("mediabox")[2].alias("width"))


def _emplaced(e: Editor) -> None:
    e.emplace(e.pages()[0], _named(Type=Name("/Page"), MediaBox=[0, 0, 9, 9]))


@query("SELECT path, i AS page_index, CASE i WHEN 0 THEN 9 ELSE CAST(300 + 10 * turn AS DOUBLE) END AS width, CASE i WHEN 0 THEN 0 ELSE 90 * (i % 4) END AS rotate FROM t")
def edit_emplace(spark, sf_dir):
    return tables.tables(edited(files(spark, sf_dir), _emplaced), "pages").select("path", *_long("page_index"), F.col("mediabox")[2].alias("width"), *_long("rotate"))


@query("SELECT path, name, CASE name WHEN 'pdf:PDFVersion' THEN '1.7' ELSE 'quire' END AS value FROM t, (VALUES ('pdf:Producer'), ('pdf:PDFVersion')) v(name) WHERE i = 0")
def xmp_pdf_version(spark, sf_dir):
    made = files(spark, sf_dir)
    rows = kept(tables.several(made, {"docs": ("version",), "xmp": ("name", "values")}).where("table = 'docs' or xmp_name = 'pdf:Producer'"))
    old = rows.where("table = 'xmp'").select(F.col("path").alias("doc_id"), F.col("xmp_name").alias("name"), F.col("xmp_values").alias("values"))
    told = old.unionByName(old.select("doc_id", F.lit("pdf:PDFVersion").alias("name"), F.array(F.lit("1.0")).alias("values")))
    docs = rows.where("table = 'docs'").select(F.col("path").alias("doc_id"), F.col("docs_version").alias("version"))
    return metadata.update_pdf_version(told, docs).select(F.col("doc_id").alias("path"), "name", F.col("values")[0].alias("value"))


@query("SELECT path, n AS n_pages, 'outline' AS kind, n AS n_rows FROM t WHERE i = 0 UNION ALL SELECT path, n, 'attachments', 1 FROM t WHERE i = 0")
def file_source(spark, sf_dir):
    """Files written to a folder that all share and read by the data source, in two tables."""
    folder = shared_folder(spark, "file_source")
    datasource.register(spark)
    datasource.save_files(files(spark, sf_dir).withColumn("path", F.concat("path", F.lit(".pdf"))), folder)
    read = lambda name: spark.read.format("pages").option("path", folder).option("table", name).load().withColumn("path", F.regexp_extract("path", r"([^/]*)[.]pdf$", 1))
    counts = [read(name).groupBy("path").agg(F.count("*").alias("n_rows")).withColumn("kind", F.lit(name)) for name in ("outline", "attachments")]
    return read("docs").select("path", *_long("n_pages")).join(counts[0].unionByName(counts[1]), "path")


#: Colour spaces of the pictures, by place: what follows the name in a file, and channels.
SPACES = ("/DeviceGray", "/DeviceRGB", "/DeviceCMYK", "/Indexed", "gray profile", "rgb profile", "/Separation", "/DeviceN", "16 bits")


def _profile(space: bytes) -> bytes:
    return bytes(16) + space + bytes(16) + b"acsp" + bytes(88)


def picture_file(first: int, parts: list[tuple[int, int]]) -> bytes:
    """A file with an image for each part: its colour space and mask by its key, its width by its size."""
    b = Builder()
    profiles = [b.add(Stream(_named(N=n), _profile(space))) for n, space in ((1, b"GRAY"), (3, b"RGB "))]
    tint = b.add(Stream(_named(FunctionType=4, Domain=[0, 1], Range=[0, 1]), b"{}"))
    spaces = [Name("/DeviceGray"), Name("/DeviceRGB"), Name("/DeviceCMYK"), [Name("/Indexed"), Name("/DeviceRGB"), 255, bytes(768)], [Name("/ICCBased"), profiles[0]], [Name("/ICCBased"), profiles[1]], [Name("/Separation"), Name("/Spot"), Name("/DeviceGray"), tint], [Name("/DeviceN"), [Name("/A"), Name("/B")], Name("/DeviceCMYK"), tint], Name("/DeviceGray")]
    channels = (1, 3, 4, 1, 1, 3, 1, 2, 2)
    for key, size in parts:
        k, mask = key % 9, key // 9 % 4
        head = _named(Type=Name("/XObject"), Subtype=Name("/Image"), Width=size, Height=2, BitsPerComponent=16 if k == 8 else 8, ColorSpace=spaces[k])
        grey = _named(Type=Name("/XObject"), Subtype=Name("/Image"), Width=4, Height=4)
        if mask == 1:
            head[Name("/SMask")] = b.add(Stream(grey | _named(BitsPerComponent=8, ColorSpace=Name("/DeviceGray")), bytes(16)))
        elif mask == 2:
            head[Name("/Mask")] = b.add(Stream(grey | _named(ImageMask=True, BitsPerComponent=1), bytes(4)))
        elif mask == 3:
            head[Name("/Mask")] = [0, 9] * (channels[k] if k != 8 else 1)
        b.page(b"/Im Do", _named(XObject=_named(Im=b.add(Stream(head, bytes(2 * size * channels[k]))))))
    return b.bytes()


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, content``: a file for every hundred parts, its pages in the order of their keys."""
    parts = spread(table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 100).alias("first"), "p_partkey", "p_size"), "first").groupBy("first").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_size"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((str(first), picture_file(first, [tuple(p.values()) for p in own])) for batch in batches for first, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        yield from batched(rows, pa.schema([("path", pa.string()), ("content", pa.binary())]))

    return shipped(parts).mapInArrow(run, "path string, content binary")


def picture_query(sql: str) -> Callable:
    """As ``query``, over ``p``: a row for each part with its file, page, colour space ``k`` and mask ``m``."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = f"WITH p AS (SELECT CAST(p_partkey // 100 AS VARCHAR) AS path, row_number() OVER (PARTITION BY p_partkey // 100 ORDER BY p_partkey, p_size) - 1 AS page_index, p_partkey % 9 AS k, p_partkey // 9 % 4 AS m, p_size FROM part) {sql}"
        return f

    return add


@picture_query("SELECT path, page_index, p_size AS width, ['L', 'RGB', 'CMYK', 'P', 'L', 'RGB', 'Separation', 'DeviceN', 'I;16'][k + 1] AS mode, CASE WHEN m = 1 THEN 'soft' WHEN m = 2 THEN 'stencil' WHEN m = 3 AND k IN (0, 1, 2, 4, 5) THEN 'colorkey' END AS mask FROM p")
def image_modes_and_masks(spark, sf_dir):
    got = tables.tables(pictures(spark, sf_dir), "images")
    mode = images.mode(F.col("colorspace"), F.col("bits"), F.col("is_mask"), F.col("base"), F.col("components"), images.profile_space(F.col("profile")))
    return got.withColumn("mode", mode).select("path", *_long("page_index", "width"), "mode", images.mask_kind(F.col("smask"), F.col("mask"), F.col("bits"), F.col("mode")).alias("mask"))


@picture_query("""SELECT path, page_index, k IN (6, 7) AS refused, CASE WHEN k NOT IN (6, 7) THEN lpad(printf('%X', p_size), 8, '0') || '00000002' END AS size, CASE WHEN k = 8 AND m IN (0, 3) THEN 16 WHEN k NOT IN (6, 7) THEN 8 END AS bits,
CASE WHEN k IN (6, 7) THEN NULL WHEN k IN (1, 2, 3, 5) THEN CASE WHEN m IN (1, 2) OR m = 3 AND k IN (1, 2, 5) THEN 6 ELSE 2 END WHEN k = 8 THEN CASE WHEN m IN (1, 2) THEN 6 ELSE 0 END WHEN m > 0 THEN 4 ELSE 0 END AS color FROM p""")
def image_files(spark, sf_dir):
    """Size, depth and kind of colour of the files that images become: masks are alpha."""
    got = tables.tables(pictures(spark, sf_dir), "image_files")
    byte = lambda i: F.conv(F.hex(F.substring("data", i, 1)), 16, 10).cast("long")
    return got.select("path", *_long("page_index"), F.col("problem").isNotNull().alias("refused"), F.hex(F.substring("data", 17, 8)).alias("size"), byte(25).alias("bits"), byte(26).alias("color"))
