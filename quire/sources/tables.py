"""Files to tables: one pass over the bytes for each table, everything after it in Spark.

``read`` takes any path that Spark reads (the bytes come from ``binaryFile``), ``tables``
any DataFrame of ``path, content``. A file is parsed within one row; a file that can't be
read gives a row with its problem and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from quire.session import batched, shipped
from quire.sources import content as contents
from quire.sources.document import Document
from quire.sources.values import Malformed, Name, Real, Ref, Stream, decode_text, tag, to_json, unparse

SCHEMAS = {
    "docs": "path string, version string, encrypted boolean, encryption struct<revision:int,strings:string,streams:string,bits:int,by_user:boolean,by_owner:boolean,allowed:array<string>>, linearized boolean, rebuilt boolean, n_pages int, n_objects int, trailer string, warnings array<string>, problem string, extension int",
    "objects": "path string, obj int, gen int, tag string, value string, raw binary, kind int, offset bigint, stream int, index int",
    "refs": "path string, obj int, gen int, at string, to_obj int, to_gen int",
    "pages": "path string, page_index int, obj int, gen int, mediabox array<double>, cropbox array<double>, rotate int, label string, resources string",
    "instructions": "path string, page_index int, seq int, operator string, operands array<string>, numbers array<double>",
    "annotations": "path string, page_index int, seq int, subtype string, flags bigint, rect array<double>, name string, value string",
    "actions": "path string, holder string, slot string, pos int, subtype string, value string",
    "outline": "path string, place array<int>, depth int, title string, dest string, action string, closed boolean, italic boolean, bold boolean, page int",
    "fields": "path string, obj int, parent int, name string, full_name string, type string, value string, flags bigint, is_terminal boolean",
    "names": "path string, tree string, seq int, key string, number bigint, value string",
    "docinfo": "path string, key string, value string",
    "xmp": "path string, name string, values array<string>",
    "attachments": "path string, key string, filename string, description string, mime string, data binary, size bigint, created string, modified string, checksum string, relationship string",
    "images": "path string, page_index int, name string, width int, height int, bits int, colorspace string, filters array<string>, is_mask boolean, raw binary, base string, components int, profile binary, smask string, mask string",
    "image_files": "path string, page_index int, name string, suffix string, data binary, problem string",
    "problems": "path string, obj int, problem string",
}


def _text(value) -> str | None:
    return decode_text(value) if isinstance(value, bytes) else str(value) if isinstance(value, str) else None


def _numbers(doc: Document, value) -> list[float] | None:
    got = doc.get(value)
    out = [float(x) for v in got if isinstance(x := doc.get(v), (int, Real)) and not isinstance(x, bool)] if isinstance(got, list) else []
    return out if len(out) == 4 else None


def _docs(doc: Document) -> Iterator[tuple]:
    n = len(doc.pages())
    h = doc.handler
    how = {"revision": h.revision, "strings": h.strings, "streams": h.streams, "bits": 8 * len(h.key), "by_user": h.by_user, "by_owner": h.by_owner, "allowed": sorted(k for k, ok in h.allowed().items() if ok)} if h else None
    level = doc.get((doc.get((doc.get((doc.get(doc.trailer.get("/Root")) or {}).get("/Extensions")) or {}).get("/ADBE")) or {}).get("/ExtensionLevel"))
    yield doc.version, doc.encrypted, how, doc.linearized, doc.rebuilt, n, len(doc.entries), to_json(doc.trailer), list(doc.warnings), None, level if isinstance(level, int) else None


def _objects(doc: Document) -> Iterator[tuple]:
    for number, gen, value in doc.objects():
        e = doc.entries[number, gen]
        yield number, gen, tag(value), to_json(value), value.raw if isinstance(value, Stream) else None, e.kind, e.offset, e.stream, e.index


def _refs(doc: Document) -> Iterator[tuple]:
    def walk(value, at: str):
        if isinstance(value, Ref):
            yield at, value.obj, value.gen
        elif isinstance(value, (dict, Stream)):
            for k, v in (value.head if isinstance(value, Stream) else value).items():
                yield from walk(v, at + k)
        elif isinstance(value, list):
            for i, v in enumerate(value):
                yield from walk(v, f"{at}[{i}]")

    for number, gen, value in doc.objects():
        for at, to, to_gen in walk(value, ""):
            yield number, gen, at, to, to_gen


#: Roman numerals.
ROMAN = ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))


def label_text(style: str | None, prefix: str, number: int) -> str:
    """A page label's text."""
    if style is None:
        return prefix
    if style in ("/R", "/r"):
        text, left = "", number
        for value, word in ROMAN:
            text += word * (left // value)
            left %= value
        return prefix + (text.lower() if style == "/r" else text)
    if style in ("/A", "/a"):
        text = ""
        while number > 0:
            number, rest = divmod(number - 1, 26)
            text = chr(65 + rest) + text
        return prefix + (text.lower() if style == "/a" else text)
    return prefix + str(number)


def _pages(doc: Document) -> Iterator[tuple]:
    root = doc.get(doc.trailer.get("/Root")) or {}
    ranges = sorted((k, doc.get(v) or {}) for k, v in doc.tree(root.get("/PageLabels"), "/Nums") if isinstance(k, int))
    for i, (ref, page) in enumerate(doc.pages()):
        own = [(k, v) for k, v in ranges if k <= i]
        label = str(i + 1)
        if own:
            start = own[-1][1].get("/St", 1)
            label = label_text(own[-1][1].get("/S"), _text(own[-1][1].get("/P")) or "", i - own[-1][0] + (start if isinstance(start, int) else 1))
        turn = doc.get(page.get("/Rotate"))
        yield i, ref.obj if ref else None, ref.gen if ref else None, _numbers(doc, page.get("/MediaBox")), _numbers(doc, page.get("/CropBox")), turn % 360 if isinstance(turn, int) else 0, label, to_json(doc.get(page.get("/Resources")) or {})


def _instructions(doc: Document, operators: str = "") -> Iterator[tuple]:
    for i, (_, page) in enumerate(doc.pages()):
        for seq, (operands, operator) in enumerate(contents.instructions(doc.content(page), operators)):
            if operator == "INLINE IMAGE":
                operands = [operands[0]]
            yield i, seq, operator, [unparse(x).decode("latin-1") for x in operands], [float(x) for x in operands if isinstance(x, (int, Real)) and not isinstance(x, bool)]


def _annotations(doc: Document) -> Iterator[tuple]:
    for i, (_, page) in enumerate(doc.pages()):
        for seq, ref in enumerate(doc.get(page.get("/Annots")) or []):
            if isinstance(a := doc.get(ref), dict):
                flags = doc.get(a.get("/F"))
                yield i, seq, _text(a.get("/Subtype")), flags if isinstance(flags, int) else 0, _numbers(doc, a.get("/Rect")), _text(doc.get(a.get("/T"))), to_json(a)


def _chain(doc: Document, action) -> Iterator[tuple[int, dict]]:
    """An action and all that follows it, a branch before the next; each once."""
    todo, seen, pos = [action], set(), 0
    while todo:
        ref = todo.pop()
        if isinstance(ref, Ref):
            if ref in seen:
                continue
            seen.add(ref)
        if isinstance(value := doc.get(ref), dict):
            yield pos, value
            pos += 1
            after = doc.get(value.get("/Next"))
            todo += after[::-1] if isinstance(after, list) else [value["/Next"]] if "/Next" in value else []


def _slots(doc: Document) -> Iterator[tuple[str, str, object]]:
    """The places where actions are held: catalog, pages, annotations, fields, outline items."""

    def extra(holder: str, value: dict):
        for key, action in (doc.get(value.get("/AA")) or {}).items():
            yield holder, "/AA" + key, action

    root = doc.get(doc.trailer.get("/Root")) or {}
    if isinstance(doc.get(root.get("/OpenAction")), dict):
        yield "root", "/OpenAction", root["/OpenAction"]
    yield from extra("root", root)
    for key, action in doc.tree((doc.get(root.get("/Names")) or {}).get("/JavaScript"), "/Names"):
        yield "names", "/JavaScript" + (_text(key) or ""), action
    for i, (_, page) in enumerate(doc.pages()):
        yield from extra(f"page {i}", page)
        for j, ref in enumerate(doc.get(page.get("/Annots")) or []):
            if isinstance(a := doc.get(ref), dict):
                if "/A" in a:
                    yield f"annotation {i}.{j}", "/A", a["/A"]
                yield from extra(f"annotation {i}.{j}", a)
    for number, *_, value in _field_rows(doc):
        yield from extra(f"field {number}", value)
    for place, _, item in doc.outline():
        if "/A" in item:
            yield "outline " + ".".join(map(str, place)), "/A", item["/A"]


def _actions(doc: Document) -> Iterator[tuple]:
    for holder, slot, action in _slots(doc):
        for pos, value in _chain(doc, action):
            yield holder, slot, pos, (_text(value.get("/S")) or "").lstrip("/"), to_json(value)


def _outline(doc: Document) -> Iterator[tuple]:
    pages = {ref: i for i, (ref, _) in enumerate(doc.pages()) if ref}
    root = doc.get(doc.trailer.get("/Root")) or {}
    named: dict | None = None

    def target(item: dict) -> int | None:
        """The page that an item leads to, by its destination or a GoTo action, by name or directly."""
        nonlocal named
        dest = doc.get(item.get("/Dest"))
        action = doc.get(item.get("/A"))
        if dest is None and isinstance(action, dict) and action.get("/S") == "/GoTo":
            dest = doc.get(action.get("/D"))
        if isinstance(dest, (bytes, Name)):
            if named is None:
                named = {k: v for k, v in doc.tree((doc.get(root.get("/Names")) or {}).get("/Dests"), "/Names")} | dict(doc.get(root.get("/Dests")) or {})
            dest = doc.get(named.get(dest))
            dest = doc.get(dest.get("/D")) if isinstance(dest, dict) else dest
        return pages.get(dest[0]) if isinstance(dest, list) and dest and isinstance(dest[0], Ref) else dest[0] if isinstance(dest, list) and dest and isinstance(dest[0], int) else None

    for place, _, item in doc.outline():
        count, flags = doc.get(item.get("/Count")), doc.get(item.get("/F"))
        flags = flags if isinstance(flags, int) else 0
        yield list(place), len(place), _text(doc.get(item.get("/Title"))) or "", to_json(item["/Dest"]) if "/Dest" in item else None, to_json(doc.get(item["/A"])) if "/A" in item else None, isinstance(count, int) and count < 0, bool(flags & 1), bool(flags & 2), target(item)


def _field_rows(doc: Document) -> Iterator[tuple]:
    """Object, parent, own name, path of names, inherited type, value and flags, whether it has no named kids, and the dictionary."""
    root = doc.get(doc.trailer.get("/Root")) or {}
    form, seen = doc.get(root.get("/AcroForm")) or {}, set()

    def walk(ref, parent, path, above):
        value = doc.get(ref)
        if not isinstance(value, dict) or (isinstance(ref, Ref) and ref in seen) or len(path) > 100:
            return
        if isinstance(ref, Ref):
            seen.add(ref)
        own = above | {k: doc.get(value[k]) for k in ("/FT", "/V", "/Ff", "/DA", "/Q") if k in value}
        name = _text(doc.get(value.get("/T")))
        names = [*path, name] if name else path
        kids = [k for k in doc.get(value.get("/Kids")) or [] if isinstance(d := doc.get(k), dict) and "/T" in d]
        number = ref.obj if isinstance(ref, Ref) else None
        yield number, parent, name, names, own, not kids, value
        for kid in kids:
            yield from walk(kid, number, names, own)

    for ref in doc.get(form.get("/Fields")) or []:
        yield from walk(ref, None, [], {})


def _fields(doc: Document) -> Iterator[tuple]:
    for number, parent, name, path, own, terminal, _ in _field_rows(doc):
        flags = own.get("/Ff")
        yield number, parent, name, ".".join(path), _text(own.get("/FT")), _text(own.get("/V")) if not isinstance(own.get("/V"), (list, dict)) else to_json(own["/V"]), flags if isinstance(flags, int) else 0, terminal


def _names(doc: Document) -> Iterator[tuple]:
    root = doc.get(doc.trailer.get("/Root")) or {}
    for tree, node in (doc.get(root.get("/Names")) or {}).items():
        for seq, (key, value) in enumerate(doc.tree(node, "/Names")):
            yield tree, seq, _text(key), None, to_json(doc.get(value))
    for seq, (key, value) in enumerate((doc.get(root.get("/Dests")) or {}).items()):
        yield "/Dests (names)", seq, key, None, to_json(doc.get(value))
    for seq, (key, value) in enumerate(doc.tree(root.get("/PageLabels"), "/Nums")):
        yield "/PageLabels", seq, None, key if isinstance(key, int) else None, to_json(doc.get(value))


def _docinfo(doc: Document) -> Iterator[tuple]:
    for key, value in (doc.get(doc.trailer.get("/Info")) or {}).items():
        yield key, _text(doc.get(value))


def _xmp(doc: Document) -> Iterator[tuple]:
    from quire.sources.xmp import properties

    root = doc.get(doc.trailer.get("/Root")) or {}
    if isinstance(s := doc.get(root.get("/Metadata")), Stream):
        yield from properties(doc.stream_data(s))


def _attachments(doc: Document) -> Iterator[tuple]:
    root = doc.get(doc.trailer.get("/Root")) or {}
    for key, value in doc.tree((doc.get(root.get("/Names")) or {}).get("/EmbeddedFiles"), "/Names"):
        spec = doc.get(value)
        if isinstance(spec, dict):
            files = doc.get(spec.get("/EF")) or {}
            s = doc.get(files.get("/UF", files.get("/F")))
            yield _text(key), _text(doc.get(spec.get("/UF", spec.get("/F")))), _text(doc.get(spec.get("/Desc"))), (_text(s.head.get("/Subtype")) or "").lstrip("/") if isinstance(s, Stream) else None, doc.stream_data(s) if isinstance(s, Stream) else None, *_about(doc, spec, s)


def _about(doc: Document, spec: dict, s) -> tuple:
    """What an embedded file says of itself: size, dates as they are written, checksum in hex, relationship."""
    told = doc.get(s.head.get("/Params")) if isinstance(s, Stream) else None
    told = told if isinstance(told, dict) else {}
    size, check = doc.get(told.get("/Size")), doc.get(told.get("/CheckSum"))
    kind = _text(doc.get(spec.get("/AFRelationship")))
    return size if isinstance(size, int) else None, _text(doc.get(told.get("/CreationDate"))), _text(doc.get(told.get("/ModDate"))), check.hex() if isinstance(check, bytes) else None, kind.lstrip("/") if kind else None


def _pictures(doc: Document) -> Iterator[tuple[int, str, Stream]]:
    """Images of each page in their order, in forms nested to any depth; a form within itself is left out."""

    def within(resources):
        return iter(list((doc.get((doc.get(resources) or {}).get("/XObject")) or {}).items()))

    for i, (_, page) in enumerate(doc.pages()):
        seen, stack = set(), [("", None, within(page.get("/Resources")))]
        while stack:
            scope, form, left = stack[-1]
            for name, ref in left:
                s = doc.get(ref)
                if not isinstance(s, Stream) or (isinstance(ref, Ref) and ref in seen):
                    continue
                if s.head.get("/Subtype") == "/Image":
                    yield i, scope + name, s
                elif s.head.get("/Subtype") == "/Form":
                    seen |= {ref} if isinstance(ref, Ref) else set()
                    stack.append((scope + name, ref, within(s.head.get("/Resources"))))
                    break
            else:
                stack.pop()
                seen.discard(form)


def _space(doc: Document, value) -> tuple[str | None, str | None, int | None, bytes | None, bytes]:
    """A colour space's name, an Indexed one's base, the components and profile of an ICCBased one (or base), and a palette."""
    space = doc.get(value)
    if not isinstance(space, list) or not space:
        return (str(space) if isinstance(space, Name) else None), None, None, None, b""
    name, base, lookup, own = str(doc.get(space[0])), None, b"", space
    if name == "/Indexed" and len(space) > 3:
        own = doc.get(space[1])
        base = str(doc.get(own[0])) if isinstance(own, list) and own else str(own)
        table = doc.get(space[3])
        lookup = doc.stream_data(table) if isinstance(table, Stream) else table if isinstance(table, bytes) else b""
    profile = doc.get(own[1]) if isinstance(own, list) and len(own) > 1 and doc.get(own[0]) == "/ICCBased" else None
    if not isinstance(profile, Stream):
        return name, base, None, None, lookup
    n = doc.get(profile.head.get("/N"))
    return name, base, n if isinstance(n, int) else None, doc.stream_data(profile), lookup


def _entries(doc: Document, s: Stream) -> dict:
    return {k: doc.get(v) for k, v in s.head.items()}


def _whole(h: dict, key: str) -> int | None:
    return h.get(key) if isinstance(h.get(key), int) and not isinstance(h.get(key), bool) else None


def _images(doc: Document) -> Iterator[tuple]:
    from quire.sources.filters import chain

    for i, name, s in _pictures(doc):
        h = _entries(doc, s)
        space, base, components, profile, _ = _space(doc, h.get("/ColorSpace"))
        kinds = [("stream" if isinstance(h.get(k), Stream) else "array" if isinstance(h.get(k), list) else None) for k in ("/SMask", "/Mask")]
        yield i, name, _whole(h, "/Width"), _whole(h, "/Height"), _whole(h, "/BitsPerComponent"), space, [str(n) for n, _ in chain(h)], h.get("/ImageMask") is True, s.raw, base, components, profile, *kinds


def _picture_file(doc: Document, s: Stream, masks: bool = True) -> tuple[str, bytes]:
    """Suffix and bytes of an image, its mask as alpha; ICCBased pixels by how many components they have."""
    from quire.sources import filters, pixels

    h = _entries(doc, s)
    space, base, components, _, lookup = _space(doc, h.get("/ColorSpace"))
    device = {1: "/DeviceGray", 3: "/DeviceRGB", 4: "/DeviceCMYK"}.get(components)
    space, base = (device if space == "/ICCBased" else space), (device if base == "/ICCBased" else base)
    stencil = h.get("/ImageMask") is True
    raw, left = filters.decode(h, s.raw)
    alpha = keys = None
    if masks and isinstance(h.get("/SMask"), Stream):
        alpha = _grey(doc, h["/SMask"])
    elif masks and isinstance(h.get("/Mask"), Stream):
        alpha = 255 - _grey(doc, h["/Mask"])  # a stencil paints where it is 0
    elif masks and isinstance(h.get("/Mask"), list):
        keys = [int(float(str(doc.get(x)))) for x in h["/Mask"]]
    decode = [float(str(doc.get(x))) for x in h["/Decode"]] if isinstance(h.get("/Decode"), list) else None
    return pixels.extract(raw, _whole(h, "/Width") or 0, _whole(h, "/Height") or 0, 1 if stencil else _whole(h, "/BitsPerComponent") or 8, "/DeviceGray" if stencil else space or "", [str(n) for n, _ in left], next((p or {} for n, p in left if n == "/CCITTFaxDecode"), {}), lookup, base or "/DeviceRGB", decode, alpha, keys)


def _grey(doc: Document, s: Stream):
    """The samples of a mask, 0 to 255."""
    from quire.sources import filters, pixels

    h = _entries(doc, s)
    raw, left = filters.decode(h, s.raw)
    if left:
        raise Malformed(f"no decoder for a mask's {left[0][0]}")
    bits = 1 if h.get("/ImageMask") is True else _whole(h, "/BitsPerComponent") or 8
    values = pixels.scaled(pixels.samples(raw, _whole(h, "/Width") or 0, _whole(h, "/Height") or 0, 1, bits), bits)
    if isinstance(h.get("/Decode"), list) and len(h["/Decode"]) == 2:
        values = pixels.decoded(values, [float(str(doc.get(x))) for x in h["/Decode"]])
    return values[..., 0]


def _image_files(doc: Document) -> Iterator[tuple]:
    for i, name, s in _pictures(doc):
        try:
            yield i, name, *_picture_file(doc, s), None
        except (Malformed, ValueError, TypeError, KeyError, IndexError) as e:
            yield i, name, None, None, f"{type(e).__name__}: {e}"


def _problems(doc: Document) -> Iterator[tuple]:
    """What reading everything finds wrong: objects, stream data, page contents."""
    for number, _, value in doc.objects():
        if isinstance(value, Stream):
            try:
                doc.stream_data(value)
            except (Malformed, ValueError, TypeError, KeyError) as e:
                yield number, str(e)
    for _, page in doc.pages():
        try:
            list(contents.instructions(doc.content(page)))
        except (Malformed, ValueError) as e:
            yield None, f"content: {e}"
    for w in doc.warnings:
        yield None, w


_ROWS: dict[str, Callable] = {"docs": _docs, "objects": _objects, "refs": _refs, "pages": _pages, "instructions": _instructions, "annotations": _annotations, "actions": _actions, "outline": _outline, "fields": _fields, "names": _names, "docinfo": _docinfo, "xmp": _xmp, "attachments": _attachments, "images": _images, "image_files": _image_files, "problems": _problems}


_BAD = (Malformed, ValueError, TypeError, KeyError, AttributeError, RecursionError)


def _rows_of(path: str, data: bytes, wanted: dict[str, dict], recover: bool, password: str) -> Iterator[tuple[str, list[tuple]]]:
    """Rows of tables (with their options) of one file, which is opened once."""
    doc = why = None
    try:
        doc = Document(data, recover, password=password.encode())
    except _BAD as e:
        why = e
    for table, options in wanted.items():
        rows, bad = [], why
        if doc:
            try:
                rows = [(path, *row) for row in _ROWS[table](doc, **options)]
            except _BAD as e:
                bad = e
        if bad and table == "docs":
            rows = [(path, None, None, None, None, None, None, None, None, [], f"{type(bad).__name__}: {bad}", None)]
        elif bad:
            rows = [(path, None, f"{type(bad).__name__}: {bad}")] if table == "problems" else []
        yield table, rows


def rows_of(path: str, data: bytes, table: str, recover: bool = True, password: str = "", **options) -> list[tuple]:
    """A table's rows of one file. An unreadable file has one row in ``docs`` and ``problems``, and none elsewhere."""
    return next(_rows_of(path, data, {table: options}, recover, password))[1]


def tables(files: DataFrame, table: str, recover: bool = True, password: str = "", operators: str = "") -> DataFrame:
    """A table of all ``files`` (``path, content``). ``operators``: those of ``instructions`` that are wanted; ``password``: of encrypted files."""
    schema = StructType.fromDDL(SCHEMAS[table])
    options = {"operators": operators} if table == "instructions" else {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        rows = (row for batch in batches for i in range(batch.num_rows) for row in rows_of(batch.column(0)[i].as_py(), batch.column(1)[i].as_py() or b"", table, recover, password, **options))
        yield from batched(rows, to_arrow_schema(schema))

    return shipped(files).select("path", "content").mapInArrow(run, schema)


def several(files: DataFrame, wanted: dict[str, tuple[str, ...]], recover: bool = True, password: str = "", operators: str = "") -> DataFrame:
    """Columns of several tables of all ``files``, which are made and read once for all of them.

    ``path``, ``table``, ``n_bytes`` (the file's size), and a column ``<table>_<column>`` for each
    that is wanted, null in the rows of other tables. ``docs`` is best named first, as reading
    more of a file may add to its warnings.
    """
    fields = {t: {f.name: (k, f) for k, f in enumerate(StructType.fromDDL(SCHEMAS[t]))} for t in wanted}
    schema = StructType.fromDDL("path string, table string, n_bytes bigint")
    places: dict[str, tuple[int, list[int]]] = {}
    for t, columns in wanted.items():
        places[t] = (len(schema), [fields[t][c][0] for c in columns])
        for c in columns:
            schema = schema.add(f"{t}_{c}", fields[t][c][1].dataType)
    width = len(schema)
    options = {t: {"operators": operators} if t == "instructions" else {} for t in wanted}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for i in range(batch.num_rows):
                path, data = batch.column(0)[i].as_py(), batch.column(1)[i].as_py() or b""
                for t, got in _rows_of(path, data, options, recover, password):
                    first, columns = places[t]
                    before, after = (None,) * (first - 3), (None,) * (width - first - len(columns))
                    for row in got:
                        yield (path, t, len(data), *before, *(row[k] for k in columns), *after)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        yield from batched(rows(batches), to_arrow_schema(schema))

    return shipped(files).select("path", "content").mapInArrow(run, schema)


def read(spark: SparkSession, path: str, table: str = "docs", **options) -> DataFrame:
    """A table of the files at a path or pattern."""
    return tables(spark.read.format("binaryFile").load(path), table, **options)
