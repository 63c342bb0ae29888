"""One file: its cross-reference table or streams, its objects, its pages; rebuilt by search where the table is broken."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from quire.sources import filters
from quire.sources.crypt import Handler, WrongPassword
from quire.sources.values import Malformed, Name, Operator, Reader, Ref, Stream

_OBJ = re.compile(rb"(?<![0-9])(\d{1,10})[\0\t\n\x0c\r ]+(\d{1,5})[\0\t\n\x0c\r ]+obj(?![a-zA-Z])")
#: Attributes that a page takes from the nodes above it.
INHERITED = ("/Resources", "/MediaBox", "/CropBox", "/Rotate")
_ROW = re.compile(rb"(\d{10}) (\d{5}) ([nf])[ \r][\r\n]")
_ENDSTREAM = re.compile(rb"[\0\t\n\x0c\r ]*endstream")
_DEEPEST = 100


@dataclass(frozen=True)
class Entry:
    """Where an object is: at an offset (1), or at an index of an object stream (2)."""

    kind: int
    offset: int = 0
    stream: int = 0
    index: int = 0


@dataclass
class Document:
    """An opened file. Objects are read when asked for; ``warnings`` tells what was wrong."""

    data: bytes
    recover: bool = True
    use_streams: bool = True
    password: bytes = b""
    handler: Handler | None = None
    version: str = ""
    trailer: dict = field(default_factory=dict)
    entries: dict[tuple[int, int], Entry] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)
    rebuilt: bool = False
    _objects: dict = field(default_factory=dict, repr=False)
    _packed: dict = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        m = re.search(rb"%PDF-(\d+\.\d+)", self.data[:1024])
        if m:
            self.version = m[1].decode()
        else:
            self.warnings.append("there is no header")
        try:
            self._tables()
            for (number, _), e in self.entries.items():
                if e.kind == 1 and not ((m := _OBJ.match(self.data, Reader(self.data, e.offset).skip())) and int(m[1]) == number):
                    raise Malformed(f"object {number} isn't where it should be")
            self._unlock()
            if not isinstance(self.get(self.trailer.get("/Root")), dict):
                raise Malformed("there is no catalog")
        except WrongPassword:
            raise
        except (Malformed, ValueError, KeyError, IndexError, TypeError, RecursionError) as e:
            if not self.recover:
                raise Malformed(str(e)) from None
            self.warnings.append(f"cross-reference rebuilt: {e}")
            self._rebuild()
        root = self.get(self.trailer.get("/Root"))
        if isinstance(root, dict) and isinstance(v := root.get("/Version"), Name) and v[1:] > self.version:
            self.version = v[1:]

    def _unlock(self) -> None:
        """The security handler, if there is one."""
        if "/Encrypt" in self.trailer:
            self._objects = {}
            head = self.get(self.trailer["/Encrypt"])
            ids = self.get(self.trailer.get("/ID")) or [b""]
            head = {k: self.get(v) for k, v in head.items()}
            handler, self._objects, self._packed = Handler.open(head, self.get(ids[0]), self.password), {}, {}
            self.handler = handler

    @property
    def encrypted(self) -> bool:
        return "/Encrypt" in self.trailer

    @property
    def linearized(self) -> bool:
        m = _OBJ.search(self.data, 0, 1024)
        try:
            return bool(m) and isinstance(d := Reader(self.data, m.end()).value(), dict) and "/Linearized" in d
        except Malformed:
            return False

    def _tables(self) -> None:
        at = self.data.rfind(b"startxref")
        m = re.compile(rb"startxref[\0\t\n\x0c\r ]+(\d+)").match(self.data, max(at, 0))
        if at < 0 or not m:
            raise Malformed("there is no startxref")
        todo, seen = [int(m[1])], set()
        while todo:
            at = todo.pop(0)
            if at in seen:
                continue
            seen.add(at)
            head = self._table(at) if self.data[at : at + 40].lstrip(b"\0\t\n\x0c\r ").startswith(b"xref") else self._xref_stream(at)
            if not self.trailer:
                self.trailer = {k: v for k, v in head.items() if k not in ("/W", "/Index", "/Filter", "/DecodeParms", "/Length", "/Type")}
            todo += [x for k in ("/XRefStm", "/Prev") if isinstance(x := head.get(k), int) and (k != "/XRefStm" or self.use_streams)]

    def _table(self, at: int) -> dict:
        r = Reader(self.data, at, refs=False)
        r.value()
        while isinstance(first := r.value(), int):
            count = r.value()
            start = r.skip()
            rows = _ROW.findall(self.data, start, start + 20 * count) if isinstance(count, int) and count > 0 else []
            if rows and len(rows) == count:  # as they should be, 20 bytes each
                for number, (offset, gen, used) in enumerate(rows, first):
                    if used == b"n" and int(offset):
                        self.entries.setdefault((number, int(gen)), Entry(1, int(offset)))
                r.at = start + 20 * count
                continue
            for number in range(first, first + count):
                offset, gen, used = r.value(), r.value(), r.value()
                if used == "n" and offset:
                    self.entries.setdefault((number, gen), Entry(1, offset))
                elif used not in ("n", "f"):
                    raise Malformed("a line of the cross-reference table")
        if first != "trailer":
            raise Malformed("there is no trailer")
        return Reader(self.data, r.at).value()

    def _xref_stream(self, at: int) -> dict:
        m = _OBJ.match(self.data, Reader(self.data, at).skip())
        if not m or not isinstance(s := self._indirect(m), Stream) or s.head.get("/Type") != "/XRef":
            raise Malformed("there is no cross-reference at its offset")
        body, widths = filters.decode(s.head, s.raw)[0], s.head["/W"]
        index = s.head.get("/Index", [0, s.head["/Size"]])
        numbers = (n for first, count in zip(index[::2], index[1::2], strict=True) for n in range(first, first + count))
        size = sum(widths)
        for k, number in enumerate(numbers):
            row, fields, p = body[k * size : (k + 1) * size], [], 0
            if len(row) < size:
                break
            for i, w in enumerate(widths):
                fields.append(int.from_bytes(row[p : p + w], "big") if w else int(i == 0))
                p += w
            kind, a, b = fields
            if kind == 1:
                self.entries.setdefault((number, b), Entry(1, a))
            elif kind == 2:
                self.entries.setdefault((number, 0), Entry(2, 0, a, b))
        return s.head

    def _rebuild(self) -> None:
        """Every ``n g obj`` that can be found; the last of a number counts."""
        self.entries, self._objects, self._packed, self.rebuilt = {}, {}, {}, True
        trailer: dict = {}
        for m in _OBJ.finditer(self.data):
            self.entries[int(m[1]), int(m[2])] = Entry(1, m.start())
        for m in re.finditer(rb"trailer", self.data):
            try:
                if isinstance(d := Reader(self.data, m.end()).value(), dict):
                    trailer |= d
            except Malformed:
                continue
        for number, gen in list(self.entries):
            value = self.get(Ref(number, gen))
            head = value.head if isinstance(value, Stream) else value
            if not isinstance(head, dict):
                continue
            if head.get("/Type") == "/Catalog":
                trailer["/Root"] = Ref(number, gen)
            elif head.get("/Type") == "/XRef":
                trailer = {k: head[k] for k in ("/Root", "/Info", "/ID", "/Encrypt") if k in head} | trailer
            elif head.get("/Type") == "/ObjStm" and isinstance(value, Stream):
                for i, n in enumerate(self._pack(number)[0]):
                    self.entries.setdefault((n, 0), Entry(2, 0, number, i))
        if "/Root" not in trailer:
            for number, gen in list(self.entries):
                if isinstance(v := self.get(Ref(number, gen)), dict) and v.get("/Type") == "/Catalog":
                    trailer["/Root"] = Ref(number, gen)
        if "/Root" not in trailer:
            raise Malformed("there is no catalog")
        self.trailer = {k: v for k, v in trailer.items() if k not in ("/Prev", "/XRefStm")}
        self._unlock()

    def _indirect(self, m: re.Match):
        r = Reader(self.data, m.end())
        value = r.value()
        if isinstance(value, dict) and self.data.startswith(b"stream", r.skip()):
            start = r.at + 6
            start += 2 if self.data.startswith(b"\r\n", start) else self.data.startswith((b"\n", b"\r"), start)
            length = self.get(value.get("/Length"))
            if not isinstance(length, int) or length < 0 or not _ENDSTREAM.match(self.data, start + length):
                end = self.data.find(b"endstream", start)
                if end < 0:
                    raise Malformed("a stream doesn't end")
                self.warnings.append(f"object {m[1].decode()}: wrong stream length")
                length = end - start - (2 if self.data.startswith(b"\r\n", end - 2) else self.data.startswith((b"\n", b"\r"), end - 1))
            return Stream(value, self.data[start : start + length])
        return None if isinstance(value, Operator) else value

    def _pack(self, number: int) -> tuple[list[int], list]:
        if number not in self._packed:
            self._packed[number] = ([], [])
            if isinstance(s := self.get(Ref(number)), Stream):
                body = filters.decode(s.head, s.raw)[0]
                r, n, first = Reader(body, refs=False), self.get(s.head["/N"]), self.get(s.head["/First"])
                places = [(r.value(), r.value()) for _ in range(n)]
                self._packed[number] = ([p[0] for p in places], [Reader(body, first + p[1]) for p in places])
        return self._packed[number]

    def get(self, value, depth: int = 0):
        """What a reference stands for (null if there is none); other values as they are."""
        if not isinstance(value, Ref):
            return value
        key = (value.obj, value.gen)
        if key in self._objects:
            return self._objects[key]
        entry, out = self.entries.get(key), None
        self._objects[key] = None  # a circle of references ends here
        try:
            if entry and entry.kind == 1 and (m := _OBJ.match(self.data, Reader(self.data, entry.offset).skip())):
                out = self._indirect(m)
                if self.handler and value != self.trailer.get("/Encrypt"):
                    out = self.handler.value(out, *key)
            elif entry and entry.kind == 2:
                out = self._pack(entry.stream)[1][entry.index].value()
        except (Malformed, IndexError, KeyError, TypeError) as e:
            self.warnings.append(f"object {value.obj}: {e}")
        if isinstance(out, Ref) and depth < _DEEPEST:
            out = self.get(out, depth + 1)
        self._objects[key] = out
        return out

    def objects(self) -> list[tuple[int, int, object]]:
        """All of them by number; those that can't be read are null, with a warning."""
        return [(n, g, self.get(Ref(n, g))) for n, g in sorted(self.entries)]

    def pages(self) -> list[tuple[Ref | None, dict]]:
        """The pages in order, each with the attributes that it inherits."""
        root = self.get(self.trailer.get("/Root"))
        out: list[tuple[Ref | None, dict]] = []
        seen: set = set()

        def walk(node, above: dict, depth: int) -> None:
            value = self.get(node)
            if not isinstance(value, dict) or depth > _DEEPEST or (isinstance(node, Ref) and node in seen):
                self.warnings.append("a page tree node is missing or repeated")
                return
            if isinstance(node, Ref):
                seen.add(node)
            own = above | {k: value[k] for k in INHERITED if k in value}
            if isinstance(kids := self.get(value.get("/Kids")), list):
                for kid in kids:
                    walk(kid, own, depth + 1)
            else:
                out.append((node if isinstance(node, Ref) else None, own | value))

        if isinstance(root, dict) and "/Pages" in root:
            walk(root["/Pages"], {}, 0)
        return out

    def stream_data(self, stream: Stream, level: str = "generalized") -> bytes:
        head = {k: self.get(v) for k, v in stream.head.items()}
        if isinstance(head.get("/DecodeParms"), dict):
            head["/DecodeParms"] = {k: self.get(v) for k, v in head["/DecodeParms"].items()}
        return filters.decode(head, stream.raw, level)[0]

    def content(self, page: dict) -> bytes:
        """A page's content streams as one."""
        got = self.get(page.get("/Contents"))
        parts = [self.get(x) for x in got] if isinstance(got, list) else [got]
        return b"\n".join(self.stream_data(p) for p in parts if isinstance(p, Stream))

    def tree(self, node, key: str, depth: int = 0, seen: frozenset = frozenset()) -> list[tuple]:
        """Keys and values of a name tree (``/Names``) or a number tree (``/Nums``), in order."""
        value = self.get(node)
        if not isinstance(value, dict) or depth > _DEEPEST or (isinstance(node, Ref) and node in seen):
            return []
        pairs = self.get(value.get(key)) or []
        out = list(zip(map(self.get, pairs[::2]), pairs[1::2], strict=False))
        for kid in self.get(value.get("/Kids")) or []:
            out += self.tree(kid, key, depth + 1, seen | ({node} if isinstance(node, Ref) else set()))
        return out

    def outline(self, deepest: int = 15) -> list[tuple[tuple[int, ...], Ref | None, dict]]:
        """Items depth first with their place; an item met again ends its chain."""
        root = self.get(self.trailer.get("/Root")) or {}
        out: list = []
        seen: set = set()

        def walk(ref, path: tuple[int, ...]) -> None:
            i = 0
            while isinstance(ref, Ref) and ref not in seen and isinstance(item := self.get(ref), dict):
                seen.add(ref)
                out.append(((*path, i), ref, item))
                if len(path) + 1 < deepest and "/First" in item:
                    walk(item["/First"], (*path, i))
                ref, i = item.get("/Next"), i + 1

        top = self.get(root.get("/Outlines"))
        if isinstance(top, dict):
            walk(top.get("/First"), ())
        return out
