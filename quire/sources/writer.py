"""Objects to bytes: a file with a cross-reference table and an id that depends on the content alone."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from quire.sources import filters
from quire.sources.crypt import Encryption
from quire.sources.values import Name, Ref, Stream, unparse


@dataclass(frozen=True)
class Options:
    """How a file is written; ``problem`` tells what doesn't go together."""

    compress: bool = True
    level: int = -1
    decode: str = "generalized"
    normalize: bool = False
    linearize: bool = False
    encrypt: Encryption | None = None
    static_id: bool = False
    min_version: str = ""
    force_version: str = ""
    object_streams: bool = False

    def problem(self) -> str | None:
        if self.encrypt and (self.normalize or self.decode not in ("none", "generalized")):
            return "encryption excludes normalized content and other decode levels"
        if self.encrypt and (problem := self.encrypt.problem()):
            return problem
        if self.normalize and self.linearize:
            return "linearized files can't have normalized content"
        if self.linearize:
            return "this writer doesn't linearize"
        if self.object_streams and self.force_version and self.force_version < "1.5":
            return "object streams need version 1.5"
        if not -1 <= self.level <= 9:
            return "a compression level is -1 to 9"
        return None


def _ready(value, options: Options):
    """A value as it is written: streams compressed or decoded, with their length."""
    if not isinstance(value, Stream):
        return value
    head, raw = dict(value.head), value.raw
    if options.compress and "/Filter" not in head:
        raw = filters.encode_flate(raw, options.level)
        head[Name("/Filter")] = Name("/FlateDecode")
    elif not options.compress and options.decode != "none":
        raw, left = filters.decode(head, raw, options.decode)
        head.pop("/Filter", None), head.pop("/DecodeParms", None)
        if left:
            head[Name("/Filter")] = [n for n, _ in left]
            head[Name("/DecodeParms")] = [p or None for _, p in left]
    return Stream(head, raw)


def _written(value) -> bytes:
    if not isinstance(value, Stream):
        return unparse(value)
    return unparse(value.head | {Name("/Length"): len(value.raw)}) + b"\nstream\n" + value.raw + b"\nendstream"


#: Objects that an object stream holds.
IN_STREAM = 100


def _packed(ready: dict, level: int) -> tuple[dict, dict[int, tuple[int, int]]]:
    """The objects with those that are no streams put into object streams, and where each of these is: stream and place."""
    loose = [(n, v) for (n, gen), v in ready.items() if not gen and not isinstance(v, Stream)]
    out, places, own = {k: v for k, v in ready.items() if k[1] or isinstance(v, Stream)}, {}, max((n for n, _ in ready), default=0)
    for at in range(0, len(loose), IN_STREAM):
        part, own, body, head = loose[at : at + IN_STREAM], own + 1, bytearray(), []
        for i, (n, value) in enumerate(part):
            head.append(b"%d %d" % (n, len(body)))
            body += unparse(value) + b"\n"
            places[n] = (own, i)
        first = b" ".join(head) + b"\n"
        out[own, 0] = Stream({Name("/Type"): Name("/ObjStm"), Name("/N"): len(part), Name("/First"): len(first), Name("/Filter"): Name("/FlateDecode")}, filters.encode_flate(first + bytes(body), level))
    return out, places


def _xref_stream(places: dict[int, tuple[int, int]], packed: dict[int, tuple[int, int]], head: dict, at: int, level: int) -> bytes:
    """The cross-reference stream, itself an object at ``at``, and the file's end."""
    own = max([*places, *packed], default=0) + 1
    places = places | {own: (at, 0)}
    rows = b"\0" + bytes(4) + b"\xff\xff"
    for n in range(1, own + 1):
        kind, x, y = (2, *packed[n]) if n in packed else (1, *places[n]) if n in places else (0, 0, 0)
        rows += bytes([kind]) + x.to_bytes(4, "big") + y.to_bytes(2, "big")
    entries = head | {Name("/Type"): Name("/XRef"), Name("/Size"): own + 1, Name("/W"): [1, 4, 2], Name("/Filter"): Name("/FlateDecode")}
    return b"%d 0 obj\n" % own + _written(Stream(entries, filters.encode_flate(rows, level))) + b"\nendobj\nstartxref\n%d\n%%%%EOF\n" % at


def write(objects: dict[tuple[int, int], object], trailer: dict, version: str = "1.7", options: Options = Options()) -> bytes:
    """A whole file of the numbered objects; ``trailer`` has /Root and what else stays."""
    if problem := options.problem():
        raise ValueError(problem)
    version = options.force_version or max(version or "1.7", options.min_version, "1.5" if options.object_streams else "")
    ready = {k: _ready(v, options) for k, v in sorted(objects.items())}
    whole, bodies = hashlib.md5(), {k: _written(v) for k, v in ready.items()}
    for (number, gen), body in bodies.items():
        whole.update(b"%d %d " % (number, gen) + body)
    digest = b"\x31\x41\x59\x26\x53\x58\x97\x93" * 2 if options.static_id else whole.digest()
    first = trailer.get("/ID")
    ids = [first[0] if isinstance(first, list) and first else digest, digest]
    head = {k: v for k, v in trailer.items() if k in ("/Root", "/Info")}
    packed: dict[int, tuple[int, int]] = {}
    if options.object_streams:
        ready, packed = _packed(ready, options.level)
        bodies = {k: bodies[k] if k in bodies else _written(v) for k, v in ready.items()}
    if options.encrypt:
        rules, handler = options.encrypt.start(ids[0], digest if options.static_id else b"")
        ready = {k: handler.value(v, *k, encrypt=True) for k, v in ready.items()}
        own = max((n for n, _ in ready), default=0) + 1
        ready[own, 0] = rules
        bodies = {k: _written(v) for k, v in ready.items()}
        head[Name("/Encrypt")] = Ref(own)
    out, places = bytearray(f"%PDF-{version}\n%".encode() + b"\xbf\xf7\xa2\xfe\n"), {}
    for number, gen in list(bodies):
        places[number] = (len(out), gen)
        out += b"%d %d obj\n" % (number, gen) + bodies.pop((number, gen)) + b"\nendobj\n"
    if options.object_streams:
        return bytes(out) + _xref_stream(places, packed, head | {Name("/ID"): ids}, len(out), options.level)
    size, at = max(places, default=0) + 1, len(out)
    lines = [b"0000000000 65535 f \n"]
    for number in range(1, size):
        offset, gen = places.get(number, (0, 0))
        lines.append(b"%010d %05d n \n" % (offset, gen) if number in places else b"0000000000 00000 f \n")
    head |= {Name("/Size"): size, Name("/ID"): ids}
    return bytes(out) + b"xref\n0 %d\n" % size + b"".join(lines) + b"trailer " + unparse(head) + b"\nstartxref\n%d\n%%%%EOF\n" % at


class Builder:
    """A new file: objects as they are added, pages in order."""

    def __init__(self):
        self.objects: dict[tuple[int, int], object] = {}
        self.pages_ref = self.add({Name("/Type"): Name("/Pages")})
        self.root = {Name("/Type"): Name("/Catalog"), Name("/Pages"): self.pages_ref}
        self.root_ref = self.add(self.root)
        self.kids: list[Ref] = []
        self.info: dict = {}

    def add(self, value) -> Ref:
        number = len(self.objects) + 1
        self.objects[number, 0] = value
        return Ref(number)

    def page(self, content: bytes = b"", resources: dict | None = None, box: tuple = (0, 0, 612, 792), **more) -> Ref:
        """A page; keys of ``more`` without their slash."""
        page = {Name("/Type"): Name("/Page"), Name("/Parent"): self.pages_ref, Name("/MediaBox"): list(box), Name("/Resources"): resources or {}, Name("/Contents"): self.add(Stream({}, content))}
        self.kids.append(self.add(page | {Name("/" + k): v for k, v in more.items()}))
        return self.kids[-1]

    def bytes(self, options: Options = Options()) -> bytes:
        self.objects[self.pages_ref.obj, 0] = {Name("/Type"): Name("/Pages"), Name("/Kids"): list(self.kids), Name("/Count"): len(self.kids)}
        trailer = {Name("/Root"): self.root_ref}
        if self.info:
            trailer[Name("/Info")] = self.add(self.info)
        return write(self.objects, trailer, "1.7", options)
