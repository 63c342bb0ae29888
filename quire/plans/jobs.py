"""Jobs: a specification that is built up, checked, and run over many documents."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.plans.sanitizer import edited
from quire.session import batched, shipped, spread
from quire.sources.content import instructions, unparse_instructions
from quire.sources.crypt import Encryption
from quire.sources.document import Document
from quire.sources.edit import Editor, page_numbers
from quire.sources.values import Name, Stream, decode_text
from quire.sources.writer import Options


class Job:
    """Methods add to the specification and return the job; ``run`` makes a plan of it."""

    def __init__(self, spec: dict | str | None = None):
        self.spec: dict = json.loads(spec) if isinstance(spec, str) else dict(spec or {})

    def _set(self, key: str, value) -> Job:
        self.spec[key] = value
        return self

    def _more(self, key: str, value) -> Job:
        self.spec.setdefault(key, []).append(value)
        return self

    def pages(self, spec: str) -> Job:
        return self._set("pages", spec)

    def split(self, size: int = 1) -> Job:
        return self._set("split", size)

    def collate(self, size: int = 1) -> Job:
        return self._set("collate", size)

    def rotate(self, angle: int, pages: str = "1-z", relative: bool = True) -> Job:
        return self._more("rotate", [angle, pages, relative])

    def compress(self, level: int = -1) -> Job:
        return self._set("compress", level)

    def uncompressed(self) -> Job:
        return self._set("uncompressed", True)

    def normalize_content(self) -> Job:
        return self._set("normalize", True)

    def coalesce_contents(self) -> Job:
        return self._set("coalesce", True)

    def flatten_annotations(self) -> Job:
        """Appearances become content."""
        return self._set("flatten_annotations", True)

    def flatten_rotation(self) -> Job:
        return self._set("flatten_rotation", True)

    def generate_appearances(self) -> Job:
        """Of all text and choice fields, from their values."""
        return self._set("generate_appearances", True)

    def externalize_inline_images(self, min_size: int = 0) -> Job:
        return self._set("externalize", min_size)

    def qdf(self) -> Job:
        """For reading and editing by hand: nothing compressed, content a line for each instruction."""
        return self.uncompressed().normalize_content()

    def remove_unreferenced_resources(self) -> Job:
        return self._set("remove_unused", True)

    def copy_attachments_from(self, source: bytes, prefix: str = "") -> Job:
        """The attachments of a small file, which is part of the specification; a prefix goes before their keys."""
        return self._more("copy_attachments", [source.hex(), prefix])

    def set(self, **keys) -> Job:
        """Keys of the specification by name; an unknown one is an error."""
        if unknown := set(keys) - _KNOWN:
            raise ValueError(f"unknown keys: {', '.join(sorted(unknown))}")
        self.spec |= keys
        return self

    def linearize(self) -> Job:
        return self._set("linearize", True)

    def encrypt(self, owner: str = "", user: str = "", revision: int = 6, aes: bool = True, metadata: bool = True, denied: tuple[str, ...] = ()) -> Job:
        return self._set("encrypt", {"owner": owner, "user": user, "revision": revision, "aes": aes, "metadata": metadata, "denied": sorted(denied)})

    def password(self, password: str) -> Job:
        """Of the inputs; what is written is plain unless it is encrypted anew."""
        return self._set("password", password)

    def min_version(self, version: str) -> Job:
        return self._set("min_version", version)

    def force_version(self, version: str) -> Job:
        return self._set("force_version", version)

    def object_streams(self) -> Job:
        """Objects that are no streams are written into streams."""
        return self._set("object_streams", True)

    def static_id(self) -> Job:
        return self._set("static_id", True)

    def remove(self, *what: str) -> Job:
        """Of metadata, info, acroform, structure, page_labels."""
        for x in what:
            if x not in _REMOVED:
                raise ValueError(f"{x} can't be removed")
            self._more("remove", x)
        return self

    def set_page_labels(self, ranges: list[tuple[int, str | None, str, int]]) -> Job:
        return self._set("labels", [list(r) for r in ranges])

    def attach(self, key: str, data: bytes, mime: str = "") -> Job:
        return self._more("attach", [key, data.hex(), mime])

    def detach(self, key: str) -> Job:
        return self._more("detach", key)

    def overlay(self, stamp: bytes, under: bool = False) -> Job:
        """A small file whose first page goes onto every page; it is part of the specification."""
        return self._more("overlay", [stamp.hex(), under])

    def to_json(self) -> str:
        return json.dumps(self.spec, sort_keys=True)

    def options(self) -> Options:
        s = self.spec
        return Options(compress=not s.get("uncompressed", False), level=s.get("compress", -1), normalize=s.get("normalize", False), linearize=s.get("linearize", False), encrypt=Encryption(**s["encrypt"] | {"denied": frozenset(s["encrypt"]["denied"])}) if "encrypt" in s else None, static_id=s.get("static_id", False), min_version=s.get("min_version", ""), force_version=s.get("force_version", ""), object_streams=s.get("object_streams", False))

    def check(self) -> None:
        """Raises what can be known to be wrong before any document is read."""
        if problem := self.options().problem():
            raise ValueError(problem)
        for angle, *_ in self.spec.get("rotate", []):
            if angle % 90:
                raise ValueError("a rotation is a multiple of 90 degrees")
        if "split" in self.spec and self.spec["split"] < 1:
            raise ValueError("a part has a page or more")
        if unknown := set(self.spec) - _KNOWN:
            raise ValueError(f"unknown keys: {', '.join(sorted(unknown))}")

    def edit(self, e: Editor) -> None:
        """All of it but splitting, on one document."""
        s = self.spec
        if "pages" in s:
            kids = e.pages()
            e.set_pages([kids[i] for i in page_numbers(s["pages"], len(kids))])
        for angle, pages, relative in s.get("rotate", []):
            e.rotate(angle, page_numbers(pages, len(e.pages())) if e.pages() else [], relative)
        for stamp, under in s.get("overlay", []):
            for i in range(len(e.pages())):
                e.overlay(i, Editor(bytes.fromhex(stamp)), 0, under)
        for x in s.get("remove", []):
            if x == "info":
                e.trailer.pop("/Info", None)
            else:
                e.remove_keys(*_REMOVED[x])
        if "labels" in s:
            e.set_labels([tuple(r) for r in s["labels"]])
        for key, data, mime in s.get("attach", []):
            e.attach(key, bytes.fromhex(data), mime)
        for key in s.get("detach", []):
            e.detach(key)
        for source, prefix in s.get("copy_attachments", []):
            copy_attachments(e, Editor(bytes.fromhex(source)), prefix)
        if s.get("generate_appearances"):
            for name, f in e.fields().items():
                value = e.get(f["field"].get("/V"))
                if f.get("/FT") in ("/Tx", "/Ch") and isinstance(value, bytes):
                    e.set_field(name, decode_text(value) or "")
        if s.get("flatten_annotations"):
            e.flatten_annotations()
        if s.get("flatten_rotation"):
            e.flatten_rotation()
        if "externalize" in s:
            e.externalize_inline_images(s["externalize"])
        if s.get("remove_unused"):
            e.remove_unused_resources()
        if s.get("coalesce") or s.get("normalize"):
            doc = Document(e.bytes())
            for ref, (_, page) in zip(e.pages(), doc.pages(), strict=True):
                body = doc.content(page)
                body = unparse_instructions(instructions(body)) if s.get("normalize") else body
                e.get(ref)[Name("/Contents")] = e.add(Stream({}, body))

    def run(self, files: DataFrame) -> DataFrame:
        """``path, content, problem`` (and ``part``, if split) of each file of ``path, content``."""
        self.check()
        if "split" in self.spec:
            return self._parts(files)
        return edited(files, self.edit, self.options(), self.spec.get("password", ""))

    def _parts(self, files: DataFrame) -> DataFrame:
        size, options, change, password = self.spec["split"], self.options(), self.edit, self.spec.get("password", "").encode()

        schema = pa.schema([("path", pa.string()), ("part", pa.int32()), ("content", pa.binary()), ("problem", pa.string())])

        def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            for batch in batches:
                for i in range(batch.num_rows):
                    path, rows = batch.column(0)[i].as_py(), []
                    try:
                        whole = Editor(batch.column(1)[i].as_py() or b"", password)
                        change(whole)
                        n = len(whole.pages())
                        for part, first in enumerate(range(0, n, size)):
                            e = Editor()
                            e.copy_pages(whole, range(first, min(n, first + size)))
                            rows.append((path, part, e.bytes(options), None))
                    except (ValueError, TypeError, KeyError, IndexError, AttributeError, RecursionError) as x:
                        rows = [(path, 0, None, f"{type(x).__name__}: {x}")]
                    yield from rows

        return shipped(files).select("path", "content").mapInArrow(lambda batches: batched(parts(batches), schema), "path string, part int, content binary, problem string")

    def merge(self, files: DataFrame, by: str = "target", order: str = "seq") -> DataFrame:
        """``target, content, problem``: the files of each target in order as one, or collated.

        A merged file is one value, so its inputs meet in one task; targets are many.
        """
        self.check()
        options, change, turn, password = self.options(), self.edit, self.spec.get("collate"), self.spec.get("password", "").encode()

        def run(key: tuple, rows: pa.Table) -> pa.Table:
            out = why = None
            try:
                inputs = [Editor(r["content"], password) for r in sorted(rows.to_pylist(), key=lambda r: r["seq"])]
                e = Editor()
                if turn:
                    longest = max(len(x.pages()) for x in inputs)
                    for first in range(0, longest, turn):
                        for x in inputs:
                            e.copy_pages(x, range(min(first, len(x.pages())), min(first + turn, len(x.pages()))))
                else:
                    for x in inputs:
                        e.copy_pages(x)
                change(e)
                out = e.bytes(options)
            except (ValueError, TypeError, KeyError, IndexError, AttributeError, RecursionError) as x:
                why = f"{type(x).__name__}: {x}"
            return pa.table({"target": pa.array([key[0].as_py()], pa.string()), "content": pa.array([out], pa.binary()), "problem": pa.array([why], pa.string())})

        got = shipped(files).select(F.col(by).cast("string").alias("target"), F.col(order).cast("long").alias("seq"), "content")
        return spread(got, "target").groupBy("target").applyInArrow(run, "target string, content binary, problem string")


def copy_attachments(e: Editor, other: Editor, prefix: str = "") -> None:
    """The attachments of another document; a key that is taken is an error."""
    own, known = e.names("/EmbeddedFiles"), {}
    for key, value in other.names("/EmbeddedFiles").items():
        name = prefix.encode() + key
        if name in own:
            raise ValueError(f"there is an attachment {decode_text(name)}")
        own[name] = e.copied(other, value, known)
    e.set_names("/EmbeddedFiles", own)


_REMOVED = {"metadata": ("/Metadata",), "info": (), "acroform": ("/AcroForm",), "structure": ("/StructTreeRoot", "/MarkInfo"), "page_labels": ("/PageLabels",)}
_KNOWN = {"pages", "split", "collate", "rotate", "compress", "uncompressed", "normalize", "coalesce", "linearize", "encrypt", "password", "min_version", "force_version", "static_id", "remove", "labels", "attach", "detach", "overlay", "flatten_annotations", "flatten_rotation", "generate_appearances", "externalize", "remove_unused", "copy_attachments", "object_streams"}
