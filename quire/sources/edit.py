"""Changes to one document in memory: pages, attachments, labels, overlays, and what a sanitizer takes out.

The plans run these on executors, a document at a time; nothing here knows of Spark.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterable

from quire.sources import filters
from quire.sources.content import expanded, instructions, unparse_instructions
from quire.sources.document import Document
from quire.sources.values import Name, Ref, Stream, decode_text, unparse
from quire.sources.writer import Options, write

#: Keys that a copied page leaves behind, as they lead back into its old document.
_LEFT = ("/Parent", "/StructParents", "/B")


def page_numbers(spec: str, n: int) -> list[int]:
    """``1-3,5,z,r2,z-1``: from 1, ``z`` the last, ``r2`` the second from the end; backwards where the first is greater."""

    def one(x: str) -> int:
        p = n if x == "z" else n + 1 - int(x[1:]) if x.startswith("r") else int(x)
        if not 1 <= p <= n:
            raise ValueError(f"there is no page {x}")
        return p

    out: list[int] = []
    for part in spec.split(","):
        a, dash, b = part.strip().partition("-")
        first, last = one(a), one(b) if dash else one(a)
        out += range(first, last + 1) if first <= last else range(first, last - 1, -1)
    return [p - 1 for p in out]


class Editor:
    """A document's objects, to be changed and written."""

    def __init__(self, data: bytes | None = None, password: bytes = b""):
        self.objects: dict[tuple[int, int], object] = {}
        self._next = 0
        self.trailer: dict = {}
        self.version = "1.7"
        if data is None:
            self.trailer[Name("/Root")] = self.add({Name("/Type"): Name("/Catalog"), Name("/Pages"): Ref(2)})
            self.add({Name("/Type"): Name("/Pages"), Name("/Kids"): [], Name("/Count"): 0})
        else:
            doc = Document(data, password=password)
            for n, g, v in doc.objects():
                head = v.head if isinstance(v, Stream) else v
                if v is not None and not (isinstance(head, dict) and head.get("/Type") in ("/XRef", "/ObjStm")):
                    self.objects[n, g] = v
            self.trailer, self.version = {k: v for k, v in doc.trailer.items() if k != "/Encrypt"}, doc.version or "1.7"
            self._flat(doc)

    def _flat(self, doc: Document) -> None:
        """The page tree as one list, inherited attributes on the pages."""
        kids = []
        for ref, page in doc.pages():
            ref = ref or self.add(page)
            self.objects[ref.obj, ref.gen] = dict(page)
            kids.append(ref)
        self.set_pages(kids)

    def add(self, value) -> Ref:
        if not self._next or (self._next, 0) in self.objects:
            self._next = max((n for n, _ in self.objects), default=0) + 1
        self._next, number = self._next + 1, self._next
        self.objects[number, 0] = value
        return Ref(number)

    def get(self, value):
        for _ in range(100):
            if not isinstance(value, Ref):
                return value
            value = self.objects.get((value.obj, value.gen))
        return None

    @property
    def root(self) -> dict:
        return self.get(self.trailer[Name("/Root")])

    def sub(self, parent: dict, key: str, default=None):
        """The value of a key, made and stored if it is missing."""
        if self.get(parent.get(key)) is None and default is not None:
            parent[Name(key)] = default
        return self.get(parent.get(key))

    def at_path(self, path: Iterable[str | int], start=None):
        """The value that names and indexes lead to from the catalog (or ``start``); an error says how far they got."""
        value, done = self.root if start is None else self.get(start), ""
        for step in path:
            inner = value.head if isinstance(value, Stream) else value
            if isinstance(step, int):
                if not isinstance(inner, list) or not -len(inner) <= step < len(inner):
                    raise IndexError(f"there is no [{step}] after {done or 'the start'}")
                value, done = self.get(inner[step]), f"{done}[{step}]"
            else:
                if not isinstance(inner, dict) or step not in inner:
                    raise KeyError(f"there is no {step} after {done or 'the start'}")
                value, done = self.get(inner[step]), done + step
        return value

    def set_path(self, path: Iterable[str | int], value, start=None) -> None:
        """A value put where a path ends; what is before its last step has to be there."""
        *way, last = path
        holder = self.at_path(way, start)
        if isinstance(last, int):
            self.at_path([last], holder)
            holder[last] = value
        elif last == "/Length" and isinstance(holder, Stream):
            raise ValueError("a stream's length follows from its data")
        elif isinstance(holder, (dict, Stream)):
            (holder.head if isinstance(holder, Stream) else holder)[Name(last)] = value
        else:
            raise KeyError(f"there is nothing that {last} could be put into")

    def delete_path(self, path: Iterable[str | int], start=None) -> None:
        *way, last = path
        holder = self.at_path(way, start)
        self.at_path([last], holder)
        del (holder.head if isinstance(holder, Stream) else holder)[last]

    def emplace(self, ref: Ref, value: dict, retain: Iterable[str] = ("/Parent",)) -> None:
        """A dictionary's entries replaced by others, but for those that are retained; whoever refers to it sees the new ones."""
        own = self.get(ref)
        kept = {k: own[k] for k in retain if k in own}
        own.clear()
        own |= value | kept

    def swap(self, a: Ref, b: Ref) -> None:
        """Two objects change places; references stay as they are."""
        one, two = (a.obj, a.gen), (b.obj, b.gen)
        self.objects[one], self.objects[two] = self.objects[two], self.objects[one]

    def pages(self) -> list[Ref]:
        return list(self.get(self.root["/Pages"])["/Kids"])

    def set_pages(self, kids: list[Ref]) -> None:
        node = self.root["/Pages"] if isinstance(self.root.get("/Pages"), Ref) else self.add({})
        self.objects[node.obj, node.gen] = {Name("/Type"): Name("/Pages"), Name("/Kids"): kids, Name("/Count"): len(kids)}
        self.root[Name("/Pages")] = node
        seen: set[Ref] = set()
        for i, ref in enumerate(kids):
            if ref in seen:  # a page that stands twice becomes two
                kids[i] = ref = self.add(dict(self.get(ref)))
            seen.add(ref)
            self.get(ref)[Name("/Parent")] = node

    def copied(self, other: Editor, value, known: dict[Ref, Ref]):
        """A value of another document with all it refers to; pages only where ``known`` has them."""
        if isinstance(value, Ref):
            if value not in known:
                target = other.get(value)
                if target is None or (isinstance(target, dict) and target.get("/Type") in ("/Page", "/Pages", "/Catalog")):
                    return None
                known[value] = self.add(None)
                self.objects[known[value].obj, 0] = self.copied(other, target, known)
            return known[value]
        if isinstance(value, dict):
            return {k: c for k, v in value.items() if (c := self.copied(other, v, known)) is not None}
        if isinstance(value, Stream):
            return Stream(self.copied(other, value.head, known), value.raw)
        if isinstance(value, list):
            return [self.copied(other, v, known) for v in value]
        return value

    def copy_pages(self, other: Editor, indexes: Iterable[int] | None = None, at: int | None = None) -> dict:
        """Pages of another document, with fields and named destinations they use; says what was renamed or dropped."""
        kids = other.pages()
        picked = list(range(len(kids))) if indexes is None else [i if i >= 0 else len(kids) + i for i in indexes]
        if any(not 0 <= i < len(kids) for i in picked):
            raise IndexError("there is no such page")
        own, known, fresh = self.pages(), {}, []
        for i in picked:
            known.setdefault(kids[i], self.add(None))
            fresh.append(known[kids[i]])
        for i in dict.fromkeys(picked):
            page = {k: v for k, v in other.get(kids[i]).items() if k not in _LEFT}
            self.objects[known[kids[i]].obj, 0] = self.copied(other, page, known)
        place = len(own) if at is None else at
        if place > len(own):
            raise IndexError("there is no such place")
        self.set_pages(own[:place] + fresh + own[place:])
        result = {"pages": len(picked), "renamed_dests": {}, "dropped_dests": [], "renamed_fields": {}}
        self._copy_dests(other, [known[kids[i]] for i in dict.fromkeys(picked)], known, result)
        self._copy_fields(other, known, result)
        return result

    def names(self, tree: str) -> dict[bytes, object]:
        """A name tree's entries."""
        out: dict[bytes, object] = {}

        def walk(node, depth=0):
            value = self.get(node)
            if isinstance(value, dict) and depth < 100:
                pairs = self.get(value.get("/Names")) or []
                out.update(zip(map(self.get, pairs[::2]), pairs[1::2], strict=False))
                for kid in self.get(value.get("/Kids")) or []:
                    walk(kid, depth + 1)

        walk((self.get(self.root.get("/Names")) or {}).get(tree))
        return out

    def set_names(self, tree: str, entries: dict[bytes, object]) -> None:
        names = self.sub(self.root, "/Names", {})
        if entries:
            names[Name(tree)] = {Name("/Names"): [x for k in sorted(entries) for x in (k, entries[k])]}
        else:
            names.pop(tree, None)

    def _holders(self, pages: list[Ref]):
        """Dictionaries with a destination, on the pages' annotations: links, and GoTo actions along their chains."""
        for ref in pages:
            for a in self.get(self.get(ref).get("/Annots")) or []:
                if not isinstance(note := self.get(a), dict):
                    continue
                yield note, "/Dest"
                todo, seen = deque([note.get("/A"), *(self.get(note.get("/AA")) or {}).values()]), set()
                while todo:
                    ref = todo.popleft()
                    if not (isinstance(ref, Ref) and ref in seen) and isinstance(action := self.get(ref), dict):
                        seen |= {ref} if isinstance(ref, Ref) else set()
                        if action.get("/S") == "/GoTo":
                            yield action, "/D"
                        after = self.get(action.get("/Next"))
                        todo += after if isinstance(after, list) else [action.get("/Next")]

    def _copy_dests(self, other: Editor, pages: list[Ref], known: dict, result: dict) -> None:
        theirs, mine, moved = other.names("/Dests"), self.names("/Dests"), {}
        old = other.get(other.root.get("/Dests")) or {}
        for holder, key in self._holders(pages):
            name = self.get(holder.get(key))
            if not isinstance(name, (bytes, Name)):
                continue
            if name not in moved:
                target = other.get(old.get(name) if isinstance(name, Name) else theirs.get(name))
                target = other.get(target.get("/D")) if isinstance(target, dict) else target
                moved[name] = None
                if isinstance(target, list) and target and isinstance(target[0], Ref) and target[0] in known:
                    base = name[1:].encode() if isinstance(name, Name) else name
                    new, i = base, 0
                    while new in mine:
                        i += 1
                        new = base + b".%d" % i
                    mine[new] = [known[target[0]], *(self.copied(other, x, known) for x in target[1:])]
                    moved[name] = new
                    if new != base:
                        result["renamed_dests"][base.decode("latin-1")] = new.decode("latin-1")
                else:
                    result["dropped_dests"].append(decode_text(name) if isinstance(name, bytes) else name[1:])
            if moved[name] is None:
                holder.pop(key, None)
            else:
                holder[Name(key)] = moved[name]
        if any(moved.values()):
            self.set_names("/Dests", mine)

    def _copy_fields(self, other: Editor, known: dict, result: dict) -> None:
        form = other.get(other.root.get("/AcroForm")) or {}
        tops = [known[f] for f in other.get(form.get("/Fields")) or [] if isinstance(f, Ref) and f in known]
        if not tops:
            return
        own = self.sub(self.root, "/AcroForm", {Name("/Fields"): []})
        fields = self.sub(own, "/Fields", [])
        taken = {self.get(self.get(f).get("/T")) for f in fields}
        for key in ("/DR", "/DA", "/NeedAppearances"):
            if key in form and key not in own:
                own[Name(key)] = self.copied(other, form[key], known)
        for f in tops:
            if f in fields:
                continue
            name = new = self.get(self.get(f).get("/T"))
            i = 0
            while isinstance(new, bytes) and new in taken:
                i += 1
                new = name + b"+%d" % i
            if new != name:
                self.get(f)[Name("/T")] = new
                result["renamed_fields"][decode_text(name)] = decode_text(new)
            taken.add(new)
            fields.append(f)

    def rotate(self, angle: int, indexes: Iterable[int] | None = None, relative: bool = True) -> None:
        if angle % 90:
            raise ValueError("a rotation is a multiple of 90 degrees")
        kids = self.pages()
        for i in range(len(kids)) if indexes is None else indexes:
            page = self.get(kids[i])
            now = self.get(page.get("/Rotate")) if relative else 0
            page[Name("/Rotate")] = ((now if isinstance(now, int) else 0) + angle) % 360

    def box(self, page: dict) -> list[float]:
        got = next((b for k in ("/TrimBox", "/CropBox", "/MediaBox") if isinstance(b := self.get(page.get(k)), list)), [0, 0, 612, 792])
        return [float(self.get(x)) for x in got]

    def overlay(self, index: int, stamp: Editor, stamp_index: int = 0, under: bool = False) -> None:
        """A page of another document over (or under) one of this, evenly scaled to its trim box."""
        page, known = self.get(self.pages()[index]), {}
        doc = Document(stamp.bytes())
        source = doc.pages()[stamp_index][1]
        a, b = self.box(page), stamp.box(source)
        k = min((a[2] - a[0]) / (b[2] - b[0]), (a[3] - a[1]) / (b[3] - b[1]))
        x, y = (a[0] + a[2] - k * (b[0] + b[2])) / 2, (a[1] + a[3] - k * (b[1] + b[3])) / 2
        form = Stream({Name("/Type"): Name("/XObject"), Name("/Subtype"): Name("/Form"), Name("/BBox"): b, Name("/Resources"): self.copied(stamp, source.get("/Resources") or {}, known)}, doc.content(source))
        resources = self.sub(page, "/Resources", {})
        objects = self.sub(resources, "/XObject", {})
        name = next(n for i in range(len(objects) + 1) if (n := f"/Fx{i}") not in objects)
        objects[Name(name)] = self.add(form)
        draw = self.add(Stream({}, f"q {k:g} 0 0 {k:g} {x:g} {y:g} cm {name} Do Q".encode()))
        now = self.get(page.get("/Contents"))
        parts = list(now) if isinstance(now, list) else [page["/Contents"]] if now is not None else []
        if under:
            page[Name("/Contents")] = [draw, *parts]
        else:
            page[Name("/Contents")] = [self.add(Stream({}, b"q")), *parts, self.add(Stream({}, b"Q")), draw]

    def attach(self, key: str, data: bytes, mime: str = "", description: str = "") -> None:
        head = {Name("/Type"): Name("/EmbeddedFile"), Name("/Params"): {Name("/Size"): len(data), Name("/CheckSum"): hashlib.md5(data).digest()}}
        if mime:
            head[Name("/Subtype")] = Name("/" + mime)
        spec = {Name("/Type"): Name("/Filespec"), Name("/F"): key, Name("/UF"): key, Name("/EF"): {Name("/F"): self.add(Stream(head, data))}}
        if description:
            spec[Name("/Desc")] = description
        coded = key.encode() if key.isascii() else b"\xfe\xff" + key.encode("utf-16-be")
        self.set_names("/EmbeddedFiles", self.names("/EmbeddedFiles") | {coded: self.add(spec)})

    def detach(self, key: str | None = None) -> None:
        """One embedded file, or all."""
        kept = {} if key is None else {k: v for k, v in self.names("/EmbeddedFiles").items() if decode_text(k) != key}
        self.set_names("/EmbeddedFiles", kept)

    def set_labels(self, ranges: list[tuple[int, str | None, str, int]]) -> None:
        """First page, style, prefix and start of each range of labels."""
        nums: list = []
        for first, style, prefix, start in sorted(ranges, key=lambda r: r[0]):
            d = {}
            if style:
                d[Name("/S")] = Name("/" + style)
            if prefix:
                d[Name("/P")] = prefix
            if start != 1:
                d[Name("/St")] = start
            nums += [first, d]
        self.root[Name("/PageLabels")] = {Name("/Nums"): nums}

    def _slots(self):
        """Every dictionary that holds actions, and under which key; additional actions one by one."""
        def extra(holder: dict):
            if isinstance(aa := self.get(holder.get("/AA")), dict):
                for key in list(aa):
                    yield aa, key
                if not aa:
                    holder.pop("/AA", None)

        yield self.root, "/OpenAction"
        yield from extra(self.root)
        for ref in self.pages():
            page = self.get(ref)
            yield from extra(page)
            for a in self.get(page.get("/Annots")) or []:
                if isinstance(note := self.get(a), dict):
                    yield note, "/A"
                    yield from extra(note)
        todo, seen = list(self.get((self.get(self.root.get("/AcroForm")) or {}).get("/Fields")) or []), set()
        while todo:
            ref = todo.pop()
            if isinstance(ref, Ref) and ref not in seen and isinstance(f := self.get(ref), dict):
                seen.add(ref)
                yield from extra(f)
                todo += self.get(f.get("/Kids")) or []
        todo, seen = [(self.get(self.root.get("/Outlines")) or {}).get("/First")], set()
        while todo:
            ref = todo.pop()
            if isinstance(ref, Ref) and ref not in seen and isinstance(item := self.get(ref), dict):
                seen.add(ref)
                yield item, "/A"
                todo += [item.get("/First"), item.get("/Next")]

    def _survivors(self, value, removed: set[str], head) -> list:
        """What is left of a /Next value: removed actions give way to their own survivors, in order.

        Chains of any length, without recursion; an action that is met again below itself is left out.
        """

        def after(value):
            got = self.get(value)
            return iter(list(got) if isinstance(got, list) else [value])

        path = {head} if isinstance(head, Ref) else set()
        stack: list[tuple] = [(None, {}, [], after(value))]
        while True:
            ref, action, out, left = stack[-1]
            for child in left:
                got = self.get(child)
                if isinstance(got, dict) and not (isinstance(child, Ref) and child in path):
                    path |= {child} if isinstance(child, Ref) else set()
                    stack.append((child, got, [], after(got["/Next"]) if "/Next" in got else iter(())))
                    break
            else:
                stack.pop()
                if not stack:
                    return out
                path -= {ref} if isinstance(ref, Ref) else set()
                if str(action.get("/S"))[1:] in removed:
                    stack[-1][2].extend(out)
                    continue
                if "/Next" in action:
                    action.pop("/Next")
                    if out:
                        action[Name("/Next")] = out[0] if len(out) == 1 else out
                stack[-1][2].append(ref)

    def remove_actions(self, removed: set[str]) -> None:
        """In one walk: a slot whose action goes is emptied, chains close their gaps."""
        for holder, key in list(self._slots()):
            action = self.get(holder.get(key))
            if not isinstance(action, dict):
                continue
            if str(action.get("/S"))[1:] in removed:
                del holder[key]
            elif "/Next" in action:
                after = self._survivors(action["/Next"], removed, holder[key])
                action.pop("/Next")
                if after:
                    action[Name("/Next")] = after[0] if len(after) == 1 else after
        list(self._slots())  # drops additional actions that are empty now
        if "JavaScript" in removed and isinstance(names := self.get(self.root.get("/Names")), dict):
            names.pop("/JavaScript", None)

    def remove_annotations(self, subtypes: set[str]) -> None:
        for ref in self.pages():
            page = self.get(ref)
            if isinstance(notes := self.get(page.get("/Annots")), list):
                kept = [a for a in notes if str((self.get(a) or {}).get("/Subtype"))[1:] not in subtypes]
                if len(kept) < len(notes):
                    page[Name("/Annots")] = kept

    def remove_attachments(self) -> None:
        """Embedded files, associated files that embed one, and what file annotations embed."""
        if isinstance(names := self.get(self.root.get("/Names")), dict):
            names.pop("/EmbeddedFiles", None)
        for value in self.objects.values():
            head = value.head if isinstance(value, Stream) else value
            if not isinstance(head, dict):
                continue
            files = self.get(head.get("/AF"))
            if any(isinstance(f := self.get(x), dict) and "/EF" in f for x in (files if isinstance(files, list) else [files])):
                del head["/AF"]
            if head.get("/Subtype") == "/FileAttachment":
                head.pop("/FS", None)

    def remove_keys(self, *keys: str, catalog_only: bool = True) -> None:
        for value in [self.root] if catalog_only else list(self.objects.values()):
            head = value.head if isinstance(value, Stream) else value
            for key in keys:
                if isinstance(head, dict):
                    head.pop(key, None)

    def add_resource(self, page: dict, kind: str, value, name: str | None = None, replace: bool = False) -> Name:
        """A resource under a name that no kind has yet, or the given one; an existing one only if it may be replaced."""
        resources = self.sub(page, "/Resources", {})
        taken = {k for v in resources.values() if isinstance(d := self.get(v), dict) for k in d}
        if name is None:
            name = next(n for i in range(len(taken) + 1) if (n := f"{kind[:3]}{i}") not in taken)
        if name in taken and not replace:
            raise ValueError(f"there is a resource {name}")
        if name in taken:
            for v in resources.values():
                if isinstance(d := self.get(v), dict):
                    d.pop(name, None)
        self.sub(resources, kind, {})[Name(name)] = value
        return Name(name)

    def contents_add(self, ref: Ref, data: bytes, prepend: bool = False) -> None:
        """A stream before or after a page's content, which becomes a list."""
        page, new = self.get(ref), self.add(Stream({}, data))
        now = self.get(page.get("/Contents"))
        parts = list(now) if isinstance(now, list) else [page["/Contents"]] if now is not None else []
        page[Name("/Contents")] = [new, *parts] if prepend else [*parts, new]

    def contents_coalesce(self, ref: Ref) -> None:
        """A page's content as one stream."""
        page = self.get(ref)
        now = self.get(page.get("/Contents"))
        if isinstance(now, list):
            parts = [self.get(p) for p in now]
            page[Name("/Contents")] = self.add(Stream({}, b"\n".join(filters.decode(p.head, p.raw)[0] for p in parts if isinstance(p, Stream))))

    def remove_unused_resources(self) -> None:
        """Of each page, the resources that no operand of its content names; pages with forms keep theirs."""
        doc = Document(self.bytes())
        for ref, (_, source) in zip(self.pages(), doc.pages(), strict=True):
            page = self.get(ref)
            used = {x for operands, _ in instructions(doc.content(source)) for x in operands if isinstance(x, Name)}
            resources = {k: dict(d) if isinstance(d := self.get(v), dict) else v for k, v in (self.get(page.get("/Resources")) or {}).items()}
            objects = resources.get("/XObject") if isinstance(resources.get("/XObject"), dict) else {}
            if any(isinstance(s := self.get(v), Stream) and s.head.get("/Subtype") == "/Form" and "/Resources" not in s.head for k, v in objects.items() if k in used):
                continue
            page[Name("/Resources")] = {k: {n: v for n, v in d.items() if n in used} if isinstance(d, dict) else d for k, d in resources.items()}

    def externalize_inline_images(self, least: int = 0) -> int:
        """Inline images of ``least`` bytes or more as resources of their pages; how many."""
        doc, count = Document(self.bytes()), 0
        for ref, (_, source) in zip(self.pages(), doc.pages(), strict=True):
            page, rows = self.get(ref), []
            page[Name("/Resources")] = {k: dict(d) if isinstance(d := self.get(v), dict) else v for k, v in (self.get(page.get("/Resources")) or {}).items()}
            for operands, operator in instructions(doc.content(source)):
                if operator == "INLINE IMAGE" and len(operands[1]) >= least:
                    head = expanded(operands[0]) | {Name("/Type"): Name("/XObject"), Name("/Subtype"): Name("/Image")}
                    rows.append(([self.add_resource(page, "/XObject", self.add(Stream(head, operands[1])))], "Do"))
                    count += 1
                else:
                    rows.append((operands, operator))
            page[Name("/Contents")] = self.add(Stream({}, unparse_instructions(rows)))
        return count

    def flatten_rotation(self) -> None:
        """/Rotate put into the content, the boxes and the annotations' rectangles."""
        for ref in self.pages():
            page = self.get(ref)
            turn = self.get(page.pop("/Rotate", 0))
            turn = turn % 360 if isinstance(turn, int) else 0
            if not turn:
                continue
            x0, y0, x1, y1 = (float(self.get(v)) for v in self.get(page.get("/MediaBox")) or [0, 0, 612, 792])
            # A turn to the right about the corner that comes to lie at the origin.
            a, b, c, d, e, f = {90: (0, -1, 1, 0, -y0, x1), 180: (-1, 0, 0, -1, x1, y1), 270: (0, 1, -1, 0, y1, -x0)}[turn]

            def moved(box, m=(a, b, c, d, e, f)) -> list[float]:
                xs = [m[0] * x + m[2] * y + m[4] for x in (box[0], box[2]) for y in (box[1], box[3])]
                ys = [m[1] * x + m[3] * y + m[5] for x in (box[0], box[2]) for y in (box[1], box[3])]
                return [min(xs), min(ys), max(xs), max(ys)]

            for key in ("/MediaBox", "/CropBox", "/BleedBox", "/TrimBox", "/ArtBox"):
                if isinstance(box := self.get(page.get(key)), list) and len(box) == 4:
                    page[Name(key)] = moved([float(self.get(v)) for v in box])
            for note in self.get(page.get("/Annots")) or []:
                if isinstance(n := self.get(note), dict) and isinstance(box := self.get(n.get("/Rect")), list) and len(box) == 4:
                    n[Name("/Rect")] = moved([float(self.get(v)) for v in box])
            now = self.get(page.get("/Contents"))
            parts = list(now) if isinstance(now, list) else [page["/Contents"]] if now is not None else []
            page[Name("/Contents")] = [self.add(Stream({}, f"q {a} {b} {c} {d} {e:g} {f:g} cm".encode())), *parts, self.add(Stream({}, b"Q"))]

    def flatten_annotations(self, forbidden: int = 3) -> None:
        """Appearances of annotations drawn into the content; invisible and hidden ones just go."""
        for ref in self.pages():
            page, draws = self.get(ref), []
            for note in self.get(page.get("/Annots")) or []:
                n = self.get(note)
                if not isinstance(n, dict) or (n.get("/F") or 0) & forbidden:
                    continue
                looks = self.get((self.get(n.get("/AP")) or {}).get("/N"))
                if isinstance(looks, dict):
                    looks = self.get(looks.get(n.get("/AS")))
                if not isinstance(looks, Stream):
                    continue
                r = [float(self.get(v)) for v in self.get(n.get("/Rect")) or [0, 0, 0, 0]]
                b = [float(self.get(v)) for v in self.get(looks.head.get("/BBox")) or [0, 0, 1, 1]]
                sx, sy = ((r[2] - r[0]) / (b[2] - b[0]) if b[2] != b[0] else 1), ((r[3] - r[1]) / (b[3] - b[1]) if b[3] != b[1] else 1)
                name = self.add_resource(page, "/XObject", self.add(Stream(dict(looks.head) | {Name("/Type"): Name("/XObject"), Name("/Subtype"): Name("/Form")}, looks.raw)))
                draws.append(f"q {sx:g} 0 0 {sy:g} {r[0] - b[0] * sx:g} {r[1] - b[1] * sy:g} cm {name} Do Q")
            page.pop("/Annots", None)
            if draws:
                now = self.get(page.get("/Contents"))
                parts = list(now) if isinstance(now, list) else [page["/Contents"]] if now is not None else []
                page[Name("/Contents")] = [self.add(Stream({}, b"q")), *parts, self.add(Stream({}, ("Q\n" + "\n".join(draws)).encode()))]

    def fields(self) -> dict[str, dict]:
        """The terminal fields by full name."""
        out: dict[str, dict] = {}

        def walk(ref, path, above, seen):
            f = self.get(ref)
            if not isinstance(f, dict) or (isinstance(ref, Ref) and ref in seen) or len(seen) > 100:
                return
            own = above | {k: f[k] for k in ("/FT", "/Ff", "/DA", "/MaxLen", "/Opt") if k in f}
            name = decode_text(t) if isinstance(t := self.get(f.get("/T")), bytes) else ""
            path = [*path, name] if name else path
            kids = [k for k in self.get(f.get("/Kids")) or [] if isinstance(d := self.get(k), dict) and "/T" in d]
            if not kids:
                out[".".join(path)] = {"field": f, **own}
            for k in kids:
                walk(k, path, own, seen | ({ref} if isinstance(ref, Ref) else set()))

        for ref in self.get((self.get(self.root.get("/AcroForm")) or {}).get("/Fields")) or []:
            walk(ref, [], {}, frozenset())
        return out

    def set_field(self, name: str, value: str | bool) -> str | None:
        """A field's value by its rules, with the text's appearance; says what was changed about the value."""
        got = self.fields()[name]
        f, kind, flags, warning = got["field"], got.get("/FT"), int(self.get(got.get("/Ff")) or 0), None
        if kind == "/Btn":
            if flags & 1 << 16:
                raise ValueError("a push button has no value")
            states = [k for w in (f, *map(self.get, self.get(f.get("/Kids")) or [])) for k in self.get((self.get(w.get("/AP")) or {}).get("/N")) or {} if isinstance(w, dict) and k != "/Off"]
            state = Name(value if isinstance(value, str) else (states or ["/Yes"])[0] if value else "/Off")
            if isinstance(value, str) and state != "/Off" and states and state not in states:
                raise ValueError(f"there is no state {value}")
            f[Name("/V")] = state
            for w in (f, *map(self.get, self.get(f.get("/Kids")) or [])):
                if isinstance(looks := self.get((self.get(w.get("/AP")) or {}).get("/N")), dict):
                    w[Name("/AS")] = state if state in looks else Name("/Off")
            return None
        if kind == "/Sig":
            raise ValueError("a signature can't be set")
        if kind == "/Ch":
            options = [decode_text(o if isinstance(o, bytes) else self.get(self.get(o)[0])) for o in map(self.get, self.get(got.get("/Opt")) or [])]
            if value not in options and not flags & 1 << 18:
                raise ValueError(f"{value!r} is not an option")
        elif not flags & 1 << 12 and ("\n" in value or "\r" in value):
            value, warning = value.replace("\r", "").replace("\n", ""), "line ends were removed"
        most = self.get(got.get("/MaxLen"))
        if kind == "/Tx" and isinstance(most, int) and len(value) > most:
            value, warning = value[:most], f"cut to {most} characters"
        f[Name("/V")] = value.encode() if value.isascii() else b"\xfe\xff" + value.encode("utf-16-be")
        for w in (f, *map(self.get, self.get(f.get("/Kids")) or [])):
            if isinstance(w, dict) and isinstance(r := self.get(w.get("/Rect")), list) and len(r) == 4:
                x0, y0, x1, y1 = (float(self.get(v)) for v in r)
                look = f"/Tx BMC q BT /Helv 11 Tf 2 {max(0, (abs(y1 - y0) - 11) / 2):g} Td ".encode() + unparse(f["/V"]) + b" Tj ET Q EMC"
                font = {Name("/Type"): Name("/Font"), Name("/Subtype"): Name("/Type1"), Name("/BaseFont"): Name("/Helvetica")}
                head = {Name("/Type"): Name("/XObject"), Name("/Subtype"): Name("/Form"), Name("/BBox"): [0, 0, abs(x1 - x0), abs(y1 - y0)], Name("/Resources"): {Name("/Font"): {Name("/Helv"): font}}}
                w[Name("/AP")] = {Name("/N"): self.add(Stream(head, look))}
        return warning

    def rename_field(self, name: str, new: str) -> None:
        """A field's own (last) name; another field of its parent may not have it."""
        fields = self.fields()
        full = ".".join([*name.split(".")[:-1], new])
        if full in fields:
            raise ValueError(f"there is a field {full}")
        fields[name]["field"][Name("/T")] = new.encode() if new.isascii() else b"\xfe\xff" + new.encode("utf-16-be")

    def remove_fields(self, names: Iterable[str]) -> None:
        """Fields with their widgets; parents left without kids go too."""
        gone = {id(self.fields()[n]["field"]) for n in names}

        def pruned(refs: list) -> list:
            out = []
            for ref in refs:
                f = self.get(ref)
                if id(f) in gone:
                    widgets.update(map(id, [f, *map(self.get, self.get(f.get("/Kids")) or [])]))
                    continue
                if isinstance(kids := self.get(f.get("/Kids")) if isinstance(f, dict) else None, list):
                    left = pruned(kids)
                    if not left:
                        continue
                    f[Name("/Kids")] = left
                out.append(ref)
            return out

        widgets: set[int] = set()
        form = self.get(self.root.get("/AcroForm")) or {}
        form[Name("/Fields")] = pruned(self.get(form.get("/Fields")) or [])
        for ref in self.pages():
            page = self.get(ref)
            if isinstance(notes := self.get(page.get("/Annots")), list):
                page[Name("/Annots")] = [n for n in notes if id(self.get(n)) not in widgets]

    def disable_signatures(self) -> None:
        """Signature fields lose their kind and value, the document its marks of being signed."""
        for got in self.fields().values():
            if got.get("/FT") == "/Sig":
                for key in ("/FT", "/V", "/SV", "/Lock"):
                    got["field"].pop(key, None)
        self.root.pop("/Perms", None)
        (self.get(self.root.get("/AcroForm")) or {}).pop("/SigFlags", None)

    def orphaned_widgets(self) -> int:
        """Widgets on pages that no field of the form leads to."""
        reached, todo = set(), list(self.get((self.get(self.root.get("/AcroForm")) or {}).get("/Fields")) or [])
        while todo:
            f = self.get(todo.pop())
            if isinstance(f, dict) and id(f) not in reached:
                reached.add(id(f))
                todo += self.get(f.get("/Kids")) or []
        notes = [self.get(n) for ref in self.pages() for n in self.get(self.get(ref).get("/Annots")) or []]
        return sum(isinstance(n, dict) and n.get("/Subtype") == "/Widget" and id(n) not in reached for n in notes)

    def as_form(self, index: int) -> Ref:
        """A page's content as a form that others can draw."""
        doc = Document(self.bytes())
        page = doc.pages()[index][1]
        own = self.get(self.pages()[index])
        return self.add(Stream({Name("/Type"): Name("/XObject"), Name("/Subtype"): Name("/Form"), Name("/BBox"): self.box(own), Name("/Resources"): own.get("/Resources", {})}, doc.content(page)))

    def live(self) -> dict[tuple[int, int], object]:
        """The objects that can be reached from the trailer."""
        out: dict = {}
        todo = [self.trailer.get("/Root"), self.trailer.get("/Info")]
        while todo:
            value = todo.pop()
            if isinstance(value, Ref):
                key = (value.obj, value.gen)
                if key in out or key not in self.objects:
                    continue
                out[key] = value = self.objects[key]
            if isinstance(value, Stream):
                todo += value.head.values()
            elif isinstance(value, (dict, list)):
                todo += value.values() if isinstance(value, dict) else value
        return out

    def bytes(self, options: Options = Options()) -> bytes:
        return write(self.live(), self.trailer, self.version, options)


