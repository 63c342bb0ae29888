"""Values of the page-description format: reading from bytes, writing to bytes, and as tagged JSON.

Python stands for the kinds thus: None, bool, int and Real (its text kept), bytes for
strings, Name, list, dict (keys with their slash), Ref, Stream, and Operator within
content. Tagged JSON writes strings as ``u:`` and text or ``b:`` and hex, names as
they are, references as ``n:7 0 R``, reals as ``r:`` and their text, streams as
``{"stream": {dict}}``; dictionaries have sorted keys, so equal values have equal texts.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from functools import lru_cache


class Name(str):
    """With its leading slash."""


class Real(str):
    """The text of a number with a point."""


class Operator(str):
    """A bare word in content."""


@dataclass(frozen=True)
class Ref:
    obj: int
    gen: int = 0


@dataclass
class Stream:
    head: dict
    raw: bytes = field(repr=False)


class Malformed(ValueError):
    """Bytes that can't be read."""


SPACE, DELIMITER = b"\0\t\n\x0c\r ", b"()<>[]{}/%"
_GAPS = SPACE + b"%"
_GAP = re.compile(rb"(?:[\0\t\n\x0c\r ]+|%[^\r\n]*)*")
_WORD = re.compile(rb"[^\0\t\n\x0c\r ()<>\[\]{}/%]+")
_GAPPED = rb"(?:[\0\t\n\x0c\r ]++|%[^\r\n]*+)*+"
#: The most frequent values after a gap: a name, with or without references, an integer, a string without escapes, a dictionary's or a list's beginning.
_OFTEN = [re.compile(_GAPPED + rb"(?:(/[^\0\t\n\x0c\r ()<>\[\]{}/%]*+)|" + ref + rb"(\d++|[+-]\d++)(?![^\0\t\n\x0c\r ()<>\[\]{}/%])|\(([^()\\]*+)\)|(<<)|(\[))") for ref in (rb"(?!)(.)(.)|", rb"(\d++)[\0\t\n\x0c\r ]++(\d++)[\0\t\n\x0c\r ]++R(?![^\0\t\n\x0c\r ()<>\[\]{}/%])|")]
_DICT_END, _LIST_END = re.compile(_GAPPED + rb"(?:(>>)|\Z)"), re.compile(_GAPPED + rb"(?:(\])|\Z)")
_PLAIN = re.compile(rb"[ -~]*")
_INT, _REAL = re.compile(rb"[+-]?\d+\Z"), re.compile(rb"[+-]?(?:\d+\.\d*|\.\d+)\Z")
_REF = re.compile(rb"(\d+)[\0\t\n\x0c\r ]+(\d+)[\0\t\n\x0c\r ]+R(?![^\0\t\n\x0c\r ()<>\[\]{}/%])")
_ESCAPES = {ord("n"): 10, ord("r"): 13, ord("t"): 9, ord("b"): 8, ord("f"): 12}
_DEEPEST = 200
#: Names no longer than this are remembered, as files repeat them.
_SHORT = 64


def _read_name(raw: bytes) -> Name:
    if b"#" in raw:
        raw = re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), raw)
    return Name(raw.decode("utf-8", "surrogateescape"))


_known_name = lru_cache(4096)(_read_name)


class Reader:
    """Values one after another; ``refs``: whether ``7 0 R`` is a reference (not so in content)."""

    def __init__(self, data: bytes, at: int = 0, refs: bool = True):
        self.data, self.at, self._often = data, at, _OFTEN[refs].match

    def skip(self) -> int:
        at, data = self.at, self.data
        if at < len(data) and data[at] not in _GAPS:
            return at
        self.at = at = _GAP.match(data, at).end()
        return at

    def ended(self) -> bool:
        return self.skip() >= len(self.data)

    def value(self, depth: int = 0):
        if depth <= _DEEPEST and (m := self._often(self.data, self.at)):
            self.at, kind = m.end(), m.lastindex
            if kind == 1:
                return _known_name(m[1]) if len(m[1]) <= _SHORT else _read_name(m[1])
            if kind == 3:
                return Ref(int(m[2]), int(m[3]))
            if kind == 4:
                return int(m[4])
            if kind == 5:
                return m[5]
            return self._dict(depth) if kind == 6 else self._list(depth)
        data, at = self.data, self.skip()
        if depth > _DEEPEST:
            raise Malformed("nested too deeply")
        if at >= len(data):
            raise Malformed("the data ends within a value")
        c = data[at : at + 1]
        if c == b"(":
            return self._string()
        if c == b"<":
            end = data.find(b">", at)
            if end < 0:
                raise Malformed("a hex string doesn't end")
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[at + 1 : end])
            self.at = end + 1
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        m = _WORD.match(data, at)
        if not m:
            self.at += 2 if data.startswith(b">>", at) else 1
            raise Malformed(f"unexpected {c!r}")
        self.at = m.end()
        word = m[0]
        if word.isdigit() or _INT.match(word):
            return int(word)
        if _REAL.match(word):
            return Real(word.decode())
        return {b"true": True, b"false": False, b"null": None}.get(word, Operator(word.decode("latin-1")))

    def _string(self) -> bytes:
        data, i, depth, out = self.data, self.at + 1, 1, bytearray()
        while i < len(data):
            c = data[i]
            if c == 0x5C:
                i += 1
                if i >= len(data):
                    break
                c = data[i]
                if 48 <= c <= 55:
                    n = 1
                    while n < 3 and i + n < len(data) and 48 <= data[i + n] <= 55:
                        n += 1
                    out.append(int(data[i : i + n], 8) & 255)
                    i += n
                    continue
                if c in b"\r\n":
                    i += 2 if data[i : i + 2] == b"\r\n" else 1
                    continue
                out.append(_ESCAPES.get(c, c))
            elif c == 0x28:
                depth += 1
                out.append(c)
            elif c == 0x29:
                depth -= 1
                if not depth:
                    self.at = i + 1
                    return bytes(out)
                out.append(c)
            else:
                out.append(c)
            i += 1
        raise Malformed("a string doesn't end")

    def _list(self, depth: int) -> list:
        """What follows a list's beginning; one without an end goes to the end of the data."""
        out: list = []
        while not (m := _LIST_END.match(self.data, self.at)):
            out.append(self.value(depth + 1))
        self.at = m.end() + (m[1] is None)
        return out

    def _dict(self, depth: int) -> dict:
        out: dict = {}
        while not (m := _DICT_END.match(self.data, self.at)):
            key = self.value(depth + 1)
            if not isinstance(key, Name):
                raise Malformed("a key isn't a name")
            if (m := _DICT_END.match(self.data, self.at)) and m[1]:
                self.at = m.start(1)
                raise Malformed("a key without a value")
            if (value := self.value(depth + 1)) is not None:
                out[key] = value
        self.at = m.end() + 2 * (m[1] is None)
        return out


def parse(data: bytes):
    """One value and nothing after it."""
    r = Reader(data)
    out = r.value()
    if not r.ended():
        raise Malformed("there is more than one value")
    return out


_ODD = re.compile(rb"[^!-~]|[()<>\[\]{}/%#]")


def _coded_name(name: str) -> bytes:
    return b"/" + _ODD.sub(lambda x: b"#%02x" % x[0][0], name[1:].encode("utf-8", "surrogateescape"))


_known_code = lru_cache(4096)(_coded_name)


def _written_name(name: str) -> bytes:
    return _known_code(name) if len(name) <= _SHORT else _coded_name(name)


def unparse(value) -> bytes:
    """The bytes of a value; a stream's are those of its dictionary."""
    kind = type(value)
    if kind is Ref:
        return b"%d %d R" % (value.obj, value.gen)
    if kind is Name:
        return _written_name(value)
    if kind is int:
        return b"%d" % value
    if kind is dict:
        return b"<< " + b"".join([_written_name(k) + b" " + unparse(v) + b" " for k, v in value.items()]) + b">>"
    if value is None:
        return b"null"
    if isinstance(value, bool):
        return b"true" if value else b"false"
    if isinstance(value, Name):
        return _written_name(value)
    if isinstance(value, (Real, Operator)):
        return value.encode("latin-1")
    if isinstance(value, int):
        return b"%d" % value
    if isinstance(value, float):
        if value != value or value in (float("inf"), float("-inf")):
            raise ValueError("NaN and infinity can't be written")
        return (f"{value:.6f}".rstrip("0").rstrip(".") or "0").encode()
    if isinstance(value, str):
        value = _coded(value)
    if isinstance(value, (bytes, bytearray)):
        if _PLAIN.fullmatch(value):
            return b"(" + re.sub(rb"([()\\])", rb"\\\1", bytes(value)) + b")"
        return b"<" + bytes(value).hex().encode() + b">"
    if isinstance(value, Ref):
        return b"%d %d R" % (value.obj, value.gen)
    if isinstance(value, dict):
        return b"<< " + b"".join(_written_name(k) + b" " + unparse(v) + b" " for k, v in value.items()) + b">>"
    if isinstance(value, Stream):
        return unparse(value.head)
    if isinstance(value, (list, tuple)):
        return b"[ " + b"".join(unparse(v) + b" " for v in value) + b"]"
    raise TypeError(f"no value of the format: {type(value).__name__}")


def tag(value) -> str:
    kinds = ((bool, "boolean"), (int, "integer"), (Real, "real"), (Name, "name"), (Operator, "operator"), (bytes, "string"), (list, "array"), (dict, "dictionary"), (Stream, "stream"), (Ref, "reference"))
    return "null" if value is None else next(name for kind, name in kinds if isinstance(value, kind))


def decode_text(raw: bytes) -> str | None:
    """A text string's text, null if its bytes have none."""
    from quire.functions.text import PDFDOC

    try:
        if raw.startswith((b"\xfe\xff", b"\xff\xfe")):
            return raw.decode("utf-16")
        if raw.startswith(b"\xef\xbb\xbf"):
            return raw[3:].decode()
    except UnicodeDecodeError:
        return None
    return "".join(chr(PDFDOC.get(c, c)) for c in raw)


def _coded(text: str) -> bytes:
    """ASCII as it is, else UTF-16 with its mark."""
    return text.encode() if text.isascii() else b"\xfe\xff" + text.encode("utf-16-be", "surrogatepass")


def _tagged(value):
    kind = type(value)
    if kind is dict:
        return {k: _tagged(v) for k, v in value.items()}
    if kind is Ref:
        return f"n:{value.obj} {value.gen} R"
    if isinstance(value, Name) or value is None or isinstance(value, (bool, int)):
        return value
    if isinstance(value, Real):
        return "r:" + value
    if isinstance(value, Operator):
        return "o:" + value
    if isinstance(value, bytes):
        text = decode_text(value)
        return "u:" + text if text is not None and text.isprintable() and _coded(text) == value else "b:" + value.hex()
    if isinstance(value, Ref):
        return f"n:{value.obj} {value.gen} R"
    if isinstance(value, dict):
        return {k: _tagged(v) for k, v in value.items()}
    if isinstance(value, Stream):
        return {"stream": _tagged(value.head)}
    return [_tagged(v) for v in value]


_JSON = json.JSONEncoder(sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def to_json(value) -> str:
    return _JSON.encode(_tagged(value)).encode("utf-8", "replace").decode()


def _untagged(x, raw: bytes):
    if isinstance(x, str):
        if x.startswith("/"):
            return Name(x)
        kind, rest = x[:2], x[2:]
        if kind == "u:":
            return _coded(rest)
        if kind == "b:":
            return bytes.fromhex(rest)
        if kind == "n:":
            obj, gen, _ = rest.split()
            return Ref(int(obj), int(gen))
        if kind in ("r:", "o:"):
            return Real(rest) if kind == "r:" else Operator(rest)
        raise Malformed(f"a string without a tag: {x[:20]}")
    if isinstance(x, dict):
        if x.keys() == {"stream"}:
            return Stream(_untagged(x["stream"], b""), raw)
        return {Name(k): _untagged(v, b"") for k, v in x.items()}
    return [_untagged(v, b"") for v in x] if isinstance(x, list) else Real(repr(x)) if isinstance(x, float) else x


def from_json(text: str, raw: bytes | None = None):
    """The value of tagged JSON; ``raw``: the bytes, if it is a stream."""
    return _untagged(json.loads(text), raw or b"")
