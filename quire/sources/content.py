"""Content streams: tokens, instructions, and back."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from quire.sources.values import Malformed, Name, Operator, Reader, unparse

#: Short keys and colour spaces in inline images.
SHORT_KEYS = {"/BPC": "/BitsPerComponent", "/CS": "/ColorSpace", "/D": "/Decode", "/DP": "/DecodeParms", "/F": "/Filter", "/H": "/Height", "/IM": "/ImageMask", "/I": "/Interpolate", "/W": "/Width", "/L": "/Length"}
SHORT_SPACES = {"/G": "/DeviceGray", "/RGB": "/DeviceRGB", "/CMYK": "/DeviceCMYK", "/I": "/Indexed"}
_END = re.compile(rb"[\0\t\n\x0c\r ]EI(?=[\0\t\n\x0c\r /]|\Z)")


def passes(operator: str, allowed: set[str]) -> bool:
    """q and Q let all operators through that begin like them; inline images need BI, ID and EI."""
    if not allowed or operator in allowed:
        return True
    if operator == "INLINE IMAGE":
        return {"BI", "ID", "EI"} <= allowed
    return operator[:1] in ("q", "Q") and bool({"q", "Q"} & allowed)


def instructions(data: bytes, operators: str = "") -> Iterator[tuple[list, str]]:
    """Operands and operator one after another; an inline image is one instruction, its operands its entries and its bytes.

    Operands that no operator follows are dropped; what can't be read is skipped.
    """
    allowed, r, held = set(operators.split()), Reader(data, refs=False), []
    while not r.ended():
        try:
            value = r.value()
        except Malformed:
            if r.at >= len(data) or data[r.at : r.at + 1] in (b"(", b"<"):
                return
            continue
        if not isinstance(value, Operator):
            held.append(value)
            continue
        if value == "BI":
            head: dict = {}
            while not r.ended() and not isinstance(key := r.value(), Operator):
                head[key] = r.value()
            start = r.at + 1
            m = _END.search(data, start)
            body, r.at = data[start : m.start() if m else len(data)], m.end() if m else len(data)
            if passes("INLINE IMAGE", allowed):
                yield [head, body], "INLINE IMAGE"
        elif passes(value, allowed):
            yield held, str(value)
        held = []


def unparse_instructions(rows: Iterable[tuple[list, str]]) -> bytes:
    """A line for each instruction."""
    out = []
    for operands, operator in rows:
        if operator == "INLINE IMAGE":
            head, body = operands
            out.append(b"BI\n" + b"".join(unparse(k) + b" " + unparse(v) + b"\n" for k, v in head.items()) + b"ID " + body + b"\nEI")
        else:
            out.append(b" ".join([*map(unparse, operands), operator.encode("latin-1")]))
    return b"\n".join(out)


def expanded(head: dict) -> dict:
    """An inline image's entries under their full names."""
    from quire.sources.filters import SHORT_FILTERS

    long = lambda v, names: [long(x, names) for x in v] if isinstance(v, list) else Name(names.get(v, v)) if isinstance(v, Name) else v
    out = {Name(SHORT_KEYS.get(k, k)): v for k, v in head.items()}
    if "/ColorSpace" in out:
        out[Name("/ColorSpace")] = long(out["/ColorSpace"], SHORT_SPACES)
    if "/Filter" in out:
        out[Name("/Filter")] = long(out["/Filter"], SHORT_FILTERS)
    return out


_TOKEN = re.compile(rb"(?P<space>[\0\t\n\x0c\r ]+)|(?P<comment>%[^\r\n]*)|(?P<dict_open><<)|(?P<dict_close>>>)|(?P<hex><[^>]*>)|(?P<array_open>\[)|(?P<array_close>\])|(?P<brace>[{}])|(?P<name>/[^\0\t\n\x0c\r ()<>\[\]{}/%]*)|(?P<word>[^\0\t\n\x0c\r ()<>\[\]{}/%]+)", re.S)


def tokens(data: bytes) -> Iterator[tuple[str, bytes]]:
    """Kind and bytes of each lexical token, white space and comments included; joined they are the data again."""
    at = 0
    while at < len(data):
        if data[at : at + 1] == b"(":
            r = Reader(data, at)
            try:
                r.value()
                kind = "string"
            except Malformed:
                r.at, kind = len(data), "bad"
            yield kind, data[at : r.at]
            at = r.at
            continue
        m = _TOKEN.match(data, at)
        if not m:
            yield "bad", data[at : at + 1]
            at += 1
            continue
        kind, raw = m.lastgroup, m[0]
        if kind == "word":
            kind = "integer" if re.fullmatch(rb"[+-]?\d+", raw) else "real" if re.fullmatch(rb"[+-]?(\d+\.\d*|\.\d+)", raw) else "bool" if raw in (b"true", b"false") else "null" if raw == b"null" else "word"
        yield "string" if kind == "hex" else kind, raw
        at = m.end()
        if raw == b"ID" and kind == "word" and (e := _END.search(data, at)):
            yield "inline_image", data[at : e.start()]
            at = e.start()


def filter_tokens(data: bytes, keep) -> bytes:
    """The data with each token replaced by what ``keep(kind, raw)`` returns: None, bytes or a list of bytes."""
    out = []
    for kind, raw in tokens(data):
        got = keep(kind, raw)
        out += [] if got is None else got if isinstance(got, list) else [got]
    return b"".join(out)


