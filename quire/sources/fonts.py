"""Simple fonts: codes of characters by an encoding with differences, and widths of texts."""

from __future__ import annotations

from dataclasses import dataclass, field

from quire.sources.values import Name

#: Glyph names of printable ASCII characters other than letters.
_SIGNS = dict(zip("space exclam quotedbl numbersign dollar percent ampersand quotesingle parenleft parenright asterisk plus comma hyphen period slash zero one two three four five six seven eight nine colon semicolon less equal greater question at bracketleft backslash bracketright asciicircum underscore grave braceleft bar braceright asciitilde".split(), " !\"#$%&'()*+,-./0123456789:;<=>?@[\\]^_`{|}~", strict=True))
#: Accents by the end of a glyph name, as combining characters.
_ACCENTS = {"grave": "̀", "acute": "́", "circumflex": "̂", "tilde": "̃", "dieresis": "̈", "ring": "̊", "cedilla": "̧", "caron": "̌"}
_OTHERS = {"germandbls": "ß", "AE": "Æ", "ae": "æ", "Oslash": "Ø", "oslash": "ø", "OE": "Œ", "oe": "œ", "Euro": "€", "bullet": "•", "endash": "–", "emdash": "—", "ellipsis": "…", "quoteleft": "‘", "quoteright": "’", "quotedblleft": "“", "quotedblright": "”"}


def character(glyph: str) -> str | None:
    """The character of a glyph name: letters, ASCII signs, letters with an accent, ``uniXXXX``."""
    import unicodedata

    name = glyph.removeprefix("/")
    if len(name) == 1 and name.isalpha():
        return name
    if name in _SIGNS or name in _OTHERS:
        return _SIGNS.get(name) or _OTHERS[name]
    if name[1:] in _ACCENTS:
        one = unicodedata.normalize("NFC", name[0] + _ACCENTS[name[1:]])
        return one if len(one) == 1 else None
    if name.startswith("uni") and len(name) == 7:
        try:
            return chr(int(name[3:], 16))
        except ValueError:
            return None
    return None


def differences(array: list) -> tuple[dict[int, str], list[str]]:
    """Characters by code of a /Differences array (a number sets the code, names count on), and names that are unknown."""
    out, unknown, code = {}, [], 0
    for x in array:
        if isinstance(x, int):
            code = x
        elif isinstance(x, Name):
            if (c := character(x)) is None:
                unknown.append(x)
            else:
                out[code] = c
            code += 1
    return out, unknown


@dataclass
class SimpleFont:
    """A font of one-byte codes."""

    first: int = 32
    widths: list[float] = field(default_factory=list)
    missing: float = 0.0
    base: str = "cp1252"
    changed: dict[int, str] = field(default_factory=dict)
    ascent: float = 750.0
    descent: float = -250.0
    scale: float = 1000.0

    def encode(self, text: str) -> bytes:
        """Codes; characters that the font lacks become a question mark."""
        own = {c: code for code, c in self.changed.items()}
        return b"".join(bytes([own[c]]) if c in own else c.encode(self.base, "replace") for c in text)

    def width(self, text: str, size: float) -> float:
        """Of the widest line."""

        def one(line: bytes) -> float:
            return sum(self.widths[c - self.first] if 0 <= c - self.first < len(self.widths) else self.missing for c in line)

        return max((one(x) for x in self.encode(text).split(b"\n")), default=0) * size / self.scale

    def leading(self, size: float) -> float:
        return (self.ascent - self.descent) * size / self.scale


def lines_of(text: str, limit: float, width) -> list[str]:
    """Words put together greedily while ``width`` of the line stays within the limit; line ends stay."""
    out: list[str] = []
    for part in text.split("\n"):
        line = ""
        for word in part.split(" "):
            longer = f"{line} {word}" if line else word
            if line and width(longer) > limit:
                out.append(line)
                line = word
            else:
                line = longer
        out.append(line)
    return out
