"""Drawing: a content stream by calls, and a one-page file of it."""

from __future__ import annotations

from quire.sources.values import Name, Stream, unparse
from quire.sources.writer import Builder, Options

#: Operators by what they do.
OPERATORS = {
    "push": "q", "pop": "Q", "cm": "cm", "begin_text": "BT", "end_text": "ET", "end_marked_content": "EMC", "begin_marked_content": "BMC", "marked_content_properties": "BDC",
    "font": "Tf", "char_spacing": "Tc", "word_spacing": "Tw", "leading": "TL", "text_matrix": "Tm", "text_rendering": "Tr", "horizontal_scaling": "Tz",
    "show_text": "Tj", "show_text_adjusted": "TJ", "show_line": "'", "show_line_spaced": '"', "move_text": "Td", "next_line": "T*", "stroke": "S", "fill": "f",
    "rectangle": "re", "stroke_color": "RG", "fill_color": "rg", "line_width": "w", "move_to": "m", "line_to": "l", "dashes": "d", "close_path": "h", "draw": "Do", "end_path": "n",
}


class Content:
    """Each method of the names in OPERATORS adds a line; the last operand first given comes first."""

    def __init__(self):
        self.lines: list[bytes] = []

    def __getattr__(self, name: str):
        if name not in OPERATORS:
            raise AttributeError(name)

        def add(*operands) -> Content:
            self.lines.append(b" ".join([*map(unparse, operands), OPERATORS[name].encode()]))
            return self

        return add

    def extend(self, other: Content) -> Content:
        self.lines += other.lines
        return self

    def build(self) -> bytes:
        return b"\n".join(self.lines)


#: Widths of the printable ASCII characters of Helvetica, from the space on, in thousandths.
HELVETICA = [
    278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278, 556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 278, 278, 584, 584, 584, 556,
    1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556,
    333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556, 556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584,
]


def helvetica_width(text: str, size: float) -> float:
    """Of one line; characters outside ASCII count like a digit."""
    return sum(HELVETICA[ord(c) - 32] if 32 <= ord(c) < 127 else 556 for c in text) * size / 1000


class Canvas:
    """A page to draw on."""

    def __init__(self, size: tuple[float, float] = (612, 792)):
        self.size, self.content, self.images = size, Content(), []

    def line(self, x1, y1, x2, y2) -> Canvas:
        self.content.move_to(x1, y1).line_to(x2, y2).stroke()
        return self

    def rect(self, x, y, w, h, fill: bool = False) -> Canvas:
        self.content.rectangle(x, y, w, h)
        (self.content.fill if fill else self.content.stroke)()
        return self

    def text(self, x, y, text: str, size: float = 12) -> Canvas:
        self.content.begin_text().font(Name("/F1"), size).move_text(x, y).show_text(text).end_text()
        return self

    def image(self, raw: bytes, width: int, height: int, bits: int, colorspace: str, x, y, w, h) -> Canvas:
        self.images.append(Stream({Name("/Type"): Name("/XObject"), Name("/Subtype"): Name("/Image"), Name("/Width"): width, Name("/Height"): height, Name("/BitsPerComponent"): bits, Name("/ColorSpace"): Name(colorspace)}, raw))
        self.content.push().cm(w, 0, 0, h, x, y).draw(Name(f"/Im{len(self.images) - 1}")).pop()
        return self

    def to_file(self, options: Options = Options()) -> bytes:
        b = Builder()
        font = b.add({Name("/Type"): Name("/Font"), Name("/Subtype"): Name("/Type1"), Name("/BaseFont"): Name("/Helvetica")})
        resources = {Name("/Font"): {Name("/F1"): font}, Name("/XObject"): {Name(f"/Im{i}"): b.add(s) for i, s in enumerate(self.images)}}
        b.page(self.content.build(), resources, (0, 0, *self.size))
        return b.bytes(options)
