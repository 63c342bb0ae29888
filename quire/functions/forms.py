"""Values of form fields, and how their text is laid out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.values import FIELD_FLAGS

#: Arguments of each way to fit a page into a window.
FIT = {"XYZ": ("left", "top", "zoom"), "Fit": (), "FitH": ("top",), "FitV": ("left",), "FitR": ("left", "bottom", "right", "top"), "FitB": (), "FitBH": ("top",), "FitBV": ("left",)}


def has_flag(flags: Column, name: str) -> Column:
    return F.shiftright(flags.cast("long"), FIELD_FLAGS[name] - 1).bitwiseAND(1) == 1


def field_kind(field_type: Column, flags: Column) -> Column:
    """text, checkbox, radio, button, choice or signature; null for another type."""
    return (
        F.when(field_type == "/Tx", "text")
        .when((field_type == "/Btn") & has_flag(flags, "push_button"), "button")
        .when((field_type == "/Btn") & has_flag(flags, "radio"), "radio")
        .when(field_type == "/Btn", "checkbox")
        .when(field_type == "/Ch", "choice")
        .when(field_type == "/Sig", "signature")
    )


def text_value(value: Column, flags: Column, max_length: Column) -> Column:
    """What a text field takes: no line ends unless it has several lines, no more than its length."""
    one = F.when(has_flag(flags, "multiline"), value).otherwise(F.regexp_replace(value, r"[\r\n]", ""))
    return F.when(max_length.isNotNull() & (F.length(one) > max_length), one.substr(F.lit(1), max_length)).otherwise(one)


def was_cut(value: Column, flags: Column, max_length: Column) -> Column:
    one = F.when(has_flag(flags, "multiline"), value).otherwise(F.regexp_replace(value, r"[\r\n]", ""))
    return F.coalesce(F.length(one) > max_length, F.lit(False))


def choice_value(value: Column, options: Column, flags: Column) -> Column:
    """What a choice field takes: one of its options, or anything if it can be edited; else null."""
    return F.when(has_flag(flags, "edit") | F.array_contains(options, value), value)


def checkbox_value(checked: Column, on_state: Column) -> Column:
    return F.when(checked, F.coalesce(on_state, F.lit("/Yes"))).otherwise("/Off")


def comb_positions(text: Column, width: float, cells: int) -> Column:
    """The middle of the cell of each character, for as many as there are cells."""
    cell = width / cells
    return F.transform(F.sequence(F.lit(1), F.least(F.length(text), F.lit(cells))), lambda i: (i - 0.5) * cell)


def default_appearance(da: Column) -> Column:
    """Font and size of the last Tf of a default appearance; a size of zero is 11."""
    found = F.regexp_extract_all(da, F.lit(r"(/[^ \t\r\n/]+[ \t\r\n]+[0-9.]+)[ \t\r\n]+Tf"), 1)
    last = F.get(found, F.size(found) - 1)
    size = F.regexp_extract(last, r"([0-9.]+)$", 1).try_cast("double")
    return F.struct(F.regexp_extract(last, r"^(/[^ \t\r\n/]+)", 1).alias("font"), F.when(size == 0, 11.0).otherwise(size).alias("size"))


def destination(parts: Column) -> Column:
    """A destination array of strings as page, way to fit, and its arguments by name; missing ones are null."""
    fit = F.regexp_replace(F.get(parts, F.lit(1)), "^/", "")
    number = lambda name: F.coalesce(*[F.when(fit == kind, F.get(parts, F.lit(2 + args.index(name))).try_cast("double")) for kind, args in FIT.items() if name in args])
    return F.struct(F.get(parts, F.lit(0)).alias("page"), F.when(fit.isin(*FIT), fit).alias("fit"), *(number(n).alias(n) for n in ("left", "bottom", "right", "top", "zoom")))


class Path:
    """A way through nested values: ``Path("Root")["Pages"].Kids[0]``; names get their slash."""

    def __init__(self, *steps: str | int):
        self.steps: tuple[str | int, ...] = tuple(s if isinstance(s, int) else s if s.startswith("/") else "/" + s for s in steps)

    def __getitem__(self, step: str | int) -> Path:
        return Path(*self.steps, step)

    def __getattr__(self, name: str) -> Path:
        if name.startswith("_"):
            raise AttributeError(name)
        return self[name]

    def __call__(self, *steps: str | int) -> Path:
        return Path(*self.steps, *steps)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Path) and self.steps == other.steps

    def __hash__(self) -> int:
        return hash(self.steps)

    def of(self, json: Column, kind: str = "string") -> Column:
        """The value there in tagged JSON, null where the path ends early; negative steps count from an array's end."""
        out = F.try_parse_json(json)
        for i, step in enumerate(self.steps):
            last = kind if i == len(self.steps) - 1 else "variant"
            if isinstance(step, int) and step < 0:
                items = F.try_variant_get(out, "$", "array<variant>")
                got = F.get(items, F.size(items) + step)
                out = got if last == "variant" else F.try_variant_get(got, "$", kind)
            else:
                out = F.try_variant_get(out, f"$[{step}]" if isinstance(step, int) else f"$[{step!r}]", last)
        return out
