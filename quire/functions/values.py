"""Typed values, flags and rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bit positions (from 1) of the standard security handler's permissions.
PERMISSION_BITS = {"print_lowres": 3, "modify_other": 4, "extract": 5, "modify_annotation": 6, "modify_form": 9, "accessibility": 10, "modify_assembly": 11, "print_highres": 12}
#: Bit positions of annotation flags and of field flags.
ANNOTATION_FLAGS = {"invisible": 1, "hidden": 2, "print": 3, "no_zoom": 4, "no_rotate": 5, "no_view": 6, "read_only": 7, "locked": 8, "toggle_no_view": 9, "locked_contents": 10}
FIELD_FLAGS = {"read_only": 1, "required": 2, "no_export": 3, "multiline": 13, "password": 14, "no_toggle_to_off": 15, "radio": 16, "push_button": 17, "combo": 18, "edit": 19, "sort": 20, "file_select": 21, "multi_select": 22, "do_not_spell_check": 23, "do_not_scroll": 24, "comb": 25, "radios_in_unison": 26, "commit_on_sel_change": 27}


def flags(value: Column, names: dict[str, int]) -> Column:
    """A struct of booleans, one for each named bit."""
    return F.struct(*((F.shiftright(value.cast("long"), bit - 1).bitwiseAND(1) == 1).alias(name) for name, bit in names.items()))


def permissions(p: Column, encrypted: Column) -> Column:
    """What a reader may do; everything where the document is not encrypted."""
    got = flags(p, PERMISSION_BITS)
    return F.struct(*((~encrypted | got[name]).alias(name) for name in PERMISSION_BITS))


def encryption_problem(r: Column, aes: Column, metadata: Column) -> Column:
    """Why the choices don't go together; null if they do."""
    return (
        F.when(~r.between(2, 6), "revision must be 2 to 6")
        .when(aes & (r < 4), "AES needs revision 4 or more")
        .when(metadata & (r < 4), "encrypted metadata needs revision 4 or more")
        .when((r == 6) & ~aes, "revision 6 needs AES")
        .when(metadata & ~aes, "encrypted metadata needs AES")
    )


def floor_div(a: Column, b: Column) -> Column:
    """Integer division towards zero."""
    return F.when(b != 0, ((a - a % b) / b).cast("long"))


def remainder(a: Column, b: Column) -> Column:
    """With the dividend's sign."""
    return F.when(b != 0, a % b)


def as_int(tag: Column, text: Column, default: Column) -> Column:
    """The integer where the value is one."""
    return F.when(tag == "integer", text.cast("long")).otherwise(default)


def as_bool(tag: Column, text: Column, default: Column) -> Column:
    return F.when(tag == "boolean", text == "true").otherwise(default)


def as_float(tag: Column, text: Column, default: Column) -> Column:
    """Of integers and reals."""
    return F.when(tag.isin("integer", "real"), text.cast("double")).otherwise(default)


def as_decimal(tag: Column, text: Column, default: Column) -> Column:
    """Of reals only."""
    return F.when(tag == "real", text.cast("decimal(38,10)")).otherwise(default)


def at_path(json: Column, path: list[str | int], kind: str = "string") -> Column:
    """The value at a path of names and indexes; null where the path ends early or the kind differs."""
    steps = "".join(f"[{p}]" if isinstance(p, int) else f"[{p!r}]" for p in path)
    return F.try_variant_get(F.try_parse_json(json), "$" + steps, kind)


def known_equal(tag_a: Column, text_a: Column, tag_b: Column, text_b: Column) -> Column:
    """Equality of direct values: booleans, integers and reals as numbers (true is 1), others by tag and text."""
    numbers = ("boolean", "integer", "real")
    number = lambda tag, text: F.when(tag == "boolean", (text == "true").cast("int").cast("decimal(38,10)")).otherwise(text.try_cast("decimal(38,10)"))
    return F.when(tag_a.isin(*numbers) & tag_b.isin(*numbers), number(tag_a, text_a) == number(tag_b, text_b)).otherwise((tag_a == tag_b) & text_a.eqNullSafe(text_b))
