"""Page labels: a style, a prefix and a number as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The digits of each decimal place in roman numerals.
ROMAN = {
    1000: ["", "M", "MM", "MMM", "MMMM", "MMMMM"],
    100: ["", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"],
    10: ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"],
    1: ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"],
}


def roman(n: Column, small: Column | None = None) -> Column:
    """1 to 5000, in lower case where ``small``; null outside."""
    after = F.lit(0) if small is None else F.when(small, 1).otherwise(0)
    parts = []
    for place, words in ROMAN.items():
        digit = F.floor(n / place) if place == 1000 else F.floor(n % (place * 10) / place)
        parts.append(F.get(F.array(*map(F.lit, words), *(F.lit(w.lower()) for w in words)), (digit + after * len(words)).cast("int")))
    return F.when(n.between(1, 5000), F.concat(*parts))


def alpha(n: Column, small: Column | None = None) -> Column:
    """Bijective base 26 from 1 (A, ..., Z, AA, AB, ...), in lower case where ``small``; null below 1."""
    first = F.lit(65) if small is None else F.when(small, 97).otherwise(65)
    # Of k letters there are 26 + ... + 26^(k-1) shorter ones; what is left over is written in base 26.
    shorter = [sum(26**j for j in range(1, k)) for k in range(1, 8)]
    out = F.lit(None).cast("string")
    for k, less in reversed(list(enumerate(shorter, 1))):
        rest = n.cast("long") - less - 1
        letters = [F.char((F.floor(rest / 26**j) % 26 + first).cast("long")) for j in reversed(range(k))]
        out = F.when(n.cast("long") <= less + 26**k, F.concat(*letters)).otherwise(out)
    return F.when(n >= 1, out)


def label(style: Column, prefix: Column, number: Column) -> Column:
    """The text of a label. No style: the prefix alone; an unknown style: null."""
    text = (
        F.when(style.isNull(), F.lit(""))
        .when(style == "D", number.cast("string"))
        .when(style.isin("R", "r"), roman(number, style == "r"))
        .when(style.isin("A", "a"), alpha(number, style == "a"))
    )
    return F.concat(F.coalesce(prefix, F.lit("")), text)


def label_number(page_index: Column, first_index: Column, start: Column) -> Column:
    """The number of a page in the range that begins at ``first_index``; a missing start is 1."""
    return page_index - first_index + F.coalesce(start, F.lit(1))
