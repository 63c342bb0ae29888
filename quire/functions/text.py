"""Strings and dates of documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The code points of the bytes 18-1F and 80-9E, A0 of PDFDocEncoding; all others are those of Latin-1.
PDFDOC = dict(zip([*range(0x18, 0x20), *range(0x80, 0x9F), 0xA0], [
    0x02D8, 0x02C7, 0x02C6, 0x02D9, 0x02DD, 0x02DB, 0x02DA, 0x02DC,
    0x2022, 0x2020, 0x2021, 0x2026, 0x2014, 0x2013, 0x0192, 0x2044, 0x2039, 0x203A, 0x2212, 0x2030, 0x201E, 0x201C, 0x201D, 0x2018, 0x2019, 0x201A, 0x2122, 0xFB01, 0xFB02, 0x0141, 0x0152, 0x0160, 0x0178, 0x017D, 0x0131, 0x0142, 0x0153, 0x0161, 0x017E,
    0x20AC,
], strict=True))
_OWN = "".join(map(chr, PDFDOC.values()))
_BYTES = "".join(map(chr, PDFDOC))
#: Bytes that mean nothing: 7F, 9F, AD and the controls but tab, newline and return.
_CLASS = r"\x00-\x17\x20-\x7E\xA1-\xAC\xAE-\xFF" + _OWN


def pdfdoc_encodable(text: Column) -> Column:
    """Whether each character is one of PDFDocEncoding."""
    return ~text.rlike(f"[^{_CLASS}]")


def pdfdoc_encode(text: Column, unknown: str = "?") -> Column:
    """The bytes in PDFDocEncoding; other characters become ``unknown``."""
    return F.encode(F.translate(F.regexp_replace(text, f"[^{_CLASS}]", unknown), _OWN, _BYTES), "ISO-8859-1")


def pdfdoc_checked(text: Column) -> Column:
    """Whether all of a text is in PDFDocEncoding, and its bytes, with a question mark for what isn't."""
    return F.struct(pdfdoc_encodable(text).alias("ok"), pdfdoc_encode(text).alias("raw"))


def pdfdoc_decode(raw: Column) -> Column:
    """The text of bytes in PDFDocEncoding."""
    return F.translate(F.decode(raw, "ISO-8859-1"), _BYTES, _OWN)


def text_string(raw: Column) -> Column:
    """A text string: UTF-16 after its byte order mark, UTF-8 after its own, else PDFDocEncoding."""
    start = F.hex(F.substring(raw, 1, 3))
    return F.when(start.startswith("FEFF") | start.startswith("FFFE"), F.decode(raw, "UTF-16")).when(start == "EFBBBF", F.decode(raw.substr(F.lit(4), F.length(raw)), "UTF-8")).otherwise(pdfdoc_decode(raw))


def docinfo_bytes(text: Column) -> Column:
    """As DocumentInfo stores it: ASCII as it is, else UTF-16BE with its mark."""
    return F.when(text.rlike(r"^[\x00-\x7F]*$"), F.encode(text, "ISO-8859-1")).otherwise(F.concat(F.unhex(F.lit("FEFF")), F.encode(text, "UTF-16BE")))


def xml_clean(text: Column) -> Column:
    """Without the characters that XML 1.0 forbids."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]", "")


def authors_join(names: Column) -> Column:
    """Names by "; ", missing ones left out."""
    return F.array_join(F.filter(names, lambda x: x.isNotNull()), "; ")


def pdf_date(ts: Column, offset_minutes: Column | None = None) -> Column:
    """``D:YYYYMMDDHHmmSS``, with ``+hh'mm`` for an offset."""
    text = F.concat(F.lit("D:"), F.date_format(ts, "yyyyMMddHHmmss"))
    if offset_minutes is None:
        return text
    sign = F.when(offset_minutes < 0, "-").otherwise("+")
    size = F.abs(offset_minutes)
    return F.concat(text, sign, F.lpad(F.floor(size / 60).cast("string"), 2, "0"), F.lit("'"), F.lpad((size % 60).cast("string"), 2, "0"))


def parse_pdf_date(text: Column) -> Column:
    """The date's local time as a timestamp without zone: with or without ``D:``, seconds and offset; null if it is none."""
    digits = F.regexp_extract(text, r"^(?:D:)?([0-9]{4}(?:[0-9]{2}){0,5})(?:Z(?:00'?00'?)?|[+-][0-9]{2}'?[0-9]{2}'?)?$", 1)
    # Missing months and days are 1, missing times 0.
    full = F.concat(digits, F.lit("00000101000000").substr(F.length(digits) + 1, F.lit(14)))
    return F.when(F.length(digits) >= 4, F.try_to_timestamp(full, F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz"))


def pdf_date_offset(text: Column) -> Column:
    """The offset in minutes, 0 for Z, null if the date has none."""
    got = F.regexp_extract(text, r"([+-])([0-9]{2})'?([0-9]{2})'?$", 0)
    minutes = F.regexp_extract(got, r"([0-9]{2})'?([0-9]{2})", 1).try_cast("int") * 60 + F.regexp_extract(got, r"([0-9]{2})'?([0-9]{2})", 2).try_cast("int")
    return F.when(text.rlike(r"Z(?:00'?00'?)?$"), 0).when(got != "", F.when(got.startswith("-"), -minutes).otherwise(minutes))


def xmp_date(text: Column) -> Column:
    """An XMP date from a PDF date that may stop at the year or month; null if it is none."""
    d = F.regexp_replace(text, "^D:", "")
    whole = F.regexp_replace(d, r"^([0-9]{4})([0-9]{2})([0-9]{2})([0-9]{2})([0-9]{2})([0-9]{2}).*$", "$1-$2-$3T$4:$5:$6")
    zone = F.when(d.rlike(r"Z(?:00'?00'?)?$"), "+00:00").when(d.rlike(r"[+-][0-9]{2}'?[0-9]{2}'?$"), F.regexp_replace(d, r"^.*([+-][0-9]{2})'?([0-9]{2})'?$", "$1:$2")).otherwise("")
    return (
        F.when(d.rlike("^[0-9]{4}$"), d)
        .when(d.rlike("^[0-9]{6}$"), F.regexp_replace(d, "^(....)(..)$", "$1-$2"))
        .when(d.rlike("^[0-9]{8}$"), F.regexp_replace(d, "^(....)(..)(..)$", "$1-$2-$3"))
        .when(d.rlike(r"^[0-9]{14}(?:Z(?:00'?00'?)?|[+-][0-9]{2}'?[0-9]{2}'?)?$"), F.concat(whole, zone))
    )
