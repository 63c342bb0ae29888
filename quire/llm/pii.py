"""Format-preserving pseudonyms for personal numbers and dates, in DataFrame operations only.

Every value found in a text is checked (card numbers by their check digit, dates
against the calendar, address octets and social security numbers against their
ranges). A valid value is written as a pair of numbers below two fixed bounds and
permuted by a keyed Feistel network over that pair: in turn, each of the two gets
the HMAC of the other added, modulo its bound. This is a permutation of the
valid values, so equal values get equal pseudonyms in every document, different
ones different ones, and a pseudonym is valid and formatted like its value.

* card: 13 to 19 digits in one run, or in groups of 4-4-4-4 or 4-6-5; all digits but
  the check digit are permuted, the check digit follows.
* phone: (ddd) ddd-dddd, with or without a country code, which stays; ten digits as
  ddd-ddd-dddd, with points or spaces too, after 1, +1 or nothing, with an area code from
  200; after + and another country code, which stays, 7 to 15 digits in any groups. Each of the
  three is permuted in a domain of its own.
* ssn: ddd-dd-dddd with an area, group and serial that are given out.
* ip: four octets.
* date: yyyy-mm-dd, yyyy/mm/dd, dd/mm/yyyy and dd.mm.yyyy, day and month of one digit or two,
  also right before the T of a time, in the years 1600 to 2399, permuted within the calendar's
  cycle of 400 years. What is no date as dd/mm/yyyy but is one as mm/dd/yyyy has a day
  from 13 and is permuted among those, so it can't meet the pseudonym of another date.
* email: the letters and digits of the local part, by a Feistel network over its halves;
  the domain stays.

Rows: a null text stays null with no values; an empty one stays empty; a value
that fails its check stays as it is and isn't counted; every occurrence is
replaced; matches that could overlap are taken from the left, the first kind of ``PATTERNS`` that
fits at a place; very long texts are searched whole; repeated rows (and ties) get equal results;
an empty table gives an empty one; all other columns are kept as they are.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "date", "ssn", "phone", "card")
_EDGE, _END = r"(?<![0-9A-Za-z_@])(?<![0-9][.-])", r"(?![0-9A-Za-z_@]|[.-][0-9])"
PATTERNS = {
    "email": r"(?<![0-9A-Za-z._%+@-])[0-9A-Za-z._%+-]++@[0-9A-Za-z-]++(?:\.[0-9A-Za-z-]++)*\.[A-Za-z]{2,}",
    "ip": _EDGE + r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}" + _END,
    "date": _EDGE + r"(?:[0-9]{4}(?<ymd>[/-])[0-9]{1,2}\k<ymd>[0-9]{1,2}|[0-9]{1,2}(?<dmy>[/.])[0-9]{1,2}\k<dmy>[0-9]{4})(?:(?=[Tt][0-9]{2})|" + _END + ")",
    "ssn": _EDGE + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _END,
    "phone": r"(?:(?<![0-9A-Za-z+])\+[0-9]{1,3}[ -]?)?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z]|-[0-9])"
    + r"|(?:(?<![0-9A-Za-z+])\+1[ .-]?[0-9]{3}[ .-]?[0-9]{3}[ .-]?[0-9]{4}|" + _EDGE + r"(?<!\+)(?:1[ .-])?[0-9]{3}(?<tel>[ .-])[0-9]{3}\k<tel>[0-9]{4})" + _END
    + r"|(?<![0-9A-Za-z+])\+[2-9](?:[ .-]?\(?[0-9]\)?){6,14}" + _END,
    "card": _EDGE + r"(?:[0-9]{13,19}|[0-9]{4}(?<sep>[ -])[0-9]{4}\k<sep>[0-9]{4}\k<sep>[0-9]{4}|[0-9]{4}(?<gap>[ -])[0-9]{6}\k<gap>[0-9]{5})" + _END,
}
ANY = "|".join(PATTERNS.values())
ROUNDS = 10
#: Days in 400 years, and a way to write that as a product.
CYCLE, CYCLE_A, CYCLE_B = 146_097, 189, 773
#: Those from the 13th of a month on, as a product, and the months.
LATE_A, LATE_B, MONTHS = 9, 9_833, 4_800
#: Country codes of two digits; 1 and 7 have one, all others three.
TWO_DIGITS = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _keyed(message: str) -> str:
    """SQL: HMAC-SHA512 of a text under the column ``key``, as hex."""
    return f"sha2(concat(key.outer, unhex(sha2(concat(key.inner, cast({message} as binary)), 512))), 512)"


def _feistel(tweak: str, x: str, y: str, mod_x: str, mod_y: str, out: str) -> str:
    """SQL: ``out`` of the pair ``s.x, s.y`` after the rounds."""
    def add(a: str, b: str, m: str) -> str:
        return f"pmod({a} + cast(conv(substr({_keyed(f"concat_ws('|', {_quoted(tweak)}, r, {b})")}, 1, 15), 16, 10) as bigint) % ({m}), ({m}))"

    new_x, new_y = add("s.x", "s.y", mod_x), add("s.y", "s.x", mod_y)
    return f"aggregate(sequence(1, {ROUNDS}), struct(cast({x} as bigint) as x, cast({y} as bigint) as y), (s, r) -> if(r % 2 = 1, struct({new_x} as x, s.y as y), struct(s.x as x, {new_y} as y)), s -> {out})"


def _luhn(digits: str) -> str:
    """SQL: the sum of a number's check, with its last digit counted once."""
    return f"aggregate(sequence(1, length({digits})), 0L, (a, i) -> a + if(i % 2 = 0, (2 * cast(substr({digits}, -i, 1) as int)) div 10 + (2 * cast(substr({digits}, -i, 1) as int)) % 10, cast(substr({digits}, -i, 1) as int)))"


def _fill(form: str, digits: str) -> str:
    """SQL: ``form`` with its digits replaced by those of ``digits`` in order."""
    return f"aggregate(sequence(1, length({form})), named_struct('o', '', 'k', 1), (f, i) -> if(substr({form}, i, 1) between '0' and '9', named_struct('o', concat(f.o, substr({digits}, f.k, 1)), 'k', f.k + 1), named_struct('o', concat(f.o, substr({form}, i, 1)), 'k', f.k)), f -> f.o)"


def _let(name: str, value: str, body: str) -> str:
    """SQL: ``body`` with ``name`` bound to ``value``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _valid() -> str:
    """SQL: the kind of the value ``v``, behind ``_`` its domain where that has several, null if it is not valid."""
    digits = "regexp_replace(v, '[^0-9]', '')"
    date = "coalesce(try_to_date(v, 'yyyy-M-d'), try_to_date(v, 'yyyy/M/d'), try_to_date(v, 'd/M/yyyy'), try_to_date(v, 'd.M.yyyy'))"
    return f"""case
 when instr(v, '@') > 0 then if(rlike(substring_index(v, '@', 1), '[0-9A-Za-z]'), 'email', null)
 when rlike(v, '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$') then if(forall(split(v, '[.]'), o -> cast(o as int) <= 255), 'ip', null)
 when rlike(v, '^([0-9]{{4}}[/-][0-9]{{1,2}}[/-][0-9]{{1,2}}|[0-9]{{1,2}}[/.][0-9]{{1,2}}[/.][0-9]{{4}})$') then case when year({date}) between 1600 and 2399 then 'date' when year(try_to_date(v, 'M/d/yyyy')) between 1600 and 2399 then 'date_late' end
 when rlike(v, '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$') then if(substr(v, 1, 3) between '001' and '899' and substr(v, 1, 3) <> '666' and substr(v, 5, 2) <> '00' and substr(v, 8) <> '0000', 'ssn', null)
 when rlike(v, '[(][0-9]{{3}}[)][ .-]?[0-9]{{3}}[ .-][0-9]{{4}}$') then 'phone'
 when rlike(v, '^[+]?1?[ .-]?[0-9]{{3}}[ .-]?[0-9]{{3}}[ .-]?[0-9]{{4}}$') and rlike(v, '^[+]1|^1?[ .-]?[0-9]{{3}}[ .-]') then if(substr({digits}, -10, 1) >= '2', 'phone_national', null)
 when startswith(v, '+') then if(rlike(v, '[ .-][0-9][ .-][0-9][ .-]') or length({digits}) not between 7 and 15, null, 'phone_abroad')
 when {_let("d", digits, f"({_luhn('d')}) % 10 = 0 and rlike(d, '[1-9]')")} then 'card'
end"""


def _shift(part: str, other: str) -> str:
    """SQL: letters and digits of ``part`` moved within their class by a keyed digest of ``other``."""
    step = "cast(conv(substr(z, 1 + 4 * ((i - 1) % 32), 4), 16, 10) as int)"
    moved = " ".join(f"when c between '{a}' and '{b}' then char({ord(a)} + (ascii(c) - {ord(a)} + {step}) % {n})" for a, b, n in (("a", "z", 26), ("A", "Z", 26), ("0", "9", 10)))
    one = _let("c", f"substr({part}, i, 1)", f"case {moved} else c end")
    body = f"if(length({part}) = 0, '', array_join(transform(sequence(1, length({part})), i -> {one}), ''))"
    return _let("z", _keyed(f"concat_ws('|', 'email', r, length({part}), {other})"), body)


def _pseudonym() -> str:
    """SQL: the pseudonym of the value ``v`` of the kind ``kind``."""
    body = "substr(d, 1, length(d) - 1)"
    left, right = f"length({body}) div 2", f"(length({body}) - length({body}) div 2)"
    ten = lambda n: f"cast(pow(10, {n}) as bigint)"
    permuted = _feistel("card", f"substr({body}, 1, {left})", f"substr({body}, 1 + {left})", ten(left), ten(right), f"concat(lpad(s.x, {left}, '0'), lpad(s.y, {right}, '0'))")
    digit = _luhn("concat(n, '0')")
    card = _let("d", "regexp_replace(v, '[^0-9]', '')", _let("n", permuted, _fill("v", f"concat(n, pmod(10 - ({digit}) % 10, 10))")))
    last = "substr(regexp_replace(v, '[^0-9]', ''), -10)"
    phone = _let("d", last, _let("n", _feistel("phone", "substr(d, 1, 5)", "substr(d, 6)", "100000", "100000", "concat(lpad(s.x, 5, '0'), lpad(s.y, 5, '0'))"), f"concat(substring_index(v, '(', 1), {_fill('substr(v, instr(v, \'(\'))', 'n')})"))
    national = _let("d", "regexp_replace(v, '[^0-9]', '')", _let("n", _feistel("phone national", "cast(substr(d, -10, 5) as int) - 20000", "substr(d, -5)", "80000", "100000", "concat(s.x + 20000, lpad(s.y, 5, '0'))"), _fill("v", "concat(substr(d, 1, length(d) - 10), n)")))
    code = f"case when startswith(d, '7') then 1 when substr(d, 1, 2) in ({', '.join(map(_quoted, TWO_DIGITS))}) then 2 else 3 end"
    first, second = "(length(o) div 2)", "(length(o) - length(o) div 2)"
    moved = _feistel("phone abroad", f"substr(o, 1, {first})", f"substr(o, 1 + {first})", ten(first), ten(second), f"concat(lpad(s.x, {first}, '0'), lpad(s.y, {second}, '0'))")
    abroad = _let("d", "regexp_replace(v, '[^0-9]', '')", _let("o", f"substr(d, 1 + {code})", _let("n", moved, _fill("v", "concat(substr(d, 1, length(d) - length(o)), n)"))))
    area = "cast(substr(v, 1, 3) as int)"
    ssn = _feistel("ssn", f"{area} - 1 - if({area} > 666, 1, 0)", "(cast(substr(v, 5, 2) as int) - 1) * 9999 + cast(substr(v, 8) as int) - 1", "898", "989901", "concat_ws('-', lpad(s.x + 1 + if(s.x >= 665, 1, 0), 3, '0'), lpad(s.y div 9999 + 1, 2, '0'), lpad(s.y % 9999 + 1, 4, '0'))")
    octet = lambda i: f"cast(split(v, '[.]')[{i}] as int)"
    ip = _feistel("ip", f"{octet(0)} * 256 + {octet(1)}", f"{octet(2)} * 256 + {octet(3)}", "65536", "65536", "concat_ws('.', s.x div 256, s.x % 256, s.y div 256, s.y % 256)")
    forms = {"9999-99-99": "yyyy-MM-dd", "9999-.*": "yyyy-M-d", "9999/99/99": "yyyy/MM/dd", "9999/.*": "yyyy/M/d", "99/99/9999": "dd/MM/yyyy", ".*/.*": "d/M/yyyy", "99[.]99[.]9999": "dd.MM.yyyy", ".*": "d.M.yyyy"}
    form = f"case {' '.join(f"when rlike(v, '^{x.replace('9', '[0-9]')}$') then '{y}'" for x, y in forms.items())} end"
    since = lambda form: f"datediff(to_date(v, {form}), date'2000-01-01')"
    written = lambda form, day, place: f"date_format(date_add(date'2000-01-01', cast(floor({day} / {CYCLE}) * {CYCLE} + {place} as int)), {form})"
    day = since("form")
    back = written("form", day, f"s.x * {CYCLE_B} + s.y")
    date = _let("form", form, _feistel("date", f"pmod({day}, {CYCLE}) div {CYCLE_B}", f"pmod({day}, {CYCLE}) % {CYCLE_B}", str(CYCLE_A), str(CYCLE_B), back))
    # A day from the 13th on, by how many such days of its cycle come before it; back by the last month that begins with no more.
    late_form, late_day = "if(rlike(v, '^../../....$'), 'MM/dd/yyyy', 'M/d/yyyy')", since("form")
    month = f"pmod(year(to_date(v, form)) * 12 + month(to_date(v, form)) - 24001, {MONTHS})"
    rank = f"(pmod({late_day}, {CYCLE}) - 12 * ({month} + 1))"
    begins = f"array_max(filter(sequence(cast(n * {MONTHS} div {LATE_A * LATE_B} as int) - 2, cast(n * {MONTHS} div {LATE_A * LATE_B} as int) + 2), m -> datediff(add_months(date'2000-01-01', m), date'2000-01-01') - 12 * m <= n))"
    late = _let("form", late_form, _let("n", _feistel("date late", f"{rank} div {LATE_B}", f"{rank} % {LATE_B}", str(LATE_A), str(LATE_B), f"s.x * {LATE_B} + s.y"), written("form", late_day, f"n + 12 * ({begins} + 1)")))
    local = "substring_index(v, '@', 1)"
    start = f"named_struct('a', substr({local}, 1, length({local}) div 2), 'b', substr({local}, 1 + length({local}) div 2))"
    email = f"aggregate(sequence(1, {ROUNDS}), {start}, (s, r) -> if(r % 2 = 1, named_struct('a', {_shift('s.a', 's.b')}, 'b', s.b), named_struct('a', s.a, 'b', {_shift('s.b', 's.a')})), s -> concat(s.a, s.b, substr(v, instr(v, '@'))))"
    return f"case kind when 'email' then {email} when 'ip' then {ip} when 'date' then {date} when 'date_late' then {late} when 'ssn' then {ssn} when 'phone' then {phone} when 'phone_national' then {national} when 'phone_abroad' then {abroad} when 'card' then {card} else v end"


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the text's values replaced, and a column ``pii`` with each value's ``kind`` and ``pseudonym`` in order.

    ``key`` is the secret that the permutation depends on. It goes to the executors as the
    one row of a table, so no expression, and hence no plan, holds it. A column ``pii`` of the
    input is replaced.
    """
    any_ = _quoted(ANY)
    block = hashlib.sha512(key.encode()).digest() + bytes(64)
    pads = {name: bytes(b ^ pad for b in block) for name, pad in (("inner", 0x36), ("outer", 0x5C))}  # of HMAC
    kind = pa.struct([("inner", pa.binary()), ("outer", pa.binary())])
    keys = docs.sparkSession.createDataFrame(pa.table({"key": pa.array([pads], kind)}))  # a local table, so no Python worker starts
    # All other columns go along in one, under no name that could clash.
    others = [c for c in docs.columns if c not in (text_col, "pii")]
    rest = F.struct(*(F.col(f"`{c}`") for c in others)) if others else F.lit(0)
    # Texts without a digit or an at sign hold nothing to look for.
    values = F.expr(f"if(rlike(text, '[0-9@]'), regexp_extract_all(text, {any_}, 0), cast(array() as array<string>))")
    found = docs.select(rest.alias("rest"), F.col(f"`{text_col}`").alias("text")).withColumn("found", values)
    made = F.expr(f"transform(coalesce(found, array()), v -> {_let('kind', _valid(), f"named_struct('value', v, 'kind', substring_index(kind, '_', 1), 'pseudonym', {_pseudonym()})")})")
    new = found.crossJoin(F.broadcast(keys)).select("rest", "text", made.alias("made"))  # one row
    # What lies between the values, and the values' pseudonyms, in turn.
    whole = F.expr(f"if(size(made) = 0, text, array_join(transform(split(text, {any_}), (x, i) -> concat(x, coalesce(get(made, i).pseudonym, ''))), ''))")
    pii = F.expr("transform(filter(made, m -> m.kind is not null), m -> named_struct('kind', m.kind, 'pseudonym', m.pseudonym))")
    place = {c: F.col("rest").getField(c).alias(c) for c in others} | {text_col: whole.alias(text_col)}
    return new.select(*(place[c] for c in docs.columns if c != "pii"), pii.alias("pii"))


def counted(found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts by kind, the new text and its digest."""
    counts = [F.expr(f"cast(size(filter(pii, m -> m.kind = '{kind}')) as bigint)").alias(f"n_{kind}") for kind in KINDS]
    return found.select(id_col, F.size("pii").cast("long").alias("n_values"), *counts, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("text_sha256"), text_col)
