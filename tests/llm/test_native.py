import hashlib
import hmac
import random
import re
from collections import Counter
from datetime import datetime

import pytest
import xxhash
from pyspark.sql import functions as F
from quire.llm import chat, decontam, pii, syncmers

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute_hits(docs, items, span=10):
    wins = {}
    for item, text in items:
        w = WORD.findall(low(text))
        if item is not None and w:
            n = min(len(w), span)
            for s in range(len(w) - n + 1):
                wins.setdefault(tuple(w[s : s + n]), set()).add(str(item))
    out = Counter()
    for doc, text in docs:
        w, hit, found = WORD.findall(low(text)), set(), set()
        for n in {len(k) for k in wins}:
            for s in range(len(w) - n + 1):
                if (ids := wins.get(tuple(w[s : s + n]))) is not None:
                    hit |= set(range(s, s + n))
                    found |= ids
        out[doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)] += 1
    return out


@pytest.mark.parametrize("broadcast", [0, 100_000])
@pytest.mark.parametrize("short", [False, True])
def test_decontamination(spark, monkeypatch, broadcast, short):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", broadcast)
    rng = random.Random(3)
    word = lambda: rng.choice(["a", "b", "É", "x1", "the"])
    items = [(i, " ".join(word() for _ in range(rng.randint(10, 30)))) for i in range(20)] + [(None, "a a a a a a a a a a"), (50, ""), (51, None), (9, "the " * 14)]
    if short:
        items += [(60, "a, The x1"), (61, "É-b"), (62, "a, The x1")]
    docs = []
    for i in range(40):
        text = [word() for _ in range(rng.randint(0, 40))]
        if i % 3:
            w = items[rng.randrange(20)][1].split()
            s = rng.randrange(len(w) - 9)
            text[5:5] = w[s : s + rng.choice([8, 9, 10, 13])]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(text).upper() if i % 4 else " ".join(text)))
    docs += [(100, None), (101, ""), (None, "the " * 20), (102, "the " * 5000), *[(3, docs[3][1])] * 3, (None, "the " * 20), (101, "")]
    found = decontam.digest(decontam.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    assert Counter(map(tuple, found.collect())) == brute_hits(docs, items)


def test_decontamination_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog while nine others", 3)], "item_id long, text string, n int")
    assert decontam.decontaminate(empty, items).count() == 0
    assert decontam.decontaminate(odd, items).count() == decontam.decontaminate(odd, items.limit(0)).count() == odd.count()
    got = {r.doc_id: r.n_hit for r in decontam.decontaminate(odd, items).collect()}
    assert got[1] == got[2] == 11 and got[6] == 0
    assert {r.n_hit for r in decontam.decontaminate(odd, items.limit(0)).collect()} == {0}


def test_winnowing_keeps_shared_spans(spark):
    rows = spark.createDataFrame([(1, [f"w{random.Random(i).randrange(9)}" for i in range(200)])], "id long, w array<string>")
    kept = {m.p for m in decontam._marks(rows, ["id"], 10, 5).first().marks}
    assert all(kept & set(range(s, s + 6)) for s in range(200 - 9)) and len(kept) < 150


KEY = "k"


def brute_feistel(tweak, x, y, mx, my):
    for r in range(1, pii.ROUNDS + 1):
        add = lambda other, tweak=tweak, r=r: int(hmac.new(hashlib.sha512(KEY.encode()).digest(), f"{tweak}|{r}|{other}".encode(), "sha512").hexdigest()[:15], 16)
        if r % 2:
            x = (x + add(y) % mx) % mx
        else:
            y = (y + add(x) % my) % my
    return x, y


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def values(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in pii.pseudonymise(df, KEY).collect()}


def test_pseudonyms_by_brute_force(spark):
    got = values(spark, ["4785380592391139", "70.123.182.155", "+1 (743) 555-3824", "123-45-6789", "2024-02-29"])
    x, y = brute_feistel("card", 4785380, 59239113, 10**7, 10**8)
    body = f"{x:07d}{y:08d}"
    assert got[0].text == next(body + c for c in "0123456789" if luhn(body + c))
    x, y = brute_feistel("ip", 70 * 256 + 123, 182 * 256 + 155, 65536, 65536)
    assert got[1].text == f"{x >> 8}.{x & 255}.{y >> 8}.{y & 255}"
    x, y = brute_feistel("phone", 74355, 53824, 10**5, 10**5)
    d = f"{x:05d}{y:05d}"
    assert got[2].text == f"+1 ({d[:3]}) {d[3:6]}-{d[6:]}"
    x, y = brute_feistel("ssn", 122, 44 * 9999 + 6788, 898, 989901)
    assert got[3].text == f"{x + 1 + (x >= 665):03d}-{y // 9999 + 1:02d}-{y % 9999 + 1:04d}"
    from datetime import date, timedelta

    o = (date(2024, 2, 29) - date(2000, 1, 1)).days
    x, y = brute_feistel("date", o // 773, o % 773, 189, 773)
    assert got[4].text == str(date(2000, 1, 1) + timedelta(x * 773 + y))


def test_pseudonyms_keep_the_format(spark):
    given = ["4785-3805-9239-1139", "4785 3805 9239 1139", "378282246310005", "31/12/1999", "01.02.1700", "(743) 555-3824", "ahrk.19@mail1.example.com", "A@b.org"]
    made = [r.text for r in values(spark, given).values()]
    shape = lambda t: re.sub("[a-z]", "a", re.sub("[0-9]", "9", re.sub("[A-Z]", "A", t)))
    assert [shape(x) for x in made] == [shape(x) for x in given]
    assert all(a != b for a, b in zip(given, made, strict=True))
    assert all(luhn(re.sub("[^0-9]", "", x)) for x in made[:3]) and made[6].endswith("@mail1.example.com")


def test_phones_and_dates_in_other_forms(spark):
    phones = ["555-123-4567", "555.123.4567", "555 123 4567", "1-555-123-4567", "+1 555 123 4567", "+15551234567", "(555) 123 4567", "+44 20 7946 0958", "+33 1 23 45 67 89", "+442079460958", "+49 (0)30 1234567"]
    dates = ["12/31/1999", "3/31/2020", "3/4/2020", "2020/04/03", "2020/4/3", "2020-4-3", "3.4.2020"]
    times = ["2024-01-02T10:00:00", "2024-01-02T10:00:00.123Z"]
    given = [*phones, *dates, *times, "123-456-7890", "+1 123 456 7890", "12/32/1999", "13/31/1999", "2/30/2020", "2024-01-02Term", "+5 6 7 8 9 10 11"]
    got = values(spark, given)
    n = len(phones + dates + times)
    assert [[p.kind for p in got[i].pii] for i in range(len(given))] == [["phone"]] * len(phones) + [["date"]] * (n - len(phones)) + [[]] * (len(given) - n)
    shape = lambda t: re.sub("[0-9]", "9", t)
    assert all(got[i].text != given[i] for i in range(n)) and all(got[i].text == given[i] for i in range(n, len(given)))
    assert all(shape(got[i].text) == shape(given[i]) for i in range(len(phones)))
    assert [got[i].text[:3] for i in (7, 8, 9)] == ["+44", "+33", "+44"]
    # One number in any separated form, one date in any form.
    assert len({re.sub("[^0-9]", "", got[i].text)[-10:] for i in range(6)}) == 1 and re.sub("[^0-9]", "", got[7].text) == got[9].text[1:]
    assert len({tuple(sorted(map(int, re.split("[/.-]", got[len(phones) + i].text)))) for i in (2, 3, 4, 5, 6)}) == 1
    assert [got[n - 2 + i].text[10:] for i in (0, 1)] == ["T10:00:00", "T10:00:00.123Z"]
    again = values(spark, [got[i].text for i in range(n)])
    assert all(again[i].pii for i in range(n))


def test_late_days_and_phones_are_permuted(spark):
    days = spark.range(146_097).selectExpr("date_format(date_add(date'1600-01-01', cast(id as int)), 'MM/dd/yyyy') AS text").where("substr(text, 4, 2) > '12'")
    got = [r.text for r in pii.pseudonymise(days, KEY).collect()]
    assert len(got) == len(set(got)) == pii.LATE_A * pii.LATE_B
    assert all(datetime.strptime(t, "%m/%d/%Y") and t[3:5] > "12" and "1600" <= t[6:] <= "1999" for t in got)
    calls = spark.range(3000).selectExpr("concat('212-555-', lpad(id, 4, '0')) AS text")
    got = {r.text for r in pii.pseudonymise(calls, KEY).collect()}
    assert len(got) == 3000 and all(re.fullmatch("[2-9][0-9]{2}-[0-9]{3}-[0-9]{4}", t) for t in got)


def test_what_is_not_valid_stays(spark):
    given = ["4785380592391138", "70.123.182.256", "2023-02-29", "000-12-3456", "1.2.3", "version 4.785.380.592.391", "0000000000000000", "x4785380592391139", "", None, "12345678901234567890"]
    got = values(spark, given)
    assert [got[i].text for i in range(len(given))] == given and not any(got[i].pii for i in range(len(given)))


def test_values_beside_junk(spark):
    card, mail = "4785380592391139", "ahrk.19@mail1.example.com"
    given = [f"end.{card}$$$ x", f"a-{card}-b", f"###{mail}%%%", "%" * 90 + mail, f"<{mail}>", "v1.70.123.182.155", "is 70.123.182.155.", "COST&&&+1 (743) 555-3824###"]
    got = values(spark, given)
    assert [bool(got[i].pii) for i in range(len(given))] == [True, True, True, True, True, False, True, True]
    assert all(card not in got[i].text and mail not in got[i].text for i in range(len(given)))


def test_values_within_texts(spark):
    card = "4785380592391139"
    got = values(spark, [f"{card}, {card}\n{card}.", f"Card {card} and 4111111111111111 and 12.", "mail x.y@mail.example.com, or 1.2.3.4!"])
    one = values(spark, [card])[0].text
    assert got[0].text == f"{one}, {one}\n{one}." and got[1].text.startswith(f"Card {one} and ") and got[1].text.endswith(" and 12.")
    assert [p.kind for p in got[2].pii] == ["email", "ip"] and got[2].text.endswith("!") and "@mail.example.com, or " in got[2].text


def test_no_plan_holds_the_key(spark, capsys):
    secret = "f3a9-not-in-any-plan"
    made = pii.pseudonymise(spark.createDataFrame([(1, "on 2020-01-02")], "doc_id long, text string"), secret)
    made.explain("extended")
    shown = capsys.readouterr().out + made._jdf.queryExecution().toString()
    inner = bytes(b ^ 0x36 for b in hashlib.sha512(secret.encode()).digest())
    assert secret not in shown and inner.hex() not in shown.lower().replace(" ", "") and "2020-01-02" not in made.first().text


def test_the_key_comes_from_the_session(spark):
    from quire.llm import queries

    own = queries.pii_key(spark)
    assert own == queries.pii_key(spark) and len(own) == 64
    spark.conf.set(queries.PII_SETTING, "mine")
    assert queries.pii_key(spark) == "mine"
    spark.conf.unset(queries.PII_SETTING)


def test_pseudonyms_are_a_permutation(spark):
    ids = spark.range(3000).select("id", F.expr("concat(lpad(id + 1, 3, '0'), '.', '0.0.1')").alias("x"), F.expr("date_format(date_add(date'2000-01-01', cast(id as int)), 'yyyy-MM-dd')").alias("text"))
    assert pii.pseudonymise(ids, KEY).select("text").distinct().count() == 3000


def test_pii_rows(odd, empty):
    got = pii.pseudonymise(odd, KEY)
    assert got.columns == [*[c for c in odd.columns if c != "pii"], "pii"] and got.count() == odd.count()
    assert sorted(map(str, got.select("text", "doc_id").collect())) == sorted(map(str, odd.select("text", "doc_id").collect()))
    assert pii.counted(pii.pseudonymise(empty, KEY)).count() == 0


def xx(data, seed=42):
    """Spark's hash of a string, or of a long on top of another hash."""
    data = data.encode() if isinstance(data, str) else data.to_bytes(8, "little")
    return xxhash.xxh64_intdigest(data, seed % 2**64)


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def brute_anchors(text):
    """Place and hash of every run of 12 code points whose least inner run of 4 is the first or the last."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    out = []
    inner = []
    for i in range(len(low) - 3):
        h = 42
        for c in low[i : i + 4]:
            h = xx(c, h)
        inner.append(signed(h))
    for i in range(len(low) - 11):
        if min(inner[i : i + 9]) in (inner[i], inner[i + 8]):
            h = 42
            for j in (0, 4, 8):
                h = xx(inner[i + j] % 2**64, h)
            out.append((i, h))
    return out or [(0, xx(low))]


def brute_marks(text):
    first = {}
    for at, h in brute_anchors(text):
        first.setdefault(h >> 33, at)
    depth = sum(len(first) > 64 << k for k in range(3))
    return depth, {v: at for v, at in sorted(first.items()) if v < 2**31 >> depth}


def brute_fingerprint(text):
    depth, marks = brute_marks(text)
    return f"{depth}:" + ",".join(f"{v:08x}@{at}" for v, at in marks.items())


def brute_likeness(one, two):
    (d1, a), (d2, b) = brute_marks(one), brute_marks(two)
    a, b = ({v: at for v, at in m.items() if v < 2**31 >> max(d1, d2)} for m in (a, b))
    if not len(a) + len(b) > 1:
        return 0.0
    moved = Counter(b[v] - at for v, at in a.items() if v in b)
    few = min(len(a), len(b)) < 16
    return 2 * sum(n for n in moved.values() if few or n > 1) / (len(a) + len(b))


def brute_next(docs):
    rows = sorted(((d, t or "") for d, t in docs), key=lambda r: (r[0] is not None, r[0] or 0, signed(xx(r[1])), r[1]))
    out = []
    for i, (d, t) in enumerate(rows):
        after, half = rows[(i + 1) % len(rows)][1], len(t) // 2
        made = t[: len(t) - half] + after[:half]
        out.append((d, len(t), hashlib.sha256(made.encode()).hexdigest(), brute_fingerprint(t), brute_fingerprint(made), round(brute_likeness(t, made), 9), round(brute_likeness(t, after), 9)))
    return Counter(out)


@pytest.mark.parametrize("rows", [4, 1024])
def test_syncmers_by_brute_force(spark, small, odd, monkeypatch, rows):
    monkeypatch.setattr(syncmers, "SLICE_ROWS", rows)
    for docs in (spark.read.parquet(f"{small}/documents.parquet"), odd, odd.withColumn("doc_id", F.lit(None).cast("long")), odd.withColumn("doc_id", F.lit(7).cast("long"))):
        got = syncmers.digest(syncmers.compare_next(docs)).collect()
        assert Counter((*r[:5], round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == brute_next([(r.doc_id, r.text) for r in docs.collect()])
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_blocks_make_no_difference(spark, monkeypatch):
    rng = random.Random(3)
    text = "".join(rng.choice("abcdé 漢") for _ in range(3000))
    docs = spark.createDataFrame([(1, text), (2, text[:1500])], "doc_id long, text string")
    want = sorted(map(tuple, syncmers.digest(syncmers.compare_next(docs)).collect()))
    monkeypatch.setattr(syncmers, "BLOCK", 37)
    assert sorted(map(tuple, syncmers.digest(syncmers.compare_next(docs)).collect())) == want


def test_syncmers_of_text_ids(spark):
    docs = spark.createDataFrame([("b", "some text of a few words"), ("a", "another text"), (None, "third")], "doc_id string, text string")
    got = syncmers.compare_next(docs).collect()
    assert {r.doc_id: r.edited for r in got} == {None: "thian", "a": "anothesome t", "b": "some text ofthird"}


def test_syncmer_likeness(spark, small, empty):
    """Close to the share of common anchors where half of a text is its own; texts without spaces too."""
    rng = random.Random(4)
    kana = [chr(0x3042 + rng.randrange(80)) for _ in range(80)]
    docs = [(1, "".join(kana[:40])), (2, "".join(kana[40:])), (3, "a b"), (4, "a b")]
    got = {r.doc_id: r for r in syncmers.digest(syncmers.compare_next(spark.createDataFrame(docs, "doc_id long, text string"))).collect()}
    assert got[1].near_edited > 0.2 and got[2].near_edited > 0.2 and got[1].near_next == 0
    assert got[3].fingerprint == got[4].fingerprint and got[3].near_next == 1
    assert syncmers.compare_next(empty).count() == 0
    off = []
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect() if r.text]
    for one, two in zip(texts, texts[1:], strict=False):
        made = one[: len(one) - len(one) // 2] + two[: len(one) // 2]
        a, b = ({h for _, h in brute_anchors(t)} for t in (one, made))
        off.append(abs(brute_likeness(one, made) - 2 * len(a & b) / (len(a) + len(b))))
    assert sum(off) / len(off) < 0.05


TOOLS = {"add": chat.Tool({"a": "integer", "b": "number"}, ["a"]), "say": chat.Tool({"text": "string"}, [], True)}


def test_chat_linking(spark):
    calls = [
        (1, 0, 0, "c1", "add", '{"b": 2.50, "a": 1}'),
        (1, 2, 0, "c2", "add", '{"a": "x", "z": 1}'),
        (1, 4, 0, "c3", "say", '{"text": {"$result": "c1"}, "more": {"$result": "c2"}}'),
        (1, 6, 0, "c4", "say", '{"text": {"$result": "c3"}}'),
        (1, 8, 0, "c5", "nope", "{}"),
        (1, 8, 1, "c5", "say", "[1]"),
        (2, 0, 0, "x", "say", '{"r": {"$result": "y"}}'),
        (2, 1, 0, "y", "say", '{"r": {"$result": "x"}}'),
        (2, 2, 0, "z", "say", '{"r": {"$result": "y"}}'),
        (None, 0, 0, "c1", "say", None),
        (3, 0, 0, None, "say", "not json"),
    ]
    results = [(1, 1, 0, "c1", "3.5"), (1, 3, 0, "c2", 'a "quoted" é\n'), (1, 5, 0, "c3", None), (1, 9, 0, "gone", "x"), (2, 5, 0, "x", "x")]
    got = chat.link(spark.createDataFrame(calls, "conv_id long, turn long, place long, call_id string, tool string, arguments string"), spark.createDataFrame(results, "conv_id long, turn long, place long, call_id string, content string"), None, TOOLS)
    by = {(r.conv_id, r.kind, r.call_id, r.place): r for r in got.collect()}
    assert len(by) == len(calls) + len(results)
    at = lambda *k: (by[k].level, by[k].status, by[k].problems)
    assert at(1, "call", "c1", 0) == (0, "linked", []) and at(1, "result", "c1", 0) == (1, "linked", [])
    assert at(1, "call", "c2", 0) == (0, "linked", ["type:a", "unknown:z"])
    assert at(1, "call", "c3", 0) == (2, "linked", ["type:text"]) and at(1, "result", "c3", 0)[0] == 3
    assert at(1, "call", "c4", 0) == (4, "no result", ["type:text"])
    assert at(1, "call", "c5", 0) == (0, "repeated id", ["tool:unknown"]) or at(1, "call", "c5", 0)[2] == ["tool:unknown"]
    assert by[1, "call", "c5", 1].problems == ["arguments:no object"]
    assert at(1, "result", "gone", 0)[1] == "no call"
    assert at(2, "call", "x", 0)[:2] == (None, "circular") and at(2, "call", "z", 0)[0] is None
    assert by[None, "call", "c1", 0].status == "no id" and by[3, "call", None, 0].status == "no id"
    assert by[1, "call", "c1", 0].json == '{"arguments":{"a":1,"b":2.5},"id":"c1","name":"add","type":"call"}'
    assert by[1, "result", "c2", 0].json == '{"content":"a \\"quoted\\" é\\n","tool_call_id":"c2","type":"result"}'


def test_chat_from_turns(spark):
    turns = [
        (1, 0, "user", "hello", 9),
        (1, 1, "assistant", '{"tool_calls": [{"id": "a", "name": "add", "arguments": {"a": 1}}, {"id": "b", "name": "add", "arguments": {}}]}', 9),
        (1, 2, "tool", '{"tool_call_id": "a", "content": "1"}', 9),
        (None, None, None, None, None),
    ]
    talk = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, call_id int")
    got = {(r.kind, r.call_id): (r.status, r.problems) for r in chat.link(*chat.parsed(talk), TOOLS).collect()}
    assert got == {("call", "a"): ("linked", []), ("call", "b"): ("no result", ["missing:a"]), ("result", "a"): ("linked", []), ("message", None): ("message", [])}
    assert chat.link(*chat.parsed(talk), TOOLS).count() == 5  # two calls in one turn
    assert chat.link(*chat.parsed(talk.limit(0)), TOOLS).count() == 0 and chat.link(*chat.exchanges(talk.limit(0)), chat.REPLY).count() == 0
    clash = talk.selectExpr("*", "1 as level", "2 as n_calls", "3 as depth", "4 as status", "5 as named", "6 as kind", "7 as m", "8 as json", "9 as place")
    for rows in (talk, clash):
        kinds = sorted(r.kind for r in chat.link(*chat.exchanges(rows), chat.REPLY).collect())
        assert kinds == ["call", "message", "message", "result"]  # every turn, and the tool's and the null one as messages


def brute_depth(edges):
    """Longest way before each node, None on or behind a circle, by walking every way."""
    before = {}
    for a, b in edges:
        before.setdefault(a, set()).add(b)

    def depth(x, way):
        if x in way:
            return None
        found = [depth(y, way | {x}) for y in before.get(x, ())]
        return None if None in found else 1 + max(found) if found else 0

    return {a: depth(a, frozenset()) for a in before}


def test_levels_by_brute_force(spark):
    """Random graphs, sparse ones with long chains and denser ones, with circles."""
    rng = random.Random(8)
    calls, want = [], {}
    for conv in range(40):
        n = rng.choice([3, 6, 12, 20])
        refs = {i: rng.sample(range(i), min(i, rng.choice([0, 1, 1, 1, 2, 3]))) for i in range(n)}
        if conv % 3 == 0:
            refs[0] = [rng.randrange(n)]
        calls += [(conv, i, 0, f"c{i}", "say", '{"r": [' + ", ".join(f'{{"$result": "c{j}"}}' for j in refs[i]) + "]}") for i in range(n)]
        depth = brute_depth([(i, j) for i in refs for j in refs[i]])
        want |= {(conv, f"c{i}"): 2 * depth[i] if i in depth and depth[i] is not None else None if i in depth else 0 for i in range(n)}
    df = spark.createDataFrame(calls, "conv_id long, turn long, place long, call_id string, tool string, arguments string")
    none = spark.createDataFrame([], "conv_id long, turn long, place long, call_id string, content string")
    got = {(r.conv_id, r.call_id): r.level for r in chat.link(df, none, None, TOOLS).collect()}
    assert got == want


def test_a_chain_of_a_thousand_calls(spark):
    calls = spark.range(1000).selectExpr("1L as conv_id", "id as turn", "0 as place", "concat('c', id) as call_id", "'say' as tool", """concat('{"deep": [{"x": {"$result": "c', id - 1, '"}}]}') as arguments""")
    none = spark.createDataFrame([], "conv_id long, turn long, place long, call_id string, content string")
    got = chat.link(calls, none, None, TOOLS).select("turn", "level").collect()
    assert all(r.level == 2 * r.turn for r in got) and len(got) == 1000


def test_canonical_json(spark):
    texts = ['{"b": 1e2, "a": [1.0, -0, 0.50, 1E-7, 123456789012345678901234567890, 12.5e1], "c": "1.0 \\"2e5\\" x"}', "1.50", "not json", None, '{"a":1,"a":2', '"\\u0041é"', "[]", "true"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, j string")
    got = [r.c for r in rows.select("i", chat.canonical("j").alias("c")).orderBy("i").collect()]
    assert got == ['{"a":[1,0,0.5,0.0000001,123456789012345678901234567890,125],"b":100,"c":"1.0 \\"2e5\\" x"}', "1.5", None, None, None, '"Aé"', "[]", "true"]


def test_references_with_escapes_and_long_texts(spark):
    long = "x" * 3_000_000
    calls = [(1, 0, 0, 'a"b', "say", "{}"), (1, 1, 0, "c", "say", '{"r": {"\\u0024result": "a\\"b"}}'), (1, 2, 0, "d", "say", '{"text": "{\\"$result\\":\\"c\\"}", "r": {"$result": "c", "more": 1}}'), (1, 3, 0, "e", "say", '{"text": "' + long + '"}')]
    df = spark.createDataFrame(calls, "conv_id long, turn long, place long, call_id string, tool string, arguments string")
    none = spark.createDataFrame([(1, 4, 0, "e", long)], "conv_id long, turn long, place long, call_id string, content string")
    got = {(r.kind, r.call_id): (r.level, len(r.json)) for r in chat.link(df, none, None, TOOLS).collect()}
    assert [got["call", k][0] for k in ('a"b', "c", "d", "e")] == [0, 2, 0, 0] and got["result", "e"][1] > 3_000_000


def test_unpadded_days_before_a_padded_month(spark):
    rows = [(i, f"on {d} again") for i, d in enumerate(("2/11/2018", "12/1/2018", "2.11.2018", "2018/1/12", "2018-1-12", "11/2/2018", "2/13/2018"))]
    got = pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), KEY).collect()
    assert all(len(r.pii) == 1 and r.pii[0].kind == "date" for r in got)
