import random

import numpy as np
import pytest
import xxhash
from quire.llm import simhash


def brute_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({i: 32 for i in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(rows):
    ids = {i for i, _ in rows}
    near = lambda a, b: (a ^ b).bit_count() <= 4
    out, left = {}, dict(rows)
    for start in sorted(ids):
        if start in out:
            continue
        todo, seen = [start], {start}
        while todo:
            a = todo.pop()
            for b in ids - seen:
                if near(left[a], left[b]):
                    seen.add(b)
                    todo.append(b)
        out |= dict.fromkeys(seen, min(seen))
    return out


@pytest.mark.parametrize("text", ["", None, "a", "One two THREE", "a b c d", "É é A b c d e f", "x\x0by\x1cz w  v u", "the the the the the the"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_hash_is_sparks(spark):
    assert spark.sql("select xxhash64('é b c d')").first()[0] % (1 << 64) == xxhash.xxh64_intdigest("é b c d".encode(), 42)


@pytest.mark.parametrize(("bits", "crowded"), [(4, 1 << 18), (12, 1 << 18), (4, 20), (12, 3)])
def test_links_lose_nothing(spark, monkeypatch, bits, crowded):
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    rng = random.Random(5)
    fps = []
    for _ in range(25):
        base = rng.getrandbits(64)
        for _ in range(12):
            x = base
            for b in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << b
            fps.append(x)
    rows = [(i, f) for i, f in enumerate(dict.fromkeys(fps))]
    node = {f - (1 << 64) if f >> 63 else f: i for i, f in rows}
    df = spark.createDataFrame([(f,) for f in node], "fp long")
    pairs = [np.array([[node[r.a], node[r.b]]]) for r in simhash.links(df, 4, bits).collect()]
    root = simhash.forest(iter(pairs), len(rows))
    assert dict(enumerate(root.tolist())) == brute_components(rows)


def test_blocks_are_split(monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 500)
    rng = random.Random(6)
    base = rng.getrandbits(64)
    fps = list(dict.fromkeys(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(40)))
    found = simhash._meetings(np.array(fps, np.uint64), np.zeros(len(fps), np.int64), np.arange(len(fps)), 0, 2)
    root = simhash.forest(found, len(fps))
    assert dict(enumerate(root.tolist())) == brute_components(list(enumerate(fps)))


def test_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()]
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect()}
    want = brute_components(rows)
    assert got == {i: (f, want[i]) for i, f in rows}


def test_rows(odd, empty):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    assert by[1] == by[2] == 1 and by[3] == by[4] == by[5] == 3 and by[6] == 6
    assert sorted((r.component_id for r in got if r.doc_id is None), key=str) == [3, None]
    assert simhash.near_duplicates(empty).count() == 0


def test_pairs_are_verified():
    fp = np.array([0, 0b1111, 0b11111], np.uint64)
    made = list(simhash.verified(iter([np.array([[0, 1], [0, 2], [1, 2]])]), fp, 4))
    assert np.concatenate(made).tolist() == [[0, 1], [1, 2]]


def test_any_ids(spark):
    """Ids from 2^62 on, negative ones, text ids."""
    big = [(2**62 + 9, "same words here"), (2**62 + 5, "same words here"), (2**63 - 1, "other"), (-(2**63), "other"), (None, "other"), (-5, None)]
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(big, "doc_id long, text string")).collect()}
    assert got == {(2**62 + 9, 2**62 + 5), (2**62 + 5, 2**62 + 5), (2**63 - 1, -(2**63)), (-(2**63), -(2**63)), (None, -(2**63)), (-5, -5)}
    named = spark.createDataFrame([(str(i), t) for i, t in big if i is not None], "doc_id string, text string")
    assert {r.component_id for r in simhash.near_duplicates(named).collect()} == {"-5", str(-(2**63)), str(2**62 + 5)}


def test_odd_radius(odd):
    with pytest.raises(ValueError):
        simhash.near_duplicates(odd, radius=3)
