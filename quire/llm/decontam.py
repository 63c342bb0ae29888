"""Benchmark decontamination by winnowing, in DataFrame operations only.

Words are the runs of a-z, 0-9 and characters from U+0080 on, after A-Z were put
in lower case. A window is ``span`` consecutive words of an item (a shorter item
is one window). Texts and items alike are winnowed: of the hashes of ``k``-grams
in every run of ``span`` words the least are kept (all of them, where several are
equal), so every shared window holds a hash kept on both sides at the same place.
The kept hashes are joined, and each joined pair is extended over the windows
around it, word by word; what is equal is a hit. Short items are their own
``k``-grams.

A bitmap of the items' hashes keeps a text's hashes that no item has from leaving
the row; it only saves work. It has ``BITS`` bits for each of the items' counted hashes, up
to ``MOST_LONGS`` longs, and is a constant of the plan, shared by all rows. The items' table is
broadcast if its counted rows are few, and else joined by a shuffle, in which the join's skew
handling splits a frequent hash.

Rows: a null text has no words, an empty one neither, so nothing hits them; rows
that repeat id and text are counted and give as many equal rows of the result; items with a
null id or without words are left out; an item that occurs repeatedly counts once, and so do
ties between items in the join; a null id is kept as such; very long texts are searched whole;
empty tables of texts or items give an empty result or no hits; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import ascii_lower, saved

#: Rows of the items' table up to which it is broadcast (each holds some 2 * span words).
BROADCAST_ROWS = 100_000
#: Bits of the bitmap for each hash, and its least and greatest number of longs.
BITS, LEAST_LONGS, MOST_LONGS = 64, 4096, 1 << 17
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _SEPARATORS), "")


def _grams(n: int, k: int) -> str:
    """Hashes of the k-grams of an array ``h`` of word hashes, if it has ``n`` words or more."""
    parts = ", ".join(f"h[i + {j}]" for j in range(k))
    return f"if(size(h) >= {n}, transform(sequence(0, size(h) - {k}), i -> xxhash64({k}, {parts})), array())"


def _kept(window: int) -> str:
    """Whether the hash at ``p`` of ``g`` is the least of a run of ``window`` hashes that covers it."""
    runs = []
    for a in range(window):
        ends = f"p - {a} >= 0 and p - {a} + {window - 1} < size(g)"
        least = f"least({', '.join(f'get(g, p - {a} + {j})' for j in range(window))})" if window > 1 else "g[p]"
        runs.append(f"({ends} and {least} = g[p])")
    return f"({' or '.join(runs)})"


def _marks(rows: DataFrame, key: list[str], n: int, k: int, bitmap: str | None = None, longs: int = 0) -> DataFrame:
    """``marks``: of each kept hash the place ``p``, the hash ``f`` and the words ``near`` it (null beyond the text); with a bitmap, of those in it."""
    back = n - k
    hashed = rows.select(*key, "w", F.expr("transform(w, x -> xxhash64(x))").alias("h"))
    grams = hashed.select(*key, "w", F.expr(_grams(n, k)).alias("g"))
    known = f"(shiftrightunsigned({bitmap}[cast(shiftrightunsigned(g[p], 6) & {longs - 1} as int)], cast(g[p] & 63 as int)) & 1) = 1 and " if bitmap else ""
    kept = f"filter(if(size(g) > 0, sequence(0, size(g) - 1), array()), p -> {known}{_kept(n - k + 1)})"
    near = f"transform(sequence(p - {back}, p + {n - 1}), i -> if(i >= 0, get(w, i), null))"
    return grams.select(*key, F.expr(f"transform({kept}, p -> struct({n} as n, p as p, g[p] as f, {near} as near))").alias("marks"))


def _bitmap(hashes: DataFrame, longs: int) -> str:
    """SQL of the array of longs in which each hash ``f`` has set its bit."""
    at = hashes.select(F.expr(f"cast(shiftrightunsigned(f, 6) & {longs - 1} as int)").alias("at"), F.expr("shiftleft(1L, cast(f & 63 as int))").alias("bit"))
    out = [0] * longs
    for r in at.groupBy("at").agg(F.bit_or("bit").alias("bits")).collect():  # MOST_LONGS rows at most
        out[r["at"]] = r["bits"]
    return f"from_json('[{','.join(map(str, out))}]', 'array<bigint>')"


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span: int = 10, k: int = 5) -> DataFrame:
    """``id_col, n_words, n_hit, items, hits`` for each row.

    ``n_hit`` counts the words inside any occurrence of a window, ``items`` are the
    ids (as strings, sorted) of items with one, ``hits`` the starts and ends of the
    windows found.
    """
    tests = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), words(F.col(item_text_col)).alias("w")).where(F.size("w") > 0)
    lengths = [r[0] for r in tests.select(F.least(F.size("w"), F.lit(span)).alias("n")).distinct().collect()]  # span values at most
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("text_hash"), words(F.col(text_col)).alias("w"))
    key = ["id", "text_hash", "n_words"]
    rows = source.select("id", "text_hash", F.size("w").alias("n_words"), "w")
    if not lengths:
        return rows.select(F.col("id").alias(id_col), F.col("n_words").cast("long"), F.lit(0).cast("long").alias("n_hit"), F.expr("array()").cast("array<string>").alias("items"), F.expr("array()").cast("array<struct<start:int,end:int>>").alias("hits"))
    sizes = {n: k if n == span else n for n in sorted(lengths)}
    theirs = None
    for n, size in sizes.items():
        fits = tests.where(F.size("w") == n) if n < span else tests.where(F.size("w") >= span)
        part = _marks(fits, ["item"], n, size).select("item", F.explode_outer("marks").alias("m")).where("m is not null").select("item", "m.*")  # explode() would push a filter with all of this inlined down to the scan
        theirs = part if theirs is None else theirs.union(part)
    theirs = saved(theirs.select("item", "n", "f", F.col("p").alias("q"), F.col("near").alias("item_near")).distinct())
    count = theirs.count()
    longs = min(MOST_LONGS, max(LEAST_LONGS, 1 << math.ceil(math.log2(max(1, count) * BITS / 64))))
    bitmap, marked = _bitmap(theirs, longs), rows
    for n, size in sizes.items():
        own = _marks(marked, [*key, *[f"m{x}" for x in sizes if x < n], *(["w"] if n < max(sizes) else [])], n, size, bitmap, longs)
        marked = own.withColumnRenamed("marks", f"m{n}")
    # One mark of each row stands for the row, under a key of its own that no item has.
    itself = "named_struct('n', 0, 'p', 0, 'f', xxhash64(id, text_hash), 'near', cast(array() as array<string>))"
    found = marked.select(*key, F.explode_outer(F.concat(F.array(F.expr(itself)), *(f"m{n}" for n in sizes))).alias("m")).select(*key, "m.*")
    pairs = found.join(F.broadcast(theirs) if count <= BROADCAST_ROWS else theirs, ["n", "f"], "left")
    size_of = "case n " + " ".join(f"when {n} then {n - size}" for n, size in sizes.items()) + " else 0 end"
    same = f"filter(sequence(0, {size_of}), s -> near[{size_of} - s] is not null and get(near, {size_of} - s + n - 1) is not null and slice(near, {size_of} - s + 1, n) = slice(item_near, {size_of} - s + 1, n))"
    spans = f"if(item is null, array(), transform({same}, s -> struct(p - s as start, p - s + n as end)))"
    each = pairs.select(*key, "n", "item", F.expr(spans).alias("spans")).select(*key, "n", F.when(F.size("spans") > 0, F.col("item")).alias("item"), F.explode_outer("spans").alias("span"))
    whole = each.groupBy(*key).agg(F.collect_set("item").alias("items"), F.collect_set("span").alias("hits"), F.count(F.when(F.col("n") == 0, 1)).cast("int").alias("copies"))
    # Starts in order; each adds what lies beyond the furthest end so far.
    covered = "aggregate(hits, struct(0L as total, 0 as upto), (a, x) -> struct(a.total + greatest(0, x.end - greatest(a.upto, x.start)) as total, greatest(a.upto, x.end) as upto), a -> a.total)"
    repeated = whole.select("id", "n_words", F.array_sort("items").alias("items"), F.array_sort("hits").alias("hits"), F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    return repeated.select(F.col("id").alias(id_col), F.col("n_words").cast("long"), F.expr(covered).alias("n_hit"), "items", "hits")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The counts and the digest of the items' ids."""
    return found.select(id_col, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: The same rows without fingerprints: every window of every item against every run of words.
ORACLE_SQL = r"""
WITH item_words AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
doc_words AS (
  SELECT doc_id, text, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS s FROM item_words WHERE len(w) > 0)),
runs AS (
  SELECT doc_id, text, s, n, array_to_string(w[s:s + n - 1], ' ') AS win
  FROM (SELECT doc_id, text, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM (SELECT DISTINCT * FROM doc_words), (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
hits AS (SELECT doc_id, text, s, runs.n AS n, item_id FROM runs JOIN windows ON runs.win = windows.win AND runs.n = windows.n),
hit_words AS (SELECT doc_id, text, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, text, unnest(generate_series(s, s + n - 1)) AS p FROM hits) GROUP BY 1, 2),
hit_items AS (SELECT doc_id, text, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, text, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1, 2)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words d
LEFT JOIN hit_words h ON d.doc_id IS NOT DISTINCT FROM h.doc_id AND d.text IS NOT DISTINCT FROM h.text
LEFT JOIN hit_items i ON d.doc_id IS NOT DISTINCT FROM i.doc_id AND d.text IS NOT DISTINCT FROM i.text
"""
