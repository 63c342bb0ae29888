"""Document fingerprints from closed syncmers over code points, in DataFrame operations only.

A text is its sequence of code points, A-Z in lower case. A run of ``K`` code points is an
anchor if, of the hashes of its inner runs of ``S``, the least is the first or the last.
Whether a run is an anchor depends on nothing but the run itself, so texts that share a
passage share its anchors, whatever stands around and whether or not they have spaces. Texts
are worked on in blocks of ``BLOCK`` code points that overlap, so no array grows with the text
but that of its anchors. A text without any anchor has one: the whole of it.

An anchor is one number: the highest 31 bits of its hash, then 32 bits for its place. The
fingerprint keeps each distinct hash with its first place.
A text of more than ``ALL`` distinct anchors keeps those with a hash in the lowest half, quarter
or eighth, the last whenever there are more than four times ``ALL``, so a fingerprint grows with
its text. As text: the depth of that cut, then ``<hash>@<place>`` in the order of hashes.

The likeness of two fingerprints, both cut to the same depth, goes by matching places: an
anchor that both hold counts if another one is displaced as far (any counts where either
side has fewer than ``FEW``), and the likeness is twice that number, divided by the anchors of
both. Equal texts have likeness 1.

The edited text's anchors are those of the own text that end in its first half, those of the
next text that end in its head, and those that cross the seam, as anchors know no context.

Rows: a null text counts as an empty one; a null id comes before all others; rows
with equal ids (of any type) go in the order of their texts' hashes, ties by text (exact
repeats in any, as it makes no difference; those of one row lie in one slice); very long texts
are worked on in blocks; an empty table gives an empty one; a table of one
row has that row as its own next; other columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import ascii_lower, saved

K, S = 12, 4
BLOCK = 8192
#: Masks of an anchor's place and of a bit that no place sets, and one more than the greatest hash.
PLACE, SIDE, HASHES = (1 << 31) - 1, 1 << 31, 1 << 31
#: Distinct anchors up to which all are kept, and the deepest cut (an eighth).
ALL, DEEPEST = 64, 3
#: Marks below which a single match counts.
FEW = 16
#: Rows that a slice of the order holds on average, how many slices there are at most, sampled rows for each bound.
SLICE_ROWS, MOST_SLICES, SAMPLED = 1024, 65_536, 32


def _let(name: str, value: str, body: str) -> str:
    """SQL: ``body`` with ``name`` bound to ``value``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _block(text: str, offset: str) -> str:
    """SQL: the anchors of a short ``text`` that begins at ``offset``."""
    inner = f"transform(sequence(0, size(c) - {S}), i -> xxhash64({', '.join(f'c[i + {j}]' if j else 'c[i]' for j in range(S))}))"
    last = K - S
    edge = f"least(g[i], g[i + {last}]) <= least({', '.join(f'g[i + {j}]' for j in range(1, last))})"
    whole = f"xxhash64({', '.join(f'g[i + {j}]' if j else 'g[i]' for j in range(0, K, S))})"
    runs = f"transform(filter(sequence(0, size(g) - {last + 1}), i -> {edge}), i -> shiftleft(shiftrightunsigned({whole}, 33), 32) + {offset} + i)"
    none = "cast(array() as array<bigint>)"
    return _let("c", f"split({text}, '')", f"if(size(c) < {K}, {none}, {_let('g', inner, runs)})")


def anchors(text: str, n: str) -> str:
    """SQL: the anchors of ``text`` (in lower case) of ``n`` code points, in the order of places."""
    piece = f"substr({text}, b * {BLOCK} + 1, {BLOCK + K - 1})"
    return f"flatten(transform(sequence(0, greatest(0, {n} - {K}) div {BLOCK}), b -> {_block(piece, f'b * {BLOCK}')}))"


def _sketch(found: str, text: str) -> str:
    """SQL: depth and marks (anchors with distinct hashes, in their order) of anchors; of the whole text if there are none."""
    own = f"if(size(a) > 0, a, array(shiftleft(shiftrightunsigned(xxhash64({text}), 33), 32)))"
    count = "size(array_distinct(transform(m, x -> shiftright(x, 32))))"
    depth = f"transform(array({count}), d -> case {' '.join(f'when d > {ALL << k} then {k + 1}' for k in reversed(range(DEEPEST)))} else 0 end)[0]"
    cut = f"sort_array(filter(m, x -> shiftright(x, 32) < shiftright({HASHES}L, z)))"
    firsts = "filter(s, (x, i) -> i = 0 or shiftright(x, 32) <> shiftright(s[i - 1], 32))"
    return _let("a", found, _let("m", own, _let("z", depth, _let("s", cut, f"named_struct('depth', z, 'marks', {firsts})"))))


def with_sketch(rows: DataFrame, text_col: str, out: str) -> DataFrame:
    """``rows`` with the sketch of a text in the column ``out``."""
    lower = rows.withColumn("__low", ascii_lower(F.coalesce(F.col(text_col), F.lit("")))).withColumn("__n", F.length("__low"))
    return lower.withColumn(out, F.expr(_sketch(anchors("__low", "__n"), "__low"))).drop("__low", "__n")


def fingerprint(sketch: str) -> Column:
    """A sketch as text."""
    return F.expr(f"concat({sketch}.depth, ':', array_join(transform({sketch}.marks, x -> concat(lower(lpad(hex(shiftright(x, 32)), 8, '0')), '@', x & {PLACE})), ','))")


def likeness(a: str, b: str) -> Column:
    """The share of both sketches' marks that match at matching places."""
    cut = lambda s: f"filter({s}.marks, x -> shiftright(x, 32) < shiftright({HASHES}L, greatest({a}.depth, {b}.depth)))"
    both = f"sort_array(concat(p, transform(q, x -> x | {SIDE})))"
    moved = f"sort_array(transform(filter(sequence(1, size(z) - 1), i -> shiftright(z[i], 32) = shiftright(z[i - 1], 32)), i -> (z[i] & {PLACE}) - (z[i - 1] & {PLACE})))"
    alike = "size(filter(w, (x, i) -> x <=> get(w, i - 1) or x <=> get(w, i + 1)))"
    count = f"if(least(size(p), size(q)) < {FEW}, size(w), {alike})"
    share = f"if(size(z) < 2, 0D, {_let('w', moved, f'2D * {count} / size(z)')})"
    return F.expr(_let("p", cut(a), _let("q", cut(b), _let("z", both, share))))


def _slice_of(bounds: list[tuple]) -> str:
    """SQL: how many of the sorted ``bounds`` are not above the key, by bisection."""
    if not bounds:
        return "0"
    text = json.dumps([{"id": i, "h": h} for i, h in bounds], separators=(",", ":")).replace("\\", "\\\\").replace("'", "\\'")
    array = f"from_json('{text}', 'array<struct<id:{{kind}},h:bigint>>')"
    steps = max(1, len(bounds).bit_length())
    return f"aggregate(sequence(1, {steps}), struct(0 as lo, {len(bounds)} as hi), (z, i) -> if(z.lo >= z.hi, z, if({array}[(z.lo + z.hi) div 2] <= key, struct(cast((z.lo + z.hi) div 2 + 1 as int) as lo, z.hi as hi), struct(z.lo as lo, cast((z.lo + z.hi) div 2 as int) as hi))), z -> z.lo)"


def edited(text: str, n: str, after: str) -> Column:
    """The last half of the code points replaced by as many of the next text's first ones, or all it has."""
    return F.expr(f"concat(substr({text}, 1, {n} - {n} div 2), substr({after}, 1, {n} div 2))")


def _edited_anchors() -> str:
    """SQL: anchors of the edited text, from those of the own text, of the next one and of the seam."""
    keep, head = "(n_chars - n_chars div 2)", "least(n_chars div 2, next_chars)"
    begin = f"greatest(0, {keep} - {K - 1})"
    seam = f"substr(__edited_low, {begin} + 1, least({keep}, {K - 1}) + least({head}, {K - 1}))"
    own = f"filter(anchors, x -> (x & {PLACE}) + {K} <= {keep})"
    theirs = f"transform(filter(next_anchors, x -> (x & {PLACE}) + {K} <= {head}), x -> x + {keep})"
    return f"concat({own}, {_block(seam, begin)}, {theirs})"


def compare_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's fingerprint, its edited text's, and their likeness to its own and to the next row's.

    The order of all rows, by id and then by the text's hash, is cut into slices at the quantiles
    of a sample (``SAMPLED`` rows a bound); each slice is sorted by itself, so one shuffle moves
    each text once. To follow its last row, a slice gets a copy of the first row of the next slice.
    Rows of one id, null ids too, spread over slices by their hashes.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("h")).alias("key"), text.alias("text"))
    keys = saved(rows.select("key"))
    total = keys.count()
    n = min(MOST_SLICES, total // SLICE_ROWS)
    bounds: list[tuple] = []
    if n > 1:
        # Rows alike in id and text are alike here, so the sample goes by each row's place in its partition too.
        place = F.pmod(F.xxhash64("key", F.monotonically_increasing_id()), F.lit(1 << 30))
        sample = [tuple(r["key"]) for r in keys.where(place < (SAMPLED * n << 30) // total + 1).sort("key").limit(2 * SAMPLED * n).collect()]  # SAMPLED a slice, as expected
        step = max(1, len(sample) // n)
        bounds = sorted({key: None for key in sample[step::step]}, key=lambda k: (k[0] is not None, *([k[0]] if k[0] is not None else []), k[1]))
    part = F.expr(_slice_of(bounds).replace("{kind}", kind))
    # The first row of each slice, as an extra last row of the slice before it (of the last one before the first).
    least = saved(keys.withColumn("part", part).groupBy("part").agg(F.min("key").alias("key")))
    parts = sorted(r["part"] for r in least.select("part").collect())  # MOST_SLICES at most
    before = "from_json('{" + ",".join(f'"{p}":{parts[i - 1]}' for i, p in enumerate(parts)) + "}', 'map<string,int>')[cast(part as string)]"
    heads = rows.join(F.broadcast(least.select(F.col("key").alias("__key"), "part")), F.col("key").eqNullSafe(F.col("__key"))).groupBy("part").agg(F.min("text").alias("text"))
    extra = heads.select(F.lit(None).cast(rows.schema["key"].dataType).alias("key"), "text", F.expr(before).alias("part"))
    placed = rows.withColumn("part", part).select("key", "text", "part").union(extra).repartition("part")
    made = placed.withColumn("low", ascii_lower(F.col("text"))).withColumn("n_chars", F.length("low"))
    made = made.withColumn("anchors", F.expr(anchors("low", "n_chars"))).withColumn("sketch", F.expr(_sketch("anchors", "low")))
    order = Window.partitionBy("part").orderBy(F.asc_nulls_last("key"), "text")
    nexts = [F.lead(c).over(order).alias(f"next_{name}") for c, name in (("text", "text"), ("n_chars", "chars"), ("anchors", "anchors"), ("sketch", "sketch"))]
    ahead = made.select("key", "text", "n_chars", "anchors", "sketch", *nexts).where("key is not null")
    changed = ahead.withColumn("edited", edited("text", "n_chars", "next_text")).withColumn("__edited_low", ascii_lower(F.col("edited")))
    both = changed.withColumn("edited_sketch", F.expr(_sketch(_edited_anchors(), "__edited_low")))
    return both.select(F.col("key.id").alias(id_col), F.col("n_chars").cast("long").alias("n_chars"), "edited", "sketch", "edited_sketch", likeness("sketch", "edited_sketch").alias("near_edited"), likeness("sketch", "next_sketch").alias("near_next"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return found.select(id_col, "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"), fingerprint("sketch").alias("fingerprint"), fingerprint("edited_sketch").alias("edited_fingerprint"), "near_edited", "near_next")
