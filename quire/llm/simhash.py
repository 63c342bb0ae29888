"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most ``radius`` bits share a variant that is
at most half the radius away from each. Every distinct fingerprint therefore
stands for all its variants within half the radius; fingerprints that meet
on a variant are paired, and each pair's bits are compared before it links.

The variants are not sent one by one. What is shuffled is the leading bits of
the variants: a fingerprint goes to each prefix that its variants have (79 of
2,081 variants for 12 bits and 2 flips), and a task makes the variants of one
prefix, in blocks of a fixed size, and sorts them. A prefix that more than ``CROWDED``
come to is split by four more bits, until none is. Within a prefix the links are
cut down to a spanning forest before they leave the task, so that a group of
near copies gives no more links than rows came in.

The nodes that are linked are the distinct fingerprints; ids only come in at the end,
as the smallest of each component, so they may be of any type that has an order.

Rows: a null or empty text has no words and fingerprint zero, linked like any
other; repeated texts share a fingerprint and hence a component; a row with a
null id takes part in linking, is never a representative while its component
has any id, and gets a null component if it has none; ties are equal ids and give
equal rows; very long texts are hashed whole, shingle by shingle; an empty table
gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.bpe import small_batches
from quire.llm.common import modest_batches, saved
from quire.llm.components import components

#: Variants that a task holds at a time.
BLOCK = 1 << 20
#: Fingerprints that may come to one prefix, and the bits by which a fuller one is split.
CROWDED, DEEPER = 1 << 18, 4
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_OFFSETS = np.arange(8, dtype=np.int64) * 256


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """64 bits; bit i is set if it is set in more than half of the XXH64 of the shingles of ``width`` words."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z only, and splits at 09-0D and 20
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - width + 1)
    line = b" ".join(words)
    if n == 1:
        return digest(line, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: n - 1].tolist()]
    hashes = np.array([digest(line[a : b - 1], seed) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], np.uint64)
    counts = np.bincount((hashes.view(np.uint8).reshape(n, 8) + _OFFSETS).ravel(), minlength=2048).reshape(8, 256)
    over = (counts @ _BITS).ravel() * 2 > n
    return int(np.packbits(over, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """``id_col, fp`` (a signed long with the fingerprint's bits) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            fps = np.array([fingerprint(x, width) for x in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], [id_col, "fp"])

    return modest_batches(docs).select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, fp bigint")


def flips(bits: int, most: int) -> list[tuple[int, int]]:
    """All masks over ``bits`` bits with at most ``most`` ones, and their number of ones."""
    out = [(0, 0)]
    for i in range(bits):
        out += [(m | 1 << i, k + 1) for m, k in out if k < most]
    return out


def _meetings(center: np.ndarray, used: np.ndarray, node: np.ndarray, bit: int, half: int) -> Iterator[np.ndarray]:
    """Pairs of nodes that share a variant; ``center`` is right in its first ``bit`` bits and has ``used`` flips there."""
    if len(center) < 2:
        return
    rest = 64 - bit
    per = [sum(math.comb(rest, k) for k in range(half - u + 1)) for u in range(half + 1)]
    if sum(per[u] * int(n) for u, n in enumerate(np.bincount(used, minlength=half + 1))) > BLOCK and rest:
        step = min(4, rest)
        made = [[], [], []]
        for mask, k in flips(step, half):
            fits = used + k <= half
            made[0].append(center[fits] ^ np.uint64(mask << (rest - step)))
            made[1].append(used[fits] + k)
            made[2].append(node[fits])
        center, used, node = map(np.concatenate, made)
        part = (center >> np.uint64(rest - step)) & np.uint64((1 << step) - 1)
        for p in range(1 << step):
            here = part == p
            yield from _meetings(center[here], used[here], node[here], bit + step, half)
        return
    variants, owners = [], []
    for u in range(half + 1):
        if (here := used == u).any():
            masks = np.array([m for m, _ in flips(rest, half - u)], np.uint64)
            variants.append((center[here][:, None] ^ masks).ravel())
            owners.append(np.repeat(node[here], len(masks)))
    v, own = np.concatenate(variants), np.concatenate(owners)
    order = np.argsort(v)
    v, own = v[order], own[order]
    same = np.flatnonzero(v[1:] == v[:-1])
    if len(same):
        pairs = np.stack([own[same], own[same + 1]], 1)
        pairs.sort(axis=1)
        yield np.unique(pairs, axis=0)


def forest(pairs: Iterator[np.ndarray], n: int) -> np.ndarray:
    """The least member of each of ``n`` nodes' group."""
    up = list(range(n))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for block in pairs:
        for a, b in block.tolist():
            a, b = top(a), top(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    return np.array([top(i) for i in range(n)], np.int64)


def verified(pairs: Iterator[np.ndarray], fp: np.ndarray, radius: int) -> Iterator[np.ndarray]:
    """The pairs of nodes whose fingerprints differ in at most ``radius`` bits."""
    for block in pairs:
        yield block[np.bitwise_count(fp[block[:, 0]] ^ fp[block[:, 1]]) <= radius]


def _turned(bits: int, depth: int, half: int) -> str:
    """SQL: masks that flip at most ``half`` of the ``depth`` bits behind the first ``bits``."""
    low = 64 - bits - depth
    masks = [(m << low) - (1 << 64 if m << low >> 63 else 0) for m, _ in flips(depth, half)]
    return f"from_json('{masks}', 'array<bigint>')"


def links(fps: DataFrame, radius: int = 4, prefix_bits: int = 12) -> DataFrame:
    """``a, b``: enough links between the distinct fingerprints ``fp`` to join all that are within ``radius``."""
    half = radius // 2
    sent = fps.select("fp", F.explode(F.expr(_turned(0, prefix_bits, half))).alias("mask"))
    sent = sent.select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("center"), F.lit(prefix_bits).alias("bits"))
    prefix = F.expr("shiftrightunsigned(center, 64 - bits)")
    bits, done = prefix_bits, None
    while bits + DEEPER <= 64:
        full = saved(sent.groupBy(prefix.alias("full")).count().where(F.col("count") > CROWDED).select("full"))
        if full.isEmpty():
            break
        crowded = sent.withColumn("full", prefix).join(full, "full", "left_semi").drop("full")
        rest = sent.withColumn("full", prefix).join(full, "full", "left_anti").drop("full")
        done = rest if done is None else done.union(rest)
        deeper = crowded.select("fp", F.explode(F.expr(f"transform({_turned(bits, DEEPER, half)}, m -> center ^ m)")).alias("center"), F.lit(bits + DEEPER).alias("bits"))
        sent = deeper.where(F.bit_count(F.col("center").bitwiseXOR(F.col("fp"))) <= half)
        bits += DEEPER
    sent = sent if done is None else done.union(sent)

    def run(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("fp").to_numpy())
        signed = t.column("fp").to_numpy()[order]
        center, fp, bits = t.column("center").to_numpy()[order].view(np.uint64), signed.view(np.uint64), t.column("bits")[0].as_py()
        used = np.bitwise_count(center ^ fp).astype(np.int64)
        root = forest(verified(_meetings(center, used, np.arange(len(fp)), bits, half), fp, radius), len(fp))
        linked = root != np.arange(len(fp))
        return pa.table({"a": signed[linked], "b": signed[root[linked]]})

    return sent.groupBy("bits", prefix.alias("prefix")).applyInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """``id_col, fp, component_id`` for each row: the smallest id that links of at most ``radius`` bits reach."""
    if radius % 2:
        raise ValueError("the radius must be even: each side flips half of it")
    of_docs = saved(fingerprints(docs, id_col, text_col, width))
    fps = saved(of_docs.groupBy("fp").agg(F.min(id_col).alias("least")))
    # A prefix holds 2^13 fingerprints or fewer on average, at any size of the corpus.
    bits = max(12, math.ceil(math.log2(max(1, fps.count()) / (1 << 13))))
    roots = components(links(fps.select("fp"), radius, bits), "a", "b")
    rooted = saved(fps.join(roots, fps.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return of_docs.join(rooted.join(least, "root").select("fp", "component_id"), "fp", "left").select(id_col, "fp", "component_id")
