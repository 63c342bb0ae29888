"""Byte-level BPE: encoding with a priority queue over a linked symbol list, and decoding.

A piece of text is a doubly linked list of byte symbols. Every adjacent pair
that the vocabulary can merge waits in a heap under its merge rank (ties: the
leftmost). Popping an entry whose symbols have changed since is a no-op, so
nothing is ever removed from the middle of the heap. Decoding concatenates the
vocabulary's byte strings.

Rows: a null text counts as an empty one (no ids); an empty text has no ids and
decodes to the empty text; repeated rows (and ties) give equal results; very long
texts are cut into pieces and encoded whole; an empty table gives an empty one; columns of the input other than the id and the text are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from quire.llm.common import modest_batches

#: How the public byte-level vocabularies cut a text before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Ranges of letters and digits that Unicode got after version 16, which public tokenizers take for neither.
NEWER = [
    (0x0558, 0x0558), (0x058B, 0x058C), (0x088F, 0x088F), (0x0C5C, 0x0C5C), (0x0CDC, 0x0CDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF),
    (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959),
    (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F),
    (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2),
    (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96),
    (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F),
    (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
]
_NEWER = "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in NEWER) + "]"
_OLDER = PIECES.replace(r"\p{L}+", rf"(?:(?!{_NEWER})\p{{L}})+").replace(r"\p{N}+", rf"(?:(?!{_NEWER})\p{{N}})+").replace(r"[^\p{White_Space}\p{L}\p{N}]+", rf"(?:[^\p{{White_Space}}\p{{L}}\p{{N}}]|{_NEWER})+")
#: Pieces whose ids are remembered in each of the cache's two generations.
CACHED = 1 << 18


def _byte_letters() -> dict[str, int]:
    """The vocabulary file's letter for each byte: printable bytes stand for themselves, the rest follow from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteBPE:
    """A vocabulary with ordered merges; made from the JSON text of a tokenizer file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        byte_of = _byte_letters()
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.bytes_of = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in token)
        for token, i in self.added.items():
            self.bytes_of[i] = token.encode()
        self.first = [0] * 256
        for letter, b in byte_of.items():
            self.first[b] = vocab[letter]
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank.setdefault(vocab[a] << 32 | vocab[b], r)
            self.made.append(vocab[a + b])
        self.text_of = [str(i) for i in range(size)]
        self.pieces, self.older_pieces, self.newer = regex.compile(PIECES).findall, regex.compile(_OLDER).findall, regex.compile(_NEWER).search
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else None
        self.young: dict[str, list[int]] = {}
        self.old: dict[str, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        rank, made = self.rank, self.made
        ids = [self.first[b] for b in piece]
        n = len(ids)
        if n < 2:
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r << 32 | i for i in range(n - 1) if (r := rank.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapify(heap)
        while heap:
            top = heappop(heap)
            r, i = top >> 32, top & 0xFFFFFFFF
            j = after[i]
            if ids[i] < 0 or j >= n or rank.get(ids[i] << 32 | ids[j]) != r:
                continue  # stale: one of the two symbols has been merged since
            ids[i], ids[j] = made[r], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (s := rank.get(ids[i] << 32 | ids[k])) is not None:
                    heappush(heap, s << 32 | i)
            if (h := before[i]) >= 0 and (s := rank.get(ids[h] << 32 | ids[i])) is not None:
                heappush(heap, s << 32 | h)
        return [i for i in ids if i >= 0]

    def _miss(self, piece: str) -> list[int]:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.merge(piece.encode())
        if len(self.young) >= CACHED:
            self.old, self.young = self.young, {}
        if len(piece) <= 64:
            self.young[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.split(text) if self.split else (text,):
            if part in self.added:
                out.append(self.added[part])
                continue
            cut = self.older_pieces if not part.isascii() and self.newer(part) else self.pieces
            for piece in cut(part):
                out += self.young.get(piece) or self._miss(piece)
        return out

    def decode(self, ids: list[int]) -> str:
        """Bytes that are no valid UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


#: One vocabulary for each broadcast in a worker process, so that its cache lasts from batch to batch.
_LOADED: dict[str, ByteBPE] = {}


def loaded(text: str) -> ByteBPE:
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = ByteBPE(text)
    return _LOADED[key]


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Slices, so that only a few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """``id_col, n_tokens, ids_sha256, decoded_sha256`` and, with ``keep_ids``, ``ids`` and ``decoded`` of every whole text.

    ``tokenizer`` is the path of a tokenizer file on the driver; its text (a
    vocabulary, so of a fixed size) goes to the executors as a broadcast.
    """
    spark: SparkSession = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(spec.value)
        for batch in small_batches(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                ids = bpe.encode(text or "")
                decoded = bpe.decode(ids)
                rows.append((len(ids), hashlib.sha256(",".join(map(bpe.text_of.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), ids, decoded))
            cols = [batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                cols += [pa.array([r[3] for r in rows], pa.list_(pa.int32())), pa.array([r[4] for r in rows], pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids
    return modest_batches(docs).select(id_col, text_col).mapInArrow(run, schema)
