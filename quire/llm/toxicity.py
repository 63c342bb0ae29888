"""Toxicity by compression distance: which of two zstandard dictionaries shortens a text's windows more.

Learning takes a bounded sample: ``per_class`` labelled texts of each class, those
with the smallest hash of their id (exact copies in it count once). Half of it
trains the dictionaries, half the thresholds.

* A window is a run of ``WIDTH`` words in lower case, one after the other, so each word is in
  one. What several texts of the sample hold alike (a window with the word before and the
  word after it) counts once in training, so that copies weigh like one text.
* The ordinary dictionary is trained by zstandard on the windows of ordinary texts.
* The toxic dictionary is trained by zstandard on toxic windows. A label speaks of a
  text, most windows of which are ordinary, so a toxic text's window counts as toxic
  if it holds a word beginning that is ``LIFT`` times as frequent among toxic texts as
  among ordinary ones. The two dictionaries share nothing.
* A window is compressed on its own, written ``REPEAT`` times in lines: the later
  copies cost one match under either dictionary, so a short match in the first one
  shows in the length instead of vanishing in a block that is stored as it is.

A window that the toxic dictionary shortens by less than ``LEAST`` bytes can't be shorter by as
many under it than under the other one, so only the rest is compressed a second time.

A text's counts of windows whose two lengths differ by ``LEAST`` or more bytes, up to ``STEPS``, are weighed by
a logistic regression, fitted on the other half of the sample with the classes' true
weights: these are the calibrated thresholds, and the score is a probability. Texts that get
a score from ``UNSURE`` on and below ``SURE`` are read again with every run of ``WIDTH`` words as
a window, and scored by a second regression on those counts.

Rows: null and empty texts have no windows and get the score of that; very long texts
are compressed window by window, in blocks of a fixed size; a null id is never held
out and matches no label; null labels are left out; repeated rows get equal results;
ties (equal lengths, equal hashes of ids) are a difference of zero and go by id; without
labels of both classes, or without any window that counts as toxic, every score is the
share of toxic labels (0 without any); an empty table gives an empty one; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.bpe import small_batches
from quire.llm.common import modest_batches

WIDTH, REPEAT, STEPS = 2, 2, 8
#: The least difference of lengths, in bytes, that is counted.
LEAST = 3
#: Scores from the first of which on, and below the second, a text is read again with overlapping windows.
UNSURE, SURE = 0.03, 0.9
#: Windows compressed at a time, and those whose differences a worker remembers.
BLOCK, REMEMBERED = 4096, 1 << 18
#: Bytes of the dictionaries.
ORDINARY_SIZE, TOXIC_SIZE = 131_072, 3_072
#: How much more frequent a beginning of a toxic window is among toxic texts; its least and greatest length in bytes.
LIFT, BEGINNING = 10, (4, 16)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().split()


def windows(text: str | None, step: int = WIDTH, width: int = WIDTH) -> list[bytes]:
    """Runs of ``width`` words, one every ``step`` words, to the last word."""
    words = words_of(text)
    return [b" ".join(words[i : i + width]) for i in range(0, max(len(words) - width + step, 1), step)] if words else []


def fresh_windows(texts: list[str], width: int = WIDTH) -> list[list[bytes]]:
    """Each text's words, ``width`` at a time, but what it or an earlier text had with the same words around it."""
    seen: set[bytes] = set()
    out = []
    for text in texts:
        words, own = words_of(text), []
        for i in range(0, len(words), width):
            around = b" ".join(words[max(0, i - 1) : i + width + 1])
            if around not in seen:
                seen.add(around)
                own.append(b" ".join(words[i : i + width]))
        out.append(own)
    return out


def _beginnings(window: bytes) -> set[bytes]:
    return {w[:n] for w in window.split() for n in range(BEGINNING[0], min(len(w), BEGINNING[1]) + 1)}


def toxic_windows(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> list[bytes]:
    """The windows of toxic texts with a beginning that is ``LIFT`` times as frequent there, by texts that have it.

    A beginning has to be in three texts, or in one of 150 where that is more.
    """
    bad, good = (Counter(b for wins in part for b in set().union(*map(_beginnings, wins))) for part in (toxic, ordinary))
    least = max(3, round(len(toxic) / 150))
    marked = {b for b, n in bad.items() if n >= least and n * len(ordinary) > LIFT * (good[b] + 0.5) * len(toxic)}
    return [w for wins in toxic for w in wins if not marked.isdisjoint(_beginnings(w))]


def framed(window: bytes) -> bytes:
    return (b"\n " + window + b" ") * REPEAT


def trained(samples: list[bytes], size: int) -> bytes:
    """A dictionary trained by zstandard; where the samples are too few for that, the samples themselves."""
    samples = [b" " + w + b" " for w in samples]
    try:
        return zs.train_dictionary(size, samples).as_bytes()
    except zs.ZstdError:
        return b"".join(samples)[-size:]


def compressor(dictionary: bytes) -> zs.ZstdCompressor:
    """Every match of four bytes or more that the dictionary has is found; lengths hold no checksum or size."""
    params = zs.ZstdCompressionParameters.from_level(19, strategy=zs.STRATEGY_BTLAZY2, min_match=4, write_content_size=False, write_checksum=False, write_dict_id=False)
    known = zs.ZstdCompressionDict(dictionary, dict_type=zs.DICT_TYPE_RAWCONTENT)
    known.precompute_compress(compression_params=params)
    return zs.ZstdCompressor(dict_data=known, compression_params=params)


#: Lengths of windows for which it is known how long they get where nothing shortens them.
SHORT = 256


def plain_lengths(tool: zs.ZstdCompressor) -> np.ndarray:
    """By a window's length in bytes: its compressed length where no part of it was seen before."""
    out = np.full(SHORT + 1, np.iinfo(np.int64).max)
    for n in range(SHORT + 1):
        out[n] = max(len(tool.compress(framed(hashlib.shake_128(b"%d %d" % (n, k)).digest(n)))) for k in range(3))
    return out


@dataclass
class Distance:
    """Differences of compressed lengths under the two dictionaries."""

    ordinary: bytes
    toxic: bytes
    _tools: tuple | None = field(default=None, repr=False)
    _plain: np.ndarray | None = field(default=None, repr=False)
    _known: dict[bytes, int] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> tuple:
        return self.ordinary, self.toxic

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def _lengths(self, tool: int, parts: list[bytes]) -> np.ndarray:
        sizes = np.fromiter(map(len, parts), np.uint64, len(parts))
        segments = zs.BufferWithSegments(b"".join(parts), np.stack([np.cumsum(sizes) - sizes, sizes], 1).astype(np.uint64).tobytes())
        made = self._tools[tool].multi_compress_to_buffer(segments, threads=1)
        return np.fromiter((len(made[i]) for i in range(len(parts))), np.int64, len(parts))

    def of(self, wins: list[bytes]) -> np.ndarray:
        """How many bytes shorter each window is under the toxic dictionary; 0 below ``LEAST``."""
        known, some = self._known, dict.fromkeys(wins)
        if len(known) + len(some) > REMEMBERED:
            known.clear()
        new = [w for w in some if w not in known]
        for at in range(0, len(new), BLOCK):
            known.update(zip(new[at : at + BLOCK], self._differences(new[at : at + BLOCK]).tolist(), strict=True))
        return np.fromiter(map(known.__getitem__, wins), np.int64, len(wins))

    def _differences(self, wins: list[bytes]) -> np.ndarray:
        if self._tools is None:
            self._tools = compressor(self.ordinary), compressor(self.toxic)
            self._plain = plain_lengths(compressor(bytes(8)))
        parts = [framed(w) for w in wins]
        toxic, out = self._lengths(1, parts), np.zeros(len(wins), np.int64)
        sizes = np.fromiter(map(len, wins), np.int64, len(wins))
        open_ = np.flatnonzero((sizes > SHORT) | (toxic <= self._plain[np.minimum(sizes, SHORT)] - LEAST))
        if len(open_):
            out[open_] = self._lengths(0, [parts[i] for i in open_]) - toxic[open_]
        return np.where(out < LEAST, 0, out)

    def features(self, texts: list[str | None], step: int = WIDTH) -> np.ndarray:
        """A row for each text: the logarithms of how many windows differ by ``LEAST`` to ``STEPS`` bytes or more, and, if any does, of how many there are; and a one."""
        wins = [windows(t, step) for t in texts]
        ends = np.cumsum([len(w) for w in wins])
        saved = np.clip(self.of([w for own in wins for w in own]), 0, STEPS)
        out = np.zeros((len(texts), STEPS - LEAST + 2))
        for i, part in enumerate(np.split(saved, ends[:-1]) if texts else []):
            over = np.bincount(part, minlength=STEPS + 1)[::-1].cumsum()[::-1]
            out[i] = np.append(over[LEAST:], over[0] if over[LEAST] else 0)
        return np.hstack([np.log1p(out), np.ones((len(texts), 1))])


def regression(x: np.ndarray, y: np.ndarray, row: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights of a logistic regression with weighted rows, by Newton steps that are halved until they help."""

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((row * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * ridge * w @ w)

    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (row * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (row * (p - y)) + ridge * w)
        size, now = 1.0, loss(w)
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return w


def probability(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ weights, -40, 40)))


@dataclass
class Model:
    """``weights``: of counts of windows one after the other, and of every window."""

    distance: Distance | None
    weights: tuple[np.ndarray, ...] = ()
    share: float = 0.0

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.distance is None:
            return np.full(len(texts), self.share)
        out = probability(self.distance.features(texts), self.weights[0])
        again = np.flatnonzero((out >= UNSURE) & (out < SURE))
        if len(again):
            out[again] = probability(self.distance.features([texts[i] for i in again], 1), self.weights[1])
        return out

    @classmethod
    def fit(cls, toxic: list[str], ordinary: list[str], share: float) -> Model:
        """``share``: of toxic rows among all labelled ones."""
        toxic, ordinary = (list(dict.fromkeys(x)) for x in (toxic, ordinary))
        if not toxic or not ordinary:
            return cls(None, (), share)
        half = [max(1, len(x) // 2) for x in (toxic, ordinary)]
        bad, good = fresh_windows(toxic[: half[0]]), fresh_windows(ordinary[: half[1]])
        marked = toxic_windows(bad, good)
        if not marked:
            return cls(None, (), share)
        distance = Distance(trained([w for wins in good for w in wins], ORDINARY_SIZE), trained(marked, TOXIC_SIZE))
        rest = [toxic[half[0] :] or toxic, ordinary[half[1] :] or ordinary]
        known = [t for part in rest for t in part]
        y = np.repeat([1.0, 0.0], [len(rest[0]), len(rest[1])])
        row = np.where(y > 0, share / len(rest[0]), (1 - share) / len(rest[1])) * len(y)
        return cls(distance, tuple(regression(distance.features(known, step), y, row) for step in (WIDTH, 1)), share)


def train(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", per_class: tuple[int, int] = (4800, 1600)) -> Model:
    """From at most ``per_class`` ordinary and toxic texts for whose ids ``learn`` holds."""
    marks = labels.where(learn & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
    counts = {r[0]: r[1] for r in marks.groupBy("label").count().collect()}
    chosen = None
    for k, most in enumerate(per_class):
        part = marks.where(F.col("label") == k).dropDuplicates(["id"]).orderBy(F.xxhash64("id"), "id").limit(most)
        chosen = part if chosen is None else chosen.union(part)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    got = texts.join(F.broadcast(chosen), "id").orderBy(F.xxhash64("id"), "text", "label").limit(2 * sum(per_class)).collect()  # the limit only holds the bound where ids repeat
    total = sum(counts.values())
    return Model.fit([r.text for r in got if r.label == 1], [r.text for r in got if r.label == 0], counts.get(1, 0) / total if total else 0.0)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``id_col, score, predicted`` for each whole text; the model (two dictionaries and a few weights) goes as a broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(batch.column(1).to_pylist()), pa.float64())], [id_col, "score"])

    scored = modest_batches(docs).select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
