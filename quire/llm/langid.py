"""Language identification in two steps: the family first, then the language within it.

A text is a vector of hashed byte n-grams (1 to 3 bytes of the text with A-Z in
lower case and everything that is not a letter as one space), square-rooted and
scaled to length one. A linear support vector machine against the rest picks the
family; within a family of several languages one machine for each pair of them
votes (ties: the larger sum of margins). Both kinds are trained by dual
coordinate descent on the driver.

The training sample is bounded: ``per_language`` rows for each language, those
with the smallest hash of their id, so it does not depend on the order of rows.

Rows: null texts and texts without a letter get ``und`` and score 0; a null id
is never held out; rows with a null language are not learned from; repeated rows
get equal results; very long texts are counted whole; ties of votes go by margin, then by
code; languages in no family of ``FAMILIES`` form one of their own;
with a single learned language every text with a letter gets it; with none every
text gets ``und``; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.bpe import small_batches
from quire.llm.common import modest_batches

#: ISO 639-1 codes of closely related languages.
FAMILIES = {
    "germanic": ("en", "de", "nl", "af", "fy", "lb"),
    "nordic": ("da", "sv", "no", "nb", "nn", "is"),
    "romance": ("fr", "es", "it", "pt", "ca", "gl", "ro", "oc"),
    "slavic": ("ru", "uk", "be", "bg", "pl", "cs", "sk", "sl", "hr", "sr"),
}
DIMS = 4096
_FOLD = np.full(256, 32, np.uint8)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_letter = regex.compile(r"\p{L}").search


def grams(text: str) -> np.ndarray:
    """The text's vector."""
    b = _FOLD[np.frombuffer(text.encode(), np.uint8)].astype(np.int32)
    out = np.zeros(DIMS)
    for n in (1, 2, 3):
        if len(b) >= n:
            code = b[n - 1 :] + n * 7919
            for k in range(1, n):
                code = (code * 31 + b[n - 1 - k : len(b) - k]) % 1_000_003
            out += np.bincount(code & (DIMS - 1), minlength=DIMS)
    out = np.sqrt(out)
    return out / max(1e-9, float(np.sqrt(out @ out)))


def machine(x: np.ndarray, y: np.ndarray, c: float = 4.0, rounds: int = 12) -> np.ndarray:
    """Weights (the last one is the bias) of a linear SVM with squared hinge loss; ``y`` is -1 or 1, classes weigh alike."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weigh = np.where(y > 0, len(y) / max(1, 2 * (y > 0).sum()), len(y) / max(1, 2 * (y < 0).sum())) * c
    alpha, w, diag = np.zeros(len(y)), np.zeros(x.shape[1]), (x * x).sum(axis=1) + 0.5 / weigh
    order = np.random.default_rng(7)
    for _ in range(rounds):
        for i in order.permutation(len(y)):
            g = y[i] * (x[i] @ w) - 1 + alpha[i] * 0.5 / weigh[i]
            step = max(alpha[i] - g / diag[i], 0.0) - alpha[i]
            if step:
                alpha[i] += step
                w += step * y[i] * x[i]
    return w


@dataclass
class Model:
    """``family`` has weights for each family's name, ``pair`` those for two languages of a family (positive: the first)."""

    members: dict[str, list[str]]
    family: dict[str, np.ndarray] = field(default_factory=dict)
    pair: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)

    @classmethod
    def fit(cls, x: np.ndarray, lang: list[str]) -> Model:
        home = {code: name for name, codes in FAMILIES.items() for code in codes}
        members: dict[str, list[str]] = {}
        for code in sorted(set(lang)):
            members.setdefault(home.get(code, code), []).append(code)
        model, lang_of = cls(members), np.array(lang, object)
        for name, codes in members.items():
            inside = np.isin(lang_of, codes)
            if len(members) > 1:
                model.family[name] = machine(x, np.where(inside, 1.0, -1.0))
            for a, b in combinations(codes, 2):
                own = (lang_of == a) | (lang_of == b)
                model.pair[a, b] = machine(x[own], np.where(lang_of[own] == a, 1.0, -1.0))
        return model

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.members or not _letter(text):
            return "und", 0.0
        x = np.append(grams(text), 1.0)
        margins = sorted(((float(x @ w), name) for name, w in self.family.items()), reverse=True)
        name = margins[0][1] if margins else next(iter(self.members))
        sure = margins[0][0] - margins[1][0] if len(margins) > 1 else 4.0
        codes = self.members[name]
        votes = {code: [0, 0.0] for code in codes}
        for a, b in combinations(codes, 2):
            m = float(x @ self.pair[a, b])
            votes[a if m >= 0 else b][0] += 1
            votes[a][1] += m
            votes[b][1] -= m
        best = max(codes, key=lambda code: (*votes[code], code))
        if len(codes) > 1:
            sure = min(sure, 2 * votes[best][1] / (len(codes) - 1))
        return best, float(1 / (1 + np.exp(-np.clip(sure, -30, 30))))


def train(docs: DataFrame, learn: Column, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", per_language: int = 400) -> Model:
    """From at most about ``per_language`` rows of each language for which ``learn`` holds."""
    place = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30))
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}  # a row for each language
    if not counts:
        return Model({})
    share = F.lit(0)
    for code, n in counts.items():
        share = F.when(F.col(lang_col) == code, min(1 << 30, (per_language << 30) // n + 1)).otherwise(share)
    sample = rows.where(place < share).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), place.alias("place"), F.col(id_col).alias("id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            x = [grams(t).astype(np.float32).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary()), batch.column(2), batch.column(3)], ["lang", "x", "place", "id"])

    made = modest_batches(sample).mapInArrow(run, f"lang string, x binary, place bigint, id {docs.schema[id_col].dataType.simpleString()}")
    # The limit only holds the bound where ids repeat: by hash, so about per_language rows of each are expected.
    got = made.orderBy("place", "id", "x").limit(2 * per_language * len(counts)).collect()
    if not got:
        return Model({})
    return Model.fit(np.stack([np.frombuffer(r.x, np.float32) for r in got]).astype(float), [r.lang for r in got])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, lang_pred, score`` for each whole text; the model has a fixed size and goes as a broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            said = [shared.value.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64())], [id_col, "lang_pred", "score"])

    return modest_batches(docs).select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double")
