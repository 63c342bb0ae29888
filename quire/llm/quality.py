"""Quality classification by a regularised quadratic discriminant.

Each text gives a vector of transformed statistics (logarithms of counts, logits
of shares). For each class the mean and a covariance shrunk towards its diagonal
are fitted, the Cholesky factor of each covariance is computed once, and a text's
score is the logistic of the difference of the classes' log densities (from the
Mahalanobis distances) plus the log odds of the classes.

The fit uses every labelled row, and reads the texts of no others: what reaches the driver
are the sums of the vectors and of their products, of a fixed size. The labels are
broadcast if their counted rows are few, and joined by a shuffle beyond.

Rows: a null text counts as an empty one, and an empty text has the statistics
of no characters and no words and gets a score like any other; a null id is
never held out and matches no label; repeated rows get equal results; repeated
labels of a document count as often as they occur; null labels are left out; with
one class only among the labels every score is that class's; with no labels every
score is 0.5; ties in the score go to 1; very long texts are read whole; an empty table gives an
empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.bpe import small_batches
from quire.llm.common import BROADCAST_IDS, modest_batches, saved

_SETS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": b" \t", "line": b"\n", "stop": b".,;:?", "shout": b"!", "bar": b"|", "symbol": b"#$%&*<>=@\\^_~{}[]+/", "quote": b"\"'()-`"}
NAMES = ["log_bytes", *(f"share_{k}" for k in _SETS), "share_wide", "log_words", "word_length", "word_spread", "distinct_words", "distinct_lines", "top_word", "log_longest", "log_line"]
_CLASS = np.zeros((256, len(_SETS) + 1))
for _k, _chars in enumerate(_SETS.values()):
    _CLASS[list(_chars), _k] = 1
_CLASS[128:, -1] = 1


def _logit(part: float, whole: float) -> float:
    return float(np.log((part + 0.5) / (whole - part + 0.5)))


def statistics(text: str | None) -> list[float]:
    """The values named in NAMES."""
    raw = (text or "").encode()
    n = len(raw)
    of_class = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASS
    words = raw.lower().split()
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    lines = [x for x in raw.split(b"\n") if x]
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    return [
        float(np.log1p(n)),
        *(_logit(c, n) for c in of_class.tolist()),
        float(np.log1p(len(words))),
        float(np.log1p(lengths.mean())),
        float(np.log1p(lengths.std())),
        _logit(len(seen), len(words)),
        _logit(len(set(lines)), len(lines)),
        _logit(max(seen.values(), default=0), len(words)),
        float(np.log1p(lengths.max())),
        float(np.log1p(n / max(1, len(lines)))),
    ]


@dataclass
class Discriminant:
    """Two classes' log weights, means and Cholesky factors; a class that no row has is None."""

    weight: list[float]
    mean: list[np.ndarray | None]
    factor: list[np.ndarray | None]
    #: The inverses of the factors, and the halves of the log determinants: made once, used for every text.
    inverse: list[np.ndarray | None] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.inverse = [None if f is None else np.linalg.inv(f) for f in self.factor]
        self.scale = [0.0 if f is None else float(np.log(np.diag(f)).sum()) for f in self.factor]

    @classmethod
    def of_sums(cls, count: np.ndarray, total: np.ndarray, product: np.ndarray, shrink: float, floor: float) -> Discriminant:
        """From each class's row count, sum of vectors and sum of outer products."""
        weight, mean, factor = [], [], []
        for n, s, p in zip(count, total, product, strict=True):
            if not n:
                weight, mean, factor = [*weight, 0.0], [*mean, None], [*factor, None]
                continue
            m = s / n
            cov = p / n - np.outer(m, m)
            cov = (1 - shrink) * cov + shrink * np.diag(np.diag(cov)) + floor * np.eye(len(m))
            weight, mean, factor = [*weight, float(np.log(n / count.sum()))], [*mean, m], [*factor, np.linalg.cholesky(cov)]
        return cls(weight, mean, factor)

    def _log_density(self, k: int, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean[k]) @ self.inverse[k].T
        return self.weight[k] - self.scale[k] - 0.5 * (z * z).sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1."""
        if self.factor[0] is None or self.factor[1] is None:
            return np.full(len(x), 0.5 if self.factor[0] is self.factor[1] else float(self.factor[0] is None))
        return 1 / (1 + np.exp(-np.clip(self._log_density(1, x) - self._log_density(0, x), -40, 40)))


def sums(rows: DataFrame, text_col: str = "text", counts: tuple[str, str] = ("zeros", "ones")) -> DataFrame:
    """``at, value`` by partition: for each class its number of labels, the sum of the vectors and of their outer products.

    ``counts`` are the columns that tell how often a row's text has the label 0 and 1. A text becomes
    its part of the sums in one step: a second one behind it would need a Python worker of
    its own for each running task, which stays and takes memory as long as the executor does.
    """
    d = len(NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for batch in small_batches(batches):
            x = np.array([statistics(t) for t in batch.column(0).to_pylist()], float).reshape(-1, d)
            for k in (0, 1):
                n = batch.column(1 + k).to_numpy(zero_copy_only=False).astype(float)
                total[k] += np.concatenate([[n.sum()], n @ x, ((x.T * n) @ x).ravel()])
        at = np.arange(total.size, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel())], ["at", "value"])

    return modest_batches(rows).select(text_col, *counts).mapInArrow(run, "at int, value double")


def fit(made: DataFrame, shrink: float = 0.1, floor: float = 0.2) -> Discriminant:
    """From the rows of ``sums``, added up by position."""
    d = len(NAMES)
    got = np.zeros(2 * (1 + d + d * d))
    for at, value in made.groupBy("at").agg(F.sum("value").alias("value")).collect():  # as many rows as there are sums
        got[at] = value
    got = got.reshape(2, -1)
    return Discriminant.of_sums(got[:, 0], got[:, 1 : 1 + d], got[:, 1 + d :].reshape(2, d, d), shrink, floor)


def _sums(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str, id_col: str, text_col: str) -> DataFrame:
    marks = saved(labels.select(F.col(id_col).alias("__id"), F.col(label_col).alias("label")).where(F.col("label").isin(0, 1) & F.col("__id").isNotNull()))
    few = marks.count() <= BROADCAST_IDS
    marks = marks.groupBy("__id").agg(F.count_if(F.col("label") == 0).alias("zeros"), F.count_if(F.col("label") == 1).alias("ones"))
    known = docs.where(learn).select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"))
    return sums(known.join(F.broadcast(marks) if few else marks, "__id"))


def classify(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``id_col, score, predicted`` for each row; the fit takes the labels of rows for which ``learn`` (on the id) holds."""
    model = fit(_sums(docs, labels, learn, label_col, id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            score = model.score(np.array([statistics(t) for t in batch.column(1).to_pylist()]).reshape(-1, len(NAMES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], [id_col, "score"])

    scored = modest_batches(docs).select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The whole rows of ``docs`` that ``classify`` predicts 1 for; no text is shuffled."""
    model, at = fit(_sums(docs, labels, learn, label_col, id_col, text_col)), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            score = model.score(np.array([statistics(t) for t in batch.column(at).to_pylist()]).reshape(-1, len(NAMES)))
            yield batch.filter(pa.array(score >= threshold))

    return modest_batches(docs).mapInArrow(run, docs.schema)
