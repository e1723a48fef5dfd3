"""Quality classifier: random Fourier features, ridge regression and isotonic calibration.

Every whole text becomes a few statistics (shares of kinds of characters, of repeated
neighbouring words and of distinct words, lengths). Standardised, they are mapped to
random Fourier features of a Gaussian kernel. The normal equations are summed within
partitions, and the sums of the partitions again, so only one small matrix reaches the
driver. Ridge scores are calibrated by isotonic regression on labelled rows that the
ridge fit did not see, from counts on a fixed grid.

Only the fit is bounded: at most ``max_rows`` labelled rows, taken by hash, train it.
Every document is scored on its whole text.

Defined cases: a null or empty text has zero statistics and is scored like any other; a
document with several labels counts once with their mean, rounded; labels that are null
or of no document are ignored; with no labels, or of one class only, every score is the
share of class 1 (0.5 without any); texts of any length are read whole; raw scores that tie
get equal scores; repeated rows are scored each; an empty table gives an empty table; extra
columns are not read by ``scored`` and stay, whatever their names, in ``accepted``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import workers_ready, written

#: Rows that may train, random features, kernel width, ridge penalty a row, cells of the calibration grid.
MAX_ROWS, FEATURES, WIDTH, PENALTY, GRID = 200_000, 256, 4.0, 1e-4, 2000
#: Statistics of a text, in order.
STATISTICS = ("log_words", "log_chars", "word_length", "letters", "upper", "digits", "spaces", "symbols", "marks", "stops", "high", "distinct", "neighbours", "line_words", "same_lines", "top_word")


def _class(chars: str) -> np.ndarray:
    return np.frombuffer(chars.encode("latin-1"), "u1")


_LETTER = _class("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_UPPER, _DIGIT, _BLANK = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("0123456789"), _class(" \t\n\r\v\f")
_SYMBOL, _MARK, _STOP = _class("#*$%&|<>@^~{}[]\\=+_"), _class("!?;:\"'()-/"), _class(".,")
_LINE = re.compile("[^\n]+")


def statistics(text: str | None) -> list[float]:
    """The statistics of one whole text."""
    if not text:
        return [0.0] * len(STATISTICS)
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), "u1"), minlength=256)
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n, size = len(words), int(raw.sum())
    if not n:
        return [0.0, np.log1p(size), 0.0, 0.0, 0.0, 0.0, raw[_BLANK].sum() / size, *[0.0] * 9]
    solid = max(1, size - int(raw[_BLANK].sum()))
    share = lambda kind: raw[kind].sum() / solid
    same = sum(map(str.__eq__, words, words[1:]))
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    return [
        np.log1p(n), np.log1p(size), min(30.0, solid / n), share(_LETTER), share(_UPPER), share(_DIGIT), raw[_BLANK].sum() / size, share(_SYMBOL), share(_MARK), share(_STOP), raw[128:].sum() / solid,
        len(counts) / n, same / n, np.log1p(n / len(lines)), 1 - len(set(lines)) / len(lines), max(counts.values()) / n,
    ]


def described(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each row."""
    workers_ready(docs.sparkSession)

    def run(batches):
        for b in batches:
            found = np.array([statistics(t) for t in b.column(1).to_pylist()], "f8").reshape(b.num_rows, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(found), pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, x array<double>")


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


@dataclass
class Model:
    """Standardisation, random features, ridge weights and the calibration's knots."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray
    seed: int = 7

    def features(self, x: np.ndarray) -> np.ndarray:
        return fourier((x - self.mean) / self.scale, self.seed)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated scores; a hair of the raw score keeps the order within a step."""
        if not len(self.weights):
            return np.full(len(x), self.values[0])
        raw = self.features(x) @ self.weights
        return np.clip(0.998 * np.interp(raw, self.knots, self.values) + 0.002 * np.clip(raw, 0, 1), 0, 1)


def fourier(x: np.ndarray, seed: int, n: int = FEATURES, width: float = WIDTH) -> np.ndarray:
    """Random Fourier features of a Gaussian kernel, and a constant."""
    draw = np.random.default_rng(seed)
    w, b = draw.normal(0, 1 / width, (x.shape[1], n)), draw.uniform(0, 2 * np.pi, n)
    return np.hstack([np.sqrt(2 / n) * np.cos(np.clip(x, -20, 20) @ w + b), np.ones((len(x), 1))])


def isotonic(x: np.ndarray, weight: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; the knots are the pools' mean x."""
    pools: list[list[float]] = []
    for a, w, v in zip(x, weight, y, strict=True):
        pools.append([a * w, w, v * w])
        while len(pools) > 1 and pools[-2][2] / pools[-2][1] >= pools[-1][2] / pools[-1][1]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[1] for p in pools]), np.array([p[2] / p[1] for p in pools])


def _summed(df: DataFrame, of) -> np.ndarray:
    """The sum of of(x, y) over all rows: within a partition, then of partitions in two steps."""

    def run(batches):
        total = None
        for b in batches:
            if b.num_rows:
                part = of(np.array(b.column(0).to_pylist(), "f8"), b.column(1).to_numpy())
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype("f8").tobytes()], pa.binary())], names=["sum"])

    def again(batches):
        parts = [np.frombuffer(x, "f8") for b in batches for x in b.column(0).to_pylist()]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([np.sum(parts, axis=0).tobytes()], pa.binary())], names=["sum"])

    sums = df.select("x", "y").mapInArrow(run, "sum binary").repartition(8).mapInArrow(again, "sum binary").collect()
    return np.sum([np.frombuffer(r[0], "f8") for r in sums], axis=0) if sums else np.zeros(0)


def fit(found: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS, seed: int = 7) -> Model:
    """Fit on described documents whose remainder is not 2: 0 and 1 train the ridge, 3 calibrates."""
    clean = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).filter("doc_id is not null and y is not null").filter(remainder(F.col("doc_id")) != 2)
    clean = clean.groupBy("doc_id").agg(F.when(F.avg("y") >= 0.5, 1.0).otherwise(0.0).alias("y"))
    clean = clean.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = written(found.join(clean, "doc_id").select("doc_id", "x", "y", (remainder(F.col("doc_id")) == 3).alias("calibrates")), "labelled")
    d = len(STATISTICS)
    moments = _summed(rows, lambda x, y: np.concatenate([[len(x), y.sum()], x.sum(0), (x * x).sum(0)]))
    if not len(moments) or moments[1] in (0, moments[0]):
        return Model(np.zeros(d), np.ones(d), np.zeros(0), np.zeros(1), np.array([moments[1] / moments[0] if len(moments) else 0.5]))
    mean = moments[2 : 2 + d] / moments[0]
    scale = np.sqrt(np.maximum(moments[2 + d :] / moments[0] - mean**2, 1e-12))
    scale[scale < 1e-5] = 1.0
    model = Model(mean, scale, np.zeros(0), np.zeros(0), np.zeros(0), seed)

    def normal(x, y):
        z = model.features(x)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y, [len(x)]])

    train = rows.filter("not calibrates")
    sums = _summed(train, normal)
    if not len(sums):
        train, sums = rows, _summed(rows, normal)
    k = FEATURES + 1
    ridge = PENALTY * sums[-1] * np.eye(k)
    ridge[-1, -1] = 0
    model.weights = np.linalg.solve(sums[: k * k].reshape(k, k) + ridge + 1e-9 * np.eye(k), sums[k * k : k * k + k])

    def cells(x, y):
        raw = model.features(x) @ model.weights
        cell = np.clip(((raw + 0.5) / 2 * GRID).astype(int), 0, GRID - 1)
        return np.concatenate([np.bincount(cell, minlength=GRID), np.bincount(cell, y, minlength=GRID), np.bincount(cell, raw, minlength=GRID)])

    counts = _summed(rows.filter("calibrates"), cells)
    n, good, raw = (counts if len(counts) else _summed(rows, cells)).reshape(3, GRID)
    used = n > 0
    model.knots, model.values = isotonic(raw[used] / n[used], n[used], good[used] / n[used])
    return model


def scored(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.7, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    found = written(described(docs), "described")
    model = fit(found, labels, label, max_rows)

    def run(batches):
        for b in batches:
            x = np.array(b.column(1).to_pylist(), "f8").reshape(b.num_rows, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x), pa.float64())], names=["doc_id", "score"])

    scores = found.mapInArrow(run, "doc_id long, score double")
    return scores.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.7, max_rows: int = MAX_ROWS) -> DataFrame:
    """The documents that score at least the threshold, with their columns; they are scored where they lie."""
    workers_ready(docs.sparkSession)
    found = written(described(docs), "described")
    model = fit(found, labels, label, max_rows)
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            x = np.array([statistics(t) for t in b.column(at).to_pylist()], "f8").reshape(b.num_rows, len(STATISTICS))
            yield b.filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)
