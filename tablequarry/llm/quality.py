"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature, and each chosen pair of features, has a lookup table over bins; a document's score
is the logistic function of the sum of its tables' entries. The tables come from cyclic boosting:
round after round, one shallow tree per feature (then per pair) is added to its table.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

FEATURES = ("size", "upper", "lower", "digit", "symbol", "shout", "stop", "space", "line", "high", "word_length", "distinct", "repeat", "bare", "longest", "top_word", "marked", "line_words")
_BYTES = np.zeros((8, 256))
for _row, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"#$%&*+/<=>@\\^_`{|}~", b"!", b".,;:?", b" \t\r", b"\n")):
    _BYTES[_row, list(_chars)] = 1


def features(text: bytes | None) -> list[float]:
    """The features of one whole text, from its bytes and words alone."""
    text = text or b""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n = max(1, len(text))
    upper, lower, digit, symbol, shout, stop, space, line = (_BYTES @ counts).tolist()
    letters = max(1.0, upper + lower + float(counts[128:].sum()))
    words = text.split()
    w = max(1, len(words))
    times = Counter(words)
    top = max(times.values(), default=0)
    bare = sum(c for x, c in times.items() if not (x.isalnum() or max(x) > 127 or any(map(bytes.isalpha, (x[:1], x[-1:])))))
    marked = sum(c for x, c in times.items() if x[-1] in b"#$%&*!|+=~^<>")
    return [
        np.log1p(len(text)), upper / letters, lower / letters, digit / n, symbol / n, shout / n, stop / n, space / n, line / n, float(counts[128:].sum()) / n,
        (n - space - line) / w, len(times) / w, sum(map(operator.eq, words, words[1:])) / w, bare / w, np.log1p(max(map(len, times), default=0)), top / w, marked / w, np.log1p(w / (line + 1)),
    ]


def _described(batch: pa.RecordBatch, column: int | str) -> Iterator[list[float]]:
    return (features(t) for part in slices(batch) for t in part.column(column).cast(pa.binary()).to_pylist())


@dataclass
class Gam:
    """edges: bin edges per feature; tables: entries per feature; pairs: (i, j, coarse edges, table)."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for k, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += table[np.searchsorted(edges, x[:, k], side="right")]
        for i, j, a, b, table in self.pairs:
            out += table[np.searchsorted(a, x[:, i], side="right"), np.searchsorted(b, x[:, j], side="right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -40, 40)))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))


def _leaf(g: np.ndarray | float, h: np.ndarray | float) -> np.ndarray | float:
    return g / (h + 1.0)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """A tree over one feature's bins: its value in each bin."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    out = np.full(len(g), _leaf(g.sum(), h.sum()))
    if depth and len(g) > 1:
        gain = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h)
        cut = int(np.argmax(gain)) + 1
        if gain[cut - 1] > _gain(g.sum(), h.sum()) + 1e-9:
            out = np.concatenate([_tree(g[:cut], h[:cut], depth - 1), _tree(g[cut:], h[cut:], depth - 1)])
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of a pair's grid into four leaves: its gain and its values."""
    cg, ch = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    if min(g.shape) < 2:
        return 0.0, np.zeros_like(g)
    at = lambda c: (c[1:-1, 1:-1], c[1:-1, -1:] - c[1:-1, 1:-1], c[-1:, 1:-1] - c[1:-1, 1:-1], c[-1, -1] - c[1:-1, -1:] - c[-1:, 1:-1] + c[1:-1, 1:-1])
    parts = list(zip(at(cg), at(ch), strict=True))
    gain = sum(_gain(a, b) for a, b in parts)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    values = np.empty_like(g)
    for k, (a, b) in enumerate(parts):
        values[slice(0, i + 1) if k < 2 else slice(i + 1, None), slice(0, j + 1) if k % 2 == 0 else slice(j + 1, None)] = _leaf(a[i, j], b[i, j])
    return float(gain[i, j] - _gain(cg[-1, -1], ch[-1, -1])), values


def fit(x: np.ndarray, y: np.ndarray, *, bins: int = 64, rounds: int = 120, pair_count: int = 8, pair_rounds: int = 60, rate: float = 0.1) -> Gam:
    """Cyclic boosting of the single tables, then of the pairs whose best cut gains most on what is left."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = Gam(base=float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        model.edges, model.tables = [np.empty(0)] * len(FEATURES), [np.zeros(1)] * len(FEATURES)
        return model
    model.edges = [_cuts(x[:, k], bins) for k in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    at = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(model.edges)]
    logit = np.full(len(y), model.base)
    slope = lambda: (y - (p := 1 / (1 + np.exp(-logit))), p * (1 - p))
    for _ in range(rounds):
        for k, table in enumerate(model.tables):
            g, h = slope()
            step = rate * _tree(np.bincount(at[k], g, len(table)), np.bincount(at[k], h, len(table)), 2)
            table += step
            logit += step[at[k]]
    coarse = [_cuts(x[:, k], 16) for k in range(x.shape[1])]
    low = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(coarse)]
    g, h = slope()

    def grids(i: int, j: int, g: np.ndarray, h: np.ndarray) -> list[np.ndarray]:
        shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        return [np.bincount(low[i] * shape[1] + low[j], v, shape[0] * shape[1]).reshape(shape) for v in (g, h)]

    best = sorted(combinations(range(x.shape[1]), 2), key=lambda p: -_quadrants(*grids(*p, g, h))[0])[:pair_count]
    model.pairs = [(i, j, coarse[i], coarse[j], np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for i, j in best]
    for _ in range(pair_rounds):
        for i, j, _a, _b, table in model.pairs:
            step = rate * _quadrants(*grids(i, j, *slope()))[1]
            table += step
            logit += step[low[i], low[j]]
    return model


def _held_out(id: Column) -> Column:
    return F.crc32(id.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, *, sample: int = 20_000, id: str = "doc_id", text: str = "text", label: str = "quality") -> Gam:
    """Fits on at most `sample` labelled rows outside the held-out fifth, those of the smallest id hashes.

    The bound makes both the broadcast of their ids and the features sent to the driver at most
    `sample` rows; a million of them would still be a few hundred MB. Of several texts of an id
    the one whose features come first counts, so that the model depends on the tables alone.
    """
    chosen = labels.where(F.col(label).isin(0, 1) & F.col(id).isNotNull() & ~_held_out(F.col(id))).groupBy(id).agg(F.max(label).alias("_y"))
    chosen = chosen.orderBy(F.xxhash64(id), id).limit(sample).select(F.col(id).alias("_id"), "_y")
    rows = docs.select(F.col(id).alias("_doc"), F.col(text).cast("binary").alias("_text")).join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).select("_id", "_y", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int32()), pa.array(_described(batch, 2), pa.list_(pa.float64()))], ["id", "y", "x"])

    got = rows.mapInArrow(run, "id long, y int, x array<double>").groupBy("id").agg(F.min(F.struct("y", "x")).alias("r")).select("id", "r.y", "r.x").orderBy("id").limit(sample).collect()
    return fit(np.array([r.x for r in got]).reshape(-1, len(FEATURES)), np.array([r.y for r in got], dtype=float))


def with_score(docs: DataFrame, model: Gam, *, text: str = "text", score: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 for each whole text; a null text scores as an empty one. docs has no column of the name `score`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(list(_described(batch, text))).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.score(x))], [*batch.schema.names, score])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())]))


def scored(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per document: id, held_out, score, predicted.

    Only the text gives the score. A null or empty text is scored by its (empty) features.
    Repeated rows are scored alike; a row without an id is scored and counts as not held out. An
    id with several labels counts as of the greatest; without any labels all score one half, and
    with labels of one kind alone nearly 0 or 1. Empty tables give empty results; further columns
    are not read.
    """
    model = train(docs, labels, id=id, text=text, **options)
    found = with_score(docs.select(id, text), model, text=text)
    return found.select(id, F.coalesce(_held_out(F.col(id)), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
