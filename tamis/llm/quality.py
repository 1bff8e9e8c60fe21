"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted in turn on one feature at a time, then on pairs; since each tree reads
one feature (or one pair), their sum is a lookup table for each. A score is the sum of a few
table entries. The model is fitted on the driver from a bounded sample of labelled rows'
features (never texts); scoring reads every whole text where it lies.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamis.llm._shared import fresh, tidied
from tamis.session import ship

FEATURES = ("log_bytes", "log_words", "word_length", "upper_letters", "upper_words", "exclamations", "bars", "marks", "digits", "punctuation", "wide", "distinct_words", "top_word", "next_same", "same_lines", "line_length", "symbol_tail", "commas", "stops", "controls")
_UPPER = np.arange(65, 91)
_ALPHA = np.concatenate([_UPPER, np.arange(97, 123)])
_DIGIT = np.arange(48, 58)
_MARKS = np.frombuffer(b"#$%&*+<=>@\\^_`{|}~", np.uint8)
_PUNCT = np.array([b for b in range(33, 127) if not chr(b).isalnum()])
_CONTROL = np.array([b for b in range(32) if b not in (9, 10, 13)] + [127])
_STEP = 1 << 20


def features(text: str | None) -> list[float]:
    """The numbers that describe a text; those of an empty one are zeros."""
    data = (text or "").encode()
    words = (text or "").split()
    if not words:
        return [0.0] * len(FEATURES)
    count = sum(np.bincount(np.frombuffer(data, np.uint8, min(_STEP, len(data) - i), i), minlength=256) for i in range(0, len(data), _STEP))
    n, size = len(words), len(data)
    per = lambda which: float(count[which].sum())
    lines = [x for x in text.split("\n") if x.strip()]
    top = Counter(words)
    tails = sum(1 for w in words if not w[-1].isalnum() and w[-1] not in ".,;:?!")
    return [
        math.log1p(size),
        math.log1p(n),
        (size - per([32, 9, 10, 13])) / n,
        per(_UPPER) / max(1.0, per(_ALPHA)),
        sum(map(str.isupper, words)) / n,
        per([33]) / n,
        per([124]) / n,
        per(_MARKS) / n,
        per(_DIGIT) / n,
        per(_PUNCT) / n,
        float(count[128:].sum()) / size,
        len(top) / n**0.8,
        max(top.values()) / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        1 - len(set(lines)) / len(lines),
        math.log1p(size / len(lines)),
        tails / n,
        per([44]) / n,
        per([46, 63]) / n,
        per(_CONTROL) / size,
    ]


@dataclass
class AdditiveModel:
    """Bin edges and a table for each feature, tables for pairs, and the prior's log-odds."""

    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    prior: float = 0.0

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)]

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row of features."""
        if not len(x):
            return np.zeros(0)
        at = self.bins(x)
        total = np.full(len(x), self.prior)
        for b, t in zip(at, self.tables, strict=True):
            total += t[b]
        for i, j, t in self.pairs:
            total += t[self.coarse[i][at[i]], self.coarse[j][at[j]]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _tree(g: np.ndarray, h: np.ndarray, depth: int, rate: float, least: float) -> np.ndarray:
    """A tree over ordered bins from their sums of gradients and curvatures: its value at each bin."""
    out = np.zeros(len(g))
    gain = lambda a, b: a * a / (b + 1.0)

    def grow(lo: int, hi: int, d: int) -> None:
        a, b = g[lo:hi].cumsum(), h[lo:hi].cumsum()
        if d and hi - lo > 1:
            left = gain(a[:-1], b[:-1]) + gain(a[-1] - a[:-1], b[-1] - b[:-1]) - gain(a[-1], b[-1])
            left[(b[:-1] < least) | (b[-1] - b[:-1] < least)] = -1
            k = int(left.argmax())
            if left[k] > 1e-9:
                grow(lo, lo + k + 1, d - 1)
                grow(lo + k + 1, hi, d - 1)
                return
        out[lo:hi] = rate * a[-1] / (b[-1] + 1.0)

    grow(0, len(g), depth)
    return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 40, n_pairs: int = 6, bins: int = 64, coarse: int = 8, rate: float = 0.15, depth: int = 2, least: float = 1.0) -> AdditiveModel:
    """Boost the features in turn, ``rounds`` times, then the ``n_pairs`` pairs whose grid explains most of what is left.

    Labels of one kind alone (or none) give the prior: a constant score.
    """
    k = x.shape[1]
    edges = [np.unique(np.quantile(x[:, f], np.arange(1, bins) / bins)) if len(x) else np.zeros(0) for f in range(k)]
    model = AdditiveModel(edges, [np.zeros(len(e) + 1) for e in edges], prior=float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
    model.coarse = [(np.arange(len(e) + 1) * coarse // (len(e) + 1)) for e in edges]
    if not len(y) or y.min() == y.max():
        return model
    at = model.bins(x)
    total = np.full(len(y), model.prior)
    slope = lambda: (lambda p: (y - p, p * (1 - p)))(1 / (1 + np.exp(-total)))
    for _ in range(rounds):
        for f in range(k):
            g, h = slope()
            size = len(model.tables[f])
            step = _tree(np.bincount(at[f], g, size), np.bincount(at[f], h, size), depth, rate, least)
            model.tables[f] += step
            total += step[at[f]]
    g, h = slope()
    cells = [model.coarse[f][at[f]] for f in range(k)]
    grid = lambda i, j, v: np.bincount(cells[i] * coarse + cells[j], v, coarse * coarse).reshape(coarse, coarse)
    worth = sorted(((float((grid(i, j, g) ** 2 / (grid(i, j, h) + 1)).sum()), i, j) for i in range(k) for j in range(i + 1, k)), reverse=True)
    chosen = [(i, j, np.zeros((coarse, coarse))) for _, i, j in worth[:n_pairs]]
    for _ in range(pair_rounds):
        for i, j, t in chosen:
            g, h = slope()
            a, b = grid(i, j, g), grid(i, j, h)
            rows = _tree(a.sum(1), b.sum(1), 1, 1.0, least)
            cut = np.flatnonzero(np.diff(rows)) + 1  # one split of the first feature, then trees of the second
            step = np.zeros_like(t)
            for lo, hi in zip([0, *cut], [*cut, coarse], strict=True):
                step[lo:hi] = _tree(a[lo:hi].sum(0), b[lo:hi].sum(0), depth, rate, least)
            t += step
            total += step[cells[i], cells[j]]
    model.pairs = chosen
    return model


def held_out(id_col: str):
    """Rows whose labels are never learnt: crc32 of the id as text, modulo 4, is 2 (null ids: false)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 20_000) -> AdditiveModel:
    """Fit on ``sample`` labelled rows at most (the bound on what reaches the driver), chosen by a hash of the id.

    Held-out rows, null labels and null ids are left out; of several labels of an id the smallest counts, and
    of several texts that with the smallest features, so that what is learnt never depends on the rows' order.
    """
    ship(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out("id")).groupBy("id").agg(F.min("y").alias("y"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    found = rows.mapInArrow(tidied(_features_of), T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("y", T.IntegerType()), T.StructField("x", T.ArrayType(T.DoubleType()))]))
    found = found.groupBy("id").agg(F.min(F.struct("y", "x")).alias("one")).select("id", "one.*").collect()
    found.sort(key=lambda r: (r.id, r.y, r.x))
    return fit(np.array([r.x for r in found], dtype=float).reshape(-1, len(FEATURES)), np.array([r.y for r in found], dtype=float))


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [features(t.as_py()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y").cast(pa.int32()), pa.array(made, pa.list_(pa.float64()))], names=["id", "y", "x"])


def with_score(docs: DataFrame, model: AdditiveModel, text_col: str = "text", score_col: str = "score", keep_text: bool = False) -> DataFrame:
    """``docs`` with the score of each whole text; the text itself goes unless it is to be kept.

    Null and empty texts are scored as texts without words. Other columns pass through.
    """
    fields = [f for f in docs.schema.fields if keep_text or f.name != text_col]
    schema = T.StructType([*fields, T.StructField(score_col, T.DoubleType())])
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(batch.schema.get_field_index(text_col))], dtype=float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(model.score(x))], names=[*names, score_col])

    return docs.mapInArrow(tidied(run), schema)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", least: float = 0.7, sample: int = 20_000) -> DataFrame:
    """(id, held_out, score, predicted) for every row of ``docs``; predicted is 1 from a score of ``least`` on."""
    model = train(docs, labels, id_col, text_col, label_col, sample)
    scored = with_score(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), model)
    return scored.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", least: float = 0.7, sample: int = 20_000) -> DataFrame:
    """The rows of ``docs``, with their columns, whose score is ``least`` or more."""
    model = train(docs, labels, id_col, text_col, label_col, sample)
    (score,) = fresh(docs, "score")
    return with_score(docs, model, text_col, score, keep_text=True).where(F.col(score) >= least).drop(score)
