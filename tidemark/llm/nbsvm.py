"""Quality by naive-Bayes support vectors (operator 6).

Features are indicators of hashed n-grams: words, pairs of words and byte trigrams. Each is scaled by
the log ratio of its smoothed shares in the two classes; on top a linear model minimises the squared
hinge loss by dual coordinate descent, and a logistic curve turns its margin into a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_TABLE, SpanHash, arrow_type, batch, blocks, fold_of, mix, segment_sum, words
from .exact_dedup import _ddl
from .sample import labelled_sample, within


def features(raw: np.ndarray, off: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct feature numbers of each text of a block, and each text's first (n + 1 values)."""
    data, rows = LOWER_TABLE[raw], len(off) - 1
    start, end, first = words(data, off)
    h = SpanHash(data).of(start, end)
    text = np.repeat(np.arange(rows), np.diff(first))
    pair = text[1:] == text[:-1]
    two = mix(h[:-1] * np.uint64(3) + h[1:])[pair]
    of = np.repeat(np.arange(rows), np.diff(off))
    d = data.astype(np.uint64)
    tri = d[:-2] | (d[1:-1] << np.uint64(8)) | (d[2:] << np.uint64(16)) if len(d) > 2 else d[:0]
    same = of[2:] == of[:-2] if len(d) > 2 else np.zeros(0, bool)
    mask = np.uint64((1 << bits) - 1)
    key = np.concatenate([h & mask, two & mask, mix(tri[same]) & mask]).astype(np.int64)
    at = np.concatenate([text, text[1:][pair], of[2:][same] if len(d) > 2 else of[:0]])
    both = np.unique((at << bits) | key)
    return (both & ((1 << bits) - 1)).astype(np.int32), np.searchsorted(both, np.arange(rows + 1) << bits)


@dataclass
class NBSVM:
    """``weights`` hold the SVM's weights times the log-count ratios; ``slope`` and ``shift`` the curve."""

    bits: int
    weights: np.ndarray
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def margins(self, keys: np.ndarray, first: np.ndarray) -> np.ndarray:
        n = np.maximum(np.diff(first), 1)
        return segment_sum(self.weights[keys], first) / np.sqrt(n) + self.bias

    def score(self, keys: np.ndarray, first: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(keys, first) + self.shift, -40, 40)))


def log_count_ratios(texts: list[np.ndarray], y: np.ndarray, size: int) -> np.ndarray:
    """For each feature the log of its share among the indicators of class 1 over that of class 0, one added to each."""
    counts = []
    for c in (0, 1):
        n = np.bincount(np.concatenate([*[t for t, z in zip(texts, y, strict=True) if z == c], np.zeros(0, np.int32)]), minlength=size) + 1.0
        counts.append(n / n.sum())
    return np.log(counts[1] / counts[0])


def dual_coordinate_descent(texts: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, size: int, epochs: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear SVM with squared hinge loss (Hsieh and others, 2008)."""
    w, bias = np.zeros(size), 0.0
    alpha, diag = np.zeros(len(y)), 0.5 / cost
    norm = np.array([v @ v for v in values]) + 1.0 + diag
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(y)):
            g = y[i] * (w[texts[i]] @ values[i] + bias) - 1 + diag[i] * alpha[i]
            pg = min(g, 0.0) if alpha[i] == 0 else g
            if pg:
                worst = max(worst, abs(pg))
                new = max(alpha[i] - g / norm[i], 0.0)
                w[texts[i]] += (new - alpha[i]) * y[i] * values[i]
                bias += (new - alpha[i]) * y[i]
                alpha[i] = new
        if worst < 1e-3:
            break
    return w, bias


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = 3000, max_features: int = 60_000, max_total: int = 10_000_000, bits: int = 18, cost: float = 1.0) -> NBSVM:
    """A classifier from at most ``per_class`` labelled rows of each class with up to ``max_features``
    distinct features each (longer ones are not learned from) and ``max_total`` together, which bounds what the
    driver holds to 40 MB. Null texts are empty. Ratios and weights come from four fifths,
    the logistic curve from one fifth; rows are weighted to the classes' true shares. Where labels of
    both classes are missing, the score is the share of label 1."""
    sample, share = labelled_sample(docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text")), labels, id_col, label_col, per_class)
    schema = pa.schema([("order", pa.int64()), ("label", pa.int32()), ("keys", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for lo, hi, raw, off in blocks(x.column(2)):
                keys, first = features(raw, off, bits)
                yield batch(schema, x.column(0).slice(lo, hi - lo), x.column(1).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(keys)))

    got = within(sample.select("order", "label", "__text").mapInArrow(run, _ddl(schema)).filter(F.size("keys") <= max_features), "keys", max_total).toArrow().sort_by([("order", "ascending"), ("label", "ascending")])
    y = got["label"].to_numpy().astype(np.float64)
    size = 1 << bits
    if len(y) == 0 or y.min() == y.max():
        p = min(max(share, 1e-6), 1 - 1e-6)
        return NBSVM(bits, np.zeros(size, np.float32), shift=float(np.log(p / (1 - p))))
    texts = [k.values.to_numpy(zero_copy_only=False) for k in got["keys"]]
    check = np.arange(len(y)) % 5 == 4 if len(y) >= 50 else np.zeros(len(y), bool)
    train = np.flatnonzero(~check)
    ratio = log_count_ratios([texts[i] for i in train], y[train], size)
    scaled = [ratio[texts[i]] / np.sqrt(max(len(texts[i]), 1)) for i in train]
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    w, bias = dual_coordinate_descent([texts[i] for i in train], scaled, 2 * y[train] - 1, cost * weight[train], size)
    model = NBSVM(bits, (w * ratio).astype(np.float32), bias)
    held = np.flatnonzero(check) if check.any() else train
    m = np.concatenate([model.margins(texts[i], np.array([0, len(texts[i])])) for i in held])
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton's method for the logistic curve, with a little ridge
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -40, 40)))
        r, q = weight[held] * (p - y[held]), weight[held] * p * (1 - p)
        hess = np.array([[(q * m * m).sum() + 1e-3, (q * m).sum()], [(q * m).sum(), q.sum() + 1e-3]])
        a, b = np.array([a, b]) - np.clip(np.linalg.solve(hess, [(r * m).sum() + 1e-3 * (a - 1), r.sum()]), -2, 2)
    model.slope, model.shift = float(max(a, 1e-3)), float(b)
    return model


def score_quality(docs: DataFrame, model: NBSVM, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """id, ``extra`` columns and ``score`` for each row, from its whole text; no shuffle. Null and empty texts get
    the score of no features; repeated rows are scored each for itself, an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 1 MB at 18 bits
    kept = [id_col, *extra]
    schema = pa.schema([*[(c, arrow_type(docs, c)) for c in kept], ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for x in batches:
            for lo, hi, raw, off in blocks(x.column(x.num_columns - 1)):
                yield batch(schema, *[x.column(i).slice(lo, hi - lo) for i in range(len(kept))], m.score(*features(raw, off, m.bits)))

    return docs.select(*kept, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text")).mapInArrow(run, _ddl(schema))


def op6_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of ``documents``, learned from four of five folds: doc_id, held_out, score and predicted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("held_out", fold_of("doc_id", 5) == 0)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(fold_of("doc_id", 5) != 0)
    model = fit_quality(docs, labels)
    scored = score_quality(docs, model, extra=("held_out",))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
