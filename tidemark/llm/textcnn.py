"""Toxicity by a convolutional text classifier (operator 3).

A word's vector is the sum of two rows of two hashed embedding tables. Filters of several widths run
over the words, each keeps its maximum over the whole text, and a logistic unit joins them. Trained in
the tasks on all labelled rows, in rounds: each shard of them goes on from the common model, and the changes
are averaged by parameter. Applied to whole texts in the tasks.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import InitVar, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_TABLE, SPACE, SpanHash, arrow_type, batch, blocks, fold_of, staged, words
from .exact_dedup import _ddl
from .sample import labelled_rows

#: Words end at white space, control characters and ASCII punctuation.
STOPS = SPACE.copy()
STOPS[:0x30] = True
STOPS[0x3A:0x41] = True
STOPS[0x5B:0x61] = True
STOPS[0x7B:0x80] = True


def word_ids(raw: np.ndarray, off: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the two tables for each word of a block, and each text's first word (n + 1 values)."""
    data = LOWER_TABLE[raw]
    start, end, first = words(data, off, STOPS)
    h = SpanHash(data).of(start, end)
    mask = np.uint64((1 << bits) - 1)
    return (h & mask).astype(np.int32), ((h >> np.uint64(32)) & mask).astype(np.int32), first


@dataclass
class TextCNN:
    bits: int = 16
    dim: int = 12
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8
    seed: int = 7
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.5

    def __post_init__(self) -> None:
        rng = np.random.default_rng(self.seed)
        normal = lambda *shape: rng.normal(0, 1, shape).astype(np.float32)
        self.tables = [0.05 * normal(1 << self.bits, self.dim) for _ in range(2)]
        self.conv = [normal(w, self.dim, self.filters) / np.float32(np.sqrt(self.dim)) for w in self.widths]
        self.conv_bias = np.zeros(len(self.widths) * self.filters, np.float32)
        self.out = 0.5 * np.abs(normal(len(self.widths) * self.filters))
        self.out[::2] *= -1
        self.bias = np.float32(0)

    def _pad(self, a: np.ndarray, b: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """Word vectors with max(widths) zero rows behind each text, each text's first row, and the rows
        at which no window of the text begins."""
        pad, n = max(self.widths), np.diff(first)
        starts = first[:-1] + np.arange(len(n)) * pad
        at = np.arange(len(a)) + np.repeat(np.arange(len(n)) * pad, n)
        x = np.zeros((len(a) + len(n) * pad, self.dim), np.float32)
        x[at] = self.tables[0][a]
        x[at] += self.tables[1][b]
        idle = np.ones(len(x), bool)
        idle[at] = False
        idle[starts[n == 0]] = False  # a text without words has one window of zeros
        return x, starts, idle, at

    def _maps(self, x: np.ndarray, idle: np.ndarray) -> Iterator[np.ndarray]:
        for w, kernel in zip(self.widths, self.conv, strict=True):
            z = x @ kernel[0]
            for k in range(1, w):
                z[:-k] += x[k:] @ kernel[k]
            z[idle] = -np.inf
            yield z

    def logits(self, a: np.ndarray, b: np.ndarray, first: np.ndarray) -> np.ndarray:
        if len(first) == 1:
            return np.zeros(0)
        x, starts, idle, _ = self._pad(a, b, first)
        top = np.concatenate([np.maximum.reduceat(z, starts, axis=0) for z in self._maps(x, idle)], axis=1)
        return np.maximum(top + self.conv_bias, 0) @ self.out + self.bias

    def score(self, a: np.ndarray, b: np.ndarray, first: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(a, b, first).astype(np.float64), -40, 40)))

    def fit(self, texts: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, weight: np.ndarray, epochs: int = 5, size: int = 64, rate: float = 0.05, decay: float = 1e-4) -> None:
        """Mini-batches of some texts, in an order drawn anew for each epoch."""
        rng = np.random.default_rng(self.seed)
        sums = Sums(self)
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // size)):
                self.learn(sums, [texts[i] for i in part], y[part], weight[part], rate, decay)

    def learn(self, sums: Sums, texts: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, weight: np.ndarray, rate: float = 0.05, decay: float = 1e-4) -> None:
        """A step of Adagrad; a filter's gradient goes to the window that gave its maximum."""
        a, b = (np.concatenate([t[k] for t in texts]) for k in (0, 1))
        first = np.concatenate([[0], np.cumsum([len(t[0]) for t in texts])])
        grads, dx = self.gradients(a, b, first, y, weight)
        for name, value in self._params().items():
            grad = grads[name] + (0 if name == "conv_bias" else decay * value)
            sums.dense[name] += grad**2
            value -= (rate * grad / np.sqrt(sums.dense[name])).astype(np.float32)
        self.bias -= np.float32(rate * grads["bias"])
        used = np.abs(dx).sum(1) > 0
        for table, held, ids in zip(self.tables, sums.rows, (a[used], b[used]), strict=True):
            rows, back = np.unique(ids, return_inverse=True)
            d = np.zeros((len(rows), self.dim), np.float32)
            np.add.at(d, back, dx[used])
            held[rows] += (d**2).mean(1, keepdims=True)
            table[rows] -= rate * d / np.sqrt(held[rows])

    def state(self, sums: Sums) -> np.ndarray:
        """All parameters as rows of ``dim + 1`` values: each row of the two tables with its sum of squares, then the others
        and their sums, filled up with zeros."""
        rest = np.concatenate([*[v.ravel() for v in self._params().values()], [self.bias], *[v.ravel() for v in sums.dense.values()]]).astype(np.float32)
        rest = np.append(rest, np.zeros(-len(rest) % (self.dim + 1), np.float32)).reshape(-1, self.dim + 1)
        return np.concatenate([*[np.hstack([t, r]) for t, r in zip(self.tables, sums.rows, strict=True)], rest])

    def restore(self, sums: Sums, state: np.ndarray) -> None:
        """Takes what ``state`` gave."""
        n = 1 << self.bits
        for i in range(2):
            self.tables[i], sums.rows[i] = state[i * n : (i + 1) * n, :-1].copy(), state[i * n : (i + 1) * n, -1:].copy()
        rest, at = state[2 * n :].ravel(), 0
        for value in [*self._params().values(), None, *sums.dense.values()]:
            if value is None:
                self.bias, at = np.float32(rest[at]), at + 1
            else:
                value[...], at = rest[at : at + value.size].reshape(value.shape), at + value.size

    def gradients(self, a: np.ndarray, b: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the mean weighted log loss by the parameters, and by each word's vector."""
        x, starts, idle, at = self._pad(a, b, first)
        text_of = np.repeat(np.arange(len(first) - 1), np.diff(np.append(starts, len(x))))
        maps = list(self._maps(x, idle))
        tops = [np.maximum.reduceat(z, starts, axis=0) for z in maps]
        raw = np.concatenate(tops, axis=1) + self.conv_bias
        h = np.maximum(raw, 0)
        p = 1 / (1 + np.exp(-np.clip(h @ self.out + self.bias, -40, 40)))
        g = ((p - y) * weight / len(y)).astype(np.float32)
        gh = g[:, None] * self.out * (raw > 0)
        out = {"conv_bias": gh.sum(0), "out": h.T @ g, "bias": g.sum()}
        dx = np.zeros_like(x)
        for i, (w, z, top) in enumerate(zip(self.widths, maps, tops, strict=True)):
            dk = np.zeros_like(self.conv[i])
            for f in range(self.filters):
                hit = np.flatnonzero(z[:, f] == top[text_of, f])
                _, one = np.unique(text_of[hit], return_index=True)
                pos, gf = hit[one], gh[:, i * self.filters + f]
                for k in range(w):
                    dk[k, :, f] += x[pos + k].T @ gf
                    dx[pos + k] += gf[:, None] * self.conv[i][k, :, f]
            out[f"conv{i}"] = dk
        return out, dx[at]

    def _params(self) -> dict[str, np.ndarray]:
        return {f"conv{i}": c for i, c in enumerate(self.conv)} | {"conv_bias": self.conv_bias, "out": self.out}

    def calibrate(self, scores: np.ndarray, y: np.ndarray, weight: np.ndarray, langs: list, precision: float, least: int = 25, counts: np.ndarray | None = None) -> None:
        """For each language the lowest threshold from which on the weighted precision is reached;
        languages with fewer than ``least`` rows of label 1 take the one over all rows. An item stands for ``counts`` rows."""
        counts = np.ones(len(y)) if counts is None else counts
        weight = weight * counts

        def lowest(pick: np.ndarray) -> float:
            s, t, w = scores[pick], y[pick], weight[pick]
            order = np.argsort(-s, kind="stable")
            good = np.cumsum((t * w)[order]) / np.cumsum(w[order])
            last = np.append(np.diff(s[order]) != 0, True)
            ok = np.flatnonzero((good >= precision) & last)
            if not len(ok):
                return 0.5
            below = s[order][ok[-1] + 1] if ok[-1] + 1 < len(s) else 0.0
            return float((s[order][ok[-1]] + below) / 2)

        if len(y):
            self.threshold = lowest(np.ones(len(y), bool))
            of = np.array([x or "" for x in langs])
            self.thresholds = {str(x): lowest(of == x) for x in np.unique(of) if (y * counts)[of == x].sum() >= least}


@dataclass
class Sums:
    """Sums of squared gradients, by which Adagrad divides its steps."""

    model: InitVar[TextCNN]

    def __post_init__(self, model: TextCNN) -> None:
        self.dense = {k: np.full_like(v, 1e-6) for k, v in model._params().items()}
        self.rows = [np.full((1 << model.bits, 1), 1e-6, np.float32) for _ in range(2)]


#: Labelled rows that one task learns from in a round, rows of a step, and words from which on a step takes fewer rows.
SHARD_ROWS, STEP_ROWS, STEP_WORDS = 8192, 64, 1 << 20
#: Changes are summed as integers of this unit, so that their sum does not depend on the order of the tasks.
UNIT = 2.0**-32
#: Thresholds are sought among this many equal steps of the score.
SCORE_STEPS = 1 << 16


def _lists(column: pa.Array) -> list[np.ndarray]:
    flat, off = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[lo - off[0] : hi - off[0]] for lo, hi in zip(off[:-1], off[1:], strict=True)]


def _round(rows: DataFrame, model: TextCNN, sums: Sums, weights: tuple[float, float]) -> None:
    """Each shard of ``rows`` (written shard by shard) is learned from, beginning with the common model; the changes of
    a parameter are averaged over the shards that changed it. What comes back is one model's size, whatever ``rows`` is."""
    shared = rows.sparkSession.sparkContext.broadcast((model, sums))
    width = model.dim + 1
    schema = pa.schema([("key", pa.int32()), *[(f"v{i}", pa.int64()) for i in range(width)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, shard, m, held = shared.value[0].state(shared.value[1]), None, None, []

        def step() -> None:
            if held:
                y = np.array([h[2] for h in held], np.float64)
                m[0].learn(m[1], [h[:2] for h in held], y, np.where(y == 1, weights[1], weights[0]))
                held.clear()

        def changes() -> Iterator[pa.RecordBatch]:
            if m is not None:
                step()
                change = np.rint((m[0].state(m[1]).astype(np.float64) - start) / UNIT).astype(np.int64)
                at = np.flatnonzero(change.any(1))
                yield batch(schema, at, *[change[at, i] for i in range(width)])

        for x in batches:
            for s, y, a, b in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), _lists(x.column(2)), _lists(x.column(3)), strict=True):
                if s != shard:
                    yield from changes()
                    shard, m = s, copy.deepcopy(shared.value)
                if len(held) == STEP_ROWS or sum(len(h[0]) for h in held) + len(a) > STEP_WORDS:
                    step()
                held.append((a, b, y))
        yield from changes()

    got = rows.select("shard", "label", "a", "b").mapInArrow(run, _ddl(schema)).groupBy("key").agg(F.count("*").alias("n"), *[F.sum(f"v{i}").alias(f"v{i}") for i in range(width)]).toArrow()
    state = model.state(sums)
    change = np.stack([got[f"v{i}"].to_numpy() for i in range(width)], 1) * UNIT / got["n"].to_numpy()[:, None]
    state[got["key"].to_numpy()] += change.astype(np.float32)
    model.restore(sums, state)
    shared.destroy()


def _score_counts(rows: DataFrame, model: TextCNN) -> DataFrame:
    """(lang, label, step, n): how many rows have a score in each of SCORE_STEPS steps."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("lang", pa.string()), ("label", pa.int32()), ("step", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            none = np.zeros(0, np.int32)
            s = np.concatenate([none, *[shared.value.score(a, b, np.array([0, len(a)])) for a, b in zip(_lists(x.column(2)), _lists(x.column(3)), strict=True)]])
            yield batch(schema, x.column(0), x.column(1), np.minimum(s * SCORE_STEPS, SCORE_STEPS - 1).astype(np.int32))

    return rows.select("lang", "label", "a", "b").mapInArrow(run, _ddl(schema)).groupBy("lang", "label", "step").agg(F.count("*").alias("n"))


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic", precision: float = 0.98, bits: int = 16, epochs: int = 5) -> TextCNN:
    """A classifier from all labelled rows and their whole texts. Null texts are empty. Four fifths train it, by the hash of
    the id, in rounds over shards of some SHARD_ROWS rows; one fifth, in full, sets its thresholds. The driver holds
    the model and a count for each language, label and step of the score. Without labels it scores 0.5
    everywhere, rejecting none."""
    found, share = labelled_rows(docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"), F.col(lang_col).cast("string").alias("__lang")), labels, id_col, label_col)
    ints = pa.list_(pa.int32())
    schema = pa.schema([("order", pa.int64()), ("label", pa.int32()), ("lang", pa.string()), ("a", ints), ("b", ints)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for lo, hi, raw, off in blocks(x.column(3)):
                a, b, first = word_ids(raw, off, bits)
                lists = [pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(v)) for v in (a, b)]
                yield batch(schema, *[x.column(i).slice(lo, hi - lo) for i in range(3)], *lists)

    rows = staged(found.select("order", "label", "__lang", F.coalesce("__text", F.lit("")).alias("__text")).mapInArrow(run, _ddl(schema)), "labelled")
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    model = TextCNN(bits=bits)
    if n == 0 or ones in (0, n):
        model.out[:], model.threshold = 0, 2.0
        return model
    weights = (1 - share) / (1 - ones / n), share / (ones / n)
    held = (F.pmod(F.xxhash64("order"), F.lit(5)) == 4) if n >= 50 else F.lit(False)
    shards = -(-n // SHARD_ROWS)
    of = F.pmod("order", F.lit(shards)).cast("int")
    sums, dealt = Sums(model), staged(rows.filter(~held).withColumn("shard", of).repartitionById(shards, "shard").sortWithinPartitions("shard", "order", "label").select("shard", "label", "a", "b"), "shards")
    for _ in range(epochs):
        _round(dealt, model, sums, weights)
    got = _score_counts(rows.filter(held), model).toArrow()
    y = got["label"].to_numpy().astype(np.float64)
    model.calibrate((got["step"].to_numpy() + 0.5) / SCORE_STEPS, y, np.where(y == 1, weights[1], weights[0]), got["lang"].to_pylist(), precision, counts=got["n"].to_numpy())
    return model


def score_toxicity(docs: DataFrame, model: TextCNN, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", extra: tuple[str, ...] = ()) -> DataFrame:
    """id, ``extra`` columns, ``score`` and ``rejected`` (score reaches the threshold of the row's language;
    unknown or null languages take the common one) for each row. Whole texts; no shuffle. Null and empty texts
    get the score of one window of zeros; repeated rows are scored each for itself, an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few MB, whatever the corpus is
    kept = [id_col, *extra]
    schema = pa.schema([*[(c, arrow_type(docs, c)) for c in kept], ("score", pa.float64()), ("rejected", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for x in batches:
            langs = x.column(x.num_columns - 2).to_pylist()
            for lo, hi, raw, off in blocks(x.column(x.num_columns - 1)):
                s = m.score(*word_ids(raw, off, m.bits))
                limit = np.array([m.thresholds.get(v, m.threshold) for v in langs[lo:hi]])
                yield batch(schema, *[x.column(i).slice(lo, hi - lo) for i in range(len(kept))], s, s >= limit)

    cols = [*kept, F.col(lang_col).cast("string").alias("__lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text")]
    return docs.select(*cols).mapInArrow(run, _ddl(schema))


def op3_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of ``documents``, learned from three of four folds: doc_id, held_out, score, predicted and
    ``rejected`` (by the threshold of the row's language)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("held_out", fold_of("doc_id", 4) == 2)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(fold_of("doc_id", 4) != 2)
    model = fit_toxicity(docs, labels)
    scored = score_toxicity(docs, model, extra=("held_out",))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "rejected")
