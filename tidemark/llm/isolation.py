"""Quality rules by an isolation forest on rule statistics (operator 12).

Each text gives counts, and from them shares that do not depend on its length. Fixed rules drop texts that are too
short or repeat themselves. An isolation forest, fitted on good labelled texts, tells how few random splits it takes
to part a text from those, where splits may also fall beyond their range; the threshold from which a text counts
as an anomaly is calibrated on all labelled texts, for each band of lengths.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_type, batch, staged
from .exact_dedup import _ddl
from .sample import labelled_sample

SYMBOLS = b"#*$%&|<>"  # a fixed value of the query
_SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"  # what bytes.split() splits at
_INSIDE = bytes(range(0x80, 0xC0))
_UPPER, _LETTERS = bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123)])
_DIGITS, _POINTS, _CALLS = b"0123456789", b".,;:", b"!?"
WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_digits", "n_points", "n_calls")
#: Upper ends of the bands of lengths in words; a last band has no end.
BANDS = (100, 1000)
#: Bins of a score from 0 to 1 for calibration.
BINS = 1000


def _pieces(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """The text in pieces that end at white space, of ``size`` bytes where words are shorter."""
    lo = 0
    while lo < len(data):
        hi = lo + size
        while hi < len(data) and data[hi] not in _SPACES:
            hi += 1
        yield data[lo:hi]
        lo = hi


def repeated_words(words: np.ndarray, size: int = WINDOW) -> int:
    """How many words lie in windows of ``size`` (a power of two) that occur twice or more. Windows are numbered by
    doubling: equal numbers of two halves make equal numbers of the whole, so nothing is hashed."""
    if len(words) < size:
        return 0
    number, width = words.astype(np.int64), 1
    while width < size:
        pair = number[:-width] * np.int64(len(words) + 1) + number[width:]
        different, number = np.unique(pair, return_inverse=True)
        if len(different) == len(pair):
            return 0
        width *= 2
    again = np.flatnonzero(np.bincount(number)[number] > 1)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, again, 1)
    np.add.at(change, again + size, -1)
    return int((np.cumsum(change[:-1]) > 0).sum())


def counts(data: bytes) -> tuple[int, ...]:
    """The COUNTS of one text. Words are what stands between white space; a line counts if it has a word."""
    seen: dict[bytes, None] = {}
    for p in _pieces(data):
        seen.update(dict.fromkeys(p.split()))
    number = dict(zip(seen, range(len(seen)), strict=True))
    words = np.concatenate([np.zeros(0, np.int32), *(np.fromiter(map(number.__getitem__, p.split()), np.int32) for p in _pieces(data))])
    lines = [x for x in data.split(b"\n") if x.strip(_SPACES)]
    without = lambda drop: len(data.translate(None, drop))
    n = len(data)
    return (
        len(words), without(_INSIDE + _SPACES), n - without(SYMBOLS), len(lines) - len(set(lines)), repeated_words(words), len(lines),
        n - without(_UPPER), n - without(_LETTERS), n - without(_DIGITS), n - without(_POINTS), n - without(_CALLS),
    )


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: the id, ``extra`` columns and COUNTS; a null text has none. Rows stay where they are
    read. A text needs some sixty bytes of memory for each of its words while it is counted."""
    kept = [id_col, *extra]
    schema = pa.schema([*[(f"k{i}", arrow_type(docs, c)) for i, c in enumerate(kept)], *[(c, pa.int64()) for c in COUNTS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [counts(t.as_buffer().to_pybytes()) for t in b.column(b.num_columns - 1)]
            if rows:
                yield batch(schema, *[b.column(i) for i in range(len(kept))], *map(list, zip(*rows, strict=True)))

    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    out = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(kept)], text).mapInArrow(run, _ddl(schema))
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], *COUNTS)


def base_failed(least_words: int = 20, most_repeated: int = 30) -> Column:
    """Fewer than ``least_words`` words, or more than ``most_repeated`` of 100 in repeated windows."""
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))


def shares() -> list[Column]:
    """What the forest looks at: numbers that a longer text of the same kind shares."""
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return [
        ratio("word_chars", "n_words"), ratio("n_symbols", "n_words"), ratio("n_dup_lines", "n_lines"), ratio("n_repeat_words", "n_words"),
        ratio("n_upper", "n_letters"), ratio("n_digits", "word_chars"), ratio("n_points", "n_words"), ratio("n_calls", "n_words"),
    ]


#: How far around the sample's range of each of ``shares`` splits may fall.
MARGINS = np.array([1.0, 0.2, 0.1, 0.05, 0.1, 0.05, 0.1, 0.1])


def _mean_path(n: np.ndarray) -> np.ndarray:
    """The mean path length of a search that fails in a tree of ``n`` rows."""
    m = np.maximum(n, 2).astype(float)
    return np.where(n > 2, 2 * (np.log(m - 1) + np.euler_gamma) - 2 * (m - 1) / m, np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees of one array each; of a leaf, ``at`` is its path length."""

    feature: np.ndarray  # (trees, nodes), -1: a leaf
    at: np.ndarray
    left: np.ndarray  # the right child follows the left one
    norm: float

    @classmethod
    def fit(cls, rows: np.ndarray, trees: int, size: int, margins: np.ndarray, seed: int = 0) -> Forest | None:
        """``trees`` trees over ``size`` of ``rows`` each (all, if there are fewer), split at random until rows are alone
        or a depth of log2(size) is reached; None without two rows."""
        if len(rows) < 2:
            return None
        rng = np.random.default_rng(seed)
        size = min(size, len(rows))
        deepest = math.ceil(math.log2(size))
        made = [cls._tree(rows[rng.choice(len(rows), size, replace=False)], deepest, margins, rng) for _ in range(trees)]
        nodes = max(len(t) for t in made)
        table = np.zeros((trees, nodes, 3))
        table[:, :, 0] = -1
        for k, t in enumerate(made):
            table[k, : len(t)] = t
        return cls(table[:, :, 0].astype(np.int32), table[:, :, 1], table[:, :, 2].astype(np.int32), float(_mean_path(np.array([size]))[0]))

    @staticmethod
    def _tree(rows: np.ndarray, deepest: int, margins: np.ndarray, rng: np.random.Generator) -> list[tuple]:
        """Splits fall anywhere in a node's box, at the root the rows' own one widened by ``margins`` and a quarter, so
        that what lies outside of all good rows, which may agree in a value, is parted from them soon."""
        low, high = rows.min(0), rows.max(0)
        wide = (high - low) / 4 + margins
        out: list[tuple] = [()]
        todo = [(0, rows, 0, np.maximum(low - wide, 0), high + wide)]
        while todo:
            k, own, depth, low, high = todo.pop()
            if depth == deepest or len(own) < 2:
                out[k] = (-1, depth + float(_mean_path(np.array([len(own)]))[0]), 0)
                continue
            f = int(rng.integers(rows.shape[1]))
            cut = rng.uniform(low[f], high[f])
            below = own[:, f] <= cut
            out[k] = (f, cut, len(out))
            middle = np.arange(rows.shape[1]) == f
            todo += [(len(out), own[below], depth + 1, low, np.where(middle, cut, high)), (len(out) + 1, own[~below], depth + 1, np.where(middle, cut, low), high)]
            out += [(), ()]
        return out

    def score(self, rows: np.ndarray) -> np.ndarray:
        """From 0 to 1: the shorter the mean path, the higher."""
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for feature, at, left in zip(self.feature, self.at, self.left, strict=True):
            node = np.zeros(len(rows), np.int64)
            live = every if feature[0] >= 0 else every[:0]
            while len(live):
                n = node[live]
                node[live] = left[n] + (rows[live, feature[n]] > at[n])
                live = live[feature[node[live]] >= 0]
            total += at[node]
        return np.exp2(-total / len(self.feature) / self.norm)


def anomaly(rows: DataFrame, forest: Forest | None, values: list[Column] | None = None) -> DataFrame:
    """``rows``, with all columns, and ``anomaly``: the forest's score of ``values`` (0.5 without a forest)."""
    shared = rows.sparkSession.sparkContext.broadcast(forest)  # trees * 2 * size nodes at most

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        for x in batches:
            if own is None:
                yield pa.array(np.full(len(x), 0.5))
            else:
                flat = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
                yield pa.array(np.concatenate([np.zeros(0), *(own.score(flat[i : i + 20_000]) for i in range(0, len(flat), 20_000))]))

    return rows.withColumn("anomaly", score(F.array(*(values or shares()))))


def band() -> Column:
    out = F.when(F.col("n_words") < BANDS[0], 0)
    for k, end in enumerate(BANDS[1:], 1):
        out = out.when(F.col("n_words") < end, k)
    return out.otherwise(len(BANDS))


def thresholds(scored: DataFrame, labels: DataFrame, id_col: str, label_col: str, most_lost: float = 0.01, weight: float = 10.0, least: int = 50) -> list[float]:
    """The threshold of each band, from all labelled rows that pass the base rules: of those scores from which on at most
    ``most_lost`` of the good rows lie, the one with the largest share of bad rows less ``weight`` times that of good
    ones; 2.0, which nothing reaches, if none has a gain. A band with fewer than ``least`` good or bad rows takes the
    threshold of all. A row with contradicting labels counts as good; only counts per bin come to the driver."""
    once = labels.filter(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("l_id")).agg(F.max(label_col).alias("l_good"))
    bins = scored.filter(~F.col("base_failed")).select(F.col(id_col).alias("s_id"), band().alias("s_band"), F.floor(F.col("anomaly") * BINS).cast("int").alias("s_bin"))
    found = bins.join(once, F.col("s_id") == F.col("l_id")).groupBy("s_band", "s_bin", "l_good").count().collect()
    table = np.zeros((len(BANDS) + 1, 2, BINS + 1))
    for b, k, good, n in found:
        table[b, good, k] += n

    def best(bad: np.ndarray, good: np.ndarray) -> float:
        lost, caught = (np.cumsum(x[::-1])[::-1] / max(x.sum(), 1) for x in (good, bad))
        gain = np.where(lost <= most_lost, caught - weight * lost, -1.0)
        k = int(gain.argmax())
        return k / BINS if gain[k] > 0 else 2.0

    overall = best(*table.sum(0))
    return [best(*t) if t.sum(1).min() >= least else overall for t in table]


def keep_normal(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", extra: tuple[str, ...] = (), most_rows: int = 8192, trees: int = 128, size: int = 256) -> DataFrame:
    """One row per row of ``docs``: the id, ``extra``, COUNTS, ``base_failed``, ``anomaly`` (0 to 1), and ``kept``.

    The forest is fitted on at most ``most_rows`` rows labelled good (1) that pass the base rules, those with the smallest
    id hashes, ``size`` of them a tree; counts, scores and thresholds cover all rows. A null or empty text fails the
    base rules. Without good labels, or without bad ones, nothing but the base rules drops a row. Rows that repeat an
    id are rows of their own, each with that id's label."""
    rules = staged(statistics(docs, id_col, text_col, extra).withColumn("base_failed", base_failed()), "rules")
    usable = rules.filter(~F.col("base_failed")).select(F.col(id_col).alias("doc"), F.array(*shares()).alias("values"))
    good = labels.filter(F.col(label_col) == 1)
    sample = labelled_sample(usable, good.select(F.col(id_col).alias("doc"), F.col(label_col).alias("y")), "doc", "y", most_rows)[0]
    values = sample.orderBy("order", "doc").select("values").toArrow()["values"].to_pylist()
    scored = staged(anomaly(rules, Forest.fit(np.array(values, float).reshape(-1, len(MARGINS)), trees, size, MARGINS)), "anomaly")
    limits = thresholds(scored, labels, id_col, label_col)
    limit = F.element_at(F.array(*[F.lit(x) for x in limits]), band() + 1)
    # the same bins as in calibration
    return scored.withColumn("kept", ~F.col("base_failed") & (F.floor(F.col("anomaly") * BINS) / BINS < limit))


def op12_isolation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of ``documents``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept and anomaly; thresholds come from ``labels.quality``."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return keep_normal(docs, labels).select("doc_id", *COUNTS[:5], "base_failed", "kept", "anomaly")
