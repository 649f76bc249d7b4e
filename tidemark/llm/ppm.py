"""Language-model scoring by prediction by partial matching (operator 2).

The model is a byte-context trie of depth ``order`` counted over the training texts. A symbol is one
byte of the lower-cased UTF-8 text, or 0xFF (never a UTF-8 byte) for the end. Escape estimation is
PPM's method C: a context seen n times with d kept symbols gives a symbol counted c the probability
c / (n + d) and the escape the rest; after an escape the next shorter context excludes the symbols
that the longer one could have coded. Below order 0 all remaining symbols are equally likely.

The trie is a table of its nodes, one level per order, and is never cut: it grows with the corpus and
stays distributed. What a symbol costs depends on it and the ``order`` bytes before it alone, so the
levels are joined from the shortest context up into one table of costs for every sequence that occurs.
The sequences with at least 1 / 2**22 of all symbols (2**22 of them at most) are looked up in the tasks,
all others by a join.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER_TABLE, SPACE, SpanHash, arrow_type, batch, blocks, fold_of, mix, segment_sum, staged, words
from .exact_dedup import _ddl

END = 0xFF
#: Words and symbol sequences are broadcast from these shares (1 / 2**bits) of all tokens or symbols on;
#: the others are joined. So no more than 2**bits of them are broadcast, and none of a join's keys is hot.
SHARE_BITS, GRAM_BITS = 20, 22
#: Bytes of text handled at once; each takes about a hundred in arrays.
_BLOCK = 1 << 18
_FREE = np.uint64(0xFFFFFFFFFFFFFFFF)


class HashIndex:
    """Positions of 64-bit keys, by open addressing in numpy arrays."""

    def __init__(self, keys: np.ndarray) -> None:
        bits = max(4, int(2 * len(keys)).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.keys, self.at = np.full(1 << bits, _FREE), np.full(1 << bits, -1, np.int32)
        left, pos = np.arange(len(keys)), mix(keys) & self.mask
        while len(left):
            free = self.at[pos] < 0
            self.at[pos[free]] = left[free]
            won = self.at[pos] == left
            self.keys[pos[won]] = keys[left[won]]
            left, pos = left[~won], (pos[~won] + np.uint64(1)) & self.mask

    def find(self, q: np.ndarray) -> np.ndarray:
        out = np.full(len(q), -1, np.int32)
        pos = mix(q) & self.mask
        have = self.keys[pos]
        hit = have == q
        out[hit] = self.at[pos[hit]]
        left = np.flatnonzero(~hit & (have != _FREE))
        pos = pos[left]
        while len(left):
            pos = (pos + np.uint64(1)) & self.mask
            have = self.keys[pos]
            hit = have == q[left]
            out[left[hit]] = self.at[pos[hit]]
            on = ~hit & (have != _FREE)
            left, pos = left[on], pos[on]
        return out


def symbols(data: np.ndarray, off: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The (order + 1)-byte integer of each symbol of a block, and each row's first (n + 1 values).
    Texts begin after ``order`` zero bytes and end with ``END``."""
    rows, sizes = len(off) - 1, np.diff(off)
    step = order + 1
    x = np.zeros(len(data) + rows * step + order, np.uint8)
    x[np.arange(len(data)) + np.repeat(np.arange(rows) * step + order, sizes)] = data
    x[off[1:] + np.arange(rows) * step + order] = END
    g = np.zeros(len(x) - order, np.uint64)
    for j in range(order + 1):
        g |= x[order - j : len(x) - j].astype(np.uint64) << np.uint64(8 * j)
    first = np.concatenate([[0], np.cumsum(sizes + 1)])
    take = np.arange(first[-1]) + np.repeat(np.arange(rows) * order, sizes + 1)
    return g[take], first


def _parts(arr: pa.Array, order: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]]:
    """(first row, last row + 1, lower-cased bytes, offsets, symbols, each row's first symbol, whether the texts end here) of
    runs of rows; a text longer than a block comes in parts that end before white space, whose symbols know the
    bytes before them, so that what a task holds in arrays does not grow with the text."""
    for lo, hi, raw, off in blocks(arr, _BLOCK):
        data = LOWER_TABLE[raw]
        if hi - lo > 1 or len(data) <= _BLOCK:
            yield lo, hi, data, off, *symbols(data, off, order), True
            continue
        at, seek = 0, _BLOCK
        while at < len(data):
            space = np.flatnonzero(SPACE[data[seek : seek + _BLOCK]])
            if not len(space) and seek + _BLOCK < len(data):  # within a long word
                seek += _BLOCK
                continue
            end = seek + int(space[0]) if len(space) else len(data)
            start, last = max(0, at - order), end == len(data)
            g = symbols(data[start:end], np.array([0, end - start]), order)[0][at - start : end - start + last]
            yield lo, hi, data[at:end], np.array([0, end - at]), g, np.array([0, len(g)]), last
            at, seek = end, end + _BLOCK


_STATS = pa.schema([("kind", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.int64()), ("learned", pa.int64())])
GRAM, WORD, TEXT = 0, 1, 2


def _tally(keys: list[np.ndarray], counts: list[np.ndarray], learned: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k = np.concatenate(keys)
    sort = np.argsort(k, kind="stable")
    k = k[sort]
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[at], np.add.reduceat(np.concatenate(counts)[sort], at), np.add.reduceat(np.concatenate(learned)[sort], at)


def count(texts: DataFrame, order: int) -> DataFrame:
    """(kind, k1, k2, n, learned) of the columns ``text`` and ``learn`` over all rows: how often each
    (order + 1)-gram of symbols and each word (128-bit hash) occurs in all texts and in those to learn from,
    and the numbers of texts. Counted in the tasks, then summed."""

    def rows(u: np.ndarray, n: np.ndarray, learned: np.ndarray) -> pa.RecordBatch:
        return batch(_STATS, np.zeros(len(u), np.int32), u.view(np.int64), np.zeros(len(u), np.int64), n, learned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        learned: list[np.ndarray] = []
        held = 0
        for b, learn in ((b, x) for b in batches for x in (True, False)):
            flags = b.column(1)
            for _, _, data, off, g, _, ends in _parts(b.column(0).filter(flags if learn else pc.invert(flags)), order):
                u, n = np.unique(g, return_counts=True)
                keys.append(u)
                counts.append(n)
                learned.append(n if learn else np.zeros(len(n), n.dtype))
                held += len(u)
                if held > 1_500_000:
                    u, n, m = _tally(keys, counts, learned)
                    keys, counts, learned, held = [u], [n], [m], len(u)
                    if held > 1_000_000:
                        yield rows(u, n, m)
                        keys, counts, learned, held = [], [], [], 0
                start, end, _ = words(data, off)
                h, at, n = np.unique(SpanHash(data).of(start, end), return_index=True, return_counts=True)
                h2 = SpanHash(data, 1).of(start[at], end[at])
                kinds = np.full(len(h) + 1, WORD, np.int32)
                kinds[-1] = TEXT
                tail = np.zeros(1, np.uint64)
                n = np.concatenate([n, [(len(off) - 1) * ends]])
                yield batch(_STATS, kinds, np.concatenate([h, tail]).view(np.int64), np.concatenate([h2, tail]).view(np.int64), n, n if learn else np.zeros(len(n), n.dtype))
        if keys:
            yield rows(*_tally(keys, counts, learned))

    return texts.mapInArrow(run, _ddl(_STATS)).groupBy("kind", "k1", "k2").agg(F.sum("n").alias("n"), F.sum("learned").alias("learned"))


def _low(column: str, size: int) -> Column:
    return F.col(column).bitwiseAND(F.lit((1 << (8 * size)) - 1))


def code_lengths(stats: DataFrame, order: int) -> DataFrame:
    """(gram, n, bits): what the last symbol of each (order + 1)-gram of ``count``'s table costs, given the
    bytes before it.

    A level has the nodes of one order: ``c`` is a node's count in training, ``seen`` and ``kinds`` are its
    context's number of symbols and of distinct ones, ``start`` is the cost where coding begins with this
    context or the longest known one within it, and ``below`` the cost after an escape from it. A context
    has 256 symbols at most, so no window is large; a node has 256 longer ones at most, so no join is skewed.
    """
    grams = stats.filter(F.col("kind") == GRAM).select(F.col("k1").alias("g"), "n", "learned")
    level: DataFrame | None = None
    for j in range(order + 1):
        nodes = grams.select("g", F.col("learned").alias("c"), "n") if j == order else grams.groupBy(_low("g", j + 1).alias("g")).agg(F.sum("learned").alias("c"))
        context = Window.partitionBy(F.shiftrightunsigned("g", 8))
        hit = F.col("c") > 0
        own = (F.sum("c").over(context).alias("seen"), F.count_if(hit).over(context).alias("kinds"))
        if level is None:
            nodes = nodes.select("*", *own).withColumn("below", F.log2(F.lit(256.0) - F.col("kinds")))
            unknown = F.lit(8.0)
        else:
            shorter = level.select(F.col("g").alias("s"), *[F.col(x).alias(f"{x}1") for x in ("c", "seen", "kinds", "start", "below")])
            nodes = nodes.join(shorter, _low("g", j) == F.col("s"))
            nodes = nodes.select("*", *own, F.sum(F.when(hit, F.col("c1")).otherwise(0)).over(context).alias("taken"))
            left = F.col("kinds1") - F.col("kinds")
            total = F.col("seen1") - F.col("taken") + left
            escape = F.when(left > 0, F.log2(total / left)).otherwise(0.0)
            nodes = nodes.withColumn("below", F.when(F.col("c1") > 0, F.log2(total / F.col("c1"))).otherwise(escape + F.col("below1")))
            unknown = F.col("start1")
        size = F.col("seen") + F.col("kinds")
        start = F.when(F.col("seen") == 0, unknown).when(hit, F.log2(size / F.col("c"))).otherwise(F.log2(size / F.col("kinds")) + F.col("below"))
        level = nodes.withColumn("start", start)
    return level.select(F.col("g").alias("gram"), "n", F.col("start").alias("bits"))


def score(docs: DataFrame, stats: DataFrame, codes: DataFrame, order: int, id_col: str, text_col: str, extra: str | None = None) -> DataFrame:
    """One row per row of ``docs``: id, ``extra`` column, n_tokens, n_known, train_tokens, base_score, score.

    Words and symbol sequences that are frequent in all texts (2**20 and 2**22 at most), learned or not, are
    looked up in the tasks; all others are joined to the counts and costs, by keys none of which is frequent.
    """
    spark = docs.sparkSession
    found = stats.filter(F.col("kind") != GRAM).groupBy("kind").agg(F.sum("learned").alias("n"), F.count_if(F.col("learned") > 0).alias("d"), F.sum("n").alias("all")).collect()
    by = {r["kind"]: r for r in found}
    n_texts = by[TEXT]["n"] if TEXT in by else 0
    total = n_texts + (by[WORD]["n"] if WORD in by else 0)
    distinct = (n_texts > 0) + (by[WORD]["d"] if WORD in by else 0)
    least = max(1, math.ceil(sum(r["all"] for r in found) / 2**SHARE_BITS))
    counts = stats.filter(F.col("kind") == WORD)
    often = counts.filter(F.col("n") >= least).select("k1", "k2", "learned").toArrow()
    sort = np.argsort(k1 := often["k1"].to_numpy().view(np.uint64))
    least_gram = max(1, math.ceil(codes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] / 2**GRAM_BITS))
    top = codes.filter(F.col("n") >= least_gram).select("gram", "bits").toArrow()
    shared = spark.sparkContext.broadcast(
        (top["gram"].to_numpy().view(np.uint64), top["bits"].to_numpy(), k1[sort], often["k2"].to_numpy().view(np.uint64)[sort], np.log10(often["learned"].to_numpy()[sort] + 1.0))
    )
    end_log = math.log10(n_texts + 1)
    norm = math.log10(total + distinct + 1)
    ids = arrow_type(docs, id_col)
    more = [extra] if extra else []
    longs = pa.list_(pa.int64())
    schema = pa.schema(
        [("uid", pa.int64()), ("id", ids), *[(x, arrow_type(docs, x)) for x in more], ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("bits", pa.float64()), ("k1", longs), ("k2", longs), ("grams", longs)]
    )

    def lists(values: np.ndarray, first: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values.view(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, costs, w1, w2, logs = shared.value
        codebook, index = HashIndex(grams), HashIndex(w1)
        serial = itertools.count(TaskContext.get().partitionId() << 33)
        for b in batches:
            held: list[tuple[np.ndarray, ...]] = []  # of a long text's parts
            for lo, hi, data, off, g, first, ends in _parts(b.column(b.num_columns - 1), order):
                at_gram = np.concatenate([codebook.find(g[i : i + _BLOCK]) for i in range(0, len(g), _BLOCK)])
                rare = at_gram < 0
                bits = segment_sum(np.where(rare, 0.0, costs[at_gram] if len(costs) else 0.0), first)
                start, end, at = words(data, off)
                h1, h2 = SpanHash(data).of(start, end), SpanHash(data, 1).of(start, end)
                k = index.find(h1)
                often = (k >= 0) & (w2[k] == h2) if len(w2) else np.zeros(len(k), bool)
                base = segment_sum(np.where(often, logs[k] if len(logs) else 0.0, 0.0), at)
                known = segment_sum(often & (logs[k] > 0) if len(logs) else often, at).astype(np.int64)
                cut = [np.concatenate([[0], np.cumsum(x)])[y] for x, y in ((~often, at), (rare, first))]
                held.append((np.diff(at), known, base, bits, h1[~often], h2[~often], cut[0], g[rare], cut[1]))
                if not ends:
                    continue
                if len(held) > 1:
                    n, known, base, bits = (sum(p[i] for p in held) for i in range(4))
                    h1, h2, rare_grams = (np.concatenate([p[i] for p in held]) for i in (4, 5, 7))
                    cut = [np.array([0, len(h1)]), np.array([0, len(rare_grams)])]
                else:
                    n, known, base, bits, h1, h2, _, rare_grams, _ = held[0]
                held = []
                n, known = n + 1, known + (n_texts > 0)
                out = [b.column(i).slice(lo, hi - lo) for i in range(b.num_columns - 1)]
                tails = lists(h1, cut[0]), lists(h2, cut[0]), lists(rare_grams, cut[1])
                yield batch(schema, np.array([next(serial) for _ in range(hi - lo)]), *out, n, known, base + end_log - n * norm, bits, *tails)

    cols = [F.col(id_col).alias("id"), *more, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")]
    done = staged(docs.select(*cols).mapInArrow(run, _ddl(schema)), "ppm-scores")
    tail = done.select("uid", F.explode(F.arrays_zip("k1", "k2")).alias("k")).select("uid", "k.k1", "k.k2")
    rare_words = tail.join(counts.filter((F.col("n") < least) & (F.col("learned") > 0)).select("k1", "k2", F.col("learned").alias("n")), ["k1", "k2"])
    rare_grams = done.select("uid", F.explode("grams").alias("gram")).join(codes.filter(F.col("n") < least_gram).select("gram", "bits"), "gram")
    zero, none = F.lit(0), F.lit(0.0)
    seen = (
        rare_words.select("uid", F.lit(1).alias("one"), F.log10(F.col("n") + 1.0).alias("log"), none.alias("rare_bits"))
        .unionByName(rare_grams.select("uid", zero.alias("one"), none.alias("log"), F.col("bits").alias("rare_bits")))
        .groupBy("uid").agg(F.sum("one").alias("more"), F.sum("log").alias("logs"), F.sum("rare_bits").alias("rare_bits"))
    )
    return done.drop("k1", "k2", "grams").join(seen, "uid", "left").select(
        F.col("id").alias(id_col),
        *more,
        "n_tokens",
        (F.col("known") + F.coalesce("more", zero)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("logs", none)).alias("base_score"),
        ((F.col("bits") + F.coalesce("rare_bits", none)) * -math.log10(2)).alias("score"),
    )


def train_and_score(docs: DataFrame, train: DataFrame | Column, id_col: str = "doc_id", text_col: str = "text", extra: str | None = None, order: int = 5) -> DataFrame:
    """Learn from all rows of ``train``, or from those rows of ``docs`` where the column ``train`` holds,
    and score all rows of ``docs`` (null texts are empty; an empty text has one symbol and one token, its
    end). Without training rows every symbol costs eight bits."""
    if not 0 <= order <= 5:
        raise ValueError("order must be from 0 to 5")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    if isinstance(train, DataFrame):
        texts = docs.select(text, F.lit(False).alias("learn")).unionByName(train.select(text, F.lit(True).alias("learn")))
    else:
        texts = docs.select(text, F.coalesce(train, F.lit(False)).alias("learn"))
    stats = staged(count(texts, order), "ppm-counts")
    codes = staged(code_lengths(stats, order), "ppm-codes")
    return score(docs, stats, codes, order, id_col, text_col, extra)


def op2_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of ``documents``, learned from the six folds that are not held out: doc_id, held_out, n_tokens,
    n_known, train_tokens, base_score and score. An empty table gives no row."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("held_out", fold_of("doc_id", 7) == 2)
    return train_and_score(docs, ~F.col("held_out"), extra="held_out")
