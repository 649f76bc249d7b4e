"""Benchmark decontamination by greedy string tiling (operator 9).

A document and a benchmark item are compared if they share a seed, a run of ``least`` words. Their equal
runs are then tiled greedily: the longest run whose words are unmarked on both sides is marked again and
again, so passages that were cut up and put in another order still cover the item. An item counts as
leaked into a document whose tiles cover at least ``coverage`` of its words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SpanHash, arrow_type, batch, blocks, staged, utf8, words
from .exact_dedup import _ddl
from .ppm import HashIndex
from .textcnn import STOPS

_R = np.uint64(0x9FB21C651E98DF25)
_R_BACK = np.uint64(pow(int(_R), -1, 1 << 64))


class RunningHash:
    """Karp-Rabin hashes of all windows of a sequence of word hashes, for any window length."""

    def __init__(self, h: np.ndarray) -> None:
        n = len(h)
        up, down = np.full(n + 1, _R), np.full(n + 1, _R_BACK)
        up[0] = down[0] = 1
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(h * np.cumprod(up, dtype=np.uint64)[:n], out=self.sums[1:])
        self.down = np.cumprod(down, dtype=np.uint64)

    def windows(self, size: int) -> np.ndarray:
        n = max(len(self.sums) - size, 0)
        return (self.sums[size : size + n] - self.sums[:n]) * self.down[:n]


def tokens(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a block (words end at white space and ASCII punctuation), each row's first word."""
    start, end, first = words(raw, off, STOPS)
    return SpanHash(raw).of(start, end), first


class Item:
    """One benchmark item: its windows by number (``key``), and the words before and after each of them."""

    def __init__(self, h: np.ndarray, key: np.ndarray, size: int) -> None:
        self.size, self.key = size, key
        self.words = np.unique(h)
        none = len(self.words)  # no word of a document has this number
        number = np.searchsorted(self.words, h)
        before, after = np.append(none, number[: len(key) - 1]), np.append(number[size:], none)
        self.base = none + 1
        self.edges = []
        for beside in (before, after):
            code = key * self.base + beside
            order = np.argsort(code, kind="stable")
            self.edges.append((code[order], order))

    def _pairs(self, side: int, at: np.ndarray, key: np.ndarray, beside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document window, item window) with equal windows but different words ``beside`` them."""
        code, order = self.edges[side]
        lo, hi = np.searchsorted(code, key * self.base), np.searchsorted(code, (key + 1) * self.base)
        same_lo = np.where(beside < 0, hi, np.searchsorted(code, key * self.base + np.maximum(beside, 0)))
        same_hi = np.where(beside < 0, hi, np.searchsorted(code, key * self.base + np.maximum(beside, 0), "right"))
        out = []
        for x, y in ((lo, same_lo), (same_hi, hi)):
            n = y - x
            out.append((np.repeat(at, n), order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(x, n)]))
        return np.concatenate([out[0][0], out[1][0]]), np.concatenate([out[0][1], out[1][1]])

    def runs(self, h: np.ndarray, at: np.ndarray, key: np.ndarray) -> np.ndarray:
        """(length, start in the item, start in the document) of the maximal equal runs, as rows; ``at`` are the
        document's windows that the item has, ``key`` their numbers. Beginnings and ends of runs are found
        each for itself, and the k-th beginning on a diagonal belongs to its k-th end; pairs of windows
        inside a run are never listed."""
        spot = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        number = np.where(self.words[spot] == h, spot, -1)
        wide = np.concatenate([[-1], number, [-1]])
        sides = []
        for side, beside in ((0, wide[at]), (1, wide[at + self.size + 1])):
            d, i = self._pairs(side, at, key, beside)
            order = np.lexsort((i, d - i))
            sides.append((d[order], i[order]))
        (d, i), (_, end) = sides
        return np.stack([end - i + self.size, i, d], axis=1)


def greedy_tiles(found: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Tiles from maximal runs: always the longest run that is unmarked on both sides (ties: first in the
    item, then in the document); a partly marked run goes on as its unmarked stretches of ``size`` or more."""
    out = []
    while len(found):
        best = found[found[:, 0] == found[:, 0].max()]
        n, i, d = (int(x) for x in best[np.lexsort((best[:, 2], best[:, 1]))[0]])
        out.append((n, i, d))
        for column, start in ((1, i), (2, d)):
            at, length = found[:, column], found[:, 0]
            cut = (at < start + n) & (at + length > start)
            hit = found[cut]
            left = hit.copy()
            left[:, 0] = start - hit[:, column]
            skip = start + n - hit[:, column]
            right = hit + np.stack([-skip, skip, skip], axis=1)
            found = np.concatenate([found[~cut], left[left[:, 0] >= size], right[right[:, 0] >= size]])
    return out


class Seeds:
    """The benchmark items of one block: their windows of one length, sorted for probing."""

    def __init__(self, hashes: list[np.ndarray], least: int) -> None:
        self.items = hashes
        self.by_size: list[tuple[int, HashIndex, np.ndarray, np.ndarray, np.ndarray]] = []
        sizes = {min(least, len(h)) for h in hashes if len(h)}
        for size in sorted(sizes):
            keys, item, at = [], [], []
            for k, h in enumerate(hashes):
                if min(least, len(h)) == size:
                    w = RunningHash(h).windows(size)
                    keys.append(w)
                    item.append(np.full(len(w), k))
                    at.append(np.arange(len(w)))
            key = np.concatenate(keys)
            order = np.argsort(key, kind="stable")
            uniq, where = np.unique(key[order], return_index=True)
            self.by_size.append((size, HashIndex(uniq), np.append(where, len(key)), np.concatenate(item)[order], np.concatenate(at)[order]))
        self.made: dict[int, Item] = {}

    def _item(self, k: int, size: int, index: HashIndex) -> Item:
        """The item prepared for comparing; a few are remembered."""
        if k not in self.made:
            if len(self.made) >= 64:
                self.made.clear()
            h = self.items[k]
            self.made[k] = Item(h, index.find(RunningHash(h).windows(size)).astype(np.int64), size)
        return self.made[k]

    def _likely(self, size: int, where: np.ndarray, items: np.ndarray, ats: np.ndarray, rows: np.ndarray, keys: np.ndarray, coverage: float) -> Iterator[tuple[int, int]]:
        """(row, item) where the item's windows that the row has could cover enough of it: no tile covers a
        word that no equal window covers. Each row meets each item window once at most; rows are taken
        together up to SLICE windows."""
        n = where[keys + 1] - where[keys]
        until = np.cumsum(n)
        ends = np.append(np.flatnonzero(np.diff(rows)) + 1, len(rows))  # after each row's last key
        lo = 0
        while lo < len(rows):
            top = (until[lo - 1] if lo else 0) + SLICE
            fits = ends[(ends > lo) & (until[ends - 1] <= top)]
            hi = int(fits[-1]) if len(fits) else int(ends[ends > lo][0])
            m = n[lo:hi]
            take = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(where[keys[lo:hi]], m)
            row, item, at = np.repeat(rows[lo:hi], m), items[take], ats[take]
            order = np.lexsort((at, item, row))
            row, item, at = row[order], item[order], at[order]
            new = np.append(True, (np.diff(row) != 0) | (np.diff(item) != 0))
            gain = np.where(new, size, np.minimum(np.append(0, np.diff(at)), size))
            begin = np.flatnonzero(new)
            bound = np.add.reduceat(gain, begin)
            words_in = np.array([len(self.items[k]) for k in item[begin]])
            for k in np.flatnonzero(bound >= coverage * words_in):
                yield int(row[begin[k]]), int(item[begin[k]])
            lo = hi

    def leaks(self, h: np.ndarray, first: np.ndarray, coverage: float) -> Iterator[tuple[int, int, list]]:
        """(row, item, tiles) for each item that the tiles of a row cover well enough."""
        text_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
        rolled = RunningHash(h)
        for size, index, where, items, ats in self.by_size:
            w = rolled.windows(size)
            key = index.find(w)
            inside = text_of[: len(w)] == text_of[size - 1 : size - 1 + len(w)]
            hit = np.flatnonzero((key >= 0) & inside)
            if not len(hit):
                continue
            key = key[hit].astype(np.int64)
            span = len(where)
            pairs = np.unique(text_of[hit] * span + key)
            for row, item in self._likely(size, where, items, ats, pairs // span, pairs % span, coverage):
                lo, hi = np.searchsorted(hit, first[row]), np.searchsorted(hit, first[row + 1])
                own = self._item(item, size, index)
                both = np.isin(key[lo:hi], own.key)
                found = own.runs(h[first[row] : first[row + 1]], hit[lo:hi][both] - first[row], key[lo:hi][both])
                tiles = greedy_tiles(found, size)
                if sum(t[0] for t in tiles) >= coverage * len(self.items[item]):
                    yield row, item, tiles


#: Item windows looked at together.
SLICE = 1 << 20


def _seeds(benchmark: DataFrame, item_id: str, item_text: str, least: int, block_words: int) -> Iterator[tuple[object, int]]:
    """Broadcast seeds of the items in blocks of ``block_words`` words by running count (the item that
    crosses the bound belongs to the block), and the number of blocks."""
    spark = benchmark.sparkSession
    text = F.lower(F.coalesce(F.col(item_text).cast("string"), F.lit("")))
    items = benchmark.select(F.col(item_id).alias("item"), text.alias("text"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"))
    items = staged(items.withColumn("words", F.size(F.split("text", r"[\s\p{Punct}]+")).cast("long")), "items")
    sums = sorted(items.groupBy("part").agg(F.sum("words")).collect())  # a row a partition
    starts = dict(zip([p for p, _ in sums], np.cumsum([0, *[n for _, n in sums]]).tolist(), strict=False))
    blocks_ = max(1, math.ceil(sum(n for _, n in sums) / block_words))
    at = F.sum("words").over(Window.partitionBy("part").orderBy("row")) - F.col("words")
    if starts:
        at = at + F.element_at(F.create_map(*[F.lit(x) for pair in starts.items() for x in pair]), F.col("part"))
    numbered = items.withColumn("block", F.floor(at / block_words))
    for k in range(blocks_):
        block = numbered.filter(F.col("block") == k).select("item", "text").toArrow()
        texts = block["text"].combine_chunks() if block.num_rows else pa.array([], pa.string())
        h, first = tokens(*utf8(texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts))
        yield spark.sparkContext.broadcast((block["item"].to_pylist(), Seeds([h[a:b] for a, b in zip(first[:-1], first[1:], strict=True)], least))), blocks_


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", least: int = 5, coverage: float = 0.5, block_words: int = 500_000) -> DataFrame:
    """A row for each document and item leaked into it: both ids, ``n_tiles``, ``tiled_words``,
    ``item_words``, ``coverage`` and ``tiles`` (words, start in the item, start in the document).

    Words are lower-cased and end at white space and ASCII punctuation. An item with fewer than ``least``
    words is sought whole; one without words (null, empty) leaks nowhere. The benchmark is
    taken in blocks of about ``block_words`` words (and one item at least), each broadcast to one
    pass over the documents; there is no shuffle. With several blocks each one's result is written before the
    next is broadcast. Repeated rows give repeated results.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text"))
    tile = pa.struct([("words", pa.int32()), ("in_item", pa.int32()), ("in_doc", pa.int32())])
    schema = pa.schema([(id_col, arrow_type(docs, id_col)), (item_id, arrow_type(benchmark, item_id)), ("n_tiles", pa.int64()), ("tiled_words", pa.int64()), ("item_words", pa.int64()), ("coverage", pa.float64()), ("tiles", pa.list_(tile))])
    out = None
    for shared, n in _seeds(benchmark, item_id, item_text, least, block_words):
        found = texts.mapInArrow(_search(shared, schema, coverage), _ddl(schema))
        if n > 1:
            found = staged(found, "leaks")
            shared.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def _search(shared, schema: pa.Schema, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, seeds = shared.value
        for x in batches:
            ids = x.column(0).to_pylist()
            rows = []
            for lo, _, raw, off in blocks(x.column(1)):
                h, first = tokens(raw, off)
                for row, item, tiles in seeds.leaks(h, first, coverage):
                    n, size = sum(t[0] for t in tiles), len(seeds.items[item])
                    rows.append((ids[lo + row], names[item], len(tiles), n, size, n / size, [dict(zip(("words", "in_item", "in_doc"), t, strict=True)) for t in tiles]))
            if rows:
                yield batch(schema, *zip(*rows, strict=True))

    return run


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", least: int = 5, coverage: float = 0.5, block_words: int = 500_000) -> DataFrame:
    """The rows of ``docs`` into which no item leaked, with all their columns whatever their names; ``id_col``
    is not looked at. Only texts go to Python and only a boolean comes back, so rows are kept or dropped where
    they are read and nothing is shuffled; with several blocks the rows left are written before the next is
    broadcast."""
    names = docs.columns
    now = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text = F.lower(F.coalesce(F.col(f"c{names.index(text_col)}").cast("string"), F.lit("")))
    for shared, n in _seeds(benchmark, item_id, item_text, least, block_words):
        now = now.filter(_free(shared, coverage)(text))
        if n > 1:
            now = staged(now, "clean")
            shared.destroy()
    return now.toDF(*names)


def _free(shared, coverage: float):
    """For each text whether no item of the block leaked into it."""

    @F.arrow_udf("boolean")
    def free(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        _, seeds = shared.value
        for x in batches:
            stay = np.ones(len(x), bool)
            for lo, _, raw, off in blocks(x):
                for row, _, _ in seeds.leaks(*tokens(raw, off), coverage):
                    stay[lo + row] = False
            yield pa.array(stay)

    return free


def op9_greedy_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaks of ``benchmark`` into ``documents``, as :func:`leaks` gives them; empty tables give none."""
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
