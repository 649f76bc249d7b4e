"""Join on the Jaccard similarity of word shingles with Bayesian candidate pruning (operator 8).

1. Each text becomes the set of its shingles' 64-bit hashes; equal sets are one class. A class has 128
   16-bit MinHash values, in 32 bands of four.
2. Classes that share a band are candidates. Within a band's bucket MinHash values are compared 16 at a
   time, and a pair is dropped once the posterior probability that its similarity reaches the threshold
   falls below the tolerance (Satuluri and Parthasarathy, 2012). What is left ties classes together into
   clusters; inside a bucket each class that is already tied is not compared again.
3. Each cluster's classes meet once more, now with their whole sets: pairs that survive the same pruning
   are verified exactly. Links are counted where they are found and only a spanning forest of them is
   passed on, so a group of g near copies gives results in proportion to g, not to its pairs.

Buckets and clusters with more than ``block`` classes or ``block_bytes`` are cut into blocks, and each pair of
blocks is a group of its own, so no task holds more than two blocks; all pairs are still met. A class is
sent to as many groups as its cluster has blocks, and compared with a whole block in each of them.

A pair at the threshold 0.8 shares no band with probability (1 - 0.8**4)**32 = 5e-8.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, SpanHash, arrow_type, batch, blocks, marked, marks, mix, shingles, staged, words
from .components import components, forest
from .exact_dedup import _ddl

HASHES, BAND, STEP = 128, 4, 16
_RNG = np.random.default_rng(20)
_A = _RNG.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def minhash(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row of 16-bit MinHash values for each text that has shingles."""
    out = np.empty((len(first) - 1, HASHES), np.uint16)
    for k in range(HASHES):
        low = np.minimum.reduceat(h * _A[k] + _B[k], first[:-1])
        out[:, k] = (mix(low) >> np.uint64(48)).astype(np.uint16)
    return out


def least_matches(threshold: float, tolerance: float) -> np.ndarray:
    """For each multiple of STEP compared values, the fewest matches with which a pair stays: with m of n
    equal and a uniform prior, P(similarity >= threshold | m, n) >= tolerance. A 16-bit value also
    matches by chance, with 1 / 65536."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    equal = grid + (1 - grid) / 65536
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        for m in range(n + 1):
            log = m * np.log(equal) + (n - m) * np.log1p(-equal)
            p = np.exp(log - log.max())
            if p[grid >= threshold].sum() / p.sum() >= tolerance:
                break
        out.append(m)
    return np.array(out)


def survivors(one: np.ndarray, many: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Rows of ``many`` that the pruning leaves as partners of the values ``one``."""
    left = np.arange(len(many))
    matches = np.zeros(len(many), np.int32)
    for i, m in enumerate(least):
        cut = slice(i * STEP, (i + 1) * STEP)
        matches += (many[left, cut] == one[cut]).sum(1, dtype=np.int32)
        stay = matches >= m
        left, matches = left[stay], matches[stay]
        if not len(left):
            break
    return left


def word_sets(raw: np.ndarray, off: np.ndarray, size: int) -> tuple[list[np.ndarray], list[int]]:
    """The sorted distinct shingle hashes of each text of a block."""
    start, end, first = words(raw, off, SPACE)
    h, at = shingles(SpanHash(raw).of(start, end), first, size)
    return [np.unique(h[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def sketch(docs: DataFrame, id_col: str, text_col: str, size: int, sets: bool = False, extra: tuple[str, ...] = ()) -> DataFrame:
    """(id, set, sig, size[, shingles]) for each row. Words are lower-cased and end at white space; ``set`` is a
    128-bit hash of the shingle set and null for a text without words."""
    ids = arrow_type(docs, id_col)
    schema = pa.schema([("id", ids), *[(c, arrow_type(docs, c)) for c in extra], ("set", pa.binary()), ("sig", pa.binary()), ("size", pa.int64()), *([("shingles", pa.binary())] if sets else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for lo, hi, raw, off in blocks(x.column(x.num_columns - 1), 1 << 19):
                own = word_sets(raw, off, size)
                full = np.array([i for i, s in enumerate(own) if len(s)], np.int64)
                keys: list = [None] * len(own)
                sigs: list = [None] * len(own)
                if len(full):
                    sig = minhash(np.concatenate([own[i] for i in full]), np.concatenate([[0], np.cumsum([len(own[i]) for i in full])]))
                    for k, i in enumerate(full):
                        keys[i], sigs[i] = hashlib.blake2b(own[i].tobytes(), digest_size=16).digest(), sig[k].tobytes()
                more = [[s.tobytes() for s in own]] if sets else []
                yield batch(schema, *[x.column(i).slice(lo, hi - lo) for i in range(1 + len(extra))], keys, sigs, [len(s) for s in own], *more)

    return docs.select(F.col(id_col).alias("id"), *extra, F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("__text")).mapInArrow(run, _ddl(schema))


def _by_group(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Consecutive rows with equal values in the first ``keys`` columns, as one table each."""
    held: list[pa.RecordBatch] = []
    at: tuple | None = None
    for b in batches:
        cols = [b.column(i).to_pylist() for i in range(keys)]
        rows = list(zip(*cols, strict=True))
        lo = 0
        while lo < len(rows):
            hi = lo + 1
            while hi < len(rows) and rows[hi] == rows[lo]:
                hi += 1
            if rows[lo] != at:
                if held:
                    yield at, pa.Table.from_batches(held)
                held, at = [], rows[lo]
            held.append(b.slice(lo, hi - lo))
            lo = hi
    if held:
        yield at, pa.Table.from_batches(held)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, HASHES)


def _in_blocks(members: DataFrame, n: Column, node: str) -> DataFrame:
    """``members``, whose group has ``n`` blocks, with columns i and j: the groups of up to two blocks in which
    each must take part."""
    own = F.pmod(F.xxhash64(node), n).cast("int")
    spread = members.withColumn("__n", n).withColumn("__own", own).withColumn("__to", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    return spread.withColumn("i", F.least("__own", "__to")).withColumn("j", F.greatest("__own", "__to")).withColumn("own", F.col("__own")).drop("__n", "__to", "__own")


def tie(batches: Iterator[pa.RecordBatch], least: np.ndarray) -> Iterator[tuple[bytes, bytes]]:
    """(class, class) edges that span what the pruning leaves in each bucket."""
    for _, t in _by_group(batches, 3):
        nodes, sig = t["set"].to_pylist(), _matrix(t["sig"])
        free = np.ones(len(nodes), bool)
        for seed in range(len(nodes)):
            if not free[seed]:
                continue
            free[seed] = False
            queue = [seed]
            while queue:
                i = queue.pop()
                rest = np.flatnonzero(free)
                if not len(rest):
                    break
                near = rest[survivors(sig[i], sig[rest], least)]
                free[near] = False
                queue += near.tolist()
                for k in near:
                    yield nodes[seed], nodes[k]


def similar(batches: Iterator[pa.RecordBatch], least: np.ndarray, threshold: float) -> Iterator[tuple]:
    """(class, links, linked documents, a class of its component) for each class of each group; a pair is
    counted in the one group of its two blocks."""
    for (_, i, j), t in _by_group(batches, 3):
        nodes = t["set"].to_pylist()
        once = sorted({x: k for k, x in reversed(list(enumerate(nodes)))}.values())  # a repeated row counts once
        t, nodes = t.take(once), [nodes[k] for k in once]
        own, docs = t["own"].to_numpy(), t["docs"].to_numpy()
        sig, sets = _matrix(t["sig"]), [np.frombuffer(x, np.uint64) for x in t["shingles"].to_pylist()]
        sizes = np.array([len(s) for s in sets])
        order = np.argsort(own, kind="stable")
        root = np.arange(len(nodes))
        links, linked = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64)

        def find(x: int, root: np.ndarray = root) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for at, one in enumerate(order):
            rest = order[at + 1 :]
            rest = rest[own[rest] != own[one]] if i != j else rest
            # sets whose sizes are too different cannot reach the threshold
            lo, hi = threshold * sizes[one], sizes[one] / threshold
            rest = rest[(sizes[rest] >= lo - 1e-9) & (sizes[rest] <= hi + 1e-9)]
            near = rest[survivors(sig[one], sig[rest], least)] if len(rest) else rest
            if not len(near):
                continue
            flat = np.concatenate([sets[k] for k in near])
            pos = np.minimum(np.searchsorted(sets[one], flat), sizes[one] - 1)
            both = np.add.reduceat((sets[one][pos] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(sizes[near])[:-1]]))
            near = near[both >= threshold * (sizes[one] + sizes[near] - both) - 1e-9]
            links[one] += len(near)
            links[near] += 1
            linked[one] += docs[near].sum()
            linked[near] += docs[one]
            for k in near:
                a, b = find(one), find(k)
                root[max(a, b)] = min(a, b)
        for k in np.flatnonzero(links):
            yield nodes[k], int(links[k]), int(linked[k]), nodes[find(k)]


def _stream(schema: pa.Schema, rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == 20_000:
            yield batch(schema, *zip(*held, strict=True))
            held = []
    if held:
        yield batch(schema, *zip(*held, strict=True))


def _run(schema: pa.Schema, f: Callable[..., Iterator[tuple]], *more) -> Callable:
    return lambda batches: _stream(schema, f(batches, *more))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, size: int = 5, tolerance: float = 1e-6, block: int = 2000, block_bytes: int = 64 << 20) -> DataFrame:
    """One row per row of ``docs``: the id, ``class_id``, ``n_links`` and ``n_text_links``.

    Documents are linked if their sets of ``size``-word shingles have a Jaccard similarity of ``threshold``
    or more (equal sets have 1). ``class_id`` is the smallest id of the document's connected component;
    ``n_links`` counts the other documents it is linked to, ``n_text_links`` the different sets among
    them. A text of fewer words is one shingle; one without words (null, empty, white space) is linked to
    nothing and is its own class. Rows that repeat an id are documents of their own.
    """
    own = staged(sketch(docs, id_col, text_col, size), "sketch")
    nodes = own.filter("set is not null").groupBy("set").agg(F.count("*").alias("docs"), F.min("id").alias("low"), F.max("sig").alias("sig"), F.max("size").alias("size"))
    nodes = staged(nodes, "sets")
    least = least_matches(threshold, tolerance)
    band = F.transform(F.sequence(F.lit(0), F.lit(HASHES // BAND - 1)), lambda k: F.xxhash64(k, F.substring("sig", k * (2 * BAND) + 1, F.lit(2 * BAND))))
    bands = nodes.select("set", F.explode(F.array_distinct(band)).alias("bucket"))
    shared = bands.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    members = bands.join(shared, "bucket").join(nodes.select("set", "sig"), "set")
    placed = _in_blocks(members, F.ceil(F.col("n") / block).cast("int"), "set").select("bucket", "i", "j", "set", "sig")
    edge_schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])
    tied = placed.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(lambda b: forest(_stream(edge_schema, tie(b, least))), _ddl(edge_schema))
    clusters = staged(components(tied, tied=True).withColumnRenamed("node", "set").withColumnRenamed("root", "cluster"), "clusters")

    members = clusters.join(nodes.select("set", "docs", "low", "size"), "set")
    counts = members.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum(F.col("size") * 8) / block_bytes)).cast("int").alias("n"))
    picks = staged(members.join(counts, "cluster").select(F.col("low").alias("p_low"), F.col("set").alias("p_set"), "cluster", "n", "docs"), "picks")
    # only texts that stand for a class of a cluster are fetched, for which a bitmap spares the others the shuffle
    texts = docs.select(F.col(id_col).alias("p_id"), F.col(text_col).alias("p_text"))
    texts = marked(texts, marks(picks, "p_low"), "p_id").filter("marked").join(picks, F.col("p_id").eqNullSafe(F.col("p_low")))
    texts = texts.select("p_id", "p_text", F.col("p_set").alias("want"), "cluster", "n", "docs")
    full = sketch(texts, "p_id", "p_text", size, sets=True, extra=("want", "cluster", "n", "docs")).filter("set = want")
    whole = _in_blocks(full, F.col("n"), "set").select("cluster", "i", "j", "set", "own", "docs", "sig", "shingles")
    whole = whole.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    link_schema = pa.schema([("set", pa.binary()), ("links", pa.int64()), ("linked", pa.int64()), ("root", pa.binary())])
    links = staged(whole.mapInArrow(_run(link_schema, similar, least, threshold), _ddl(link_schema)), "links")

    roots = components(links.select(F.col("set").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "set")
    found = roots.join(links.groupBy("set").agg(F.sum("links").alias("links"), F.sum("linked").alias("linked")), "set").join(nodes.select("set", "low"), "set")
    found = staged(found, "linked")
    lows = found.groupBy("root").agg(F.min("low").alias("class_low"))
    found = found.join(lows, "root").select("set", "links", "linked", "class_low")
    copies = nodes.filter("docs > 1").select("set", "docs", "low")
    info = copies.join(found, "set", "full_outer")
    zero = F.lit(0)
    return own.select("id", "set").join(info, "set", "left").select(
        F.col("id").alias(id_col),
        F.coalesce("class_low", "low", "id").alias("class_id"),
        (F.coalesce("docs", F.lit(1)) - 1 + F.coalesce("linked", zero)).cast("long").alias("n_links"),
        F.coalesce("links", zero).cast("long").alias("n_text_links"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, size: int = 5) -> DataFrame:
    """The rows of ``docs`` with the smallest id of each class, with all columns whatever their names; documents
    without links stay. Rows that repeat the id that stays all stay; ``exact_dedup.deduplicate`` before
    this leaves one of them. Only rows that a bitmap of the ids that go marks are joined to these."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    id_ = names[docs.columns.index(id_col)]
    classes = near_classes(docs, id_col, text_col, threshold, size)
    drop = staged(classes.filter(~F.col(id_col).eqNullSafe(F.col("class_id"))).select(F.col(id_col).alias("drop")).distinct(), "drop")
    flagged = marked(docs.toDF(*names), marks(drop, "drop"), id_)
    looked = flagged.filter("marked").join(drop, F.col(id_).eqNullSafe(F.col("drop")), "left_anti")
    return flagged.filter(~F.col("marked")).select(*names).unionByName(looked.select(*names)).toDF(*docs.columns)


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of ``documents``: doc_id, class_id, n_links and n_text_links."""
    return near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
