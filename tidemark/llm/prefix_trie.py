"""Conversation prefix trie from ternary search trees over range shards (operator 13).

1. Each different turn (role and text) gets a number; from there on rows are narrow. Positions of turns are counted
   within range shards and added up over them, so a conversation with very many turns is no task of its own.
2. A conversation is cut into segments of SEGMENT turns. A segment hangs below the node of all turns before it, so its
   key is that node's and its own turn numbers; equal segments are counted together before anything is sorted.
3. The different segments are sorted by range. A task takes its range in shards of bounded size, inserts each shard's
   segments into ternary search trees, medians first, and accumulates members, children, leaves and savings in one
   iteration over the nodes from the last made to the first.
4. Only nodes on the first or last path of a shard can also be in another one, and only nodes above a further segment
   have parts of their subtrees elsewhere. These open nodes are merged, and their subtrees are summed by doubling:
   after k rounds a node has the sums of all open nodes fewer than 2**k below it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_type, batch, staged
from .exact_dedup import _ddl

SEGMENT = 256
#: Turns in the trees of one shard.
SHARD_TURNS = 1 << 17
#: Turns that make up 1 / 2**16 of all or more are looked up in the tasks (2**16 of them at most).
SHARE_BITS = 16
ROOT = b""


def below(key: bytes, turn: int) -> bytes:
    """The key of a node's child by this turn number: 128 bits."""
    return hashlib.blake2b(key + turn.to_bytes(8, "big", signed=True), digest_size=16).digest()


class TernaryTree:
    """A ternary search tree over sequences of numbers. Node 0 stands for the empty sequence."""

    def __init__(self) -> None:
        self.turn, self.lo, self.eq, self.hi, self.up = [0], [-1], [-1], [-1], [-1]
        self.n, self.low, self.size = [0], [None], [0]

    def _new(self, turn: int, up: int, size: int) -> int:
        for column, x in ((self.turn, turn), (self.lo, -1), (self.eq, -1), (self.hi, -1), (self.up, up), (self.n, 0), (self.low, None), (self.size, size)):
            column.append(x)
        return len(self.turn) - 1

    def insert(self, turns: list[int], sizes: list[int], n: int, low: object) -> list[int]:
        """Count ``n`` members, the smallest of them ``low``, along a sequence; the numbers of its nodes."""
        path, at = [], 0
        for turn, size in zip(turns, sizes, strict=True):
            up, links, from_ = at, self.eq, at
            k = self.eq[at]
            while k >= 0 and self.turn[k] != turn:
                links, from_ = (self.lo, k) if turn < self.turn[k] else (self.hi, k)
                k = links[k]
            if k < 0:
                k = links[from_] = self._new(turn, up, size)
            self.n[k] += n
            if self.low[k] is None or low < self.low[k]:
                self.low[k] = low
            path.append(k)
            at = k
        return path

    def totals(self, open_: set[int]) -> tuple[list[int], list[int], list[int]]:
        """Children, leaves and savings below each node, itself included unless it is open; open nodes (whose ancestors
        all are) hand nothing up. A child is always made after its parent."""
        kids, leaves, saved = ([0] * len(self.turn) for _ in range(3))
        for k in range(len(self.turn) - 1, 0, -1):
            if k not in open_:
                leaves[k] += not kids[k]
                saved[k] += (self.n[k] - 1) * self.size[k]
                up = self.up[k]
                kids[up] += 1
                leaves[up] += leaves[k]
                saved[up] += saved[k]
        return kids, leaves, saved


def median_order(n: int) -> Iterator[int]:
    """0 to n - 1, the middle first and then so in both halves."""
    todo = [(0, n)]
    while todo:
        lo, hi = todo.pop()
        if lo < hi:
            middle = (lo + hi) // 2
            yield middle
            todo += [(middle + 1, hi), (lo, middle)]


def shard_nodes(rows: list[tuple], segment: int) -> Iterator[tuple]:
    """Node rows of one shard's sorted (number of a segment of ``segment`` turns, key above, turns, sizes, goes on, n, low)."""
    lo = 0
    while lo < len(rows):
        hi = lo
        while hi < len(rows) and rows[hi][1] == rows[lo][1]:
            hi += 1
        tree, own = TernaryTree(), rows[lo:hi]
        open_ = {0}
        for k in median_order(hi - lo):
            _, _, turns, sizes, goes_on, n, low = own[k]
            path = tree.insert(turns, sizes, n, low)
            if goes_on or (k + lo) in (0, len(rows) - 1):
                open_.update(path)
        depth = [own[0][0] * segment]
        keys = [own[0][1]]
        kids, leaves, saved = tree.totals(open_)
        yield keys[0], None, depth[0], 0, None, 0, kids[0], leaves[0], saved[0], True, None
        for k in range(1, len(tree.turn)):
            up = tree.up[k]
            keys.append(below(keys[up], tree.turn[k]))
            depth.append(depth[up] + 1)
            yield keys[k], keys[up], depth[k], tree.n[k], tree.low[k], tree.size[k], kids[k], leaves[k], saved[k], k in open_, None if up in open_ else tree.low[up]
        lo = hi


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def _stream(schema: pa.Schema, rows: Iterator[tuple], most: int = 20_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == most:
            yield batch(schema, *map(list, zip(*held, strict=True)))
            held = []
    if held:
        yield batch(schema, *map(list, zip(*held, strict=True)))


# ---------------------------------------------------------------------------------------------
# Turns and positions
def encoded(conversations: DataFrame, conv_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, key, tid, size) of each row with a conversation: ``tid`` is the number of its role and text, ``key``
    128 bits of their hash, ``size`` the text's bytes. A null role or text is empty."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    key = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.filter(F.col(conv_col).isNotNull()).select(F.col(conv_col).alias("conv"), F.col(order_col).alias("turn"), F.substring(F.unhex(key), 1, 16).alias("key"), F.octet_length(text).cast("long").alias("size"))
    rows = staged(rows, "turns")
    known = staged(rows.groupBy("key").agg(F.count("*").alias("uses")).withColumn("tid", F.monotonically_increasing_id()), "dictionary")
    least = max(1, math.ceil(rows.count() / 2**SHARE_BITS))
    often = F.broadcast(known.filter(F.col("uses") >= least).select("key", F.col("tid").alias("often")))
    looked = rows.join(often, "key", "left")
    rare = looked.filter("often is null").drop("often").join(known.filter(F.col("uses") < least).select("key", "tid"), "key")
    return looked.filter("often is not null").withColumnRenamed("often", "tid").select("conv", "turn", "key", "tid", "size").unionByName(rare.select("conv", "turn", "key", "tid", "size"))


def placed(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``encoded``'s rows by range shards (conv, shard, at, tid, size), and for each conversation in a shard (conv, shard, base,
    before, n): its first row there, its rows in shards before and in all. Turns are ordered by ``turn``, nulls
    first, ties by key."""
    ranged = turns.repartitionByRange("conv", "turn", "key").sortWithinPartitions("conv", "turn", "key")
    rows = staged(ranged.select("conv", F.spark_partition_id().alias("shard"), F.monotonically_increasing_id().alias("at"), "tid", "size"), "placed")
    runs = rows.groupBy("conv", "shard").agg(F.min("at").alias("base"), F.count("*").alias("own"))
    all_ = Window.partitionBy("conv")  # a row a shard
    before = F.sum("own").over(all_.orderBy("shard")) - F.col("own")
    return rows, staged(runs.select("conv", "shard", "base", before.alias("before"), F.sum("own").over(all_).alias("n")), "runs")


def positions(rows: DataFrame, runs: DataFrame, *more: str) -> DataFrame:
    """(conv, pos, tid, size) and columns of ``runs``; positions count from 1."""
    return rows.join(runs, ["conv", "shard"]).select("conv", (F.col("at") - F.col("base") + F.col("before") + 1).alias("pos"), "tid", "size", *more)


# ---------------------------------------------------------------------------------------------
# The trie
_NODE = [("key", pa.binary()), ("up", pa.binary()), ("depth", pa.int64()), ("n", pa.int64()), ("low", None), ("size", pa.int64()), ("kids", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64())]


def _ends(paths: DataFrame, ids: pa.DataType, part_chars: int = 1 << 16) -> DataFrame:
    """(key, ends_sha256) of the keys at which conversations end: ids are sorted by range and joined to parts in the tasks,
    and each key's parts are hashed as a stream."""
    schema = pa.schema([("key", pa.binary()), ("first", ids), ("part", pa.string())])
    out_schema = pa.schema([("e_key", pa.binary()), ("ends_sha256", pa.string())])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            at, first, held, size = None, None, [], 0
            for key, conv in _rows(batches):
                if held and (key != at or size > part_chars):
                    yield at, first, ",".join(held)
                    held, size = [], 0
                if not held:
                    at, first = key, conv
                held.append(str(conv))
                size += len(held[-1]) + 1
            if held:
                yield at, first, ",".join(held)

        return _stream(schema, made(), 1000)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            at, state = None, None
            for key, _, part in _rows(batches):
                if state and key == at:
                    state.update(b"," + part.encode())
                else:
                    if state:
                        yield at, state.hexdigest()
                    at, state = key, hashlib.sha256(part.encode())
            if state:
                yield at, state.hexdigest()

        return _stream(out_schema, made())

    ranged = paths.repartitionByRange("key", "conv").sortWithinPartitions("key", "conv").mapInArrow(parts, _ddl(schema))
    return ranged.repartition("key").sortWithinPartitions("key", "first").mapInArrow(digest, _ddl(out_schema))


def _subtrees(nodes: DataFrame, deepest: int) -> DataFrame:
    """(key, leaves, saved) of all of ``nodes`` (key, up, leaves, saved): the sums over each one's subtree within them."""
    now = nodes.select("key", F.col("up").alias("jump"), "leaves", "saved")
    for _ in range(max(deepest, 1).bit_length()):
        gains = now.filter("jump is not null").groupBy(F.col("jump").alias("g_key")).agg(F.sum("leaves").alias("g_leaves"), F.sum("saved").alias("g_saved"))
        further = now.select(F.col("key").alias("j_key"), F.col("jump").alias("j_jump"))
        zero = F.lit(0).cast("long")
        now = now.join(gains, F.col("key") == F.col("g_key"), "left").join(further, F.col("jump") == F.col("j_key"), "left")
        now = staged(now.select("key", F.col("j_jump").alias("jump"), (F.col("leaves") + F.coalesce("g_leaves", zero)).alias("leaves"), (F.col("saved") + F.coalesce("g_saved", zero)).alias("saved")), "subtrees")
    return now.select("key", "leaves", "saved")


def trie(turns: DataFrame, convs: DataFrame, conv_col: str = "conv_id", shard_turns: int = SHARD_TURNS, segment: int = SEGMENT) -> DataFrame:
    """One row per node of the trie over the conversations ``convs`` (conv), each once, whose ``turns`` (conv, pos, tid, size)
    are at positions from 1 on without gaps: ``conv_col`` (the smallest member), depth, parent, n_convs, n_children,
    n_leaves, saved_tokens and ends_sha256."""
    ids = arrow_type(convs, "conv")
    conv_type = convs.schema["conv"].dataType.simpleString()
    longs = pa.list_(pa.int64())
    seg_schema = pa.schema([("conv", ids), ("seg", pa.int64()), ("above", pa.binary()), ("turns", longs), ("sizes", longs), ("after", pa.binary())])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            at, key = None, ROOT
            for conv, seg, turns_, sizes in _rows(batches):
                above = ROOT if conv != at else key
                at, key = conv, above
                for t in turns_:
                    key = below(key, t)
                yield conv, seg, above, turns_, sizes, key

        return _stream(seg_schema, made(), 2000)

    seg = F.floor((F.col("pos") - 1) / segment).cast("long")
    items = F.array_sort(F.collect_list(F.struct("pos", "tid", "size")))  # ``segment`` of them at most
    segs = turns.groupBy("conv", seg.alias("seg")).agg(items.alias("items")).select("conv", "seg", F.col("items.tid").alias("turns"), F.col("items.size").alias("sizes"))
    segs = staged(segs.repartition("conv").sortWithinPartitions("conv", "seg").mapInArrow(chain, _ddl(seg_schema)), "segments")

    last = segs.groupBy("conv").agg(F.max_by("after", "seg").alias("key"), F.max("seg").alias("last"))
    paths = staged(convs.join(last, "conv", "left").select("conv", F.coalesce("key", F.lit(ROOT)).alias("key"), "last"), "paths")
    long_ = paths.filter("last > 0").select(F.col("conv").alias("l_conv"), "last")
    same = segs.join(long_, F.col("conv") == F.col("l_conv"), "left")
    same = same.groupBy("seg", "above", "turns", "sizes").agg(F.max(F.coalesce(F.col("seg") < F.col("last"), F.lit(False))).alias("goes_on"), F.count("*").alias("n"), F.min("conv").alias("low"))
    same = staged(same, "same")

    fields = [(c, t or ids) for c, t in _NODE]
    node_schema = pa.schema([*fields, ("open", pa.bool_()), ("up_low", ids)])

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            held, size = [], 0
            for r in _rows(batches):
                held.append(r)
                size += len(r[2])
                if size >= shard_turns:
                    yield from shard_nodes(held, segment)
                    held, size = [], 0
            yield from shard_nodes(held, segment)

        return _stream(node_schema, made())

    ranged = same.select("seg", "above", "turns", "sizes", "goes_on", "n", "low").repartitionByRange("above", "turns").sortWithinPartitions("above", "turns")
    nodes = staged(ranged.mapInArrow(grow, _ddl(node_schema)), "nodes")

    none, zero = F.lit(None), F.lit(0).cast("long")
    root = convs.agg(F.count("*").alias("n"), F.min("conv").alias("low")).filter("n > 0")
    root = root.select(F.lit(ROOT).alias("key"), none.cast("binary").alias("up"), zero.alias("depth"), "n", "low", *[zero.alias(c) for c in ("size", "kids", "leaves", "saved")])
    parts = nodes.filter("open").select(*[c for c, _ in _NODE]).unionByName(root)
    merged = parts.groupBy("key").agg(F.max("up").alias("up"), F.max("depth").alias("depth"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("size").alias("size"), *[F.sum(c).alias(c) for c in ("kids", "leaves", "saved")])
    merged = staged(merged, "merged")
    deepest = merged.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    born = merged.filter("up is not null").groupBy(F.col("up").alias("b_key")).agg(F.count("*").alias("born"))
    all_kids = (F.col("kids") + F.coalesce("born", zero)).alias("kids")
    own = merged.join(born, F.col("key") == F.col("b_key"), "left").select("key", "up", "depth", "n", "low", all_kids, "leaves", "saved", "size")
    own = own.withColumn("leaves", F.col("leaves") + (F.col("kids") == 0).cast("long")).withColumn("saved", F.col("saved") + (F.col("n") - 1) * F.col("size"))
    own = staged(own.drop("size"), "open")
    opened = own.drop("leaves", "saved").join(_subtrees(own, deepest), "key")

    done = nodes.filter(~F.col("open")).select("key", "up", "depth", "n", "low", "kids", "leaves", "saved", "up_low")
    whole = done.unionByName(opened.withColumn("up_low", none.cast(conv_type)))
    lows = own.select(F.col("key").alias("p_key"), F.col("low").alias("p_low"))
    near, far = whole.filter("up_low is not null"), whole.filter("up_low is null").join(lows, F.col("up") == F.col("p_key"), "left").withColumn("up_low", F.col("p_low")).drop("p_key", "p_low")
    out = near.unionByName(far).join(_ends(paths.select("key", "conv"), ids), F.col("key") == F.col("e_key"), "left")
    return out.select(
        F.col("low").alias(conv_col),
        "depth",
        F.col("up_low").alias(f"parent_{conv_col}"),
        F.col("n").alias("n_convs"),
        F.col("kids").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text", shard_turns: int = SHARD_TURNS, segment: int = SEGMENT) -> DataFrame:
    """The trie of conversations as they stand: a row per different sequence of first turns, as :func:`trie` gives it.

    Turns are ordered by ``order_col``, nulls first, equal ones by the hash of role and text; a null role or text is
    empty; rows that repeat are turns of their own; rows without a conversation belong to none. An empty table has
    no node, any other a root."""
    rows, runs = placed(encoded(conversations, conv_col, order_col, role_col, text_col))
    return trie(positions(rows, runs), runs.select("conv").distinct(), conv_col, shard_turns, segment)


def rebuilt(rows: DataFrame, runs: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """The query's conversations: c begins with the first h turns of c - c % ``group``, h = crc32(c) % ``most``, and goes on with
    its own turns after its first h. Turns (conv, pos, tid, size) and conversations (conv)."""
    head: Column = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    lens = runs.select("conv", "n").distinct()
    first = F.col("conv") - F.col("conv") % group
    plan = lens.select("conv", head.alias("h"), first.alias("b")).join(lens.select(F.col("conv").alias("b"), F.col("n").alias("b_n")), "b", "left")
    plan = staged(plan.select("conv", "h", "b", (F.col("h") - F.least("h", F.coalesce("b_n", F.lit(0)))).alias("gap")), "plan")
    own = positions(rows, runs.join(plan.select("conv", "h", "gap"), "conv"), "h", "gap").filter("pos > h").select("conv", (F.col("pos") - F.col("gap")).alias("pos"), "tid", "size")
    starts = positions(rows, runs.filter((F.col("conv") % group == 0) & (F.col("before") < most))).filter(F.col("pos") < most).withColumnRenamed("conv", "b")
    copied = plan.select("conv", "b", "h").join(starts, "b").filter("pos <= h").select("conv", "pos", "tid", "size")
    return own.unionByName(copied), lens.select("conv")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per node of the trie over the rebuilt ``conversations``: conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens and ends_sha256."""
    turns, convs = rebuilt(*placed(encoded(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))
    return trie(turns, convs)


# CRC-32 of a text of ASCII characters by its rule, bit by bit, with the reversed polynomial (a fixed value).
_BITS = "list_reduce([{}, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)"
_CRC = f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split({{}}, ''), lambda c: CAST(ord(c) AS BIGINT))), lambda x, y: {_BITS.format('xor(x, y)')}), 4294967295)"
ORACLE = f"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
r AS (
  SELECT c, strlen(role) || ':' || role || strlen(text) || ':' || text AS item, strlen(text) AS size,
    row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || text)) AS pos FROM t),
k AS (SELECT DISTINCT c, c - c % 5 AS b, {_CRC.format("CAST(c AS VARCHAR)")} % 9 AS h FROM t),
parts AS (
  SELECT k.c, 0 AS part, r.pos, r.item, r.size FROM k JOIN r ON r.c = k.b AND r.pos <= k.h
  UNION ALL SELECT k.c, 1, r.pos, r.item, r.size FROM k JOIN r ON r.c = k.c AND r.pos > k.h),
seq AS (SELECT c, item, size, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS d FROM parts),
pre AS (
  SELECT c, d, size, sha256(string_agg(item, '') OVER (PARTITION BY c ORDER BY d)) AS key FROM seq
  UNION ALL SELECT c, 0, 0, '' FROM k),
links AS (SELECT c, d, size, key, lag(key) OVER (PARTITION BY c ORDER BY d) AS up, d = max(d) OVER (PARTITION BY c) AS final FROM pre),
nodes AS (
  SELECT key, any_value(up) AS up, any_value(d) AS depth, min(c) AS low, count(*) AS n, any_value(size) AS size,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (final), '')) AS ends FROM links GROUP BY key),
kids AS (SELECT up AS key, count(*) AS kids FROM nodes WHERE up IS NOT NULL GROUP BY up),
full_ AS (SELECT nodes.*, coalesce(kids, 0) AS kids FROM nodes LEFT JOIN kids USING (key)),
pairs AS (
  SELECT DISTINCT a.key AS top, b.key AS node FROM pre a JOIN pre b ON a.c = b.c AND a.d <= b.d),
sums AS (
  SELECT top AS key, count(*) FILTER (f.kids = 0) AS leaves, sum((f.n - 1) * f.size) AS saved FROM pairs JOIN full_ f ON f.key = pairs.node GROUP BY top)
SELECT f.low AS conv_id, f.depth, p.low AS parent_conv_id, f.n AS n_convs, CAST(f.kids AS BIGINT) AS n_children,
  CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, f.ends AS ends_sha256
FROM full_ f JOIN sums s USING (key) LEFT JOIN nodes p ON p.key = f.up
"""
