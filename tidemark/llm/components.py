"""Connected components of a graph given as an edge table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


#: A node with more than 1 / HOT of all edge ends (and LEAST of them) is joined by broadcast: fewer than HOT nodes.
HOT, LEAST = 1 << 15, 1000
#: Nodes that a task ties at once, about 200 bytes each.
FOREST = 300_000


def _hang(edges: DataFrame, low: DataFrame, ends: int) -> DataFrame:
    """``edges`` (a, b) with ``m`` of ``low`` (n, m, deg), one row a node, joined on a. Hubs, of which there can be
    but HOT, are broadcast and their edges stay in place; every other node has a small share of all edges."""
    hub = F.col("deg") > max(LEAST, ends // HOT)
    hubs = low.filter(hub).select(F.col("n").alias("h"), F.col("m").alias("hub_m"))
    split = edges.join(F.broadcast(hubs), F.col("a") == F.col("h"), "left")
    rest = split.filter("h is null").select("a", "b").join(low.filter(~hub).select("n", "m"), F.col("a") == F.col("n"))
    return split.filter("h is not null").select("a", "b", F.col("hub_m").alias("m")).unionByName(rest.select("a", "b", "m"))


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node of a task's edges with the smallest node that they tie it to, by union and find over up to
    FOREST nodes at a time."""
    root: dict = {}

    def find(x):
        top = x
        while (up := root.setdefault(top, top)) != top:
            top = up
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    def flush(schema: pa.Schema) -> pa.RecordBatch:
        nodes = [x for x in root if find(x) != x]
        out = pa.RecordBatch.from_arrays([pa.array(nodes, schema[0].type), pa.array([find(x) for x in nodes], schema[1].type)], schema=schema)
        root.clear()
        return out

    schema = None
    for b in batches:
        schema = b.schema
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = find(x), find(y)
            root[max(x, y)] = min(x, y)
        if len(root) > FOREST:
            yield flush(schema)
    if root:
        yield flush(schema)


def _are_stars(edges: DataFrame) -> bool:
    """If each component is its smallest node with all others hanging on it: no node hangs on two, and none that
    others hang on hangs itself."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(edges.select(F.col("b").alias("n"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    by = ends.groupBy("n").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return by.filter("hangs > 1 or hangs + holds > 1").isEmpty()


def components(edges: DataFrame, rounds: int = 200, tied: bool = False) -> DataFrame:
    """(node, root) for each node that has an edge in ``edges`` (columns ``a`` and ``b`` of one orderable
    type); the root is the smallest node of its component (Kiveris and others, 2014). Edges with a null end
    or between a node and itself count for nothing; repeated edges count once; no edges give no rows.

    The edges within a task are tied first, unless ``tied`` says that ``forest`` has been applied where they
    were made (which spares a second Python process a task). Each round then is two aggregates and joins whose size is that of the
    edges; nothing is gathered by group, the minimum of a node's neighbours is a combined aggregate, and a hub's
    edges stay where they are. Rounds are written to the shared folder. Their number grows with the
    logarithm of the longest chain; after ``rounds`` of them an error is raised.
    """
    some = edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = staged((some if tied else some.mapInArrow(forest, some.schema)).distinct(), "edges")
    ends = 2 * now.count()
    for _ in range(rounds):
        if _are_stars(now):
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("deg")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"), "deg")
        # large star: larger neighbours hang themselves on the smallest one
        large = _hang(both.filter("b > a"), low, ends).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = staged(large.filter("a <> b").distinct(), "large")
        # small star: smaller neighbours and the node itself hang on the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("deg")).withColumnRenamed("a", "n")
        small = _hang(large, low, ends).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("n").alias("a"), F.col("m").alias("b")))
        now = staged(small.filter("a <> b").distinct(), "edges")
    else:
        raise RuntimeError(f"components not complete after {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
