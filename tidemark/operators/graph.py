"""Questions about the lineage graph. Nodes and edges are tables; traversals are iterated joins whose
frontier is written to the shared folder each round, so plans stay short."""

from __future__ import annotations

import itertools
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tidemark.functions import ids
from tidemark.functions.scratch import shared_dir, written

# Lanes of the table graph.
LANES = {"Source": 0, "Intermediate": 1, "Output": 2}
NO_SYSTEM = "(unsystemed)"


def tables_by_role(tables: DataFrame) -> DataFrame:
    """(role, source_system, n_tables, names): alphabetical names per role and system."""
    by = tables.groupBy("role", F.coalesce("source_system", F.lit(NO_SYSTEM)).alias("source_system"))
    return by.agg(F.count("*").alias("n_tables"), F.array_sort(F.collect_set("name")).alias("names"))


def source_to_output_paths(tables: DataFrame, edges: DataFrame, max_depth: int | None = None, max_paths: int | None = None) -> tuple[DataFrame, bool]:
    """All simple paths from Source to Output tables as ``path`` (array of table ids), and whether the
    search was cut at ``max_depth`` edges or after ``max_paths`` partial paths. Parallel edges count once.
    The number of simple paths can be exponential; the two bounds are the caller's, and are reported. Without
    them the search goes on until no path grows: simple paths end by themselves."""
    hop = written(edges.select(F.col("source_table_id").alias("s"), F.col("target_table_id").alias("t")).filter("s <> t").distinct(), "hop")
    goal = written(tables.filter("role = 'Output'").select(F.col("table_id").alias("t")), "goal")
    front = written(tables.filter("role = 'Source'").select(F.array("table_id").alias("path"), F.col("table_id").alias("end")), "paths")
    found, cut = [], False
    for _ in itertools.count() if max_depth is None else range(max_depth):
        nxt = front.join(hop, front["end"] == hop["s"]).filter(~F.array_contains("path", F.col("t")))
        front = written(nxt.select(F.concat("path", F.array("t")).alias("path"), F.col("t").alias("end")), "paths")
        n = front.count()
        found.append(front.join(goal, front["end"] == goal["t"], "left_semi").select("path"))
        if n == 0:
            break
        if max_paths is not None and n > max_paths:
            cut = True
            break
    else:
        cut = True
    out = found[0] if found else front.select("path").limit(0)
    for f in found[1:]:
        out = out.unionByName(f)
    return out, cut


def reachable(edges: DataFrame, seeds: DataFrame, source: str = "source_table_id", target: str = "target_table_id", upstream: bool = False, max_depth: int | None = None) -> DataFrame:
    """(seed, node, depth): every node that each seed reaches (``upstream``: that reaches it) and the
    fewest edges to it; the seed itself has depth 0. ``seeds(seed)``. Breadth first for 64 seeds at a time: a row is a
    node and a block of seeds, with a bit for each, so a round moves nodes times seeds / 64 numbers; bits met once are
    not sent on again, so cycles end. Nodes beyond a ``max_depth`` that is given are an error."""
    s, t = (target, source) if upstream else (source, target)
    spark = edges.sparkSession
    hop = written(edges.select(F.col(s).alias("s"), F.col(t).alias("t")).filter("s <> t").distinct(), "hop")
    # numbers are dense within a task, so only its last block is not full
    numbered = written(seeds.select("seed").distinct().withColumn("id", F.monotonically_increasing_id()), "seeds")
    start = numbered.select(F.col("seed").alias("node"), F.expr("id div 64").alias("block"), F.expr("shiftleft(1L, cast(id % 64 as int))").alias("bits"))
    # one table holds all rounds, a folder each, so the plan of a round does not grow
    path = f"{shared_dir(spark)}/reach-{uuid.uuid4().hex}"
    start.write.parquet(f"{path}/depth=0")
    schema = StructType([*start.schema.fields, StructField("depth", IntegerType())])
    seen = spark.read.schema(schema).parquet(path)
    for depth in itertools.count(1):
        front = seen.filter(F.col("depth") == depth - 1)
        step = front.join(hop, front["node"] == hop["s"]).groupBy(F.col("t").alias("node"), "block").agg(F.bit_or("bits").alias("step"))
        old = seen.groupBy("node", "block").agg(F.bit_or("bits").alias("old"))
        new = F.col("step").bitwiseAND(F.bitwise_not(F.coalesce("old", F.lit(0).cast("long"))))
        step.join(old, ["node", "block"], "left").select("node", "block", new.alias("bits")).filter("bits <> 0").write.parquet(f"{path}/depth={depth}")
        seen = spark.read.schema(schema).parquet(path)
        if seen.filter(F.col("depth") == depth).isEmpty():
            break
        if max_depth is not None and depth > max_depth:
            raise RuntimeError(f"nodes beyond {max_depth} edges")
    bit = F.explode(F.expr("filter(sequence(0, 63), i -> getbit(bits, i) = 1)")).alias("bit")
    return seen.select("node", "depth", "block", bit).select("node", "depth", (F.col("block") * 64 + F.col("bit")).alias("id")).join(numbered, "id").select("seed", "node", "depth")


# ------------------------------------------------------------------------- paths without enumeration
def _cyclic_core(hop: DataFrame) -> DataFrame:
    """Edges left when nodes without a way in or without a way out are dropped again and again: none in an
    acyclic graph."""
    rest, n = written(hop, "core"), -1
    while n != (n := rest.count()) and n:
        ins, outs = rest.select("t").distinct(), rest.select("s").distinct()
        kept = rest.join(ins.withColumnRenamed("t", "s"), "s", "left_semi").join(outs.withColumnRenamed("s", "t"), "t", "left_semi")
        rest = written(kept.select("s", "t"), "core")
    return rest


def _spread(rest: DataFrame, start: DataFrame) -> DataFrame:
    """(node, colour): the largest colour that reaches each node, of those that ``start(node, colour)`` has."""
    now, changed = written(start, "colours"), True
    while changed:
        sent = now.join(rest, F.col("node") == F.col("s")).select(F.col("t").alias("node"), "colour")
        new = written(now.unionByName(sent).groupBy("node").agg(F.max("colour").alias("colour")), "colours")
        changed = not new.join(now.withColumnRenamed("colour", "old"), "node", "left").filter("old is null or colour <> old").isEmpty()
        now = new
    return now


def strong_components(edges: DataFrame, source: str = "source_table_id", target: str = "target_table_id") -> DataFrame:
    """(node, component) of the nodes that lie on cycles of two or more; a component is named by one of its nodes. By
    colouring: the largest name that reaches a node colours it, and the nodes of that colour from which its namesake
    can be reached are its component. What is left is coloured again."""
    hop = edges.select(F.col(source).alias("s"), F.col(target).alias("t")).filter("s <> t").distinct()
    rest, found = _cyclic_core(hop), hop.select(F.col("s").alias("node"), F.col("s").alias("component")).limit(0)
    while not rest.isEmpty():
        nodes = rest.select(F.explode(F.array("s", "t")).alias("node")).distinct()
        colours = _spread(rest, nodes.withColumn("colour", F.col("node")))
        same = rest.join(colours.select(F.col("node").alias("s"), F.col("colour").alias("cs")), "s").join(colours.select(F.col("node").alias("t"), F.col("colour").alias("ct")), "t").filter("cs = ct")
        back = written(same.select(F.col("t").alias("s"), F.col("s").alias("t")), "back")
        members = _spread(back, colours.filter("node = colour")).select("node", F.col("colour").alias("component"))
        # a namesake alone has no cycle of its own; it goes all the same
        sizes = members.groupBy("component").agg(F.count("*").alias("n"))
        found = written(found.unionByName(members.join(sizes.filter("n > 1"), "component", "left_semi").select("node", "component")), "components")
        rest = _cyclic_core(rest.join(members.select(F.col("node").alias("s")), "s", "left_anti").join(members.select(F.col("node").alias("t")), "t", "left_anti").select("s", "t"))
    return found


def _by_levels(tables: DataFrame, edges: DataFrame, start, grow, merge) -> tuple[DataFrame, DataFrame]:
    """Values of (source, node) from Source tables on over the graph whose cycles are one node each, level by level: a
    node comes once all ways into it are done. Gives those of Output tables, by their own ids, and the components."""
    # edges may be many for one pair of tables, and are found anew by each job that reads them
    edges = written(edges.select("source_table_id", "target_table_id").distinct(), "pairs")
    parts = strong_components(edges)
    of = lambda df, c: df.join(parts.select(F.col("node").alias(c), F.col("component").alias(f"{c}_part")), c, "left").withColumn(c, F.coalesce(f"{c}_part", c)).drop(f"{c}_part")
    hop = edges.select(F.col("source_table_id").alias("s"), F.col("target_table_id").alias("t")).distinct()
    left = written(of(of(hop, "s"), "t").select("s", "t").filter("s <> t").distinct(), "dag")
    dag = left
    ends = tables.filter("role in ('Source', 'Output')").select(F.col("table_id").alias("id"), "role", F.col("table_id").alias("node"))
    ends = written(of(ends, "node"), "ends")
    sources = ends.filter("role = 'Source'").select("id", "node")
    todo = written(dag.select(F.explode(F.array("s", "t")).alias("node")).unionByName(ends.select("node")).distinct(), "todo")
    sent = start(sources).limit(0)
    done = []
    while not todo.isEmpty():
        ready = written(todo.join(left.select(F.col("t").alias("node")), "node", "left_anti"), "ready")
        own = start(sources.join(ready, "node", "left_semi"))
        values = written(merge(own.unionByName(sent.join(ready, "node", "left_semi").select(*own.columns))), "values")
        done.append(values)
        pushed = values.join(dag, F.col("node") == F.col("s"))
        sent = written(sent.join(ready, "node", "left_anti").select(*own.columns).unionByName(grow(pushed).select(*own.columns)), "sent")
        todo = written(todo.join(ready, "node", "left_anti"), "todo")
        left = written(left.join(ready.select(F.col("node").alias("s")), "s", "left_anti").select("s", "t"), "left")
    out = done[0] if done else sent
    for v in done[1:]:
        out = out.unionByName(v)
    goals = ends.filter("role = 'Output'").select(F.col("id").alias("output"), "node")
    return out.join(goals, "node").filter("source <> output"), parts


def path_counts(tables: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(source, output, n_paths): how many ways lead from each Source to each Output table, without listing one, and
    (node, component) of the tables on cycles, which count as one table each. Parallel edges count once. Counts have up
    to 38 digits."""
    start = lambda df: df.select(F.col("id").alias("source"), "node", F.lit(1).cast("decimal(38,0)").alias("n"))
    grow = lambda df: df.select("source", F.col("t").alias("node"), "n")
    merge = lambda df: df.groupBy("source", "node").agg(F.sum("n").cast("decimal(38,0)").alias("n"))
    found, parts = _by_levels(tables, edges, start, grow, merge)
    return found.select("source", "output", F.col("n").alias("n_paths")), parts


def shortest_paths(tables: DataFrame, edges: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(source, output, path): the ``k`` paths with the fewest edges, ties by their ids, from each Source to each Output
    table, and the components as in :func:`path_counts`; a cycle stands in a path under its component's name. No
    more than ``k`` paths are held for a source and a node."""
    start = lambda df: df.select(F.col("id").alias("source"), "node", F.array("node").alias("path"))
    grow = lambda df: df.select("source", F.col("t").alias("node"), F.concat("path", F.array("t")).alias("path"))
    nth = F.row_number().over(Window.partitionBy("source", "node").orderBy(F.size("path"), "path"))
    found, parts = _by_levels(tables, edges, start, grow, lambda df: df.withColumn("nth", nth).filter(F.col("nth") <= k).drop("nth"))
    return found.select("source", "output", "path"), parts


def table_graph(tables: DataFrame, columns: DataFrame, table_edges: DataFrame, column_edges: DataFrame) -> dict[str, DataFrame]:
    """``nodes`` (with lane and column count), ``edges`` and ``counts``."""
    n = columns.groupBy("table_id").agg(F.count("*").alias("column_count"))
    lane = F.create_map(*[F.lit(x) for kv in LANES.items() for x in kv])
    nodes = tables.join(n, "table_id", "left").select("table_id", "name", F.col("role").alias("lane"), F.coalesce(F.try_element_at(lane, F.col("role")), F.lit(1)).alias("lane_index"), "source_system", F.coalesce("column_count", F.lit(0)).alias("column_count"))
    edges = table_edges.select("edge_id", "source_table_id", "target_table_id", F.col("transformation_type").alias("label"), "model_id")
    one = lambda df, c: df.agg(F.count("*").alias(c))
    counts = one(tables, "tables").crossJoin(one(table_edges, "table_edges")).crossJoin(one(column_edges, "column_edges")).crossJoin(pending_review(table_edges, column_edges))
    return {"nodes": nodes, "edges": edges, "counts": counts}


def column_subgraph(table_id: str, tables: DataFrame, columns: DataFrame, column_edges: DataFrame) -> dict[str, DataFrame]:
    """A table's ``columns`` and the ``edges`` that touch it, both ends resolved to table ids."""
    index = tables.select(ids.canonical_name("name").alias("canon"), "table_id").groupBy("canon").agg(F.max("table_id").alias("table_id"))
    e = column_edges.withColumn("__s", ids.canonical_name(ids.element_table("source_element"))).withColumn("__t", ids.canonical_name(ids.element_table("target_element")))
    src = index.select(F.col("canon").alias("__s"), F.col("table_id").alias("source_table_id"))
    tgt = index.select(F.col("canon").alias("__t"), F.col("table_id").alias("target_table_id"))
    # only names of the wanted table can match, so edges are filtered before they are resolved
    mine = index.filter(F.col("table_id") == table_id).select("canon")
    e = e.join(F.broadcast(mine), (F.col("__s") == F.col("canon")) | (F.col("__t") == F.col("canon")), "left_semi")
    e = e.join(src, "__s", "left").join(tgt, "__t", "left").drop("__s", "__t")
    own = columns.filter(F.col("table_id") == table_id).join(tables.filter(F.col("table_id") == table_id).select("table_id", F.col("name").alias("__table")), "table_id")
    return {"columns": own.select(F.concat("__table", F.lit("."), "name").alias("element"), "table_id", "name"), "edges": e}


def pending_review(table_edges: DataFrame, column_edges: DataFrame) -> DataFrame:
    """(pending_review): proposed edges of both kinds."""
    both = table_edges.select("review_status").unionAll(column_edges.select("review_status"))
    return both.agg(F.count_if(F.col("review_status") == "Proposed").alias("pending_review"))


def filter_graph(tables: DataFrame, edges: DataFrame, model_id: str | None = None, low_confidence: bool = False, search: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Tables that pass all set filters, and the edges with both ends among them."""
    t = tables
    if model_id is not None:
        t = t.filter(F.array_contains("produced_by", model_id) | F.array_contains("consumed_by", model_id))
    if low_confidence:
        t = t.filter("confidence = 'Low'")
    if search:
        t = t.filter(F.lower("name").contains(search.strip().lower()))
    seen = t.select("table_id")
    e = edges.join(seen.withColumnRenamed("table_id", "source_table_id"), "source_table_id", "left_semi").join(seen.withColumnRenamed("table_id", "target_table_id"), "target_table_id", "left_semi")
    return t, e


def model_io(tables: DataFrame) -> DataFrame:
    """(model_id, direction, table_id, name), from the narrow rows of ``lineage.table_models`` or from tables that hold their
    models as arrays."""
    if "direction" in tables.columns:
        return tables.select("model_id", "direction", "table_id", "name")
    both = F.concat(F.transform("consumed_by", lambda m: F.struct(m.alias("model_id"), F.lit("input").alias("direction"))), F.transform("produced_by", lambda m: F.struct(m.alias("model_id"), F.lit("output").alias("direction"))))
    return tables.select("table_id", "name", F.explode(both).alias("x")).select("x.model_id", "x.direction", "table_id", "name")


def model_fan(tables: DataFrame) -> DataFrame:
    """(model_id, fan_in, fan_out)."""
    d = F.col("direction")
    return model_io(tables).groupBy("model_id").agg(F.count_if(d == "input").alias("fan_in"), F.count_if(d == "output").alias("fan_out"))


def hubs(edges: DataFrame, k: int) -> DataFrame:
    """(table_id, degree): the ``k`` tables with the most edges, ties by id."""
    ends = edges.select(F.explode(F.array("source_table_id", "target_table_id")).alias("table_id"))
    return ends.groupBy("table_id").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "table_id").limit(k)
