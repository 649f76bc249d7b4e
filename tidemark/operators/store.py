"""The run store. A save writes all kinds to a version of their own and then publishes it by one row, so a reader sees the
whole run as it was or as it is now. Kinds with ids are kept by ranges of their ids' hashes, with a tree of digests
over the ranges: two versions are compared from the root down, and only ranges that differ are read."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .runs import ENTITY_IDS, diff

#: Ranges of a kind where nothing else is said, and how many nodes of the tree share a parent.
RANGES, FANOUT = 64, 8
_PUBLISHED = "run_id string, version string, at long, kinds array<string>"


def save_run(state: dict[str, DataFrame], path: str, run_id: str, ranges: int = RANGES) -> str:
    """Write each table of ``state`` under ``path`` and publish them together as the run's newest version, which is
    returned. A kind that is not in ``state`` has no rows in the run from then on; what an unfinished save wrote is
    never read. Any text may be a run id. Columns named run_id give way to it."""
    version = f"v{uuid.uuid4().hex}"
    spark = None
    for kind, df in state.items():
        spark = df.sparkSession
        rows, folder, key = df.drop("run_id"), f"{path}/{kind}/__version={version}", ENTITY_IDS.get(kind)
        if key not in rows.columns:
            rows.write.parquet(folder)
            continue
        where = F.pmod(F.xxhash64(key), F.lit(ranges)).cast("int")
        rows.withColumn("__range", where).repartition(ranges, "__range").write.partitionBy("__range").parquet(folder)
        _tree(spark.read.parquet(folder), key, ranges).write.parquet(f"{path}/__trees/{kind}/{version}")
    if spark is None:
        raise ValueError("a run without tables")
    row = spark.createDataFrame([(run_id, version, time.time_ns(), sorted(state))], _PUBLISHED)
    row.coalesce(1).write.mode("append").parquet(f"{path}/__published")
    return version


def _tree(rows: DataFrame, key: str, ranges: int) -> DataFrame:
    """(level, node, n, x, y, ranges): for each node the rows below it and two exclusive ors of hashes of their
    contents; level 0 is the root, and node k's parent is k div FANOUT."""
    content = F.to_json(F.struct(*sorted(c for c in rows.columns if c != "__range")), {"ignoreNullFields": "false"})
    leaves = rows.select("__range", content.alias("c")).select("__range", F.xxhash64("c").alias("x"), F.xxhash64(F.sha1("c")).alias("y"))
    leaves = leaves.groupBy("__range").agg(F.count("*").alias("n"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    depth = _depth(ranges)
    up = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.floor(F.col("__range") / FANOUT ** (depth - k)).cast("int").alias("node")) for k in range(depth + 1)])).alias("t")
    by = leaves.select(up, "n", "x", "y").groupBy("t.level", "t.node")
    return by.agg(F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")).withColumn("ranges", F.lit(ranges))


def _depth(ranges: int) -> int:
    depth = 0
    while FANOUT**depth < ranges:
        depth += 1
    return depth


def published(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, version, kinds): the newest version of each run."""
    rows = spark.read.schema(_PUBLISHED).parquet(f"{path}/__published")
    return rows.groupBy("run_id").agg(F.max_by(F.struct("version", "kinds"), F.struct("at", "version")).alias("v")).select("run_id", "v.*")


def load_run(spark: SparkSession, path: str, kind: str, run_id: str | None = None) -> DataFrame:
    """A kind's rows, with ``run_id``, of one run (its version alone is read) or of the newest version of all runs."""
    own = published(spark, path).filter(F.array_contains("kinds", kind))
    every = spark.read.option("basePath", f"{path}/{kind}").parquet(f"{path}/{kind}")
    if run_id is None:
        rows = every.join(F.broadcast(own.select(F.col("version").alias("__version"), "run_id")), "__version")  # a row a run
    else:
        found = own.filter(F.col("run_id") == run_id).first()
        rows = (every.filter("false") if found is None else every.filter(F.col("__version") == found["version"])).withColumn("run_id", F.lit(run_id))
    return rows.drop("__version", "__range")


def entity_ids(spark: SparkSession, path: str, kind: str, run_id: str) -> DataFrame:
    """Sorted ids of a kind in one run."""
    key = ENTITY_IDS[kind]
    return load_run(spark, path, kind, run_id).select(key).distinct().orderBy(key)


def changed_ranges(spark: SparkSession, path: str, kind: str, a: str, b: str) -> list[int] | None:
    """The ranges in which two versions of a kind differ, found from the root down; None if their ranges are not the same.
    Each step looks at the children of nodes that differ, so no more rows come here than FANOUT times these."""
    trees = [spark.read.parquet(f"{path}/__trees/{kind}/{v}") for v in (a, b)]
    tops = [t.filter("level = 0").first() for t in trees]
    if any(t is None for t in tops):
        return None
    if tops[0]["ranges"] != tops[1]["ranges"]:
        return None
    nodes: list[int] = [0]
    for level in range(_depth(tops[0]["ranges"]) + 1):
        if level:
            nodes = [k * FANOUT + i for k in nodes for i in range(FANOUT)]
        one, two = ({r["node"]: (r["n"], r["x"], r["y"]) for r in t.filter((F.col("level") == level) & F.col("node").isin(nodes)).collect()} for t in trees)
        nodes = [k for k in nodes if one.get(k) != two.get(k)]
        if not nodes:
            break
    return nodes


def diff_stored(spark: SparkSession, path: str, kind: str, a: str, b: str) -> DataFrame:
    """(kind, id, change) from run ``a`` to run ``b``, as :func:`tidemark.operators.runs.diff` gives it, from the ranges that
    differ alone. A run that is not there is an error."""
    own = {r["run_id"]: r["version"] for r in published(spark, path).filter(F.col("run_id").isin(a, b)).collect()}
    versions = [own[a], own[b]]
    rows = [spark.read.parquet(f"{path}/{kind}/__version={v}") for v in versions]
    ranges = changed_ranges(spark, path, kind, *versions)
    if ranges is not None:
        rows = [r.filter(F.col("__range").isin(ranges) if ranges else F.lit(False)) for r in rows]
    return diff(*[r.drop("__range") for r in rows], ENTITY_IDS[kind], kind)


def log_overrides(overrides: DataFrame, path: str) -> None:
    """Append to the log."""
    overrides.write.mode("append").partitionBy("run_id").parquet(path)


def read_overrides(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """The log of one run, whose folder alone is read. Folder names are texts, whatever they look like."""
    found = spark.read.parquet(path).schema
    schema = StructType([StructField("run_id", StringType()) if f.name == "run_id" else f for f in found.fields])
    return spark.read.schema(schema).parquet(path).filter(F.col("run_id") == run_id).orderBy("seq")
