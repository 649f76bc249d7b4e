"""Delta assembly: a state of tables, columns, edges and rules that is kept up to date when few models change.

What a model refers to, and its edges, are kept by ranges of model ids; tables and columns, with the numbers of models
and references behind them, by ranges of names. A change takes the old references of the changed models away (-1)
and adds the new ones (+1), so only ranges that these touch are read and written; all others are shared with the state
before. A first reference cannot be counted down: where it goes, the table's log of references is read, and nothing else.
Rules are kept by the table part of their element, with the usages and columns that they come from: a change infers those
of the elements that it uses and of the tables that it touches, and their numbers of models, anew. A range's log that has
become many folders is written as one of the references that still stand.
A row published last makes the new state visible as a whole."""

from __future__ import annotations

import json
import time
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions import ids
from tidemark.functions.scratch import written
from tidemark.operators import lineage as L
from tidemark.operators import rules as R

RANGES = 64
#: So many folders of a range's log are written as one by the next change to it.
LOG_FOLDERS = 8
#: Each kind and the column whose hash gives its range.
KEYS = {"refs": "model_id", "edges": "model_id", "usages": "model_id", "tables": "canon", "columns": "canon", "log": "canon", "uses": "key", "elements": "key", "rules": "key"}
_SAME = ["model_id", "direction", "canon", "columns", "ord", "source"]
_STATE = "at long, ranges int, schemas map<string,string>, folders array<struct<kind:string,part:int,folder:string>>"


def _part(key: str, ranges: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(ranges)).cast("int")


def newest(spark: SparkSession, path: str) -> dict:
    """The state published last: its number of ranges, schemas, and the folders of each kind and range."""
    row = spark.read.schema(_STATE).parquet(f"{path}/__states").orderBy(F.desc("at")).first()
    return row.asDict(recursive=True)


def _publish(spark: SparkSession, path: str, ranges: int, schemas: dict[str, str], folders: list[tuple]) -> None:
    spark.createDataFrame([(time.time_ns(), ranges, schemas, folders)], _STATE).coalesce(1).write.mode("append").parquet(f"{path}/__states")


def _write(df: DataFrame, path: str, kind: str, ranges: int) -> list[tuple]:
    folder, spark = f"{path}/{kind}/{uuid.uuid4().hex}", df.sparkSession
    df.withColumn("__part", _part(KEYS[kind], ranges)).hint("rebalance", "__part").write.partitionBy("__part").parquet(folder)
    there = spark.read.schema(StructType([*df.schema.fields, *spark.range(0).select(F.lit(1).alias("__part")).schema.fields])).parquet(folder)
    return [(kind, r[0], f"{folder}/__part={r[0]}") for r in there.select("__part").distinct().collect()]


def _write_all(kinds: dict[str, DataFrame], path: str, ranges: int) -> list[tuple]:
    """The folders of all kinds; their jobs are small and run side by side."""
    with ThreadPoolExecutor(len(kinds)) as pool:
        return [x for folders in pool.map(lambda kind: _write(kinds[kind], path, kind, ranges), kinds) for x in folders]


def read(spark: SparkSession, state: dict, kind: str, parts: set[int] | None = None) -> DataFrame:
    """A kind's rows, of all ranges or of ``parts``."""
    schema = StructType.fromJson(json.loads(state["schemas"][kind]))
    own = [f["folder"] for f in state["folders"] if f["kind"] == kind and (parts is None or f["part"] in parts)]
    return spark.read.schema(schema).parquet(*own) if own else spark.createDataFrame([], schema)


def _table_rows(refs: DataFrame, sign: Column) -> DataFrame:
    """(canon, n_out, n_in, first): models that write and read a table, and its first reference."""
    one = refs.groupBy("canon", "direction", "model_id").agg(F.min(F.struct("ord", "source")).alias("first"))
    n = lambda d: F.coalesce(F.sum(F.when(F.col("direction") == d, sign)), F.lit(0)).cast("long")
    return one.groupBy("canon").agg(n("output").alias("n_out"), n("input").alias("n_in"), F.min("first").alias("first"))


def _column_rows(refs: DataFrame, sign: Column) -> DataFrame:
    """(canon, name, n, first): references that name a column, and the first of them."""
    named = refs.select("canon", "ord", "source", F.posexplode("columns").alias("pos", "name"))
    return named.groupBy("canon", "name").agg(F.sum(sign).cast("long").alias("n"), F.min(F.struct("ord", "pos", "source")).alias("first"))


_ROWS = {"tables": (_table_rows, ("canon",), ("n_out", "n_in")), "columns": (_column_rows, ("canon", "name"), ("n",))}


def _key(element: Column) -> Column:
    """Where rules of an element are kept: its table part as rule ids see it, or all of it where there is none."""
    e = ids.strip(F.lower(element))
    return F.coalesce(ids.element_table(e), e)


def _with_key(usages: DataFrame) -> DataFrame:
    return usages.select(_key(F.col("element")).alias("key"), "model_id", "element", "usage_kind", "evidence", "ord")


def _elements(columns: DataFrame) -> DataFrame:
    """(key, canon, name) of ``columns(canon, name)``."""
    return columns.select(_key(F.concat("canon", F.lit("."), "name")).alias("key"), "canon", "name")


def _register(uses: DataFrame, elements: DataFrame, tables: DataFrame, models: DataFrame) -> DataFrame:
    out = R.register_totals(uses, tables, elements.select(ids.table_id("canon").alias("table_id"), "name"), models)
    return out.withColumn("key", _key(F.col("element")))


def start(refs: DataFrame, edges: DataFrame, path: str, ranges: int = RANGES, usages: DataFrame | None = None) -> None:
    """Write the state of ``refs`` (as ``reference_set`` gives them; every one has a model) and ``edges`` (``table_edges``).
    Rules are kept where ``usages(element, usage_kind, evidence, model_id, ord)`` are given."""
    own = written(refs.select(*_SAME), "refs")
    kinds = {"refs": own, "edges": edges, "log": own.withColumn("sign", F.lit(1).cast("long"))}
    kinds |= {k: f(own, F.lit(1)) for k, (f, _, _) in _ROWS.items()}
    if usages is not None:
        kinds["usages"] = written(usages.select("model_id", "element", "usage_kind", "evidence", "ord"), "usages")
        kinds["uses"] = _with_key(kinds["usages"])
        kinds["elements"] = written(_elements(_column_rows(own, F.lit(1))), "elements")
        kinds["rules"] = _register(kinds["uses"], kinds["elements"], L.table_totals(own), written(L.table_models(own), "models"))
    folders = _write_all(kinds, path, ranges)
    _publish(refs.sparkSession, path, ranges, {k: df.schema.json() for k, df in kinds.items()}, folders)


def change(changed: DataFrame, refs: DataFrame, edges: DataFrame, path: str, usages: DataFrame | None = None) -> None:
    """The state after the models ``changed(model_id)`` got ``refs``, ``edges`` and, where the state keeps rules, ``usages``
    instead of their old ones; a model without any is gone. Rows of other models in these are not looked at."""
    spark = changed.sparkSession
    state = newest(spark, path)
    if ("usages" in state["schemas"]) != (usages is not None):
        raise ValueError("usages belong to a state that keeps rules, and to no other")
    ranges = state["ranges"]
    who = written(changed.select("model_id").distinct(), "changed")
    mine = _parts(who, "model_id", ranges)
    old = read(spark, state, "refs", mine)
    lost = written(old.join(who, "model_id", "left_semi"), "lost")
    new = written(refs.join(who, "model_id", "left_semi").select(*lost.columns), "gained")
    touched = written(lost.select("canon").unionByName(new.select("canon")).distinct(), "touched")
    theirs = _parts(touched, "canon", ranges)

    one = F.lit(1).cast("long")
    log = lost.withColumn("sign", -one).unionByName(new.withColumn("sign", one))
    made = {"refs": old.join(who, "model_id", "left_anti").unionByName(new), "edges": read(spark, state, "edges", mine).join(who, "model_id", "left_anti").unionByName(edges.join(who, "model_id", "left_semi"))}
    with ThreadPoolExecutor(len(_ROWS)) as pool:
        made |= dict(zip(_ROWS, pool.map(lambda kind: _counted(spark, state, kind, *_ROWS[kind], lost, new, log, theirs), _ROWS)))
    long = {p for p in theirs if sum(f["kind"] == "log" and f["part"] == p for f in state["folders"]) >= LOG_FOLDERS}
    kept = read(spark, state, "log", long).groupBy(*_SAME).agg(F.sum("sign").alias("sign")).filter("sign <> 0")
    done = {"refs": mine, "edges": mine, "tables": theirs, "columns": theirs, "log": long}
    after = _replaced(state, path, {**made, "log": log.unionByName(kept) if long else log}, done)
    if usages is not None:
        after = _change_rules(spark, state, after, path, usages, who, new, touched)
    _publish(spark, path, ranges, state["schemas"], [(f["kind"], f["part"], f["folder"]) for f in after["folders"]])


def _parts(df: DataFrame, key: str, ranges: int) -> set[int]:
    return {r[0] for r in df.select(_part(key, ranges)).distinct().collect()}


def _replaced(state: dict, path: str, made: dict[str, DataFrame], done: dict[str, set[int]]) -> dict:
    """``state`` with the rows ``made`` instead of the ranges ``done`` of each kind; not published yet."""
    folders = [f for f in state["folders"] if f["part"] not in done.get(f["kind"], ())]
    rows = {kind: df.select(*StructType.fromJson(json.loads(state["schemas"][kind])).names) for kind, df in made.items()}
    new = [{"kind": kind, "part": part, "folder": folder} for kind, part, folder in _write_all(rows, path, state["ranges"])]
    return {**state, "folders": folders + new}


def _change_rules(spark: SparkSession, before: dict, after: dict, path: str, usages: DataFrame, who: DataFrame, gained: DataFrame, touched: DataFrame) -> dict:
    """``after``, which has the new tables and columns already, with the rules that the change touches inferred anew."""
    ranges = before["ranges"]
    mine, theirs = _parts(who, "model_id", ranges), _parts(touched, "canon", ranges)
    old = read(spark, before, "usages", mine)
    lost = old.join(who, "model_id", "left_semi")
    new = written(usages.join(who, "model_id", "left_semi").select(*old.columns), "new-usages")
    named = gained.select("canon", F.explode("columns").alias("name")).unionByName(read(spark, before, "columns", theirs).join(touched, "canon", "left_semi").select("canon", "name"))
    keys = _with_key(lost.unionByName(new)).select("key").unionByName(_elements(named).select("key")).unionByName(touched.select(_key(F.concat("canon", F.lit("."))).alias("key")))
    keys = written(keys.distinct(), "keys")
    parts = _parts(keys, "key", ranges)

    uses = written(read(spark, before, "uses", parts).join(who, "model_id", "left_anti").unionByName(_with_key(new)), "uses")
    columns = read(spark, after, "columns", theirs).join(touched, "canon", "left_semi").select("canon", "name")
    elements = written(read(spark, before, "elements", parts).join(touched, "canon", "left_anti").unionByName(_elements(columns)), "elements")
    u, e = uses.join(keys, "key", "left_semi"), elements.join(keys, "key", "left_semi")
    spelt = u.select("element").unionByName(e.select(F.concat("canon", F.lit("."), "name").alias("element")))
    of = written(spelt.select(ids.element_table("element").alias("canon")).filter("canon IS NOT NULL").unionByName(e.select("canon")).distinct(), "of")
    where = _parts(of, "canon", ranges)
    tables = _as_tables(read(spark, after, "tables", where).join(of, "canon", "left_semi"))
    log = read(spark, after, "log", where).join(of, "canon", "left_semi")
    models = written(L.table_models(_standing(log, "model_id", "direction", "canon", "ord")), "models")
    rules = read(spark, before, "rules", parts).join(keys, "key", "left_anti").unionByName(_register(u, e, tables, models))
    made = {"usages": old.join(who, "model_id", "left_anti").unionByName(new), "uses": uses, "elements": elements, "rules": rules}
    return _replaced(after, path, made, {"usages": mine, "uses": parts, "elements": parts, "rules": parts})


def _standing(log: DataFrame, *by: str) -> DataFrame:
    """The references of a log that were not taken away, or their columns ``by``, once each."""
    return log.groupBy(*(by or _SAME)).agg(F.sum("sign").alias("n")).filter("n > 0")


def _counted(spark: SparkSession, state: dict, kind: str, rows, keys: tuple[str, ...], counts: tuple[str, ...], lost: DataFrame, new: DataFrame, log: DataFrame, parts: set[int]) -> DataFrame:
    """The rows of the ranges ``parts`` with the counts of ``lost`` taken away and those of ``new`` added."""
    renamed = lambda df, tag: df.select(*keys, *[F.col(c).alias(f"{tag}_{c}") for c in (*counts, "first")])
    now = renamed(read(spark, state, kind, parts), "now")
    both = now.join(renamed(rows(lost, F.lit(-1)), "lost"), list(keys), "full_outer").join(renamed(rows(new, F.lit(1)), "new"), list(keys), "full_outer")
    total = lambda c: sum((F.coalesce(f"{tag}_{c}", F.lit(0)) for tag in ("now", "lost", "new")), F.lit(0).cast("long"))
    gone = F.coalesce(F.col("lost_first") <= F.col("now_first"), F.lit(False))
    out = both.select(*keys, *[total(c).alias(c) for c in counts], F.when(~gone, F.least("now_first", "new_first")).alias("kept"), gone.alias("gone"))
    out = written(out.filter(" + ".join(counts) + " > 0"), "counted")
    # a first reference that went: the table's log, with this change, has the next one
    ask = written(out.filter("gone").select("canon").distinct(), "ask")
    where = {r[0] for r in ask.select(_part("canon", state["ranges"])).distinct().collect()}
    left = _standing(read(spark, state, "log", where).unionByName(log).join(ask, "canon", "left_semi"))
    again = rows(left, F.lit(1)).select(*keys, F.col("first").alias("next"))
    return out.join(again, list(keys), "left").select(*keys, *counts, F.when(F.col("gone"), F.col("next")).otherwise(F.col("kept")).alias("first"))


def _as_tables(t: DataFrame) -> DataFrame:
    role = F.when((F.col("n_out") > 0) & (F.col("n_in") > 0), "Intermediate").when(F.col("n_out") > 0, "Output").otherwise("Source")
    return t.select(ids.table_id("canon").alias("table_id"), F.col("canon").alias("name"), role.alias("role"), ids.source_system("canon").alias("source_system"), F.col("first.source").alias("source"), F.col("n_out").alias("n_produced"), F.col("n_in").alias("n_consumed"))


def tables(spark: SparkSession, path: str) -> DataFrame:
    """The tables, as ``lineage.table_totals`` gives them."""
    return _as_tables(read(spark, newest(spark, path), "tables"))


def columns(spark: SparkSession, path: str) -> DataFrame:
    """The columns, as ``lineage.assemble_columns`` gives them."""
    return read(spark, newest(spark, path), "columns").select(ids.table_id("canon").alias("table_id"), "name", F.col("first.source").alias("source"))


def edges(spark: SparkSession, path: str) -> DataFrame:
    """The table edges, as ``lineage.table_edges`` gives them."""
    return read(spark, newest(spark, path), "edges")


def rules(spark: SparkSession, path: str) -> DataFrame:
    """The rules, as ``rules.register_totals`` gives them."""
    return read(spark, newest(spark, path), "rules").drop("key")
