"""Lineage assembly: from references and lineage rows to tables, columns and edges.

Every step is a keyed aggregate or an equi join. Where the first of several rows decides, inputs carry
an ``ord`` column; an ordered set is only built per entity (the models of a table).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import ids
from tidemark.functions.ordered import first_by, ordered_set
from tidemark.functions.scratch import written


def merge_extractions(parts: DataFrame) -> dict[str, DataFrame]:
    """Merge chunk extractions of each model. ``parts(model_id, chunk_no, purpose, executive_summary,
    assumptions, limitations, methodology_steps, transformations, input_tables, output_tables, calculations,
    lineage_rows)`` (``transformations`` may be absent) gives ``scalars`` (first non-empty texts, ordered sets, joined steps and transformations), ``tables`` (by direction and
    name, with the union of their columns), ``calculations`` (by target and expression) and ``lineage``
    (by source and target, the first type wins); a model with one part keeps its rows as they are. The parts are written
    first: each of the relations reads them, and would parse them again, once more for each list that it unfolds."""
    parts = written(parts, "parts")
    one = parts.groupBy("model_id").agg(F.count("*").alias("__parts"))
    first = lambda c: F.coalesce(F.min_by(c, F.when(F.length(F.coalesce(c, F.lit(""))) > 0, F.col("chunk_no"))), F.lit("")).alias(c)
    lists = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", F.coalesce(c, F.array()).alias("v")))), lambda p: p["v"]))
    scalars = parts.groupBy("model_id").agg(
        first("purpose"), first("executive_summary"), F.array_distinct(lists("assumptions")).alias("assumptions"), F.array_distinct(lists("limitations")).alias("limitations"), lists("methodology_steps").alias("methodology_steps"),
        (lists("transformations") if "transformations" in parts.columns else F.array().cast("array<string>")).alias("transformations"),
    )
    tables = None
    for direction in ("input", "output"):
        t = parts.select("model_id", "chunk_no", F.posexplode(f"{direction}_tables").alias("pos", "t"))
        t = t.select("model_id", F.lit(direction).alias("direction"), F.col("t.name").alias("name"), F.struct("chunk_no", "pos").alias("ord"), "t.columns")
        tables = t if tables is None else tables.unionByName(t)
    cols = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.coalesce("columns", F.array().cast("array<string>")).alias("c")))), lambda p: p["c"])))
    tables = tables.groupBy("model_id", "direction", "name").agg(F.min("ord").alias("ord"), cols.alias("columns"))
    calcs = parts.select("model_id", "chunk_no", F.posexplode("calculations").alias("pos", "c")).groupBy("model_id", F.col("c.target").alias("target"), F.col("c.expression").alias("expression")).agg(F.min(F.struct("chunk_no", "pos")).alias("ord"))
    rows = parts.select("model_id", "chunk_no", F.posexplode("lineage_rows").alias("pos", "r")).select("model_id", F.struct("chunk_no", "pos").alias("ord"), "r.*").join(one, "model_id")
    many = rows.filter("__parts > 1").groupBy("model_id", "source_element", "target_element").agg(first_by("transformation_type", "ord").alias("transformation_type"), F.min("ord").alias("ord"))
    lineage = rows.filter("__parts = 1").select("model_id", "source_element", "target_element", "transformation_type", "ord").unionByName(many)
    return {"scalars": scalars, "tables": tables, "calculations": calcs, "lineage": lineage}


def reference_set(extracted: DataFrame, scanned: DataFrame) -> DataFrame:
    """Extracted references and, per model and direction, the scanned ones whose canonical name is not
    among them. ``extracted(model_id, direction, name, columns, ord)``, ``scanned(model_id, direction,
    name, ord)``; adds ``canon`` and ``source`` (E or H)."""
    e = extracted.withColumn("canon", ids.canonical_name("name")).withColumn("source", F.lit("E"))
    s = scanned.withColumn("canon", ids.canonical_name("name"))
    new = s.join(e.select("model_id", "direction", "canon").distinct(), ["model_id", "direction", "canon"], "left_anti").select("model_id", "direction", "name", F.array().cast("array<string>").alias("columns"), "ord", "canon", F.lit("H").alias("source"))
    return e.select(*new.columns).unionByName(new)


def with_aliases(refs: DataFrame, libnames: DataFrame | None) -> DataFrame:
    """``canon`` with each model's library aliases resolved. ``libnames(model_id, alias, system)``."""
    if libnames is None:
        return refs
    first = F.substring_index("canon", ".", 1)
    lib = libnames.select("model_id", F.lower(F.trim("alias")).alias("__alias"), F.lower(ids.squeeze("system")).alias("__system")).groupBy("model_id", "__alias").agg(F.max("__system").alias("__system"))
    out = refs.withColumn("__alias", F.when(F.col("canon").contains("."), first)).join(lib, ["model_id", "__alias"], "left")
    moved = F.concat("__system", F.substring(F.col("canon"), F.length("__alias") + 1, F.length("canon")))
    return out.withColumn("canon", F.coalesce(moved, "canon")).drop("__alias", "__system")


def roles(refs: DataFrame) -> DataFrame:
    """(canon, role): produced and consumed tables are Intermediate, produced ones Output, others Source."""
    by = refs.groupBy("canon").agg(F.bool_or(F.col("direction") == "output").alias("out"), F.bool_or(F.col("direction") == "input").alias("in"))
    return by.select("canon", F.when(F.col("out") & F.col("in"), "Intermediate").when(F.col("out"), "Output").otherwise("Source").alias("role"))


def assemble_tables(refs: DataFrame, role_overrides: DataFrame | None = None) -> DataFrame:
    """One row per table: id, canonical name, role, source system, producing and consuming models in order,
    provenance of the first reference. ``role_overrides(table_id, role)`` wins. A table's models are one array:
    where a table may have very many, take ``table_totals`` and ``table_models``."""
    by = refs.groupBy("canon").agg(
        F.bool_or(F.col("direction") == "output").alias("__out"),
        F.bool_or(F.col("direction") == "input").alias("__in"),
        first_by("source", "ord").alias("source"),
        ordered_set(F.when(F.col("direction") == "output", F.col("model_id")), "ord").alias("produced_by"),
        ordered_set(F.when(F.col("direction") == "input", F.col("model_id")), "ord").alias("consumed_by"),
    )
    role = F.when(F.col("__out") & F.col("__in"), "Intermediate").when(F.col("__out"), "Output").otherwise("Source")
    t = by.select(ids.table_id("canon").alias("table_id"), F.col("canon").alias("name"), role.alias("role"), ids.source_system("canon").alias("source_system"), "produced_by", "consumed_by", "source")
    if role_overrides is None:
        return t
    o = role_overrides.select("table_id", F.col("role").alias("__role"))
    return t.join(o, "table_id", "left").withColumn("role", F.coalesce("__role", "role")).drop("__role")


def table_models(refs: DataFrame) -> DataFrame:
    """(table_id, name, direction, model_id, ord): a row per table, direction and model at its first reference."""
    one = refs.filter("model_id IS NOT NULL").groupBy("canon", "direction", "model_id").agg(F.min("ord").alias("ord"))
    return one.select(ids.table_id("canon").alias("table_id"), F.col("canon").alias("name"), "direction", "model_id", "ord")


def table_totals(refs: DataFrame) -> DataFrame:
    """``assemble_tables`` with the numbers of producing and consuming models instead of the models; references
    are reduced to a row per table, direction and model first, and no array is built."""
    one = refs.groupBy("canon", "direction", "model_id").agg(first_by("source", "ord").alias("source"), F.min("ord").alias("ord"))
    out, into = F.col("direction") == "output", F.col("direction") == "input"
    known = F.col("model_id").isNotNull()
    by = one.groupBy("canon").agg(F.bool_or(out).alias("__out"), F.bool_or(into).alias("__in"), first_by("source", "ord").alias("source"), F.count_if(out & known).alias("n_produced"), F.count_if(into & known).alias("n_consumed"))
    role = F.when(F.col("__out") & F.col("__in"), "Intermediate").when(F.col("__out"), "Output").otherwise("Source")
    return by.select(ids.table_id("canon").alias("table_id"), F.col("canon").alias("name"), role.alias("role"), ids.source_system("canon").alias("source_system"), "source", "n_produced", "n_consumed")


def assemble_columns(refs: DataFrame) -> DataFrame:
    """(table_id, name, source): union of the columns named for a table, first provenance wins."""
    cols = refs.select("canon", "source", F.col("ord").alias("__ord"), F.posexplode("columns").alias("pos", "name")).select("canon", "name", "source", F.struct("__ord", "pos").alias("ord"))
    # ids are made of what is left of the names
    one = cols.groupBy("canon", "name").agg(first_by("source", "ord").alias("source"), F.min("ord").alias("ord"))
    return one.groupBy(ids.table_id("canon").alias("table_id"), "name").agg(first_by("source", "ord").alias("source"))


def column_edges(lineage: DataFrame, calculations: DataFrame) -> DataFrame:
    """Column edges by id, the first row's spelling kept; the expression is the model's last calculation
    of the target. ``lineage(model_id, source_element, target_element, transformation_type, ord)``."""
    last = calculations.groupBy("model_id", "target").agg(F.max_by("expression", "ord").alias("expression"))
    kind = F.coalesce("transformation_type", F.lit("derive"))
    rows = lineage.withColumn("transformation_type", kind).withColumn("edge_id", ids.column_edge_id("source_element", "target_element", "model_id", "transformation_type"))
    rows = rows.join(last.withColumnRenamed("target", "target_element"), ["model_id", "target_element"], "left")
    one = rows.groupBy("edge_id").agg(first_by(F.struct("source_element", "target_element", "model_id", "transformation_type", "expression"), "ord").alias("e"))
    return one.select("edge_id", "e.*")


def lineage_pairs(lineage: DataFrame) -> DataFrame:
    """(model_id, source_table, target_table) named by lineage rows; both parts need a dotted table."""
    pairs = lineage.select("model_id", ids.element_table("source_element", strict=True).alias("source_table"), ids.element_table("target_element", strict=True).alias("target_table"))
    return pairs.filter("source_table is not null and target_table is not null").distinct()


def fallback_pairs(refs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Inputs by outputs of each model for which lineage names no pair (an equi join on the model)."""
    rest = refs.join(pairs.select("model_id").distinct(), "model_id", "left_anti")
    ins = rest.filter("direction = 'input'").select("model_id", F.col("canon").alias("source_table")).distinct()
    outs = rest.filter("direction = 'output'").select("model_id", F.col("canon").alias("target_table")).distinct()
    return ins.join(outs, "model_id")


def _named_pairs(refs: DataFrame, lineage: DataFrame) -> DataFrame:
    """(model_id, source_table, target_table, extracted): pairs from lineage, else from references."""
    pairs = lineage_pairs(lineage)
    return pairs.withColumn("extracted", F.lit(True)).unionByName(fallback_pairs(refs, pairs).withColumn("extracted", F.lit(False)))


def table_edges(refs: DataFrame, lineage: DataFrame) -> DataFrame:
    """Table edges of type ``derive``: from lineage (source E), else from references (source H), without
    self loops, once per id."""
    ends = F.array(F.struct(ids.table_id("source_table").alias("s"), ids.table_id("target_table").alias("t")))
    # exploded in the outer form, so that ids are not made once more for the comparison
    e = _named_pairs(refs, lineage).select("model_id", "extracted", F.explode(F.filter(ends, lambda x: x["s"] != x["t"])).alias("e")).select(F.col("e.s").alias("source_table_id"), F.col("e.t").alias("target_table_id"), "model_id", "extracted")
    one = e.groupBy("source_table_id", "target_table_id", "model_id").agg(F.bool_or("extracted").alias("extracted")).withColumn("transformation_type", F.lit("derive"))
    return one.select(ids.table_edge_id("source_table_id", "target_table_id", "model_id", "transformation_type").alias("edge_id"), "source_table_id", "target_table_id", "model_id", "transformation_type", F.when(F.col("extracted"), "E").otherwise("H").alias("source"))


def table_hops(refs: DataFrame, lineage: DataFrame) -> DataFrame:
    """(source_table_id, target_table_id) of ``table_edges``, once each, for questions that do not ask for models; ids are
    made of distinct names."""
    names = _named_pairs(refs, lineage).select("source_table", "target_table").distinct()
    return names.select(ids.table_id("source_table").alias("source_table_id"), ids.table_id("target_table").alias("target_table_id")).filter("source_table_id <> target_table_id").distinct()


def source_systems(tables: DataFrame) -> DataFrame:
    """(name, tables): sorted table ids per source system."""
    return tables.filter("source_system is not null").groupBy(F.col("source_system").alias("name")).agg(F.array_sort(F.collect_set("table_id")).alias("tables"))


def control_status(columns: DataFrame, tables: DataFrame, rules: DataFrame, edges: DataFrame) -> DataFrame:
    """``columns`` with ``control_status``. A column with a rejected rule is Dissented, with an accepted one
    Controlled; else it is Sourced if a column edge touches it, Not Sourced in an Output table, and Not
    Controlled elsewhere. Elements are compared as they are spelt, ``table.column``."""
    flags = rules.groupBy("element").agg(F.bool_or(F.col("status") == "Rejected").alias("rejected"), F.bool_or(F.col("status") == "Accepted").alias("accepted"))
    touched = edges.select(F.explode(F.array("source_element", "target_element")).alias("element")).distinct().withColumn("touched", F.lit(True))
    own = columns.join(tables.select("table_id", F.col("name").alias("__table"), F.col("role").alias("__role")), "table_id", "left").withColumn("element", F.concat("__table", F.lit("."), "name"))
    own = own.join(flags, "element", "left").join(touched, "element", "left")
    status = F.when(F.col("rejected"), "Dissented").when(F.col("accepted"), "Controlled").when(F.col("touched"), "Sourced").when(F.col("__role") == "Output", "Not Sourced").otherwise("Not Controlled")
    return own.withColumn("control_status", status).drop("__table", "__role", "element", "rejected", "accepted", "touched")


def telemetry(models: DataFrame) -> DataFrame:
    """Tokens and cost per run."""
    return models.groupBy("run_id").agg(F.count("*").alias("models"), F.sum(F.col("tokens_in") + F.col("tokens_out")).alias("tokens"), F.sum("est_cost").alias("est_cost"))


def assemble(models: DataFrame, extracted: DataFrame, scanned: DataFrame, lineage: DataFrame, calculations: DataFrame, usages: DataFrame, libnames: DataFrame | None = None, role_overrides: DataFrame | None = None, rule_status: DataFrame | None = None, issues: DataFrame | None = None, local: bool = False, retain_source: bool = True) -> dict[str, DataFrame]:
    """The whole state: the references are written once, all else is lazy: models, tables, their models as narrow rows, columns, edges, usages, rules, calculations, source systems and
    issues. Control status is derived after the rules' final status; last, a local run that does not retain its
    sources is scrubbed of snippets, which is an issue of its own."""
    from . import rules as R
    from .runs import scrub

    refs = written(with_aliases(reference_set(extracted, scanned), libnames), "refs")
    tables, columns = assemble_tables(refs, role_overrides), assemble_columns(refs)
    edges = column_edges(lineage, calculations)
    register = R.register(usages, tables, columns)
    register = R.set_status(register, rule_status) if rule_status is not None else register
    if issues is None:
        issues = models.sparkSession.createDataFrame([], "model_id string, severity string, message string")
    state = {
        "models": models,
        "tables": tables,
        "table_models": table_models(refs),
        "table_totals": table_totals(refs),
        "columns": control_status(columns, tables, register, edges),
        "table_edges": table_edges(refs, lineage),
        "column_edges": edges,
        "usages": usages,
        "dq_rules": register,
        "calculations": calculations,
        "source_systems": source_systems(tables),
        "issues": issues,
    }
    return scrub(state, local, retain_source)
