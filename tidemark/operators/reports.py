"""Flat report tables, lineage CSV, OpenLineage events and per-model registers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import ids

from tidemark.functions.scratch import written

from .graph import model_io

MISSING = "Not identified from code"
_join = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), ", ")
_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))


def run_summary(s: dict[str, DataFrame]) -> DataFrame:
    # numbers of models need no arrays of them
    n_in, n_out = (F.col("n_consumed"), F.col("n_produced")) if "table_totals" in s else (F.size("consumed_by"), F.size("produced_by"))
    t = s.get("table_totals", s["tables"]).agg(F.count_if(n_in > 0).alias("# Input tables"), F.count_if(n_out > 0).alias("# Output tables"))
    m = s["models"].agg(F.array_join(F.array_sort(F.collect_set("language")), ", ").alias("Languages detected"), F.count("*").alias("# Models"))
    n = lambda k, c: s[k].agg(F.count("*").alias(c))
    one = s["runs"].crossJoin(m).crossJoin(t).crossJoin(n("table_edges", "# Table-level edges")).crossJoin(n("column_edges", "# Column-level edges")).crossJoin(n("dq_rules", "# DQ rules"))
    return one.select(
        F.col("run_id").alias("Run ID"), F.col("timestamp").alias("Timestamp"), F.col("tool_version").alias("Tool version"), F.concat_ws(" / ", "llm_provider", "llm_model").alias("LLM provider / model"),
        "Languages detected", "# Models", "# Input tables", "# Output tables", "# Table-level edges", "# Column-level edges", "# DQ rules", F.col("tokens").alias("Tokens"), F.col("est_cost").alias("Est. cost"),
    )


def model_inventory(s: dict[str, DataFrame]) -> DataFrame:
    io = model_io(s.get("table_models", s["tables"])).groupBy("model_id").agg(F.count_if(F.col("direction") == "input").alias("i"), F.count_if(F.col("direction") == "output").alias("o"))
    m = s["models"].join(io, "model_id", "left")
    zero = F.lit(0)
    return m.select(
        F.col("model_id").alias("Model ID"), F.col("label").alias("Model label"), F.col("language").alias("Language"), _join("source_files").alias("Source file(s)"), _text("purpose").alias("Purpose"),
        F.coalesce("i", zero).alias("# Inputs"), F.coalesce("o", zero).alias("# Outputs"), F.col("confidence").alias("Confidence"), F.col("status").alias("Status"),
    )


def _named(df: DataFrame, **cols: str | Column) -> DataFrame:
    return df.select(*[(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in cols.items()])


def report_tables(s: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The nine report tables of a state, with fixed headers, as lazy projections."""
    tables = _named(s["tables"], **{"Table ID": "table_id", "Table name": "name", "Role": "role", "Source system": _text("source_system"), "Produced by model(s)": _join("produced_by"), "Consumed by model(s)": _join("consumed_by"), "Grain": _text("grain"), "Source": "source"})
    columns = _named(s["columns"], **{"Table ID": "table_id", "Column name": "name", "Inferred type": _text("inferred_type"), "Role": "role", "Used in": _join("used_in"), "Source": "source"})
    t_edges = _named(s["table_edges"], **{"Edge ID": "edge_id", "Source table ID": "source_table_id", "Target table ID": "target_table_id", "Model ID": "model_id", "Transformation type": "transformation_type", "Notes": _text("notes"), "Source": "source", "Confidence": "confidence"})
    c_edges = _named(s["column_edges"], **{"Edge ID": "edge_id", "Source table.column": "source_element", "Target table.column": "target_element", "Model ID": "model_id", "Transformation type": "transformation_type", "Transformation expression": _text("expression"), "Join key(s)": _join("join_keys"), "Source": "source", "Confidence": "confidence"})
    rules = _named(s["dq_rules"], **{"Rule ID": "rule_id", "Table.column": "element", "DQ dimension": "dimension", "Rule": "rule_statement", "Rationale / usage": "rationale", "Code evidence": "code_evidence", "Suggested severity": "severity", "Source": "source", "Status": "status"})
    systems = _named(s["source_systems"], **{"Source system": "name", "# Tables": F.size("tables"), "Table IDs": _join("tables")})
    issues = _named(s["issues"], **{"Model ID": _text("model_id"), "Severity": "severity", "Message": "message"})
    return {
        "Run Summary": run_summary(s), "Model Inventory": model_inventory(s), "Tables": tables, "Columns": columns, "Table Lineage": t_edges, "Column Lineage": c_edges,
        "Data Quality Rules": rules, "Source Systems": systems, "Issues & Confidence Log": issues,
    }


def write_report(report: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """One folder per table; CSV with headers."""
    for name, df in report.items():
        folder = "".join(c if c.isalnum() else "_" for c in name.lower())
        df.write.mode("overwrite").option("header", True).format(fmt).save(f"{path}/{folder}")


# Headers of the five-column lineage table.
LINEAGE_HEADERS = ["Source Element", "Target Element", "Model ID", "Transformation Type", "Edge ID"]


def lineage_csv(tables: DataFrame, table_edges: DataFrame, column_edges: DataFrame) -> DataFrame:
    """Column edges, or, if there are none, table edges with table names."""
    c = column_edges.select("source_element", "target_element", "model_id", "transformation_type", "edge_id").toDF(*LINEAGE_HEADERS)
    none = column_edges.agg(F.count("*").alias("n")).filter("n = 0")
    names = tables.select("table_id", "name")
    t = table_edges.join(names.toDF("source_table_id", "__s"), "source_table_id", "left").join(names.toDF("target_table_id", "__t"), "target_table_id", "left")
    t = t.select(F.coalesce("__s", "source_table_id"), F.coalesce("__t", "target_table_id"), "model_id", "transformation_type", "edge_id").toDF(*LINEAGE_HEADERS)
    return c.unionByName(t.crossJoin(F.broadcast(none)).drop("n"))


def openlineage_events(models: DataFrame, tables: DataFrame, column_edges: DataFrame, run_id: str, timestamp: str, namespace: str = "tidemark", producer: str = "https://example.org/tidemark") -> DataFrame:
    """(model_id, event): an OpenLineage COMPLETE event per model as JSON. An output dataset has a
    columnLineage facet with the model's own edges whose target table it is."""
    schema = "https://openlineage.io/spec/2-0-2/OpenLineage.json#/$defs/RunEvent"
    facet_schema = "https://openlineage.io/spec/facets/1-0-2/ColumnLineageDatasetFacet.json#/$defs/ColumnLineageDatasetFacet"
    e = column_edges.select("model_id", ids.element_table("target_element").alias("name"), ids.element_column("target_element").alias("column"), ids.element_table("source_element").alias("__source"), ids.element_column("source_element").alias("__field"), F.coalesce("expression", F.lit("")).alias("__expr"), "transformation_type", "edge_id")
    e = e.filter("name is not null and column <> '' and __source is not null")
    made = F.struct("edge_id", F.struct(F.col("__field").alias("field"), F.col("__source").alias("name"), F.lit(namespace).alias("namespace"), F.col("__expr").alias("transformationDescription"), F.col("transformation_type").alias("transformationType")).alias("f"))
    fields = e.groupBy("model_id", "name", "column").agg(F.transform(F.array_sort(F.collect_list(made)), lambda x: x["f"]).alias("inputFields"))
    facets = fields.groupBy("model_id", "name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("column", F.struct("inputFields", F.lit("DIRECT").alias("transformationType")))))).alias("fields"))
    io = model_io(tables).join(facets, ["model_id", "name"], "left")
    facet = F.when((F.col("direction") == "output") & F.col("fields").isNotNull(), F.struct(F.struct(F.lit(producer).alias("_producer"), F.lit(facet_schema).alias("_schemaURL"), "fields").alias("columnLineage")))
    sets = io.groupBy("model_id").agg(*[F.array_sort(F.collect_list(F.when(F.col("direction") == d, F.struct(F.col("name").alias("name"), F.lit(namespace).alias("namespace"), *([F.to_json(facet).alias("facets")] if d == "output" else []))))).alias(f"{d}s") for d in ("input", "output")])
    own = models.select("model_id").join(sets, "model_id", "left")
    # datasets are sorted by name; facets are strings so far, so they are put in as JSON at the end
    out = F.transform(F.coalesce("outputs", F.array().cast(sets.schema["outputs"].dataType)), lambda d: F.concat(F.lit("{"), F.when(d["facets"].isNotNull(), F.concat(F.lit('"facets":'), d["facets"], F.lit(","))).otherwise(F.lit("")), F.lit('"name":'), _json_text(d["name"]), F.lit(f',"namespace":"{namespace}"}}')))
    ins = F.transform(F.coalesce("inputs", F.array().cast(sets.schema["inputs"].dataType)), lambda d: F.concat(F.lit('{"name":'), _json_text(d["name"]), F.lit(f',"namespace":"{namespace}"}}')))
    event = F.concat(
        F.lit(f'{{"eventTime":"{timestamp}","eventType":"COMPLETE","inputs":['), F.array_join(ins, ","), F.lit('],"job":{"name":'), _json_text(F.col("model_id")), F.lit(f',"namespace":"{namespace}"}},"outputs":['), F.array_join(out, ","),
        F.lit(f'],"producer":"{producer}","run":{{"runId":"{run_id}"}},"schemaURL":"{schema}"}}'),
    )
    return own.select("model_id", event.alias("event"))


def _json_text(c: Column) -> Column:
    """A JSON string literal."""
    return F.regexp_replace(F.to_json(F.struct(c.alias("x"))), r'^\{"x":(.*)\}$', "$1")


# Sections of a model's register, in order.
SECTIONS = ["Cover / metadata", "Executive summary", "Purpose and scope", "Data inputs", "Assumptions and dependencies", "Methodology / processing logic", "Calculation logic", "Data outputs", "Data lineage summary", "Data quality considerations", "Limitations and risks", "Provenance and confidence", "Appendix: source listing"]


def model_register(s: dict[str, DataFrame]) -> DataFrame:
    """(model_id, section_no, section, ord, key, value) for all thirteen sections: texts and lists of the models
    (``executive_summary``, ``assumptions``, ``methodology_steps`` and ``limitations`` may be absent), inputs,
    outputs, lineage, calculations, and rules of the elements that the model uses, by dimension. An empty
    section has one row saying so."""
    m = s["models"]
    row = lambda no, order, key, value: [F.lit(no).alias("section_no"), F.lit(SECTIONS[no - 1]).alias("section"), order.cast("string").alias("ord"), key.alias("key"), value.cast("string").alias("value")]
    meta = F.array(*[F.struct(F.lit(f"{i:02d}").alias("o"), F.lit(k).alias("k"), v.alias("v")) for i, (k, v) in enumerate((("Model label", F.col("label")), ("Language", F.col("language")), ("Source file(s)", F.when(F.size("source_files") > 0, F.array_join("source_files", ", ")).otherwise(MISSING)), ("Status", F.col("status"))))])
    cover = m.select("model_id", F.explode(meta).alias("x")).select("model_id", *row(1, F.col("x.o"), F.col("x.k"), F.col("x.v")))
    purpose = m.select("model_id", *row(3, F.lit("00"), F.lit(""), F.when(F.length(F.coalesce("purpose", F.lit(""))) > 0, F.col("purpose")).otherwise(MISSING)))
    io = model_io(s.get("table_models", s["tables"]))
    text = lambda no, c: m.select("model_id", *row(no, F.lit("00"), F.lit(""), F.col(c))).filter("value <> ''") if c in m.columns else None
    listed = lambda no, c: m.select("model_id", F.posexplode(c).alias("p", "v")).select("model_id", *row(no, F.format_string("%04d", F.col("p") + 1), (F.col("p") + 1).cast("string"), F.col("v"))) if c in m.columns else None
    calcs = s["calculations"].select("model_id", *row(7, F.concat_ws("|", "target", "expression"), F.col("target"), F.col("expression"))) if "calculations" in s else None
    ins = io.filter("direction = 'input'").select("model_id", *row(4, F.col("name"), F.col("name"), F.col("table_id")))
    outs = io.filter("direction = 'output'").select("model_id", *row(8, F.col("name"), F.col("name"), F.col("table_id")))
    names = s["tables"].select("table_id", "name")
    e = s["table_edges"].join(names.toDF("source_table_id", "__s"), "source_table_id", "left").join(names.toDF("target_table_id", "__t"), "target_table_id", "left")
    flow = F.concat(F.coalesce("__s", "source_table_id"), F.lit(" -> "), F.coalesce("__t", "target_table_id"), F.lit(" ("), "transformation_type", F.lit(")"))
    edges = e.select("model_id", *row(9, F.col("edge_id"), F.col("edge_id"), flow))
    used = s["usages"].select("model_id", "element").distinct().join(s["dq_rules"], "element")
    rules = used.select("model_id", *row(10, F.concat_ws("|", "dimension", "element", "rule_id"), F.col("element"), F.concat_ws(" | ", "dimension", "severity", "rule_statement")))
    conf = m.select("model_id", *row(12, F.lit("00"), F.lit(""), F.concat(F.lit("Overall model confidence: "), "confidence", F.lit("."))))
    listing = m.select("model_id", *row(13, F.lit("00"), F.lit(""), F.when(F.size("source_files") > 0, F.array_join("source_files", ", ")).otherwise(MISSING)))
    full = cover.unionByName(purpose).unionByName(conf).unionByName(listing)
    # a part and the models that lack it come from one join, so no part is made twice
    named = m.groupBy("model_id").agg(F.count("*").alias("__rows"))
    parts = {2: text(2, "executive_summary"), 4: ins, 5: listed(5, "assumptions"), 6: listed(6, "methodology_steps"), 7: calcs, 8: outs, 9: edges, 10: rules, 11: listed(11, "limitations")}
    for no, part in parts.items():
        if part is None:
            full = full.unionByName(m.select("model_id", *row(no, F.lit("00"), F.lit(""), F.lit(MISSING))))
            continue
        both = part.select("model_id", "ord", "key", "value", F.lit(True).alias("__own")).join(named, "model_id", "full_outer")
        own = lambda c, other: F.when(F.col("__own"), F.col(c)).otherwise(other)
        both = both.withColumn("__row", F.explode(F.array_repeat(F.lit(1), F.when(F.col("__own"), 1).otherwise(F.col("__rows").cast("int")))))
        full = full.unionByName(both.select("model_id", *row(no, own("ord", "00"), own("key", ""), own("value", MISSING))))
    return full


def project_summary(s: dict[str, DataFrame], paths: DataFrame) -> DataFrame:
    """(section, key, value) over all models: the inventory, the lineage ``paths`` from sources to outputs (arrays
    of table ids) by name, the register, the source systems and the outputs. An empty section has one
    row saying so."""
    row = lambda df, section, key, value: df.select(F.lit(section).alias("section"), key.cast("string").alias("key"), value.cast("string").alias("value"))
    bar = lambda *cols: F.concat_ws(" | ", *[_text(c) for c in cols])
    steps = paths.select(F.array_join("path", ">").alias("key"), F.posexplode("path").alias("p", "table_id"))
    named = steps.join(s["tables"].select("table_id", "name"), "table_id", "left").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("p", F.coalesce("name", "table_id").alias("n")))).alias("x"))
    named = named.select("key", F.array_join(F.transform("x", lambda v: v["n"]), " -> ").alias("value"))
    parts = [
        row(s["models"], "Model inventory", F.col("model_id"), bar("label", "language", "status", "confidence", "purpose")),
        row(named, "Cross-model lineage", F.col("key"), F.col("value")),
        row(s["dq_rules"], "Data quality register", F.col("rule_id"), bar("element", "dimension", "severity", "status")),
        row(s["source_systems"], "Source systems", F.col("name"), F.size("tables")),
        row(s["tables"].filter("role = 'Output'"), "Outputs", F.col("table_id"), F.col("name")),
    ]
    sections = ["Model inventory", "Cross-model lineage", "Data quality register", "Source systems", "Outputs"]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # written once: the sections that are there are told by its rows
    out = written(out, "summary")
    every = s["models"].sparkSession.createDataFrame([(x,) for x in sections], "section string")
    return out.unionByName(every.join(out.select("section").distinct(), "section", "left_anti").select("section", F.lit("").alias("key"), F.lit(MISSING).alias("value")))
