"""Tolerant reading of extraction JSON: table lists and lineage rows in several shapes become one schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TABLES = "array<struct<name:string,columns:array<string>>>"
_CALCS = "array<struct<target:string,expression:string>>"
_ROWS = "array<struct<source_element:string,target_element:string,transformation_type:string>>"


def _kind(v: Column) -> Column:
    """ARRAY, OBJECT, STRING ... of a variant; null for null."""
    return F.when(F.is_variant_null(v), None).otherwise(F.regexp_extract(F.schema_of_variant(v), r"^(\w+)", 1))


def _csv(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def _columns(v: Column) -> Column:
    """A list of names, from a list or a comma-separated string."""
    k = _kind(v)
    return F.when(k == "ARRAY", F.filter(F.try_variant_get(v, "$", "array<string>"), lambda x: x.isNotNull())).when(k == "STRING", _csv(F.try_variant_get(v, "$", "string"))).otherwise(F.array().cast("array<string>"))


def tables(v: Column) -> Column:
    """Tables given as null, a comma-separated string, an object of name to columns, one object with a
    ``name``, or a list of strings and objects."""
    k = _kind(v)
    of_names = lambda names: F.transform(names, lambda n: F.struct(n.alias("name"), F.array().cast("array<string>").alias("columns")))
    item = lambda x: F.when(_kind(x) == "STRING", F.struct(F.trim(F.try_variant_get(x, "$", "string")).alias("name"), F.array().cast("array<string>").alias("columns"))).when(
        _kind(x) == "OBJECT", F.struct(F.try_variant_get(x, "$.name", "string").alias("name"), _columns(F.try_variant_get(x, "$.columns", "variant")).alias("columns"))
    )
    listed = F.filter(F.transform(F.try_variant_get(v, "$", "array<variant>"), item), lambda t: t["name"].isNotNull() & (t["name"] != ""))
    by_name = F.transform(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), lambda e: F.struct(e["key"].alias("name"), _columns(e["value"]).alias("columns")))
    single = F.array(F.struct(F.try_variant_get(v, "$.name", "string").alias("name"), _columns(F.try_variant_get(v, "$.columns", "variant")).alias("columns")))
    named = F.try_variant_get(v, "$.name", "string").isNotNull()
    return F.when(k == "ARRAY", listed).when(k == "STRING", of_names(_csv(F.try_variant_get(v, "$", "string")))).when((k == "OBJECT") & named, single).when(k == "OBJECT", by_name).otherwise(F.array().cast(_TABLES))


def lineage_rows(v: Column) -> Column:
    """Lineage given as a string ``a -> b`` (without an arrow it gives nothing), one object, or a list of
    both; objects may say ``source_element``/``target_element`` or ``source``/``target``."""
    k = _kind(v)

    def arrow(text: Column) -> Column:
        parts = F.split(text, r"\s*->\s*", 2)
        return F.when(text.contains("->"), F.struct(F.trim(parts[0]).alias("source_element"), F.trim(F.try_element_at(parts, F.lit(2))).alias("target_element"), F.lit("derive").alias("transformation_type")))

    def obj(x: Column) -> Column:
        g = lambda *names: F.coalesce(*[F.try_variant_get(x, f"$.{n}", "string") for n in names])
        return F.struct(g("source_element", "source").alias("source_element"), g("target_element", "target").alias("target_element"), F.coalesce(g("transformation_type"), F.lit("derive")).alias("transformation_type"))

    item = lambda x: F.when(_kind(x) == "STRING", arrow(F.try_variant_get(x, "$", "string"))).when(_kind(x) == "OBJECT", obj(x))
    ok = lambda r: r.isNotNull() & r["source_element"].isNotNull() & r["target_element"].isNotNull()
    listed = F.filter(F.transform(F.try_variant_get(v, "$", "array<variant>"), item), ok)
    one = F.filter(F.array(item(v)), ok)
    return F.when(k == "ARRAY", listed).when(k.isin("STRING", "OBJECT"), one).otherwise(F.array().cast(_ROWS))


def texts(v: Column) -> Column:
    """A list of strings; a single string is a list of one, anything else none."""
    k = _kind(v)
    return F.when(k == "ARRAY", F.filter(F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.try_variant_get(x, "$", "string")), lambda x: x.isNotNull())).when(k == "STRING", F.array(F.try_variant_get(v, "$", "string"))).otherwise(F.array().cast("array<string>"))


def calculations(v: Column) -> Column:
    """A list of objects with ``target`` and ``expression``, or one; objects that lack either are left out."""
    k = _kind(v)
    one = lambda x: F.struct(F.try_variant_get(x, "$.target", "string").alias("target"), F.try_variant_get(x, "$.expression", "string").alias("expression"))
    every = F.when(k == "ARRAY", F.transform(F.try_variant_get(v, "$", "array<variant>"), one)).when(k == "OBJECT", F.array(one(v))).otherwise(F.array().cast(_CALCS))
    return F.filter(every, lambda c: c["target"].isNotNull() & c["expression"].isNotNull())


def parse_extractions(raw: DataFrame, raw_col: str = "raw") -> tuple[DataFrame, DataFrame]:
    """Rows whose JSON is an object, with ``purpose``, ``executive_summary``, ``assumptions``,
    ``methodology_steps``, ``limitations``, ``transformations``, ``input_tables``, ``output_tables``,
    ``calculations`` and ``lineage_rows``, which ``merge_extractions`` takes; and the others (quarantine) with
    the reason."""
    v = raw.withColumn("__v", F.try_parse_json(raw_col))
    ok = F.col("__v").isNotNull() & F.coalesce(_kind(F.col("__v")) == "OBJECT", F.lit(False))
    get = lambda n: F.try_variant_get("__v", f"$.{n}", "variant")
    text = lambda n: F.coalesce(F.try_variant_get("__v", f"$.{n}", "string"), F.lit("")).alias(n)
    good = v.filter(ok).select(
        *raw.columns, text("purpose"), text("executive_summary"), *[texts(get(n)).alias(n) for n in ("assumptions", "methodology_steps", "limitations", "transformations")],
        tables(get("input_tables")).alias("input_tables"), tables(get("output_tables")).alias("output_tables"), calculations(get("calculations")).alias("calculations"), lineage_rows(get("lineage_rows")).alias("lineage_rows"),
    )
    bad = v.filter(~ok).select(*raw.columns, F.when(F.col("__v").isNull(), "not valid JSON").otherwise("not an object").alias("reason"))
    return good, bad


def extraction_issues(bad: DataFrame, model_col: str = "model_id") -> DataFrame:
    """(model_id, severity, message): an error for each model with replies in quarantine."""
    by = bad.groupBy(F.col(model_col).alias("model_id")).agg(F.count("*").alias("n"))
    return by.select("model_id", F.lit("error").alias("severity"), F.concat(F.col("n").cast("string"), F.lit(" reply(s) could not be read")).alias("message"))
