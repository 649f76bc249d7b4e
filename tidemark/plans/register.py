"""Infer the register of a catalog and run it: one fused aggregate per table for all checks on single
rows, one grouped aggregate or join for each of the others."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.ids import rule_id
from tidemark.operators import checks as C
from tidemark.operators import rules as R

_RESULT = "element string, dimension string, rule_statement string, rows long, violations long, outcome string"
#: Bounds of a plausible date where the caller gives none.
DATE_BOUNDS = ("1900-01-01", "2100-01-01")


def catalog_columns(catalog: dict[str, DataFrame]) -> DataFrame:
    """(table_id, name): the columns of every table, from their schemas."""
    spark = next(iter(catalog.values())).sparkSession
    return spark.createDataFrame([(t, c) for t, df in catalog.items() for c in df.columns], "table_id string, name string")


def catalog_tables(catalog: dict[str, DataFrame]) -> DataFrame:
    spark = next(iter(catalog.values())).sparkSession
    rows = [(t, t, "Source", [], []) for t in catalog]
    return spark.createDataFrame(rows, "table_id string, name string, role string, produced_by array<string>, consumed_by array<string>")


def run_register(catalog: dict[str, DataFrame], usages: DataFrame, params: dict[str, dict] | None = None, proposals: DataFrame | None = None) -> DataFrame:
    """Rules of ``catalog`` and ``usages``, run: (rule_id, element, dimension, severity, rule_statement,
    rows, violations, pass_rate, outcome). Outcomes are passed, failed and skipped (no such column, or no
    bound to check against). ``params`` gives, per element, ``range``, ``allowed``, ``type``,
    ``references`` (table, column), ``grain`` (list of columns), ``as_of`` and ``max_lag``, ``cross_system``
    (other table, its key, own value, other value, tolerance), or ``relations``: for the statement of a rule in
    ``proposals``, which are merged into the register, (other table, own key, other key, SQL condition)."""
    params = params or {}
    spark = usages.sparkSession
    register = R.register(usages, catalog_tables(catalog), catalog_columns(catalog))
    if proposals is not None:
        register = R.merge_proposals(register, proposals)
    results: list[DataFrame] = []
    # The catalog and its rules are metadata: their number is that of columns, not of rows.
    rules = register.select("element", "dimension", "rule_statement").collect()
    scalar: dict[str, list[C.Check]] = {}
    skipped: list[tuple] = []
    for r in rules:
        table, _, col = r["element"].rpartition(".")
        df = catalog.get(table)
        key = (r["element"], r["dimension"], r["rule_statement"])
        p = params.get(r["element"], {})
        if df is None or col not in df.columns:
            skipped.append((*key, None, None, "skipped"))
            continue
        kind = df.schema[col].dataType
        st = r["rule_statement"]
        one: C.Check | None = None
        many: DataFrame | None = None
        if st == "Non-null":
            one = C.non_null(table, col)
        elif st == "Must be non-null and non-zero":
            one = C.non_zero(table, col)
        elif st == R.DATE_STATEMENT:
            one = C.valid_date(table, col, *p.get("range", DATE_BOUNDS)) if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType, T.StringType)) else None
        elif st == "Value within expected domain/range" and "range" in p:
            one = C.in_range(table, col, *p["range"])
        elif st.startswith("Domain/code-value") and "allowed" in p:
            one = C.allowed(table, col, p["allowed"])
        elif st == "Format/type conformance" and "type" in p:
            one = C.castable(table, col, p["type"])
        elif st == "Non-null; not all-zero/all-null" and isinstance(kind, T.NumericType):
            one = C.output_measure(table, col)
        elif st in p.get("relations", {}):
            other, key_own, key_other, holds = p["relations"][st]
            named = catalog[other].select(*[F.col(c).alias(f"{other}__{c}" if c in df.columns else c) for c in catalog[other].columns])
            joined = df.join(named, F.col(key_own) == F.col(f"{other}__{key_other}" if key_other in df.columns else key_other))
            many = C.run_scalar(joined, [C.expression(r["element"], st, F.expr(holds))])
        elif st == "Cross-system consistency":
            if "cross_system" in p:
                other, key_other, own_value, other_value, tolerance = p["cross_system"]
                both = C.cross_system(df.groupBy(F.col(col).alias("k")).agg(F.sum(own_value).alias("x")), catalog[other].groupBy(F.col(key_other).alias("k")).agg(F.sum(other_value).alias("y")), "k", "x", "y", tolerance)
                many = both.agg(F.count("*").alias("rows"), F.count_if(F.col("outcome") != "match").alias("violations"))
        elif r["dimension"] == "Uniqueness":
            many = C.unique(df, table, [col])
        elif r["dimension"] == "Consistency" and "references" in p:
            parent, parent_col = p["references"]
            many = C.references(df, table, col, catalog[parent], parent_col)
        elif r["dimension"] == "Completeness" and "grain" in p:
            many = C.grain_check(df, table, p["grain"])
        elif r["dimension"] == "Timeliness" and "as_of" in p:
            f = C.freshness(df, col, p["as_of"], p.get("max_lag", 86_400))
            many = f.select(F.lit(1).alias("rows"), F.when(F.col("passed"), 0).otherwise(1).alias("violations"))
        if one is not None:
            scalar.setdefault(table, []).append(C.Check(st, r["element"], r["dimension"], "", one.violations, one.rows))
        elif many is not None:
            results.append(many.select(F.lit(key[0]).alias("element"), F.lit(key[1]).alias("dimension"), F.lit(st).alias("rule_statement"), F.col("rows").cast("long").alias("rows"), F.col("violations").cast("long").alias("violations")))
        else:
            skipped.append((*key, None, None, "skipped"))
    for table, own in scalar.items():
        results.append(C.run_scalar(catalog[table], own).select("element", "dimension", F.col("check").alias("rule_statement"), "rows", "violations"))
    outcome = F.when(F.col("violations") == 0, "passed").otherwise("failed")
    done = [x.withColumn("outcome", outcome) for x in results] + [spark.createDataFrame(skipped, _RESULT)]
    found = reduce(DataFrame.unionByName, done).withColumn("rule_id", rule_id("element", "dimension", "rule_statement"))
    rate = F.when(F.col("rows") > 0, F.round((F.col("rows") - F.col("violations")) / F.col("rows"), 6)).when(F.col("rows") == 0, F.lit(1.0))
    severity = register.select("rule_id", "severity")
    return found.join(severity, "rule_id").select("rule_id", "element", "dimension", "severity", "rule_statement", "rows", "violations", rate.alias("pass_rate"), "outcome")
