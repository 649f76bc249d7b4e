"""Inference of data-quality rules from usages and column names, and the rule register."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import ids
from tidemark.functions.ordered import first_by, ordered_set
from tidemark.functions.scratch import written

DATE_STATEMENT = "Valid date; within plausible range"
# The rule that each usage kind gives: (usage kind, dimension, severity, statement).
USAGE_RULES: list[tuple[str, str, str, str]] = [
    ("denominator", "Validity", "High", "Must be non-null and non-zero"),
    ("join_key", "Uniqueness", "High", "Uniqueness on key; referential integrity to joined table"),
    ("join_key", "Consistency", "High", "Uniqueness on key; referential integrity to joined table"),
    ("date_parse", "Validity", "Medium", DATE_STATEMENT),
    ("range_filter", "Validity", "Medium", "Value within expected domain/range"),
    ("aggregated", "Completeness", "Medium", "Completeness on the aggregation grain (no missing rows)"),
    ("type_cast", "Accuracy", "Medium", "Format/type conformance"),
    ("equality_set", "Validity", "Medium", "Domain/code-value validity (allowed values)"),
    ("output_measure", "Completeness", "Medium", "Non-null; not all-zero/all-null"),
    ("time_window", "Timeliness", "Low", "Timeliness / freshness expectation"),
    ("cross_system_join", "Consistency", "Medium", "Cross-system consistency"),
]
# The rules that a column's name gives: (shape or null, dimension, severity, statement, confidence).
BASELINE_RULES = [
    (None, "Completeness", "Medium", "Non-null", "Medium"),
    (ids.ID_SHAPE, "Uniqueness", "High", "Unique identifier", "High"),
    (ids.DATE_SHAPE, "Validity", "Medium", DATE_STATEMENT, "Medium"),
]


_FIELDS = ("element", "dimension", "rule_statement", "rationale", "code_evidence", "severity", "source", "confidence", "status")


def _keyed(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("rule_id", ids.rule_id("element", "dimension", "rule_statement"))


def _finish(candidates: DataFrame) -> DataFrame:
    """One row per rule id: the first candidate's fields, all models in order (as one array)."""
    by = _keyed(candidates).groupBy("rule_id").agg(first_by(F.struct(*_FIELDS), "ord").alias("f"), ordered_set("model_id", "ord").alias("model_ids"), F.min("ord").alias("ord"))
    return by.select("rule_id", "f.*", "model_ids", "ord")


def rule_models(candidates: DataFrame) -> DataFrame:
    """(rule_id, model_id, ord): a row per rule and model at its first candidate."""
    return _keyed(candidates).filter("model_id IS NOT NULL").groupBy("rule_id", "model_id").agg(F.min("ord").alias("ord"))


def rule_totals(candidates: DataFrame) -> DataFrame:
    """One row per rule id: the first candidate's fields and the number of models, ``n_models``. Candidates are
    reduced to a row per rule and model first, and no array is built."""
    one = _keyed(candidates).groupBy("rule_id", "model_id").agg(first_by(F.struct(*_FIELDS), "ord").alias("f"), F.min("ord").alias("ord"))
    by = one.groupBy("rule_id").agg(first_by("f", "ord").alias("f"), F.count("model_id").alias("n_models"), F.min("ord").alias("ord"))
    return by.select("rule_id", "f.*", "n_models", "ord")


def _count_models(rules: DataFrame, own: DataFrame, by: DataFrame, of: DataFrame, models: DataFrame) -> DataFrame:
    """``rules`` with ``n_models``: the models of ``own`` (a model and the columns beside ``rule_id`` of ``by``, which names the
    rules that they give) and of the tables ``of(rule_id, name)``, once each. The models of a rule's largest table are
    counted by table; only others are compared, so no rule meets the models of its table one by one, and no row
    of ``own`` is made for each of its rules before it is known to be new."""
    named = models.select("name", "model_id").distinct()
    sizes = named.groupBy("name").agg(F.count("*").alias("size"))
    main = of.join(sizes, "name").groupBy("rule_id").agg(F.max_by("name", F.struct("size", "name")).alias("main"), F.max("size").alias("size"), F.count("*").alias("tables"))
    rest = of.join(main.filter("tables > 1"), "rule_id").filter("name <> main").join(named, "name").select("rule_id", "model_id")
    keys = [c for c in by.columns if c != "rule_id"]
    mains = main.select("rule_id", "main")
    # the rules of one key are as many as the mapping has rows
    groups = by.join(mains, "rule_id", "left").groupBy(*[F.col(c).alias(f"__{c}") for c in keys], "main").agg(F.collect_set("rule_id").alias("rules"))
    used = own.join(groups, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys]).select("main", "model_id", "rules")
    more = used.unionByName(rest.join(mains, "rule_id").select("main", "model_id", F.array("rule_id").alias("rules")))
    more = more.join(named.withColumnRenamed("name", "main"), ["main", "model_id"], "left_anti").select(F.explode("rules").alias("rule_id"), "model_id")
    new = more.distinct().groupBy("rule_id").agg(F.count("*").alias("more"))
    zero = F.lit(0)
    out = rules.join(main.select("rule_id", "size"), "rule_id", "left").join(new, "rule_id", "left")
    return out.withColumn("n_models", F.coalesce("size", zero) + F.coalesce("more", zero)).drop("size", "more")


def attributed_totals(candidates: DataFrame, models: DataFrame) -> DataFrame:
    """(rule_id, n_models) with the models of the element's table, ``table_models``, counted once beside the rule's own."""
    rules = _keyed(candidates).groupBy("rule_id").agg(first_by("element", "ord").alias("element"))
    of = rules.select("rule_id", ids.element_table("element").alias("name")).filter("name is not null")
    by = ["element", "dimension", "rule_statement"]
    return _count_models(rules.select("rule_id"), candidates.filter("model_id IS NOT NULL").select(*by, "model_id"), _keyed(candidates.select(*by).distinct()), of, models)


def usage_candidates(usages: DataFrame, mapping: list[tuple[str, str, str, str]] | None = None, *more: str) -> DataFrame:
    """A candidate per usage and mapped rule, with the columns ``more`` of its usage. The mapping is a dozen rows, broadcast."""
    spark = usages.sparkSession
    m = spark.createDataFrame([(i, *r) for i, r in enumerate(mapping or USAGE_RULES)], "__no int, usage_kind string, dimension string, severity string, rule_statement string")
    return usages.join(F.broadcast(m), "usage_kind").select(
        "element", "dimension", "rule_statement", F.concat(F.lit("element used as "), "usage_kind").alias("rationale"), F.col("evidence").alias("code_evidence"), "severity",
        F.lit("H").alias("source"), F.lit("High").alias("confidence"), F.lit("Proposed").alias("status"), "model_id",
        F.struct(F.lit(1).alias("stage"), F.col("ord").cast("long").alias("a"), F.col("__no").cast("long").alias("b")).alias("ord"), *more,
    )


def first_usages(usages: DataFrame) -> DataFrame:
    """The first usage of each element and kind, without its model. Rules take their fields from these alone, so ids and
    candidates are made for them and not for every usage."""
    first = usages.groupBy("element", "usage_kind").agg(F.min(F.struct("ord", "evidence")).alias("x"))
    return first.select("element", "usage_kind", "x.evidence", F.lit(None).cast("string").alias("model_id"), "x.ord")


def baseline_rows(tables: DataFrame, columns: DataFrame, include_roles: tuple[str, ...] = ("Source", "Intermediate", "Output"), models: DataFrame | None = None) -> DataFrame:
    """A candidate, without a model, per column and name shape, before all usage rules; ``table`` is its table. With
    ``models``, the rows of ``table_models``, it stands where its table's first model does."""
    t = tables.filter(F.col("role").isin(*include_roles)).select("table_id", F.col("name").alias("table"))
    if models is not None:
        t = t.join(models.groupBy(F.col("name").alias("table")).agg(F.min(_model_order()).alias("a")), "table", "left")
    return _by_shape(columns.join(t, "table_id"), F.coalesce("a", F.lit(0).cast("long")) if models is not None else F.lit(0).cast("long"), "table")


def _model_order() -> Column:
    """Producers before consumers, by their order."""
    return F.col("ord").cast("long") + F.when(F.col("direction") == "output", 0).otherwise(1 << 61)


def _by_shape(c: DataFrame, a: Column, *more: str) -> DataFrame:
    made = [
        F.when(F.lit(True) if shape is None else F.col("name").rlike(shape), F.struct(F.lit(dim).alias("dimension"), F.lit(st).alias("rule_statement"), F.lit(sev).alias("severity"), F.lit(conf).alias("confidence"), F.lit(i).cast("long").alias("b")))
        for i, (shape, dim, sev, st, conf) in enumerate(BASELINE_RULES)
    ]
    rows = c.withColumn("element", F.concat("table", F.lit("."), "name")).withColumn("__a", a).withColumn("r", F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())))
    model = F.col("model_id") if "model_id" in c.columns else F.lit(None).cast("string").alias("model_id")
    return rows.select(
        "element", "r.dimension", "r.rule_statement", F.lit("baseline data-element expectation").alias("rationale"), F.lit("").alias("code_evidence"), "r.severity", F.lit("H").alias("source"), "r.confidence", F.lit("Proposed").alias("status"), model,
        F.struct(F.lit(0).alias("stage"), F.col("__a").alias("a"), F.col("r.b").alias("b")).alias("ord"), *more,
    )


def baseline_candidates(tables: DataFrame, columns: DataFrame, include_roles: tuple[str, ...] = ("Source", "Intermediate", "Output")) -> DataFrame:
    """Candidates per column and name shape, one per touching model (producers before consumers); they come before
    all usage rules. Their number is columns by models: for counts take ``baseline_rows``."""
    t = tables.filter(F.col("role").isin(*include_roles)).select("table_id", F.col("name").alias("table"), F.posexplode_outer(F.array_distinct(F.concat("produced_by", "consumed_by"))).alias("at", "model_id"))
    return _by_shape(columns.join(t, "table_id"), F.coalesce(F.col("at").cast("long"), F.lit(0).cast("long")))


def baseline_totals(tables: DataFrame, columns: DataFrame, models: DataFrame, include_roles: tuple[str, ...] = ("Source", "Intermediate", "Output")) -> DataFrame:
    """The register from column names alone, with ``n_models`` counted by table."""
    rows = _keyed(baseline_rows(tables, columns, include_roles, models))
    rules = rows.groupBy("rule_id").agg(first_by(F.struct(*_FIELDS), "ord").alias("f"), F.min("ord").alias("ord")).select("rule_id", "f.*", "ord")
    none = rows.select("rule_id", "element", "model_id").limit(0)
    return _count_models(rules, none.select("element", "model_id"), none.select("rule_id", "element"), rows.select("rule_id", F.col("table").alias("name")).distinct(), models)


def infer_rules(usages: DataFrame) -> DataFrame:
    """The register from usages alone. ``usages(element, usage_kind, evidence, model_id, ord)``."""
    return _finish(usage_candidates(usages))


def baseline_rules(tables: DataFrame, columns: DataFrame, include_roles: tuple[str, ...] = ("Source", "Intermediate", "Output")) -> DataFrame:
    """The register from column names alone."""
    return _finish(baseline_candidates(tables, columns, include_roles))


def attribute_models(rules: DataFrame, tables: DataFrame) -> DataFrame:
    """``rules`` with the models of the element's table behind their own."""
    t = tables.select(F.col("name").alias("__table"), F.array_distinct(F.concat("produced_by", "consumed_by")).alias("__models"))
    own = rules.withColumn("__table", ids.element_table("element")).join(t, "__table", "left")
    return own.withColumn("model_ids", F.array_distinct(F.concat("model_ids", F.coalesce("__models", F.array().cast("array<string>"))))).drop("__table", "__models")


def _register_rows(usages: DataFrame, tables: DataFrame, columns: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """Candidates of a register with ``rule_id``: a row per column and name shape, with its ``table``, and per first usage, with
    its ``usage_kind``."""
    none = lambda c: F.lit(None).cast("string").alias(c)
    base = baseline_rows(tables, columns, models=models).select("*", none("usage_kind"))
    return _keyed(base.unionByName(usage_candidates(first_usages(usages), None, "usage_kind").select("*", none("table"))))


def _first_fields(rows: DataFrame) -> DataFrame:
    return rows.groupBy("rule_id").agg(first_by(F.struct(*_FIELDS), "ord").alias("f"), F.min("ord").alias("ord")).select("rule_id", "f.*", "ord")


def register(usages: DataFrame, tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Baseline and usage rules in one register, once per id, with all models that touch the table. The models are
    joined last: where ``model_ids`` is not read, they are not gathered."""
    rows = _register_rows(usages, tables, columns)
    rules = _first_fields(rows)
    place = lambda stage, a, b: F.struct(F.lit(stage).alias("stage"), a.cast("long").alias("a"), b.alias("b")).alias("o")
    t = tables.select(F.col("name").alias("table"), F.posexplode(F.array_distinct(F.concat("produced_by", "consumed_by"))).alias("at", "model_id"))
    used = _keyed(usage_candidates(usages).filter("model_id IS NOT NULL")).select("rule_id", "model_id", F.col("ord").alias("o"))
    base = rows.filter("table IS NOT NULL").join(t, "table").select("rule_id", t["model_id"], place(0, F.col("at"), F.col("ord.b")))
    rest = rules.select("rule_id", ids.element_table("element").alias("table")).join(t, "table").select("rule_id", "model_id", place(2, F.col("at"), F.lit(0).cast("long")))
    models = base.unionByName(used).unionByName(rest).groupBy("rule_id").agg(ordered_set("model_id", "o").alias("model_ids"))
    return rules.join(models, "rule_id", "left").select("rule_id", *_FIELDS, F.coalesce("model_ids", F.array().cast("array<string>")).alias("model_ids"), "ord")


def register_totals(usages: DataFrame, tables: DataFrame, columns: DataFrame, models: DataFrame) -> DataFrame:
    """``register`` with ``n_models`` instead of the models, from ``table_totals`` and ``table_models``. A column has a
    candidate for each name shape, not for each model of its table. The candidates, few, are written once."""
    rows = written(_register_rows(usages, tables, columns, models), "rule-rows")
    rules = _first_fields(rows)
    of = rows.select("rule_id", F.col("table").alias("name")).unionByName(rules.select("rule_id", ids.element_table("element").alias("name"))).filter("name is not null").distinct()
    by = rows.filter("usage_kind IS NOT NULL").select("rule_id", "element", "usage_kind")
    return _count_models(rules, usages.filter("model_id is not null").select("element", "usage_kind", "model_id"), by, of, models)


def merge_proposals(rules: DataFrame, proposals: DataFrame) -> DataFrame:
    """``rules`` with ``related_elements`` and the proposals merged in by element and dimension.

    A proposal for a key that exists adds its related elements to the key's last rule; a new key's first
    proposal becomes a rule of source I and medium confidence, later ones add to it.
    ``proposals(element, dimension, rule_statement, severity, rationale, related_elements, ord)``."""
    own = rules if "related_elements" in rules.columns else rules.withColumn("related_elements", F.array().cast("array<string>"))
    related = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", "related_elements"))), lambda p: p["related_elements"])))
    p = proposals.groupBy("element", "dimension").agg(related.alias("__related"), first_by(F.struct("rule_statement", "severity", "rationale"), "ord").alias("f"))
    last = own.groupBy("element", "dimension").agg(F.max_by("rule_id", "ord").alias("__last"))
    hit = p.join(last, ["element", "dimension"]).select(F.col("__last").alias("rule_id"), "__related")
    old = own.join(hit, "rule_id", "left").withColumn("related_elements", F.array_distinct(F.concat("related_elements", F.coalesce("__related", F.array().cast("array<string>"))))).drop("__related")
    new = p.join(last, ["element", "dimension"], "left_anti").select(
        ids.rule_id("element", "dimension", "f.rule_statement").alias("rule_id"), "element", "dimension", "f.rule_statement", "f.rationale", F.lit("").alias("code_evidence"), "f.severity",
        F.lit("I").alias("source"), F.lit("Medium").alias("confidence"), F.lit("Proposed").alias("status"), F.array().cast("array<string>").alias("model_ids"), F.col("__related").alias("related_elements"),
    )
    return old.drop("ord").unionByName(new)


def set_status(rules: DataFrame, decisions: DataFrame) -> DataFrame:
    """``rules`` with the accepted or rejected status of ``decisions(rule_id, status)``."""
    d = decisions.select("rule_id", F.col("status").alias("__status"))
    return rules.join(d, "rule_id", "left").withColumn("status", F.coalesce("__status", "status")).drop("__status")


def filter_register(rules: DataFrame, model_id: str | None = None, dimension: str | None = None, high_only: bool = False, shared_only: bool = False) -> DataFrame:
    """Rules that pass all set filters; a rule without models passes the model filter."""
    out = rules
    if model_id is not None:
        out = out.filter((F.size("model_ids") == 0) | F.array_contains("model_ids", model_id))
    if dimension is not None:
        out = out.filter(F.col("dimension") == dimension)
    if high_only:
        out = out.filter("severity = 'High'")
    return out.filter(F.size("model_ids") >= 2) if shared_only else out


def register_counters(rules: DataFrame) -> DataFrame:
    """(candidate, high, pending, accepted) of a filtered register."""
    by = lambda c, v: F.count_if(F.col(c) == v)
    return rules.agg(F.count("*").alias("candidate"), by("severity", "High").alias("high"), by("status", "Proposed").alias("pending"), by("status", "Accepted").alias("accepted"))
