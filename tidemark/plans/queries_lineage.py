"""Registered queries of lineage, rules, graph, run history and reports, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import ids
from tidemark.functions.scratch import shared_dir, written
from tidemark.operators import delta as D
from tidemark.operators import graph as G
from tidemark.operators import lineage as L
from tidemark.operators import reports as P
from tidemark.operators import rules as R
from tidemark.operators import runs as H
from tidemark.operators import store as ST

from . import state as S
from .state import CTE, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            word = "WITH RECURSIVE" if sql.startswith("WITH RECURSIVE") else "WITH"
            ORACLES[f.__name__] = sql.replace(word, f"{word} {CTE},", 1) if sql.startswith(word) else f"WITH {CTE} {sql}"
        return f

    return add


def _plain(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


# ------------------------------------------------------------------------------------- assembly
@_plain("""
SELECT conv_id AS model_id, arg_min(text, turn) AS purpose, CAST(count(DISTINCT role) AS BIGINT) AS n_assumptions, count(*) AS n_steps,
  CAST(count(DISTINCT role) AS BIGINT) AS n_tables, count(DISTINCT role) AS n_calcs, count(DISTINCT role) AS n_lineage
FROM conversations WHERE text <> '' GROUP BY conv_id
""")
def d1_merge_extractions(spark, d):
    """Each turn of a conversation is a chunk of a model's extraction."""
    t = table(spark, d, "conversations").filter("text <> ''")
    one = F.array("role")
    tables = F.array(F.struct(F.col("role").alias("name"), F.array(F.lit("a"), F.lit("b")).alias("columns")))
    none = F.array().cast("array<struct<name:string,columns:array<string>>>")
    parts = t.select(
        F.col("conv_id").alias("model_id"), F.col("turn").alias("chunk_no"), F.col("text").alias("purpose"), F.lit("").alias("executive_summary"), one.alias("assumptions"), one.alias("limitations"), one.alias("methodology_steps"),
        tables.alias("input_tables"), none.alias("output_tables"), F.array(F.struct(F.col("role").alias("target"), F.lit("x").alias("expression"))).alias("calculations"),
        F.array(F.struct(F.concat("role", F.lit(".a")).alias("source_element"), F.lit("t.b").alias("target_element"), F.lit("derive").alias("transformation_type"))).alias("lineage_rows"),
    )
    m = L.merge_extractions(parts)
    n = lambda k, c: m[k].groupBy("model_id").agg(F.count("*").alias(c))
    s = m["scalars"].select("model_id", "purpose", F.size("assumptions").cast("long").alias("n_assumptions"), F.size("methodology_steps").cast("long").alias("n_steps"))
    return s.join(n("tables", "n_tables"), "model_id").join(n("calculations", "n_calcs"), "model_id").join(n("lineage", "n_lineage"), "model_id")


@query("SELECT model_id, direction, canon, source FROM refs")
def d2_reference_set(spark, d):
    return S.refs(spark, d).select("model_id", "direction", "canon", "source")


@query("SELECT name AS canon, role FROM tabs")
def d3_roles(spark, d):
    return L.roles(S.refs(spark, d))


@query("SELECT * FROM tabs")
def d4_assemble_tables(spark, d):
    return L.table_totals(S.refs(spark, d))


@query("SELECT table_id, name, 'E' AS source FROM cols")
def d5_assemble_columns(spark, d):
    return L.assemble_columns(S.refs(spark, d))


@query("SELECT * FROM cedges")
def d6_column_edges(spark, d):
    return L.column_edges(S.lineage_rows(spark, d), S.calculations(spark, d)).select("edge_id", "source_element", "target_element", "model_id", "transformation_type", "expression")


@query("SELECT DISTINCT model_id, in_name AS source_table, out_name AS target_table FROM lin")
def d7_lineage_pairs(spark, d):
    return L.lineage_pairs(S.lineage_rows(spark, d))


@query("SELECT model_id, a AS source_table, b AS target_table FROM pairs WHERE source = 'H'")
def d8_fallback_pairs(spark, d):
    return L.fallback_pairs(S.refs(spark, d), L.lineage_pairs(S.lineage_rows(spark, d)))


@query("SELECT edge_id, source_table_id, target_table_id, model_id, 'derive' AS transformation_type, source FROM edges")
def d9_table_edges(spark, d):
    return L.table_edges(S.refs(spark, d), S.lineage_rows(spark, d))


@query("SELECT table_id, CASE WHEN name LIKE 'log_%' THEN 'Reference' ELSE role END AS role FROM tabs")
def d10_role_overrides(spark, d):
    refs = S.refs(spark, d)
    o = refs.filter("canon like 'log_%'").select(ids.table_id("canon").alias("table_id"), F.lit("Reference").alias("role")).distinct()
    return L.assemble_tables(refs, o).select("table_id", "role")


@query("SELECT source_system AS name, string_agg(table_id, ',' ORDER BY table_id) AS ids FROM tabs WHERE source_system IS NOT NULL GROUP BY source_system")
def d11_source_systems(spark, d):
    return L.source_systems(L.assemble_tables(S.refs(spark, d))).select("name", F.array_join("tables", ",").alias("ids"))


_STATUS = "CASE WHEN name = 'order_id' THEN 'Dissented' WHEN name = 'as_of_date' THEN 'Controlled' WHEN tname || '.' || name IN (SELECT source_element FROM cedges UNION SELECT target_element FROM cedges) THEN 'Sourced' WHEN tname LIKE 'sum.%' THEN 'Not Sourced' ELSE 'Not Controlled' END"


@query(f"SELECT table_id, name, {_STATUS} AS control_status FROM cols")
def d12_control_status(spark, d):
    """Join-key rules are rejected and date rules accepted before the status is derived."""
    of = S.base(spark, d)
    refs = S.refs(spark, d, of)
    t, c = L.assemble_tables(refs), L.assemble_columns(refs)
    rules = written(R.register(S.usages(spark, d, of), t, c).drop("model_ids"), "rules")
    decided = rules.filter("dimension in ('Uniqueness', 'Validity') and severity <> 'High' or rule_statement like 'Uniqueness on key%'").select("rule_id", F.when(F.col("rule_statement").startswith("Uniqueness"), "Rejected").otherwise("Accepted").alias("status"))
    return L.control_status(c, t, R.set_status(rules, decided), L.column_edges(S.lineage_rows(spark, d, of), S.calculations(spark, d, of))).select("table_id", "name", "control_status")


@_plain("SELECT o_orderpriority AS run_id, count(*) AS models, sum(o_orderkey + o_custkey)::BIGINT AS tokens, count(*) * 0.25 AS est_cost FROM orders GROUP BY o_orderpriority")
def d13_telemetry(spark, d):
    m = table(spark, d, "orders").select(F.col("o_orderpriority").alias("run_id"), F.col("o_orderkey").alias("tokens_in"), F.col("o_custkey").alias("tokens_out"), F.lit(0.25).alias("est_cost"))
    return L.telemetry(m)


@query("""
SELECT 'tables' AS kind, count(*) AS n FROM tabs UNION ALL SELECT 'columns', count(*) FROM cols UNION ALL SELECT 'table_edges', count(*) FROM edges
UNION ALL SELECT 'column_edges', count(*) FROM cedges UNION ALL SELECT 'usages', count(*) FROM uses UNION ALL SELECT 'models', (SELECT count(*) FROM customer) + (SELECT count(*) FROM nation)
""")
def d14_assemble_state(spark, d):
    s = S.state(spark, d)
    parts = [s[k].agg(F.lit(k).alias("kind"), F.count("*").alias("n")) for k in ("tables", "columns", "table_edges", "column_edges", "usages", "models")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _after_edits(spark, d, rules: bool) -> str:
    """The folder of a state after a change, from an older state: a quarter of the customers was not there, and every tenth
    read, wrote and used a table that it no longer does."""
    path = f"{shared_dir(spark)}/delta-{uuid.uuid4().hex}"
    of = S.base(spark, d)
    refs = S.refs(spark, d, of)
    late = of[0].filter("c_custkey % 4 = 1").select("model_id")
    other = of[0].filter("c_custkey % 10 = 0").select("model_id")
    edges = written(L.table_edges(refs, S.lineage_rows(spark, d, of)), "edges")
    once = refs.join(other, "model_id", "left_semi").groupBy("model_id").agg(F.min("ord").alias("ord")).withColumn("direction", F.explode(F.array(F.lit("input"), F.lit("output"))))
    more = once.select("model_id", "direction", F.lit("old.table").alias("name"), F.array(F.lit("x")).alias("columns"), (F.col("ord") - 5).alias("ord"), F.lit("old.table").alias("canon"), F.lit("E").alias("source"))
    before = after = None
    if rules:
        after = written(S.usages(spark, d, of), "usages")
        used = once.filter("direction = 'input'").select(F.lit("old.table.x").alias("element"), F.lit("denominator").alias("usage_kind"), F.lit("/ x").alias("evidence"), "model_id", (F.col("ord") - 5).alias("ord"))
        before = after.join(late, "model_id", "left_anti").unionByName(used)
    D.start(refs.join(late, "model_id", "left_anti").unionByName(more), edges.join(late, "model_id", "left_anti"), path, ranges=16, usages=before)
    D.change(late.unionByName(other), refs, edges, path, after)
    return path


@query("SELECT table_id, name, role, source_system, source, n_produced, n_consumed FROM tabs")
def d14_delta_tables(spark, d):
    """The tables after a change."""
    return D.tables(spark, _after_edits(spark, d, rules=False))


# ---------------------------------------------------------------------------------------- rules
_RID = "'dq_' || substr(sha1(lower(element) || '␟' || lower(dimension) || '␟' || lower(rule_statement)), 1, 12)"
_U = "u AS (SELECT element, ord, model_id, evidence, usage_kind, unnest(CASE usage_kind WHEN 'join_key' THEN ['Uniqueness', 'Consistency'] ELSE ['Validity'] END) AS dimension, CASE usage_kind WHEN 'join_key' THEN 'Uniqueness on key; referential integrity to joined table' WHEN 'date_parse' THEN 'Valid date; within plausible range' ELSE 'Must be non-null and non-zero' END AS rule_statement, CASE usage_kind WHEN 'date_parse' THEN 'Medium' ELSE 'High' END AS severity FROM uses)"


@query(f"WITH {_U} SELECT {_RID} AS rule_id, element, dimension, rule_statement, severity, arg_min(evidence, ord) AS code_evidence, count(DISTINCT model_id) AS n_models FROM u GROUP BY element, dimension, rule_statement, severity")
def e1_infer_rules(spark, d):
    return R.rule_totals(R.usage_candidates(S.usages(spark, d))).select("rule_id", "element", "dimension", "rule_statement", "severity", "code_evidence", "n_models")


_B = "b AS (SELECT tname || '.' || name AS element, tname, unnest(list_concat(['Completeness'], CASE WHEN name IN ('order_id', 'region_key') THEN ['Uniqueness'] WHEN name = 'as_of_date' THEN ['Validity'] ELSE [] END)) AS dimension FROM cols), bb AS (SELECT *, CASE dimension WHEN 'Completeness' THEN 'Non-null' WHEN 'Uniqueness' THEN 'Unique identifier' ELSE 'Valid date; within plausible range' END AS rule_statement FROM b)"


@query(f"WITH {_B} SELECT {_RID} AS rule_id, element, dimension, rule_statement, t.n_all AS n_models FROM bb JOIN (SELECT canon, count(DISTINCT model_id) AS n_all FROM refs GROUP BY canon) t ON t.canon = tname")
def e2_baseline_rules(spark, d):
    refs = S.refs(spark, d)
    return R.baseline_totals(L.table_totals(refs), L.assemble_columns(refs), L.table_models(refs)).select("rule_id", "element", "dimension", "rule_statement", "n_models")


@query(f"WITH {_U}, {_B}, a AS (SELECT element, dimension, rule_statement, 0 AS stage, '' AS code_evidence, 0 AS ord FROM bb UNION ALL SELECT element, dimension, rule_statement, 1, evidence, ord FROM u) SELECT {_RID} AS rule_id, element, dimension, rule_statement, arg_min(code_evidence, stage * 1000000000 + ord) AS code_evidence FROM a GROUP BY element, dimension, rule_statement")
def e3_register(spark, d):
    refs = S.refs(spark, d)
    return R.register_totals(S.usages(spark, d), L.table_totals(refs), L.assemble_columns(refs), L.table_models(refs)).select("rule_id", "element", "dimension", "rule_statement", "code_evidence")


@query(f"""WITH {_U}, {_B}, a AS (SELECT element, dimension, rule_statement, CASE dimension WHEN 'Uniqueness' THEN 'High' ELSE 'Medium' END AS severity, 0 AS stage, '' AS code_evidence, 0 AS ord FROM bb UNION ALL SELECT element, dimension, rule_statement, severity, 1, evidence, ord FROM u),
n AS (SELECT DISTINCT canon, model_id FROM refs), k AS (SELECT DISTINCT element, dimension, rule_statement FROM a),
m AS (SELECT element, dimension, rule_statement, model_id FROM u UNION SELECT element, dimension, rule_statement, n.model_id FROM k JOIN n ON canon = substr(element, 1, length(element) - length(split_part(element, '.', -1)) - 1)),
c AS (SELECT element, dimension, rule_statement, count(*) AS n_models FROM m GROUP BY ALL)
SELECT {_RID} AS rule_id, element, dimension, rule_statement, arg_min(severity, stage * 1000000000 + ord) AS severity, arg_min(code_evidence, stage * 1000000000 + ord) AS code_evidence, any_value(n_models) AS n_models FROM a JOIN c USING (element, dimension, rule_statement) GROUP BY element, dimension, rule_statement""")
def d14_delta_rules(spark, d):
    """The rules after the same change, with the numbers of their models."""
    return D.rules(spark, _after_edits(spark, d, rules=True)).select("rule_id", "element", "dimension", "rule_statement", "severity", "code_evidence", "n_models")


@query(f"WITH {_U}, n AS (SELECT canon, list(DISTINCT model_id) AS all_models FROM refs GROUP BY canon), r AS (SELECT element, dimension, rule_statement, list(DISTINCT model_id) AS own FROM u GROUP BY element, dimension, rule_statement) SELECT {_RID} AS rule_id, CAST(len(list_distinct(list_concat(own, all_models))) AS BIGINT) AS n_models FROM r JOIN n ON canon = substr(element, 1, length(element) - length(split_part(element, '.', -1)) - 1)")
def e4_attribute_models(spark, d):
    return R.attributed_totals(R.usage_candidates(S.usages(spark, d)), L.table_models(S.refs(spark, d)))


@query(f"WITH {_U}, r AS (SELECT element, dimension, count(DISTINCT rule_statement) AS n FROM u GROUP BY element, dimension), p AS (SELECT DISTINCT element, unnest(['Validity', 'Accuracy']) AS dimension FROM uses) SELECT coalesce(r.element, p.element) AS element, coalesce(r.dimension, p.dimension) AS dimension, r.element IS NULL AS is_new, CASE WHEN p.element IS NULL THEN 0 ELSE 1 END AS n_related FROM r FULL JOIN p ON r.element = p.element AND r.dimension = p.dimension")
def e5_merge_proposals_all(spark, d):
    """Two proposals for every element that is used in any way."""
    e = S.usages(spark, d).select("element", F.explode(F.array(F.lit("Validity"), F.lit("Accuracy"))).alias("dimension"), "ord")
    p = e.select("element", "dimension", F.lit("Totals add up").alias("rule_statement"), F.lit("High").alias("severity"), F.lit("").alias("rationale"), F.array(F.lit("other.total")).alias("related_elements"), "ord")
    return R.merge_proposals(R.infer_rules(S.usages(spark, d)), p).select("element", "dimension", (F.col("source") == "I").alias("is_new"), F.size("related_elements").alias("n_related"))


@query(f"WITH {_U}, r AS (SELECT DISTINCT element, dimension FROM u), p AS (SELECT DISTINCT out_name || '.total' AS element, unnest(['Validity', 'Accuracy']) AS dimension FROM cm) SELECT coalesce(r.element, p.element) AS element, coalesce(r.dimension, p.dimension) AS dimension, r.element IS NULL AS is_new, CASE WHEN p.element IS NULL THEN 0 ELSE 1 END AS n_related FROM r FULL JOIN p ON r.element = p.element AND r.dimension = p.dimension")
def e5_merge_proposals(spark, d):
    e = S.usages(spark, d).filter("usage_kind = 'denominator'").select("element", F.explode(F.array(F.lit("Validity"), F.lit("Accuracy"))).alias("dimension"), "ord")
    p = e.select("element", "dimension", F.lit("Totals add up").alias("rule_statement"), F.lit("High").alias("severity"), F.lit("").alias("rationale"), F.array(F.lit("other.total")).alias("related_elements"), "ord")
    return R.merge_proposals(R.infer_rules(S.usages(spark, d)), p).select("element", "dimension", (F.col("source") == "I").alias("is_new"), F.size("related_elements").alias("n_related"))


@query(f"WITH {_U}, r AS (SELECT DISTINCT element, dimension, rule_statement, severity FROM u) SELECT {_RID} AS rule_id, CASE WHEN severity = 'High' THEN 'Accepted' ELSE 'Proposed' END AS status FROM r")
def e6_set_status(spark, d):
    r = R.infer_rules(S.usages(spark, d))
    return R.set_status(r, r.filter("severity = 'High'").select("rule_id", F.lit("Accepted").alias("status"))).select("rule_id", "status")


# ---------------------------------------------------------------------------------------- graph
@query("SELECT role, coalesce(source_system, '(unsystemed)') AS source_system, count(*) AS n_tables, string_agg(name, ',' ORDER BY name) AS names FROM tabs GROUP BY ALL")
def g1_tables_by_role(spark, d):
    return G.tables_by_role(L.assemble_tables(S.refs(spark, d))).withColumn("names", F.array_join("names", ","))


@query("WITH RECURSIVE h AS (SELECT DISTINCT source_table_id AS s, target_table_id AS t FROM edges), w AS (SELECT [table_id] AS path, table_id AS last FROM tabs WHERE role = 'Source' UNION ALL SELECT list_append(path, t), t FROM w JOIN h ON last = s WHERE NOT list_contains(path, t)) SELECT array_to_string(path, '>') AS path, CAST(len(path) AS INTEGER) AS n FROM w JOIN tabs ON table_id = last WHERE role = 'Output' AND len(path) > 1")
def g2_source_to_output_paths(spark, d):
    refs = S.refs(spark, d)
    paths, cut = G.source_to_output_paths(L.assemble_tables(refs), L.table_edges(refs, S.lineage_rows(spark, d)))
    if cut:
        raise RuntimeError("paths were cut")
    return paths.select(F.array_join("path", ">").alias("path"), F.size("path").alias("n"))


_WAYS = "WITH RECURSIVE h AS (SELECT DISTINCT source_table_id AS s, target_table_id AS t FROM edges), w AS (SELECT [table_id] AS path, table_id AS last FROM tabs WHERE role = 'Source' UNION ALL SELECT list_append(path, t), t FROM w JOIN h ON last = s WHERE NOT list_contains(path, t)), ways AS (SELECT path[1] AS source, last AS output, path FROM w JOIN tabs ON table_id = last WHERE role = 'Output' AND len(path) > 1)"


@query(_WAYS + " SELECT source, output, CAST(count(*) AS BIGINT) AS n_paths FROM ways GROUP BY ALL")
def g2_path_counts(spark, d):
    """Ways from sources to outputs, counted level by level."""
    of = S.base(spark, d)
    refs = S.refs(spark, d, of)
    found, _ = G.path_counts(L.assemble_tables(refs), L.table_hops(refs, S.lineage_rows(spark, d, of)))
    return found.withColumn("n_paths", F.col("n_paths").cast("long"))


@query(_WAYS + " SELECT source, output, array_to_string(path, '>') AS path FROM ways QUALIFY row_number() OVER (PARTITION BY source, output ORDER BY len(path), path) <= 3")
def g2_shortest_paths(spark, d):
    """The three shortest ways from each source to each output."""
    of = S.base(spark, d)
    refs = S.refs(spark, d, of)
    found, _ = G.shortest_paths(L.assemble_tables(refs), L.table_hops(refs, S.lineage_rows(spark, d, of)), 3)
    return found.select("source", "output", F.array_join("path", ">").alias("path"))


@query("WITH RECURSIVE h AS (SELECT DISTINCT source_table_id AS s, target_table_id AS t FROM edges), w AS (SELECT table_id AS seed, table_id AS node, 0 AS depth FROM tabs WHERE role = 'Source' UNION SELECT seed, t, depth + 1 FROM w JOIN h ON node = s WHERE depth < 10) SELECT seed, node, min(depth) AS depth FROM w GROUP BY seed, node")
def g3_reachable(spark, d):
    refs = S.refs(spark, d)
    seeds = L.assemble_tables(refs).filter("role = 'Source'").select(F.col("table_id").alias("seed"))
    return G.reachable(L.table_edges(refs, S.lineage_rows(spark, d)), seeds)


@_plain("""
WITH RECURSIVE e AS (SELECT DISTINCT a.event_type || (a.user_id % 7) AS s, b.event_type || (b.user_id % 7) AS t FROM events a JOIN events b ON a.event_id + 1 = b.event_id WHERE a.event_id % 5 = 0),
w AS (SELECT 'click0' AS seed, 'click0' AS node, 0 AS depth UNION SELECT seed, s, depth + 1 FROM w JOIN e ON node = t WHERE depth < 40 AND s <> t)
SELECT seed, node, min(depth) AS depth FROM w GROUP BY seed, node
""")
def g3_upstream_cyclic(spark, d):
    """Upstream of one state in the (cyclic) graph of event transitions."""
    e = table(spark, d, "events").select("event_id", F.concat("event_type", (F.col("user_id") % 7).cast("string")).alias("n"))
    hop = e.filter("event_id % 5 = 0").select((F.col("event_id") + 1).alias("event_id"), F.col("n").alias("source_table_id")).join(e.withColumnRenamed("n", "target_table_id"), "event_id")
    return G.reachable(hop, spark.createDataFrame([("click0",)], "seed string"), upstream=True)


@_plain("""
WITH RECURSIVE e AS (SELECT DISTINCT a.event_type || (a.user_id % 7) AS s, b.event_type || (b.user_id % 7) AS t FROM events a JOIN events b ON a.event_id + 1 = b.event_id),
w AS (SELECT 'click0' AS seed, 'click0' AS node, 0 AS depth UNION SELECT seed, s, depth + 1 FROM w JOIN e ON node = t WHERE depth < 40 AND s <> t)
SELECT seed, node, min(depth) AS depth FROM w GROUP BY seed, node
""")
def g3_upstream_cyclic_all(spark, d):
    """Upstream of one state in the graph of all event transitions."""
    e = table(spark, d, "events").select("event_id", F.concat("event_type", (F.col("user_id") % 7).cast("string")).alias("n"))
    hop = e.select((F.col("event_id") + 1).alias("event_id"), F.col("n").alias("source_table_id")).join(e.withColumnRenamed("n", "target_table_id"), "event_id")
    return G.reachable(hop, spark.createDataFrame([("click0",)], "seed string"), upstream=True)


@query("SELECT t.table_id, t.name, role AS lane, CASE role WHEN 'Source' THEN 0 WHEN 'Output' THEN 2 ELSE 1 END AS lane_index, source_system, coalesce(n, 0) AS column_count FROM tabs t LEFT JOIN (SELECT table_id, count(*) AS n FROM cols GROUP BY 1) c ON t.table_id = c.table_id")
def g4_table_graph(spark, d):
    s = S.state(spark, d)
    return G.table_graph(s["tables"], s["columns"], s["table_edges"], s["column_edges"])["nodes"]


_ONE = "(SELECT min(table_id) FROM tabs WHERE role = 'Intermediate')"


@query(f"SELECT edge_id, source_element, target_element, s.table_id AS source_table_id, t.table_id AS target_table_id FROM cedges JOIN tabs s ON s.name || '.o_totalprice' = source_element JOIN tabs t ON t.name || '.total' = target_element WHERE s.table_id = {_ONE} OR t.table_id = {_ONE}")
def g5_column_subgraph(spark, d):
    s = S.state(spark, d)
    one = s["tables"].filter("role = 'Intermediate'").agg(F.min("table_id")).first()[0]
    return G.column_subgraph(one, s["tables"], s["columns"], s["column_edges"])["edges"].select("edge_id", "source_element", "target_element", "source_table_id", "target_table_id")


@query("SELECT (SELECT count(*) FROM edges) + (SELECT count(*) FROM cedges) AS pending_review")
def g6_pending_review(spark, d):
    s = S.state(spark, d)
    return G.pending_review(s["table_edges"], s["column_edges"])


@query("WITH v AS (SELECT table_id FROM tabs WHERE contains(name, 'nation_1') OR contains(name, 'urgent')) SELECT edge_id FROM edges WHERE source_table_id IN (SELECT * FROM v) AND target_table_id IN (SELECT * FROM v)")
def g7_filter_graph(spark, d):
    s = S.state(spark, d)
    a, _ = G.filter_graph(s["tables"], s["table_edges"], search=" NATION_1")
    b, _ = G.filter_graph(s["tables"], s["table_edges"], search="urgent")
    _, e = G.filter_graph(a.unionByName(b), s["table_edges"])
    return e.select("edge_id")


@query("SELECT DISTINCT model_id, direction, 't_' || substr(sha1(canon), 1, 12) AS table_id, canon AS name FROM refs")
def g8_model_io(spark, d):
    return G.model_io(L.table_models(S.refs(spark, d)))


@query("SELECT model_id, count(DISTINCT CASE WHEN direction = 'input' THEN canon END) AS fan_in, count(DISTINCT CASE WHEN direction = 'output' THEN canon END) AS fan_out FROM refs GROUP BY model_id")
def g9_model_fan(spark, d):
    return G.model_fan(L.table_models(S.refs(spark, d)))


@query("SELECT table_id, count(*) AS degree FROM (SELECT source_table_id AS table_id FROM edges UNION ALL SELECT target_table_id FROM edges) GROUP BY 1 ORDER BY degree DESC, table_id LIMIT 10")
def g9_hubs(spark, d):
    return G.hubs(L.table_edges(S.refs(spark, d), S.lineage_rows(spark, d)), 10)


@query(f"WITH {_U}, r AS (SELECT element, dimension, rule_statement, severity, count(DISTINCT model_id) AS n FROM u GROUP BY ALL) SELECT {_RID} AS rule_id FROM r WHERE dimension = 'Validity' AND severity = 'High' AND n >= 2")
def g10_filter_register(spark, d):
    return R.filter_register(R.infer_rules(S.usages(spark, d)), dimension="Validity", high_only=True, shared_only=True).select("rule_id")


@query(f"WITH {_U}, r AS (SELECT DISTINCT element, dimension, rule_statement, severity FROM u) SELECT count(*) AS candidate, count(*) FILTER (severity = 'High') AS high, count(*) AS pending, 0 AS accepted FROM r")
def g10_register_counters(spark, d):
    return R.register_counters(R.infer_rules(S.usages(spark, d)))


# -------------------------------------------------------------------------------- run history
def _versions(spark, d) -> tuple[DataFrame, DataFrame]:
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("model_id"), "o_orderstatus", "o_custkey")
    k = F.col("model_id").cast("long")
    a = o.filter(k % 11 != 0)
    b = o.filter(k % 13 != 0).withColumn("o_orderstatus", F.when(k % 7 == 0, "X").otherwise(F.col("o_orderstatus")))
    return a, b


@_plain("""
SELECT 'models' AS kind, CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 11 = 0 THEN 'added' WHEN o_orderkey % 13 = 0 THEN 'removed' ELSE 'changed' END AS change
FROM orders WHERE NOT (o_orderkey % 11 = 0 AND o_orderkey % 13 = 0) AND (o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 OR o_orderkey % 7 = 0)
""")
def h6_diff(spark, d):
    a, b = _versions(spark, d)
    return H.diff_runs({"models": a}, {"models": b})


@_plain("""
SELECT 'models' AS kind, CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 11 = 0 THEN 'added' WHEN o_orderkey % 13 = 0 THEN 'removed' ELSE 'changed' END AS change
FROM orders WHERE NOT (o_orderkey % 11 = 0 AND o_orderkey % 13 = 0) AND (o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 OR o_orderkey % 7 = 0)
""")
def h6_diff_stored(spark, d):
    """Two runs saved to the store, whose ids read as numbers, compared by their trees of digests."""
    path = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    for run_id, rows in zip(("12", "0012"), _versions(spark, d), strict=True):
        ST.save_run({"models": rows}, path, run_id)
    return ST.diff_stored(spark, path, "models", "12", "0012")


@_plain("SELECT r AS run_id, CASE WHEN r = '12' THEN 'second' ELSE 'first' END AS save, count(*) AS n FROM orders, (VALUES ('12'), ('0012'), ('1e5'), ('2024-01-02')) v(r) WHERE o_orderkey % length(r) = 0 GROUP BY r")
def h1_runs_by_any_id(spark, d):
    """Runs whose ids read as numbers and dates, one of them saved twice, read back all at once."""
    path = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("model_id"), "o_orderkey")
    for run_id, save in (("12", "unused"), ("0012", "first"), ("1e5", "first"), ("2024-01-02", "first"), ("12", "second")):
        ST.save_run({"models": o.filter(F.col("o_orderkey") % len(run_id) == 0).withColumn("save", F.lit(save))}, path, run_id, ranges=8)
    return ST.load_run(spark, path, "models").groupBy("run_id", "save").agg(F.count("*").alias("n"))


@_plain("SELECT id FROM (SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderkey % 3 = 0)")
def h3_entity_ids(spark, d):
    """Save two runs to the store and list the ids of one."""
    path = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("model_id"), "o_orderstatus")
    ST.save_run({"models": o}, path, "r1")
    ST.save_run({"models": o.filter(F.col("model_id").cast("long") % 3 == 0)}, path, "r2")
    return ST.entity_ids(spark, path, "models", "r2").select(F.col("model_id").alias("id"))


@_plain("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey % 5 = 0 GROUP BY 1")
def h1_save_load(spark, d):
    """A run saved twice holds the second state only."""
    path = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    ST.save_run({"models": o}, path, "r1")
    ST.save_run({"models": o.filter("o_orderkey % 5 = 0")}, path, "r1")
    return ST.load_run(spark, path, "models", "r1").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


_KINDS = ["models", "tables", "table_edges", "column_edges", "dq_rules"]
_RUNS = "r AS (SELECT 'r' || o_custkey AS run_id, max(strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')) AS timestamp FROM orders GROUP BY o_custkey)"


def _run_rows(spark, d) -> tuple[DataFrame, DataFrame]:
    o = table(spark, d, "orders").withColumn("run_id", F.concat(F.lit("r"), "o_custkey"))
    runs = o.groupBy("run_id").agg(F.max(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).alias("timestamp"))
    return runs, o.select("run_id", F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (F.col("o_orderkey") % 5 + 1).cast("int")).alias("kind"))


@_plain(f"WITH {_RUNS} SELECT r.run_id, r.timestamp, " + ", ".join(f"count(*) FILTER (o_orderkey % 5 = {i}) AS {k}" for i, k in enumerate(_KINDS)) + " FROM (SELECT * FROM r ORDER BY timestamp DESC, run_id LIMIT 50) r JOIN orders ON 'r' || o_custkey = run_id GROUP BY r.run_id, r.timestamp")
def h4_list_runs(spark, d):
    runs, entities = _run_rows(spark, d)
    return H.list_runs(runs, entities, 50)


@_plain(f"WITH {_RUNS}, m AS (SELECT run_id, timestamp, 'stored' AS origin FROM r WHERE run_id NOT LIKE '%7' UNION ALL SELECT run_id, '2030-01-01T00:00:00', 'live' FROM r WHERE run_id LIKE '%7') SELECT * FROM m ORDER BY timestamp DESC, run_id LIMIT 200")
def h5_merge_live(spark, d):
    runs, _ = _run_rows(spark, d)
    live = runs.filter("run_id like '%7'").withColumn("timestamp", F.lit("2030-01-01T00:00:00"))
    return H.merge_live(runs.withColumn("origin", F.lit("stored")), live.withColumn("origin", F.lit("live")), 200)


def _overrides(spark, d) -> DataFrame:
    """Per customer key: 2k sets a role, 3k then sets it again, 5k rejects; others name what is not there."""
    c = table(spark, d, "customer").select("c_custkey")
    k = F.col("c_custkey")
    row = lambda cond, seq, field, new: c.filter(cond).select((k * 10 + seq).alias("seq"), k.cast("string").alias("target"), F.lit(field).alias("field"), F.lit(new).alias("new"))
    return row(k % 2 == 0, 1, "role", "Output").unionByName(row(k % 3 == 0, 2, "role", "Source")).unionByName(row(k % 5 == 0, 3, "review_status", "Rejected")).unionByName(row(k % 7 == 0, 4, "colour", "red"))


@_plain("SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 3 = 0 THEN 'Source' WHEN c_custkey % 2 = 0 THEN 'Output' ELSE 'Intermediate' END AS role, CASE WHEN c_custkey % 5 = 0 THEN 'Rejected' WHEN c_custkey % 3 = 0 OR c_custkey % 2 = 0 THEN 'Accepted' ELSE 'Proposed' END AS review_status FROM customer")
def h8_apply_overrides(spark, d):
    e = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.lit("Intermediate").alias("role"), F.lit("Proposed").alias("review_status"))
    return H.apply_overrides(e, "id", _overrides(spark, d), ["role", "review_status"])


@_plain("SELECT c_custkey * 10 + 4 AS seq, 'warning' AS severity, 'stale override: target ''' || c_custkey || ''' field ''colour'' not found on re-apply' AS message FROM customer WHERE c_custkey % 7 = 0")
def h8_stale_overrides(spark, d):
    t = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("target"), F.explode(F.array(F.lit("role"), F.lit("review_status"))).alias("field"))
    return H.stale_overrides(_overrides(spark, d), t)


@_plain("SELECT CAST(o_orderkey AS VARCHAR) AS model_id, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END END AS result, NOT (o_orderkey % 11 <> 0 AND o_orderkey % 7 <> 0) AS redone FROM orders WHERE o_orderkey % 13 <> 0")
def h11_incremental(spark, d):
    a, b = _versions(spark, d)
    key = lambda df: df.withColumn("hash", F.sha1("o_orderstatus"))
    work = lambda m: m.select("model_id", F.col("o_orderstatus").alias("result"), F.lit(True).alias("redone"))
    old = work(a).withColumn("redone", F.lit(False))
    return H.incremental(key(b), key(a), old, work)


@query("SELECT CAST(NULL AS VARCHAR) AS model_id, 'info' AS severity, 'retention scrub: cleared source snippets in local mode (usages=' || (SELECT count(*) FROM uses) || ', calcs=' || (SELECT 2 * count(*) FROM cm WHERE c_custkey % 4 = 0) || ', edges=' || (SELECT count(expression) FROM cedges) || '); set retain_source=true to keep them' AS message")
def h12_retention_scrub(spark, d):
    s = S.state(spark, d)
    out = H.scrub({k: s[k] for k in ("usages", "calculations", "column_edges")}, local=True, retain_source=False)
    return out["issues"]


# -------------------------------------------------------------------------------------- reports
@query("""SELECT 'r1' AS "Run ID", '2024-01-01T00:00:00Z' AS "Timestamp", '1.0' AS "Tool version", 'none / none' AS "LLM provider / model", 'Python, SAS' AS "Languages detected", (SELECT count(*) FROM customer) + (SELECT count(*) FROM nation) AS "# Models",
  (SELECT count(*) FROM tabs WHERE n_consumed > 0) AS "# Input tables", (SELECT count(*) FROM tabs WHERE n_produced > 0) AS "# Output tables", (SELECT count(*) FROM edges) AS "# Table-level edges", (SELECT count(*) FROM cedges) AS "# Column-level edges",
  (SELECT count(*) FROM uses_rules) AS "# DQ rules", 0 AS "Tokens", 0.0 AS "Est. cost" """.replace("(SELECT count(*) FROM uses_rules)", f"(SELECT count(*) FROM (WITH {_U}, {_B} SELECT element, dimension, rule_statement FROM bb UNION SELECT element, dimension, rule_statement FROM u))"))
def i1_run_summary(spark, d):
    return P.report_tables(S.state(spark, d))["Run Summary"]


@query("""SELECT m.model_id AS "Model ID", m.label AS "Model label", lang AS "Language", file AS "Source file(s)", CASE WHEN ord % 10 = 3 THEN '' ELSE 'reviews ' || m.label END AS "Purpose", coalesce(i, 0) AS "# Inputs", coalesce(o, 0) AS "# Outputs", CASE WHEN ord % 7 = 0 THEN 'Low' ELSE 'High' END AS "Confidence", CASE WHEN ord % 7 = 0 THEN 'Partial' ELSE 'Analyzed' END AS "Status"
FROM (SELECT model_id, c_name AS label, 'SAS' AS lang, c_name || '.sas' AS file, cm.c_custkey AS ord FROM cm JOIN customer USING (c_custkey) UNION ALL SELECT DISTINCT '""" + "m_' || substr(sha1('nation ' || lower(n_name) || '␟' || lower(n_name) || '.py'), 1, 12)" + """, 'nation ' || n_name, 'Python', n_name || '.py', n_nationkey + 1000000000 FROM nation) m
LEFT JOIN (SELECT model_id, count(DISTINCT CASE WHEN direction = 'input' THEN canon END) AS i, count(DISTINCT CASE WHEN direction = 'output' THEN canon END) AS o FROM refs GROUP BY 1) r ON m.model_id = r.model_id""")
def i1_model_inventory(spark, d):
    return P.report_tables(S.state(spark, d))["Model Inventory"]


@query("""SELECT edge_id AS "Edge ID", source_element AS "Source table.column", target_element AS "Target table.column", model_id AS "Model ID", 'aggregate' AS "Transformation type", coalesce(expression, '') AS "Transformation expression", '' AS "Join key(s)", 'E' AS "Source", 'High' AS "Confidence" FROM cedges""")
def i1_column_lineage(spark, d):
    return P.report_tables(S.state(spark, d))["Column Lineage"]


@query("""SELECT source_system AS "Source system", CAST(count(*) AS INTEGER) AS "# Tables", string_agg(table_id, ', ' ORDER BY table_id) AS "Table IDs" FROM tabs WHERE source_system IS NOT NULL GROUP BY 1""")
def i1_source_systems(spark, d):
    return P.report_tables(S.state(spark, d))["Source Systems"]


@query("""SELECT source_element AS "Source Element", target_element AS "Target Element", model_id AS "Model ID", 'aggregate' AS "Transformation Type", edge_id AS "Edge ID" FROM cedges""")
def i2_lineage_csv(spark, d):
    s = S.state(spark, d)
    return P.lineage_csv(s["tables"], s["table_edges"], s["column_edges"])


@query("""SELECT s.name AS "Source Element", t.name AS "Target Element", model_id AS "Model ID", 'derive' AS "Transformation Type", edge_id AS "Edge ID" FROM edges JOIN tabs s ON s.table_id = source_table_id JOIN tabs t ON t.table_id = target_table_id""")
def i2_lineage_csv_tables(spark, d):
    s = S.state(spark, d)
    return P.lineage_csv(s["tables"], s["table_edges"], s["column_edges"].filter("false"))


@query("SELECT model_id, count(DISTINCT CASE WHEN direction = 'input' THEN canon END) AS n_inputs, count(DISTINCT CASE WHEN direction = 'output' THEN canon END) AS n_outputs, (SELECT count(*) FROM cedges c WHERE c.model_id = refs.model_id) AS n_fields FROM refs GROUP BY model_id")
def i4_openlineage(spark, d):
    """Events read back: datasets and facet fields per model."""
    s = S.state(spark, d)
    e = P.openlineage_events(s["models"], s["table_models"], s["column_edges"], "r1", "2024-01-01T00:00:00Z")
    kind = "inputs array<struct<name string>>, outputs array<struct<name string, facets struct<columnLineage struct<fields map<string, struct<inputFields array<struct<field string>>>>>>>>"
    j = F.from_json("event", kind)
    per = F.transform(j["outputs"], lambda o: F.aggregate(F.map_values(F.coalesce(o["facets"]["columnLineage"]["fields"], F.create_map().cast("map<string,struct<inputFields:array<struct<field:string>>>>"))), F.lit(0).cast("long"), lambda t, f: t + F.size(f["inputFields"])))
    return e.select("model_id", F.size(j["inputs"]).cast("long").alias("n_inputs"), F.size(j["outputs"]).cast("long").alias("n_outputs"), F.aggregate(per, F.lit(0).cast("long"), lambda a, b: a + b).alias("n_fields"))


@query(f"WITH {_U}, {_B}, rr AS (SELECT element, dimension, rule_statement FROM bb UNION SELECT element, dimension, rule_statement FROM u), mu AS (SELECT DISTINCT model_id, element FROM uses) SELECT section_no, n FROM (SELECT 1 AS section_no, 4 * ((SELECT count(*) FROM customer) + (SELECT count(*) FROM nation)) AS n UNION ALL SELECT 4, (SELECT count(*) FROM (SELECT DISTINCT model_id, canon FROM refs WHERE direction = 'input')) + (SELECT count(*) FROM nation) - (SELECT count(DISTINCT n_name) FROM cm) UNION ALL SELECT 9, (SELECT count(*) FROM edges) + (SELECT count(*) FROM nation) - (SELECT count(DISTINCT n_name) FROM cm) UNION ALL SELECT 10, (SELECT count(*) FROM mu JOIN rr USING (element)) + (SELECT count(*) FROM nation))")
def i5_model_register(spark, d):
    r = P.model_register(S.state(spark, d))
    return r.filter("section_no in (1, 4, 9, 10)").groupBy("section_no").agg(F.count("*").alias("n"))


_PM = "pm AS (SELECT canon, direction, model_id, min(ord) AS o FROM refs GROUP BY canon, direction, model_id), pl AS (SELECT canon, string_agg(model_id, ', ' ORDER BY o, model_id) FILTER (direction = 'output') AS made, string_agg(model_id, ', ' ORDER BY o, model_id) FILTER (direction = 'input') AS used FROM pm GROUP BY canon)"


@query(f"""WITH {_PM} SELECT table_id AS "Table ID", name AS "Table name", role AS "Role", coalesce(source_system, '') AS "Source system", coalesce(made, '') AS "Produced by model(s)", coalesce(used, '') AS "Consumed by model(s)", '' AS "Grain", source AS "Source" FROM tabs JOIN pl ON canon = name""")
def i1_tables(spark, d):
    return P.report_tables(S.state(spark, d))["Tables"]


@query("""SELECT table_id AS "Table ID", name AS "Column name", '' AS "Inferred type", 'Measure' AS "Role", '' AS "Used in", 'E' AS "Source" FROM cols""")
def i1_columns(spark, d):
    return P.report_tables(S.state(spark, d))["Columns"]


@query("""SELECT edge_id AS "Edge ID", source_table_id AS "Source table ID", target_table_id AS "Target table ID", model_id AS "Model ID", 'derive' AS "Transformation type", '' AS "Notes", source AS "Source", CASE source WHEN 'E' THEN 'High' ELSE 'Low' END AS "Confidence" FROM edges""")
def i1_table_lineage(spark, d):
    return P.report_tables(S.state(spark, d))["Table Lineage"]


_RULES = "rr AS (SELECT element, dimension, rule_statement, 0 AS stage, 0 AS ord, '' AS code_evidence, 'baseline data-element expectation' AS rationale, CASE dimension WHEN 'Uniqueness' THEN 'High' ELSE 'Medium' END AS severity FROM bb UNION ALL SELECT element, dimension, rule_statement, 1, ord, evidence, 'element used as ' || usage_kind, severity FROM u)"


@query(f"""WITH {_U}, {_B}, {_RULES} SELECT {_RID} AS "Rule ID", element AS "Table.column", dimension AS "DQ dimension", rule_statement AS "Rule", arg_min(rationale, stage * 1000000000 + ord) AS "Rationale / usage", arg_min(code_evidence, stage * 1000000000 + ord) AS "Code evidence", arg_min(severity, stage * 1000000000 + ord) AS "Suggested severity", 'H' AS "Source", 'Proposed' AS "Status" FROM rr GROUP BY element, dimension, rule_statement""")
def i1_rules(spark, d):
    return P.report_tables(S.state(spark, d))["Data Quality Rules"]


_MODELS = "mm AS (SELECT model_id, c_name AS label, 'SAS' AS language, cm.c_custkey AS ord FROM cm JOIN customer USING (c_custkey) UNION ALL SELECT " + S.MID.format(label="'nation ' || n_name", file="n_name || '.py'") + ", 'nation ' || n_name, 'Python', n_nationkey + 1000000000 FROM nation)"


@query(f"""WITH {_MODELS} SELECT model_id AS "Model ID", 'error' AS "Severity", 'part of ' || label || ' failed' AS "Message" FROM mm WHERE ord % 7 = 0""")
def i1_issues(spark, d):
    return P.report_tables(S.state(spark, d))["Issues & Confidence Log"]


def _documented(spark, d) -> dict[str, DataFrame]:
    """The state with texts for some models: a summary, assumptions, steps and limitations."""
    s = S.state(spark, d)
    some = lambda n, *x: F.when(F.col("ord") % n == 0, F.array(*[F.lit(v) for v in x])).otherwise(F.array().cast("array<string>"))
    s["models"] = s["models"].withColumns({"executive_summary": F.when(F.col("ord") % 2 == 0, F.concat(F.lit("sums up "), "label")).otherwise(""), "assumptions": some(3, "a", "b"), "methodology_steps": some(4, "one", "two", "three"), "limitations": some(5, "l")})
    return s


@query(f"""WITH {_MODELS}, c AS (SELECT model_id, 2 AS n FROM cm WHERE c_custkey % 4 = 0), x AS (
SELECT model_id, 2 AS no, CASE WHEN ord % 2 = 0 THEN 'sums up ' || label ELSE 'Not identified from code' END AS value FROM mm UNION ALL SELECT model_id, 5, unnest(CASE WHEN ord % 3 = 0 THEN ['a', 'b'] ELSE ['Not identified from code'] END) FROM mm
UNION ALL SELECT model_id, 6, unnest(CASE WHEN ord % 4 = 0 THEN ['one', 'two', 'three'] ELSE ['Not identified from code'] END) FROM mm UNION ALL SELECT model_id, 11, unnest(CASE WHEN ord % 5 = 0 THEN ['l'] ELSE ['Not identified from code'] END) FROM mm
UNION ALL SELECT model_id, 7, unnest(CASE WHEN model_id IN (SELECT model_id FROM c) THEN ['sum(o_totalprice)', 'sum(o_totalprice) * 1.0'] ELSE ['Not identified from code'] END) FROM mm
UNION ALL SELECT model_id, 3, CASE WHEN ord % 10 = 3 THEN 'Not identified from code' ELSE 'reviews ' || label END FROM mm) SELECT model_id, no AS section_no, value FROM x""")
def i5_register_texts(spark, d):
    """Summary, purpose, assumptions, methodology, calculations and limitations of every model."""
    return P.model_register(_documented(spark, d)).filter("section_no in (2, 3, 5, 6, 7, 11)").select("model_id", "section_no", "value")


@query(f"""WITH {_MODELS}, {_U}, {_B} SELECT 'Model inventory' AS section, model_id AS key, label || ' | ' || language || ' | ' || CASE WHEN ord % 7 = 0 THEN 'Partial | Low' ELSE 'Analyzed | High' END || ' | ' || CASE WHEN ord % 10 = 3 THEN '' ELSE 'reviews ' || label END AS value FROM mm
UNION ALL SELECT 'Outputs', table_id, name FROM tabs WHERE role = 'Output' UNION ALL SELECT 'Source systems', source_system, CAST(count(*) AS VARCHAR) FROM tabs WHERE source_system IS NOT NULL GROUP BY source_system
UNION ALL SELECT 'Data quality register', CAST(NULL AS VARCHAR), CAST(count(*) AS VARCHAR) FROM (SELECT element, dimension, rule_statement FROM bb UNION SELECT element, dimension, rule_statement FROM u)
UNION ALL SELECT 'Cross-model lineage', 'chain', string_agg(name, ' -> ' ORDER BY name) FROM (SELECT name FROM tabs WHERE role = 'Source' ORDER BY name LIMIT 2)""")
def i5_project_summary(spark, d):
    """The summary over all models; the register's rows are counted, and one made-up path is named."""
    s = _documented(spark, d)
    path = s["tables"].filter("role = 'Source'").orderBy("name").limit(2).agg(F.transform(F.array_sort(F.collect_list(F.struct("name", "table_id"))), lambda x: x["table_id"]).alias("path"))
    p = P.project_summary(s, path)
    rules = p.filter("section = 'Data quality register'").agg(F.lit("Data quality register").alias("section"), F.lit(None).cast("string").alias("key"), F.count("*").cast("string").alias("value"))
    chain = p.filter("section = 'Cross-model lineage'").withColumn("key", F.lit("chain"))
    return p.filter("section not in ('Data quality register', 'Cross-model lineage')").unionByName(rules).unionByName(chain)
