"""Registered queries of corpus preparation, ids and scans, with their SQL. Program code is made from the
part table, a script per part in one of four languages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import ids
from tidemark.functions.scratch import shared_dir, spread
from tidemark.operators import corpus as C
from tidemark.operators import lineage as L
from tidemark.operators import scan as S
from tidemark.sources import extractions as X
from tidemark.sources.files import read_code

from .state import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


LANGS = ["SAS", "Python", "R", "VBA"]
SUFFIX = {"SAS": "sas", "Python": "py", "R": "R", "VBA": "bas"}
CODE = {
    "SAS": "libname raw '/in';\n/* set fake.t; */\ndata work.p{k};\n set raw.{b};\n where {c} > 10;\n ratio = total / {c};\n keep ratio;\nrun;\nproc sort data=work.p{k}; by {c}; run;\n",
    "Python": "import pandas as pd\ndf = pd.read_csv('in/{b}.csv')\nx = df[df['{c}'] > 10]\ng = df.groupby('{c}').sum()\ndf['ratio'] = df['total'] / df['{c}']\ndf.to_csv('out/p{k}.csv')\n",
    "R": 'd <- read_csv("in/{b}.csv") # input\ng <- d %>% group_by({c}) %>% filter({c} > 10)\nd$ratio <- d$total / d${c}\nwrite_csv(d, "out/p{k}.csv")\n',
    "VBA": 'Sub Run()\nSet ws = ThisWorkbook.Sheets("{b}")\nSet wo = Worksheets("p{k}")\nwo.Cells(1, 2).Value = ws.Cells(1, 2) / ws.Cells(1, {s})\nIf ws.Cells(2, {s}).Value > 10 Then x = 1\nEnd Sub\n',
}


def scripts(spark: SparkSession, d: str) -> DataFrame:
    """(model_id, language, filename, code, k)."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.lower(F.translate("p_brand", "#", "_")).alias("b"), F.concat(F.lit("size_"), "p_size").alias("c"), F.col("p_size").cast("string").alias("s"))
    code = None
    lang = None
    for i, name in enumerate(LANGS):
        text = F.lit(CODE[name])
        for slot in "kbcs":
            text = F.replace(text, F.lit("{" + slot + "}"), F.col(slot).cast("string"))
        hit = F.col("k") % 4 == i
        code = F.when(hit, text) if code is None else code.when(hit, text)
        lang = F.when(hit, name) if lang is None else lang.when(hit, name)
    suffix = F.try_element_at(F.create_map(*[F.lit(x) for kv in SUFFIX.items() for x in kv]), F.col("language"))
    return p.select("k", code.alias("code"), lang.alias("language")).withColumn("filename", F.concat(F.lit("p"), "k", F.lit("."), suffix)).withColumn("model_id", F.concat(F.lit("m"), "k"))


_P = "p AS (SELECT p_partkey AS k, 'm' || p_partkey AS model_id, lower(replace(p_brand, '#', '_')) AS b, 'size_' || p_size AS c, p_size AS s, p_partkey % 4 AS l FROM part)"


@query("SELECT p_partkey AS k, ['SAS', 'Python', 'R', 'VBA'][p_partkey % 4 + 1] AS language, 1.0 AS score FROM part")
def a3_detect_language(spark, d):
    found = C.detect_language(scripts(spark, d).select("k", "filename", F.col("code").alias("content")))
    return found.select("k", "language", "score")


@query(f"WITH {_P} SELECT 'm_' || substr(sha1('p' || k || '␟p' || k || ['.sas', '.py', '.r', '.bas'][l + 1]), 1, 12) AS model_id, 'p' || k AS label, 1 AS n_files FROM p")
def a4_assemble_models(spark, d):
    m = C.assemble_models(scripts(spark, d).select("filename", F.col("code").alias("content")))
    return m.select("model_id", "label", F.size("source_files").alias("n_files"))


@query("SELECT source AS label, count(*) AS n_files, sum(length(text)) + 2 * (count(*) - 1) AS code_chars FROM documents GROUP BY source")
def a4_assemble_by_group(spark, d):
    a = table(spark, d, "documents").select("source", F.col("doc_id").cast("string").alias("filename"), F.col("text").alias("content"))
    return C.assemble_totals(a, group_col="source")


@query("""
WITH m AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn, turn FROM conversations)
SELECT 'c' || conv_id AS label, count(*) AS n_files, sum(length(text)) + 2 * (count(*) - 1) AS code_chars, min(conv_id * 1000 + turn) AS ord FROM m GROUP BY conv_id
""")
def a5_merge_models(spark, d):
    c = table(spark, d, "conversations")
    key = F.concat("conv_id", F.lit("/"), "turn")
    m = c.select(key.alias("model_id"), key.alias("label"), F.array(key).alias("source_files"), F.col("text").alias("code"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"))
    return C.merge_totals(m, c.select(key.alias("model_id"), F.concat(F.lit("c"), "conv_id").alias("label")))


@query("SELECT doc_id, CASE WHEN toxic = 1 THEN 'flagged' ELSE lang END AS language FROM documents LEFT JOIN labels USING (doc_id)")
def a6_override_language(spark, d):
    m = table(spark, d, "documents").select(F.col("doc_id").alias("model_id"), F.col("lang").alias("language"))
    o = table(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").alias("model_id"), F.lit("flagged").alias("language"))
    return C.override_language(m, o).withColumnRenamed("model_id", "doc_id")


@query("SELECT doc_id, greatest(1, length(text) // 4) AS tokens FROM documents")
def a7_token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", C.estimate_tokens("text").alias("tokens"))


@query("SELECT doc_id, sha256(text) AS text_sha256, true AS within FROM documents")
def a8_chunk(spark, d):
    """Chunks of up to 100 tokens cut before lines, put together again; each fits unless it is one segment."""
    c = C.chunk(table(spark, d, "documents").select("doc_id", "text"), "text", r"(?<=\n)", 100)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "chunk"))), lambda x: x["chunk"]), "")
    fits = F.bool_and((F.greatest(F.lit(1), F.floor(F.length("chunk") / 4)) <= 100 + F.length(F.regexp_replace("chunk", r"[^\n]", ""))) | (F.length(F.regexp_replace("chunk", r"[^\n]", "")) <= 1))
    return c.groupBy("doc_id").agg(F.sha2(whole, 256).alias("text_sha256"), fits.alias("within"))


@query("""
WITH RECURSIVE s AS (SELECT doc_id, generate_subscripts(x, 1) AS i, unnest(x) || CASE WHEN generate_subscripts(x, 1) < len(x) THEN '. ' ELSE '' END AS seg FROM (SELECT doc_id, string_split(text, '. ') AS x FROM documents)),
t AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i, greatest(1, length(seg) // 4) AS n FROM s WHERE seg <> ''),
w AS (SELECT doc_id, i, n AS used, 0 AS chunk_no FROM t WHERE i = 1
  UNION ALL SELECT t.doc_id, t.i, CASE WHEN w.used + t.n <= 120 THEN w.used + t.n ELSE t.n END, CASE WHEN w.used + t.n <= 120 THEN w.chunk_no ELSE w.chunk_no + 1 END FROM w JOIN t ON t.doc_id = w.doc_id AND t.i = w.i + 1)
SELECT doc_id, chunk_no, count(*) AS segments, CAST(max(used) AS BIGINT) AS tokens FROM w GROUP BY doc_id, chunk_no
""")
def a8_chunk_boundaries(spark, d):
    """Which sentences each chunk of 120 tokens holds; empty texts have no sentence."""
    c = C.chunk(table(spark, d, "documents").select("doc_id", "text").filter("text <> ''"), "text", r"(?<=\. )", 120)
    segs = F.filter(C.segments("chunk", r"(?<=\. )"), lambda x: x != "")
    size = F.transform(segs, lambda x: F.greatest(F.lit(1), F.floor(F.length(x) / 4).cast("int")))
    return c.select("doc_id", "chunk_no", F.size(segs).cast("long").alias("segments"), F.aggregate(size, F.lit(0).cast("long"), lambda t, n: t + n).alias("tokens"))


@query(f"WITH {_P} SELECT k, [3, 1, 1, 1][l + 1] AS n_segments FROM p")
def a9_split_points(spark, d):
    s = scripts(spark, d)
    n = [F.when(F.col("language") == lang, F.size(F.filter(C.segments("code", C.SPLITS[lang]), lambda x: x != ""))) for lang in LANGS]
    return s.select("k", F.when(F.col("language") == "SAS", n[0] - 1).otherwise(F.coalesce(*n[1:])).alias("n_segments"))


@query("SELECT p_partkey AS k, false AS has_comment, p_partkey % 4 = 0 AS string_gone FROM part WHERE p_partkey % 4 = 0")
def a10_blank_comments(spark, d):
    s = scripts(spark, d).filter("language = 'SAS'")
    bare = C.blank("code", "SAS")
    return s.select("k", bare.contains("fake.t").alias("has_comment"), (~bare.contains("/in")).alias("string_gone"))


@query("""
SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN 'a = "x # y ' || p_brand || '" + b  ' WHEN 1 THEN 'x <- f(a) ' ELSE 'x = y / z ' END AS bare FROM part
""")
def a10_blank_other_languages(spark, d):
    """Comments go, signs of comments inside Python strings stay; R loses its strings, too."""
    k = F.col("p_partkey")
    p = table(spark, d, "part").select(k.alias("k"), "p_brand")
    py = F.concat(F.lit('a = "x # y '), "p_brand", F.lit('" + b  # c = "d"'))
    r, vba = F.concat(F.lit("x <- f(a) # g('"), "p_brand", F.lit("')")), F.concat(F.lit("x = y / z ' "), "p_brand")
    bare = F.when(F.col("k") % 3 == 0, C.blank(py, "Python")).when(F.col("k") % 3 == 1, C.blank(r, "R")).otherwise(C.blank(vba, "VBA"))
    return p.select("k", bare.alias("bare"))


_RED = [("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "[REDACTED:email]"), ("ssn", r"\b\d{3}-\d{2}-\d{4}\b", "[REDACTED:ssn]"), ("account", r"(?i)\b(?:acct|account|card|cc)\w*[#:= _\-,.]*[0-9]{12,19}\b", "[REDACTED:account]"), ("aws", r"\bAKIA[0-9A-Z]{16}\b", "[REDACTED:aws_access_key]"), ("secret", r"\bsk-(?:ant-)?[A-Za-z0-9_\-]{16,}\b", "[REDACTED:secret]")]
_expr = "text"
for _, _rx, _to in _RED:
    _expr = f"regexp_replace({_expr}, '{_rx}', '{_to}', 'g')"
_ASCII = "regexp_replace(text, '[^ -~\\n]', 'x', 'g')"  # both engines then agree on word boundaries


@query(f"WITH t AS (SELECT doc_id, {_ASCII} AS text FROM documents) SELECT doc_id, sha256({_expr}) AS redacted_sha256, CAST(len(regexp_extract_all(text, '{_RED[0][1]}')) AS INTEGER) AS emails FROM t")
def a11_redact(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.regexp_replace("text", r"[^ -~\n]", "x").alias("text"))
    r = C.redact(t, "text")
    return r.select("doc_id", F.sha2("redacted", 256).alias("redacted_sha256"), F.coalesce(F.try_element_at("hits", F.lit("email")), F.lit(0)).alias("emails"))


@query(f"WITH t AS (SELECT source, {_ASCII} AS text FROM documents), n AS (SELECT source, sum(len(regexp_extract_all(text, '{_RED[0][1]}'))) AS n, sum(len(regexp_extract_all(text, '{_RED[3][1]}'))) AS k FROM t GROUP BY source) SELECT source AS model_id, 'info' AS severity, 'redacted ' || CAST(n + k AS BIGINT) || ' token(s) before LLM call: ' || CASE WHEN n > 0 THEN 'email=' || CAST(n AS BIGINT) ELSE '' END || CASE WHEN n > 0 AND k > 0 THEN ', ' ELSE '' END || CASE WHEN k > 0 THEN 'aws_access_key=' || CAST(k AS BIGINT) ELSE '' END AS message FROM n WHERE n + k > 0")
def a12_redaction_issues(spark, d):
    two = [p for p in C.REDACTIONS if p[0] in ("email", "aws_access_key")]
    t = table(spark, d, "documents").select("source", F.regexp_replace("text", r"[^ -~\n]", "x").alias("text"))
    return C.redaction_issues(C.redact(t, "text", two), "source", two)


_NAMES = ["email", "ssn", "account_number", "aws_access_key", "provider_secret"]
_STEPS = f"t0 AS (SELECT source, {_ASCII} AS text FROM documents)"
for _i, (_, _rx, _to) in enumerate(_RED):
    _STEPS += f", t{_i + 1} AS (SELECT *, len(regexp_extract_all(text, '{_rx}')) AS n{_i} FROM {f'u{_i}' if _i else 't0'}), u{_i + 1} AS (SELECT * REPLACE (regexp_replace(text, '{_rx}', '{_to}', 'g') AS text) FROM t{_i + 1})"
_COUNTS = ", ".join(f"CAST(sum(n{i}) AS BIGINT) AS n{i}" for i in range(5))
_SAID = ", ".join(f"CASE WHEN n{i} > 0 THEN '{n}=' || n{i} END" for i, n in enumerate(_NAMES))


@query(f"WITH {_STEPS}, s AS (SELECT source, {_COUNTS} FROM u5 GROUP BY source) SELECT source AS model_id, 'info' AS severity, 'redacted ' || (n0 + n1 + n2 + n3 + n4) || ' token(s) before LLM call: ' || concat_ws(', ', {_SAID}) AS message FROM s WHERE n0 + n1 + n2 + n3 + n4 > 0")
def a12_redaction_issues_all(spark, d):
    """All five patterns, each counted in what the ones before it left."""
    t = table(spark, d, "documents").select("source", F.regexp_replace("text", r"[^ -~\n]", "x").alias("text"))
    return C.redaction_issues(C.redact(t, "text"), "source")


@query("""
WITH m AS (SELECT doc_id, greatest(1, length(text) // 4) + 450 AS i FROM documents), n AS (SELECT doc_id, i, CAST(floor(i * CAST(0.35 AS DOUBLE)) AS BIGINT) AS o FROM m)
SELECT doc_id AS label, CAST(sum(i) AS BIGINT) AS tokens_in, CAST(sum(o) AS BIGINT) AS tokens_out, CAST(sum(i) + sum(o) AS BIGINT) AS tokens FROM n GROUP BY ROLLUP (doc_id)
""")
def a13_estimate(spark, d):
    return C.estimate_models(table(spark, d, "documents"), "doc_id", "text").drop("est_cost")


@query("""
WITH m AS (SELECT doc_id, greatest(1, length(text) // 4) + 450 AS i FROM documents), n AS (SELECT doc_id, i, CAST(floor(i * CAST(0.35 AS DOUBLE)) AS BIGINT) AS o FROM m)
SELECT doc_id AS label, round(CAST(sum(i) AS DOUBLE) / 1000 * CAST(0.003 AS DOUBLE) + CAST(sum(o) AS DOUBLE) / 1000 * CAST(0.015 AS DOUBLE), 4) AS est_cost FROM n GROUP BY ROLLUP (doc_id)
""")
def a13_estimate_cost(spark, d):
    return C.estimate_models(table(spark, d, "documents"), "doc_id", "text").select("label", "est_cost")


@query("SELECT doc_id, sha1('summarise' || chr(0) || text) AS request_hash, length(text) AS n FROM documents")
def a14_reuse_by_hash(spark, d):
    q = table(spark, d, "documents").select("doc_id", F.lit("summarise").alias("system"), F.col("text").alias("user"))
    out = C.reuse_by_hash(q, "system", "user", lambda r: r.withColumn("n", F.length("user").cast("long")))
    return out.select("doc_id", "request_hash", "n")


@query("SELECT doc_id, length(text) AS n, CASE WHEN text IN (SELECT text FROM documents WHERE doc_id % 2 = 0) THEN 'first' ELSE 'second' END AS made_in FROM documents")
def a14_reuse_across_runs(spark, d):
    """Two runs over one store of results: every other document is asked for in the first, all in the second."""
    path = f"{shared_dir(spark)}/answers-{uuid.uuid4().hex}"
    q = table(spark, d, "documents").select("doc_id", F.lit("summarise").alias("system"), F.col("text").alias("user"))
    work = lambda run: lambda r: r.withColumns({"n": F.length("user").cast("long"), "made_in": F.lit(run)})
    C.reuse_stored(q.filter("doc_id % 2 = 0"), "system", "user", work("first"), path)
    return C.reuse_stored(q, "system", "user", work("second"), path).select("doc_id", "n", "made_in")


@query("SELECT count(*) AS requests, count(DISTINCT text) AS misses, count(*) - count(DISTINCT text) AS hits FROM documents")
def a14_cache_statistics(spark, d):
    return C.cache_statistics(table(spark, d, "documents").withColumn("system", F.lit("s")), "system", "text")


@query("""
SELECT o_orderkey, o_orderstatus AS purpose, CASE o_orderkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 3 THEN 1 WHEN 4 THEN 2 ELSE 1 END AS n_tables,
  CASE o_orderkey % 3 WHEN 0 THEN 'a.x>b.y' WHEN 1 THEN 'a.x>b.y' ELSE '' END AS lineage
FROM orders WHERE o_orderkey % 7 <> 0
""")
def a15_parse_extractions(spark, d):
    """Raw replies made from orders: table lists in six shapes, lineage in three, every seventh broken."""
    tables = ['null', '"t1, t2"', '["t1", {"name": "t2", "columns": "a, b"}]', '{"name": "t1", "columns": ["a"]}', '{"t1": ["a", "b"], "t2": "c"}', '[{"name": "t1"}, {"columns": ["x"]}]']
    rows = ['"a.x -> b.y"', '[{"source": "a.x", "target": "b.y"}, "none"]', '"no arrow"']
    k = F.col("o_orderkey")
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (k % n + 1).cast("int"))
    raw = F.concat(F.lit('{"purpose": "'), "o_orderstatus", F.lit('", "input_tables": '), pick(tables, 6), F.lit(', "lineage_rows": '), pick(rows, 3), F.when(k % 7 == 0, F.lit("")).otherwise(F.lit("}")))
    good, _ = X.parse_extractions(table(spark, d, "orders").select("o_orderkey", raw.alias("raw")))
    said = F.array_join(F.transform("lineage_rows", lambda r: F.concat(r["source_element"], F.lit(">"), r["target_element"])), ",")
    return good.select("o_orderkey", "purpose", F.size("input_tables").alias("n_tables"), said.alias("lineage"))


@query("""
WITH o AS (SELECT o_custkey AS m, o_orderkey AS k, o_orderstatus AS s, o_orderpriority AS p FROM orders WHERE o_orderkey % 7 <> 0)
SELECT m AS model_id, arg_min(p, k) AS executive_summary, CAST(count(DISTINCT s) + 1 AS BIGINT) AS n_assumptions, string_agg('s' || k, ',' ORDER BY k) AS steps, 2 * count(*) AS n_transformations,
  count(DISTINCT s) AS n_calculations, count(DISTINCT s) AS n_tables, count(DISTINCT (s, left(p, 1))) AS n_columns, CASE WHEN count(*) = 1 THEN 1 ELSE count(DISTINCT s) END AS n_lineage
FROM o GROUP BY m
""")
def a15_d1_read_and_merge(spark, d):
    """Raw replies, one an order, read and merged to one extraction a customer; every seventh cannot be read."""
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    q = lambda *x: F.concat(F.lit('"'), *x, F.lit('"'))
    raw = F.concat(
        F.lit('{"executive_summary": '), q("o_orderpriority"), F.lit(', "assumptions": ['), q(s), F.lit(', "common"], "methodology_steps": '), q(F.lit("s"), k.cast("string")), F.lit(', "limitations": null, "transformations": ['), q(s), F.lit(', "u"]'),
        F.lit(', "calculations": [{"target": '), q(F.lit("a."), s), F.lit(', "expression": "x + 1"}, {"target": "none"}], "input_tables": {'), q(F.lit("t_"), s), F.lit(": ["), q(F.substring("o_orderpriority", 1, 1)), F.lit(']}, "lineage_rows": '), q(F.lit("a."), s, F.lit(" -> b.x")), F.when(k % 7 == 0, F.lit("")).otherwise(F.lit("}")),
    )
    orders = spread(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), "o_orderkey")
    good, _ = X.parse_extractions(orders.select(F.col("o_custkey").alias("model_id"), k.alias("chunk_no"), raw.alias("raw")))
    m = L.merge_extractions(good)
    t = m["tables"].groupBy("model_id").agg(F.count("*").alias("n_tables"), F.sum(F.size("columns")).cast("long").alias("n_columns"))
    n = lambda kind, c: m[kind].groupBy("model_id").agg(F.count("*").alias(c))
    size = lambda c: F.size(c).cast("long")
    own = m["scalars"].select("model_id", "executive_summary", size("assumptions").alias("n_assumptions"), F.array_join("methodology_steps", ",").alias("steps"), size("transformations").alias("n_transformations"))
    return own.join(n("calculations", "n_calculations"), "model_id").join(t, "model_id").join(n("lineage", "n_lineage"), "model_id")


@query("SELECT o_custkey AS model_id, 'error' AS severity, count(*) || ' reply(s) could not be read' AS message FROM orders WHERE o_orderkey % 7 = 0 GROUP BY o_custkey")
def a15_issues(spark, d):
    """Replies in quarantine become issues of their models."""
    raw = F.when(F.col("o_orderkey") % 7 == 0, F.lit("[1")).otherwise(F.lit("{}"))
    _, bad = X.parse_extractions(table(spark, d, "orders").select(F.col("o_custkey").alias("model_id"), raw.alias("raw")))
    return X.extraction_issues(bad)


@query("""
SELECT o_custkey AS model_id, count(*) FILTER (o_orderstatus <> 'P') AS ok, count(*) FILTER (o_orderstatus = 'P') AS bad,
  CASE WHEN count(*) FILTER (o_orderstatus <> 'P') = 0 THEN 'Failed' WHEN count(*) FILTER (o_orderstatus = 'P') > 0 THEN 'Partial' ELSE 'Analyzed' END AS status,
  CASE WHEN count(*) FILTER (o_orderstatus = 'P') = 0 THEN 'High' ELSE 'Low' END AS confidence
FROM orders GROUP BY o_custkey
""")
def a16_extraction_status(spark, d):
    return C.extraction_status(table(spark, d, "orders").select(F.col("o_custkey").alias("model_id"), (F.col("o_orderstatus") != "P").alias("valid")))


# --------------------------------------------------------------------------------------- ids
@query("SELECT p_partkey, lower(regexp_replace(trim('  ' || p_name || '  x '), '\\s+', ' ', 'g')) AS canon, 'stg.' || lower(replace(p_brand, '#', '_')) AS aliased FROM part")
def b1_canonical_name(spark, d):
    p = table(spark, d, "part")
    aliases = F.create_map(F.lit("wrk"), F.lit(" STG "))
    return p.select("p_partkey", ids.canonical_name(F.concat(F.lit("  "), "p_name", F.lit("  x "))).alias("canon"), ids.canonical_name(F.concat(F.lit("WRK."), F.translate("p_brand", "#", "_")), aliases).alias("aliased"))


@query("""
SELECT s_suppkey, 't_' || substr(sha1(lower(s_name)), 1, 12) AS table_id, 'm_' || substr(sha1(lower(s_name) || '␟a.sas␟b.sas'), 1, 12) AS model_id,
  'te_' || substr(sha1(lower(s_name) || '␟x␟m␟derive'), 1, 12) AS te, 'ce_' || substr(sha1(lower(s_name) || '.a␟x.b␟m␟derive'), 1, 12) AS ce,
  'dq_' || substr(sha1(lower(s_name) || '.a␟validity␟non-null'), 1, 12) AS dq
FROM supplier
""")
def b2_ids(spark, d):
    n = F.col("s_name")
    m, k = F.lit("m"), F.lit("derive")
    return table(spark, d, "supplier").select(
        "s_suppkey", ids.table_id(F.concat(F.lit(" "), F.upper(n))).alias("table_id"), ids.model_id(n, F.array(F.lit("b.sas"), F.lit("a.sas"))).alias("model_id"), ids.table_edge_id(n, F.lit("X"), m, k).alias("te"),
        ids.column_edge_id(F.concat(n, F.lit(".a")), F.lit("x.b"), m, k).alias("ce"), ids.rule_id(F.concat(n, F.lit(".a")), F.lit("Validity"), F.lit("Non-null")).alias("dq"),
    )


@query("SELECT page_id, split_part(url, '.', -1) AS col, CASE WHEN contains(url, '.') THEN substr(url, 1, length(url) - length(split_part(url, '.', -1)) - 1) END AS tab, CASE WHEN contains(url, '.') THEN split_part(url, '.', 1) END AS sys, split_part(url, '/', -1) AS tail FROM pages")
def b3_element_parts(spark, d):
    """Element split, source system and path tail, on URLs."""
    return table(spark, d, "pages").select("page_id", ids.element_column("url").alias("col"), ids.element_table("url").alias("tab"), ids.source_system("url").alias("sys"), ids.path_tail("url").alias("tail"))


@query("SELECT event_id, regexp_matches(n, '(?i)(?:^|_)(id|key|sk|pk|uuid)(?:$|_)') AS id_like, regexp_matches(n, '(?i)(?:^|_)(date|dt|datetime|timestamp|ts|asof)(?:$|_)') AS date_like FROM (SELECT event_id, event_type || CASE event_id % 4 WHEN 0 THEN '_ID' WHEN 1 THEN '_ts' WHEN 2 THEN 'date' ELSE '_key_x' END AS n FROM events)")
def b7_name_shapes(spark, d):
    n = F.concat("event_type", F.element_at(F.array(*[F.lit(x) for x in ("_ID", "_ts", "date", "_key_x")]), (F.col("event_id") % 4 + 1).cast("int")))
    return table(spark, d, "events").select("event_id", ids.looks_like_id(n).alias("id_like"), ids.looks_like_date(n).alias("date_like"))


@query("SELECT page_id, regexp_replace(split_part(split_part(url, '?', 1), '/', -1), '\\.[^.]*$', '') AS stem FROM pages WHERE split_part(split_part(url, '?', 1), '/', -1) NOT LIKE '.%'")
def b5_path_stem(spark, d):
    u = F.substring_index("url", "?", 1)
    return table(spark, d, "pages").filter(~ids.path_tail(u).startswith(".")).select("page_id", ids.path_stem(u).alias("stem"))


@query("SELECT page_id, CASE WHEN x LIKE '.%' AND x NOT LIKE '.%.%' THEN x ELSE regexp_replace(x, '\\.[^.]*$', '') END AS stem FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '.' ELSE '' END || split_part(split_part(url, '?', 1), '/', -1) AS x FROM pages)")
def b5_path_stem_all(spark, d):
    """All pages, a third of them with a dot put in front of the last segment, which is no suffix."""
    u = F.substring_index("url", "?", 1)
    dotted = F.concat(F.lit("d/"), F.when(F.col("page_id") % 3 == 0, ".").otherwise(""), ids.path_tail(u))
    return table(spark, d, "pages").select("page_id", ids.path_stem(dotted).alias("stem"))


# --------------------------------------------------------------------------------------- scans
@query(f"""
WITH {_P} SELECT model_id, 'input' AS direction, CASE l WHEN 0 THEN 'raw.' || b WHEN 1 THEN 'in/' || b || '.csv' WHEN 2 THEN b || '.csv' ELSE b END AS name FROM p
UNION ALL SELECT model_id, 'output', CASE l WHEN 0 THEN 'work.p' || k WHEN 1 THEN 'out/p' || k || '.csv' WHEN 2 THEN 'p' || k || '.csv' ELSE 'p' || k END FROM p
UNION ALL SELECT model_id, 'input', 'work.p' || k FROM p WHERE l = 0
""")
def c_scan_references(spark, d):
    return S.scan_references(scripts(spark, d))


@query(f"""
WITH {_P} SELECT model_id, 'raw.' || b || '.' || c AS element, unnest(['denominator', 'range_filter']) AS usage_kind, 'High' AS confidence FROM p WHERE l = 0
UNION ALL SELECT model_id, c, 'join_key', 'High' FROM p WHERE l = 0
UNION ALL SELECT model_id, 'raw.' || b || '.ratio', 'output_measure', 'High' FROM p WHERE l = 0
UNION ALL SELECT model_id, b || '.' || c, unnest(['denominator', 'range_filter', 'aggregated']), 'High' FROM p WHERE l = 1
UNION ALL SELECT model_id, b || '.ratio', 'output_measure', 'Medium' FROM p WHERE l = 1
UNION ALL SELECT model_id, c, unnest(['denominator', 'range_filter', 'aggregated']), 'High' FROM p WHERE l = 2
UNION ALL SELECT model_id, 'ratio', 'output_measure', 'Medium' FROM p WHERE l = 2
UNION ALL SELECT model_id, b || '.col' || s, unnest(['denominator', 'range_filter']), 'High' FROM p WHERE l = 3
""")
def c_scan_usages(spark, d):
    return S.scan_usages(scripts(spark, d)).drop("evidence")


@query(f"WITH {_P} SELECT model_id, 'raw' AS alias, '/in' AS system FROM p WHERE l = 0")
def c3_libnames(spark, d):
    return S.sas_libnames(scripts(spark, d).filter("language = 'SAS'"))


# Scripts whose statements depend on the customer: each bit of the key puts one in.
_SAS_BITS = [" where {c} between 1 and 9;", " x = datepart({c}_d);", " y = input({c}_t, 8.);", " if {c}_s in (1, 2);", " r = a / {c};", " z = 1; keep z;"]
_PY_BITS = [
    "a = df[df['{c}'].between(1, 9)]", "df['d'] = pd.to_datetime(df['{c}_d'])  # df['no'] / df['no']", "t = df['{c}_t'].astype(int)", "s = df['{c}_s'].isin([1, 2]) & ('x / df' != '#')", "r = 1 / df['{c}']", "m = df.merge(o, on='{c}_k')",
    "df = pd.read_parquet('in/late_{n}.parquet')\nq = df['{c}_q'].isin([3])",
]


def _bits(spark: SparkSession, d: str) -> DataFrame:
    """(model_id, language, code): a SAS, a Python and an R script for each customer."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.concat(F.lit("n"), "c_nationkey").alias("n"), F.lower(F.substring("c_mktsegment", 1, 3)).alias("c"))
    filled = lambda t: F.replace(F.replace(F.lit(t), F.lit("{c}"), F.col("c")), F.lit("{n}"), F.col("n"))
    some = lambda parts: F.array_join(F.filter(F.array(*[F.when(F.shiftright("k", i) % 2 == 1, filled(t)) for i, t in enumerate(parts)]), lambda x: x.isNotNull()), "\n")
    libs = F.when(F.col("k") % 2 == 0, F.lit("libname p '/p'; libname q '/q';\n")).otherwise(F.lit("libname p '/p';\n"))
    sas = F.concat(libs, filled("data out.{n};\n merge p.{n} (in=f) q.{n}_b; by {c}_id;\n"), some(_SAS_BITS), filled("\nrun;\nproc sql; create table w.{n} as select * from p.{n} inner join q.t on a.{c} = b.{c} group by {c}, seg order by zz; quit;\n"))
    py = F.concat(filled("import pandas as pd\ndf = pd.read_csv('data/raw/{n}.csv')\n"), some(_PY_BITS), F.lit("\n"))
    r = filled('d <- inner_join(read_csv("in/{n}.csv"), e, by = "{c}_k") # merge(x, y, by = "no")\n')
    made = F.explode(F.array(*[F.struct(F.lit(lang).alias("language"), code.alias("code")) for lang, code in (("SAS", sas), ("Python", py), ("R", r))])).alias("x")
    return c.select("k", made).select(F.concat(F.substring("x.language", 1, 1), F.col("k").cast("string")).alias("model_id"), "x.language", "x.code")


def _bit(i: int) -> str:
    return f"(k >> {i}) % 2 = 1"


_CB = "b AS (SELECT c_custkey AS k, 'n' || c_nationkey AS n, lower(left(c_mktsegment, 3)) AS c FROM customer)"
_SAS_KINDS = [("c", "time_window"), ("c || '_d'", "date_parse"), ("c || '_t'", "type_cast"), ("c || '_s'", "equality_set"), ("c", "denominator"), ("'z'", "output_measure")]
_PY_KINDS = [("c", "time_window", ".between(...)"), ("c || '_d'", "date_parse", "to_datetime(...)"), ("c || '_t'", "type_cast", ".astype(...)"), ("c || '_s'", "equality_set", ".isin([...])"), ("c", "denominator", "x / <col>")]
_SAS_ROWS = [f"SELECT 'S' || k AS model_id, 'p.' || n || '.' || {col} AS element, '{kind}' AS usage_kind, CASE '{kind}' WHEN 'output_measure' THEN 'z = ... ; keep z' END AS evidence FROM b WHERE {_bit(i)}" for i, (col, kind) in enumerate(_SAS_KINDS)]
_SAS_ROWS += [
    "SELECT 'S' || k, 'p.' || n || '.' || c || '_id', 'join_key', NULL FROM b",
    "SELECT 'S' || k, 'p.' || n || '.' || c, CASE WHEN k % 2 = 0 THEN 'cross_system_join' ELSE 'join_key' END, NULL FROM b",
    "SELECT 'S' || k, 'p.' || n || '.' || unnest([c, 'seg']), 'aggregated', NULL FROM b",
]
_PY_ROWS = [f"SELECT 'P' || k, n || '.' || {col}, '{kind}', '{said}' FROM b WHERE {_bit(i)}" for i, (col, kind, said) in enumerate(_PY_KINDS)]
_PY_ROWS += [
    f"SELECT 'P' || k, n || '.' || c || '_k', CASE WHEN {_bit(6)} THEN 'cross_system_join' ELSE 'join_key' END, '.merge(on=' || chr(39) || c || '_k' || chr(39) || ')' FROM b WHERE {_bit(5)}",
    f"SELECT 'P' || k, 'late_' || n || '.' || c || '_q', 'equality_set', '.isin([...])' FROM b WHERE {_bit(6)}",
]


@query(f"WITH {_CB} " + " UNION ALL ".join([*_SAS_ROWS, *_PY_ROWS, "SELECT 'R' || k, c || '_k', 'join_key', 'by = \"' || c || '_k\"' FROM b"]))
def c_scan_usage_kinds(spark, d):
    """All kinds of usages in SAS and Python, and joins in R, over scripts that differ by customer: MERGE before
    FROM, libraries that make a join cross systems, a rebound data frame, signs of comments in strings."""
    u = S.scan_usages(_bits(spark, d))
    told = (F.col("usage_kind") == "output_measure") | ~F.col("model_id").startswith("S")
    return u.select("model_id", "element", "usage_kind", F.when(told, F.col("evidence")).alias("evidence"))


@query(f"""WITH {_CB} SELECT 'S' || k AS model_id, 'input' AS direction, unnest(['p.' || n, 'q.' || n || '_b']) AS name FROM b UNION ALL SELECT 'S' || k, 'output', unnest(['out.' || n, 'w.' || n]) FROM b
UNION ALL SELECT 'P' || k, 'input', 'data/raw/' || n || '.csv' FROM b UNION ALL SELECT 'P' || k, 'input', 'in/late_' || n || '.parquet' FROM b WHERE {_bit(6)} UNION ALL SELECT 'R' || k, 'input', n || '.csv' FROM b""")
def c_scan_more_references(spark, d):
    return S.scan_references(_bits(spark, d))


# One script in four layouts, by the customer's key: a statement a line, arguments on lines of their own, calls on
# lines of their own within brackets, and lines continued by backslashes.
_LAYOUTS = [
    "df = pd.read_csv('in/{n}.csv')\nm = df.merge(o, how='left', on='{c}_k')\ng = df.groupby('{c}_g').sum()\nr = 1 / (df['{c}_d'])\nt = df['{c}_t'].astype(int)\nf = df[df['{c}_f'] > 10]\ndf['{c}_o'] = 1\ndf.to_csv('out/{n}.csv')\n",
    "df = pd.read_csv(\n    'in/{n}.csv',\n    sep=')',\n)\nm = df.merge(\n    o[['a', 'b']],  # on='no'\n    how='left',\n    on='{c}_k',\n)\ng = df.groupby(\n    '{c}_g'\n).sum()\nr = 1 / (\n    df['{c}_d']\n)\nt = df[\n    '{c}_t'\n].astype(int)\nf = df[\n    df['{c}_f']\n    > 10\n]\ndf[\n    '{c}_o'\n] = 1\ndf.to_csv(\n    'out/{n}.csv'\n)\n",
    "df = (\n    pd\n    .read_csv('in/{n}.csv')\n)\nm = (\n    df\n    .merge(o, how='left', on='{c}_k')\n)\ng = (\n    df\n    .groupby('{c}_g')\n    .sum()\n)\nr = (\n    1\n    / (df['{c}_d'])\n)\nt = (\n    df['{c}_t']\n    .astype(int)\n)\nf = df[(\n    df['{c}_f'] > 10\n)]\ndf['{c}_o'] = (\n    1\n)\n(\n    df\n    .to_csv('out/{n}.csv')\n)\n",
    "df = \\\n    pd.read_csv('in/{n}.csv')\nm = df \\\n    .merge(o, how=f('x', on='no'), on='{c}_k')\ng = df \\\n    .groupby('{c}_g').sum()\nr = 1 \\\n    / (df['{c}_d'])\nt = df['{c}_t'] \\\n    .astype(int)\nf = df[df['{c}_f'] \\\n    > 10]\ndf['{c}_o'] \\\n    = 1\ndf \\\n    .to_csv('out/{n}.csv')\n",
]
_LAID = [("_k", "join_key", ".merge(on=' || chr(39) || c || '_k' || chr(39) || ')"), ("_g", "aggregated", ".groupby(...)"), ("_d", "denominator", "x / <col>"), ("_t", "type_cast", ".astype(...)"), ("_f", "range_filter", "df[col] > n"), ("_o", "output_measure", 'df["\' || c || \'_o"] = ...; df.to_*()')]


@query(f"WITH {_CB} " + " UNION ALL ".join(f"SELECT 'L' || k AS model_id, n || '.' || c || '{end}' AS element, '{kind}' AS usage_kind, '{said}' AS evidence, '{'Medium' if kind == 'output_measure' else 'High'}' AS confidence FROM b" for end, kind, said in _LAID).replace("\\'", "'"))
def c_scan_layouts(spark, d):
    """A Python script gives the same usages however its statements are laid out."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.concat(F.lit("n"), "c_nationkey").alias("n"), F.lower(F.substring("c_mktsegment", 1, 3)).alias("c"))
    laid = F.element_at(F.array(*[F.lit(x) for x in _LAYOUTS]), (F.col("k") % len(_LAYOUTS) + 1).cast("int"))
    code = F.replace(F.replace(laid, F.lit("{c}"), F.col("c")), F.lit("{n}"), F.col("n"))
    return S.python_usages(c.select(F.concat(F.lit("L"), F.col("k").cast("string")).alias("model_id"), code.alias("code")))


def _made(spark: SparkSession, d: str, **scripts: tuple) -> DataFrame:
    """(model_id, language, code) of each customer: the scripts by language, the key choosing among several, with the
    customer's nation and segment put in."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.concat(F.lit("n"), "c_nationkey").alias("n"), F.lower(F.substring("c_mktsegment", 1, 3)).alias("c"))
    code = lambda texts: F.replace(F.replace(F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col("k") % len(texts) + 1).cast("int")), F.lit("{c}"), F.col("c")), F.lit("{n}"), F.col("n"))
    made = F.explode(F.array(*[F.struct(F.lit(lang).alias("language"), code(texts).alias("code")) for lang, texts in scripts.items()])).alias("x")
    return c.select("k", made).select(F.concat(F.substring("x.language", 1, 1), F.col("k").cast("string")).alias("model_id"), "x.language", "x.code")


@query(f"""WITH {_CB} SELECT 'S' || k AS model_id, c || '_id' AS element, CASE WHEN k % 2 = 0 THEN 'aggregated' ELSE 'join_key' END AS usage_kind FROM b
UNION ALL SELECT 'S' || k, 'p.' || n || '.' || c, 'denominator' FROM b UNION ALL SELECT 'S' || k, 'p.' || n || '.' || c || '_g', 'aggregated' FROM b""")
def c_scan_sas_words(spark, d):
    """SAS words are no columns, and BY keys of a script that runs MEANS are aggregated."""
    rest = "data o.{n}; set p.{n}; x = a / sum; y = a / {c}; z = a / date; run;\nproc sql; create table w.t as select * from p.{n} group by {c}_g, calculated, month; quit;"
    return S.sas_usages(_made(spark, d, SAS=("proc means data=p.{n}; by {c}_id case; run;\n" + rest, "proc sort data=p.{n}; by {c}_id when; run;\n" + rest))).select("model_id", "element", "usage_kind")


_SHIFTS = {"SAS": [("lagged", r"\blag\((\w+)", "Low")], "Python": [("lagged", r"\b(\w+)\[[\"']([^\"']+)[\"']\]\.shift\(", 2, 1, "")], "R": [("lagged", r"\blag\((\w+)", "Low")], "VBA": [("lagged", r"(\w+)\.Cells\(\w+, (\d+)\)\.Offset")]}


@query(f"""WITH {_CB} SELECT 'S' || k AS model_id, 'p.' || n || '.' || c AS element, 'lagged' AS usage_kind, 'Low' AS confidence FROM b UNION ALL SELECT 'P' || k, n || '.' || c, 'lagged', 'High' FROM b
UNION ALL SELECT 'R' || k, c, 'lagged', 'Low' FROM b UNION ALL SELECT 'V' || k, n || '.col3', 'lagged', 'High' FROM b""")
def c24_more_patterns(spark, d):
    """A usage kind of the caller's own, found in all four languages by patterns that are passed in."""
    code = _made(spark, d, SAS=("data o.{n}; set p.{n}; x = lag({c}); run;",), Python=("df = pd.read_csv('in/{n}.csv')\nx = df['{c}'].shift(1)\n",), R=("x <- lag({c})\n",), VBA=('Set ws = Sheets("{n}")\nx = ws.Cells(1, 3).Offset(1)\n',))
    return S.scan_usages(code, _SHIFTS).drop("evidence")


@query("SELECT sum(length(p_name) + 1)::BIGINT AS chars, count(*) AS lines FROM part")
def a1_read_code(spark, d):
    """Files of code in nested folders, read one a row; files of another kind beside them are not."""
    path = f"{shared_dir(spark)}/code-{uuid.uuid4().hex}"
    p = table(spark, d, "part")
    p.select((F.col("p_size") % 3).alias("folder"), F.col("p_name").alias("value")).repartition(4).write.partitionBy("folder").text(f"{path}/text")
    p.select("p_name").write.parquet(f"{path}/other")
    return read_code(spark, path).agg(F.sum(F.length("content")).alias("chars"), F.sum(F.regexp_count("content", F.lit("\n"))).cast("long").alias("lines"))
