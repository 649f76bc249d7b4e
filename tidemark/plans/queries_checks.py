"""Registered queries of executed checks, streaming and the risk workload, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions.scratch import shared_dir
from tidemark.operators import checks as C
from tidemark.operators import history as Y
from tidemark.operators import risk as W
from tidemark.streaming import monitors as J

from .register import run_register
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


def _row(check: str, element: str, dimension: str, severity: str, source: str) -> str:
    return f"SELECT '{check}' AS \"check\", '{element}' AS element, '{dimension}' AS dimension, '{severity}' AS severity, n AS \"rows\", v AS violations, CASE WHEN n > 0 THEN round((n - v) / n, 6) ELSE 1.0 END AS pass_rate, v = 0 AS passed FROM ({source})"


def _where(t: str, bad: str) -> str:
    return f"SELECT count(*) AS n, count(*) FILTER ({bad}) AS v FROM {t}"


@query(_row("denominator", "lineitem.l_discount", "Validity", "High", _where("lineitem", "l_discount IS NULL OR l_discount = 0")))
def f1_non_zero(spark, d):
    return C.run_scalar(table(spark, d, "lineitem"), [C.non_zero("lineitem", "l_discount")])


@query(_row("unique", "orders.o_orderkey", "Uniqueness", "High", "SELECT sum(n)::BIGINT AS n, sum(n - 1)::BIGINT AS v FROM (SELECT o_orderkey, count(*) AS n FROM orders GROUP BY 1)") + " UNION ALL " + _row("unique", "lineitem.l_orderkey", "Uniqueness", "High", "SELECT sum(n)::BIGINT AS n, sum(n - 1)::BIGINT AS v FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)"))
def f2_unique(spark, d):
    return C.unique(table(spark, d, "orders"), "orders", ["o_orderkey"]).unionByName(C.unique(table(spark, d, "lineitem"), "lineitem", ["l_orderkey"]))


@query(_row("references", "lineitem.l_orderkey", "Consistency", "High", "SELECT count(*) AS n, count(*) FILTER (l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')) AS v FROM lineitem"))
def f3_references(spark, d):
    return C.references(table(spark, d, "lineitem"), "lineitem", "l_orderkey", table(spark, d, "orders").filter("o_orderstatus <> 'P'"), "o_orderkey")


@query(_row("date", "lineitem.l_shipdate", "Validity", "Medium", _where("lineitem", "NOT (CAST(l_shipdate AS DATE) BETWEEN DATE '1993-01-01' AND DATE '1997-12-31')")))
def f4_valid_date(spark, d):
    return C.run_scalar(table(spark, d, "lineitem"), [C.valid_date("lineitem", "l_shipdate", "1993-01-01", "1997-12-31")])


@query(_row("range", "lineitem.l_quantity", "Validity", "Medium", _where("lineitem", "NOT (l_quantity BETWEEN 2 AND 49)")))
def f5_in_range(spark, d):
    return C.run_scalar(table(spark, d, "lineitem"), [C.in_range("lineitem", "l_quantity", 2, 49)])


@query("SELECT quantile_cont(l_extendedprice, 0.01) AS low, quantile_cont(l_extendedprice, 0.99) AS high FROM lineitem")
def f5_learned_range(spark, d):
    return C.learned_range(table(spark, d, "lineitem"), "l_extendedprice")


@query("""
WITH a AS (SELECT n_name, date_trunc('month', o_orderdate)::DATE AS m FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderkey % 17 = 0)
SELECT x.n_name, y.m FROM (SELECT DISTINCT n_name FROM a) x, (SELECT DISTINCT m FROM a) y WHERE (x.n_name, y.m) NOT IN (SELECT (n_name, m) FROM a)
""")
def f6_grain(spark, d):
    j = table(spark, d, "orders").filter("o_orderkey % 17 = 0").join(table(spark, d, "customer"), F.expr("o_custkey = c_custkey")).join(table(spark, d, "nation"), F.expr("c_nationkey = n_nationkey"))
    return C.grain(j.select("n_name", F.trunc("o_orderdate", "month").alias("m")), "orders", ["n_name", "m"])


@query("""
WITH a AS (SELECT DISTINCT c_mktsegment, n_name, CAST(o_orderdate AS DATE) AS d FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
SELECT x.c_mktsegment, y.n_name, z.d FROM (SELECT DISTINCT c_mktsegment FROM a) x, (SELECT DISTINCT n_name FROM a) y, (SELECT DISTINCT d FROM a) z
EXCEPT SELECT c_mktsegment, n_name, d FROM a
""")
def f6_grain_daily(spark, d):
    """All orders, at a grain fine enough to have gaps."""
    j = table(spark, d, "orders").join(table(spark, d, "customer"), F.expr("o_custkey = c_custkey")).join(table(spark, d, "nation"), F.expr("c_nationkey = n_nationkey"))
    return C.grain(j.select("c_mktsegment", "n_name", F.to_date("o_orderdate").alias("d")), "orders", ["c_mktsegment", "n_name", "d"])


@query("""
WITH a AS (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS d FROM orders), s AS (SELECT min(d) AS lo, max(d) AS hi FROM a),
p AS (SELECT o_custkey, d, lead(d) OVER (PARTITION BY o_custkey ORDER BY d) AS n FROM a UNION ALL SELECT o_custkey, lo - 1, min(d) FROM a, s GROUP BY o_custkey, lo UNION ALL SELECT o_custkey, max(d), hi + 1 FROM a, s GROUP BY o_custkey, hi)
SELECT o_custkey, CAST(d + 1 AS DATE) AS gap_from, CAST(n - 1 AS DATE) AS gap_to, CAST(date_diff('day', d, n) - 1 AS INTEGER) AS days FROM p WHERE date_diff('day', d, n) > 1
""")
def f6_gaps(spark, d):
    """Stretches of days without an order, for each customer."""
    return C.gaps(table(spark, d, "orders"), ["o_custkey"], "o_orderdate")


@query("""
WITH b AS (SELECT name, count(DISTINCT CAST(o_orderdate AS DATE)) AS days, count(*) AS n, min(v) AS "min", max(v) AS "max" FROM (SELECT o_orderdate, unnest(['o_totalprice', 'o_custkey']) AS name, unnest([o_totalprice, o_custkey]) AS v FROM orders) GROUP BY name)
SELECT name, days, n, "min", "max", true AS low_is_near, true AS high_is_near, true AS distinct_is_near FROM b
""")
def f5_kept_bounds(spark, d):
    """Statistics kept by day, in two goes: the second reads the days that the first did not have. Whether the merged bounds lie
    within a hundredth of their ranks among all values, and the number of distinct ones within 5 percent."""
    path = f"{shared_dir(spark)}/days-{uuid.uuid4().hex}"
    o = table(spark, d, "orders")
    half = o.agg(F.expr("percentile_approx(o_orderdate, 0.5)")).first()[0]
    early = o.filter(F.to_date("o_orderdate") < F.lit(half).cast("date"))
    for rows in (early, o):
        Y.keep_days(rows, "o_orderdate", ["o_totalprice", "o_custkey"], path)
    kept = Y.learned_bounds(spark, path, 0.05, 0.95)
    one = [F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in ("o_totalprice", "o_custkey")]
    ranks = o.select(F.explode(F.array(*one)).alias("c")).select("c.*").join(F.broadcast(kept.select("name", "low", "high")), "name").groupBy("name").agg(
        F.avg((F.col("v") < F.col("low")).cast("int")).alias("a"), F.avg((F.col("v") <= F.col("low")).cast("int")).alias("b"),
        F.avg((F.col("v") < F.col("high")).cast("int")).alias("y"), F.avg((F.col("v") <= F.col("high")).cast("int")).alias("z"), F.count_distinct("v").alias("d"),
    )
    near = lambda q, lo, hi, name: ((F.col(lo) <= q + 0.01) & (F.col(hi) >= q - 0.01)).alias(name)
    return kept.join(ranks, "name").select("name", "days", "n", "min", "max", near(0.05, "a", "b", "low_is_near"), near(0.95, "y", "z", "high_is_near"), (F.abs(F.col("n_distinct") / F.col("d") - 1) < 0.05).alias("distinct_is_near"))


@query(_row("grain", "events.event_type,day", "Completeness", "Medium", "SELECT count(DISTINCT event_type) * count(DISTINCT d) AS n, count(DISTINCT event_type) * count(DISTINCT d) - count(DISTINCT (event_type, d)) AS v FROM (SELECT event_type, CAST(ts AS DATE) AS d FROM events)"))
def f6_grain_check(spark, d):
    return C.grain_check(table(spark, d, "events").withColumn("day", F.to_date("ts")), "events", ["event_type", "day"])


@query(_row("type", "events.props.k", "Accuracy", "Medium", _where("events", "props->>'k' IS NOT NULL AND TRY_CAST(props->>'k' AS TINYINT) IS NULL")))
def f7_castable(spark, d):
    return C.run_scalar(table(spark, d, "events"), [C.castable("events", "props.k", "tinyint", F.get_json_object("props", "$.k"))])


@query(_row("allowed", "documents.lang", "Validity", "Medium", _where("documents", "lang NOT IN ('en', 'de')")))
def f8_allowed(spark, d):
    return C.run_scalar(table(spark, d, "documents"), [C.allowed("documents", "lang", ["en", "de"])])


@query("SELECT p_brand AS value, count(*) AS n FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size < 3) GROUP BY 1")
def f8_offending_values(spark, d):
    p = table(spark, d, "part")
    return C.offending_values(p, "p_brand", p.filter("p_size < 3"), "p_brand")


@query(_row("measure", "lineitem.l_extendedprice", "Completeness", "Medium", "SELECT count(*) AS n, count(*) FILTER (l_extendedprice IS NULL) AS v FROM lineitem") + " UNION ALL " + _row("measure", "lineitem.zero", "Completeness", "Medium", "SELECT count(*) AS n, 1 AS v FROM lineitem"))
def f9_output_measure(spark, d):
    return C.run_scalar(table(spark, d, "lineitem").withColumn("zero", F.lit(0.0)), [C.output_measure("lineitem", "l_extendedprice"), C.output_measure("lineitem", "zero")])


@query("SELECT o_orderpriority AS value, count(*) AS n FROM orders WHERE o_orderpriority NOT LIKE '1%' GROUP BY 1")
def f8_offending_priorities(spark, d):
    o = table(spark, d, "orders")
    return C.offending_values(o, "o_orderpriority", o.filter("o_orderpriority like '1%'"), "o_orderpriority")


@query("SELECT event_type, max(ts) AS last, CAST(floor(epoch(TIMESTAMP '2024-01-31') - epoch(date_trunc('second', max(ts)))) AS BIGINT) AS lag_seconds, floor(epoch(TIMESTAMP '2024-01-31') - epoch(date_trunc('second', max(ts)))) <= 90000 AS passed FROM events GROUP BY event_type")
def f10_freshness(spark, d):
    return C.freshness(table(spark, d, "events"), "ts", "2024-01-31 00:00:00", 90_000, "event_type")


@query("""
WITH a AS (SELECT o_orderkey AS key, round(o_totalprice, 2) AS left_value FROM orders WHERE o_orderkey % 10 <> 1),
b AS (SELECT l_orderkey AS key, round(sum(l_extendedprice), 2) AS right_value FROM lineitem WHERE l_orderkey % 10 <> 2 GROUP BY 1)
SELECT key, left_value, right_value, CASE WHEN a.left_value IS NULL THEN 'missing_left' WHEN b.right_value IS NULL THEN 'missing_right' WHEN abs(left_value - right_value) <= 50000 THEN 'match' ELSE 'mismatch' END AS outcome FROM a FULL JOIN b USING (key)
""")
def f11_cross_system(spark, d):
    a = table(spark, d, "orders").filter("o_orderkey % 10 <> 1").select(F.col("o_orderkey").alias("k"), F.round("o_totalprice", 2).alias("x"))
    b = table(spark, d, "lineitem").filter("l_orderkey % 10 <> 2").groupBy(F.col("l_orderkey").alias("k")).agg(F.round(F.sum("l_extendedprice"), 2).alias("y"))
    return C.cross_system(a, b, "k", "x", "y", 50_000)


@query("""
WITH a AS (SELECT o_orderkey AS key, round(o_totalprice, 2) AS left_value FROM orders),
b AS (SELECT l_orderkey AS key, round(sum(l_extendedprice), 2) AS right_value FROM lineitem GROUP BY 1)
SELECT key, left_value, right_value, CASE WHEN a.left_value IS NULL THEN 'missing_left' WHEN b.right_value IS NULL THEN 'missing_right' WHEN abs(left_value - right_value) <= 50000 THEN 'match' ELSE 'mismatch' END AS outcome FROM a FULL JOIN b USING (key)
""")
def f11_cross_system_all(spark, d):
    """All keys of both sides."""
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.round("o_totalprice", 2).alias("x"))
    b = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.round(F.sum("l_extendedprice"), 2).alias("y"))
    return C.cross_system(a, b, "k", "x", "y", 50_000)


_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS \"rows\", count(*) - count({c}) AS nulls FROM lineitem" for c in _COLS))
def f12_completeness(spark, d):
    return C.completeness_profile(table(spark, d, "lineitem").select(*_COLS))


_IDS = [("documents", "doc_id"), ("events", "event_id"), ("events", "user_id"), ("benchmark", "item_id"), ("labels", "doc_id")]


@query(" UNION ALL ".join(_row("unique", f"{t}.{c}", "Uniqueness", "High", f"SELECT count(*) AS n, count(*) - count(DISTINCT {c}) AS v FROM {t}") for t, c in _IDS))
def f13_unique_ids(spark, d):
    """Uniqueness of the columns whose names look like keys, over four tables."""
    from tidemark.functions.ids import ID_SHAPE
    import re

    shape = re.compile(ID_SHAPE)
    out = None
    for name in ("documents", "events", "benchmark", "labels"):
        df = table(spark, d, name)
        for c in df.columns:
            if shape.search(c):
                one = C.unique(df, name, [c])
                out = one if out is None else out.unionByName(one)
    return out


@query(_row("date", "events.ts", "Validity", "Medium", _where("events", "NOT (CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20')")))
def f14_valid_dates(spark, d):
    from tidemark.functions.ids import DATE_SHAPE
    import re

    df = table(spark, d, "events")
    return C.run_scalar(df, [C.valid_date("events", c, "2024-01-05", "2024-01-20") for c in df.columns if re.search(DATE_SHAPE, c)])


@query(_row("ships_after_order", "lineitem,orders", "Consistency", "Medium", "SELECT count(*) AS n, count(*) FILTER (NOT (l_shipdate >= o_orderdate)) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey"))
def f15_relation(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.expr("l_orderkey = o_orderkey"))
    return C.run_scalar(j, [C.expression("lineitem,orders", "ships_after_order", F.col("l_shipdate") >= F.col("o_orderdate"))])


_USES = [("lineitem.l_discount", "denominator"), ("lineitem.l_orderkey", "join_key"), ("orders.o_orderkey", "join_key"), ("lineitem.l_quantity", "range_filter"), ("orders.o_orderstatus", "equality_set"), ("lineitem.l_extendedprice", "output_measure"), ("orders.o_orderdate", "date_parse"), ("orders.o_gone", "denominator")]
_PARAMS = {"lineitem.l_quantity": {"range": (2, 49)}, "orders.o_orderstatus": {"allowed": ["F", "O"]}, "lineitem.l_orderkey": {"references": ("orders", "o_orderkey")}, "orders.o_orderdate": {"range": ("1993-01-01", "1997-12-31")}}


def register(spark, d):
    """Baseline and usage rules of three tables, inferred and run."""
    catalog = {t: table(spark, d, t) for t in ("orders", "customer", "lineitem")}
    uses = spark.createDataFrame([(e, k, "", "m1", i) for i, (e, k) in enumerate(_USES)], "element string, usage_kind string, evidence string, model_id string, ord int")
    return run_register(catalog, uses, _PARAMS)


_NULLS = {"orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"], "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], "lineitem": _COLS}
_RULES = [f"SELECT '{t}.{c}' AS element, 'Completeness' AS dimension, 'Medium' AS severity, 'Non-null' AS rule_statement, count(*) AS n, count(*) - count({c}) AS v FROM {t}" for t, cs in _NULLS.items() for c in cs]
_KEY = "Uniqueness on key; referential integrity to joined table"
_RULES += [
    f"SELECT 'lineitem.l_discount', 'Validity', 'High', 'Must be non-null and non-zero', n, v FROM ({_where('lineitem', 'l_discount = 0')})",
    f"SELECT 'lineitem.l_orderkey', 'Uniqueness', 'High', '{_KEY}', count(*), count(*) - count(DISTINCT l_orderkey) FROM lineitem",
    f"SELECT 'lineitem.l_orderkey', 'Consistency', 'High', '{_KEY}', count(*), 0 FROM lineitem",
    f"SELECT 'orders.o_orderkey', 'Uniqueness', 'High', '{_KEY}', count(*), count(*) - count(DISTINCT o_orderkey) FROM orders",
    f"SELECT 'orders.o_orderkey', 'Consistency', 'High', '{_KEY}', NULL, NULL",
    f"SELECT 'lineitem.l_quantity', 'Validity', 'Medium', 'Value within expected domain/range', n, v FROM ({_where('lineitem', 'NOT l_quantity BETWEEN 2 AND 49')})",
    f"SELECT 'orders.o_orderstatus', 'Validity', 'Medium', 'Domain/code-value validity (allowed values)', n, v FROM ({_where('orders', 'o_orderstatus NOT IN (chr(70), chr(79))')})",
    f"SELECT 'lineitem.l_extendedprice', 'Completeness', 'Medium', 'Non-null; not all-zero/all-null', n, v FROM ({_where('lineitem', 'l_extendedprice IS NULL')})",
    f"SELECT 'orders.o_orderdate', 'Validity', 'Medium', 'Valid date; within plausible range', n, v FROM ({_where('orders', '''NOT CAST(o_orderdate AS DATE) BETWEEN DATE '1993-01-01' AND DATE '1997-12-31' ''')})",
    "SELECT 'orders.o_gone', 'Validity', 'High', 'Must be non-null and non-zero', NULL, NULL",
]
_REGISTER = f"WITH r AS ({' UNION ALL '.join(_RULES)}) SELECT 'dq_' || substr(sha1(lower(element) || '␟' || lower(dimension) || '␟' || lower(rule_statement)), 1, 12) AS rule_id, element, dimension, severity, rule_statement, n AS \"rows\", v AS violations, CASE WHEN n > 0 THEN round((n - v) / n, 6) WHEN n = 0 THEN 1.0 END AS pass_rate, CASE WHEN n IS NULL THEN 'skipped' WHEN v = 0 THEN 'passed' ELSE 'failed' END AS outcome FROM r"


@query(_REGISTER)
def f16_register(spark, d):
    return register(spark, d)


@query(f"WITH q AS ({_REGISTER}), p AS (SELECT * FROM q WHERE outcome <> 'skipped') SELECT dimension, severity, CAST(GROUPING(dimension, severity) AS INTEGER) AS level, count(*) AS checks, count(*) FILTER (outcome = 'passed') AS passed, count(*) FILTER (outcome = 'failed') AS failed FROM p GROUP BY ROLLUP (dimension, severity)")
def f17_scorecard(spark, d):
    r = register(spark, d).filter("outcome <> 'skipped'").withColumn("passed", F.col("outcome") == "passed")
    return C.scorecard(r)


# ------------------------------------------------------------------------------------ streaming
def _stream(spark, df, name: str):
    """Write ``df`` as files and read them as a stream, a file at a time."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 4).parquet(f"{path}/in"), f"{path}/out", f"{path}/checkpoint"


@query("SELECT 'r' || o_custkey AS run_id, CAST(max(o_orderkey % 50) + 50 AS INTEGER) AS total, CAST(max(o_orderkey % 50) AS INTEGER) AS completed, arg_max(o_orderpriority, o_orderkey) AS label, arg_max(o_orderstatus, o_orderkey) AS status FROM (SELECT *, max(o_orderkey % 50) OVER (PARTITION BY o_custkey) AS x FROM orders) GROUP BY o_custkey")
def j1_run_progress(spark, d):
    """Progress events made from orders, folded from a stream."""
    o = table(spark, d, "orders")
    most = o.groupBy("o_custkey").agg((F.max(F.col("o_orderkey") % 50) + 50).cast("int").alias("total"))
    e = o.join(most, "o_custkey").select(F.col("o_orderkey").alias("seq"), F.concat(F.lit("r"), "o_custkey").alias("run_id"), F.lit("model").alias("type"), F.lit("m").alias("model_id"), F.col("o_orderpriority").alias("label"), F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 50).cast("int").alias("completed"), "total")
    s, out, checkpoint = _stream(spark, e, "progress")
    J.run_available(J.run_progress(s), out, checkpoint, "complete")
    return spark.read.parquet(out)


@query("SELECT doc_id, sha256(regexp_replace(text, '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}\\b', '[REDACTED:email]', 'g')) AS redacted_sha256 FROM (SELECT doc_id, regexp_replace(text, '[^ -~\\n]', 'x', 'g') AS text FROM documents)")
def j2_redacted_stream(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.regexp_replace("text", r"[^ -~\n]", "x").alias("text"))
    s, out, checkpoint = _stream(spark, t, "docs")
    J.run_available(J.redacted_stream(s).select("doc_id", F.sha2("redacted", 256).alias("redacted_sha256")), out, checkpoint)
    return spark.read.parquet(out)


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS events, count(*) FILTER (value IS NULL) AS null_values, max(ts) AS last_ts FROM events GROUP BY 1, 2")
def j3_event_windows(spark, d):
    """The batch form; the tests compare the streamed form with it."""
    return J.event_windows(table(spark, d, "events"))


# ---------------------------------------------------------------------------------------- risk
def _accounts(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s"), F.count("*").alias("n"))
    k = F.col("c_custkey")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey")).select(k.alias("account_id"), (k % 6).cast("int").alias("segment_id"), F.round("s", 2).alias("balance"), (k % 95 / 100.0).alias("utilization"), (550.0 + k % 250).alias("fico_or_rating"), F.round(F.col("s") * 0.8, 2).alias("collateral_value"), (0.045 + k % 8 * 0.004).alias("macro_unemployment"), (-0.025 + k % 9 * 0.006).alias("macro_gdp_shock"), (3 + k % 96).alias("months_on_book"))


_ACC = "acc AS (SELECT c_custkey AS k, round(s, 2) AS balance, (c_custkey % 95) / 100.0 AS u, 550.0 + c_custkey % 250 AS fico, round(s * 0.8, 2) AS coll, 0.045 + c_custkey % 8 * 0.004 AS un, -0.025 + c_custkey % 9 * 0.006 AS gdp, 3 + c_custkey % 96 AS mob FROM customer JOIN (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY 1) ON c_custkey = o_custkey), ft AS (SELECT *, balance / greatest(coll, 1.0) AS ltv, un * 2.5 - gdp AS mp, pow(u, 1.2) AS uf FROM acc), sc AS (SELECT *, greatest(0.0001, least(0.9999, (0.015 + mp * 0.12 + uf * 0.03 + greatest(0.0, (720.0 - fico) / 10000.0)) * 1.35)) AS pd, greatest(0.05, least(0.95, 0.22 + greatest(ltv - 0.75, 0.0) * 0.35 + mp * 0.08)) AS lgd, balance * (1.0 + 0.25 * u * 1.35) AS ead FROM ft)"


@query(f"WITH {_ACC} SELECT k AS account_id, round(ltv, 6) AS ltv, floor(fico / 50.0) * 50.0 AS score_band, round(mp, 6) AS macro_pressure, round(ln(1 + mob) / 5.0, 6) AS seasoning_factor, round(uf, 6) AS utilization_factor, 1.35 AS scenario_factor FROM ft")
def w2_features(spark, d):
    f = W.features(_accounts(spark, d))
    r = lambda c: F.round(c, 6).alias(c)
    return f.select("account_id", r("ltv"), "score_band", r("macro_pressure"), r("seasoning_factor"), r("utilization_factor"), "scenario_factor")


@query(f"WITH {_ACC} SELECT k AS account_id, round(pd, 6) AS pd, round(lgd, 6) AS lgd, round(ead, 2) AS ead, round(pd * lgd * ead, 2) AS expected_loss, round(12.5 * pd * lgd * ead * (1.0 + mp), 2) AS rwa_proxy FROM sc")
def w3_score(spark, d):
    s = W.score(W.features(_accounts(spark, d)))
    return s.select("account_id", *[F.round(c, 6).alias(c) for c in ("pd", "lgd")], *[F.round(c, 2).alias(c) for c in ("ead", "expected_loss", "rwa_proxy")])


@query(f"WITH {_ACC} SELECT CAST(k % 6 AS INTEGER) AS segment_id, count(*) AS record_count, round(sum(ead), 0) AS total_ead, round(sum(pd * ead) / sum(ead), 6) AS weighted_pd, round(sum(lgd * ead) / sum(ead), 6) AS weighted_lgd, round(sum(pd * lgd * ead) / sum(ead), 6) AS loss_rate FROM sc GROUP BY 1")
def w4_aggregate(spark, d):
    a = W.aggregate(W.score(W.features(_accounts(spark, d))), "segment_id")
    return a.select("segment_id", "record_count", F.round("total_ead", 0).alias("total_ead"), *[F.round(c, 6).alias(c) for c in ("weighted_pd", "weighted_lgd", "loss_rate")])


@query(f"WITH {_ACC} SELECT k AS segment_id, 'Loss rate exceeds 100 percent' AS issue FROM sc WHERE false")
def w4_validate(spark, d):
    a = W.aggregate(W.score(W.features(_accounts(spark, d))), "segment_id")
    return W.validate(a, "segment_id")


_HEAVY = f"WITH {_ACC}, z AS (SELECT CAST(k % 6 AS INTEGER) AS segment_id, CASE WHEN k % 6 = 5 THEN -ead ELSE ead END AS ead, pd, lgd, CASE WHEN k % 6 < 2 THEN 1000 * pd * lgd * ead ELSE pd * lgd * ead END AS el FROM sc)"
_HEAVY += ", g AS (SELECT segment_id, sum(ead) AS ead, sum(el) / greatest(sum(ead), 1.0) AS rate FROM z GROUP BY 1)"


@query(_HEAVY + " SELECT segment_id, 'Loss rate exceeds 100 percent' AS issue FROM g WHERE rate > 1 UNION ALL SELECT segment_id, 'EAD must be positive' FROM g WHERE ead <= 0")
def w4_validate_issues(spark, d):
    """Losses of two segments made large and the exposures of one negative."""
    k = F.col("segment_id")
    s = W.score(W.features(_accounts(spark, d)))
    s = s.withColumn("expected_loss", F.when(k < 2, F.col("expected_loss") * 1000).otherwise(F.col("expected_loss"))).withColumn("ead", F.when(k == 5, -F.col("ead")).otherwise(F.col("ead")))
    return W.validate(W.aggregate(s, "segment_id"), "segment_id")


@query("""
WITH i AS (SELECT unnest(range(1, (SELECT count(*) FROM customer) + 1)) AS i)
SELECT 100000 + i AS account_id, CAST(i % 6 AS INTEGER) AS segment_id, 25000.0 + i * 417.25 AS balance, round((i % 95) / 100.0, 6) AS utilization, 550.0 + i % 250 AS fico_or_rating, 18000.0 + i * 250.0 AS collateral_value,
  round(0.045 + i % 8 * 0.004, 6) AS macro_unemployment, round(-0.025 + i % 9 * 0.006, 6) AS macro_gdp_shock, CAST(3 + i % 96 AS INTEGER) AS months_on_book, round(0.035 + i % 10 * 0.002, 6) AS rate
FROM i
""")
def w1_accounts(spark, d):
    """As many accounts as there are customers."""
    a = W.accounts(spark, table(spark, d, "customer").count())
    return a.withColumns({c: F.round(c, 6) for c in ("utilization", "macro_unemployment", "macro_gdp_shock", "rate")})


def _by_time(spark, rows, query_of, name: str, parts: int = 3):
    """A stream over ``rows`` that arrive in ``parts`` goes by time; results of all of them."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    cuts = rows.agg(F.expr(f"percentile_approx(ts, array({', '.join(str(k / parts) for k in range(1, parts))}))")).first()[0]
    for k in range(parts):
        low, high = (cuts[k - 1] if k else None), (cuts[k] if k < parts - 1 else None)
        at = lambda t: F.lit(str(t)).cast(rows.schema["ts"].dataType)
        now = rows if low is None else rows.filter(F.col("ts") >= at(low))
        now = now if high is None else now.filter(F.col("ts") < at(high))
        now.write.mode("append").parquet(f"{path}/in")
        J.run_available(query_of(spark.readStream.schema(rows.schema).parquet(f"{path}/in")), f"{path}/out", f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/out")


@query("""
WITH e AS (SELECT user_id, ts, value, max(ts) OVER () AS top, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS no FROM e)
SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS events, count(*) FILTER (value IS NULL) AS null_values FROM s GROUP BY user_id, no, top HAVING max(ts) + INTERVAL 30 MINUTE <= top - INTERVAL 2 HOUR
""")
def j3_sessions(spark, d):
    """Sessions of users from a stream that arrives in three goes; those that the watermark has not passed stay inside."""
    return _by_time(spark, table(spark, d, "events"), J.sessions, "sessions")


@query("""
WITH e AS (SELECT 'r' || user_id AS run_id, ts, event_type = 'purchase' AS finished, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_type = 'purchase') AS next, max(ts) OVER () AS top FROM events)
SELECT run_id, ts AS last_ts FROM e WHERE NOT finished AND CASE WHEN next IS NULL THEN ts + INTERVAL 6 HOUR < top - INTERVAL 2 HOUR ELSE next - ts > INTERVAL 6 HOUR END
""")
def j1_stalled_runs(spark, d):
    """Users as runs that are finished by a purchase: each silence of more than six hours, told by timers of a stream."""
    e = table(spark, d, "events").select(F.concat(F.lit("r"), "user_id").alias("run_id"), "ts", (F.col("event_type") == "purchase").alias("finished"))
    return _by_time(spark, e, lambda s: J.stalled_runs(s, 6 * 3600), "stalled")


@query("""
WITH w AS (SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS h, event_type, value, ts, max(ts) OVER () AS top FROM events)
SELECT make_timestamp(h * 3600000000) AS window_start, event_type, count(*) AS events, count(*) FILTER (value IS NULL) AS null_values, max(ts) AS last_ts FROM w GROUP BY h, event_type, top HAVING make_timestamp((h + 1) * 3600000000) <= top - INTERVAL 2 HOUR
""")
def j3_event_windows_late(spark, d):
    """Streamed in append mode: windows come out once the watermark has passed them. Copies of all events a month
    late arrive after the watermark and are dropped; what is behind it stays in the state."""
    e = table(spark, d, "events")
    path = f"{shared_dir(spark)}/windows-{uuid.uuid4().hex}"
    late = e.withColumn("ts", F.col("ts") - F.expr("interval 30 days"))
    for rows in (e, late):  # the second run goes on from the first one's checkpoint
        rows.write.mode("append").parquet(f"{path}/in")
        J.run_available(J.event_windows(spark.readStream.schema(e.schema).parquet(f"{path}/in")), f"{path}/out", f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/out")


@query("SELECT c_custkey * 10 + 1 AS seq, CAST(c_custkey AS VARCHAR) AS target, 'role' AS field, 'Output' AS new FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 = 1")
def h7_override_log(spark, d):
    """Overrides of three runs appended in two writes, those of one run read back."""
    from tidemark.operators import store as H

    path = f"{shared_dir(spark)}/overrides-{uuid.uuid4().hex}"
    c = table(spark, d, "customer").select(F.concat(F.lit("r"), (F.col("c_custkey") % 3).cast("string")).alias("run_id"), (F.col("c_custkey") * 10 + 1).alias("seq"), F.col("c_custkey").cast("string").alias("target"), F.lit("role").alias("field"), F.lit("Output").alias("new"))
    H.log_overrides(c.filter("seq % 20 = 1 and target % 4 = 0"), path)
    H.log_overrides(c.filter("seq % 20 = 1 and target % 4 = 2"), path)
    return H.read_overrides(spark, path, "r1").select("seq", "target", "field", "new")


def _relations(spark, d):
    """A cross-system rule with its comparison, one without, and a proposed relation between two tables."""
    catalog = {t: table(spark, d, t) for t in ("orders", "lineitem")}
    uses = spark.createDataFrame([("orders.o_orderkey", "cross_system_join", "", "m1", 0), ("lineitem.l_orderkey", "cross_system_join", "", "m1", 1)], "element string, usage_kind string, evidence string, model_id string, ord int")
    said = "Ships after the order"
    proposals = spark.createDataFrame([("lineitem.l_shipdate", "Consistency", said, "High", "", ["orders.o_orderdate"], 0)], "element string, dimension string, rule_statement string, severity string, rationale string, related_elements array<string>, ord int")
    params = {
        "orders.o_orderkey": {"cross_system": ("lineitem", "l_orderkey", "o_totalprice", "l_extendedprice", 50_000)}, "lineitem.l_orderkey": {"references": ("orders", "o_orderkey")},
        "lineitem.l_shipdate": {"relations": {said: ("orders", "l_orderkey", "o_orderkey", "l_shipdate >= o_orderdate")}},
    }
    return run_register(catalog, uses, params, proposals)


@query("""
WITH a AS (SELECT o_orderkey AS k, sum(o_totalprice) AS x FROM orders GROUP BY 1), b AS (SELECT l_orderkey AS k, sum(l_extendedprice) AS y FROM lineitem GROUP BY 1)
SELECT 'orders.o_orderkey' AS element, 'Cross-system consistency' AS rule_statement, count(*) AS "rows", count(*) FILTER (a.k IS NULL OR b.k IS NULL OR abs(x - y) > 50000) AS violations, CASE WHEN count(*) FILTER (a.k IS NULL OR b.k IS NULL OR abs(x - y) > 50000) = 0 THEN 'passed' ELSE 'failed' END AS outcome FROM a FULL JOIN b ON a.k = b.k
UNION ALL SELECT 'lineitem.l_orderkey', 'Cross-system consistency', NULL, NULL, 'skipped'
UNION ALL SELECT 'lineitem.l_shipdate', 'Ships after the order', count(*), count(*) FILTER (NOT (l_shipdate >= o_orderdate)), CASE WHEN count(*) FILTER (NOT (l_shipdate >= o_orderdate)) = 0 THEN 'passed' ELSE 'failed' END FROM lineitem JOIN orders ON l_orderkey = o_orderkey
""")
def f16_register_relations(spark, d):
    r = _relations(spark, d)
    return r.filter(F.col("rule_statement").isin("Cross-system consistency", "Ships after the order")).select("element", "rule_statement", "rows", "violations", "outcome")
