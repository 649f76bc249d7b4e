"""A lineage state derived from the star schema, for the registered queries: each customer and each nation
is a model whose references come from its orders; sizes follow the tables'."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import ids
from tidemark.functions.scratch import written
from tidemark.operators import lineage as L


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model_id, label, language, source_files, ord): one per customer, then one per nation."""
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("label"), F.concat("c_name", F.lit(".sas")).alias("file"), F.col("c_custkey").alias("ord"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("nation "), "n_name").alias("label"), F.concat("n_name", F.lit(".py")).alias("file"), (F.col("n_nationkey") + 1_000_000_000).cast("long").alias("ord"))
    both = c.unionByName(n)
    return both.select(
        ids.model_id("label", F.array("file")).alias("model_id"), "label", F.when(F.col("file").endswith(".sas"), "SAS").otherwise("Python").alias("language"), F.array("file").alias("source_files"), "ord",
        F.when(F.col("ord") % 10 == 3, "").otherwise(F.concat(F.lit("reviews "), "label")).alias("purpose"), F.when(F.col("ord") % 7 == 0, "Partial").otherwise("Analyzed").alias("status"),
        F.when(F.col("ord") % 7 == 0, "Low").otherwise("High").alias("confidence"), (F.col("ord") % 1000 + 450).alias("tokens_in"), (F.col("ord") % 100).alias("tokens_out"), F.lit(0.25).alias("est_cost"),
    )


def _customer_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    j = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.select(ids.model_id("c_name", F.array(F.concat("c_name", F.lit(".sas")))).alias("model_id"), "c_custkey", F.concat(F.lit("Rep."), "c_mktsegment", F.lit("_"), "n_name").alias("out_name"), "n_name", "n_regionkey", "c_mktsegment")


def _customer_reads(spark: SparkSession, sf_dir: str, cm: DataFrame) -> DataFrame:
    """The customers' models, once for each order priority of their orders."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority").distinct()
    return cm.join(o, F.col("c_custkey") == F.col("o_custkey")).drop("o_custkey")


Base = tuple[DataFrame, DataFrame]


def base(spark: SparkSession, sf_dir: str) -> Base:
    """The customers' models and their reads, written once for queries that derive several relations from them."""
    cm = written(_customer_models(spark, sf_dir), "customer-models")
    return cm, written(_customer_reads(spark, sf_dir, cm), "customer-reads")


def _based(spark: SparkSession, sf_dir: str, of: Base | None) -> Base:
    cm = _customer_models(spark, sf_dir) if of is None else of[0]
    return cm, _customer_reads(spark, sf_dir, cm) if of is None else of[1]


def extracted(spark: SparkSession, sf_dir: str, of: Base | None = None) -> DataFrame:
    """(model_id, direction, name, columns, ord): customers read a table per order priority and write one
    per segment and nation; nations read those and write one per region. ``of``: ``base``, where written."""
    cm, reads = _based(spark, sf_dir, of)
    reads = reads.select("model_id", F.lit("input").alias("direction"), F.concat(F.lit("Ord."), "o_orderpriority").alias("name"), F.array(F.lit("order_id"), F.lit("o_totalprice")).alias("columns"), (F.col("c_custkey") * 10).alias("ord"))
    writes = cm.select("model_id", F.lit("output").alias("direction"), F.col("out_name").alias("name"), F.array(F.lit("total"), F.lit("as_of_date")).alias("columns"), (F.col("c_custkey") * 10 + 1).alias("ord"))
    r = table(spark, sf_dir, "region")
    nm = cm.select("n_name", "n_regionkey", "out_name").distinct().join(r, F.col("n_regionkey") == F.col("r_regionkey")).withColumn("model_id", ids.model_id(F.concat(F.lit("nation "), "n_name"), F.array(F.concat("n_name", F.lit(".py")))))
    far = F.lit(10_000_000_000)
    n_reads = nm.select("model_id", F.lit("input").alias("direction"), F.col("out_name").alias("name"), F.array(F.lit("total")).alias("columns"), far.alias("ord"))
    n_writes = nm.select("model_id", F.lit("output").alias("direction"), F.concat(F.lit("Sum."), "r_name").alias("name"), F.array(F.lit("region_key"), F.lit("total")).alias("columns"), (far + 1).alias("ord")).distinct()
    return reads.unionByName(writes).unionByName(n_reads).unionByName(n_writes)


def scanned(spark: SparkSession, sf_dir: str, of: Base | None = None) -> DataFrame:
    """Scanned references: the extracted outputs in capitals (known), and a log table per segment (new)."""
    cm, _ = _based(spark, sf_dir, of)
    known = cm.select("model_id", F.lit("output").alias("direction"), F.upper("out_name").alias("name"), (F.col("c_custkey") * 10 + 2).alias("ord"))
    new = cm.select("model_id", F.lit("input").alias("direction"), F.concat(F.lit("log_"), "c_mktsegment").alias("name"), (F.col("c_custkey") * 10 + 3).alias("ord"))
    return known.unionByName(new)


def lineage_rows(spark: SparkSession, sf_dir: str, of: Base | None = None) -> DataFrame:
    """(model_id, source_element, target_element, transformation_type, ord) for customers whose key is even;
    the other models have none, so their edges come from references."""
    _, reads = _based(spark, sf_dir, of)
    return reads.filter("c_custkey % 2 = 0").select("model_id", F.concat(F.lit("ord."), F.lower("o_orderpriority"), F.lit(".o_totalprice")).alias("source_element"), F.concat(F.lower("out_name"), F.lit(".total")).alias("target_element"), F.lit("aggregate").alias("transformation_type"), F.col("c_custkey").alias("ord"))


def calculations(spark: SparkSession, sf_dir: str, of: Base | None = None) -> DataFrame:
    cm = _based(spark, sf_dir, of)[0].filter("c_custkey % 4 = 0")
    one = cm.select("model_id", F.concat(F.lower("out_name"), F.lit(".total")).alias("target"), F.lit("sum(o_totalprice)").alias("expression"), F.lit(1).alias("ord"))
    return one.unionByName(one.withColumn("expression", F.lit("sum(o_totalprice) * 1.0")).withColumn("ord", F.lit(2)))


def usages(spark: SparkSession, sf_dir: str, of: Base | None = None) -> DataFrame:
    """(element, usage_kind, evidence, model_id, ord): each customer's model joins on its order tables' key
    and divides by its output."""
    cm, reads = _based(spark, sf_dir, of)
    a = reads.select(F.concat(F.lit("ord."), F.lower("o_orderpriority"), F.lit(".order_id")).alias("element"), F.lit("join_key").alias("usage_kind"), F.lit("by order_id").alias("evidence"), "model_id", F.col("c_custkey").alias("ord"))
    b = cm.select(F.concat(F.lower("out_name"), F.lit(".as_of_date")).alias("element"), F.lit("date_parse").alias("usage_kind"), F.concat(F.lit("datepart("), F.col("c_custkey").cast("string"), F.lit(")")).alias("evidence"), "model_id", F.col("c_custkey").alias("ord"))
    c = cm.select(F.concat(F.lower("out_name"), F.lit(".total")).alias("element"), F.lit("denominator").alias("usage_kind"), F.lit("/ total").alias("evidence"), "model_id", F.col("c_custkey").alias("ord"))
    return a.unionByName(b).unionByName(c)


def refs(spark: SparkSession, sf_dir: str, of: Base | None = None) -> DataFrame:
    """Written once, since tables, columns and edges all read it."""
    if of is None:
        cm = written(_customer_models(spark, sf_dir), "customer-models")
        of = cm, _customer_reads(spark, sf_dir, cm)
    return written(L.reference_set(extracted(spark, sf_dir, of), scanned(spark, sf_dir, of)), "refs")


def state(spark: SparkSession, sf_dir: str, run_id: str = "r1") -> dict[str, DataFrame]:
    """The assembled state with the columns that reports and exports read."""
    of = base(spark, sf_dir)
    calcs = calculations(spark, sf_dir, of)
    s = L.assemble(models(spark, sf_dir), extracted(spark, sf_dir, of), scanned(spark, sf_dir, of), lineage_rows(spark, sf_dir, of), calcs, usages(spark, sf_dir, of))
    none = F.lit(None).cast("string")
    s["tables"] = s["tables"].withColumns({"grain": none, "confidence": F.when(F.col("source") == "E", "High").otherwise("Low"), "review_status": F.lit("Proposed")})
    s["columns"] = s["columns"].withColumns({"inferred_type": none, "role": F.lit("Measure"), "used_in": F.array().cast("array<string>")})
    s["table_edges"] = s["table_edges"].withColumns({"notes": F.lit(""), "confidence": F.when(F.col("source") == "E", "High").otherwise("Low"), "review_status": F.lit("Proposed")})
    s["column_edges"] = s["column_edges"].withColumns({"join_keys": F.array().cast("array<string>"), "source": F.lit("E"), "confidence": F.lit("High"), "review_status": F.lit("Proposed")})
    s["calculations"] = calcs
    spark_ = spark
    s["runs"] = spark_.createDataFrame([(run_id, "2024-01-01T00:00:00Z", "1.0", "none", "none", 0, 0.0, "local")], "run_id string, timestamp string, tool_version string, llm_provider string, llm_model string, tokens long, est_cost double, security_mode string")
    s["issues"] = s["models"].filter("status = 'Partial'").select("model_id", F.lit("error").alias("severity"), F.concat(F.lit("part of "), "label", F.lit(" failed")).alias("message"))
    return s


# The same relations in SQL, for the oracles.
MID = "('m_' || substr(sha1(lower({label}) || '␟' || lower({file})), 1, 12))"
TID = "('t_' || substr(sha1({n}), 1, 12))"
CTE = f"""
cm AS (SELECT {MID.format(label="c_name", file="c_name || '.sas'")} AS model_id, c_custkey, c_mktsegment, lower('Rep.' || c_mktsegment || '_' || n_name) AS out_name, n_name, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey),
op AS (SELECT DISTINCT o_custkey, lower('Ord.' || o_orderpriority) AS in_name FROM orders),
nm AS (SELECT DISTINCT {MID.format(label="'nation ' || n_name", file="n_name || '.py'")} AS model_id, out_name, lower('Sum.' || r_name) AS sum_name FROM cm JOIN region ON n_regionkey = r_regionkey),
refs AS (
  SELECT model_id, 'input' AS direction, in_name AS canon, c_custkey * 10 AS ord, 'E' AS source FROM cm JOIN op ON c_custkey = o_custkey
  UNION ALL SELECT model_id, 'output', out_name, c_custkey * 10 + 1, 'E' FROM cm
  UNION ALL SELECT DISTINCT model_id, 'input', out_name, 10000000000, 'E' FROM nm
  UNION ALL SELECT DISTINCT model_id, 'output', sum_name, 10000000001, 'E' FROM nm
  UNION ALL SELECT model_id, 'input', lower('log_' || c_mktsegment), c_custkey * 10 + 3, 'H' FROM cm),
tabs AS (
  SELECT {TID.format(n="canon")} AS table_id, canon AS name,
    CASE WHEN bool_or(direction = 'output') AND bool_or(direction = 'input') THEN 'Intermediate' WHEN bool_or(direction = 'output') THEN 'Output' ELSE 'Source' END AS role,
    CASE WHEN contains(canon, '.') THEN split_part(canon, '.', 1) END AS source_system, min_by(source, ord) AS source,
    count(DISTINCT CASE WHEN direction = 'output' THEN model_id END) AS n_produced, count(DISTINCT CASE WHEN direction = 'input' THEN model_id END) AS n_consumed
  FROM refs GROUP BY canon),
cols AS (
  SELECT DISTINCT {TID.format(n="canon")} AS table_id, canon AS tname, unnest(CASE WHEN canon LIKE 'ord.%' THEN ['order_id', 'o_totalprice'] WHEN canon LIKE 'rep.%' THEN ['total', 'as_of_date'] WHEN canon LIKE 'sum.%' THEN ['region_key', 'total'] END) AS name
  FROM refs WHERE canon NOT LIKE 'log_%'),
lin AS (SELECT model_id, c_custkey, in_name || '.o_totalprice' AS s, out_name || '.total' AS t, in_name, out_name FROM cm JOIN op ON c_custkey = o_custkey WHERE c_custkey % 2 = 0),
pairs AS (
  SELECT DISTINCT model_id, in_name AS a, out_name AS b, 'E' AS source FROM lin
  UNION ALL SELECT DISTINCT i.model_id, i.canon, o.canon, 'H' FROM refs i JOIN refs o ON i.model_id = o.model_id AND i.direction = 'input' AND o.direction = 'output' WHERE i.model_id NOT IN (SELECT model_id FROM lin)),
edges0 AS (SELECT DISTINCT model_id, {TID.format(n="a")} AS source_table_id, {TID.format(n="b")} AS target_table_id, source FROM pairs WHERE a <> b),
edges AS (SELECT 'te_' || substr(sha1(source_table_id || '␟' || target_table_id || '␟' || model_id || '␟derive'), 1, 12) AS edge_id, * FROM edges0),
cedges AS (SELECT 'ce_' || substr(sha1(s || '␟' || t || '␟' || model_id || '␟aggregate'), 1, 12) AS edge_id, s AS source_element, t AS target_element, model_id, 'aggregate' AS transformation_type, CASE WHEN c_custkey % 4 = 0 THEN 'sum(o_totalprice) * 1.0' END AS expression FROM lin),
uses AS (
  SELECT in_name || '.order_id' AS element, 'join_key' AS usage_kind, 'by order_id' AS evidence, model_id, c_custkey AS ord FROM cm JOIN op ON c_custkey = o_custkey
  UNION ALL SELECT out_name || '.as_of_date', 'date_parse', 'datepart(' || c_custkey || ')', model_id, c_custkey FROM cm
  UNION ALL SELECT out_name || '.total', 'denominator', '/ total', model_id, c_custkey FROM cm)
"""
