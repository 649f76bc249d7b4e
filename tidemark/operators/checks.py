"""Data-quality checks executed on tables.

A check gives one row ``(check, element, dimension, severity, rows, violations, pass_rate, passed)``.
Checks on single rows are aggregate expressions, so any number of them over one table share one scan
(``run_scalar``); the others are joins or grouped aggregates.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.scratch import written


@dataclass(frozen=True)
class Check:
    """A check by aggregation: ``violations`` is an aggregate expression over the table."""

    name: str
    element: str
    dimension: str
    severity: str
    violations: Column = field(compare=False)
    rows: Column = field(default_factory=lambda: F.count(F.lit(1)), compare=False)


def _report(df: DataFrame, name: str, element: str, dimension: str, severity: str) -> DataFrame:
    rows, bad = F.col("rows").cast("long"), F.coalesce("violations", F.lit(0)).cast("long")
    rate = F.when(rows > 0, F.round((rows - bad) / rows, 6)).otherwise(F.lit(1.0))
    return df.select(F.lit(name).alias("check"), F.lit(element).alias("element"), F.lit(dimension).alias("dimension"), F.lit(severity).alias("severity"), rows.alias("rows"), bad.alias("violations"), rate.alias("pass_rate"), (bad == 0).alias("passed"))


def run_scalar(df: DataFrame, checks: list[Check]) -> DataFrame:
    """All ``checks`` in one pass: one aggregate, then one row per check."""
    one = df.agg(*[e for i, c in enumerate(checks) for e in (c.rows.alias(f"r{i}"), c.violations.alias(f"v{i}"))])
    made = F.array(*[F.struct(F.lit(c.name).alias("check"), F.lit(c.element).alias("element"), F.lit(c.dimension).alias("dimension"), F.lit(c.severity).alias("severity"), F.col(f"r{i}").cast("long").alias("rows"), F.coalesce(F.col(f"v{i}"), F.lit(0)).cast("long").alias("violations")) for i, c in enumerate(checks)])
    out = one.select(F.explode(made).alias("c")).select("c.*")
    rate = F.when(F.col("rows") > 0, F.round((F.col("rows") - F.col("violations")) / F.col("rows"), 6)).otherwise(F.lit(1.0))
    return out.withColumn("pass_rate", rate).withColumn("passed", F.col("violations") == 0)


# --------------------------------------------------------------------- checks on single rows
def non_zero(table: str, col: str) -> Check:
    return Check("denominator", f"{table}.{col}", "Validity", "High", F.count_if(F.col(col).isNull() | (F.col(col) == 0)))


def in_range(table: str, col: str, low, high) -> Check:
    return Check("range", f"{table}.{col}", "Validity", "Medium", F.count_if(~F.col(col).between(low, high)))


def non_null(table: str, col: str) -> Check:
    return Check("completeness", f"{table}.{col}", "Completeness", "Medium", F.count_if(F.col(col).isNull()))


def valid_date(table: str, col: str, low: str, high: str) -> Check:
    """Values that are no date, or outside the bounds; nulls are no violation."""
    d = F.col(col).try_cast("date")
    return Check("date", f"{table}.{col}", "Validity", "Medium", F.count_if(F.col(col).isNotNull() & (d.isNull() | ~d.between(F.lit(low).cast("date"), F.lit(high).cast("date")))))


def castable(table: str, col: str, to: str, value: Column | None = None) -> Check:
    """Values that cannot be cast; nulls are no violation. ``value``: an expression instead of the column."""
    v = F.col(col) if value is None else value
    return Check("type", f"{table}.{col}", "Accuracy", "Medium", F.count_if(v.isNotNull() & v.try_cast(to).isNull()))


def allowed(table: str, col: str, values: list) -> Check:
    return Check("allowed", f"{table}.{col}", "Validity", "Medium", F.count_if(F.col(col).isNotNull() & ~F.col(col).isin(values)))


def output_measure(table: str, col: str) -> Check:
    """Nulls, and one more violation if all values are zero or null."""
    return Check("measure", f"{table}.{col}", "Completeness", "Medium", F.count_if(F.col(col).isNull()) + F.when(F.bool_and(F.coalesce(F.col(col), F.lit(0)) == 0), 1).otherwise(0))


def expression(table: str, name: str, ok: Column, dimension: str = "Consistency", severity: str = "Medium") -> Check:
    """A relation between elements of one row; unknown counts as a violation."""
    return Check(name, table, dimension, severity, F.count_if(~F.coalesce(ok, F.lit(False))))


# ---------------------------------------------------------------------- checks by grouping or joining
def unique(df: DataFrame, table: str, cols: list[str], name: str = "unique") -> DataFrame:
    """Rows beyond the first of each non-null key. Counts are combined before the shuffle, so a frequent
    key costs one row per task."""
    by = df.filter(" and ".join(f"`{c}` is not null" for c in cols)).groupBy(*cols).agg(F.count("*").alias("n"))
    return _report(by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.sum(F.col("n") - 1).alias("violations")), name, f"{table}.{','.join(cols)}", "Uniqueness", "High")


def references(child: DataFrame, child_table: str, child_col: str, parent: DataFrame, parent_col: str) -> DataFrame:
    """Rows with a non-null key that the parent does not have. Keys are counted first: a frequent key is
    looked up once."""
    keys = child.filter(F.col(child_col).isNotNull()).groupBy(F.col(child_col).alias("k")).agg(F.count("*").alias("n"))
    have = parent.select(F.col(parent_col).alias("k")).distinct().withColumn("__in", F.lit(1))
    got = keys.join(have, "k", "left")
    return _report(got.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.sum(F.when(F.col("__in").isNull(), F.col("n")).otherwise(0)).alias("violations")), "references", f"{child_table}.{child_col}", "Consistency", "High")


def grain(df: DataFrame, table: str, dims: list[str], calendar: dict[str, DataFrame] | None = None) -> DataFrame:
    """(dims) combinations that are missing: the product of each dimension's distinct values (or of the
    given one-column ``calendar`` frames) against the actual combinations. Dimensions are small by nature;
    the product is what the check is about."""
    want = None
    for d in dims:
        own = (calendar or {}).get(d, df.select(d)).select(d).filter(F.col(d).isNotNull()).distinct()
        want = own if want is None else want.crossJoin(own)
    return want.join(df.select(*dims).distinct(), dims, "left_anti")


def gaps(df: DataFrame, dims: list[str], day_col: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """(dims, gap_from, gap_to, days): the stretches of days without a row, for each combination of ``dims`` that has any,
    from ``first`` to ``last`` (where not given, the first and last day of all). The work grows with the rows and the
    stretches, not with the calendar: neighbours are compared within range shards, so a combination with very many
    days is no task of its own, and where it spans shards their ends are. Rows without a day are left out."""
    day = F.to_date(day_col).alias("day")
    have = df.select(*dims, day).filter("day is not null").distinct()
    shards = written(have.repartitionByRange(*dims, "day").withColumn("shard", F.spark_partition_id()), "days")
    inner = shards.select(*dims, "day", F.lead("day").over(Window.partitionBy("shard", *dims).orderBy("day")).alias("next")).filter("next is not null")
    ends = written(shards.groupBy(*dims, "shard").agg(F.min("day").alias("low"), F.max("day").alias("high")), "ends")
    between = ends.select(*dims, F.col("high").alias("day"), F.lead("low").over(Window.partitionBy(*dims).orderBy("shard")).alias("next")).filter("next is not null")
    span = ends.agg((F.lit(first).cast("date") if first else F.min("low")).alias("lo"), (F.lit(last).cast("date") if last else F.max("high")).alias("hi"))
    whole = ends.groupBy(*dims).agg(F.min("low").alias("low"), F.max("high").alias("high")).crossJoin(F.broadcast(span))  # the span is one row
    outer = whole.select(*dims, F.explode(F.array(F.struct(F.date_sub("lo", 1).alias("day"), F.col("low").alias("next")), F.struct(F.col("high").alias("day"), F.date_add("hi", 1).alias("next")))).alias("e")).select(*dims, "e.*")
    missing = inner.unionByName(between).unionByName(outer).filter(F.datediff("next", "day") > 1)
    return missing.select(*dims, F.date_add("day", 1).alias("gap_from"), F.date_sub("next", 1).alias("gap_to"), (F.datediff("next", "day") - 1).alias("days"))


def grain_check(df: DataFrame, table: str, dims: list[str], calendar: dict[str, DataFrame] | None = None) -> DataFrame:
    missing = grain(df, table, dims, calendar).agg(F.count("*").alias("violations"))
    actual = df.select(*dims).dropna().distinct().agg(F.count("*").alias("__have"))
    return _report(missing.crossJoin(actual).select((F.col("__have") + F.col("violations")).alias("rows"), "violations"), "grain", f"{table}.{','.join(dims)}", "Completeness", "Medium")


def offending_values(df: DataFrame, col: str, reference: DataFrame, reference_col: str) -> DataFrame:
    """(value, n) of non-null values that the reference list lacks."""
    by = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"))
    return by.join(reference.select(F.col(reference_col).alias("value")).distinct(), "value", "left_anti")


def freshness(df: DataFrame, ts_col: str, as_of: str, max_lag_seconds: int, group: str | None = None) -> DataFrame:
    """(group, last, lag_seconds, passed) of the newest time against ``as_of``."""
    keys = [group] if group else []
    last = df.groupBy(*keys).agg(F.max(ts_col).alias("last"))
    lag = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("last")
    return last.select(*keys, "last", lag.alias("lag_seconds"), F.coalesce(lag <= max_lag_seconds, F.lit(False)).alias("passed"))


def cross_system(left: DataFrame, right: DataFrame, key: str, left_value: str, right_value: str, tolerance: float) -> DataFrame:
    """(key, left_value, right_value, outcome): both sides are one row per key; outcomes are match,
    mismatch, missing_left and missing_right."""
    a = left.select(F.col(key).alias("key"), F.col(left_value).alias("left_value"), F.lit(1).alias("__l"))
    b = right.select(F.col(key).alias("key"), F.col(right_value).alias("right_value"), F.lit(1).alias("__r"))
    both = a.join(b, "key", "full_outer")
    same = F.col("left_value").eqNullSafe(F.col("right_value")) | F.coalesce(F.abs(F.col("left_value") - F.col("right_value")) <= tolerance, F.lit(False))
    outcome = F.when(F.col("__l").isNull(), "missing_left").when(F.col("__r").isNull(), "missing_right").when(same, "match").otherwise("mismatch")
    return both.select("key", "left_value", "right_value", outcome.alias("outcome"))


def completeness_profile(df: DataFrame) -> DataFrame:
    """(column, rows, nulls) for every column, in one scan."""
    one = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)])
    made = F.array(*[F.struct(F.lit(c).alias("column"), F.col("__rows").alias("rows"), F.col(f"n{i}").alias("nulls")) for i, c in enumerate(df.columns)])
    return one.select(F.explode(made).alias("c")).select("c.*")


def learned_range(df: DataFrame, col: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """(low, high) as exact percentiles, interpolated. Values are counted, dealt in ranges and numbered by a
    running sum in each, so no task holds all distinct values; only a count per range meets in one."""
    n = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).cast("double").alias("v")).agg(F.count("*").alias("n"))
    ranged = written(n.repartitionByRange("v").withColumn("r", F.spark_partition_id()), "counts")
    sizes = ranged.groupBy("r").agg(F.sum("n").alias("m"))
    all_before = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    start = sizes.select("r", F.coalesce(F.sum("m").over(all_before), F.lit(0)).alias("s"), F.sum("m").over(Window.partitionBy()).alias("total"))
    end = F.col("s") + F.sum("n").over(Window.partitionBy("r").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    ranks = ranged.join(F.broadcast(start), "r").withColumn("__end", end)

    def at(share: float, whole):
        k = whole(F.lit(share) * (F.col("total") - 1))
        return F.max(F.when((k < F.col("__end")) & (k >= F.col("__end") - F.col("n")), F.col("v")))

    x = lambda share: F.lit(share) * (F.max("total") - 1)
    made = lambda share: at(share, F.floor) + (at(share, F.ceil) - at(share, F.floor)) * (x(share) - F.floor(x(share)))
    return ranks.agg(made(low).alias("low"), made(high).alias("high"))


def scorecard(results: DataFrame) -> DataFrame:
    """(dimension, severity, level, checks, passed, failed) by dimension and severity with subtotals and a
    total; ``level`` is the grouping id (0 detail, 1 dimension, 3 total)."""
    by = results.rollup("dimension", "severity").agg(F.grouping_id().alias("level"), F.count("*").alias("checks"), F.count_if("passed").alias("passed"))
    return by.select("dimension", "severity", F.col("level").cast("int").alias("level"), "checks", "passed", (F.col("checks") - F.col("passed")).alias("failed"))
