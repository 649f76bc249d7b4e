"""Statistics of a table that are kept by day: sketches that merge, so bounds over all days come without reading days
again that are known."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DateType, DoubleType, LongType, StringType, StructField, StructType, TimestampType

from tidemark.functions import published

#: Size parameter of the quantile sketches: a rank is off by about 1.7 / this for nearly all quantiles.
SKETCH_K = 400
_TYPES = {"day": DateType(), "name": StringType(), "n": LongType(), "nulls": LongType(), "low": DoubleType(), "high": DoubleType(), "last": TimestampType(), "values": BinaryType(), "ids": BinaryType()}
_SCHEMA = StructType([StructField(name, kind) for name, kind in _TYPES.items()])


def keep_days(df: DataFrame, ts_col: str, value_cols: list[str], path: str) -> None:
    """Add the days of ``df`` that ``path`` does not have: per day and column the rows, nulls, extremes, newest time, a quantile
    sketch and a distinct-count sketch. Days that it has are filtered away before anything else is read of them; a
    day that gets more rows later must be dropped by its owner first. Rows without a time belong to no day."""
    spark = df.sparkSession
    have = {r[0] for r in published.read(spark, path, _SCHEMA).select("day").distinct().collect()}  # a date a day
    day = F.to_date(ts_col)
    new = df.filter(day.isNotNull() & ~day.isin(*have) if have else day.isNotNull())
    one = [F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in value_cols]
    rows = new.select(day.alias("day"), F.col(ts_col).cast("timestamp").alias("ts"), F.explode(F.array(*one)).alias("c")).select("day", "ts", "c.name", "c.v")
    by = rows.groupBy("day", "name").agg(
        F.count("*").alias("n"), F.count_if(F.col("v").isNull()).alias("nulls"), F.min("v").alias("low"), F.max("v").alias("high"), F.max("ts").alias("last"),
        F.kll_sketch_agg_double("v", F.lit(SKETCH_K)).alias("values"), F.hll_sketch_agg(F.xxhash64("v")).alias("ids"),
    )
    published.append(by, path)


def learned_bounds(spark: SparkSession, path: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """(name, days, n, nulls, min, max, last, low, high, n_distinct) over all kept days: counts and extremes are exact, ``low``
    and ``high`` are quantiles within the sketch's error of rank, ``n_distinct`` within about 3 percent."""
    kept = published.read(spark, path, _SCHEMA)
    newest = kept.groupBy("day", "name").agg(F.max_by(F.struct("n", "nulls", "low", "high", "last", "values", "ids"), "__at").alias("s")).select("day", "name", "s.*")
    by = newest.groupBy("name").agg(
        F.count("*").alias("days"), F.sum("n").alias("n"), F.sum("nulls").alias("nulls"), F.min("low").alias("min"), F.max("high").alias("max"), F.max("last").alias("last"),
        F.kll_merge_agg_double("values").alias("values"), F.hll_sketch_estimate(F.hll_union_agg("ids")).alias("n_distinct"),
    )
    at = lambda q: F.when(F.col("n") > F.col("nulls"), F.kll_sketch_get_quantile_double("values", F.lit(q)))
    return by.select("name", "days", "n", "nulls", "min", "max", "last", at(low).alias("low"), at(high).alias("high"), "n_distinct")
