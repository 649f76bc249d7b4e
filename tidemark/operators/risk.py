"""Portfolio risk workload: accounts, features, scores and weighted aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def accounts(spark: SparkSession, n: int, by_account: bool = False) -> DataFrame:
    """``n`` synthetic accounts; cyclic fields follow the row number, or (``by_account``) the account id."""
    i = F.col("id") + 1
    m = lambda k: ((F.lit(100_000) + i) if by_account else i) % k
    return spark.range(n).select(
        (100_000 + i).alias("account_id"), m(6).cast("int").alias("segment_id"), (25_000.0 + i * 417.25).alias("balance"), (m(95) / 100.0).alias("utilization"), (550.0 + m(250)).alias("fico_or_rating"),
        (18_000.0 + i * 250.0).alias("collateral_value"), (0.045 + m(8) * 0.004).alias("macro_unemployment"), (-0.025 + m(9) * 0.006).alias("macro_gdp_shock"), (3 + m(96)).cast("int").alias("months_on_book"), (0.035 + m(10) * 0.002).alias("rate"),
    )


def features(df: DataFrame, stress: float = 1.35, scenario: str = "severely_adverse") -> DataFrame:
    """Loan to value, score band, macro pressure, seasoning, utilisation and scenario factors."""
    return df.withColumns({
        "ltv": F.col("balance") / F.greatest("collateral_value", F.lit(1.0)),
        "score_band": F.floor(F.col("fico_or_rating") / 50.0) * 50.0,
        "macro_pressure": F.col("macro_unemployment") * 2.5 - F.col("macro_gdp_shock"),
        "seasoning_factor": F.log1p("months_on_book") / 5.0,
        "utilization_factor": F.pow("utilization", F.lit(1.2)),
        "scenario_factor": F.lit(1.0 if scenario.lower() == "base" else stress),
    })


def _clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def score(df: DataFrame, floor: float = 0.0001, cap: float = 0.9999) -> DataFrame:
    """Probability and size of loss, exposure, expected loss and a capital proxy."""
    base = 0.015 + F.col("macro_pressure") * 0.12 + F.col("utilization_factor") * 0.03
    adjust = F.greatest(F.lit(0.0), (720.0 - F.col("fico_or_rating")) / 10_000.0)
    out = df.withColumn("pd", _clamp((base + adjust) * F.col("scenario_factor"), floor, cap))
    out = out.withColumn("lgd", _clamp(0.22 + F.greatest(F.col("ltv") - 0.75, F.lit(0.0)) * 0.35 + F.col("macro_pressure") * 0.08, 0.05, 0.95))
    out = out.withColumn("ead", F.col("balance") * (1.0 + 0.25 * F.col("utilization") * F.col("scenario_factor")))
    out = out.withColumn("expected_loss", F.col("pd") * F.col("lgd") * F.col("ead"))
    return out.withColumn("rwa_proxy", 12.5 * F.col("expected_loss") * (1.0 + F.col("macro_pressure")))


def aggregate(scored: DataFrame, *keys: str) -> DataFrame:
    """Exposure-weighted figures per ``keys``."""
    ead = F.sum("ead")
    weight = F.when(ead != 0, ead).otherwise(1.0)
    return scored.groupBy(*keys).agg(
        F.count("*").alias("record_count"), ead.alias("total_ead"), F.sum("expected_loss").alias("total_expected_loss"), (F.sum(F.col("pd") * F.col("ead")) / weight).alias("weighted_pd"),
        (F.sum(F.col("lgd") * F.col("ead")) / weight).alias("weighted_lgd"), (F.sum("expected_loss") / F.greatest(ead, F.lit(1.0))).alias("loss_rate"),
    )


def validate(summary: DataFrame, *keys: str) -> DataFrame:
    """A row per failed expectation of each summary row: (keys, issue)."""
    tests = F.array(
        F.when(F.col("weighted_pd") <= 0, "PD must be positive"), F.when(F.col("weighted_lgd") <= 0, "LGD must be positive"),
        F.when(F.col("total_ead") <= 0, "EAD must be positive"), F.when(F.col("loss_rate") > 1, "Loss rate exceeds 100 percent"),
    )
    return summary.select(*keys, F.explode(F.filter(tests, lambda t: t.isNotNull())).alias("issue"))
