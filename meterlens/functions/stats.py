"""Null-safe arithmetic, guarded correlation and exact distributed quantiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def missing_if_nan(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator, NULL unless the denominator is positive."""
    return F.when(denominator > 0, numerator / denominator)


def relative_change(value: Column, base: Column) -> Column:
    return F.when(base > 0, (value - base) / base)


def guarded_corr(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate; NULL below two pairs or when a side is constant.

    ``corr`` raises on a constant side under ANSI mode, so the coefficient is built from the
    sample moments of the rows where both sides are present.
    """
    left, right = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    varies = (F.min(left) < F.max(left)) & (F.min(right) < F.max(right))
    return F.when(
        varies,
        F.try_divide(F.covar_samp(left, right), F.stddev_samp(left) * F.stddev_samp(right)),
    )


def _magnitude_slice(value: Column) -> Column:
    """Order-preserving bucket number: 256 buckets for every doubling of the magnitude."""
    magnitude = F.floor(F.log2(F.abs(value)) * 256) + 1_000_000
    return F.when(value > 0, magnitude).when(value < 0, -magnitude).otherwise(F.lit(0))


def exact_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """Linearly interpolated quantiles of whole columns: one row per (column, probability).

    Equal values are counted first. Counts per magnitude slice locate the slices that hold a
    wanted rank, and only the values of those slices are ranked, so no task holds a whole column.
    """
    counted = (
        df.select(*columns)
        .unpivot([], list(columns), "column", "value")
        .where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count("*").alias("copies"))
        .withColumn("slice", _magnitude_slice(F.col("value")))
    )
    by_slice = W.partitionBy("column").orderBy("slice")
    wanted = (
        counted.groupBy("column", "slice")
        .agg(F.sum("copies").alias("in_slice"))
        .withColumn("before", F.sum("in_slice").over(by_slice) - F.col("in_slice"))
        .withColumn("total", F.sum("in_slice").over(W.partitionBy("column")))
        .withColumn("probability", F.explode(F.array(*[F.lit(float(p)) for p in probabilities])))
        .withColumn("target", F.col("probability") * (F.col("total") - 1))
        .where(
            (F.ceil("target") >= F.col("before"))
            & (F.floor("target") < F.col("before") + F.col("in_slice"))
        )
        .drop("in_slice", "total")
    )
    needed = counted.join(wanted.select("column", "slice").distinct(), ["column", "slice"], "left_semi")
    within = W.partitionBy("column", "slice").orderBy("value")
    ranked = needed.withColumn("upto", F.sum("copies").over(within)).join(wanted, ["column", "slice"])
    last = F.col("before") + F.col("upto") - 1
    first = last - F.col("copies") + 1

    def value_at(rank: Column) -> Column:
        return F.max(F.when((first <= rank) & (rank <= last), F.col("value")))

    return (
        ranked.groupBy("column", "probability")
        .agg(
            value_at(F.floor("target")).alias("low"),
            value_at(F.ceil("target")).alias("high"),
            F.max(F.col("target") - F.floor("target")).alias("weight"),
        )
        .select(
            "column",
            "probability",
            (F.col("low") + (F.col("high") - F.col("low")) * F.col("weight")).alias("quantile"),
        )
    )
