"""Dashboard aggregates, pivots and case tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cumulative_by_day(df: DataFrame, ts: str) -> DataFrame:
    """day, n, running: the window runs over one row a day."""
    days = df.where(F.col(ts).isNotNull()).groupBy(F.date_format(ts, "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    return days.withColumn("running", F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))


def kpis(df: DataFrame, *, duration: str, completed: Column) -> DataFrame:
    total = F.count("*")
    return df.agg(total.alias("total"), F.floor(F.avg(duration) + 0.5).cast("long").alias("mean_duration"), F.floor(F.count_if(completed) * 100 / F.nullif(total, F.lit(0)) + 0.5).cast("long").alias("completion_pct"))


def funnel(df: DataFrame, steps: dict[str, Column]) -> DataFrame:
    """step, no, answered, pct of all rows, in the order of the steps."""
    counts = df.agg(F.count("*").alias("__all"), *(F.count_if(c).alias(n) for n, c in steps.items()))
    long = counts.unpivot("__all", list(steps), "step", "answered")
    order = F.array_position(F.array(*map(F.lit, steps)), F.col("step")).cast("int")
    return long.select("step", order.alias("no"), "answered", F.floor(F.col("answered") * 100 / F.nullif(F.col("__all"), F.lit(0)) + 0.5).cast("long").alias("pct"))


def bins(df: DataFrame, group: str, value: str, *, n: int = 10) -> DataFrame:
    """Equal-width bins of each group's values, the last one closed."""
    spans = df.groupBy(group).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    width = F.when(F.col("high") > F.col("low"), (F.col("high") - F.col("low")) / n).otherwise(1.0)
    at = F.least(F.lit(n - 1), F.floor((F.col(value) - F.col("low")) / width))
    return df.where(F.col(value).isNotNull()).join(spans, group).groupBy(group, at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def top_values(df: DataFrame, group: str, value: str, *, k: int = 5) -> DataFrame:
    counts = df.groupBy(group, value).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.col("n").desc(), value))
    return counts.withColumn("place", place).where(F.col("place") <= k)


def pivot_counts(df: DataFrame, rows: str, column: str, values: list[str]) -> DataFrame:
    """Counts by row and column value, missing combinations 0."""
    return df.groupBy(rows).agg(F.count("*").alias("total"), *(F.count_if(F.col(column) == v).alias(v) for v in values))


def table_totals(df: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """Cells with row, column and grand totals; all blank stays null."""
    sets = df.groupingSets([[F.col(row), F.col(column)], [F.col(row)], [F.col(column)], []], F.col(row), F.col(column))
    return sets.agg(F.sum(value).alias("total")).select(F.coalesce(row, F.lit("TOT")).alias(row), F.coalesce(column, F.lit("TOT")).alias(column), "total")
