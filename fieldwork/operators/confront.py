"""Confrontation with reference data, corrections and redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REDACTED = "[REDACTED]"


def within(survey: Column, reference: Column, *, pct: float | None = None, absolute: float | None = None) -> Column:
    """Either tolerance passes; exact if there is none; a percentage needs a reference."""
    tests = []
    if pct is not None:
        tests.append((reference != 0) & (F.abs(survey - reference) / F.abs(reference) * 100 <= pct))
    if absolute is not None:
        tests.append(F.abs(survey - reference) <= absolute)
    if not tests:
        return survey == reference
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def mismatch_suspicion(survey: Column, reference: Column) -> Column:
    return F.least(F.lit(1.0), 0.5 + F.abs(survey - reference) / F.when(reference == 0, 1.0).otherwise(F.abs(reference)))


def last_per_key(reference: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """One row a key, the last by ``order``; an aggregate, so a hot key is no window."""
    return reference.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("__r")).select(key, "__r.*")


def confront(survey: DataFrame, reference: DataFrame, *, key: str, ref_key: str, value: str, ref_value: str, order: str | None = None, pct: float | None = None, absolute: float | None = None) -> DataFrame:
    """Every survey row with its reference value, whether it matches, and a suspicion.

    Of several reference rows of a key the last by ``order`` counts (without one, the largest value).
    """
    r = last_per_key(reference, ref_key, order or ref_value, [ref_value]).select(F.col(ref_key).alias("__key"), F.col(ref_value).alias("reference"))
    both = survey.join(r, F.col(key) == F.col("__key"), "left").drop("__key")
    s = F.col(value)
    ok = F.when(F.col("reference").isNull(), None).otherwise(within(s, F.col("reference"), pct=pct, absolute=absolute))
    return both.withColumn("matches", ok).withColumn("suspicion", F.when(F.col("reference").isNull(), 0.4).when(~F.col("matches"), mismatch_suspicion(s, F.col("reference"))))


def unmatched(left: DataFrame, right: DataFrame, key: str, other: str) -> DataFrame:
    """Rows of left without a partner; blank keys take no part."""
    return left.where(F.col(key).isNotNull()).join(right.select(F.col(other).alias("__o")), F.col(key) == F.col("__o"), "left_anti")


def latest(corrections: DataFrame, cell: list[str], decided: str, ordinal: str, value: str) -> DataFrame:
    """The latest correction of each cell; of equal times the first seen."""
    newest = F.max_by(F.col(value), F.struct(F.col(decided), -F.col(ordinal)))
    return corrections.groupBy(*cell).agg(newest.alias("value"))


def overlay(raw: DataFrame, corrections: DataFrame, cell: list[str], value: str) -> DataFrame:
    """Raw cells with corrections laid over; corrected cells may be new."""
    c = corrections.withColumnRenamed("value", "__new")
    both = raw.join(c, cell, "full_outer")
    return both.withColumn("corrected", F.col("__new").isNotNull()).withColumn(value, F.coalesce("__new", value)).drop("__new")


def redacted(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.lit(REDACTED)) for c in columns})


def base_name(instance_key: Column) -> Column:
    """The name before the first @ of an answer key."""
    return F.substring_index(instance_key, "@", 1)


def rank_in_timeline(df: DataFrame, entity: str, order: list[str], representation: str) -> DataFrame:
    """Adds ``changed``: the representation differs from the one before it."""
    w = Window.partitionBy(entity).orderBy(*order)
    before = F.lag(representation).over(w)
    return df.withColumn("changed", before.isNotNull() & ~before.eqNullSafe(F.col(representation)))
