"""Variable cascade, timelines and corpus statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldwork.functions import text as X


def most_frequent(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Each group's most frequent value; ties go to the smallest; blanks do not count."""
    counts = df.where(F.col(value).isNotNull() & (F.trim(F.col(value)) != "")).groupBy(*group, value).agg(F.count("*").alias("__n"))
    # largest count first, then smallest value: a max over counts and a min over its values
    top = counts.groupBy(*group).agg(F.max("__n").alias("__top"))
    on = [counts[g].eqNullSafe(top[g]) for g in group] + [counts["__n"] == top["__top"]]
    return counts.join(top, on, "left_semi").groupBy(*group).agg(F.min(value).alias(value), F.first("__n").alias("n"))


def cascade(rows: DataFrame, *, meaning: Column, universe: Column, representation: Column, survey: str, year: str) -> dict[str, DataFrame]:
    """Concepts, conceptual variables, represented variables and memberships.

    Rows without a meaning are left out (unplaced). One scan, one shuffle for each level.
    """
    keyed = rows.select("*", X.normalize_key(meaning).alias("concept"), F.coalesce(X.normalize_key(universe), F.lit("")).alias("universe_key"), F.coalesce(representation, F.lit("none")).alias("representation")).where(F.col("concept") != "")
    spans = [F.count("*").alias("occurrences"), F.countDistinct(survey).alias("surveys"), F.countDistinct(year).alias("years"), F.min(year).alias("first_year"), F.max(year).alias("last_year")]
    return {
        "concepts": keyed.groupBy("concept").agg(*spans, F.countDistinct("universe_key").alias("variables")),
        "conceptual": keyed.groupBy("concept", "universe_key").agg(*spans, F.countDistinct("representation").alias("representations")),
        "represented": keyed.groupBy("concept", "universe_key", "representation").agg(*spans),
        "members": keyed,
    }


def corpus_stats(df: DataFrame, *, survey: str, year: str, flags: dict[str, Column]) -> DataFrame:
    return df.agg(F.count("*").alias("records"), F.countDistinct(survey).alias("surveys"), F.min(year).alias("first_year"), F.max(year).alias("last_year"), *(F.count_if(c).alias(n) for n, c in flags.items()))


def subject_facet(subjects: DataFrame, records: DataFrame, *, key: str, subject: str, confirmed: Column) -> DataFrame:
    """Records, surveys and confirmed surveys a subject; subjects without records stay."""
    both = subjects.join(records, key, "left")
    return both.groupBy(subject).agg(F.count("record").alias("records"), F.countDistinct(key).alias("surveys"), F.countDistinct(F.when(confirmed, F.col(key))).alias("confirmed"))
