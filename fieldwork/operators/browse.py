"""Browse filters, rollups, usage counts and numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def filters(*, equal: dict[str, object] | None = None, between: dict[str, tuple] | None = None, flags: dict[str, bool | None] | None = None) -> Column:
    """A conjunction of those filters that are set; None is no filter, and a null year fails a range."""
    out = F.lit(True)
    for c, v in (equal or {}).items():
        out = out if v is None else out & (F.col(c) == v)
    for c, (low, high) in (between or {}).items():
        out = out if low is None else out & (F.col(c) >= low)
        out = out if high is None else out & (F.col(c) <= high)
    for c, v in (flags or {}).items():
        out = out if v is None else out & (F.col(c) == v)
    return out


def with_subject(df: DataFrame, subjects: DataFrame, key: str, subject: str) -> DataFrame:
    """Rows whose survey has the subject; a semi-join, so nothing is doubled."""
    return df.join(subjects.where(F.col("subject") == subject).select(key), key, "left_semi")


def document_browse(df: DataFrame, *, title: str, q: str | None, order: list[Column], limit: int = 50, offset: int = 0) -> DataFrame:
    """Documents whose title holds q (% and _ are wild, as given), in order, a page."""
    hits = df.where(F.ilike(F.col(title), F.lit(f"%{q}%"))) if q and q.strip() else df
    return hits.orderBy(*order).offset(max(0, offset)).limit(max(1, min(200, limit)))


def document_of(df: DataFrame, bundle: str | None, path: str) -> DataFrame:
    """The document of a path; without a bundle the path alone decides."""
    hit = F.col("path") == path
    return df.where(hit & (F.col("bundle") == bundle) if bundle else hit).limit(1)


def rollups(df: DataFrame, columns: list[str]) -> DataFrame:
    """(dimension, key, n) of each column, and all rows, in one pass by grouping sets."""
    sets = df.groupingSets([[], *([F.col(c)] for c in columns)], *(F.col(c) for c in columns))
    dimension, key = F.lit("all"), F.lit("all")
    for c in columns:
        mine = F.grouping(c) == 0
        dimension = F.when(mine, c).otherwise(dimension)
        key = F.when(mine, F.coalesce(F.col(c).cast("string"), F.lit("unknown"))).otherwise(key)
    return sets.agg(dimension.alias("dimension"), key.alias("key"), F.count("*").alias("n")).select("dimension", "key", "n")


def usage(components: DataFrame, uses: DataFrame, key: str, used: str) -> DataFrame:
    """Components with the number of uses, 0 if there is none."""
    counts = uses.groupBy(F.col(used).alias(key)).agg(F.count("*").alias("uses"))
    return components.join(counts, key, "left").withColumn("uses", F.coalesce("uses", F.lit(0)))


def numbered(df: DataFrame, group: str, order: list[str], like: Column) -> DataFrame:
    """Adds ``number``: 1, 2, ... over the question-like rows of a group; null for others."""
    n = F.count_if(like).over(Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("number", F.when(like, n))


def event_timelines(events: DataFrame, respondent: str, ts: str, kind: str) -> DataFrame:
    """Each respondent's events in order, as one list; rows without respondent are left out."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(ts).alias("ts"), F.col(kind).alias("kind"))))
    return events.where(F.col(respondent).isNotNull()).groupBy(respondent).agg(listed.alias("events"))
