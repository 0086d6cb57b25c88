"""Stored-table operations: version-gated upserts, queues, joins of cases and codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldwork.functions.text import version_key
from fieldwork.sources.store import written

# The order of a case queue by status.
STATUS_ORDER = ("new", "assigned", "in_progress", "callback", "refused", "completed")


def upsert_surveys(stored: DataFrame, incoming: DataFrame, key: str, version: str) -> DataFrame:
    """Incoming rows replace stored ones of the same key unless their version is lower."""
    both = stored.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)))
    columns = [c for c in both.columns if c not in (key, "__new")]
    best = F.max_by(F.struct(*columns), F.struct(version_key(F.col(version)).alias("v"), "__new"))
    return both.groupBy(key).agg(best.alias("__r")).select(key, "__r.*").select(*stored.columns)


def surveys_with_counts(surveys: DataFrame, responses: DataFrame, key: str, updated: str) -> DataFrame:
    """Surveys with their number of responses, 0 if there are none, newest first."""
    counts = responses.groupBy(key).agg(F.count("*").alias("responses"))
    return surveys.join(counts, key, "left").withColumn("responses", F.coalesce("responses", F.lit(0))).orderBy(F.col(updated).desc())


def case_of_code(cases: DataFrame, codes: DataFrame, code: str) -> DataFrame:
    """The case of an access code, which is trimmed and capitalised first."""
    return codes.where(F.col("code") == code.strip().upper()).join(cases, "case_id")


def with_place(rows: DataFrame, order: list[Column | str], place: str = "place") -> DataFrame:
    """Adds each row's place, from 1, in an order over all rows, which must be a total one.

    Rows are dealt by ranges of the order and numbered within their range, behind as
    many as the ranges before hold: no task sees more than a range. The ranges are
    written, so both passes see the same.
    """
    keys = [f"__o{i}" for i in range(len(order))]
    named = rows.withColumns({k: F.col(c) if isinstance(c, str) else c for k, c in zip(keys, order, strict=True)})
    ranged = written(named.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()), "placed")
    counts = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    here = F.row_number().over(Window.partitionBy("__part").orderBy(*keys))
    return ranged.join(F.broadcast(before), "__part").withColumn(place, F.col("__before") + here).drop("__part", "__before", *keys)


def case_queue(cases: DataFrame, status: str, order: list[str]) -> DataFrame:
    """Cases with their ``place`` in the queue: by status in its order, unknown ones last, then by ``order``."""
    rank = F.array_position(F.array(*map(F.lit, STATUS_ORDER)), F.col(status))
    return with_place(cases, [F.when(rank > 0, rank).otherwise(len(STATUS_ORDER) + 1), *order])


def pages_of(items: DataFrame, order: str, breaks: Column) -> DataFrame:
    """Adds ``page``, from 1: a break starts a page; what stands before the first is one too.

    For the items of one instrument, which are few.
    """
    w = Window.partitionBy("instrument").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    started = F.sum(breaks.cast("int")).over(w)
    first = F.first(breaks).over(Window.partitionBy("instrument").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return items.withColumn("page", started + F.when(first, 0).otherwise(1))
