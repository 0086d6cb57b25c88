"""Statistical checks, scoring, suppression and the run summary.

All checks return flags of one shape (FLAG), so they can be united, scored together
and ranked. A check never collects: thresholds come from exact aggregates that are
joined back, and joins to per-variable rows are small by the number of variables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldwork.sources.store import written

FLAG = ("response_id", "respondent_id", "variable_name", "check_kind", "check_id", "severity", "observed", "suspicion")

# The scale of a median deviation, and the checks' defaults.
MAD_SCALE = 0.6745
Z_THRESHOLD = 3.5
LEAST_OBSERVATIONS = 8
SPEED_FLOOR_MS = 60_000
CHECK_KINDS = ("metadata", "edit", "rule", "statistical", "confrontation")


def flag(df: DataFrame, *, response: Column, respondent: Column, variable: Column, kind: str, check_id: Column, severity: str, observed: Column, suspicion: Column) -> DataFrame:
    cells = (response.cast("string"), respondent.cast("string"), variable, F.lit(kind), check_id, F.lit(severity), observed, suspicion.cast("double"))
    return df.select(*(c.alias(n) for c, n in zip(cells, FLAG, strict=True)))


#: Groups up to which a row for each goes to every task; more are joined by a shuffle.
BROADCAST_GROUPS = 100_000


def medians(df: DataFrame, group: str, value: str, *, least: int = 1) -> DataFrame:
    """(group, median, n): exact medians of groups with ``least`` values or more.

    Ranks are found from counts of distinct values, dealt by ranges of group and value:
    a group of any size lies in many tasks, and only sums of these meet in one.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("__c"))
    ranged = counts.repartitionByRange(group, value).withColumn("__part", F.spark_partition_id())
    held = ranged.groupBy(group, "__part").agg(F.sum("__c").alias("__held"))
    parts = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = held.select(group, "__part", F.coalesce(F.sum("__held").over(parts), F.lit(0)).alias("__base"), F.sum("__held").over(Window.partitionBy(group)).alias("n")).where(F.col("n") >= least)
    upto = F.sum("__c").over(Window.partitionBy(group, "__part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranked = ranged.withColumn("__upto", upto).join(_broadcast_few(base), [group, "__part"]).withColumn("__upto", F.col("__base") + F.col("__upto"))
    at = lambda rank: F.min(F.when((F.col("__upto") >= rank) & (F.col("__upto") - F.col("__c") < rank), F.col(value)))
    low, high = at(F.floor((F.col("n") + 1) / 2)), at(F.floor(F.col("n") / 2) + 1)
    return ranked.groupBy(group).agg(((low + high) / 2).alias("median"), F.max("n").alias("n"))


def _broadcast_few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if len(df.take(BROADCAST_GROUPS + 1)) <= BROADCAST_GROUPS else df


def mad_scores(obs: DataFrame, group: str, value: str, *, least: int = LEAST_OBSERVATIONS) -> DataFrame:
    """``obs`` with ``z``: 0.6745 (x - median) / MAD, by exact medians; MAD 0 gives 0.

    Groups with fewer than ``least`` observations are left out.
    """
    rows = obs.where(F.col(value).isNotNull())
    centre = written(medians(rows, group, value, least=least).select(group, F.col("median").alias("centre")), "centres")
    away = rows.join(_broadcast_few(centre), group).withColumn("away", F.abs(F.col(value) - F.col("centre")))
    spread = written(medians(away, group, "away").select(group, F.col("median").alias("mad")), "spreads")
    z = F.when(F.col("mad") > 0, MAD_SCALE * (F.col(value) - F.col("centre")) / F.col("mad")).otherwise(0.0)
    return away.join(_broadcast_few(spread), group).withColumn("z", z).drop("away")


def mad_suspicion(z: Column, threshold: float = Z_THRESHOLD) -> Column:
    return F.least(F.lit(1.0), 0.5 + (F.abs(z) - threshold) / (2 * threshold))


def mad_outliers(obs: DataFrame, *, response: str, respondent: str, group: str, value: str, threshold: float = Z_THRESHOLD) -> DataFrame:
    found = mad_scores(obs, group, value).where(F.abs("z") > threshold)
    return flag(found, response=F.col(response), respondent=F.col(respondent), variable=F.col(group), kind="statistical", check_id=F.concat(F.lit("mad:"), F.col(group)), severity="query", observed=F.col(value), suspicion=mad_suspicion(F.col("z"), threshold))


def exact_duplicates(df: DataFrame, key: Column) -> DataFrame:
    """``df`` with ``others``: how many other rows have the same key; rows alone are left out.

    Keys are grouped by 128 bits of two hashes, so long keys are not shuffled. They are
    counted apart and joined back, so one very common key is no single window.
    """
    keyed = df.withColumns({"__key": F.xxhash64(key), "__also": F.xxhash64(F.lit("also"), key)})
    many = keyed.groupBy("__key", "__also").agg((F.count("*") - 1).alias("others")).where("others > 0")
    return keyed.join(many, ["__key", "__also"]).drop("__key", "__also")


def repeated_respondents(df: DataFrame, respondent: str, completed: Column) -> DataFrame:
    """Completed rows of respondents with two or more, with ``others``."""
    done = df.where(completed & F.col(respondent).isNotNull())
    many = done.groupBy(respondent).agg((F.count("*") - 1).alias("others")).where("others > 0")
    return done.join(many, respondent)


def speed_threshold(df: DataFrame, duration: str, *, floor: float, least: int = 10) -> DataFrame:
    """One row: the larger of the floor and, from ``least`` durations on, sorted[floor(n / 20)].

    The wanted rank is found by counts of distinct durations, not by a global sort of rows.
    """
    counts = df.where(F.col(duration).isNotNull()).groupBy(duration).agg(F.count("*").alias("c"))
    total = counts.agg(F.sum("c").alias("n"))
    ranged = counts.repartitionByRange(duration).withColumn("__part", F.spark_partition_id())
    parts = ranged.groupBy("__part").agg(F.sum("c").alias("held"))
    before = parts.withColumn("base", F.coalesce(F.sum("held").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("held")
    upto = F.sum("c").over(Window.partitionBy("__part").orderBy(duration))
    ranked = ranged.join(F.broadcast(before), "__part").withColumn("upto", F.col("base") + upto)
    picked = ranked.join(F.broadcast(total)).where(F.col("upto") > F.floor(F.col("n") * 0.05)).agg(F.min(duration).alias("p5"), F.max("n").alias("n"))
    return picked.select(F.when(F.col("n") >= least, F.greatest(F.lit(float(floor)), "p5")).otherwise(F.lit(float(floor))).alias("threshold"))


def speeders(df: DataFrame, duration: str, *, floor: float = SPEED_FLOOR_MS, least: int = 10) -> DataFrame:
    """Rows strictly below the threshold."""
    limit = speed_threshold(df, duration, floor=floor, least=least)
    return df.join(F.broadcast(limit)).where(F.col(duration) < F.col("threshold"))


def straight_lines(df: DataFrame, group: str, answer: str, *, least: int = 3) -> DataFrame:
    """Groups with ``least`` answers or more, all given and all the same."""
    g = df.groupBy(group).agg(F.count("*").alias("n"), F.count(answer).alias("given"), F.min(answer).alias("low"), F.max(answer).alias("high"))
    return g.where((F.col("n") >= least) & (F.col("given") == F.col("n")) & (F.col("low") == F.col("high"))).select(group, "n", F.col("low").alias("answer"))


def missing_rates(df: DataFrame, columns: list[str], *, rate: float = 0.5) -> DataFrame:
    """variable, blank, total, rate of the columns that are blank at that rate or more."""
    blank = lambda c: F.col(c).isNull() | (F.col(c).cast("string") == "")
    counts = df.agg(F.count("*").alias("total"), *(F.count_if(blank(c)).alias(c) for c in columns))
    long = counts.unpivot("total", columns, "variable", "blank").where("total > 0")
    return long.withColumn("rate", F.col("blank") / F.col("total")).where(F.col("rate") >= rate).select("variable", "blank", "total", "rate")


def with_impact(flags: DataFrame, observations: DataFrame, group: str, value: str) -> DataFrame:
    """Adds impact: |observed| over the variable's sum of |value|; 0.5 without one; and score."""
    totals = observations.groupBy(F.col(group).alias("variable_name")).agg(F.sum(F.abs(value)).alias("__total"))
    joined = flags.join(totals, "variable_name", "left")
    impact = F.when((F.col("__total") > 0) & F.col("observed").isNotNull(), F.abs("observed") / F.col("__total")).otherwise(0.5)
    return joined.withColumn("impact", impact).withColumn("score", F.col("suspicion") * F.col("impact")).drop("__total")


def unsuppressed(flags: DataFrame, accepted: DataFrame, on: tuple[str, ...] = ("response_id", "check_id", "variable_name", "observed")) -> DataFrame:
    """Flags whose value was not accepted; nulls match nulls."""
    a = accepted.select(*(F.col(c).alias(f"__{c}") for c in on))
    return flags.join(a, reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in on)), "left_anti")


def queue(flags: DataFrame) -> DataFrame:
    """Ranked by score, ties by response, check and variable."""
    return flags.orderBy(F.col("score").desc(), "response_id", "check_id", "variable_name")


def run_summary(flags: DataFrame) -> DataFrame:
    """Counts by kind and severity; every kind is present."""
    kinds = flags.sparkSession.createDataFrame([(k,) for k in CHECK_KINDS], "check_kind string")
    counts = flags.groupBy("check_kind").agg(F.count_if(F.col("severity") == "fatal").alias("fatal"), F.count_if(F.col("severity") == "query").alias("query"), F.count("*").alias("total"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return kinds.join(counts, "check_kind", "left").select("check_kind", zero("fatal"), zero("query"), zero("total"))
