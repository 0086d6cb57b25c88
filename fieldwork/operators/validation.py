"""One validation run: every check's flags, scored, without accepted values, with the run's summary."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldwork.functions import expr as E
from fieldwork.operators import confront as K
from fieldwork.operators import flags as S
from fieldwork.operators import instrument as I
from fieldwork.operators import metadata as M


@dataclass(frozen=True)
class Confrontation:
    """A reference table: each mapping of a response's column to one of its own is compared."""

    name: str
    reference: DataFrame
    key: str
    ref_key: str
    order: str
    mappings: dict[str, str]
    pct: float | None = None
    absolute: float | None = None


@dataclass(frozen=True)
class Run:
    """What a run checks; what is empty is left out, and ``kinds`` can leave out more."""

    response: str
    respondent: str
    fields: tuple[M.Field, ...] = ()
    form: I.Instrument | None = None
    rules: dict[str, tuple[str, str]] = field(default_factory=dict)
    numeric: tuple[str, ...] = ()
    confrontations: tuple[Confrontation, ...] = ()
    #: Answers that make two responses the same, if all are; none: not checked.
    compared: tuple[str, ...] = ()
    #: Whether a response is complete, as a condition; only complete ones can be second ones or too quick.
    completed: str = "true"
    duration: str | None = None
    speed_floor: float = S.SPEED_FLOOR_MS
    #: Batteries of questions by name: alike answers to all are suspicious, from three on.
    batteries: dict[str, tuple[str, ...]] = field(default_factory=dict)
    kinds: tuple[str, ...] = S.CHECK_KINDS
    threshold: float = S.Z_THRESHOLD
    least: int = S.LEAST_OBSERVATIONS


def observations(responses: DataFrame, run: Run) -> DataFrame:
    """(response, respondent, variable, value): the numeric answers, long."""
    cells = [F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value")) for c in run.numeric]
    return responses.select(F.col(run.response).alias("response"), F.col(run.respondent).alias("respondent"), F.explode(F.array(*cells)).alias("c")).select("response", "respondent", "c.*")


def skipped(responses: DataFrame, run: Run) -> DataFrame:
    """(check_id, reason): outlier checks that have too few observations, and the speed check if no duration is known."""
    none = responses.limit(0).select(F.lit("").alias("check_id"), F.lit("").alias("reason"))
    if run.numeric:
        counts = responses.agg(*(F.count(c).alias(c) for c in run.numeric))
        long = counts.unpivot([], list(run.numeric), "variable", "n").where(F.col("n") < run.least)
        found = long.select(F.concat(F.lit("mad:"), "variable").alias("check_id"), F.concat(F.col("n").cast("string"), F.lit(f" of {run.least} observations")).alias("reason"))
    else:
        found = none
    if not run.duration:
        return found
    timed = responses.where(F.expr(run.completed)).agg(F.count(run.duration).alias("n")).where("n = 0")
    return found.unionByName(timed.select(F.lit("speeder").alias("check_id"), F.lit("no complete response with a duration").alias("reason")))


#: The column that names a response and its respondent within the checks.
_WHO = "__who"


def _statistical(responses: DataFrame, run: Run) -> list[DataFrame]:
    """Outliers, copies, second responses of a respondent, too quick ones, and batteries answered alike."""
    who = {"response": F.col(run.response), "respondent": F.col(run.respondent)}
    none, no = F.lit(None).cast("double"), F.lit(None).cast("string")
    complete, out = F.expr(run.completed), []

    def add(df: DataFrame, check: Column, suspicion: Column, variable: Column = no, observed: Column = none, by: dict[str, Column] = who) -> None:
        out.append(S.flag(df, **by, variable=variable, kind="statistical", check_id=check, severity="query", observed=observed, suspicion=suspicion))

    if run.numeric:
        found = S.mad_scores(observations(responses, run), "variable", "value", least=run.least).where(F.abs("z") > run.threshold)
        add(found, F.concat(F.lit("mad:"), "variable"), S.mad_suspicion(F.col("z"), run.threshold), F.col("variable"), F.col("value"), {"response": F.col("response"), "respondent": F.col("respondent")})
    if run.compared:
        add(S.exact_duplicates(responses, F.to_json(F.struct(*run.compared))), F.lit("duplicate-exact"), F.lit(0.7))
    add(S.repeated_respondents(responses, run.respondent, complete), F.lit("duplicate-respondent"), F.lit(0.7))
    if run.duration:
        timed = responses.where(complete).withColumn("__took", F.col(run.duration).cast("double"))
        add(S.speeders(timed, "__took", floor=run.speed_floor), F.lit("speeder"), F.lit(0.7), observed=F.col("__took"))
    for name, columns in run.batteries.items():
        if len(columns) < 3:
            continue
        texts = [F.col(c).cast("string") for c in columns]
        alike = reduce(lambda a, b: a & b, (t == texts[0] for t in texts[1:]))
        add(responses.where(alike), F.lit(f"straight-line:{name}"), F.lit(0.6), F.lit(name), F.col(columns[0]).try_cast("double"))
    return out


def flags_of(responses: DataFrame, run: Run) -> DataFrame:
    """The flags of all kinds of checks, in the common shape."""
    who = {"response": F.col(run.response), "respondent": F.col(run.respondent)}
    # who answered goes along with each check's own key, so nothing is joined back, and equal ids stay apart
    keyed = responses.withColumn(_WHO, F.struct(*(c.cast("string").alias(n) for n, c in who.items())))
    none, no = F.lit(None).cast("double"), F.lit(None).cast("string")

    def shaped(df: DataFrame, kind: str, variable, check) -> DataFrame:
        cells = (F.col(f"{_WHO}.response"), F.col(f"{_WHO}.respondent"), variable, F.lit(kind), check, F.col("severity"), none, F.col("suspicion").cast("double"))
        return df.select(*(c.alias(n) for c, n in zip(cells, S.FLAG, strict=True)))

    out = []
    if run.fields and "metadata" in run.kinds:
        answers = M.long_answers(keyed, _WHO, [f.name for f in run.fields])
        out.append(shaped(M.checked(answers, list(run.fields), response=_WHO), "metadata", F.col("base_name"), F.col("check_id")))
    if run.form is not None and "edit" in run.kinds:
        out.append(shaped(I.fired_edits(keyed, run.form, _WHO), "edit", no, F.col("edit_id")))
    if run.rules and "rule" in run.kinds:
        env = E.environment(responses)
        hits = [F.when(E.compile_condition(source, env), F.struct(F.lit(name).alias("check_id"), F.lit(sev).alias("severity"), F.lit(1.0 if sev == "fatal" else 0.6).alias("suspicion"))) for name, (source, sev) in run.rules.items()]
        fired = keyed.select(_WHO, F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("r")).select(_WHO, "r.*")
        out.append(shaped(fired, "rule", no, F.col("check_id")))
    if "statistical" in run.kinds:
        out += _statistical(responses, run)
    for c in run.confrontations if "confrontation" in run.kinds else ():
        last = K.last_per_key(c.reference, c.ref_key, c.order, sorted(set(c.mappings.values())))
        both = responses.join(last.select(F.col(c.ref_key).alias("__k"), *(F.col(x).cast("double").alias(f"__{x}") for x in set(c.mappings.values()))), F.col(c.key) == F.col("__k"), "left")
        lost = both.where(F.col("__k").isNull())
        out.append(S.flag(lost, **who, variable=no, kind="confrontation", check_id=F.lit(f"confront-unmatched:{c.name}"), severity="query", observed=none, suspicion=F.lit(0.4)))
        for mine, theirs in c.mappings.items():
            a, b = F.col(mine).cast("double"), F.col(f"__{theirs}")
            off = both.where(a.isNotNull() & b.isNotNull() & ~K.within(a, b, pct=c.pct, absolute=c.absolute))
            out.append(S.flag(off, **who, variable=F.lit(mine), kind="confrontation", check_id=F.lit(f"confront:{c.name}:{mine}"), severity="query", observed=a, suspicion=K.mismatch_suspicion(a, b)))
    empty = responses.limit(0).select(*(F.lit(None).cast("double" if n in ("observed", "suspicion") else "string").alias(n) for n in S.FLAG))
    return reduce(DataFrame.unionByName, out, empty)


def validate(responses: DataFrame, run: Run, accepted: DataFrame | None = None) -> dict[str, DataFrame]:
    """``flags`` (scored, ranked, without accepted values), ``summary`` by kind, ``skipped`` checks, ``missing`` rates."""
    found = flags_of(responses, run)
    if run.numeric:
        found = S.with_impact(found, observations(responses, run), "variable", "value")
    else:
        found = found.withColumns({"impact": F.lit(0.5), "score": F.col("suspicion") * 0.5})
    if accepted is not None:
        found = S.unsuppressed(found, accepted)
    columns = [c for c in responses.columns if c not in (run.response, run.respondent)]
    return {"flags": S.queue(found), "summary": S.run_summary(found), "skipped": skipped(responses, run), "missing": S.missing_rates(responses, columns)}
