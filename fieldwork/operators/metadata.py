"""Field registry and metadata checks of single answers.

The registry is small metadata of the instrument; it becomes literal expressions, so a
check is a projection over the answers without join or shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    name: str
    kind: str  # numeric, text, code, lookup, boolean, datetime, markAll, gridRow
    low: float | None = None
    high: float | None = None
    decimals: int | None = None
    longest: int | None = None
    pattern: str | None = None
    codes: tuple[str, ...] = ()


# The codes of a mark-all answer.
MARK_ALL = ("1", "2", "6", "7", "9")

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_TIMES = ("yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSSX", "yyyy/MM/dd")


def _issue(f: Field, check: str, severity: str, suspicion: float, when: Column) -> Column:
    return F.when(when, F.struct(F.lit(f"{check}:{f.name}").alias("check_id"), F.lit(severity).alias("severity"), F.lit(suspicion).alias("suspicion")))


def issues(f: Field, text: Column) -> list[Column]:
    """Issue structs (null if fine) of one field's answer, given as text."""
    num = F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double"))
    if f.kind == "numeric":
        out = [_issue(f, "type", "fatal", 1.0, num.isNull())]
        beyond = F.lit(False)
        if f.low is not None:
            beyond = beyond | (num < f.low)
        if f.high is not None:
            beyond = beyond | (num > f.high)
        out.append(_issue(f, "range", "fatal", 1.0, beyond))
        if f.decimals is not None:
            scale = 10.0**f.decimals
            out.append(_issue(f, "precision", "query", 0.5, F.floor(num * scale + 0.5) / scale != num))
        return out
    if f.kind == "text":
        out = []
        if f.longest is not None:
            out.append(_issue(f, "range", "query", 0.5, F.length(text) > f.longest))
        if f.pattern is not None:
            out.append(_issue(f, "pattern", "query", 0.5, ~text.rlike(f.pattern)))
        return out
    if f.kind in ("code", "gridRow", "markAll"):
        return [_issue(f, "code", "fatal", 1.0, ~text.isin(*(f.codes or MARK_ALL)))]
    if f.kind == "lookup":
        return [_issue(f, "code", "query", 0.4, ~text.isin(*f.codes))]
    if f.kind == "boolean":
        return [_issue(f, "type", "fatal", 1.0, ~text.isin("true", "false"))]
    if f.kind == "datetime":
        parsed = F.coalesce(*(F.try_to_timestamp(text, F.lit(p)) for p in _TIMES))
        return [_issue(f, "type", "fatal", 1.0, parsed.isNull())]
    return []


def checked(answers: DataFrame, fields: list[Field], *, response: str = "response_id", name: str = "base_name", value: str = "value") -> DataFrame:
    """Flags of long answers (response, base name, text); blanks never reach a check."""
    text = F.col(value)
    known = F.lit(False)
    found = F.array().cast("array<struct<check_id:string,severity:string,suspicion:double>>")
    for f in fields:
        mine = F.col(name) == f.name
        known = known | mine
        of = issues(f, text)
        if of:
            found = F.when(mine, F.array(*of)).otherwise(found)
    orphan = F.array(F.struct(F.lit("orphan").alias("check_id"), F.lit("query").alias("severity"), F.lit(0.3).alias("suspicion")))
    all_ = F.filter(F.when(known, found).otherwise(orphan), lambda x: x.isNotNull())
    rows = answers.where(text.isNotNull() & (text != "")).select(F.col(response), F.col(name), text.alias("observed"), F.explode(all_).alias("i"))
    return rows.select(response, name, "observed", "i.*")


def long_answers(wide: DataFrame, response: str, columns: list[str]) -> DataFrame:
    """One row an answer: response, base_name, value as text."""
    texts = wide.select(response, *(F.col(c).cast("string").alias(c) for c in columns))
    return texts.unpivot(response, columns, "base_name", "value")
