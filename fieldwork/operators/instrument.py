"""Questionnaires as trees, unrolled to columns: routing, computations, edits, rosters.

The tree is metadata and is walked once on the driver. Conditions are compiled with
the computations that stand before them folded in, so a response costs one projection;
only rosters multiply rows, by exploding their iterations.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldwork.functions import expr as E

#: Iterations of a roster at most; a limit of the questionnaire language.
MOST_ITERATIONS = 50


@dataclass(frozen=True)
class Question:
    name: str
    text: str = ""
    required: bool = False
    visible_when: str | None = None


@dataclass(frozen=True)
class Edit:
    id: str
    when: str
    severity: str = "hard"  # hard or soft


@dataclass(frozen=True)
class Computation:
    variable: str
    expression: str


@dataclass(frozen=True)
class IfThenElse:
    condition: str
    then: tuple = ()
    otherwise: tuple = ()


@dataclass(frozen=True)
class Roster:
    name: str
    count_variable: str
    children: tuple = ()


@dataclass(frozen=True)
class Instrument:
    id: str
    nodes: tuple
    edits: tuple[Edit, ...] = ()
    derived: dict[str, str] = field(default_factory=dict)


def _derived(instrument: Instrument, env: dict[str, E.Cell]) -> dict[str, E.Cell]:
    """Derived variables in the order of their use; a name met again inside itself is null."""
    out = dict(env)
    busy: set[str] = set()

    def resolve(name: str) -> None:
        if name in out or name not in instrument.derived or name in busy:
            return
        busy.add(name)
        for other in sorted(E.variables(instrument.derived[name])):
            resolve(other)
        busy.discard(name)
        try:
            out[name] = E.lower(E.parse(instrument.derived[name]), out)
        except E.ExpressionError:
            out[name] = E.of_null()

    for name in instrument.derived:
        resolve(name)
    return out


@dataclass
class Item:
    """A question of a response: its place, whether it shows, and its answer."""

    question: Question
    no: int
    shown: Column
    answer: E.Cell
    roster: str | None = None


def unrolled(instrument: Instrument, env: dict[str, E.Cell]) -> tuple[list[Item], dict[str, E.Cell]]:
    """Items in document order and the environment after all computations.

    A malformed condition shows what it guards; a computation that does not parse is
    skipped. Items of a roster carry its name and are repeated by ``items``.
    """
    env = _derived(instrument, env)
    items: list[Item] = []

    def walk(nodes: tuple, shown: Column, roster: str | None) -> None:
        for n in nodes:
            if isinstance(n, Question):
                items.append(Item(n, len(items) + 1, shown & E.visible(n.visible_when, env), env.get(n.name) or E.of_null(), roster))
            elif isinstance(n, IfThenElse):
                taken = E.visible(n.condition, env)
                walk(n.then, shown & taken, roster)
                walk(n.otherwise, shown & ~taken, roster)
            elif isinstance(n, Computation):
                try:
                    env[n.variable] = E.lower(E.parse(n.expression), env)
                except E.ExpressionError:
                    continue
            elif isinstance(n, Roster):
                walk(n.children, shown, n.name)

    walk(instrument.nodes, F.lit(True), None)
    return items, env


def _rosters(nodes: tuple) -> Iterator[Roster]:
    for n in nodes:
        if isinstance(n, Roster):
            yield n
        for part in ("then", "otherwise", "children"):
            yield from _rosters(getattr(n, part, ()))


def items(responses: DataFrame, instrument: Instrument, key: str) -> DataFrame:
    """(key, no, iteration, name, text, answered): the shown questions of every response.

    Roster questions come once an iteration: floor(count), at most MOST_ITERATIONS.
    """
    env = E.environment(responses)
    listed, env = unrolled(instrument, env)
    times = {r.name: F.greatest(F.lit(0), F.least(F.lit(MOST_ITERATIONS), F.floor(F.coalesce((env.get(r.count_variable) or E.of_null()).num, F.lit(0.0))).cast("int"))) for r in _rosters(instrument.nodes)}
    structs = [
        F.when(i.shown, F.struct(F.lit(i.no).alias("no"), F.lit(i.question.name).alias("name"), E.piped(i.question.text, env).alias("text"), (~i.answer.blank).alias("answered"), (times[i.roster] if i.roster else F.lit(-1)).alias("times")))
        for i in listed
    ]
    rows = responses.select(key, F.explode(F.filter(F.array(*structs), lambda x: x.isNotNull())).alias("i"))
    once = F.when(F.col("i.times") < 0, F.array(F.lit(0))).when(F.col("i.times") > 0, F.sequence(F.lit(1), F.col("i.times")))
    return rows.select(key, "i.*", F.explode(once).alias("iteration")).drop("times")


def fired_edits(responses: DataFrame, instrument: Instrument, key: str) -> DataFrame:
    """(key, edit_id, severity, suspicion): required questions first, then edits.

    Hard edits are fatal, soft ones queries; a malformed edit is left out.
    """
    listed, env = unrolled(instrument, E.environment(responses))
    found = []

    def add(edit_id: str, severity: str, when: Column) -> None:
        hard = severity == "hard"
        found.append(F.when(when, F.struct(F.lit(edit_id).alias("edit_id"), F.lit("fatal" if hard else "query").alias("severity"), F.lit(1.0 if hard else 0.6).alias("suspicion"))))

    for i in listed:
        if i.question.required:
            add(f"required:{i.question.name}", "hard", i.shown & i.answer.blank)
    for e in instrument.edits:
        try:
            add(e.id, e.severity, E.compile_condition(e.when, env))
        except E.ExpressionError:
            continue
    return responses.select(key, F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("e")).select(key, "e.*")
