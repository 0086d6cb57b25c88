"""Test values of answers, and the paths through a questionnaire.

Paths are found breadth first: the frontier holds states, a state is what has been
answered so far. A step finds each state's first shown question without an answer, by
one expression over all questions, and joins it with the values to try; a state without
such a question is a scenario. Scenarios come in the order in which a queue would give
them: by number of answers, then by the place of each answer among its values.

States that agree on all answers that later conditions use go on alike, and of these
only the first ``most`` can be among the first ``most`` scenarios. The frontier is so
bounded by the answers that matter, without a scenario lost.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldwork.functions import expr as E
from fieldwork.operators import instrument as I
from fieldwork.sources.store import written

# The texts and dates that stand for their kinds of answers.
TEXT = "Test response"
VALUES = {
    "boolean": {"routing": ["true", "false"], "boundary": ["true", "false"], "canonical": ["true"]},
    "date": {"routing": ["2024-01-01", "2024-12-31"], "boundary": ["", "2024-01-01", "1900-01-01", "9999-12-31", "not-a-date"], "canonical": ["2024-06-15"]},
    "time": {"routing": ["09:00", "23:59"], "boundary": ["", "00:00", "09:00", "23:59", "24:00", "not-a-time"], "canonical": ["09:00"]},
}
ODD_TEXTS = ("<script>alert(1)</script>", "😀🎉")
MODES = ("routing", "boundary", "canonical")
#: Steps after which the frontier is written, so that plans stay short.
STEPS_PER_PLAN = 6


def _number(x: Column) -> Column:
    """Whole numbers without decimals."""
    return F.when(x == F.floor(x), x.cast("bigint").cast("string")).otherwise(x.cast("string"))


def test_values(domains: DataFrame, mode: str) -> DataFrame:
    """(variable, no, value) for domains (variable, type, codes, low, high, longest).

    Types: code, codes (several at once, joined by commas), numeric, text, and those of
    VALUES; any other has none. ``routing`` has what can change a path, ``boundary`` the
    edges and what lies beyond, ``canonical`` one plain answer. A null value is no answer.
    """
    text = lambda v: F.lit(v).cast("string")
    codes, n, none = F.coalesce("codes", F.array().cast("array<string>")), F.size(F.coalesce("codes", F.array().cast("array<string>"))), F.array(text(None))
    ends = F.when(n > 1, F.array(codes[0], F.element_at(codes, -1))).otherwise(F.slice(codes, 1, 1))
    low, high = F.coalesce("low", F.lit(0.0)), F.coalesce("high", F.lit(100.0))
    middle, longest = F.floor((low + high) / 2 + 0.5), F.coalesce("longest", F.lit(255))
    all_ = F.array_join(codes, ",")
    numbers = {"routing": (low, middle, high), "boundary": (low - 1, low, middle, high, high + 1), "canonical": (middle,)}[mode]
    texts = {"routing": [text(TEXT), text("")], "boundary": [text(""), text("A"), text(TEXT), F.repeat(F.lit("A"), longest), F.repeat(F.lit("A"), longest + 1), *map(text, ODD_TEXTS)], "canonical": [text(TEXT)]}[mode]
    one = {"routing": codes, "boundary": F.concat(none, ends), "canonical": F.slice(codes, 1, 1)}[mode]
    some = {"routing": F.when(n > 1, F.array(text(""), codes[0], all_)).otherwise(F.array(text(""), codes[0])), "boundary": F.array(text(""), F.array_join(F.slice(codes, 1, 1), ","), all_), "canonical": F.slice(codes, 1, 1)}[mode]
    kind = F.col("type")
    values = F.when(kind.isin("code", "codes") & (n == 0), none).when(kind == "code", one).when(kind == "codes", some)
    values = values.when(kind == "numeric", F.transform(F.array(*(x.cast("double") for x in numbers)), _number)).when(kind == "text", F.array(*texts))
    for k, v in VALUES.items():
        values = values.when(kind == k, F.array(*map(text, v[mode])))
    return domains.select("variable", F.posexplode(values).alias("no", "value"))


@dataclass(frozen=True)
class Routing:
    """A questionnaire for path finding: questions in order, which of them steer, and what each later one needs."""

    questions: list[I.Question]
    numeric: frozenset[str]

    @property
    def steering(self) -> set[str]:
        used = set()
        for q in self.questions:
            try:
                used |= E.variables(q.visible_when or "")
            except E.ExpressionError:
                continue
        return used & {q.name for q in self.questions}

    def needed(self, at: int) -> list[str]:
        """The steering variables that questions from this one on look at; all, if a condition looks ahead."""
        names = [q.name for q in self.questions]
        looks = [sorted(set(self._used(q)) & set(names)) for q in self.questions]
        ahead = any(names.index(v) >= i for i, used in enumerate(looks) for v in used)
        return sorted(self.steering) if ahead else sorted({v for used in looks[at:] for v in used})

    @staticmethod
    def _used(q: I.Question) -> set[str]:
        try:
            return E.variables(q.visible_when or "")
        except E.ExpressionError:
            return set()


def _next(routing: Routing) -> Column:
    """The place of a state's first shown question without an answer; null at the end of its path."""
    env = {}
    for q in routing.questions:
        c = F.col(f"v_{q.name}")
        env[q.name] = E.of_column(c.try_cast("double"), "double") if q.name in routing.numeric else E.of_column(c, "string")
    return F.coalesce(*(F.when(~F.col(f"d_{q.name}") & E.visible(q.visible_when, env), F.lit(i)) for i, q in enumerate(routing.questions)))


def _answered(df: DataFrame, routing: Routing) -> DataFrame:
    """States with a question and a value -> with that answer, and the question after it."""
    here = {f"v_{q.name}": F.when(F.col("at") == i, F.col("value")).otherwise(F.col(f"v_{q.name}")) for i, q in enumerate(routing.questions)}
    here |= {f"d_{q.name}": (F.col("at") == i) | F.col(f"d_{q.name}") for i, q in enumerate(routing.questions)}
    step = F.struct(F.element_at(F.array(*(F.lit(q.name) for q in routing.questions)), F.col("at") + 1).alias("variable"), "value")
    moved = df.withColumns({**here, "path": F.concat("path", F.array("no")), "steps": F.concat("steps", F.array(step))})
    return moved.drop("no", "value", "at").withColumn("at", _next(routing))


def _start(spark, routing: Routing) -> DataFrame:
    first = {f"v_{q.name}": F.lit(None).cast("string") for q in routing.questions} | {f"d_{q.name}": F.lit(False) for q in routing.questions}
    return spark.range(1).select(F.array().cast("array<int>").alias("path"), F.array().cast("array<struct<variable:string,value:string>>").alias("steps"), *(c.alias(n) for n, c in first.items())).withColumn("at", _next(routing))


def _tried(values: DataFrame, plain: DataFrame, routing: Routing) -> DataFrame:
    """(at, no, value): all values of questions that steer, a plain one of others; none to try is no answer."""
    places = values.sparkSession.createDataFrame([(q.name, i, q.name in routing.steering) for i, q in enumerate(routing.questions)], "variable string, at int, steers boolean")
    both = values.withColumn("steers", F.lit(True)).unionByName(plain.withColumn("steers", F.lit(False)))
    found = places.join(both, ["variable", "steers"], "left")
    return F.broadcast(found.select("at", F.coalesce("no", F.lit(0)).alias("no"), "value"))


def all_paths(values: DataFrame, plain: DataFrame, routing: Routing, *, most: int = 200) -> DataFrame:
    """(scenario, questions, steps): the first ``most`` complete paths.

    ``values`` and ``plain`` are what ``test_values`` gives for the questions that steer
    and for the others; both have the size of the questionnaire.
    """
    spark = values.sparkSession
    tried = _tried(written(values, "path-values"), written(plain, "path-plain"), routing)
    frontier, done = _start(spark, routing), []
    order = [F.size("path"), F.col("path")]
    for step in range(len(routing.questions)):
        done.append(frontier.where("at IS NULL").select("path", "steps"))
        frontier = _answered(frontier.where("at IS NOT NULL").join(tried, "at"), routing)
        if step % STEPS_PER_PLAN == STEPS_PER_PLAN - 1:
            frontier = written(frontier, "path-frontier")
        # what a state still looks at depends on where it is
        same = [F.when(F.col("at").isNotNull() & F.col("at").isin([i for i in range(len(routing.questions)) if q.name in routing.needed(i)] or [-1]), F.struct(f"v_{q.name}")) for q in routing.questions if q.name in routing.steering]
        same += [F.col(f"d_{q.name}") for q in routing.questions]
        alike = Window.partitionBy("at", *same).orderBy(*order)
        frontier = frontier.withColumn("__r", F.row_number().over(alike)).where(F.col("__r") <= most).drop("__r")
    done.append(frontier.where("at IS NULL").select("path", "steps"))
    found = done[0]
    for d in done[1:]:
        found = found.unionByName(d)
    first = found.orderBy(*order).limit(most)
    return first.select(F.row_number().over(Window.orderBy(*order)).alias("scenario"), F.size("steps").alias("questions"), "steps")


def covering_paths(values: DataFrame, plain: DataFrame, routing: Routing, *, most: int = 200) -> DataFrame:
    """(scenario, questions, steps): paths that take every value of every question that steers, where it can be reached.

    Each value not yet taken by an earlier path gets one that aims at it and answers
    plainly otherwise. Paths to all values are walked at once; which of them are needed
    is decided in their order, over as many rows as there are values.
    """
    spark = values.sparkSession
    names = [q.name for q in routing.questions]
    values, plain = written(values.where(F.col("variable").isin(sorted(routing.steering))), "path-values"), written(plain, "path-plain")
    place = F.coalesce(*(F.when(F.col("variable") == n, F.lit(i)) for i, n in enumerate(names)))
    targets = values.select(place.alias("target"), F.col("no").alias("target_no"), F.col("value").alias("target_value"))
    aimless = spark.range(1).select(F.lit(-1).alias("target"), F.lit(0).alias("target_no"), F.lit(None).cast("string").alias("target_value"))
    states = targets.unionByName(aimless).crossJoin(F.broadcast(_start(spark, routing)))  # one row on the right
    usual = F.broadcast(spark.createDataFrame([(n, i) for i, n in enumerate(names)], "variable string, at int").join(plain.where("no = 0"), "variable", "left").select("at", F.col("value").alias("usual")))
    for step in range(len(routing.questions)):
        over = states.where("at IS NULL")
        going = states.where("at IS NOT NULL").join(usual, "at").withColumn("no", F.lit(0)).withColumn("value", F.when(F.col("at") == F.col("target"), F.col("target_value")).otherwise(F.col("usual"))).drop("usual")
        states = over.unionByName(_answered(going, routing))
        if step % STEPS_PER_PLAN == STEPS_PER_PLAN - 1:
            states = written(states, "path-covering")
    taken = F.transform("steps", lambda s: F.concat_ws("=", s["variable"], F.coalesce(s["value"], F.lit("\u0000"))))
    aim = F.concat_ws("=", F.element_at(F.array(*(F.lit(n) for n in names)), F.col("target") + 1), F.coalesce("target_value", F.lit("\u0000")))
    row = F.struct("target", "target_no", aim.alias("aim"), taken.alias("taken"), "steps")
    rows = F.sort_array(F.collect_list(F.when(F.col("target") >= 0, row)))
    choose = lambda acc, r: F.when(F.array_contains(acc["taken"], r["aim"]), acc).otherwise(F.struct(F.concat(acc["taken"], r["taken"]).alias("taken"), F.concat(acc["chosen"], F.array(r["steps"])).alias("chosen")))
    empty = F.struct(F.array().cast("array<string>").alias("taken"), F.array().cast("array<array<struct<variable:string,value:string>>>").alias("chosen"))
    kept = states.agg(rows.alias("rows"), F.max(F.when(F.col("target") < 0, F.col("steps"))).alias("aimless")).select(F.aggregate("rows", empty, choose)["chosen"].alias("chosen"), "aimless")
    all_ = kept.select(F.posexplode(F.when(F.size("chosen") > 0, F.slice("chosen", 1, most)).otherwise(F.array("aimless"))).alias("no", "steps"))
    return all_.select((F.col("no") + 1).alias("scenario"), F.size("steps").alias("questions"), "steps")
