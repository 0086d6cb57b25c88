"""Paths against a plain queue."""

from collections import deque

import pytest

from fieldwork.operators import instrument as I
from fieldwork.operators import paths as P

DOMAINS = "variable string, type string, codes array<string>, low double, high double, longest int"
ROWS = [("a", "code", ["1", "2", "3"], None, None, None), ("b", "numeric", None, 0.0, 10.0, None), ("c", "boolean", None, None, None, None), ("d", "text", None, None, None, 3), ("e", "code", ["x"], None, None, None), ("f", "photo", None, None, None, None)]
QUESTIONS = [I.Question("a"), I.Question("b", visible_when="$a != '2'"), I.Question("c"), I.Question("d", visible_when="$b > 4 && $c == 'true'"), I.Question("f"), I.Question("e", visible_when="$a == '3'")]
AHEAD = [I.Question("a"), I.Question("d", visible_when="$c == 'true'"), I.Question("c"), I.Question("e", visible_when="$a == '3'")]


def shows(name, ahead):
    number = lambda x: float(x) if x not in (None, "") else 0.0
    if ahead:
        return {"d": lambda s: s.get("c") == "true", "e": lambda s: s.get("a") == "3"}.get(name, lambda s: True)
    return {"b": lambda s: s.get("a") != "2", "d": lambda s: number(s.get("b")) > 4 and s.get("c") == "true", "e": lambda s: s.get("a") == "3"}.get(name, lambda s: True)


def queue(questions, values, plain, steering, most, ahead):
    todo, out = deque([{}]), []
    while todo and len(out) < most:
        state = todo.popleft()
        q = next((q.name for q in questions if q.name not in state and shows(q.name, ahead)(state)), None)
        if q is None:
            out.append(list(state.items()))
            continue
        for v in (values if q in steering else plain).get(q, []) or [None]:
            todo.append({**state, q: v})
    return out


@pytest.mark.parametrize(("questions", "ahead"), [(QUESTIONS, False), (AHEAD, True)])
@pytest.mark.parametrize("most", [1, 5, 200])
def test_paths_are_those_of_a_queue(spark, questions, ahead, most, monkeypatch):
    monkeypatch.setattr(P, "STEPS_PER_PLAN", 2)
    routing = P.Routing(questions, frozenset({"b"}))
    assert routing.steering == ({"a", "c"} if ahead else {"a", "b", "c"})
    domains = spark.createDataFrame(ROWS, DOMAINS)
    lists = []
    for mode in ("routing", "canonical"):
        found = {}
        for r in P.test_values(domains, mode).orderBy("variable", "no").collect():
            found.setdefault(r.variable, []).append(r.value)
        lists.append(found)
    assert lists[0]["b"] == ["0", "5", "10"] and lists[1]["d"] == ["Test response"] and "f" not in lists[0]
    got = [[(s.variable, s.value) for s in r.steps] for r in P.all_paths(P.test_values(domains, "routing"), P.test_values(domains, "canonical"), routing, most=most).orderBy("scenario").collect()]
    assert got == queue(questions, *lists, routing.steering, most, ahead)


def test_coverage_takes_every_value_that_can_be_reached(spark):
    domains = spark.createDataFrame(ROWS, DOMAINS)
    routing = P.Routing(QUESTIONS, frozenset({"b"}))
    got = P.covering_paths(P.test_values(domains, "routing"), P.test_values(domains, "canonical"), routing).orderBy("scenario").collect()
    taken = {(s.variable, s.value) for r in got for s in r.steps}
    assert {("a", x) for x in "123"} | {("b", x) for x in ("0", "5", "10")} | {("c", "true"), ("c", "false")} <= taken
    assert [r.scenario for r in got] == list(range(1, len(got) + 1)) and len(got) < 18
    assert len(P.covering_paths(P.test_values(domains, "routing"), P.test_values(domains, "canonical"), P.Routing([I.Question("a"), I.Question("d")], frozenset())).collect()) == 1


def test_boundary_values(spark):
    rows = [*ROWS, ("g", "codes", ["1", "2"], None, None, None), ("h", "code", [], None, None, None), ("i", "time", None, None, None, None)]
    found = {}
    for r in P.test_values(spark.createDataFrame(rows, DOMAINS), "boundary").orderBy("variable", "no").collect():
        found.setdefault(r.variable, []).append(r.value)
    assert found["a"] == [None, "1", "3"] and found["e"] == [None, "x"] and found["b"] == ["-1", "0", "5", "10", "11"] and found["g"] == ["", "1", "1,2"]
    assert found["h"] == [None] and found["d"][3:5] == ["AAA", "AAAA"] and found["i"][0] == "" and "f" not in found
