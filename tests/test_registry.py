"""The registry of questionnaires against a plain walk."""

import json
import random

from fieldwork.operators import registry as G


def tree(rng, depth):
    kind = rng.choice(["sequence", "loop", "ifThenElse", "question", "question", "statement"]) if depth else "sequence"
    node = {"type": kind, "id": f"n{rng.randrange(10**9)}"}
    some = lambda: [tree(rng, depth + 1) for _ in range(rng.randrange(3))] if depth < 7 else []
    if kind == "question":
        domain = rng.choice([{"type": "code", "categorySchemeRef": "s1"}, {"type": "grid", "rowSchemeRef": "s1", "colSchemeRef": "s2"}, {"type": "text"}, {"type": "markAll", "categorySchemeRef": "s2"}])
        node |= {"variableRef": rng.choice(["A", "B", "gone", ""]), "text": {"en": "How?", "fr": "Comment ?"}, "responseDomain": domain}
    elif kind == "ifThenElse":
        node |= {"then": some()} | ({"else": some()} if rng.random() < 0.5 else {})
    elif kind != "statement":
        node |= {"children": [*some(), *some()], "label": rng.choice([{}, {"en": "Part"}, {"en": " "}]), "isPage": rng.random() < 0.5}
    return node


def walk(node):
    yield node
    for c in node.get("children", []) + node.get("then", []) + node.get("else", []):
        yield from walk(c)


def test_every_component_is_listed_and_counted(spark):
    rng = random.Random(5)
    given = []
    for k in range(6):
        given.append({"id": f"i{k}", "version": "1", "metadata": {"title": {"en": "T", "fr": "TF"}, "created": "2020"}, "concepts": [{"id": "c", "label": {"en": "money"}}], "variables": [{"name": "A", "conceptRef": "c", "kind": "k", "representation": "r"}, {"name": "B"}], "categorySchemes": [{"id": "s1", "categories": [{"code": "1", "label": {"en": "Yes"}}]}, {"id": "s2"}], "sequence": tree(rng, 0)})
    rows = [(json.dumps(x), k) for k, x in enumerate(given)] + [("{broken", 90), (None, 91), ("{}", 92), ('{"id": "bare"}', 93)]
    got = G.registry(spark.createDataFrame(rows, "j string, instrument int"), json="j").collect()
    found = {}
    for r in got:
        found.setdefault((r.instrument, r.component_type), []).append(r)
    assert [r.entry_id for r in found.pop(("bare", "instrument"))] == ["inst:bare"]
    for x in given:
        all_ = list(walk(x["sequence"]))
        asked = [n for n in all_ if n["type"] == "question"]
        assert sorted(r.entry_id for r in found.get((x["id"], "question"), [])) == sorted(f"{x['id']}#{n['id']}" for n in asked)
        named = [n for n in all_[1:] if n["type"] == "sequence" and n["label"].get("en", "").strip()]
        groups = {(r.entry_id, k) for k in ("page", "section") for r in found.get((x["id"], k), [])}
        assert groups == {(f"{x['id']}#{n['id']}", "page" if n["isPage"] else "section") for n in named}
        uses = {v: sum(n["variableRef"] == v for n in asked) for v in "AB"}
        assert {r.entry_id[-1]: r.usage_count for r in found[x["id"], "variable"]} == uses
        refs = [v for n in asked for v in n["responseDomain"].values()]
        assert {r.entry_id[-2:]: r.usage_count for r in found[x["id"], "codeList"]} == {s: refs.count(s) for s in ("s1", "s2")}
        for r in found.get((x["id"], "question"), []):
            node = json.loads(r.payload)
            want = ["How?", "Comment ?", node["variableRef"], node["responseDomain"]["type"], "money" if node["variableRef"] == "A" else ""]
            assert r.search_text == " · ".join(w for w in want if w)


def test_places_give_document_order(spark):
    root = {"type": "sequence", "id": "0", "children": [{"type": "loop", "id": "1", "children": [{"type": "question", "id": "2"}]}, {"type": "ifThenElse", "id": "3", "then": [{"type": "statement", "id": "4"}], "else": [{"type": "question", "id": "5"}]}]}
    df = spark.createDataFrame([(json.dumps({"id": "x", "sequence": root}),)], "j string")
    assert [json.loads(r.node)["id"] for r in G.nodes(df, json="j").orderBy("place").collect()] == list("012345")


def test_ids_are_read_once_a_questionnaire(spark):
    df = spark.createDataFrame([(json.dumps({"id": "x", "variables": [{"name": "A"}, {"name": "B"}]}),)], "j string")
    listed = G._listed(df, "j", "$.variables", "$.name")
    assert sorted((r.instrument, r.i, r.key) for r in listed.collect()) == [("x", 0, "A"), ("x", 1, "B")]
    # not beside the members, where it would be read for each of them
    plan = listed._jdf.queryExecution().optimizedPlan().toString()
    assert "$.id" not in plan[: plan.index("Generate ")]
