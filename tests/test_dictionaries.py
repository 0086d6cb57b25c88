"""Dictionary lines, by hand; the queries compare whole printed documents with their tables."""

import pytest
from pyspark.sql import functions as F

from fieldwork.operators import dictionaries as D


@pytest.mark.parametrize(
    ("row", "want"),
    [
        ("1   Yes   1,234   5,678", ("1", "Yes", 1234.0, 5678.0)),
        ("Yes   1   1,234", ("1", "Yes", 1234.0, None)),
        ("First collection period 1 850 2,870,500 7.9", ("1", "First collection period", 850.0, 2870500.0)),
        ("Première période 1 2 400 461 000 1,4", ("1", "Première période", None, None)),
        ("Oui 2 1 150 %", ("2", "Oui", None, None)),
        ("No 01 - 31 12 %", ("01 - 31", "No", 12.0, None)),
        ("1   TBC_30A Nb of cigarettes   13", None),
        ("TBC_30A Nb of cigarettes smoked 1 13", None),
        ("Total   31   1,234", None),
        ("1   2   3", None),
        ("12 13 14", None),
        ("A line of prose that ends with 5", None),
        ("x" * 121 + "   1   5", None),
        ("", None),
    ],
)
def test_category_rows(spark, row, want):
    got = spark.createDataFrame([(row,)], "r string").select(D.category(D.plain_row(F.col("r"))).alias("c")).first().c
    assert (tuple(got) if got else None) == want


def parsed(spark, pages):
    rows = [(d, p, i, r) for d, texts in pages.items() for p, t in enumerate(texts) for i, r in enumerate(t.split("\n") if t is not None else [None])]
    lines = spark.createDataFrame(rows, "doc string, pg int, ln int, txt string")
    chosen = D.layouts(lines, document="doc", row="txt")
    found = D.variables(lines, chosen, document="doc", page="pg", line="ln", row="txt")
    return chosen, found


def test_blocks_run_across_pages_and_the_most_frequent_layout_wins(spark):
    pages = {
        "en": ["FIELD NAME: STRAY\nVariable Name: ABC Length: 2.0 Position: 1\nConcept: Smoking   Question Text:   Universe: All", "Question Text: Do you smoke?\n1   Yes   10   20\nVariable Name: 9X Length: 1 Position: 3\nVariable Name: DEF Length: 1 Position: 4"],
        "fr": ["Contenu\nNom de la variable : REFPER Longueur : 13.0 Position : 9\nUnivers :\nUnivers : Tous\nNota : voir"],
        "field": ["FIELD NAME: AGE\nDESCRIPTION: The age", "in years\nCOMMENT: first\nDESCRIPTION: Age: last\n\nbirthday"],
        "definition": ["Variable name: SEX\nShort Description: Sex\nLong Description: Sex of\n12\nthe child\nDerived from: BC"],
        "collection": ["Variable Name:  Q1  Position:  1  Length:  2\nHow old\nResponse\nare you?\nCoverage:  all\nNote:  Universe: none"],
        "none": ["prose", None, ""],
    }
    chosen, found = parsed(spark, pages)
    assert {r.doc: (r.layout, r.headers) for r in chosen.collect()} == {"en": ("labelled", 3), "fr": ("labelled", 1), "field": ("field", 1), "definition": ("definition", 1), "collection": ("collection", 1), "none": (None, 0)}
    got = {(r.doc, r.name): r for r in found.collect()}
    assert set(got) == {("en", "ABC"), ("en", "DEF"), ("fr", "REFPER"), ("field", "AGE"), ("definition", "SEX"), ("collection", "Q1")}
    abc = got["en", "ABC"]
    assert (abc.block, abc.page, abc.length, abc.concept, abc.universe, abc.question_text) == (1, 0, "2.0", "Smoking", "All", "Do you smoke?")
    assert [tuple(c) for c in abc.codes] == [("1", "Yes", 10.0, 20.0)] and got["en", "DEF"].block == 3
    assert (got["fr", "REFPER"].universe, got["fr", "REFPER"].note, got["fr", "REFPER"].position) == ("Tous", "voir", "9")
    assert (got["field", "AGE"].question_text, got["field", "AGE"].note) == ("Age: last birthday", "first")
    assert (got["definition", "SEX"].note, got["definition", "SEX"].concept) == ("Sex of the child Derived from: BC", "Sex")
    q1 = got["collection", "Q1"]
    assert (q1.question_text, q1.universe, q1.note, q1.position, q1.length) == ("How old are you?", "all", None, "1", "2")
    assert {(r.doc, r.severity) for r in D.notes(chosen, found, document="doc").collect()} == {("none", "warning"), ("en", "info")}


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc string, pg int, ln int, txt string")
    chosen = D.layouts(none, document="doc", row="txt")
    found = D.variables(none, chosen, document="doc", page="pg", line="ln", row="txt")
    assert found.count() == 0 and D.notes(chosen, found, document="doc").count() == 0


def test_lines_are_cut_once(spark):
    row = F.col("r")
    # the pattern of narrow rows, and the cells of wide ones
    plan = spark.createDataFrame([("1   Yes   1,234   5,678",)], "r string").select(D.category(row).alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(trim(r") == 1 and plan.count("{2,120}?") == 1
