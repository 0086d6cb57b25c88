"""The expression language on a few rows of mixed values."""

import math

import pytest

from fieldwork.functions import expr as E

ROW = {"age": 34.0, "zero": 0.0, "neg": -1.5, "name": "Ann", "num": "12", "empty": "", "none": None, "yes": True, "no": False}


@pytest.fixture(scope="module")
def row(spark):
    schema = "age double, zero double, neg double, name string, num string, empty string, none string, yes boolean, no boolean"
    return spark.createDataFrame([tuple(ROW.values())], schema)


NUMBERS = {
    "1 + 2 * 3": 7.0, "(1 + 2) * 3": 9.0, "10 - 4 - 3": 3.0, "$age % 5": 4.0, "-7 % 3": -1.0, "$age / 4": 8.5, "1 / $zero": math.inf, "-1 / $zero": -math.inf, "0 / $zero": None,
    "round(-1.5)": -1.0, "round(2.5)": 3.0, "floor($neg)": -2.0, "ceil($neg)": -1.0, "abs($neg)": 1.5, "min(3, 1, 2)": 1.0, "max(3, $num)": 12.0, "max(1, 'x')": None, "min()": math.inf,
    "sum(1, 'x', $num)": 13.0, "len($name)": 3.0, "len($none)": 0.0, "len('\U0001f600')": 2.0, "count($empty)": 0.0, "count($name)": 1.0, "'2' + 3": 5.0, "'0x10' - 1": None, "true + 1": 2.0, "-$num": -12.0,
}
FLAGS = {
    "": True, "$age > 30 && $age < 40": True, "$age == '34'": True, "$num == 12": True, "$none == null": True, "$missing == null": True, "$empty == null": False, "$none != 5": True, "$none > 1": False, "$none < 1": False,
    "$name > 1": False, "$name != 1": True, "isAnswered($zero)": True, "isAnswered($empty)": False, "isAnswered($none)": False, "!$name": False, "not $zero": True, "'false'": True, "$yes == true": True, "$no || $yes": True,
    "false && danger()": False, "true or danger()": True, "contains($name, 'nn')": True, "contains($age, 3)": False, "matches($name, '^A')": True, "matches($name, '[')": False, "not $age == 1": False, "1 < 2 == true": True, "$yes and $no or $yes": True, "'a' == \"a\"": True,
}
TEXTS = {"upper($name)": "ANN", "lower($none)": "", "$name + '!'": "Ann!", "'a' + 1": "a1", "'x' + $age": "x34", "'x' + 1.5": "x1.5", r"'it\'s'": "it's", "$none + 'b'": "b"}


@pytest.mark.parametrize("kind, cases", [("number", NUMBERS), ("condition", FLAGS), ("text", TEXTS)])
def test_values(row, kind, cases):
    env = E.environment(row)
    to_column = {"number": E.compile_number, "condition": E.compile_condition, "text": E.compile_text}[kind]
    got = row.select(*(to_column(s, env).alias(f"c{i}") for i, s in enumerate(cases))).first()
    assert dict(zip(cases, got, strict=True)) == cases


@pytest.mark.parametrize("source", ["1 +", "name", "(1", "1 2", "$", "min(1", "'open"])
def test_malformed(source):
    with pytest.raises(E.ExpressionError):
        E.parse(source)
    assert E.variables(source) == set()


def test_unknown_function_fails_when_evaluated(row):
    env = E.environment(row)
    with pytest.raises(Exception, match="unknown function"):
        row.select(E.compile_condition("danger()", env)).collect()


def test_variables_visibility_and_piping(row):
    env = E.environment(row)
    assert E.variables("$a + min($b, $a) > 1") == {"a", "b"}
    got = row.select(E.visible("1 +", env).alias("bad"), E.visible(None, env).alias("blank"), E.visible("$age > 40", env).alias("old"), E.piped("Hi ${name}, ${$age + 1}${oops +}${missing}.", env).alias("t")).first()
    assert tuple(got) == (True, True, False, "Hi Ann, 35.")
