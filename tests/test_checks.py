"""Checks, confrontation and corrections on fixed small cases."""

import uuid

from pyspark.sql import functions as F

from fieldwork.functions import text as X
from fieldwork.operators import cascade as C
from fieldwork.operators import confront as K
from fieldwork.operators import flags as S
from fieldwork.operators import metadata as M
from fieldwork.operators import search as Q


def test_one_outlier(spark):
    values = [100, 105, 98, 102, 101, 99, 103, 100000]
    obs = spark.createDataFrame([(i, i, "revenue", float(v)) for i, v in enumerate(values)], "id long, who long, var string, x double")
    got = S.mad_outliers(obs, response="id", respondent="who", group="var", value="x").collect()
    assert [(r.response_id, r.check_id, r.suspicion) for r in got] == [("7", "mad:revenue", 1.0)]
    assert S.mad_outliers(obs.limit(7), response="id", respondent="who", group="var", value="x").count() == 0
    same = obs.withColumn("x", F.lit(5.0))
    assert S.mad_outliers(same, response="id", respondent="who", group="var", value="x").count() == 0


def test_speed_threshold_is_the_reference_rank(spark):
    rows = spark.createDataFrame([(i, float(i)) for i in range(20)], "id long, d double")
    assert S.speed_threshold(rows, "d", floor=-1.0).first().threshold == 1.0
    assert S.speed_threshold(rows.limit(5), "d", floor=7.0).first().threshold == 7.0
    assert [r.id for r in S.speeders(rows, "d", floor=2.0).orderBy("id").collect()] == [0, 1]


def test_straight_lines_and_duplicates(spark):
    grid = spark.createDataFrame([("a", "lo")] * 3 + [("b", "lo"), ("b", "lo"), ("b", None), ("c", "lo"), ("c", "lo")], "g string, v string")
    assert [r.g for r in S.straight_lines(grid, "g", "v").collect()] == ["a"]
    twice = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "id long, t string")
    assert sorted((r.id, r.others) for r in S.exact_duplicates(twice, F.col("t")).collect()) == [(1, 1), (2, 1)]


def test_impact_and_suppression(spark):
    f = spark.createDataFrame([("1", "mad:v", "v", 900.0, 1.0), ("2", "mad:v", "v", 100.0, 1.0), ("3", "r", None, None, 0.6)], "response_id string, check_id string, variable_name string, observed double, suspicion double")
    obs = spark.createDataFrame([("v", 900.0), ("v", 100.0)], "var string, x double")
    got = {r.response_id: r.impact for r in S.with_impact(f, obs, "var", "x").collect()}
    assert got == {"1": 0.9, "2": 0.1, "3": 0.5}
    left = S.unsuppressed(f, spark.createDataFrame([("1", "mad:v", "v", 100.0), ("3", "r", None, None)], "response_id string, check_id string, variable_name string, observed double"))
    assert sorted(r.response_id for r in left.collect()) == ["1", "2"]


def test_tolerances(spark):
    rows = spark.createDataFrame([(100.0, 104.0), (100.0, 120.0), (5.0, 0.0), (None, 1.0)], "s double, r double")
    either = rows.select(K.within(F.col("s"), F.col("r"), pct=5, absolute=10).alias("ok")).collect()
    assert [r.ok for r in either] == [True, False, True, None]
    assert [r.ok for r in rows.select(K.within(F.col("s"), F.col("r")).alias("ok")).collect()] == [False, False, False, None]


def test_latest_correction_keeps_the_first_of_equals(spark):
    c = spark.createDataFrame([("a", 1, 0, "old"), ("a", 2, 1, "first"), ("a", 2, 2, "second")], "cell string, at long, ord long, v string")
    assert K.latest(c, ["cell"], "at", "ord", "v").first().value == "first"
    raw = spark.createDataFrame([("a", "raw"), ("b", "raw")], "cell string, v string")
    fixed = spark.createDataFrame([("a", "new"), ("z", "added")], "cell string, value string")
    assert {r.cell: (r.v, r.corrected) for r in K.overlay(raw, fixed, ["cell"], "v").collect()} == {"a": ("new", True), "b": ("raw", False), "z": ("added", True)}


def test_metadata_checks(spark):
    fields = [M.Field("n", "numeric", 0, 10, 0), M.Field("c", "code", codes=("a", "b")), M.Field("t", "text", longest=3, pattern="^x"), M.Field("d", "datetime"), M.Field("m", "markAll")]
    rows = [("1", "n", "11"), ("2", "n", "abc"), ("3", "n", "1.5"), ("4", "c", "z"), ("5", "t", "yyyy"), ("6", "d", "2020-13-40"), ("7", "d", "2020-01-02"), ("8", "m", "3"), ("9", "who", "1"), ("10", "n", ""), ("11", "n", None), ("12", "n", "10")]
    got = M.checked(spark.createDataFrame(rows, "response_id string, base_name string, value string"), fields)
    found = {(r.response_id, r.check_id) for r in got.collect()}
    assert found == {("1", "range:n"), ("2", "type:n"), ("3", "precision:n"), ("4", "code:c"), ("5", "range:t"), ("5", "pattern:t"), ("6", "type:d"), ("8", "code:m"), ("9", "orphan")}


def test_text_functions(spark):
    df = spark.createDataFrame([("  Marital  STATUS (É) ", "cih_005", "studies testing boxes cats is")], "a string, b string, c string")
    r = df.select(X.normalize_key(F.col("a")).alias("k"), X.mnemonic(F.col("b")).alias("m"), X.search_tokens(F.col("c")).alias("t"), X.trigrams(F.lit("cat")).alias("g"), X.uuid5(uuid.NAMESPACE_URL, F.col("b")).alias("u"), X.chunk_start(F.lit(101)).alias("p"), X.years(F.lit("x2019 2015-2021 12020")).alias("y")).first()
    assert r.k == "marital status" and r.m == "CIH_005" and r.t == ["study", "test", "box", "cat", "is"] and r.g == ["  c", " ca", "cat", "at "]
    assert r.u == str(uuid.uuid5(uuid.NAMESPACE_URL, "cih_005")) and r.p == 101 and r.y == ["2015", "2021"]


def test_most_frequent_and_suggestions(spark):
    df = spark.createDataFrame([("g", "b"), ("g", "a"), ("g", " "), ("h", "x")], "k string, v string")
    assert {r.k: r.v for r in C.most_frequent(df, ["k"], "v").collect()} == {"g": "a", "h": "x"}
    v = spark.createDataFrame([("smoking", 100), ("smocking", 2), ("housing", 50)], "term string, records long")
    assert [r.term for r in Q.suggest(v, "smokking").collect()][0] == "smoking"


def test_medians_of_hot_and_small_groups(spark):
    """Exact medians from ranges of counts, against the built-in function."""
    from fieldwork.operators import flags as S

    rows = [("hot", float(i * 7919 % 1013)) for i in range(4000)] + [("even", float(i)) for i in range(10)] + [("one", 5.0), ("none", None), (None, 1.0), (None, 4.0), ("same", 2.0), ("same", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: (r.median, r.n) for r in S.medians(df, "g", "v").collect() if r.g is not None}
    want = {r.g: (r.m, r.n) for r in df.where("v IS NOT NULL AND g IS NOT NULL").groupBy("g").agg(F.median("v").alias("m"), F.count("v").alias("n")).collect()}
    assert got == want and "none" not in got
    assert {r.g for r in S.medians(df, "g", "v", least=10).collect()} == {"hot", "even"}


def test_a_whole_run_has_every_statistical_check(spark):
    """Repeated response ids keep their own respondents; batteries of two say nothing; without a duration the check is skipped."""
    from fieldwork.operators import validation as R

    rows = [("r1", "a", 1, 1, 1, 5.0, True), ("r1", "b", 1, 1, 1, 5.0, True), ("r2", "a", 1, 2, 1, 900.0, True), ("r3", None, None, 1, 1, None, False)]
    df = spark.createDataFrame(rows, "id string, who string, x int, y int, z int, ms double, done boolean")
    run = R.Run("id", "who", rules={"big": ("$x == 1", "fatal")}, compared=("x", "y", "z"), completed="done", duration="ms", speed_floor=10.0, batteries={"g": ("x", "y", "z"), "two": ("x", "z")})
    got = R.validate(df, run)
    flags = sorted((f.response_id, f.respondent_id, f.check_id) for f in got["flags"].collect())
    same = [("r1", "a", "straight-line:g"), ("r1", "b", "straight-line:g")]
    want = [("r1", "a", "big"), ("r1", "b", "big"), ("r2", "a", "big"), ("r1", "a", "duplicate-exact"), ("r1", "b", "duplicate-exact"), ("r1", "a", "duplicate-respondent"), ("r2", "a", "duplicate-respondent"), ("r1", "a", "speeder"), ("r1", "b", "speeder"), *same]
    assert flags == sorted(want)
    assert {s.check_kind: s.total for s in got["summary"].collect()}["statistical"] == 8
    assert [s.check_id for s in R.skipped(df.where("NOT done"), run).collect()] == ["speeder"]
