"""All survey queries over the driver's tables, and their DuckDB oracles, by name."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwork.functions import expr as E
from fieldwork.functions import text as X
from fieldwork.operators import browse as B
from fieldwork.operators import cascade as C
from fieldwork.operators import confront as K
from fieldwork.operators import dashboards as D
from fieldwork.operators import flags as S
from fieldwork.operators import instrument as I
from fieldwork.operators import metadata as M
from fieldwork.operators import search as Q
from fieldwork.streaming import paradata as P

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


# -- statistical checks and scoring

_MAD = """
WITH m AS (SELECT event_type, median(value) AS centre, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1),
d AS (SELECT e.*, centre, abs(value - centre) AS away FROM events e JOIN m USING (event_type) WHERE n >= 8),
s AS (SELECT event_type, median(away) AS mad FROM d GROUP BY 1),
z AS (SELECT d.*, CASE WHEN mad > 0 THEN 0.6745 * (value - centre) / mad ELSE 0 END AS z FROM d JOIN s USING (event_type)),
f AS (SELECT CAST(event_id AS VARCHAR) AS response_id, CAST(user_id AS VARCHAR) AS respondent_id, event_type AS variable_name,
  'statistical' AS check_kind, 'mad:' || event_type AS check_id, 'query' AS severity, value AS observed,
  least(1.0, 0.5 + (abs(z) - 3.5) / 7.0) AS suspicion FROM z WHERE abs(z) > 3.5)
"""
_SCORED = (
    _MAD
    + """, t AS (SELECT event_type AS variable_name, sum(abs(value)) AS total FROM events GROUP BY 1),
q AS (SELECT f.*, CASE WHEN total > 0 AND observed IS NOT NULL THEN abs(observed) / total ELSE 0.5 END AS impact FROM f LEFT JOIN t USING (variable_name))
"""
)


def _mad_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "value")
    return S.mad_outliers(e, response="event_id", respondent="user_id", group="event_type", value="value")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.with_impact(_mad_flags(spark, sf_dir), table(spark, sf_dir, "events", "event_type", "value"), "event_type", "value")


@query(_MAD + "SELECT * REPLACE (round(suspicion, 6) AS suspicion) FROM f")
def mad_outliers(spark, sf_dir):
    return _mad_flags(spark, sf_dir).withColumn("suspicion", F.round("suspicion", 6))


@query(_SCORED + "SELECT * REPLACE (round(suspicion, 6) AS suspicion), round(impact, 9) AS impact, round(suspicion * impact, 9) AS score FROM (SELECT * EXCLUDE (impact), impact FROM q)".replace("SELECT * REPLACE (round(suspicion, 6) AS suspicion), round(impact, 9) AS impact,", "SELECT * REPLACE (round(suspicion, 6) AS suspicion, round(impact, 9) AS impact),"))
def flag_queue_scored(spark, sf_dir):
    return S.queue(_scored(spark, sf_dir)).withColumns({"suspicion": F.round("suspicion", 6), "impact": F.round("impact", 9), "score": F.round("score", 9)})


@query(_SCORED + "SELECT * REPLACE (round(suspicion, 6) AS suspicion, round(impact, 9) AS impact), round(suspicion * impact, 9) AS score FROM q WHERE NOT EXISTS (SELECT 1 FROM f a WHERE observed < 0 AND a.response_id = q.response_id AND a.check_id = q.check_id AND a.variable_name IS NOT DISTINCT FROM q.variable_name AND a.observed IS NOT DISTINCT FROM q.observed)")
def suppression_anti(spark, sf_dir):
    flags = _scored(spark, sf_dir)
    return S.unsuppressed(flags, flags.where("observed < 0")).withColumns({"suspicion": F.round("suspicion", 6), "impact": F.round("impact", 9), "score": F.round("score", 9)})


@query("SELECT doc_id, n - 1 AS others FROM (SELECT doc_id, count(*) OVER (PARTITION BY text) AS n FROM documents) WHERE n > 1")
def duplicate_exact(spark, sf_dir):
    return S.exact_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), F.col("text")).select("doc_id", "others")


@query("SELECT o_orderkey, o_custkey, n - 1 AS others FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WHERE o_orderstatus = 'F') WHERE n > 1")
def duplicate_respondent(spark, sf_dir):
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    return S.repeated_respondents(o, "o_custkey", F.col("o_orderstatus") == "F").select("o_orderkey", "o_custkey", "others")


@query("""WITH r AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events WHERE value IS NOT NULL),
t AS (SELECT greatest(1.0, min(value)) AS threshold FROM r WHERE i = floor(n * 0.05))
SELECT event_id, value, threshold FROM events, t WHERE value < threshold""")
def speeders(spark, sf_dir):
    return S.speeders(table(spark, sf_dir, "events", "event_id", "value"), "value", floor=1.0)


@query("SELECT l_orderkey, count(*) AS n, min(l_returnflag) AS answer FROM lineitem GROUP BY 1 HAVING count(*) >= 3 AND count(l_returnflag) = count(*) AND min(l_returnflag) = max(l_returnflag)")
def straight_line(spark, sf_dir):
    return S.straight_lines(table(spark, sf_dir, "lineitem", "l_orderkey", "l_returnflag"), "l_orderkey", "l_returnflag")


@query("""WITH j AS (SELECT quality, toxic, source FROM documents LEFT JOIN labels USING (doc_id)), n AS (SELECT count(*) AS total, count(*) - count(quality) AS q, count(*) - count(toxic) AS t FROM j)
SELECT * FROM (SELECT 'quality' AS variable, q AS blank, total, round(q / total, 6) AS rate FROM n UNION ALL SELECT 'toxic', t, total, round(t / total, 6) FROM n) WHERE rate >= 0.5""")
def missingness(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return S.missing_rates(d, ["quality", "toxic", "source"]).withColumn("rate", F.round("rate", 6))


@query("""WITH u AS (SELECT 'query' AS severity, 'statistical' AS check_kind FROM (""" + _MAD + """SELECT 1 FROM f) UNION ALL
SELECT 'query', 'statistical' FROM (SELECT count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WHERE o_orderstatus = 'F') WHERE n > 1 UNION ALL
SELECT 'query', 'confrontation' FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)),
k AS (SELECT unnest(['metadata', 'edit', 'rule', 'statistical', 'confrontation']) AS check_kind)
SELECT check_kind, count(*) FILTER (severity = 'fatal') AS fatal, count(*) FILTER (severity = 'query') AS query, count(severity) AS total FROM k LEFT JOIN u USING (check_kind) GROUP BY 1""")
def run_summary(spark, sf_dir):
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    again = S.repeated_respondents(o, "o_custkey", F.col("o_orderstatus") == "F")
    lost = K.unmatched(o, table(spark, sf_dir, "lineitem", "l_orderkey"), "o_orderkey", "l_orderkey")
    none = F.lit(None).cast("double")
    common = {"response": F.col("o_orderkey"), "respondent": F.col("o_custkey"), "variable": F.lit(None).cast("string"), "severity": "query", "observed": none}
    flags = _mad_flags(spark, sf_dir).unionByName(S.flag(again, kind="statistical", check_id=F.lit("duplicate-respondent"), suspicion=F.lit(0.7), **common)).unionByName(S.flag(lost, kind="confrontation", check_id=F.lit("confront-unmatched:lines"), suspicion=F.lit(0.4), **common))
    return S.run_summary(flags)


# -- confrontation, corrections, redaction


@query("""WITH t AS (SELECT l_orderkey, sum(l_extendedprice) AS reference FROM lineitem GROUP BY 1)
SELECT o_orderkey, o_totalprice, round(reference, 4) AS reference,
  CASE WHEN reference IS NULL THEN 'no reference' WHEN (reference <> 0 AND abs(o_totalprice - reference) / abs(reference) * 100 <= 10) OR abs(o_totalprice - reference) <= 500 THEN 'yes' ELSE 'no' END AS matches,
  round(CASE WHEN reference IS NULL THEN 0.4 WHEN NOT ((reference <> 0 AND abs(o_totalprice - reference) / abs(reference) * 100 <= 10) OR abs(o_totalprice - reference) <= 500)
    THEN least(1.0, 0.5 + abs(o_totalprice - reference) / CASE WHEN reference = 0 THEN 1.0 ELSE abs(reference) END) END, 6) AS suspicion
FROM orders LEFT JOIN t ON o_orderkey = l_orderkey""")
def confront_totals(spark, sf_dir):
    totals = table(spark, sf_dir, "lineitem", "l_orderkey", "l_extendedprice").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("total"))
    done = K.confront(table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice"), totals, key="o_orderkey", ref_key="l_orderkey", value="o_totalprice", ref_value="total", pct=10, absolute=500)
    said = F.when(F.col("matches").isNull(), "no reference").when(F.col("matches"), "yes").otherwise("no")
    return done.withColumns({"matches": said, "reference": F.round("reference", 4), "suspicion": F.round("suspicion", 6)})


@query("SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o.o_orderkey)")
def confront_unmatched(spark, sf_dir):
    return K.unmatched(table(spark, sf_dir, "orders", "o_orderkey", "o_custkey"), table(spark, sf_dir, "lineitem", "l_orderkey"), "o_orderkey", "l_orderkey")


@query("SELECT DISTINCT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def confront_gaps(spark, sf_dir):
    return K.unmatched(table(spark, sf_dir, "documents", "doc_id"), table(spark, sf_dir, "labels", "doc_id"), "doc_id", "doc_id").distinct()


_LATEST = "SELECT user_id, event_type, arg_max(value, (ts, -event_id)) AS value FROM events GROUP BY 1, 2"


@query("SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) AS r FROM events) WHERE r = 1")
def latest_correction(spark, sf_dir):
    return K.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "event_id", "value")


@query("""WITH raw AS (SELECT user_id, event_type, min(value) AS value FROM events WHERE event_type <> 'error' GROUP BY 1, 2),
c AS (SELECT user_id, event_type, value AS new FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) AS r FROM events WHERE event_type IN ('error', 'click')) WHERE r = 1)
SELECT user_id, event_type, coalesce(new, value) AS value, new IS NOT NULL AS corrected FROM raw FULL JOIN c USING (user_id, event_type)""")
def corrections_overlay(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    raw = e.where("event_type <> 'error'").groupBy("user_id", "event_type").agg(F.min("value").alias("value"))
    fixes = K.latest(e.where(F.col("event_type").isin("error", "click")), ["user_id", "event_type"], "ts", "event_id", "value")
    return K.overlay(raw, fixes, ["user_id", "event_type"], "value")


@query("SELECT c_custkey, CASE WHEN c_name IS NOT NULL THEN '[REDACTED]' END AS c_name, c_mktsegment FROM customer")
def redact(spark, sf_dir):
    return K.redacted(table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment"), ["c_name"])


# -- metadata checks, rules and the expression language

FIELDS = [
    M.Field("p_size", "numeric", low=5, high=45, decimals=0),
    M.Field("p_retailprice", "numeric", low=0, decimals=1),
    M.Field("p_brand", "lookup", codes=("Brand#11", "Brand#12", "Brand#13", "Brand#21", "Brand#22")),
    M.Field("p_name", "text", longest=14, pattern=r"^[a-z ]*$"),
]


@query("""WITH a AS (SELECT p_partkey, 'p_size' AS base_name, CAST(p_size AS VARCHAR) AS observed, CAST(p_size AS DOUBLE) AS num FROM part
UNION ALL SELECT p_partkey, 'p_retailprice', NULL, p_retailprice FROM part UNION ALL SELECT p_partkey, 'p_brand', p_brand, NULL FROM part
UNION ALL SELECT p_partkey, 'p_name', p_name, NULL FROM part UNION ALL SELECT p_partkey, 'p_type', p_type, NULL FROM part)
SELECT p_partkey, base_name, check_id, severity, suspicion FROM (
SELECT p_partkey, base_name, 'range:p_size' AS check_id, 'fatal' AS severity, 1.0::DOUBLE AS suspicion FROM a WHERE base_name = 'p_size' AND (num < 5 OR num > 45)
UNION ALL SELECT p_partkey, base_name, 'range:p_retailprice', 'fatal', 1.0 FROM a WHERE base_name = 'p_retailprice' AND num < 0
UNION ALL SELECT p_partkey, base_name, 'precision:p_retailprice', 'query', 0.5 FROM a WHERE base_name = 'p_retailprice' AND floor(num * 10 + 0.5) / 10 <> num
UNION ALL SELECT p_partkey, base_name, 'code:p_brand', 'query', 0.4 FROM a WHERE base_name = 'p_brand' AND observed <> '' AND observed NOT IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#21', 'Brand#22')
UNION ALL SELECT p_partkey, base_name, 'range:p_name', 'query', 0.5 FROM a WHERE base_name = 'p_name' AND length(observed) > 14
UNION ALL SELECT p_partkey, base_name, 'pattern:p_name', 'query', 0.5 FROM a WHERE base_name = 'p_name' AND observed <> '' AND NOT regexp_matches(observed, '^[a-z ]*$')
UNION ALL SELECT p_partkey, base_name, 'orphan', 'query', 0.3 FROM a WHERE base_name = 'p_type' AND observed <> '')""")
def metadata_checks(spark, sf_dir):
    answers = M.long_answers(table(spark, sf_dir, "part"), "p_partkey", ["p_size", "p_retailprice", "p_brand", "p_name", "p_type"])
    return M.checked(answers, FIELDS, response="p_partkey").drop("observed")


RULES = {
    "high": ("$o_totalprice > 300000 && $o_orderstatus != 'F'", "fatal"),
    "urgent": ("contains($o_orderpriority, 'URGENT') and $o_totalprice * 2 < 100000", "query"),
    "status": ("$o_orderstatus == 'P' || not isAnswered($o_orderpriority)", "query"),
}


@query("""SELECT o_orderkey, 'high' AS check_id, 'fatal' AS severity, 1.0::DOUBLE AS suspicion FROM orders WHERE o_totalprice > 300000 AND o_orderstatus IS DISTINCT FROM 'F'
UNION ALL SELECT o_orderkey, 'urgent', 'query', 0.6 FROM orders WHERE contains(o_orderpriority, 'URGENT') AND o_totalprice * 2 < 100000
UNION ALL SELECT o_orderkey, 'status', 'query', 0.6 FROM orders WHERE o_orderstatus = 'P' OR coalesce(o_orderpriority, '') = ''""")
def rules_eval(spark, sf_dir):
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    env = E.environment(o)
    hits = [F.when(E.compile_condition(source, env), F.struct(F.lit(name).alias("check_id"), F.lit(sev).alias("severity"), F.lit(1.0 if sev == "fatal" else 0.6).alias("suspicion"))) for name, (source, sev) in RULES.items()]
    return o.select("o_orderkey", F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("r")).select("o_orderkey", "r.*")


@query("""SELECT c_custkey, round(c_acctbal * 2 - c_nationkey / 4, 6) AS a, CASE WHEN c_nationkey = 0 THEN (CASE WHEN c_acctbal > 0 THEN 'inf'::DOUBLE WHEN c_acctbal < 0 THEN '-inf'::DOUBLE END) ELSE round(c_acctbal / c_nationkey, 6) END AS b,
floor(c_acctbal + 0.5) AS c, CASE WHEN c_nationkey <> 0 THEN round(c_acctbal % c_nationkey, 6) END AS d, greatest(c_acctbal, 100.0) AS e, abs(c_acctbal) > 5000 AND c_nationkey <= 10 AS f FROM customer""")
def expr_numeric(spark, sf_dir):
    c = table(spark, sf_dir, "customer", "c_custkey", "c_acctbal", "c_nationkey")
    env = E.environment(c)
    num = lambda s: E.compile_number(s, env)
    div = num("$c_acctbal / $c_nationkey")
    return c.select("c_custkey", F.round(num("$c_acctbal * 2 - $c_nationkey / 4"), 6).alias("a"), F.when(F.abs(div) == float("inf"), div).otherwise(F.round(div, 6)).alias("b"), num("round($c_acctbal)").alias("c"), F.round(num("$c_acctbal % $c_nationkey"), 6).alias("d"), num("max($c_acctbal, 100)").alias("e"), E.compile_condition("abs($c_acctbal) > 5000 && $c_nationkey <= 10", env).alias("f"))


@query("""SELECT p_partkey, upper(p_name) AS a, p_name || '/' || p_size AS b, length(p_name)::DOUBLE AS c, contains(p_name, 're') AS d, regexp_matches(p_brand, '#[12]') AS e, 'Part ' || p_partkey || ': ' || p_brand AS f FROM part""")
def expr_text(spark, sf_dir):
    p = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_size")
    env = E.environment(p)
    return p.select("p_partkey", E.compile_text("upper($p_name)", env).alias("a"), E.compile_text("$p_name + '/' + $p_size", env).alias("b"), E.compile_number("len($p_name)", env).alias("c"), E.compile_condition("contains($p_name, 're')", env).alias("d"), E.compile_condition("matches($p_brand, '#[12]')", env).alias("e"), E.piped("Part ${p_partkey}: ${$p_brand}", env).alias("f"))


@query("""SELECT doc_id, quality IS DISTINCT FROM 1 AS a, coalesce(quality > 0, false) AS b, coalesce(quality, 0) + coalesce(toxic, 0) + 0.0::DOUBLE AS c, quality IS NULL AS d, quality IS NOT NULL AS e, coalesce(quality, 0) = 0 AS f FROM documents LEFT JOIN labels USING (doc_id)""")
def expr_null_semantics(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    env = E.environment(d)
    yes = lambda s: E.compile_condition(s, env)
    return d.select("doc_id", yes("$quality != 1").alias("a"), yes("$quality > 0").alias("b"), E.compile_number("sum($quality, $toxic)", env).alias("c"), yes("$quality == null").alias("d"), yes("isAnswered($quality)").alias("e"), yes("!$quality").alias("f"))


@query("SELECT coalesce(l_returnflag, 'TOT') AS l_returnflag, coalesce(l_linestatus, 'TOT') AS l_linestatus, sum(l_quantity) AS total FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), (l_linestatus), ())")
def table_totals(spark, sf_dir):
    return D.table_totals(table(spark, sf_dir, "lineitem", "l_returnflag", "l_linestatus", "l_quantity"), "l_returnflag", "l_linestatus", "l_quantity")


ORDER_FORM = I.Instrument(
    id="order",
    nodes=(
        I.Question("o_orderstatus", "Status of order ${o_orderkey}"),
        I.Computation("large", "$o_totalprice > 250000"),
        I.IfThenElse("$large", then=(I.Question("o_orderpriority", "Priority of a large order"),), otherwise=(I.Question("clerk", "Clerk", required=True, visible_when="$o_orderstatus == 'P'"),)),
        I.Roster("part", "o_shippriority", (I.Question("note", "Note"),)),
    ),
    edits=(I.Edit("edit.large.open", "$large && $o_orderstatus == 'O'", "soft"), I.Edit("edit.bad", "1 +"), I.Edit("edit.price", "$net < 1000")),
    derived={"net": "$o_totalprice / 1.1"},
)


@query("""SELECT o_orderkey, 'required:clerk' AS edit_id, 'fatal' AS severity, 1.0::DOUBLE AS suspicion FROM orders WHERE o_totalprice <= 250000 AND o_orderstatus = 'P'
UNION ALL SELECT o_orderkey, 'edit.large.open', 'query', 0.6 FROM orders WHERE o_totalprice > 250000 AND o_orderstatus = 'O'
UNION ALL SELECT o_orderkey, 'edit.price', 'fatal', 1.0 FROM orders WHERE o_totalprice / 1.1 < 1000""")
def edit_rerun(spark, sf_dir):
    return I.fired_edits(table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority"), ORDER_FORM, "o_orderkey")


@query("""WITH o AS (SELECT *, o_orderkey % 3 AS k FROM orders)
SELECT o_orderkey, 1 AS no, 'o_orderstatus' AS name, 'Status of order ' || o_orderkey AS text, true AS answered, 0 AS iteration FROM o
UNION ALL SELECT o_orderkey, 2, 'o_orderpriority', 'Priority of a large order', true, 0 FROM o WHERE o_totalprice > 250000
UNION ALL SELECT o_orderkey, 3, 'clerk', 'Clerk', false, 0 FROM o WHERE o_totalprice <= 250000 AND o_orderstatus = 'P'
UNION ALL SELECT o_orderkey, 4, 'note', 'Note', false, i FROM (SELECT o_orderkey, unnest(range(1, k + 1))::INTEGER AS i FROM o)""")
def flatten_items(spark, sf_dir):
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority").withColumn("o_shippriority", F.col("o_orderkey") % 3)
    return I.items(o, ORDER_FORM, "o_orderkey")


# -- corpus: cascade, timelines, statistics

_KEYED = """WITH k AS (SELECT *, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')) AS concept, coalesce(trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')), '') AS universe_key,
coalesce(CAST(p_size AS VARCHAR), 'none') AS representation, p_partkey % 5 AS survey, 2010 + p_partkey % 7 AS year FROM part) """
_SPANS = "count(*) AS occurrences, count(DISTINCT survey) AS surveys, count(DISTINCT year) AS years, min(year) AS first_year, max(year) AS last_year"


def _cascade(spark, sf_dir):
    p = table(spark, sf_dir, "part", "p_partkey", "p_type", "p_brand", "p_size").withColumns({"survey": F.col("p_partkey") % 5, "year": 2010 + F.col("p_partkey") % 7})
    return C.cascade(p, meaning=F.col("p_type"), universe=F.col("p_brand"), representation=F.col("p_size").cast("string"), survey="survey", year="year")


@query(_KEYED + f"SELECT concept, {_SPANS}, count(DISTINCT universe_key) AS variables FROM k WHERE concept <> '' GROUP BY 1")
def cascade_concepts(spark, sf_dir):
    return _cascade(spark, sf_dir)["concepts"]


@query(_KEYED + f"SELECT concept, universe_key, {_SPANS}, count(DISTINCT representation) AS representations FROM k WHERE concept <> '' GROUP BY 1, 2")
def cascade_conceptual(spark, sf_dir):
    return _cascade(spark, sf_dir)["conceptual"]


@query(_KEYED + f"SELECT concept, universe_key, representation, {_SPANS} FROM k WHERE concept <> '' GROUP BY 1, 2, 3")
def cascade_represented(spark, sf_dir):
    return _cascade(spark, sf_dir)["represented"]


@query(_KEYED + "SELECT p_partkey, concept, universe_key, representation FROM k WHERE concept <> ''")
def cascade_members(spark, sf_dir):
    return _cascade(spark, sf_dir)["members"].select("p_partkey", "concept", "universe_key", "representation")


@query("SELECT lang, source, n FROM (SELECT lang, source, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, source) AS r FROM documents WHERE trim(source) <> '' GROUP BY 1, 2) WHERE r = 1")
def label_mode(spark, sf_dir):
    return C.most_frequent(table(spark, sf_dir, "documents", "lang", "source"), ["lang"], "source")


@query("SELECT c_name, o_orderkey, year(o_orderdate)::INTEGER AS year, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey")
def timeline(spark, sf_dir):
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    c = table(spark, sf_dir, "customer", "c_custkey", "c_name")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("c_name", "o_orderkey", F.year("o_orderdate").alias("year"), "o_orderpriority").orderBy(F.col("year").asc_nulls_last(), "c_name", "o_orderkey")


@query("SELECT o_orderkey, o_custkey, coalesce(before IS NOT NULL AND before IS DISTINCT FROM o_orderpriority, false) AS changed FROM (SELECT *, lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders)")
def coding_changes(spark, sf_dir):
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    return K.rank_in_timeline(o, "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderpriority").select("o_orderkey", "o_custkey", "changed")


@query("SELECT count(*) AS records, count(DISTINCT source) AS surveys, min(n_chars) AS first_year, max(n_chars) AS last_year, count(*) FILTER (lang = 'en') AS english, count(*) FILTER (lang = 'fr') AS french FROM documents")
def corpus_stats(spark, sf_dir):
    return C.corpus_stats(table(spark, sf_dir, "documents", "source", "n_chars", "lang"), survey="source", year="n_chars", flags={"english": F.col("lang") == "en", "french": F.col("lang") == "fr"})


@query("""SELECT source, count(*) AS records, min(n_chars) AS least, max(n_chars) AS most, lang FROM documents JOIN (
SELECT source, lang FROM (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS r FROM documents GROUP BY 1, 2) WHERE r = 1) m USING (source) GROUP BY source, m.lang""".replace("SELECT source, count(*) AS records, min(n_chars) AS least, max(n_chars) AS most, lang FROM", "SELECT source, count(*) AS records, min(n_chars) AS least, max(n_chars) AS most, m.lang AS lang FROM"))
def corpus_surveys(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "source", "lang", "n_chars")
    return d.groupBy("source").agg(F.count("*").alias("records"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.mode("lang", True).alias("lang"))


@query("SELECT r_name, count(c_custkey) AS records, count(DISTINCT n_nationkey) AS surveys, count(DISTINCT n_nationkey) FILTER (n_name < 'J') AS confirmed FROM region LEFT JOIN nation ON r_regionkey = n_regionkey LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY 1")
def subjects_facet(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "right").withColumnRenamed("n_nationkey", "key")
    c = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey").select(F.col("c_nationkey").alias("key"), F.col("c_custkey").alias("record"))
    return C.subject_facet(n, c, key="key", subject="r_name", confirmed=F.col("n_name") < "J")


@query("SELECT d.source, count(*) AS records, count(DISTINCT d.lang) AS langs FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) WHERE l.doc_id IS NULL GROUP BY 1")
def unclassified(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "doc_id", "source", "lang")
    return K.unmatched(d, table(spark, sf_dir, "labels", "doc_id"), "doc_id", "doc_id").groupBy("source").agg(F.count("*").alias("records"), F.countDistinct("lang").alias("langs"))


# -- search

_LEXICON = r"""WITH w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(regexp_replace(lower(text), '\S*[0-9_]\S*', ' ', 'g'), '[a-zà-öø-ÿœ][a-zà-öø-ÿœ''-]{2,}'))) AS term FROM documents),
v AS (SELECT term, count(*) AS records FROM w GROUP BY 1 HAVING count(*) >= 2) """


@query(_LEXICON + "SELECT * FROM v")
def lexicon(spark, sf_dir):
    return Q.vocabulary(table(spark, sf_dir, "documents", "text"), "text")


@query(_LEXICON + """, g AS (SELECT term, records, list_distinct([substr('  ' || term || ' ', i, 3) FOR i IN range(1, length(term) + 2)]) AS t, list_distinct([substr('  licence ', i, 3) FOR i IN range(1, 9)]) AS q FROM v WHERE term <> 'licence'),
s AS (SELECT term, records, len(list_intersect(t, q)) / len(list_distinct(list_concat(t, q))) AS similarity FROM g)
SELECT term, records, round(similarity, 6) AS similarity, round(similarity * (1 + ln(greatest(1, records))), 6) AS score FROM s WHERE similarity >= 0.3 ORDER BY similarity * (1 + ln(greatest(1, records))) DESC, term LIMIT 5""")
def suggest(spark, sf_dir):
    return Q.suggest(Q.grams(table(spark, sf_dir, "documents", "text"), "text"), "licence").withColumns({"similarity": F.round("similarity", 6), "score": F.round("score", 6)})


@query("SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS key FROM documents")
def normalize_key(spark, sf_dir):
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", X.normalize_key(F.col("text")).alias("key"))


_STEMMED = "CASE WHEN x LIKE '%ies' AND length(x) >= 5 THEN substr(x, 1, length(x) - 3) || 'y' WHEN x LIKE '%ing' AND length(x) >= 6 THEN substr(x, 1, length(x) - 3) WHEN x LIKE '%es' AND length(x) >= 5 THEN substr(x, 1, length(x) - 2) WHEN x LIKE '%s' AND length(x) >= 4 THEN substr(x, 1, length(x) - 1) ELSE x END"


@query(f"""WITH r AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS x FROM documents),
k AS (SELECT doc_id, {_STEMMED} AS term FROM r WHERE length(x) >= 2 AND x NOT IN ({", ".join(f"'{w}'" for w in "the a an of to in on for and or is are was were your you this that with at by as it be do did have what which how many last all".split())})),
tf AS (SELECT doc_id, term, count(*) AS tf FROM k GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(*) AS n FROM documents),
w AS (SELECT doc_id, term, (1 + ln(tf)) * ln(1 + n / df) AS w, ln(1 + n / df) * CASE term WHEN 'licensed' THEN 1.0 WHEN 'license' THEN 1.0 WHEN 'apache' THEN 0.5 END AS q FROM tf JOIN df USING (term), n),
qn AS (SELECT sqrt(sum(q * q)) AS qnorm FROM (SELECT DISTINCT term, q FROM w WHERE q IS NOT NULL)),
s AS (SELECT doc_id, round(sum(w * q) / (sqrt(sum(w * w)) * any_value(qnorm)), 6) AS score, count(q) AS matched FROM w, qn GROUP BY 1)
SELECT doc_id, score, matched FROM s WHERE matched > 0 ORDER BY score DESC, doc_id LIMIT 20""")
def tfidf_search(spark, sf_dir):
    index = Q.postings(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")
    return Q.tfidf_search(index, key="doc_id", query={"licensed": 1, "license": 1, "apache": 0.5}).drop("terms")


#: The stop list and the synonyms are written out here, so that the library's own are compared with them.
_STOP = "the a an of to in on for and or is are was were your you this that with at by as it be do did have what which how many last all".split()
_TERMS = f"""WITH r AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS x FROM documents),
k AS (SELECT doc_id, {_STEMMED} AS term FROM r WHERE length(x) >= 2 AND x NOT IN ({", ".join(f"'{w}'" for w in _STOP)})),
tf AS (SELECT doc_id, term, count(*) AS tf FROM k GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(*) AS n FROM documents),
w AS (SELECT doc_id, term, (1 + ln(tf)) * ln(1 + n / df) AS w, ln(1 + n / df) AS idf FROM tf JOIN df USING (term), n) """


@query(_TERMS + """, s(term, weight) AS (VALUES ('school', 1.0), ('education', 0.5), ('study', 0.5), ('student', 0.5), ('license', 1.0)),
h AS (SELECT w.*, idf * weight AS q FROM w JOIN s USING (term)), l AS (SELECT sqrt(sum(q * q)) AS l FROM (SELECT DISTINCT term, q FROM h)), m AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1)
SELECT doc_id, round(sum(w * q) / (any_value(norm) * any_value(l)), 6) AS score, count(*) AS matched, string_agg(term, ',' ORDER BY term) AS terms FROM h JOIN m USING (doc_id), l GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 20""")
def registry_search(spark, sf_dir):
    index = Q.postings(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")
    return Q.tfidf_search(index, key="doc_id", query=Q.query_weights("Schools with a license")).withColumn("terms", F.array_join("terms", ","))


@query(_TERMS + r""", v AS (SELECT term, count(*) AS records FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(regexp_replace(lower(text), '\S*[0-9_]\S*', ' ', 'g'), '[a-zà-öø-ÿœ][a-zà-öø-ÿœ''-]{2,}'))) AS term FROM documents) GROUP BY 1 HAVING count(*) >= 2),
g AS (SELECT term, records, list_distinct([substr('  ' || term || ' ', i, 3) FOR i IN range(1, length(term) + 2)]) AS t, list_distinct([substr('  licensd ', i, 3) FOR i IN range(1, 9)]) AS q FROM v),
b AS (SELECT term AS x, len(list_intersect(t, q)) / len(list_distinct(list_concat(t, q))) AS similarity, records FROM g),
best AS (SELECT x, """ + _STEMMED + """ AS term FROM b WHERE similarity >= 0.3 ORDER BY similarity * (1 + ln(greatest(1, records))) DESC, x LIMIT 1),
m AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1)
SELECT doc_id, round(w / norm, 6) AS score, x AS searched FROM w JOIN best USING (term) JOIN m USING (doc_id) ORDER BY score DESC, doc_id LIMIT 20""")
def search_retry(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    return Q.search_or_suggestion(d, key="doc_id", text="text", query="licensd").select("doc_id", "score", "searched")


_HITS = "WITH h AS (SELECT p_partkey, p_name, CASE WHEN lower(p_name) = 'small' THEN 10 WHEN starts_with(lower(p_name), 'small') THEN 5 ELSE 0 END + contains(lower(p_type), 'small')::INT AS rank FROM part WHERE p_size >= 10) "


@query(_HITS + "SELECT p_partkey, p_name, rank, (SELECT count(*) FROM h WHERE rank > 0) AS total FROM h WHERE rank > 0 ORDER BY rank DESC, p_name, p_partkey LIMIT 50")
def search_page(spark, sf_dir):
    return Q.search_page(table(spark, sf_dir, "part", "p_partkey", "p_name", "p_type", "p_size"), name="p_name", body="p_type", key="p_partkey", query="Small", where=F.col("p_size") >= 10)


@query("SELECT page_id, (floor((greatest(page_id, 1) - 1) / 100) * 100 + 1)::BIGINT AS chunk FROM pages")
def doc_chunks(spark, sf_dir):
    return table(spark, sf_dir, "pages", "page_id").select("page_id", X.chunk_start(F.col("page_id")).cast("long").alias("chunk"))


@query(r"SELECT page_id, url, list_aggregate(list_transform(regexp_extract_all(' ' || regexp_replace(url, '([^A-Za-z0-9])', '\1\1', 'g') || ' ', '[^A-Za-z0-9](19[89][0-9]|20[01][0-9]|202[0-6])[^A-Za-z0-9]', 1), x -> x), 'string_agg', ',') AS years FROM pages".replace("x -> x", "lambda x: x"))
def year_extract(spark, sf_dir):
    years = F.array_join(X.years(F.col("url")), ",")
    return table(spark, sf_dir, "pages", "page_id", "url").select("page_id", "url", F.when(years != "", years).alias("years"))


@query("SELECT p_partkey, CASE WHEN regexp_matches(trim(p_brand), '^[A-Za-z][A-Za-z0-9_]{1,31}$') THEN upper(trim(p_brand)) END AS brand, CASE WHEN regexp_matches(trim(p_type), '^[A-Za-z][A-Za-z0-9_]{1,31}$') THEN upper(trim(p_type)) END AS type FROM part")
def mnemonic(spark, sf_dir):
    return table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_type").select("p_partkey", X.mnemonic(F.col("p_brand")).alias("brand"), X.mnemonic(F.col("p_type")).alias("type"))


@query("""SELECT 'all' AS dimension, 'all' AS key, count(*) AS n FROM documents UNION ALL SELECT 'lang', coalesce(lang, 'unknown'), count(*) FROM documents GROUP BY 2 UNION ALL SELECT 'source', coalesce(source, 'unknown'), count(*) FROM documents GROUP BY 2""")
def ingest_rollups(spark, sf_dir):
    return B.rollups(table(spark, sf_dir, "documents", "lang", "source"), ["lang", "source"])


@query("SELECT p_partkey, p_name, p_size FROM part WHERE p_name ILIKE '%r_n%' ORDER BY p_size DESC, p_name, p_partkey LIMIT 50")
def document_browse(spark, sf_dir):
    p = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_size")
    return B.document_browse(p, title="p_name", q="r_n", order=[F.col("p_size").desc(), F.col("p_name"), F.col("p_partkey")])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 1000 AND o_totalprice <= 200000 AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')")
def search_filters(spark, sf_dir):
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus").withColumnRenamed("o_custkey", "survey")
    s = table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment").select(F.col("c_custkey").alias("survey"), F.col("c_mktsegment").alias("subject"))
    kept = o.where(B.filters(equal={"o_orderstatus": "F", "o_orderkey": None}, between={"o_totalprice": (1000, 200000)}))
    return B.with_subject(kept, s, "survey", "BUILDING").select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey, count(l_partkey) AS uses FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY 1")
def component_usage(spark, sf_dir):
    return B.usage(table(spark, sf_dir, "part", "p_partkey"), table(spark, sf_dir, "lineitem", "l_partkey"), "p_partkey", "l_partkey")


@query("SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN (count(*) FILTER (o_orderstatus <> 'O') OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING))::BIGINT END AS number FROM orders WHERE o_orderstatus <> 'O'")
def question_numbers(spark, sf_dir):
    o = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    return B.numbered(o, "o_custkey", ["o_orderdate", "o_orderkey"], F.col("o_orderstatus") != "O").where("number IS NOT NULL").select("o_custkey", "o_orderkey", "number")


@query("SELECT c_custkey, concat_ws(' · ', nullif(trim(c_name), ''), nullif(trim(c_mktsegment), ''), 'p. ' || c_nationkey) AS citation FROM customer")
def citations(spark, sf_dir):
    c = table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    return c.select("c_custkey", X.citation(F.col("c_name"), F.col("c_mktsegment"), F.concat(F.lit("p. "), F.col("c_nationkey").cast("string"))).alias("citation"))


@query("SELECT user_id, list_aggregate(list(event_type ORDER BY ts, event_type), 'string_agg', '>') AS path FROM events WHERE user_id IS NOT NULL GROUP BY 1")
def event_timelines(spark, sf_dir):
    t = B.event_timelines(table(spark, sf_dir, "events", "user_id", "ts", "event_type"), "user_id", "ts", "event_type")
    return t.select("user_id", F.array_join("events.kind", ">").alias("path"))


# -- dashboards, exports and sessions


@query("SELECT day, n, (sum(n) OVER (ORDER BY day))::BIGINT AS running FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1)")
def cumulative_daily(spark, sf_dir):
    return D.cumulative_by_day(table(spark, sf_dir, "events", "ts"), "ts")


@query("SELECT count(*) AS total, floor(avg(value) + 0.5)::BIGINT AS mean_duration, floor(count(*) FILTER (event_type = 'purchase') * 100 / count(*) + 0.5)::BIGINT AS completion_pct FROM events")
def kpis(spark, sf_dir):
    return D.kpis(table(spark, sf_dir, "events", "value", "event_type"), duration="value", completed=F.col("event_type") == "purchase")


@query("""WITH c AS (SELECT count(*) AS n, count(*) FILTER (o_totalprice > 1000) AS a, count(*) FILTER (o_orderstatus <> 'O') AS b, count(*) FILTER (o_orderpriority = '1-URGENT') AS d FROM orders)
SELECT * FROM (SELECT 'started' AS step, 1 AS no, a AS answered, floor(a * 100 / n + 0.5)::BIGINT AS pct FROM c UNION ALL SELECT 'answered', 2, b, floor(b * 100 / n + 0.5)::BIGINT FROM c UNION ALL SELECT 'urgent', 3, d, floor(d * 100 / n + 0.5)::BIGINT FROM c)""")
def completion_funnel(spark, sf_dir):
    return D.funnel(table(spark, sf_dir, "orders"), {"started": F.col("o_totalprice") > 1000, "answered": F.col("o_orderstatus") != "O", "urgent": F.col("o_orderpriority") == "1-URGENT"})


@query("""WITH s AS (SELECT event_type, min(value) AS low, max(value) AS high FROM events GROUP BY 1)
SELECT event_type, least(9, floor((value - low) / CASE WHEN high > low THEN (high - low) / 10 ELSE 1.0 END))::INTEGER AS bin, count(*) AS n FROM events JOIN s USING (event_type) WHERE value IS NOT NULL GROUP BY 1, 2""")
def field_bins(spark, sf_dir):
    return D.bins(table(spark, sf_dir, "events", "event_type", "value"), "event_type", "value")


@query("SELECT c_mktsegment, c_nationkey, n, place FROM (SELECT c_mktsegment, c_nationkey, count(*) AS n, row_number() OVER (PARTITION BY c_mktsegment ORDER BY count(*) DESC, c_nationkey)::INTEGER AS place FROM customer GROUP BY 1, 2) WHERE place <= 5")
def top_values(spark, sf_dir):
    return D.top_values(table(spark, sf_dir, "customer", "c_mktsegment", "c_nationkey"), "c_mktsegment", "c_nationkey")


@query("SELECT c_mktsegment, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def case_pivot(spark, sf_dir):
    o = table(spark, sf_dir, "orders", "o_custkey", "o_orderstatus").join(table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return D.pivot_counts(o, "c_mktsegment", "o_orderstatus", ["F", "O", "P"])


@query("SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'signup') AS signup, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY 1")
def wide_pivot(spark, sf_dir):
    return D.pivot_counts(table(spark, sf_dir, "events", "user_id", "event_type"), "user_id", "event_type", ["click", "error", "purchase", "signup", "view"])


@query("SELECT user_id, event_type AS last_event, value AS last_value, n AS events FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def session_fold(spark, sf_dir):
    return P.fold_sessions(table(spark, sf_dir, "events"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events", "event_id", "props").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


CORPUS_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:fieldwork:corpus")


def _uuid5(name: str) -> str:
    """DuckDB SQL for a name-based UUID: SHA-1 over the namespace's bytes and the name, with version and variant set."""
    h = f"sha1(unhex('{CORPUS_NAMESPACE.hex}') || encode({name}))"
    return f"(SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', 1 + (CAST('0x' || substr(h, 17, 1) AS INTEGER) % 4), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) FROM (SELECT {h} AS h))"


@query(f"SELECT p_partkey, {_uuid5("p_partkey || '|' || p_name")} AS id FROM part")
def variable_ids(spark, sf_dir):
    return table(spark, sf_dir, "part", "p_partkey", "p_name").select("p_partkey", X.uuid5(CORPUS_NAMESPACE, F.concat_ws("|", F.col("p_partkey").cast("string"), "p_name")).alias("id"))
