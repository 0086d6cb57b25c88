"""Queries of the survey and corpus views, the classifiers and the integrity checks, and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldwork.functions import classify as L
from fieldwork.functions import text as X
from fieldwork.operators import browse as B
from fieldwork.operators import confront as K
from fieldwork.operators import metadata as M
from fieldwork.operators import tables as T
from fieldwork.operators import validation as R
from fieldwork.operators import views as V
from fieldwork.operators import search as Q
from fieldwork.plans.catalogue import _LEXICON, CORPUS_NAMESPACE, ORDER_FORM, RULES, _uuid5, query, table

# -- responses, sessions, audit


@query("SELECT event_id, ts, coalesce(CAST(props AS VARCHAR), '{}') AS props FROM events WHERE event_type = 'view'")
def responses_newest(spark, sf_dir):
    e = table(spark, sf_dir, "events", "event_id", "event_type", "ts", "props")
    return V.responses_of(e, F.col("event_type") == "view", newest="ts", answers="props").select("event_id", "ts", "props")


@query("SELECT event_id, ts FROM events WHERE user_id = 7")
def paradata_of_survey(spark, sf_dir):
    return table(spark, sf_dir, "events", "event_id", "user_id", "ts").where("user_id = 7").orderBy("ts", "event_id").select("event_id", "ts")


@query("SELECT c_custkey, count(o_orderkey) AS responses FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def surveys_with_counts(spark, sf_dir):
    c = table(spark, sf_dir, "customer", "c_custkey", "c_acctbal")
    return T.surveys_with_counts(c, table(spark, sf_dir, "orders", "o_custkey").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "c_acctbal").select("c_custkey", "responses")


@query("SELECT doc_id, text FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND text IS NOT NULL")
def instruments_given(spark, sf_dir):
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return table(spark, sf_dir, "documents", "doc_id", "text").where("text IS NOT NULL").join(good, "doc_id")


@query("SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def session_states(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    return V.latest_state(e, "user_id", "at", ["event_type", "value"])


@query("SELECT event_id, value FROM events WHERE event_type = 'purchase' AND user_id IS NOT NULL")
def submitted(spark, sf_dir):
    return table(spark, sf_dir, "events", "event_id", "event_type", "user_id", "value").where("event_type = 'purchase' AND user_id IS NOT NULL").select("event_id", "value")


@query("SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def audit_log(spark, sf_dir):
    return V.newest(table(spark, sf_dir, "events", "event_id", "ts", "event_type"), "ts", "event_id")


@query("SELECT c_custkey, 'SEGMENT@' AS key, c_mktsegment AS value FROM customer UNION ALL SELECT c_custkey, 'NATION@', CAST(c_nationkey AS VARCHAR) FROM customer")
def prefill(spark, sf_dir):
    c = table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment", "c_nationkey")
    seeded = V.prefilled(c, {"c_mktsegment": "SEGMENT", "c_nationkey": "NATION", "c_missing": "NONE"})
    return c.select("c_custkey", F.explode(seeded).alias("key", "value"))


@query("SELECT l_orderkey, l_linenumber, 'qty@order=' || l_orderkey || ';line=' || l_linenumber AS key, 'qty' AS base FROM lineitem")
def instance_keys(spark, sf_dir):
    scope = F.array(F.struct(F.lit("order").alias("name"), F.col("l_orderkey").alias("index")), F.struct(F.lit("line").alias("name"), F.col("l_linenumber").cast("long").alias("index")))
    keyed = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber").withColumn("key", V.instance_key(F.lit("qty"), scope))
    return keyed.withColumn("base", K.base_name(F.col("key")))


# -- corpus rows


@query("SELECT c_custkey, nullif(trim(c_name), '') AS name, nullif(trim(CASE WHEN c_custkey % 3 = 0 THEN '  ' ELSE ' ' || c_mktsegment END), '') AS concept FROM customer")
def corpus_rows(spark, sf_dir):
    c = table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment")
    padded = F.when(F.col("c_custkey") % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), "c_mktsegment"))
    return c.select("c_custkey", *V.corpus_row({"name": F.col("c_name"), "concept": padded}))


@query(r"SELECT p_partkey, regexp_replace(concat_ws(' ', nullif(trim(p_name), ''), nullif(trim(CASE WHEN p_partkey % 2 = 0 THEN ' ' ELSE p_type END), ''), nullif(trim(p_brand), '')), '\s+', ' ', 'g') AS search_text FROM part")
def search_texts(spark, sf_dir):
    p = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_type", "p_brand")
    return p.select("p_partkey", V.search_text(F.col("p_name"), F.when(F.col("p_partkey") % 2 == 0, " ").otherwise(F.col("p_type")), F.col("p_brand")).alias("search_text"))


@query("SELECT page_id, list_extract(string_split(url, '/'), -1) AS title, length(html) AS characters FROM pages")
def document_rows(spark, sf_dir):
    return table(spark, sf_dir, "pages", "page_id", "url", "html").select("page_id", V.title_of(F.col("url")).alias("title"), F.length("html").cast("long").alias("characters"))


_ENTRIES = """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_type END AS question, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_brand END AS concept, p_name AS name FROM part"""


def _entries(spark, sf_dir):
    p = table(spark, sf_dir, "part", "p_partkey", "p_size", "p_type", "p_brand", "p_name")
    q, c = F.when(F.col("p_size") % 3 != 0, F.col("p_type")), F.when(F.col("p_size") % 5 != 0, F.col("p_brand"))
    return p.select("p_partkey", *V.registry_entry(concept=c, question=q, name=F.col("p_name")))


@query(f"SELECT p_partkey, CASE WHEN question IS NULL THEN 'variable' ELSE 'question' END AS component_type, coalesce(concept, question, name) AS label, concat_ws(' ', name, concept, question) AS search_text FROM ({_ENTRIES})")
def registry_entries(spark, sf_dir):
    return _entries(spark, sf_dir)


@query(f"SELECT p_partkey, 'variable' AS component_type, 0.0::DOUBLE AS score FROM ({_ENTRIES}) WHERE question IS NULL ORDER BY p_partkey LIMIT 100")
def registry_browse(spark, sf_dir):
    return V.browse(_entries(spark, sf_dir), type_col="component_type", component="variable", order="p_partkey").select("p_partkey", "component_type", "score")


@query(f"WITH e AS (SELECT CASE WHEN question IS NULL THEN 'variable' ELSE 'question' END AS kind FROM ({_ENTRIES})) SELECT kind, count(*) AS n FROM e GROUP BY 1 UNION ALL SELECT 'all', count(*) FROM e")
def type_facets(spark, sf_dir):
    return V.type_counts(_entries(spark, sf_dir), "component_type")


@query("SELECT doc_id FROM documents WHERE coalesce(lang, '') <> '' AND source IN (SELECT source FROM documents GROUP BY 1 HAVING count(*) > 20)")
def photo_answers(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "doc_id", "lang", "source")
    named = d.groupBy("source").agg(F.count("*").alias("n")).where("n > 20").select("source")
    return d.where(F.coalesce(F.col("lang"), F.lit("")) != "").join(named, "source", "left_semi").select("doc_id")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'fr ' || c_name WHEN c_custkey % 3 = 1 THEN 'en ' || c_name ELSE '' END AS label FROM customer")
def language_pick(spark, sf_dir):
    c = table(spark, sf_dir, "customer", "c_custkey", "c_name")
    en, fr = F.concat(F.lit("en "), "c_name"), F.concat(F.lit("fr "), "c_name")
    texts = F.when(F.col("c_custkey") % 3 == 0, F.create_map(F.lit("en"), en, F.lit("fr"), fr)).when(F.col("c_custkey") % 3 == 1, F.create_map(F.lit("en"), en)).otherwise(F.create_map().cast("map<string,string>"))
    return c.select("c_custkey", V.picked(texts, F.lit("fr")).alias("label"))


@query("SELECT count(*) AS records, round(coalesce(sum(strlen(text)), 0) / 1048576, 1) AS megabytes, round(coalesce(sum(strlen(text)), 0) / nullif(count(*), 0), 1) AS bytes_per_row FROM documents")
def corpus_size(spark, sf_dir):
    return V.table_size(table(spark, sf_dir, "documents", "text"), "text")


@query("""SELECT (SELECT count(DISTINCT p_type) FROM part) AS concepts, (SELECT count(*) FROM (SELECT DISTINCT p_type, p_brand FROM part)) AS conceptual,
(SELECT count(*) FROM (SELECT DISTINCT p_type, p_brand, p_size FROM part)) AS represented, (SELECT count(*) FROM part) AS members""")
def cluster_stats(spark, sf_dir):
    p = table(spark, sf_dir, "part", "p_type", "p_brand", "p_size")
    # one pass for all levels
    return p.agg(F.countDistinct("p_type").alias("concepts"), F.countDistinct("p_type", "p_brand").alias("conceptual"), F.countDistinct("p_type", "p_brand", "p_size").alias("represented"), F.count("*").alias("members"))


@query(_LEXICON + "SELECT count(*) AS terms FROM v")
def vocabulary_size(spark, sf_dir):
    return Q.vocabulary(table(spark, sf_dir, "documents", "text"), "text").agg(F.count("*").alias("terms"))


@query("SELECT p_type, arg_min(p_brand, p_partkey) FILTER (p_size % 4 <> 0) AS universe FROM part GROUP BY 1")
def first_universe(spark, sf_dir):
    p = table(spark, sf_dir, "part", "p_partkey", "p_type", "p_brand", "p_size").withColumn("universe", F.when(F.col("p_size") % 4 != 0, F.col("p_brand")))
    return V.first_given(p, ["p_type"], "universe", "p_partkey")


_NORMAL = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


@query(f"SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN {_NORMAL.format('p_type')} ELSE {_NORMAL.format('p_name')} END AS meaning, CASE WHEN p_size % 3 = 0 THEN 'none' ELSE '1=' || {_NORMAL.format('p_brand')} || '|2=' || {_NORMAL.format('p_type')} END AS representation FROM part")
def meanings(spark, sf_dir):
    p = table(spark, sf_dir, "part", "p_partkey", "p_size", "p_type", "p_name", "p_brand")
    concept = F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(F.lit(" -- "))
    code = lambda c, label: F.struct(F.lit(c).alias("code"), F.col(label).alias("label"))
    codes = F.when(F.col("p_size") % 3 == 0, F.array().cast("array<struct<code:string,label:string>>")).otherwise(F.array(code("1", "p_brand"), code("2", "p_type")))
    return p.select("p_partkey", V.meaning_of(concept, F.col("p_name")).alias("meaning"), V.representation_of(codes).alias("representation"))


@query(f"SELECT p_partkey, {_uuid5("'concept:' || p_type")} AS concept_id, {_uuid5("'conceptual-variable:' || p_type || ':' || p_brand")} AS conceptual_variable_id, {_uuid5("'represented-variable:' || p_type || ':' || p_brand || ':' || p_size")} AS represented_variable_id FROM part")
def cascade_ids(spark, sf_dir):
    p = table(spark, sf_dir, "part", "p_partkey", "p_type", "p_brand", "p_size")
    ids = V.cascade_ids(CORPUS_NAMESPACE, F.col("p_type"), F.col("p_brand"), F.col("p_size").cast("string"))
    return p.select("p_partkey", *(c.alias(n) for n, c in ids.items()))


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE')")
def cluster_lookup(spark, sf_dir):
    r = table(spark, sf_dir, "region", "r_regionkey", "r_name").where(F.col("r_name").isin("ASIA", "EUROPE"))
    n = table(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey").join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf_dir, "customer", "c_custkey", "c_nationkey").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")


@query("SELECT n_name, c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2")
def label_lookups(spark, sf_dir):
    n = table(spark, sf_dir, "nation", "n_nationkey", "n_name")
    return table(spark, sf_dir, "customer", "c_nationkey", "c_mktsegment").join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name", "c_mktsegment").agg(F.count("*").alias("n"))


_CONCEPTS = "SELECT p_brand AS label, p_brand || '/' || p_type AS concept_id, count(DISTINCT p_partkey % 7) AS years, count(*) AS occurrences, count(DISTINCT p_size) AS representations FROM part GROUP BY p_brand, p_type"


@query(f"SELECT concept_id, years, occurrences FROM ({_CONCEPTS}) WHERE years >= 2 AND representations > 1 AND contains(label, '1') ORDER BY years DESC, occurrences DESC, label, concept_id LIMIT 50")
def concept_page(spark, sf_dir):
    p = table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_type", "p_size")
    levels = [F.countDistinct(F.col("p_partkey") % 7).alias("years"), F.count("*").alias("occurrences"), F.countDistinct("p_size").alias("representations")]
    c = p.groupBy("p_brand", "p_type").agg(*levels).withColumn("label", F.col("p_brand")).withColumn("concept_id", F.concat_ws("/", "p_brand", "p_type"))
    return V.concept_page(c.where(F.col("label").contains("1")), q=None, least_years=2, changed_only=True).select("concept_id", "years", "occurrences")


@query("SELECT count(*) AS total, count(*) FILTER (regexp_matches(lower(p_name), '(^|[^a-z0-9])part([^a-z0-9]|$)')) AS named FROM part")
def concept_words(spark, sf_dir):
    c = table(spark, sf_dir, "part", "p_partkey", "p_name").select(F.col("p_name").alias("label"), F.col("p_partkey").cast("string").alias("concept_id"), F.lit(1).alias("years"), F.lit(1).alias("occurrences"), F.lit(1).alias("representations"))
    named = c.where(F.array_contains(F.split(F.lower("label"), "[^a-z0-9]+"), "part"))
    return c.agg(F.count("*").alias("total")).join(named.agg(F.count("*").alias("named")))


@query("SELECT source, count(*) AS n FROM documents GROUP BY 1")
def count_order(spark, sf_dir):
    return V.counted(table(spark, sf_dir, "documents", "source"), "source")


@query("SELECT DISTINCT source FROM documents")
def survey_groups(spark, sf_dir):
    return table(spark, sf_dir, "documents", "source").distinct()


@query("SELECT 'part' AS instrument, CAST(p_partkey AS VARCHAR) AS entry, p_name AS label FROM part UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), c_name FROM customer")
def catalog_union(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.lit("part").alias("instrument"), F.col("p_partkey").cast("string").alias("entry"), F.col("p_name").alias("label"))
    return p.unionByName(table(spark, sf_dir, "customer").select(F.lit("customer").alias("instrument"), F.col("c_custkey").cast("string").alias("entry"), F.col("c_name").alias("label")))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'")
def flag_filters(spark, sf_dir):
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority", "o_custkey")
    return o.where(B.filters(equal={"o_orderstatus": "O", "o_orderpriority": "1-URGENT", "o_custkey": None})).select("o_orderkey", "o_totalprice")


@query("SELECT page_id, url FROM pages WHERE url = (SELECT min(url) FROM pages) ORDER BY page_id LIMIT 1")
def document_lookup(spark, sf_dir):
    p = table(spark, sf_dir, "pages", "page_id", "url")
    first = p.agg(F.min("url").alias("path"))
    return p.join(F.broadcast(first), F.col("url") == F.col("path")).orderBy("page_id").limit(1).select("page_id", "url")


# -- cases


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'")
def cases_with_codes(spark, sf_dir):
    codes = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return V.with_codes(table(spark, sf_dir, "customer", "c_custkey"), codes, "c_custkey")


@query("SELECT c_custkey, count(o_orderkey) AS total, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def interviewer_cases(spark, sf_dir):
    return V.workload(table(spark, sf_dir, "customer", "c_custkey"), table(spark, sf_dir, "orders", "o_custkey", "o_orderstatus"), worker="c_custkey", assigned="o_custkey", status="o_orderstatus", values=["F", "O", "P"])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = (SELECT min(c_custkey) FROM customer JOIN orders ON c_custkey = o_custkey)")
def access_codes(spark, sf_dir):
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    first = o.join(table(spark, sf_dir, "customer", "c_custkey"), F.col("o_custkey") == F.col("c_custkey")).agg(F.min("c_custkey").alias("case_id"))
    codes = first.withColumn("code", F.lit("AB12"))
    cases = o.withColumnRenamed("o_custkey", "case_id")
    return T.case_of_code(cases, codes, " ab12 ").select("o_orderkey", "o_totalprice")


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'new' WHEN 'P' THEN 'callback' ELSE 'other' END AS status,
row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'P' THEN 4 ELSE 7 END, o_orderdate, o_orderkey) AS place FROM orders""")
def case_queue(spark, sf_dir):
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_orderdate")
    o = o.withColumn("status", F.when(F.col("o_orderstatus") == "O", "new").when(F.col("o_orderstatus") == "P", "callback").otherwise("other"))
    return T.case_queue(o, "status", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "status", "place")


@query("SELECT instrument, item, 1 + count(*) FILTER (brk) OVER (PARTITION BY instrument ORDER BY item ROWS UNBOUNDED PRECEDING) - CASE WHEN first_value(brk) OVER (PARTITION BY instrument ORDER BY item) THEN 1 ELSE 0 END AS page FROM (SELECT user_id AS instrument, event_id AS item, event_id % 7 = 3 AS brk FROM events)")
def pagination(spark, sf_dir):
    items = table(spark, sf_dir, "events", "user_id", "event_id").select(F.col("user_id").alias("instrument"), F.col("event_id").alias("item"))
    return T.pages_of(items, "item", F.col("item") % 7 == 3).select("instrument", "item", "page")


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 2 THEN '1.2' ELSE '1.2.' || p_size % 3 END AS version,
CASE WHEN p_size % 3 = 1 THEN 'old' ELSE 'new' END AS body FROM part""")
def survey_upsert(spark, sf_dir):
    p = table(spark, sf_dir, "part", "p_partkey", "p_size")
    # 1.2.1 is above 1.2, and 1.2.0 and 1.2 are equal: then the incoming row wins
    stored = p.select("p_partkey", F.when(F.col("p_size") % 3 == 2, "1.2.0").otherwise(F.concat(F.lit("1.2."), (F.col("p_size") % 3).cast("string"))).alias("version"), F.lit("old").alias("body"))
    incoming = p.select("p_partkey", F.when(F.col("p_size") % 3 == 0, "1.2.0").otherwise("1.2").alias("version"), F.lit("new").alias("body"))
    return T.upsert_surveys(stored, incoming, "p_partkey", "version")


@query("""SELECT p_partkey, p_size % 7 >= 2 OR (p_size % 7 = 1 AND p_size % 5 >= 0) AS at_least FROM part""")
def version_order(spark, sf_dir):
    p = table(spark, sf_dir, "part", "p_partkey", "p_size")
    mine = F.concat((F.col("p_size") % 7).cast("string"), F.lit("."), (F.col("p_size") % 5).cast("string"), F.lit("b"))
    return p.select("p_partkey", (X.version_key(mine) >= X.version_key(F.lit("1.0.0"))).alias("at_least"))


# -- checks


@query("SELECT o_orderkey, (count(*) FILTER (o_orderstatus = 'F') OVER (PARTITION BY o_orderpriority) - CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS before FROM orders")
def past_dispositions(spark, sf_dir):
    return V.past_dispositions(table(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority", "o_orderstatus"), check="o_orderpriority", key="o_orderkey", decided=F.col("o_orderstatus") == "F")


@query("""WITH f AS (SELECT event_id, event_type, value, CASE event_type WHEN 'view' THEN 'accept' WHEN 'click' THEN 'correct' WHEN 'purchase' THEN 'follow-up' ELSE 'suppress' END AS action FROM events)
SELECT 'flag' AS target, CASE action WHEN 'accept' THEN 'accepted' WHEN 'correct' THEN 'corrected' WHEN 'follow-up' THEN 'follow_up' ELSE 'suppressed' END AS status, count(*) AS n FROM f GROUP BY 2
UNION ALL SELECT 'suppression', action, count(*) FROM f WHERE action IN ('accept', 'suppress') GROUP BY 2 UNION ALL SELECT 'correction', action, count(*) FROM f WHERE action = 'correct' AND value IS NOT NULL GROUP BY 2""")
def dispositions(spark, sf_dir):
    t = F.col("event_type")
    e = table(spark, sf_dir, "events", "event_id", "event_type", "value").withColumn("action", F.when(t == "view", "accept").when(t == "click", "correct").when(t == "purchase", "follow-up").otherwise("suppress"))
    out = V.disposed(e, action="action", instance="event_type", corrected="value")
    parts = [out["flags"].select(F.lit("flag").alias("target"), "status"), out["suppressions"].select(F.lit("suppression"), "action"), out["corrections"].select(F.lit("correction"), "action")]
    return parts[0].union(parts[1]).union(parts[2]).groupBy("target", "status").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderkey % 2 = 0 THEN '$clerk == ''' || o_clerk || '''' ELSE '$total == ' || o_custkey END AS rule FROM (SELECT *, replace(o_orderpriority, '-', '''') AS raw, replace(replace(o_orderpriority, '-', ''''), '''', chr(92) || '''') AS o_clerk FROM orders)")
def rule_drafts(spark, sf_dir):
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority", "o_custkey")
    even = F.col("o_orderkey") % 2 == 0
    observed = F.when(even, F.replace("o_orderpriority", F.lit("-"), F.lit("'"))).otherwise(F.col("o_custkey").cast("string"))
    action = F.when(F.col("o_orderstatus") == "P", "follow-up").otherwise("accept")
    return o.select("o_orderkey", V.drafted_rule(F.when(even, "clerk").otherwise("total"), observed, even, action).alias("rule"))


@query("""WITH r AS (SELECT l_orderkey, l_extendedprice AS price, l_quantity AS quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_extendedprice DESC, l_quantity DESC) = 1),
c AS (SELECT o_orderkey, 'o_totalprice' AS variable, o_totalprice::DOUBLE AS observed, price::DOUBLE AS reference, abs(o_totalprice - price) / abs(price) * 100 <= 20 AS matches FROM orders LEFT JOIN r ON o_orderkey = l_orderkey
UNION ALL SELECT o_orderkey, 'o_custkey', o_custkey::DOUBLE, quantity::DOUBLE, o_custkey = quantity FROM orders LEFT JOIN r ON o_orderkey = l_orderkey) SELECT * FROM c""")
def confront_mappings(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    r = r.withColumn("place", F.struct("l_linenumber", "l_extendedprice", "l_quantity"))
    return V.confront_mappings(table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice", "o_custkey"), r, key="o_orderkey", ref_key="l_orderkey", order="place", mappings={"o_totalprice": "l_extendedprice", "o_custkey": "l_quantity"}, tolerance={"o_totalprice": {"pct": 20.0}})


@query("""WITH r AS (SELECT user_id, event_type = 'error' AND value < 20 AS fatal, event_type = 'purchase' AS reached, event_id % 3 AS failed, event_id % 2 AS console, event_id % 100 AS ms FROM events)
SELECT count(*) AS total, count(*) FILTER (reached) AS completed, sum(ms)::BIGINT AS duration_ms, count(*) FILTER (fatal) AS fatal_error, count(*) FILTER (NOT fatal AND NOT reached) AS dead_end,
coalesce(sum(failed) FILTER (NOT fatal), 0)::BIGINT AS step_failed, coalesce(sum(console) FILTER (NOT fatal), 0)::BIGINT AS console_error FROM r""")
def bot_totals(spark, sf_dir):
    e = table(spark, sf_dir, "events", "event_id", "event_type", "value").withColumn("ms", F.col("event_id") % 100)
    fatal = F.coalesce((F.col("event_type") == "error") & (F.col("value") < 20), F.lit(False))
    return V.bot_totals(e, fatal=fatal, reached=F.col("event_type") == "purchase", failed_steps=F.col("event_id") % 3, console_errors=F.col("event_id") % 2, duration="ms")


_PARSED = "SELECT l_orderkey, count(*) * 4 AS variables, count(*) FILTER (l_returnflag <> 'A') * 4 + 1 AS headers, count(*) FILTER (l_linestatus = 'F' AND l_quantity > 40) AS coded FROM lineitem GROUP BY 1"


def _parsed(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_returnflag", "l_linestatus", "l_quantity")
    return li.groupBy("l_orderkey").agg((F.count("*") * 4).alias("variables"), (F.count_if(F.col("l_returnflag") != "A") * 4 + 1).alias("headers"), F.count_if((F.col("l_linestatus") == "F") & (F.col("l_quantity") > 40)).alias("coded"))


_NOTES = f"""SELECT l_orderkey, variables || ' variables from ' || headers || ' header rows' AS note FROM ({_PARSED}) WHERE variables < headers * 0.9
UNION ALL SELECT l_orderkey, coded || '/' || variables || ' variables carry a code list' FROM ({_PARSED}) WHERE variables >= 20 AND coded / variables < 0.15"""


@query(_NOTES)
def parse_notes(spark, sf_dir):
    return V.parse_notes(_parsed(spark, sf_dir), key="l_orderkey", headers="headers", variables="variables", coded="coded")


@query(f"WITH n AS ({_NOTES}) SELECT * FROM n UNION ALL SELECT l_orderkey, 'unclassified' FROM ({_PARSED}) WHERE coded = 0 AND l_orderkey NOT IN (SELECT l_orderkey FROM n)")
def silent_notes(spark, sf_dir):
    parsed = _parsed(spark, sf_dir)
    notes = V.parse_notes(parsed, key="l_orderkey", headers="headers", variables="variables", coded="coded")
    return V.silent_notes(parsed, notes, "l_orderkey", unclassified=F.col("coded") == 0)


@query("SELECT DISTINCT c_mktsegment, c_nationkey FROM customer EXCEPT SELECT c_mktsegment, c_nationkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus = 'P' AND o_totalprice > 490000")
def coverage_gaps(spark, sf_dir):
    c = table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment", "c_nationkey")
    done = c.join(table(spark, sf_dir, "orders", "o_custkey", "o_orderstatus", "o_totalprice").where("o_orderstatus = 'P' AND o_totalprice > 490000"), F.col("c_custkey") == F.col("o_custkey"))
    return V.uncovered(c, done, ["c_mktsegment", "c_nationkey"])


@query("SELECT count(*) FILTER (l_returnflag = 'R') AS hard, count(*) FILTER (l_returnflag = 'A') AS soft FROM lineitem WHERE l_linestatus = 'F'")
def fired_edits(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem", "l_linestatus", "l_returnflag")
    items = li.select(F.when(F.col("l_linestatus") == "F", "question").otherwise("text").alias("kind"), F.when(F.col("l_returnflag") == "R", "hard").when(F.col("l_returnflag") == "A", "soft").alias("edit"))
    return V.fired_edits(items, kind="kind", edit="edit")


@query("""WITH c AS (SELECT l_orderkey, l_returnflag AS r, l_linestatus AS k, CASE WHEN l_quantity > 5 THEN l_quantity END AS v FROM lineitem WHERE NOT (l_returnflag = 'A' AND l_linestatus = 'F'))
SELECT l_orderkey, coalesce(r, 'TOT') AS r, coalesce(k, 'TOT') AS k, sum(v) AS total FROM c GROUP BY GROUPING SETS ((l_orderkey, r), (l_orderkey, k), (l_orderkey))""")
def response_table_totals(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_returnflag", "l_linestatus", "l_quantity")
    cells = li.select("l_orderkey", F.col("l_returnflag").alias("r"), F.col("l_linestatus").alias("k"), F.when(F.col("l_quantity") > 5, F.col("l_quantity")).alias("v"))
    disabled = spark.createDataFrame([("A", "F")], "r string, k string")
    return V.cell_totals(cells, disabled, response="l_orderkey", row="r", column="k", value="v")


@query("SELECT l_orderkey AS instrument, count(*) AS questions, count(*) FILTER (l_returnflag = 'R') AS required FROM lineitem GROUP BY 1")
def question_counts(spark, sf_dir):
    return table(spark, sf_dir, "lineitem", "l_orderkey", "l_returnflag").groupBy(F.col("l_orderkey").alias("instrument")).agg(F.count("*").alias("questions"), F.count_if(F.col("l_returnflag") == "R").alias("required"))


# -- integrity


@query("""SELECT 'duplicate' AS issue, p_name AS what FROM part GROUP BY p_name HAVING count(*) > 1
UNION ALL SELECT 'dangling', CAST(l_orderkey AS VARCHAR) || ':' || l_suppkey FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 10 <> 0)
UNION ALL SELECT 'reserved', c_mktsegment FROM (SELECT DISTINCT c_mktsegment FROM customer) WHERE c_mktsegment IN ('BUILDING', 'CONSENT_CAMERA')
UNION ALL SELECT 'code', event_type FROM (SELECT DISTINCT event_type FROM events) WHERE contains(event_type, '_') OR event_type = 'TOT'""")
def instrument_integrity(spark, sf_dir):
    part, s = table(spark, sf_dir, "part", "p_name"), table(spark, sf_dir, "supplier", "s_suppkey").where("s_suppkey % 10 <> 0")
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey")
    found = V.duplicate_names(part, "p_name").select(F.lit("duplicate").alias("issue"), F.col("p_name").alias("what"))
    lost = V.dangling(li, s, ref="l_suppkey", target="s_suppkey", key="l_orderkey").select(F.lit("dangling"), F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_suppkey").cast("string")))
    held = V.reserved_names(table(spark, sf_dir, "customer", "c_mktsegment").distinct(), "c_mktsegment", ("BUILDING", "CONSENT_CAMERA")).select(F.lit("reserved"), "c_mktsegment")
    codes = V.ambiguous_codes(table(spark, sf_dir, "events", "event_type").distinct(), "event_type").select(F.lit("code"), "event_type")
    return found.union(lost).union(held).union(codes)


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice > 100000 AND NOT (o_orderkey % 4 = 0) AND NOT (o_orderstatus = 'F' AND o_orderkey % 3 <> 0)")
def consent_traps(spark, sf_dir):
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_totalprice")
    s = F.when(F.col("o_orderstatus") == "F", "geolocation").when(F.col("o_orderstatus") == "O", "photo").otherwise("none")
    consent = F.when(s == "photo", "$CONSENT_CAMERA == 'granted'").otherwise("$CONSENT_GEO == 'granted'")
    q = o.select("o_orderkey", s.alias("sensor"), (F.col("o_totalprice") > 100000).alias("required"), (F.col("o_orderkey") % 3 != 0).alias("fallback"), F.when(F.col("o_orderkey") % 4 == 0, consent).alias("visible"))
    return V.consent_traps(q, sensor="sensor", required="required", fallback="fallback", visible="visible", names={"photo": "CONSENT_CAMERA", "geolocation": "CONSENT_GEO"}).select("o_orderkey")


# -- dashboards


@query("""WITH a AS (SELECT event_type AS key, CASE WHEN event_id % 11 = 0 THEN 'string' ELSE 'number' END AS kind, CAST(value AS VARCHAR) AS v, value FROM events WHERE event_type <> 'signup' AND value IS NOT NULL
UNION ALL SELECT 'flag', 'boolean', CASE WHEN event_id % 4 = 0 THEN 'true' ELSE 'false' END, NULL FROM events UNION ALL SELECT 'choice', 'string', event_type, NULL FROM events),
h AS (SELECT key, count(*) AS n, count(*) FILTER (kind = 'number') AS numbers, count(*) FILTER (kind = 'boolean') AS booleans, count(*) FILTER (kind = 'string') AS strings, avg(value) FILTER (kind = 'number') AS mean,
count(*) FILTER (kind = 'boolean' AND v = 'true') AS trues, count(DISTINCT CASE WHEN kind = 'string' THEN v END) AS d FROM a GROUP BY 1),
t AS (SELECT *, CASE WHEN numbers > 0.8 * n THEN 'numeric' WHEN booleans > 0.8 * n THEN 'boolean' WHEN strings > 0 AND d BETWEEN 2 AND 12 THEN 'categorical' END AS type FROM h)
SELECT key, type, n, CASE type WHEN 'numeric' THEN n * 3 WHEN 'boolean' THEN n * 2 ELSE n + 10 - d END AS score, round(CASE type WHEN 'numeric' THEN mean WHEN 'boolean' THEN trues / booleans * 100 ELSE d END, 6) AS detail
FROM t WHERE type IS NOT NULL ORDER BY score DESC, key LIMIT 3""")
def field_kinds(spark, sf_dir):
    e = table(spark, sf_dir, "events", "event_id", "event_type", "value")
    numbers = e.where("event_type <> 'signup' AND value IS NOT NULL").select(F.col("event_type").alias("key"), F.when(F.col("event_id") % 11 == 0, "string").otherwise("number").alias("kind"), F.col("value").cast("string").alias("v"))
    flags = e.select(F.lit("flag").alias("key"), F.lit("boolean").alias("kind"), F.when(F.col("event_id") % 4 == 0, "true").otherwise("false").alias("v"))
    choices = e.select(F.lit("choice").alias("key"), F.lit("string").alias("kind"), F.col("event_type").alias("v"))
    return V.field_kinds(numbers.unionByName(flags).unionByName(choices), key="key", kind="kind", value="v").withColumn("detail", F.round("detail", 6))


@query("SELECT CASE event_type WHEN 'view' THEN 'Viewed' WHEN 'click' THEN 'Clicked' ELSE event_type END AS label, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1")
def labelled_frequencies(spark, sf_dir):
    return V.frequencies(table(spark, sf_dir, "events", "event_type"), "event_type", {"view": "Viewed", "click": "Clicked"})


@query("SELECT * FROM (SELECT 'big' AS choice, count(*) FILTER (p_size > 40) AS n FROM part UNION ALL SELECT 'small', count(*) FILTER (p_size < 5) FROM part UNION ALL SELECT 'none', count(*) FILTER (p_size < 0) FROM part) WHERE n > 0")
def mark_all(spark, sf_dir):
    return V.marked(table(spark, sf_dir, "part", "p_size"), {"big": F.col("p_size") > 40, "small": F.col("p_size") < 5, "none": F.col("p_size") < 0})


# -- text forms


@query("""SELECT o_orderkey, format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) AS whole, CASE WHEN o_custkey < 1024 THEN format('{:,}', o_custkey) || ' B' ELSE printf('%.1f', floor(o_custkey / 1024.0 * 10 + 0.5) / 10) || ' KiB' END AS bytes,
CASE WHEN o_custkey % 5 = 0 THEN '—' ELSE printf('%.1f', (o_custkey % 5) / 5.0 * 100) || '%' END AS share, CASE WHEN o_custkey % 3 = 0 THEN '—' WHEN o_custkey % 3 = 1 THEN '2001' ELSE '2001–2003' END AS years,
'| a' || chr(92) || '|b | ' || o_orderpriority || ' |' AS line FROM orders""")
def report_forms(spark, sf_dir):
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    k = F.col("o_custkey")
    low, high = F.when(k % 3 != 0, F.lit(2001)), F.when(k % 3 == 1, 2001).when(k % 3 == 2, 2003)
    total = F.when(k % 5 == 0, 0).otherwise(5)
    return o.select("o_orderkey", V.grouped_int(F.floor("o_totalprice")).alias("whole"), V.byte_size(k).alias("bytes"), V.percentage(k % 5, total).alias("share"), V.year_range(low, high).alias("years"), V.markdown_row(F.lit("a|b"), F.col("o_orderpriority")).alias("line"))


@query("SELECT p_partkey, 'urn:ddi:int.example:' || regexp_replace(replace(p_brand || '.' || p_type, '.', '@'), '[^A-Za-z0-9*@$_-]', '_', 'g') || ':1.0' AS urn FROM part")
def ddi_urns(spark, sf_dir):
    return table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_type").select("p_partkey", V.ddi_urn(F.lit("int.example"), F.concat_ws(".", "p_brand", "p_type"), F.lit("1.0")).alias("urn"))


@query("SELECT c_custkey, floor(c_acctbal / 7 * 1000 + 0.5) / 1000 AS reading FROM customer")
def device_precision(spark, sf_dir):
    return table(spark, sf_dir, "customer", "c_custkey", "c_acctbal").select("c_custkey", V.at_precision(F.col("c_acctbal") / 7, 3).alias("reading"))


@query("""SELECT user_id, '"' || coalesce(click, '') || '","' || coalesce(purchase, '') || '","' || coalesce(view, '') || '"' AS line FROM (
SELECT user_id, max('n' || chr(34) || chr(34) || event_id) FILTER (event_type = 'click') AS click, max('n' || chr(34) || chr(34) || event_id) FILTER (event_type = 'purchase') AS purchase, max('n' || chr(34) || chr(34) || event_id) FILTER (event_type = 'view') AS view FROM events GROUP BY 1)""")
def responses_csv(spark, sf_dir):
    e = table(spark, sf_dir, "events", "user_id", "event_type", "event_id").where(F.col("event_type").isin("click", "purchase", "view"))
    users = table(spark, sf_dir, "events", "user_id").distinct()
    cells = e.groupBy("user_id", "event_type").agg(F.max(F.concat(F.lit('n"'), F.col("event_id").cast("string"))).alias("v"))
    maps = cells.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("m"))
    keys = F.array(*map(F.lit, ("click", "purchase", "view")))
    held = users.join(maps.withColumnRenamed("user_id", "u"), F.col("user_id").eqNullSafe(F.col("u")), "left")
    return held.select("user_id", V.csv_line(F.coalesce("m", F.create_map().cast("map<string,string>")), keys).alias("line"))


# -- archive files: paths written from the columns of parts, which the oracle takes what they tell from

_ARCHIVE = """SELECT *, chr(65 + b % 26) || chr(65 + b * 7 % 26) || chr(65 + b * 3 % 26) || 'S' AS one, chr(65 + b * 5 % 26) || chr(65 + b * 11 % 26) || chr(65 + b * 9 % 26) || 'Q' AS other, 1990 + p_size % 30 AS y
FROM (SELECT *, CAST(substr(p_brand, 7) AS INT) AS b, CASE length(p_name) % 3 WHEN 0 THEN '15.2' WHEN 1 THEN '3' ELSE '11.1' END AS code, CASE p_size % 2 WHEN 0 THEN 'eng' ELSE 'fra' END AS tag FROM part)"""
_PATHS = (
    "one || '_' || other || '/' || one || '_' || other || '_' || y || '_' || (y + 1) || '/' || one || '_' || y || '_' || (y + 1) || '_T' || code || '_v1_' || tag || '.pdf'",
    "one || '_' || other || '/' || one || '_T4_DataDictionary_January' || y || '.pdf'",
    "one || '_' || other || '_' || y || '/' || p_partkey || 'x_' || one || '-' || other || '_C' || y || '_T' || code || '_' || tag || '.doc'",
    "one || '_' || other || '/notes T0' || substr('4579', p_size % 4 + 1, 1) || '.2.pdf'",
    "one || '_' || other || '/Guide de l''utilisateur ' || y || '.docx'",
)
_FILES = f"""SELECT p_partkey,
  CASE f WHEN 1 THEN 'T4' WHEN 3 THEN 'T' || substr('4579', p_size % 4 + 1, 1) || '.2' WHEN 4 THEN NULL ELSE 'T' || code END AS tcode,
  CASE WHEN f = 1 THEN 'data-dictionary' WHEN f = 3 THEN 'reference' WHEN f = 4 THEN 'user-guide' WHEN code = '15.2' THEN 'data-dictionary' WHEN code = '3' THEN 'record-layout' ELSE 'alphabetic-index' END AS doc_kind,
  one AS survey_acronym, CASE f WHEN 0 THEN y || '_' || (y + 1) WHEN 2 THEN y::VARCHAR END AS cycle, CASE WHEN f IN (0, 2, 4) THEN y::INT END AS year,
  CASE WHEN f IN (0, 2) THEN CASE tag WHEN 'eng' THEN 'en' ELSE 'fr' END WHEN f = 1 THEN 'en' WHEN f = 4 THEN 'fr' ELSE 'unknown' END AS lang
FROM (SELECT *, p_partkey % {len(_PATHS)} AS f FROM ({_ARCHIVE}))"""


def _files(spark, sf_dir):
    p = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_size").withColumn("b", F.substr("p_brand", F.lit(7)).cast("int"))
    letters = lambda *ks: F.concat(*(F.chr((65 + F.col("b") * k % 26).cast("int")) for k in ks))
    p = p.withColumns({
        "one": F.concat(letters(1, 7, 3), F.lit("S")),
        "other": F.concat(letters(5, 11, 9), F.lit("Q")),
        "y": 1990 + F.col("p_size") % 30,
        "code": F.when(F.length("p_name") % 3 == 0, "15.2").when(F.length("p_name") % 3 == 1, "3").otherwise("11.1"),
        "tag": F.when(F.col("p_size") % 2 == 0, "eng").otherwise("fra"),
    })
    written = F.coalesce(*(F.when(F.col("p_partkey") % len(_PATHS) == i, F.expr(x.replace("l''u", "l\\'u"))) for i, x in enumerate(_PATHS)))
    return L.classified(p.select("p_partkey", written.alias("path")), "path").select("p_partkey", "file.*")


@query(_FILES)
def classified_files(spark, sf_dir):
    return _files(spark, sf_dir).select("p_partkey", "tcode", "doc_kind", "survey_acronym", "cycle", "year", "lang")


@query(f"WITH f AS ({_FILES}) SELECT doc_kind, lang, count(*) AS files, count(tcode) AS coded, min(year) AS first_year FROM f GROUP BY 1, 2")
def ingest_report(spark, sf_dir):
    return _files(spark, sf_dir).groupBy("doc_kind", "lang").agg(F.count("*").alias("files"), F.count("tcode").alias("coded"), F.min("year").alias("first_year"))


@query(f"WITH f AS ({_FILES}) SELECT p_partkey, tcode FROM f WHERE tcode = 'T15' OR starts_with(tcode, 'T15.') ORDER BY p_partkey LIMIT 25")
def ingest_selection(spark, sf_dir):
    return V.chosen_files(_files(spark, sf_dir).select("p_partkey", "tcode"), key="p_partkey", family="T15", code="tcode", seed=1, share=None, limit=25)


@query("""SELECT p_partkey, s AS subject FROM (SELECT p_partkey, unnest(CASE WHEN starts_with(p_name, 'small') THEN ['Health', 'Children and youth'] WHEN starts_with(p_name, 'old') THEN ['Labour', 'Income, pensions, spending and wealth'] WHEN starts_with(p_name, 'red') THEN ['Housing'] ELSE [] END) AS s FROM part)""")
def subject_hints(spark, sf_dir):
    """Titles are parts' names, some of their words replaced by what such titles say."""
    title = F.col("p_name")
    for word, said in (("small", "Survey of Child Nutrition:"), ("old", "Workplace Earnings Panel:"), ("red", "Dwelling Counts:")):
        title = F.regexp_replace(title, f"^{word}", said)
    return table(spark, sf_dir, "part", "p_partkey", "p_name").select("p_partkey", F.explode(L.subjects(title)).alias("subject"))


@query("SELECT conv_id, turn, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS block FROM conversations QUALIFY block > 0")
def variable_blocks(spark, sf_dir):
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "role")
    return V.header_blocks(c, document="conv_id", order=["turn"], header=F.col("role") == "user").select("conv_id", "turn", "block")


@query("""WITH RECURSIVE items AS (
  SELECT l_orderkey AS page, l_linenumber * 7.0 AS x, floor(l_quantity / 3) AS y, l_discount * 60 AS w, l_returnflag AS t,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY floor(l_quantity / 3) DESC, l_linenumber, l_returnflag, l_discount) AS i FROM lineitem
), walked AS (
  SELECT page, i, x, w, t, y AS anchor, 0 AS row FROM items WHERE i = 1
  UNION ALL SELECT n.page, n.i, n.x, n.w, n.t, CASE WHEN abs(n.y - anchor) > 2 THEN n.y ELSE anchor END, CASE WHEN abs(n.y - anchor) > 2 THEN row + 1 ELSE row END
  FROM walked p JOIN items n ON n.page = p.page AND n.i = p.i + 1
), spaced AS (SELECT *, CASE WHEN x - lag(x + w) OVER o >= 2.5 THEN '   ' ELSE '' END || t AS part FROM walked WINDOW o AS (PARTITION BY page, row ORDER BY x, i))
SELECT page, row::INT AS row, string_agg(part, '' ORDER BY x, i) AS line FROM spaced GROUP BY page, row""")
def page_rows(spark, sf_dir):
    """Rows of text items on a page; the oracle walks from item to item."""
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag")
    items = li.select(F.col("l_orderkey").alias("page"), (F.col("l_linenumber") * 7.0).alias("x"), F.floor(F.col("l_quantity") / 3).cast("double").alias("y"), (F.col("l_discount") * 60).cast("double").alias("w"), F.col("l_returnflag").alias("t"))
    return V.rows_of_items(items, page=["page"], x="x", y="y", width="w", text="t")


# -- a whole run

#: Every flag of a run over orders: who, what, how suspicious, and how much it matters.
_FLAGS = """WITH o AS (SELECT *, o_totalprice / 10 AS took FROM orders), r AS (SELECT l_orderkey, l_extendedprice AS price FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_extendedprice DESC) = 1),
m AS (SELECT median(o_totalprice) AS centre, sum(abs(o_totalprice)) AS total FROM o), s AS (SELECT median(abs(o_totalprice - centre)) AS mad FROM o, m),
z AS (SELECT o.*, CASE WHEN mad > 0 THEN abs(0.6745 * (o_totalprice - centre) / mad) ELSE 0 END AS z FROM o, m, s),
p AS (SELECT greatest(200.0, min(took)) AS slow FROM (SELECT took, row_number() OVER (ORDER BY took) - 1 AS i, count(*) OVER () AS n FROM o WHERE o_orderstatus <> 'O' AND took IS NOT NULL) WHERE i = floor(n * 0.05)),
f AS (SELECT 'metadata' AS check_kind, 'fatal' AS severity, o_orderkey, o_custkey, NULL::DOUBLE AS observed, 'o_totalprice' AS variable_name, 'range' AS check_id, 1.0::DOUBLE AS suspicion FROM o WHERE o_totalprice > 400000
UNION ALL SELECT 'metadata', 'query', o_orderkey, o_custkey, NULL, 'o_orderstatus', 'code', 0.4 FROM o WHERE o_orderstatus NOT IN ('F', 'O')
UNION ALL SELECT 'statistical', 'query', o_orderkey, o_custkey, o_totalprice, 'o_totalprice', 'mad:o_totalprice', least(1.0, 0.5 + (z - 1.2) / 2.4) FROM z WHERE z > 1.2 AND o_orderkey % 5 <> 0
UNION ALL SELECT 'statistical', 'query', o_orderkey, o_custkey, NULL, NULL, 'duplicate-exact', 0.7 FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey, o_orderpriority) AS n FROM o) WHERE n > 1
UNION ALL SELECT 'statistical', 'query', o_orderkey, o_custkey, NULL, NULL, 'duplicate-respondent', 0.7 FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n FROM o WHERE o_orderstatus <> 'O' AND o_custkey IS NOT NULL) WHERE n > 1
UNION ALL SELECT 'statistical', 'query', o_orderkey, o_custkey, took, NULL, 'speeder', 0.7 FROM o, p WHERE o_orderstatus <> 'O' AND took < slow
UNION ALL SELECT 'statistical', 'query', o_orderkey, o_custkey, o_custkey % 3, 'same', 'straight-line:same', 0.6 FROM o WHERE o_custkey % 3 = o_orderkey % 3 AND o_custkey % 3 = floor(o_totalprice) % 3
UNION ALL SELECT 'confrontation', 'query', o_orderkey, o_custkey, NULL, NULL, 'confront-unmatched:lines', 0.4 FROM o WHERE o_orderkey NOT IN (SELECT l_orderkey FROM r)
UNION ALL SELECT 'confrontation', 'query', o_orderkey, o_custkey, o_totalprice, 'o_totalprice', 'confront:lines:o_totalprice', NULL FROM o JOIN r ON o_orderkey = l_orderkey WHERE abs(o_totalprice - price) / abs(price) * 100 > 50)
SELECT o_orderkey::VARCHAR AS response_id, o_custkey::VARCHAR AS respondent_id, variable_name, check_kind, CASE WHEN check_kind = 'metadata' THEN severity ELSE check_id END AS what, observed, round(suspicion, 6) AS suspicion,
  CASE WHEN suspicion IS NOT NULL THEN round(CASE WHEN variable_name = 'o_totalprice' AND observed IS NOT NULL THEN abs(observed) / total ELSE 0.5 END, 12) END AS impact FROM f, m"""


def _order_run(spark, sf_dir, **more):
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice").withColumn("place", F.struct("l_linenumber", "l_extendedprice"))
    fields = (M.Field("o_totalprice", "numeric", high=400000), M.Field("o_orderstatus", "lookup", codes=("F", "O")))
    lines = R.Confrontation("lines", li, "o_orderkey", "l_orderkey", "place", {"o_totalprice": "l_extendedprice"}, pct=50.0)
    accepted = o.where("o_orderkey % 5 = 0").select(F.col("o_orderkey").cast("string").alias("response_id"), F.lit("mad:o_totalprice").alias("check_id"), F.lit("o_totalprice").alias("variable_name"), F.col("o_totalprice").cast("double").alias("observed"))
    o = o.withColumns({"took": F.col("o_totalprice") / 10, "b1": F.col("o_custkey") % 3, "b2": F.col("o_orderkey") % 3, "b3": F.floor("o_totalprice") % 3})
    return o, R.Run("o_orderkey", "o_custkey", fields, numeric=("o_totalprice",), confrontations=(lines,), threshold=1.2, compared=("o_custkey", "o_orderpriority"), completed="o_orderstatus <> 'O'", duration="took", speed_floor=200.0, batteries={"same": ("b1", "b2", "b3")}, **more), accepted


@query(_FLAGS)
def validation_flags(spark, sf_dir):
    """All flags of a run; how suspicious a mismatch is, is compared by confront_totals."""
    o, run, accepted = _order_run(spark, sf_dir)
    flags = R.validate(o, run, accepted)["flags"]
    known = ~F.col("check_id").startswith("confront:")
    what = F.when(F.col("check_kind") == "metadata", F.col("severity")).otherwise(F.col("check_id"))
    return flags.select("response_id", "respondent_id", "variable_name", "check_kind", what.alias("what"), "observed", F.when(known, F.round("suspicion", 6)).alias("suspicion"), F.when(known, F.round("impact", 12)).alias("impact"))


_RUN = """WITH o AS (SELECT * FROM orders), r AS (SELECT l_orderkey, l_extendedprice AS price FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_extendedprice DESC) = 1),
m AS (SELECT median(o_totalprice) AS centre FROM o), s AS (SELECT median(abs(o_totalprice - centre)) AS mad FROM o, m),
f AS (SELECT 'metadata' AS check_kind, 'fatal' AS severity, o_orderkey, CAST(NULL AS DOUBLE) AS observed FROM o WHERE o_totalprice > 400000
UNION ALL SELECT 'metadata', 'query', o_orderkey, NULL FROM o WHERE o_orderstatus NOT IN ('F', 'O')
UNION ALL SELECT 'edit', 'fatal', o_orderkey, NULL FROM o WHERE o_totalprice <= 250000 AND o_orderstatus = 'P' UNION ALL SELECT 'edit', 'query', o_orderkey, NULL FROM o WHERE o_totalprice > 250000 AND o_orderstatus = 'O'
UNION ALL SELECT 'edit', 'fatal', o_orderkey, NULL FROM o WHERE o_totalprice / 1.1 < 1000
UNION ALL SELECT 'rule', 'fatal', o_orderkey, NULL FROM o WHERE o_totalprice > 300000 AND o_orderstatus IS DISTINCT FROM 'F' UNION ALL SELECT 'rule', 'query', o_orderkey, NULL FROM o WHERE contains(o_orderpriority, 'URGENT') AND o_totalprice * 2 < 100000
UNION ALL SELECT 'rule', 'query', o_orderkey, NULL FROM o WHERE o_orderstatus = 'P' OR coalesce(o_orderpriority, '') = ''
UNION ALL SELECT 'statistical', 'query', o_orderkey, o_totalprice FROM o, m, s WHERE mad > 0 AND abs(0.6745 * (o_totalprice - centre) / mad) > 1.2
UNION ALL SELECT 'statistical', 'query', o_orderkey, -1 FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n FROM o WHERE o_custkey IS NOT NULL) WHERE n > 1
UNION ALL SELECT 'confrontation', 'query', o_orderkey, NULL FROM o WHERE o_orderkey NOT IN (SELECT l_orderkey FROM r)
UNION ALL SELECT 'confrontation', 'query', o_orderkey, o_totalprice FROM o JOIN r ON o_orderkey = l_orderkey WHERE abs(o_totalprice - price) / abs(price) * 100 > 50),
g AS (SELECT * FROM f WHERE NOT (check_kind = 'statistical' AND observed >= 0 AND o_orderkey % 5 = 0)),
k AS (SELECT unnest(['metadata', 'edit', 'rule', 'statistical', 'confrontation']) AS check_kind)
SELECT check_kind, count(*) FILTER (severity = 'fatal') AS fatal, count(*) FILTER (severity = 'query') AS query, count(severity) AS total FROM k LEFT JOIN g USING (check_kind) GROUP BY 1"""


@query(_RUN)
def validation_run(spark, sf_dir):
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice").withColumn("place", F.struct("l_linenumber", "l_extendedprice"))
    fields = (M.Field("o_totalprice", "numeric", high=400000), M.Field("o_orderstatus", "lookup", codes=("F", "O")))
    lines = R.Confrontation("lines", li, "o_orderkey", "l_orderkey", "place", {"o_totalprice": "l_extendedprice"}, pct=50.0)
    run = R.Run("o_orderkey", "o_custkey", fields, ORDER_FORM, RULES, ("o_totalprice",), (lines,), threshold=1.2)
    accepted = o.where("o_orderkey % 5 = 0").select(F.col("o_orderkey").cast("string").alias("response_id"), F.lit("mad:o_totalprice").alias("check_id"), F.lit("o_totalprice").alias("variable_name"), F.col("o_totalprice").cast("double").alias("observed"))
    return R.validate(o, run, accepted)["summary"]
