"""Queries over documents of the corpus: dictionaries, and what is searched in them, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldwork.functions import stemming as S
from fieldwork.operators import dictionaries as D
from fieldwork.operators import instrument as I
from fieldwork.operators import paths as P
from fieldwork.operators import registry as G
from fieldwork.operators import textsearch as T
from fieldwork.operators import views as V
from fieldwork.plans.catalogue import query, table
from fieldwork.sources.store import scratch, written
from fieldwork.streaming import upserts as U

# -- dictionaries: parts are printed in five styles, a brand a document, and read back

_STYLE = "CAST(substr(p_brand, 7) AS INT) % 6"
_SHARED = f"""part_ AS (
  SELECT *, {_STYLE} AS style, (CASE WHEN p_partkey % 13 = 0 AND {_STYLE} <> 5 THEN '9' ELSE 'P' END) || CAST(p_partkey AS VARCHAR(20)) AS v,
    CAST(length(p_name) AS VARCHAR(9)) AS len, CAST(p_size AS VARCHAR(9)) AS pos, CAST(CAST(floor(p_retailprice) AS BIGINT) AS VARCHAR(20)) AS price FROM part
), counted AS (
  SELECT l_partkey, l_returnflag AS code, 'status ' || l_linestatus AS label, count(*) AS n, CAST(floor(sum(l_quantity)) AS BIGINT) AS w FROM lineitem GROUP BY l_partkey, l_returnflag, l_linestatus
)"""
_PRINTED = {
    0: ["'Introduction to ' || p_name", "'Variable Name and Length of ' || p_type"],
    1: [
        "'Variable Name: ' || v || ' Length: ' || len || '.0 Position: ' || pos", "'Concept: ' || p_name", "'Question Text:   Universe: ' || p_type", "'Question Text: How many ' || p_name || '?'",
        "'1   TBC_30A Nb of ' || p_name || '   13'", "'Note:'", "'Note: price ' || price", "'Answer categories   Code   Frequency'",
    ],
    2: [
        "'Nom de la variable : ' || v || ' Longueur : ' || len || '.0 Position : ' || pos", "'Concept : ' || p_name", "'Texte de la question : Combien de ' || p_name || ' ?'", "'Univers : ' || p_type", "'Nota : prix ' || price",
    ],
    3: [
        "'Variable Name:  ' || v || '  Position:  ' || pos || '  Length:  ' || len", "'Collection Name:  ' || p_type", "'How many ' || p_name", "'  do you have?'", "'Page ' || pos", "'Coverage:  all of ' || p_name", "'FREQ WTD'", "'Note:  Universe: none'", "'Note:  see ' || v",
    ],
    4: [
        "'FIELD NAME: ' || v", "'POSITION: ' || pos || '-' || pos", "'LENGTH: ' || len", "'DESCRIPTION: The ' || p_name", "'   of type ' || p_type", "''", "'VALID VALUES: any'", "'COMMENTS:'", "'price'", "price",
    ],
    5: [
        "'Variable name: ' || v", "'Short Description: ' || p_name", "'Column number: ' || pos", "'Data type: ' || p_type", "'Derived from: ' || p_brand", "'Long Description: The ' || p_name", "' 12 '", "'of ' || p_type",
    ],
}


def _printed(spark, sf_dir):
    """(document, page, line, row): headers, fields and category rows, a brand a document."""
    p = table(spark, sf_dir, "part")
    p = p.withColumns({
        "style": F.substr("p_brand", F.lit(7)).cast("int") % 6,
        "v": F.concat(F.when((F.col("p_partkey") % 13 == 0) & (F.substr("p_brand", F.lit(7)).cast("int") % 6 != 5), "9").otherwise("P"), F.col("p_partkey").cast("string")),
        "len": F.length("p_name").cast("string"),
        "pos": F.col("p_size").cast("string"),
        "price": F.floor("p_retailprice").cast("string"),
    })
    lines = F.coalesce(*(F.when(F.col("style") == k, F.array(*(F.expr(t.replace("VARCHAR", "STRING")) for t in texts))) for k, texts in _PRINTED.items()))
    head = p.select(F.col("p_brand").alias("document"), F.col("p_size").alias("page"), "p_partkey", F.posexplode(lines).alias("k", "row"))
    li = table(spark, sf_dir, "lineitem", "l_partkey", "l_returnflag", "l_linestatus", "l_quantity")
    counted = li.groupBy("l_partkey", F.col("l_returnflag").alias("code"), F.concat(F.lit("status "), "l_linestatus").alias("label")).agg(F.count("*").cast("string").alias("n"), F.format_number(F.floor(F.sum("l_quantity")), 0).alias("w"))
    wide = F.concat_ws("   ", "code", "label", "n", "w")
    narrow = F.concat_ws(" ", "label", "code", "n", "w", F.lit("7.9 %"))
    french = F.concat_ws(" ", "label", "code", "n", F.replace(F.col("w"), F.lit(","), F.lit(" ")), F.lit("1,4"))
    row = F.when(F.col("style") == 2, french).when((F.col("style") != 1) | (F.col("p_partkey") % 2 == 0), wide).otherwise(narrow)
    place = F.ascii("code") * 2 + F.when(F.col("label") == "status F", 0).otherwise(1)
    body = p.where("style > 0").join(counted, F.col("p_partkey") == F.col("l_partkey")).select(F.col("p_brand").alias("document"), F.col("p_size").alias("page"), "p_partkey", place.alias("k"), row.alias("row"))
    total = p.where("style = 1").select(F.col("p_brand").alias("document"), F.col("p_size").alias("page"), "p_partkey", F.lit(900).alias("k"), F.lit("Total   31   1,234").alias("row"))
    both = head.unionByName(body).unionByName(total)
    return both.select("document", "page", (F.col("p_partkey") * 1000 + F.col("k")).alias("line"), "row")


#: What was printed, from the tables alone: nothing is read back.
_EXPECTED = f"""WITH {_SHARED}, coded AS (
  SELECT l_partkey, string_agg(code || '|' || label || '|' || (CASE WHEN style = 2 OR style = 1 AND p_partkey % 2 = 1 AND length(format('{{:,}}', w)) IN (3, 7, 11) AND length(CAST(w AS VARCHAR)) = 3 THEN '-|-' ELSE n::VARCHAR || '|' || w::VARCHAR END), ';' ORDER BY ascii(code), label) AS codes,
    string_agg(code || '   ' || label || '   ' || n::VARCHAR || '   ' || format('{{:,}}', w), ' ' ORDER BY ascii(code), label) AS printed, count(*) AS n_codes
  FROM counted JOIN part_ ON l_partkey = p_partkey GROUP BY l_partkey
), headed AS (
  SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS block FROM part_ LEFT JOIN coded ON l_partkey = p_partkey WHERE style > 0
), expected AS (
  SELECT p_brand AS document, block, p_size AS page, CASE style WHEN 3 THEN 'collection' WHEN 4 THEN 'field' WHEN 5 THEN 'definition' ELSE 'labelled' END AS layout, v AS name,
    CASE style WHEN 4 THEN pos || '-' || pos ELSE pos END AS position, CASE WHEN style <= 2 THEN len || '.0' WHEN style <= 4 THEN len END AS length,
    CASE WHEN style IN (1, 2, 5) THEN p_name END AS concept,
    CASE style WHEN 1 THEN 'How many ' || p_name || '?' WHEN 2 THEN 'Combien de ' || p_name || ' ?' WHEN 3 THEN 'How many ' || p_name || ' do you have?' WHEN 4 THEN 'The ' || p_name || ' of type ' || p_type END AS question_text,
    CASE style WHEN 1 THEN p_type WHEN 2 THEN p_type WHEN 3 THEN 'all of ' || p_name WHEN 4 THEN 'any' END AS universe,
    CASE style WHEN 1 THEN 'price ' || price WHEN 2 THEN 'prix ' || price WHEN 3 THEN 'see ' || v WHEN 4 THEN 'price ' || price || coalesce(' ' || printed, '')
      ELSE 'The ' || p_name || ' of ' || p_type || coalesce(' ' || printed, '') || ' Derived from: ' || p_brand END AS note,
    CASE style WHEN 3 THEN p_type END AS collection_name, coalesce(codes, '') AS codes, p_partkey % 13 <> 0 OR style = 5 AS named
  FROM headed
)"""


def _found(spark, sf_dir):
    lines = written(_printed(spark, sf_dir), "printed")
    chosen = written(D.layouts(lines, document="document", row="row"), "layouts")
    return chosen, D.variables(lines, chosen, document="document", page="page", line="line", row="row")


@query(_EXPECTED + " SELECT * EXCLUDE (named) FROM expected WHERE named")
def dictionary_variables(spark, sf_dir):
    """Every variable that was printed comes back with its fields, and its categories with counts where the format shows them."""
    _, found = _found(spark, sf_dir)
    count = lambda x: F.coalesce(x.cast("bigint").cast("string"), F.lit("-"))
    codes = F.array_join(F.transform("codes", lambda c: F.concat_ws("|", c["code"], c["label"], count(c["frequency"]), count(c["weighted"]))), ";")
    return found.select("document", "block", "page", "layout", *D.FIELDS, codes.alias("codes"))


@query(_EXPECTED + """, s AS (SELECT document, any_value(layout) AS layout, count(*) AS headers, count(*) FILTER (named) AS n, count(*) FILTER (named AND codes <> '') AS coded FROM expected GROUP BY 1)
SELECT DISTINCT p_brand AS document, 'warning' AS severity, 'no known layout; text is not parsed' AS message FROM part_ WHERE style = 0
UNION ALL SELECT document, 'warning', layout || ' layout with ' || headers || ' headers, but no variable parsed from them' FROM s WHERE n = 0
UNION ALL SELECT document, 'info', layout || ' layout: ' || n || ' variables from ' || headers || ' headers' FROM s WHERE n > 0 AND n < headers * 0.9
UNION ALL SELECT document, 'info', coded || ' of ' || n || ' variables have categories' FROM s WHERE n >= 20 AND coded < n * 0.15""")
def dictionary_notes(spark, sf_dir):
    chosen, found = _found(spark, sf_dir)
    return D.notes(chosen, found, document="document")


@query(r"""WITH lines AS (SELECT page_id, unnest(string_split(regexp_replace(html, '<[^>]*>', chr(10), 'g'), chr(10))) AS row FROM pages)
SELECT page_id, CASE WHEN count(*) FILTER (regexp_matches(row, '^\s*Variable\s*Name\s*:', 'i')) > 0 THEN 'some' END AS layout, 0::BIGINT AS headers, count(*) AS lines FROM lines GROUP BY 1""")
def page_layouts(spark, sf_dir):
    """Web pages' lines by layout; none of them is a dictionary, and each is reported."""
    pages = table(spark, sf_dir, "pages", "page_id", "html")
    lines = pages.select("page_id", F.explode(F.split(F.regexp_replace("html", "<[^>]*>", "\n"), "\n", -1)).alias("row"))
    return D.layouts(lines, document="page_id", row="row")


# -- ranked search of stemmed text


def _stem_sql(source: str) -> str:
    """Common table expressions from (lang, word) of ``source`` to ``stems`` (lang, word, term)."""

    def case(steps, k):
        if k >= len(steps):
            return "term"
        whens = " ".join(f"WHEN regexp_matches(term, '{p}') THEN regexp_replace(term, '{p}', '{new}', 'g')" for p, new in steps[k])
        return f"CASE {whens} ELSE term END"

    out, n = [f"stem_0 AS (SELECT DISTINCT lang, word, word AS term FROM {source})"], max(map(len, S.STEMMERS.values()))
    for k in range(n):
        out.append(f"stem_{k + 1} AS MATERIALIZED (SELECT lang, word, CASE WHEN lang = 'fr' THEN {case(S.STEMMERS['fr'], k)} ELSE {case(S.STEMMERS['en'], k)} END AS term FROM stem_{k})")
    return ", ".join([*out, f"stems AS (SELECT * FROM stem_{n})"])


_SEARCHED = "ing licenses or apache -mit"


def _search_sql() -> str:
    stops = " OR ".join(f"lang = '{k}' AND word IN ({', '.join(repr(w) for w in v)})" for k, v in S.STOPWORDS.items())
    ranked = []
    for k in ("en", "fr"):
        # the query's own words go through the same rules
        q = T.wanted(_SEARCHED, k)
        last = ", ".join(f"max(CASE WHEN term = '{t}' THEN place END) OVER w AS p{i}, max(CASE WHEN term = '{t}' THEN n END) OVER w AS n{i}" for i, t in enumerate(q.terms))
        at = {t: i for i, t in enumerate(q.terms)}
        begins = [", ".join(f"p{at[t]}" for t in g) for g in q.groups]
        least = ["CASE WHEN " + " AND ".join(f"p{at[t]} IS NOT NULL" for t in g) + f" THEN least({b}) END" for g, b in zip(q.groups, begins, strict=True)]
        ranked.append(f"""SELECT doc_id, sum({T.WEIGHT} / (1 + (stop - start) - (n_stop - n_start))) AS rank FROM (
  SELECT c.doc_id, c.start, c.stop, b.n AS n_start, e.n AS n_stop FROM (
    SELECT doc_id, start, min(place) AS stop FROM (
      SELECT doc_id, place, greatest({', '.join(least)}) AS start FROM (SELECT doc_id, place, {last} FROM hits_{k} WINDOW w AS (PARTITION BY doc_id ORDER BY place)))
    WHERE start IS NOT NULL GROUP BY doc_id, start) c
  JOIN hits_{k} b ON b.doc_id = c.doc_id AND b.place = c.start JOIN hits_{k} e ON e.doc_id = c.doc_id AND e.place = c.stop) GROUP BY 1""")
    hits = ", ".join(
        f"""hits_{k} AS (SELECT doc_id, place, term, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS n FROM indexed
  WHERE term IN ({', '.join(f"'{t}'" for t in q.terms)}) AND doc_id NOT IN (SELECT doc_id FROM indexed WHERE term IN ({', '.join(f"'{t}'" for t in q.excluded)})))"""
        for k, q in ((k, T.wanted(_SEARCHED, k)) for k in ("en", "fr"))
    )
    return f"""WITH tokens AS (
  SELECT doc_id, lang, unnest(words) AS word, unnest(range(len(words))) AS place
  FROM (SELECT doc_id, CASE WHEN lang = 'fr' THEN 'fr' ELSE 'en' END AS lang, regexp_extract_all(lower(text), '{T.WORD}') AS words FROM documents)
), kept AS (SELECT * FROM tokens WHERE NOT ({stops})), {_stem_sql('kept')},
indexed AS (SELECT doc_id, place, term FROM kept JOIN stems USING (lang, word)), {hits},
ranked AS (SELECT doc_id, max(rank) AS rank FROM ({' UNION ALL '.join(ranked)}) GROUP BY 1),
page AS (SELECT doc_id, source, rank, count(*) OVER () AS total FROM ranked JOIN documents USING (doc_id))
SELECT doc_id, source, round(rank, 9) AS rank, total FROM page ORDER BY page.rank DESC, source, doc_id LIMIT 200"""


@query(_search_sql())
def corpus_search(spark, sf_dir):
    """The page's order is the operator's own: rank, name, key."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    found = T.corpus_search(docs, key="doc_id", name="source", text="text", lang="lang", query=_SEARCHED, limit=200)
    return found.withColumn("rank", F.round("rank", 9))


@query(f"""WITH words AS (SELECT lang, word FROM (SELECT CASE WHEN lang = 'fr' THEN 'fr' ELSE 'en' END AS lang, unnest(regexp_extract_all(lower(text), '{T.WORD}')) AS word FROM documents) GROUP BY ALL),
{_stem_sql('words')} SELECT lang, term, count(*) AS words, min(word) AS first_word FROM stems GROUP BY ALL""")
def stem_families(spark, sf_dir):
    """Every word of the documents under its stem."""
    language = F.when(F.col("lang") == "fr", "fr").otherwise("en").alias("lang")
    words = table(spark, sf_dir, "documents", "text", "lang").select(language, F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"({T.WORD})"), F.lit(1))).alias("word")).distinct()
    return S.stemmed(words, word="word", lang="lang").groupBy("lang", "term").agg(F.count("*").alias("words"), F.min("word").alias("first_word"))


# -- paths through a questionnaire, with the answers that the tables hold

_ROUTING = P.Routing(
    [
        I.Question("segment"),
        I.Question("status", visible_when="$segment != 'BUILDING'"),
        I.Question("quantity"),
        I.Question("flag", visible_when="$quantity > 20"),
        I.Question("remark", visible_when="$status == 'F' || $flag == 'R'"),
    ],
    frozenset({"quantity"}),
)


def _domains(spark, sf_dir):
    """(variable, type, codes, low, high, longest): what the tables hold, as domains of answers."""
    none = {"codes": F.lit(None).cast("array<string>"), "low": F.lit(None).cast("double"), "high": F.lit(None).cast("double"), "longest": F.lit(None).cast("int")}

    def domain(name, kind, df, **have):
        return df.agg(*(have.get(k, c).alias(k) for k, c in none.items())).select(F.lit(name).alias("variable"), F.lit(kind).alias("type"), *none)

    codes = lambda c: F.sort_array(F.collect_set(c))
    li = table(spark, sf_dir, "lineitem", "l_quantity", "l_returnflag")
    out = domain("segment", "code", table(spark, sf_dir, "customer", "c_mktsegment"), codes=codes("c_mktsegment"))
    out = out.unionByName(domain("status", "code", table(spark, sf_dir, "orders", "o_orderstatus"), codes=codes("o_orderstatus")))
    out = out.unionByName(domain("quantity", "numeric", li, low=F.min("l_quantity").cast("double"), high=F.max("l_quantity").cast("double")))
    out = out.unionByName(domain("flag", "code", li, codes=codes("l_returnflag")))
    out = out.unionByName(domain("events", "codes", table(spark, sf_dir, "events", "event_type"), codes=codes("event_type")))
    out = out.unionByName(domain("shipped", "date", li.limit(1)))
    out = out.unionByName(domain("paid", "boolean", li.limit(1)))
    return out.unionByName(domain("remark", "text", table(spark, sf_dir, "part", "p_name"), longest=F.max(F.length("p_name"))))


_DOMAINS = """segments AS (SELECT c_mktsegment AS value, row_number() OVER (ORDER BY c_mktsegment) - 1 AS no FROM (SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment IS NOT NULL)),
statuses AS (SELECT o_orderstatus AS value, row_number() OVER (ORDER BY o_orderstatus) - 1 AS no FROM (SELECT DISTINCT o_orderstatus FROM orders WHERE o_orderstatus IS NOT NULL)),
flags AS (SELECT l_returnflag AS value, row_number() OVER (ORDER BY l_returnflag) - 1 AS no FROM (SELECT DISTINCT l_returnflag FROM lineitem WHERE l_returnflag IS NOT NULL)),
ends AS (SELECT min(l_quantity)::DOUBLE AS low, max(l_quantity)::DOUBLE AS high, floor((min(l_quantity) + max(l_quantity)) / 2 + 0.5) AS middle FROM lineitem),
quantities AS (SELECT low AS value, 0 AS no FROM ends UNION ALL SELECT middle, 1 FROM ends UNION ALL SELECT high, 2 FROM ends)"""
_WALKED = f"""WITH {_DOMAINS}, walked AS (
  SELECT s.value AS segment, t.value AS status, q.value AS quantity, f.value AS flag, CASE WHEN t.value = 'F' OR f.value = 'R' THEN 'Test response' END AS remark,
    list_filter([s.no, t.no, q.no, f.no, CASE WHEN t.value = 'F' OR f.value = 'R' THEN 0 END], lambda x: x IS NOT NULL) AS path
  FROM segments s LEFT JOIN statuses t ON s.value <> 'BUILDING' JOIN quantities q ON TRUE LEFT JOIN flags f ON q.value > 20
), written AS (SELECT *, concat_ws(';', 'segment=' || segment, 'status=' || status, 'quantity=' || quantity::BIGINT, 'flag=' || flag, 'remark=' || remark) AS steps FROM walked)"""


def _written(df):
    return df.withColumn("steps", F.array_join(F.transform("steps", lambda s: F.concat_ws("=", s["variable"], s["value"])), ";"))


@query(f"{_WALKED} SELECT row_number() OVER (ORDER BY len(path), path)::INT AS scenario, len(path)::INT AS questions, steps FROM written ORDER BY len(path), path LIMIT 60")
def all_paths(spark, sf_dir):
    d = _domains(spark, sf_dir)
    return _written(P.all_paths(P.test_values(d, "routing"), P.test_values(d, "canonical"), _ROUTING, most=60))


@query(f"""{_WALKED.replace('WITH ', 'WITH RECURSIVE ', 1)}, targets AS (
  SELECT 0 AS at, no, 'segment=' || value AS aim FROM segments UNION ALL SELECT 1, no, 'status=' || value FROM statuses UNION ALL SELECT 2, no, 'quantity=' || value::BIGINT FROM quantities UNION ALL SELECT 3, no, 'flag=' || value FROM flags
), usual AS (SELECT (SELECT value FROM segments WHERE no = 0) AS segment, (SELECT value FROM statuses WHERE no = 0) AS status, (SELECT middle FROM ends) AS quantity, (SELECT value FROM flags WHERE no = 0) AS flag),
aimed AS (
  SELECT row_number() OVER (ORDER BY t.at, t.no) AS i, aim, w.steps, string_split(w.steps, ';') AS taken FROM targets t, usual u JOIN written w ON
    w.segment = CASE WHEN t.at = 0 THEN split_part(aim, '=', 2) ELSE u.segment END AND (w.status IS NULL OR w.status = CASE WHEN t.at = 1 THEN split_part(aim, '=', 2) ELSE u.status END)
    AND w.quantity = CASE WHEN t.at = 2 THEN split_part(aim, '=', 2)::DOUBLE ELSE u.quantity END AND (w.flag IS NULL OR w.flag = CASE WHEN t.at = 3 THEN split_part(aim, '=', 2) ELSE u.flag END)
), chosen AS (
  SELECT 0::BIGINT AS i, []::VARCHAR[] AS covered, NULL::VARCHAR AS steps
  UNION ALL SELECT a.i, CASE WHEN list_contains(covered, aim) THEN covered ELSE covered || taken END, CASE WHEN NOT list_contains(covered, aim) THEN a.steps END FROM chosen c JOIN aimed a ON a.i = c.i + 1
)
SELECT row_number() OVER (ORDER BY i)::INT AS scenario, len(string_split(steps, ';'))::INT AS questions, steps FROM chosen WHERE steps IS NOT NULL""")
def covering_paths(spark, sf_dir):
    """The oracle decides value by value, recursively, from all walked paths."""
    d = _domains(spark, sf_dir)
    return _written(P.covering_paths(P.test_values(d, "routing"), P.test_values(d, "canonical"), _ROUTING))


@query(f"""WITH {_DOMAINS}, texts AS (SELECT max(length(p_name)) AS n FROM part), codes AS (
  SELECT 'segment' AS variable, list(value ORDER BY value) AS c FROM segments UNION ALL SELECT 'status', list(value ORDER BY value) FROM statuses UNION ALL SELECT 'flag', list(value ORDER BY value) FROM flags),
several AS (SELECT list(DISTINCT event_type ORDER BY event_type) AS c FROM events WHERE event_type IS NOT NULL),
lists AS (SELECT variable, [NULL, c[1], c[-1]] AS v FROM codes UNION ALL SELECT 'quantity', [(low - 1)::BIGINT::VARCHAR, low::BIGINT::VARCHAR, middle::BIGINT::VARCHAR, high::BIGINT::VARCHAR, (high + 1)::BIGINT::VARCHAR] FROM ends
  UNION ALL SELECT 'events', ['', c[1], array_to_string(c, ',')] FROM several UNION ALL SELECT 'paid', ['true', 'false'] UNION ALL SELECT 'shipped', ['', '2024-01-01', '1900-01-01', '9999-12-31', 'not-a-date']
  UNION ALL SELECT 'remark', ['', 'A', 'Test response', repeat('A', n), repeat('A', n + 1), '<script>alert(1)</script>', '😀🎉'] FROM texts)
SELECT variable, (unnest(range(len(v))))::INT AS no, unnest(v) AS value FROM lists""")
def boundary_values(spark, sf_dir):
    return P.test_values(_domains(spark, sf_dir), "boundary")


# -- the registry of questionnaires: one a nation, with a question a supplier


def _instruments(spark, sf_dir):
    """(json): a questionnaire for each nation, its variables its suppliers, its categories its customers' segments."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    s = table(spark, sf_dir, "supplier")
    label = lambda c: F.struct(c.alias("en"))
    name = F.concat(F.lit("V"), F.col("s_suppkey").cast("string"))
    domain = F.when(F.col("s_suppkey") % 2 == 0, F.struct(F.lit("code").alias("type"), F.lit("seg").alias("categorySchemeRef"))).otherwise(F.struct(F.lit("numeric").alias("type"), F.lit(None).cast("string").alias("categorySchemeRef")))
    question = F.struct(F.lit("question").alias("type"), F.concat(F.lit("q"), F.col("s_suppkey").cast("string")).alias("id"), name.alias("variableRef"), label(F.concat(F.lit("Trade with "), "s_name", F.lit("?"))).alias("text"), domain.alias("responseDomain"))
    variable = F.struct(name.alias("name"), label(F.col("s_name")).alias("label"), F.lit("numeric").alias("representation"), F.lit("collected").alias("kind"), F.concat(F.lit("c"), (F.col("s_suppkey") % 3).cast("string")).alias("conceptRef"))
    in_order = lambda when, c: F.transform(F.sort_array(F.collect_list(F.when(when, F.struct("s_suppkey", c.alias("x"))))), lambda r: r["x"])
    of_suppliers = s.groupBy("s_nationkey").agg(in_order(F.lit(True), variable).alias("variables"), in_order(F.col("s_acctbal") >= 0, question).alias("then"), in_order(F.col("s_acctbal") < 0, question).alias("looped"))
    c = table(spark, sf_dir, "customer", "c_nationkey", "c_mktsegment").groupBy("c_nationkey").agg(F.sort_array(F.collect_set("c_mktsegment")).alias("segments"))
    both = n.join(of_suppliers, F.col("n_nationkey") == F.col("s_nationkey"), "left").join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    categories = F.transform(F.coalesce("segments", F.array().cast("array<string>")), lambda x: F.struct(F.substr(x, F.lit(1), F.lit(1)).alias("code"), label(x).alias("label")))
    page = F.struct(
        F.lit("sequence").alias("type"), F.lit("p1").alias("id"), label(F.concat(F.lit("Suppliers of "), "n_name")).alias("label"), F.lit(True).alias("isPage"),
        F.array(F.struct(F.lit("ifThenElse").alias("type"), F.lit("if1").alias("id"), F.col("then"), F.array(F.struct(F.lit("loop").alias("type"), F.lit("l1").alias("id"), F.col("looped").alias("children"))).alias("else"))).alias("children"),
    )
    section = F.struct(F.lit("sequence").alias("type"), F.lit("s2").alias("id"), label(F.when(F.col("n_nationkey") % 2 == 0, "Rest").otherwise(" ")).alias("label"), F.array(F.struct(F.lit("statement").alias("type"), F.lit("t1").alias("id"))).alias("statements"))
    whole = F.struct(
        F.concat(F.lit("urn:n:"), F.col("n_nationkey").cast("string")).alias("id"), F.concat(F.lit("1.0."), F.col("n_regionkey").cast("string")).alias("version"),
        F.struct(F.struct(F.col("n_name").alias("en"), F.concat(F.lit("Le "), "n_name").alias("fr")).alias("title"), F.col("r_name").alias("agency"), F.lit("2024-01-01").alias("created")).alias("metadata"),
        F.array(F.struct(F.lit("c0").alias("id"), label(F.lit("money")).alias("label")), F.struct(F.lit("c1").alias("id"), label(F.concat(F.lit("trade of "), "r_name")).alias("label"))).alias("concepts"),
        F.array(F.struct(F.lit("seg").alias("id"), label(F.lit("Segments")).alias("label"), categories.alias("categories"))).alias("categorySchemes"), F.col("variables"),
        F.struct(F.lit("sequence").alias("type"), F.lit("root").alias("id"), F.array(F.to_json(page), F.to_json(section)).alias("children")).alias("sequence"),
    )
    # the two children differ in shape, so they were written by themselves
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.to_json(whole), r'"\{\\"type', '{"type'), r'\}"(?=[,\]])', "}"), r'\\"', '"')
    return both.select(text.alias("json"))


@query("""WITH n AS (SELECT 'urn:n:' || n_nationkey AS i, * FROM nation JOIN region ON n_regionkey = r_regionkey),
s AS (SELECT n.*, s.*, 'V' || s_suppkey AS v, CASE WHEN s_suppkey % 2 = 0 THEN 'code' ELSE 'numeric' END AS domain, 'c' || s_suppkey % 3 AS concept_ref, CASE s_suppkey % 3 WHEN 0 THEN 'money' WHEN 1 THEN 'trade of ' || r_name END AS concept FROM n JOIN supplier s ON n_nationkey = s_nationkey),
seg AS (SELECT c_nationkey, array_to_string(list(DISTINCT c_mktsegment ORDER BY c_mktsegment), ' · ') AS labels, array_to_string(list_transform(list(DISTINCT c_mktsegment ORDER BY c_mktsegment), lambda x: x[1]), ',') AS codes FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1),
used AS (SELECT s_nationkey, count(*) FILTER (s_suppkey % 2 = 0) AS n FROM supplier GROUP BY 1)
SELECT i AS instrument, 'inst:' || i AS entry_id, 'instrument' AS component_type, n_name || ' · Le ' || n_name || ' · money · trade of ' || r_name || ' · ' || r_name AS search_text, 'money,trade of ' || r_name AS keywords, 'instrument' AS tags, NULL AS concept_ref, 'Instrument' AS ddi_element_type, NULL AS provenance, 0::BIGINT AS usage_count, '2024-01-01' AS last_updated, i AS urn, r_name AS agency, '1.0.' || n_regionkey AS version, NULL AS flow_target FROM n
UNION ALL SELECT i, i || '#p1', 'page', 'Suppliers of ' || n_name || ' · page screen', 'page', 'page', NULL, 'Sequence', i, 0, '2024-01-01', NULL, NULL, NULL, 'screen' FROM n
UNION ALL SELECT i, i || '#s2', 'section', 'Rest · section group', 'section', 'section', NULL, 'Sequence', i, 0, '2024-01-01', NULL, NULL, NULL, 'question' FROM n WHERE n_nationkey % 2 = 0
UNION ALL SELECT i, i || '#q' || s_suppkey, 'question', concat_ws(' · ', 'Trade with ' || s_name || '?', v, domain, concept), v || ',' || domain, 'question,' || domain, concept_ref, 'QuestionItem', i, 0, '2024-01-01', NULL, NULL, NULL, 'question' FROM s WHERE s_acctbal IS NOT NULL
UNION ALL SELECT i, i || '#var:' || v, 'variable', concat_ws(' · ', v, s_name, 'numeric', 'collected', concept), v || ',numeric,collected', 'variable,collected,numeric', concept_ref, 'Variable', i, (s_acctbal IS NOT NULL)::BIGINT, '2024-01-01', NULL, NULL, NULL, NULL FROM s
UNION ALL SELECT i, i || '#cs:seg', 'codeList', concat_ws(' · ', 'seg', 'Segments', labels), concat_ws(',', 'seg', codes), 'codeList', NULL, 'CodeList', i, coalesce(n, 0), '2024-01-01', NULL, NULL, NULL, NULL FROM n LEFT JOIN seg ON c_nationkey = n_nationkey LEFT JOIN used ON s_nationkey = n_nationkey""")
def registry_built(spark, sf_dir):
    """Questionnaires go in as JSON; the oracle takes the rows from the tables that they were written from."""
    found = G.registry(_instruments(spark, sf_dir), json="json")
    return found.drop("label", "description", "payload").withColumns({"keywords": F.array_join("keywords", ","), "tags": F.array_join("tags", ",")})


# -- streams: the last event of each user, batch by batch, and what fails a check on the way


def _streamed(spark, sf_dir):
    """The events table as a stream, upserted by user into a new folder; the folder."""
    source = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")
    folder = scratch(spark, "upserts")
    source.write.option("maxRecordsPerFile", 200_000).parquet(f"{folder}/in")
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 64).parquet(f"{folder}/in")
    checks = {"no-value": lambda: F.col("value").isNull(), "error": lambda: F.col("event_type") == "error"}
    U.upsert(stream, path=f"{folder}/out", checkpoint=f"{folder}/checkpoint", key="user_id", version=lambda: F.struct("ts", "event_id"), checks=checks).awaitTermination()
    return f"{folder}/out"


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE user_id IS NOT NULL) WHERE r = 1")
def stream_upserts(spark, sf_dir):
    return U.current(spark, _streamed(spark, sf_dir), key="user_id", version=F.struct("ts", "event_id")).select("user_id", "event_id", "event_type", "value")


@query("SELECT check_id, count(*) AS records, count(DISTINCT user_id) AS users FROM (SELECT user_id, unnest(list_filter([CASE WHEN value IS NULL THEN 'no-value' END, CASE WHEN event_type = 'error' THEN 'error' END], lambda x: x IS NOT NULL)) AS check_id FROM events) GROUP BY 1")
def stream_issues(spark, sf_dir):
    issues = spark.read.parquet(f"{_streamed(spark, sf_dir)}/issues")
    return issues.groupBy("check_id").agg(F.count("*").alias("records"), F.count_distinct("user_id").alias("users"))


# -- concepts by the words of their labels


@query("SELECT p_brand || '/' || p_type AS concept_id, count(DISTINCT p_size) AS years, count(*) AS occurrences FROM part WHERE p_brand = 'Brand#12' GROUP BY p_brand, p_type ORDER BY years DESC, occurrences DESC, concept_id LIMIT 50")
def concept_search(spark, sf_dir):
    """Concepts whose label has all words asked for, in any order and case."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_type", "p_size")
    counts = [F.countDistinct("p_size").alias("years"), F.count("*").alias("occurrences"), F.countDistinct("p_size").alias("representations")]
    c = p.groupBy(F.col("p_brand").alias("label"), "p_type").agg(*counts).withColumn("concept_id", F.concat_ws("/", "label", "p_type"))
    return V.concept_page(c, q="12 BRAND", least_years=None, changed_only=False).select("concept_id", "years", "occurrences")
