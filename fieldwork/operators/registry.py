"""The registry: every component of questionnaires, given as JSON in a column, as one row.

A questionnaire is a tree of any depth. It is taken apart level by level: a step turns
all nodes of a level, of all questionnaires at once, into their children, until there
are none; a level is written before the next, so plans don't grow with the depth. A
node's place is the list of positions on its way, which gives document order.

JSON that can't be read, and a tree that is missing, give no rows. Languages of a text
are in order of their codes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldwork.sources.store import written

#: Columns of a registry row, in order.
ENTRY = ("instrument", "entry_id", "component_type", "search_text", "label", "description", "keywords", "tags", "concept_ref", "ddi_element_type", "provenance", "usage_count", "last_updated", "urn", "agency", "version", "flow_target", "payload")


def get(json: str | Column, path: str, kind: str = "string") -> Column:
    """A value in a column of JSON text; null where it is missing or of another kind."""
    return F.try_variant_get(F.try_parse_json(F.col(json) if isinstance(json, str) else json), path, kind)


def parts(json: str | Column, path: str) -> Column:
    """The members of an array, as JSON texts."""
    found = get(json, path, "array<variant>")
    return F.coalesce(F.transform(found, lambda v: F.to_json(v)), F.array().cast("array<string>"))


def languages(json: str | Column, path: str) -> Column:
    """A text's values in all languages that aren't blank."""
    values = F.map_values(get(json, path, "map<string,string>"))
    return F.coalesce(F.filter(values, lambda v: F.trim(v) != ""), F.array().cast("array<string>"))


def search_text(*lists: Column) -> Column:
    """Lists of texts, blank ones left out, joined by a middle dot."""
    empty = F.array().cast("array<string>")
    return F.array_join(F.filter(F.concat(*(F.coalesce(x, empty) for x in lists)), lambda v: v.isNotNull() & (v != "")), " · ")


def nodes(instruments: DataFrame, *, json: str, most_levels: int = 1000) -> DataFrame:
    """(instrument, place, type, node) of every construct below each ``sequence``, the root's place being empty."""
    level = instruments.select(get(json, "$.id").alias("instrument"), F.array().cast("array<int>").alias("place"), F.to_json(get(json, "$.sequence", "variant")).alias("node")).where("node IS NOT NULL")
    levels = []
    for _ in range(most_levels):
        level = written(level.withColumn("type", get("node", "$.type")), "registry-level")
        if level.isEmpty():
            break
        levels.append(level)
        inner = F.when(F.col("type").isin("sequence", "loop"), parts("node", "$.children")).when(F.col("type") == "ifThenElse", F.concat(parts("node", "$.then"), parts("node", "$.else")))
        level = level.select("instrument", F.col("place").alias("up"), F.posexplode(inner).alias("i", "node")).select("instrument", F.concat("up", F.array("i")).alias("place"), "node")
    else:
        raise ValueError(f"questionnaires are nested deeper than {most_levels} levels")
    return reduce(DataFrame.unionByName, levels) if levels else level


def _listed(instruments: DataFrame, json: str, path: str, key: str) -> DataFrame:
    """(instrument, i, key, part): the members of a list of each questionnaire; of equal keys all are there."""
    # the id comes first: beside the members it would be read out of the whole questionnaire for each of them
    lists = instruments.select(get(json, "$.id").alias("instrument"), parts(json, path).alias("parts"))
    rows = lists.select("instrument", F.posexplode("parts").alias("i", "part"))
    return rows.withColumn("key", get("part", key))


def _first(rows: DataFrame) -> DataFrame:
    """The first of each key."""
    return rows.groupBy("instrument", "key").agg(F.min_by("part", "i").alias("part"))


def _uses(constructs: DataFrame) -> DataFrame:
    """(instrument, kind, key, n): how often questions name each variable and each code list."""
    asked = constructs.where("type = 'question'")
    domain = get("node", "$.responseDomain.type")
    schemes = F.when(domain.isin("code", "lookup", "markAll"), F.array(get("node", "$.responseDomain.categorySchemeRef")))
    schemes = schemes.when(domain.isin("grid", "table"), F.array(get("node", "$.responseDomain.rowSchemeRef"), get("node", "$.responseDomain.colSchemeRef")))
    as_uses = lambda kind, keys: F.transform(keys, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))
    variables = as_uses("variable", F.array(get("node", "$.variableRef")))
    lists = as_uses("codeList", F.coalesce(schemes, F.array().cast("array<string>")))
    rows = asked.select("instrument", F.explode(F.concat(variables, lists)).alias("u")).where("u.key <> ''")
    return rows.groupBy("instrument", "u.kind", "u.key").agg(F.count("*").alias("n"))


def registry(instruments: DataFrame, *, json: str, updated: Column | None = None) -> DataFrame:
    """ENTRY: the questionnaires themselves, their pages and sections, questions, variables and code lists.

    A variable's or list's usage is the number of questions that name it. ``updated``
    replaces the creation dates that the questionnaires give.
    """
    # read for every kind of component
    given = written(instruments.select(F.col(json).alias("json"), get(json, "$.id").alias("instrument"), F.coalesce(*([updated] if updated is not None else []), get(json, "$.metadata.created")).alias("last_updated")).where("instrument IS NOT NULL"), "questionnaires")
    constructs = nodes(given, json="json")
    uses = _uses(constructs)
    concepts = _first(_listed(given, "json", "$.concepts", "$.id")).select("instrument", F.col("key").alias("concept_ref"), languages("part", "$.label").alias("concept"))
    variables = _listed(given, "json", "$.variables", "$.name")
    schemes = _listed(given, "json", "$.categorySchemes", "$.id")
    no, text = F.lit(None).cast("string"), search_text

    def entry(rows: DataFrame, **columns: Column) -> DataFrame:
        columns = {"label": no, "description": no, "concept_ref": no, "provenance": F.col("instrument"), "usage_count": F.lit(0).cast("long"), "urn": no, "agency": no, "version": no, "flow_target": no, **columns}
        return rows.select("instrument", *(columns[c].alias(c) for c in ENTRY if c not in ("instrument", "last_updated"))).join(given.select("instrument", "last_updated"), "instrument")

    words = F.flatten(F.transform(parts("json", "$.concepts"), lambda c: languages(c, "$.label")))
    agency = get("json", "$.metadata.agency")
    whole = entry(
        given.drop("last_updated"),
        entry_id=F.concat(F.lit("inst:"), "instrument"), component_type=F.lit("instrument"), payload=F.col("json"), provenance=no,
        search_text=text(languages("json", "$.metadata.title"), languages("json", "$.metadata.description"), words, F.array(agency)),
        label=F.to_json(get("json", "$.metadata.title", "variant")), description=F.to_json(get("json", "$.metadata.description", "variant")),
        keywords=words, tags=F.array(F.lit("instrument")), ddi_element_type=F.lit("Instrument"), urn=F.col("instrument"), agency=agency, version=get("json", "$.version"),
    )
    label = languages("node", "$.label")
    page = F.coalesce(get("node", "$.isPage", "boolean"), F.lit(False))
    kind = F.when(page, "page").otherwise("section")
    node_id = F.concat("instrument", F.lit("#"), get("node", "$.id"))
    groups = entry(
        constructs.where((F.col("type") == "sequence") & (F.size("place") > 0) & (F.size(label) > 0)),
        entry_id=node_id, component_type=kind, payload=F.col("node"), search_text=text(label, F.array(F.when(page, "page screen").otherwise("section group"))),
        label=F.to_json(get("node", "$.label", "variant")), keywords=F.array(kind), tags=F.array(kind), ddi_element_type=F.lit("Sequence"), flow_target=F.when(page, "screen").otherwise("question"),
    )
    name, domain = get("node", "$.variableRef"), get("node", "$.responseDomain.type")
    about = _first(variables).select("instrument", F.col("key").alias("variable"), get("part", "$.conceptRef").alias("concept_ref"))
    asked = constructs.where("type = 'question'").withColumn("variable", name).join(about, ["instrument", "variable"], "left").join(concepts, ["instrument", "concept_ref"], "left")
    questions = entry(
        asked,
        entry_id=node_id, component_type=F.lit("question"), payload=F.col("node"), search_text=text(languages("node", "$.text"), languages("node", "$.instruction"), F.array(name, domain), F.col("concept")),
        label=F.to_json(get("node", "$.text", "variant")), description=F.to_json(get("node", "$.instruction", "variant")), concept_ref=F.col("concept_ref"),
        keywords=F.filter(F.array(name, domain), lambda x: x.isNotNull() & (x != "")), tags=F.array(F.lit("question"), domain), ddi_element_type=F.lit("QuestionItem"), flow_target=F.lit("question"),
    )
    used = lambda rows, kind: rows.join(uses.where(F.col("kind") == kind).drop("kind"), ["instrument", "key"], "left").na.fill({"n": 0})
    shape = F.array(get("part", "$.representation"), get("part", "$.kind"))
    known = used(variables, "variable").withColumn("concept_ref", get("part", "$.conceptRef")).join(concepts, ["instrument", "concept_ref"], "left")
    fields = entry(
        known,
        entry_id=F.concat("instrument", F.lit("#var:"), "key"), component_type=F.lit("variable"), payload=F.col("part"), search_text=text(F.array("key"), languages("part", "$.label"), shape, F.col("concept")),
        label=F.to_json(get("part", "$.label", "variant")), concept_ref=F.col("concept_ref"), keywords=F.concat(F.array("key"), shape), tags=F.concat(F.array(F.lit("variable")), F.reverse(shape)),
        ddi_element_type=F.lit("Variable"), usage_count=F.col("n"),
    )
    categories = parts("part", "$.categories")
    lists = entry(
        used(schemes, "codeList"),
        entry_id=F.concat("instrument", F.lit("#cs:"), "key"), component_type=F.lit("codeList"), payload=F.col("part"),
        search_text=text(F.array("key"), languages("part", "$.label"), F.flatten(F.transform(categories, lambda c: languages(c, "$.label")))),
        label=F.to_json(get("part", "$.label", "variant")), keywords=F.concat(F.array("key"), F.transform(categories, lambda c: get(c, "$.code"))), tags=F.array(F.lit("codeList")), ddi_element_type=F.lit("CodeList"), usage_count=F.col("n"),
    )
    return reduce(DataFrame.unionByName, (whole, groups, questions, fields, lists)).select(*ENTRY)
