"""Views of surveys, responses, cases and corpus rows: filters, joins and counts of a few lines each.

Joins to dimension tables are by equality and left to the optimizer, which broadcasts
what it knows to be small.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldwork.functions import text as X

BROADCAST_CELLS = 100_000


def _no(c: Column) -> Column:
    """Trimmed text, null if blank."""
    return F.nullif(F.trim(c), F.lit(""))


# -- responses, sessions, audit


def responses_of(responses: DataFrame, where: Column, *, newest: str, answers: str) -> DataFrame:
    """A survey's responses, newest first; missing answers are an empty object."""
    return responses.where(where).withColumn(answers, F.coalesce(answers, F.lit("{}"))).orderBy(F.col(newest).desc())


def latest_state(sessions: DataFrame, key: str, updated: str, state: list[str]) -> DataFrame:
    """One row a session, the last one written."""
    return sessions.groupBy(key).agg(F.max_by(F.struct(*state), updated).alias("__s")).select(key, "__s.*")


def newest(log: DataFrame, ts: str, key: str, *, limit: int = 200) -> DataFrame:
    """The last entries of a log, newest first."""
    return log.orderBy(F.col(ts).desc(), F.col(key).desc()).limit(limit)


def prefilled(samples: DataFrame, mappings: dict[str, str]) -> Column:
    """Answers that a sample's fields give: a map from ``target@`` to the value, for fields that are there."""
    pairs = [F.struct(F.lit(f"{target}@").alias("key"), F.col(field).cast("string").alias("value")) for field, target in mappings.items() if field in samples.columns]
    return F.map_from_entries(F.array(*pairs)) if pairs else F.create_map().cast("map<string,string>")


def instance_key(name: Column, scope: Column) -> Column:
    """``name@a=1;b=2`` of a name and an array of (name, index)."""
    return F.concat(name, F.lit("@"), F.array_join(F.transform(scope, lambda s: F.concat(s["name"], F.lit("="), s["index"].cast("string"))), ";"))


# -- corpus rows


def corpus_row(columns: dict[str, Column]) -> list[Column]:
    """Columns trimmed, blank ones null."""
    return [_no(c).alias(n) for n, c in columns.items()]


def search_text(*parts: Column) -> Column:
    """Parts joined by a space, blank ones left out, white space collapsed."""
    return F.regexp_replace(F.concat_ws(" ", *(_no(p) for p in parts)), r"\s+", " ")


def title_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def registry_entry(*, concept: Column, question: Column, name: Column) -> list[Column]:
    """Type, label and search text of a corpus row in the registry."""
    kind = F.when(question.isNull(), "variable").otherwise("question")
    return [kind.alias("component_type"), F.coalesce(concept, question, name).alias("label"), F.concat_ws(" ", *(F.when(p != "", p) for p in (name, concept, question))).alias("search_text")]


def browse(entries: DataFrame, *, type_col: str, component: str | None, order: str, limit: int = 100) -> DataFrame:
    """Entries of a type in source order, with score 0."""
    hits = entries if component is None else entries.where(F.col(type_col) == component)
    return hits.orderBy(order).limit(limit).withColumn("score", F.lit(0.0))


def type_counts(entries: DataFrame, type_col: str) -> DataFrame:
    """Entries of each type, and of all."""
    sets = entries.groupingSets([[F.col(type_col)], []], F.col(type_col))
    return sets.agg(F.coalesce(F.col(type_col), F.lit("all")).alias("kind"), F.count("*").alias("n")).select("kind", "n")


def table_size(rows: DataFrame, *texts: str) -> DataFrame:
    """Rows, megabytes and bytes a row of the texts, with one decimal."""
    held = F.sum(reduce(lambda a, b: a + b, (F.coalesce(F.octet_length(t), F.lit(0)) for t in texts)))
    sums = rows.agg(F.count("*").alias("records"), F.coalesce(held, F.lit(0)).alias("b"))
    return sums.select("records", F.round(F.col("b") / 1048576, 1).alias("megabytes"), F.round(F.col("b") / F.nullif("records", F.lit(0)), 1).alias("bytes_per_row"))


def first_given(rows: DataFrame, group: list[str], value: str, order: str) -> DataFrame:
    """Each group's first value in order that is given."""
    return rows.groupBy(*group).agg(F.min_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias(value))


def picked(texts: Column, language: Column) -> Column:
    """A text in the language asked for, else the first there is, else empty."""
    return F.coalesce(texts[language], F.try_element_at(F.map_values(texts), F.lit(1)), F.lit(""))


def meaning_of(concept: Column, question: Column) -> Column:
    """The normalised concept, or else question."""
    return F.coalesce(F.nullif(X.normalize_key(concept), F.lit("")), X.normalize_key(question), F.lit(""))


def representation_of(codes: Column) -> Column:
    """``code=label`` of an array of (code, label), in order; none if it is empty."""
    listed = F.array_join(F.transform(codes, lambda c: F.concat(c["code"], F.lit("="), X.normalize_key(c["label"]))), "|")
    return F.when(F.size(codes) > 0, listed).otherwise("none")


def cascade_ids(namespace, meaning: Column, universe: Column, representation: Column) -> dict[str, Column]:
    """Name-based ids of a concept, its conceptual variable and its represented variable."""
    name = lambda kind, *parts: X.uuid5(namespace, F.concat_ws(":", F.lit(kind), *parts))
    return {"concept_id": name("concept", meaning), "conceptual_variable_id": name("conceptual-variable", meaning, universe), "represented_variable_id": name("represented-variable", meaning, universe, representation)}


# -- cases


def with_codes(cases: DataFrame, codes: DataFrame, key: str) -> DataFrame:
    """Cases with their access codes; several codes repeat a case, none leaves a null."""
    return cases.join(codes, key, "left")


def workload(workers: DataFrame, cases: DataFrame, *, worker: str, assigned: str, status: str, values: list[str]) -> DataFrame:
    """Each interviewer's cases by status; those without a case stay, cases of nobody don't count."""
    counts = cases.where(F.col(assigned).isNotNull()).groupBy(F.col(assigned).alias("__w")).agg(F.count("*").alias("total"), *(F.count_if(F.col(status) == v).alias(v) for v in values))
    both = workers.join(counts, F.col(worker) == F.col("__w"), "left").drop("__w")
    return both.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("total", *values)})


# -- checks


def past_dispositions(flags: DataFrame, *, check: str, key: str, decided: Column) -> DataFrame:
    """(key, before): how many other flags of the check are decided already."""
    per = flags.groupBy(check).agg(F.count_if(decided).alias("__d"))
    return flags.join(per, check).select(key, (F.col("__d") - decided.cast("int")).alias("before"))


def disposed(flags: DataFrame, *, action: str, instance: str, corrected: str) -> dict[str, DataFrame]:
    """What dispositions write: the flags' status, suppressions, and corrections of cells."""
    a = F.col(action)
    status = F.when(a == "accept", "accepted").when(a == "correct", "corrected").when(a == "follow-up", "follow_up").otherwise("suppressed")
    cell = (a == "correct") & F.col(instance).isNotNull() & F.col(corrected).isNotNull()
    return {"flags": flags.withColumn("status", status), "suppressions": flags.where(a.isin("accept", "suppress")), "corrections": flags.where(cell)}


def drafted_rule(variable: Column, observed: Column, is_text: Column, action: Column) -> Column:
    """The narrowest rule for an accepted or corrected value: ``$variable == value``."""
    literal = F.when(is_text, F.concat(F.lit("'"), F.replace(observed, F.lit("'"), F.lit("\\'")), F.lit("'"))).otherwise(F.coalesce(observed, F.lit("null")))
    return F.when(action.isin("accept", "correct") & variable.isNotNull(), F.concat(F.lit("$"), variable, F.lit(" == "), literal))


def confront_mappings(survey: DataFrame, reference: DataFrame, *, key: str, ref_key: str, order: str, mappings: dict[str, str], tolerance: dict[str, dict[str, float]]) -> DataFrame:
    """(key, variable, observed, reference, matches): every mapping of a survey column to a reference column.

    The last reference row of a key counts. Mappings are unrolled as rows of a stack, after one join.
    """
    from fieldwork.operators.confront import last_per_key, within

    last = last_per_key(reference, ref_key, order, sorted(set(mappings.values())))
    both = survey.join(last.select(F.col(ref_key).alias("__k"), *(F.col(c).alias(f"__{c}") for c in sorted(set(mappings.values())))), F.col(key) == F.col("__k"), "left")
    cells = [F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("observed"), F.col(f"__{c}").cast("double").alias("reference"), F.when(F.col(v).isNotNull() & F.col(f"__{c}").isNotNull(), within(F.col(v).cast("double"), F.col(f"__{c}").cast("double"), **tolerance.get(v, {}))).alias("matches")) for v, c in mappings.items()]
    return both.select(key, F.explode(F.array(*cells)).alias("c")).select(key, "c.*")


def bot_totals(runs: DataFrame, *, fatal: Column, reached: Column, failed_steps: Column, console_errors: Column, duration: str) -> DataFrame:
    """Scenarios, completed ones, issues by kind and total duration; a fatal error hides a run's other issues."""
    live = ~fatal
    return runs.agg(
        F.count("*").alias("total"), F.count_if(reached).alias("completed"), F.coalesce(F.sum(duration), F.lit(0)).alias("duration_ms"), F.count_if(fatal).alias("fatal_error"),
        F.count_if(live & ~reached).alias("dead_end"), F.coalesce(F.sum(F.when(live, failed_steps).otherwise(0)), F.lit(0)).alias("step_failed"), F.coalesce(F.sum(F.when(live, console_errors).otherwise(0)), F.lit(0)).alias("console_error"),
    )


def parse_notes(documents: DataFrame, *, key: str, headers: str, variables: str, coded: str) -> DataFrame:
    """(key, note): documents with fewer variables than 90% of headers, or few code lists among 20 or more."""
    v, h, c = F.col(variables), F.col(headers), F.col(coded)
    lost = F.when(v < h * 0.9, F.concat(v.cast("string"), F.lit(" variables from "), h.cast("string"), F.lit(" header rows")))
    bare = F.when((v >= 20) & (c / v < 0.15), F.concat(c.cast("string"), F.lit("/"), v.cast("string"), F.lit(" variables carry a code list")))
    return documents.select(key, F.explode(F.filter(F.array(lost, bare), lambda n: n.isNotNull())).alias("note"))


def silent_notes(files: DataFrame, notes: DataFrame, key: str, *, unclassified: Column) -> DataFrame:
    """All notes, and one for each unclassified file without any."""
    silent = files.where(unclassified).join(notes.select(key), key, "left_anti").select(key, F.lit("unclassified").alias("note"))
    return notes.select(key, "note").unionByName(silent)


def uncovered(values: DataFrame, exercised: DataFrame, on: list[str]) -> DataFrame:
    """(variable, value) pairs that no scenario has exercised."""
    return values.select(*on).distinct().join(exercised.select(*on), on, "left_anti")


def fired_edits(items: DataFrame, *, kind: str, edit: str) -> DataFrame:
    """Hard and other edits fired on answerable items."""
    shown = items.where(F.col(kind).isin("question", "table", "geolocation", "photo"))
    return shown.agg(F.count_if(F.col(edit) == "hard").alias("hard"), F.count_if(F.col(edit).isNotNull() & (F.col(edit) != "hard")).alias("soft"))


def cell_totals(cells: DataFrame, disabled: DataFrame, *, response: str, row: str, column: str, value: str) -> DataFrame:
    """Each response's row, column and grand totals over the cells that are not disabled; all blank is null.

    Dealt out by row and column, all responses' values of a cell would be one task's, so
    the disabled cells go to every task unless they are very many.
    """
    closed = disabled.select(row, column).distinct()
    if closed.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS:
        closed = F.broadcast(closed)
    open_ = cells.join(closed, [row, column], "left_anti")
    # summed by cell first, or a task that reads rows would hold each of them in all three sets
    open_ = open_.groupBy(response, row, column).agg(F.sum(value).alias(value))
    sets = open_.groupingSets([[F.col(response), F.col(row)], [F.col(response), F.col(column)], [F.col(response)]], F.col(response), F.col(row), F.col(column))
    return sets.agg(F.sum(value).alias("total")).select(response, F.coalesce(row, F.lit("TOT")).alias(row), F.coalesce(column, F.lit("TOT")).alias(column), "total")


# -- integrity of instruments, given as tables


def duplicate_names(variables: DataFrame, name: str) -> DataFrame:
    return variables.groupBy(name).agg((F.count("*") - 1).alias("repeats")).where("repeats > 0")


def dangling(rows: DataFrame, targets: DataFrame, *, ref: str, target: str, key: str) -> DataFrame:
    """(key, ref): references that name nothing."""
    return rows.where(F.col(ref).isNotNull()).join(targets.select(F.col(target).alias("__t")), F.col(ref) == F.col("__t"), "left_anti").select(key, ref)


def reserved_names(variables: DataFrame, name: str, reserved: tuple[str, ...]) -> DataFrame:
    return variables.where(F.col(name).isin(*reserved))


def ambiguous_codes(codes: DataFrame, code: str) -> DataFrame:
    """Codes that make generated names ambiguous, or that totals use."""
    return codes.withColumn("issue", F.when(F.col(code).contains("_"), "separator").when(F.col(code) == "TOT", "reserved")).where("issue IS NOT NULL")


def consent_traps(questions: DataFrame, *, sensor: str, required: str, fallback: str, visible: str, names: dict[str, str]) -> DataFrame:
    """Required sensor questions that one who declines can't get past.

    ``names`` has each sensor's consent variable; a question that depends on it is no trap, nor is one with a fallback.
    """
    gated = reduce(lambda a, b: a | b, ((F.col(sensor) == s) & F.coalesce(F.col(visible).contains(v), F.lit(False)) for s, v in names.items()))
    open_way = (F.col(sensor) == "geolocation") & F.coalesce(F.col(fallback), F.lit(True))
    return questions.where(F.col(sensor).isin(*names) & F.col(required) & ~gated & ~open_way)


# -- dashboards


def field_kinds(answers: DataFrame, *, key: str, kind: str, value: str, keep: int = 3) -> DataFrame:
    """The ``keep`` best fields to show: (key, type, n, score, detail).

    ``kind`` is number, boolean or string. Over 80% numbers: numeric, 3 points a value;
    over 80% booleans: boolean, 2 points; else 2 to 12 distinct strings: categorical, a
    point a value and 10 less the distinct ones. Detail is mean, % true, or distinct values.
    """
    n, k = F.count("*"), F.col(kind)
    part = lambda name: F.count_if(k == name)
    v = F.col(value)
    held = answers.where(v.isNotNull() & (v != "")).groupBy(key).agg(
        n.alias("n"), part("number").alias("numbers"), part("boolean").alias("booleans"), part("string").alias("strings"),
        F.avg(F.when(k == "number", v.try_cast("double"))).alias("mean"), F.count_if((k == "boolean") & (v == "true")).alias("trues"), F.countDistinct(F.when(k == "string", v)).alias("distinct"),
    )
    kind_ = F.when(F.col("numbers") > 0.8 * F.col("n"), "numeric").when(F.col("booleans") > 0.8 * F.col("n"), "boolean").when((F.col("strings") > 0) & F.col("distinct").between(2, 12), "categorical")
    typed = held.withColumn("type", kind_).where("type IS NOT NULL")
    score = F.when(F.col("type") == "numeric", F.col("n") * 3).when(F.col("type") == "boolean", F.col("n") * 2).otherwise(F.col("n") + 10 - F.col("distinct"))
    detail = F.when(F.col("type") == "numeric", F.col("mean")).when(F.col("type") == "boolean", F.col("trues") / F.col("booleans") * 100).otherwise(F.col("distinct").cast("double"))
    return typed.select(key, "type", "n", score.alias("score"), detail.alias("detail")).orderBy(F.col("score").desc(), key).limit(keep)


def frequencies(answers: DataFrame, value: str, labels: dict[str, str]) -> DataFrame:
    """Values by their labels with counts, the most frequent first; without a label the code stays."""
    names = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
    return answers.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("code")).agg(F.count("*").alias("n")).select(F.coalesce(names[F.col("code")], F.col("code")).alias("label"), "n").orderBy(F.col("n").desc(), "label")


def marked(answers: DataFrame, marks: dict[str, Column]) -> DataFrame:
    """How often each choice of a mark-all question is marked; choices without a mark are left out."""
    counts = answers.agg(*(F.count_if(c).alias(n) for n, c in marks.items()))
    return counts.unpivot([], list(marks), "choice", "n").where("n > 0").orderBy(F.col("n").desc(), "choice")


def counted(rows: DataFrame, key: str) -> DataFrame:
    """Counts by key, largest first, equal ones by key."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), key)


def concept_page(concepts: DataFrame, *, q: str | None, least_years: int | None, changed_only: bool, limit: int = 50, offset: int = 0) -> DataFrame:
    """Concepts whose label holds all words asked for, by years, occurrences, label and id."""
    hits = concepts
    for w in (q or "").lower().split():
        hits = hits.where(F.array_contains(F.split(F.lower("label"), "[^a-z0-9]+"), w))
    if least_years is not None:
        hits = hits.where(F.col("years") >= least_years)
    if changed_only:
        hits = hits.where(F.col("representations") > 1)
    return hits.orderBy(F.col("years").desc(), F.col("occurrences").desc(), "label", "concept_id").offset(max(0, offset)).limit(max(1, min(200, limit)))


# -- text forms


def grouped_int(n: Column) -> Column:
    return F.format_number(n.cast("long"), 0)


def byte_size(n: Column) -> Column:
    """Bytes in B, or with one decimal in KiB to TiB."""
    out = F.concat(F.format_string("%.1f", n / 1024.0**4), F.lit(" TiB"))
    for k, unit in reversed(list(enumerate(("KiB", "MiB", "GiB"), 1))):
        out = F.when(n < 1024.0 ** (k + 1), F.concat(F.format_string("%.1f", n / 1024.0**k), F.lit(f" {unit}"))).otherwise(out)
    return F.when(n < 1024, F.concat(grouped_int(n), F.lit(" B"))).otherwise(out)


def percentage(part: Column, total: Column) -> Column:
    return F.when(total > 0, F.concat(F.format_string("%.1f", part / total * 100), F.lit("%"))).otherwise("—")


def year_range(low: Column, high: Column) -> Column:
    return F.when(low.isNull() | high.isNull(), "—").when(low == high, low.cast("string")).otherwise(F.concat(low.cast("string"), F.lit("–"), high.cast("string")))


def markdown_row(*cells: Column) -> Column:
    """A row of a Markdown table: pipes escaped, lines joined."""
    plain = [F.regexp_replace(F.replace(c, F.lit("|"), F.lit("\\|")), "\r?\n", " ") for c in cells]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *plain), F.lit(" |"))


def ddi_id(c: Column) -> Column:
    """An id that is legal in DDI: dots become @, other signs _."""
    return F.regexp_replace(F.replace(c, F.lit("."), F.lit("@")), r"[^A-Za-z0-9*@$\-_]", "_")


def ddi_urn(agency: Column, item: Column, version: Column) -> Column:
    return F.concat_ws(":", F.lit("urn:ddi"), agency, ddi_id(item), version)


def at_precision(c: Column, digits: int) -> Column:
    """Rounded to a device's decimals, halves up."""
    return F.floor(c * 10**digits + 0.5) / 10**digits


def csv_line(answers: Column, keys: Column) -> Column:
    """Answers (a map) of all keys in order, every cell quoted, missing ones empty."""
    cell = lambda k: F.concat(F.lit('"'), F.replace(F.coalesce(answers[k], F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    return F.array_join(F.transform(keys, cell), ",")


# -- dictionary pages


def header_blocks(lines: DataFrame, *, document: str, order: list[str], header: Column) -> DataFrame:
    """Adds ``block``: the number of headers so far in a document, across pages; rows before the first are left out."""
    w = Window.partitionBy(document).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("block", F.count_if(header).over(w)).where("block > 0")


def rows_of_items(items: DataFrame, *, page: list[str], x: str, y: str, width: str, text: str, tolerance: float = 2.0, gap: float = 2.5) -> DataFrame:
    """(page, row, line): text items put into rows by height, and joined from left to right.

    An item within ``tolerance`` of a row's first item is of that row. The first decides,
    so a page's heights, highest first, are folded to the heights at which rows begin;
    an item is of the last of these at or above it. A gap of ``gap`` or more is three spaces.
    """
    item = F.struct(F.col(x).alias("x"), F.col(text).alias("t"), F.col(width).alias("w"), F.col(y).alias("y"))
    pages = items.groupBy(*page).agg(F.collect_list(item).alias("items"), F.sort_array(F.collect_set(y), asc=False).alias("heights"))
    begins = F.aggregate("heights", F.slice("heights", 1, 1), lambda acc, h: F.when(F.abs(h - F.element_at(acc, -1)) > tolerance, F.concat(acc, F.array(h))).otherwise(acc))
    rows = pages.withColumn("begins", begins).select(*page, "begins", F.explode("items").alias("i"))
    place = F.size(F.filter("begins", lambda h: h >= F.col("i.y"))) - 1
    lines = rows.groupBy(*page, place.alias("row")).agg(F.sort_array(F.collect_list(F.struct("i.x", F.negative("i.y").alias("down"), "i.t", "i.w"))).alias("r"))
    before = lambda k: F.get(F.col("r"), k - 1)
    spaced = F.transform("r", lambda i, k: F.concat(F.when(i["x"] - (before(k)["x"] + before(k)["w"]) >= gap, "   ").otherwise(""), i["t"]))
    return lines.select(*page, "row", F.array_join(spaced, "").alias("line"))


def chosen_files(files: DataFrame, *, key: str, family: str | None, code: str, seed: int, share: float | None, limit: int | None) -> DataFrame:
    """The files an ingest takes: of a code family, a sample that a seed fixes, at most a number, in order of the key."""
    out = files if family is None else files.where((F.col(code) == family) | F.col(code).startswith(f"{family}."))
    if share is not None:
        out = out.where(F.pmod(F.crc32(F.concat_ws(":", F.lit(str(seed)), F.col(key)).cast("binary")), F.lit(10_000)) < int(share * 10_000))
    return out if limit is None else out.orderBy(key).limit(limit)
