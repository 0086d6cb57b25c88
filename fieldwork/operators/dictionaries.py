"""Survey dictionaries: printed rows become variables with their categories.

Input is one row per printed line (document, page, line, text); cells within a line
are two or more spaces apart. Every document has one of four layouts, which is chosen
by counting its header lines, not by its name. A header opens a block that runs to the
next one, across pages; a block becomes one variable.

Lines are numbered into blocks in two steps, headers of whole pages first and lines
within a page then, so no window runs over a document's lines. A block's lines are
gathered in order and read by column expressions only.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldwork.sources.store import written

# What the dictionaries print as names of fields, in English and French.
LABELS = {
    "name": r"Variable\s*Name|Nom\s+de\s+(?:la\s+)?variable",
    "length": "Length|Longueur",
    "position": "Position",
    "concept": "Concept",
    "question_text": r"Question\s*Text|Texte\s+de\s+la\s+question",
    "question_name": r"Question\s*Name|Nom\s+de\s+la\s+question",
    "universe": "Universe|Univers",
    "note": "Note|Nota|Remarques?",
    "source": "Source",
    "collection": r"Collection\s*Name|Nom\s+de\s+collecte",
    "coverage": "Coverage|Port[ée]e|Couverture",
}
FIELD_LABELS = {"name": r"FIELD\s+NAME", "position": "POSITION", "length": "LENGTH", "description": "DESCRIPTION", "valid": r"VALID\s+VALUES", "comments": "COMMENTS", "comment": "COMMENT"}
DEFINITION_LABELS = {"name": r"Variable\s+name", "short": r"Short\s+Description", "column": r"Column\s+number", "type": r"Data\s+type", "derived": r"Derived\s+from", "long": r"Long\s+Description"}
# Lines of a category table that are no categories.
FURNITURE = r"answer categories?|cat[ée]gories?(?: de r[ée]ponse)?|content|contenu|code|freq(?:uency)?|fr[ée]q(?:uence)?|wtd|weighted(?: frequency)?|pond[ée]r[ée]e?|sample|[ée]chantillon|population|total|%|n"
# A variable's name, a category's code, a line of another variable's listing.
NAME = r"[A-Za-z][A-Za-z0-9_]{1,31}"
CODE = r"\d{1,9}(?:\s*[-–]\s*\d{1,9})?|[A-Z]\d?"
LISTING = r"^[A-Z][A-Z0-9]*_[A-Z0-9_]+\s+\S"
LONGEST_LABEL = 120

#: Header patterns by layout; of equally many, the first wins.
HEADERS = {
    "collection": rf"(?iu)^\s*(?:{LABELS['name']})\s*:\s{{2,}}\S+\s{{2,}}(?:{LABELS['position']})\s*:",
    "labelled": rf"(?iu)^\s*(?:{LABELS['name']})\s*:\s*\S+.*(?:{LABELS['length']})\s*:",
    "field": rf"(?iu)^\s*(?:{FIELD_LABELS['name']})\s*:",
    "definition": rf"(?iu)^\s*(?:{DEFINITION_LABELS['name']})\s*:\s*{NAME}\s*$",
}
_ANY = "|".join(LABELS.values())
_SPACES = "[\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"
BROADCAST_DOCUMENTS = 1_000_000

CODE_TYPE = "struct<code:string,label:string,frequency:double,weighted:double>"


def plain_row(row: Column) -> Column:
    """A printed line with plain spaces, and without the marks that splitting uses."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(row, F.lit("")), _SPACES, " "), "[\\u0001\\u0002]", "")


def _blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


# -- category rows


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _number(c: Column) -> Column:
    """``1,234`` or ``1 234`` or ``12.5``; anything else is null."""
    digits = F.regexp_replace(c, r"[\s,]", "")
    return F.when(digits.rlike(r"^-?\d+(?:\.\d+)?$"), digits.try_cast("double"))


def _counts(tail: Column) -> Column:
    """The columns of counts behind a category, none if they are written the French way: their spaces part thousands as well as columns."""
    french = tail.rlike(r"\d,\d{1,2}(?!\d)") | tail.rlike(r"\d \d{3}(?!\d)")
    found = F.regexp_extract_all(F.regexp_replace(tail, r"\s*%\s*$", ""), F.lit(r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?"), F.lit(0))
    return F.when(~french, F.transform(found, lambda x: F.replace(x, F.lit(",")).try_cast("double")))


def _is_label(label: Column) -> Column:
    return ~label.rlike(rf"(?iu)^(?:{FURNITURE})$") & ~label.rlike(LISTING)


def category(row: Column) -> Column:
    """A line as (code, label, frequency, weighted), null if it is no category.

    With three cells or more, one of the first two is the code and the other the label,
    and a number follows. With fewer, the line is read from its end: counts, then the
    code, and the rest is the label.
    """
    pattern = rf"^\s*(.{{2,{LONGEST_LABEL}}}?)\s+({CODE})\s+([\d.,\s%]+)$"

    def by_end(parts: Column) -> Column:
        label, code, tail = (F.trim(F.get(parts, F.lit(i))) for i in range(3))
        narrow = (F.size(parts) == 3) & label.rlike("[A-Za-zÀ-ÿ]") & _is_label(label) & tail.rlike(r"\d")
        counted = _once(_counts(tail), lambda n: F.struct(code.alias("code"), label.alias("label"), F.get(n, F.lit(0)).alias("frequency"), F.get(n, F.lit(1)).alias("weighted")))
        return F.when(narrow, counted)

    def by_cells(cells: Column) -> Column:
        cell = lambda i: F.get(cells, F.lit(i))
        first, second = (cell(i).rlike(rf"^(?:{CODE})$") for i in (0, 1))
        code, label = (F.when(first, cell(i)).otherwise(cell(1 - i)) for i in (0, 1))
        wide = (first != second) & _is_label(label) & (F.length(label) <= LONGEST_LABEL) & _number(cell(2)).isNotNull()
        return F.when(wide, F.struct(code.alias("code"), label.alias("label"), _number(cell(2)).alias("frequency"), _number(cell(3)).alias("weighted")))

    narrow = _once(F.split(F.regexp_replace(row, pattern, "$1\u0001$2\u0001$3"), "\u0001"), by_end)
    return _once(F.filter(F.split(F.trim(row), r"\s{2,}"), lambda x: x != ""), lambda cells: F.when(F.size(cells) < 3, narrow).otherwise(by_cells(cells)))


# -- fields of a line and of a block


def _kind(label: Column, labels: dict[str, str]) -> Column:
    return F.coalesce(*(F.when(label.rlike(rf"(?iu)^(?:{p})$"), F.lit(k)) for k, p in labels.items()))


def labelled_values(row: Column) -> Column:
    """Each label of a line with its value, which runs to the next label: array of (kind, value)."""
    marked = F.regexp_replace(row, rf"(?iu)(?:^|\s)({_ANY})\s*:", "\u0001$1\u0002")
    parts = F.slice(F.split(marked, "\u0001"), 2, F.length(row) + 1)
    return F.transform(parts, lambda p: F.struct(_kind(F.split_part(p, F.lit("\u0002"), F.lit(1)), LABELS).alias("kind"), F.trim(F.split_part(p, F.lit("\u0002"), F.lit(2))).alias("value")))


def cell_values(row: Column, kinds: tuple[str, ...]) -> Column:
    """Values that end at a cell gap, in the same shape; an empty field that the next label follows has none."""

    def value(kind: str) -> Column:
        found = F.trim(F.regexp_extract(row, rf"(?iu)(?:^|\s{{2,}})(?:{LABELS[kind]})\s*:\s*(.+?)\s*(?=\s{{2,}}|$)", 1))
        return F.struct(F.lit(kind).alias("kind"), F.when(~found.rlike(rf"(?iu)^(?:{_ANY})\s*:"), found).otherwise("").alias("value"))

    return F.array(*(value(k) for k in kinds))


def opened(text: Column, labels: dict[str, str]) -> Column:
    """The kind of the label that a trimmed line begins with."""
    return _kind(F.trim(F.regexp_extract(text, "^([^:]*):", 1)), labels)


_COLLECTED = ("name", "position", "length", "collection", "coverage", "note")


def read_lines(rows: DataFrame) -> DataFrame:
    """``row`` of a known ``layout`` with what it says by itself.

    ``code`` is its category, ``pairs`` its fields with their values, ``opens`` the field
    that goes on over the lines after it, ``wording`` whether it is a question's text,
    ``text`` the line trimmed; null if a field that goes on leaves it out.
    """
    row, layout, text = F.col("row"), F.col("layout"), F.trim("row")
    pairs = F.when(layout == "labelled", labelled_values(row)).when(layout == "collection", cell_values(row, _COLLECTED))
    opens = F.when(layout == "field", opened(text, FIELD_LABELS)).when(layout == "definition", opened(text, DEFINITION_LABELS))
    # page numbers stand between the lines of a definition
    out = (text == "") | (layout == "definition") & text.rlike(r"^\d{1,4}$")
    read = rows.withColumn("code", category(row).cast(CODE_TYPE)).withColumns({"pairs": pairs, "opens": opens, "text": F.when(~out, text)})
    plain = ~text.rlike(r"\s{2,}") & ~text.rlike(rf"(?iu)^(?:{_ANY})\s*:") & ~text.rlike(r"(?iu)^(?:FREQ|WTD|Response|R[ée]ponse)\b") & ~text.rlike(r"(?iu)^Page\s+\d+")
    return read.withColumn("wording", (layout == "collection") & F.col("code").isNull() & (text != "") & plain)


def _first(pairs: Column, kind: str) -> Column:
    """The first value of a kind that isn't empty."""
    return F.get(F.filter(pairs, lambda v: (v["kind"] == kind) & (v["value"] != "")), F.lit(0))["value"]


def _open(kind: str) -> Column:
    """What follows the last line of a label in ``open``, and the lines after it up to the next label, joined by spaces."""
    lines = F.col("open")
    at = F.array_max(F.transform(lines, lambda r, i: F.when(r["opens"] == kind, i)))
    end = F.coalesce(F.array_min(F.transform(lines, lambda r, i: F.when(r["opens"].isNotNull() & (i > at), i))), F.size(lines))
    parts = F.transform(F.slice(lines, at + 1, end - at), lambda r, i: F.when(i == 0, F.trim(F.regexp_replace(r["text"], "^[^:]*:", ""))).otherwise(r["text"]))
    return _blank_to_null(F.array_join(F.filter(parts, lambda p: p != ""), " "))


def _first_word(c: Column) -> Column:
    return F.regexp_extract(c, r"^(\S+)", 1)


FIELDS = ("name", "position", "length", "concept", "question_text", "universe", "note", "collection_name")


def _fields() -> dict[str, dict[str, Column]]:
    """The fields of each layout, from a block's ``head`` and ``pairs``, its ``wording`` and its ``open`` lines."""
    head, pairs = F.col("head"), F.col("pairs")
    return {
        "labelled": {"name": _first_word(_first(head, "name")), **{k: _first(pairs, k) for k in ("position", "length", "concept", "question_text", "universe", "note")}},
        "collection": {
            "name": _first_word(_first(head, "name")),
            "position": _first(head, "position"),
            "length": _first(head, "length"),
            "collection_name": _first(pairs, "collection"),
            "question_text": _blank_to_null(F.array_join("wording", " ")),
            "universe": _first(pairs, "coverage"),
            "note": _first(pairs, "note"),
        },
        "field": {"name": _open("name"), "position": _open("position"), "length": _open("length"), "question_text": _open("description"), "universe": _open("valid"), "note": F.coalesce(_open("comments"), _open("comment"))},
        "definition": {"name": _first_word(_open("name")), "position": _open("column"), "concept": _open("short"), "note": _blank_to_null(F.concat_ws(" ", _open("long"), F.concat(F.lit("Derived from: "), _open("derived"))))},
    }


# -- documents


def layouts(lines: DataFrame, *, document: str, row: str) -> DataFrame:
    """(document, layout, headers, lines) for each document; the layout is null where no line is a header."""
    text = plain_row(F.col(row))
    counts = lines.groupBy(document).agg(F.count("*").alias("lines"), *(F.count_if(text.rlike(p)).alias(k) for k, p in HEADERS.items()))
    most = F.greatest(*(F.col(k) for k in HEADERS))
    chosen = F.when(most > 0, F.coalesce(*(F.when(F.col(k) == most, F.lit(k)) for k in HEADERS)))
    return counts.select(document, chosen.alias("layout"), most.alias("headers"), "lines")


def _is_header(row: Column, layout: Column) -> Column:
    return reduce(lambda a, b: a | b, ((layout == k) & row.rlike(p) for k, p in HEADERS.items()))


def variables(lines: DataFrame, chosen: DataFrame, *, document: str, page: str, line: str, row: str) -> DataFrame:
    """(document, block, page, layout, FIELDS, codes): a row for each block with a proper name.

    ``chosen`` is what ``layouts`` gives. A category's counts are null where the line
    has none that can be told apart.
    """
    read = chosen.where("layout IS NOT NULL").select(document, "layout")
    if len(read.take(BROADCAST_DOCUMENTS + 1)) <= BROADCAST_DOCUMENTS:
        read = F.broadcast(read)
    rows = lines.select(document, F.col(page).alias("page"), F.col(line).alias("line"), plain_row(F.col(row)).alias("row")).join(read, document)
    # read for the blocks of pages, and for those within them
    rows = written(rows.withColumn("header", _is_header(F.col("row"), F.col("layout"))), "dictionary-lines")
    of_page = rows.groupBy(document, "page").agg(F.count_if("header").alias("n"))
    before = of_page.select(document, "page", (F.sum("n").over(Window.partitionBy(document).orderBy("page")) - F.col("n")).alias("before"))
    here = F.count_if("header").over(Window.partitionBy(document, "page").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    numbered = rows.withColumn("here", here).join(before, [document, "page"]).withColumn("block", F.col("before") + F.col("here")).where("block > 0")
    line_ = F.struct("page", "line", "code", "pairs", "opens", "wording", "text")
    blocks = read_lines(numbered).groupBy(document, "block", "layout").agg(F.sort_array(F.collect_list(line_)).alias("all"))
    all_ = F.col("all")
    blocks = blocks.select(
        document,
        "block",
        "layout",
        all_[0]["page"].alias("page"),
        all_[0]["pairs"].alias("head"),
        F.flatten(F.filter(F.transform(all_, lambda r: r["pairs"]), lambda p: p.isNotNull())).alias("pairs"),
        F.transform(F.filter(F.slice(all_, 2, F.size(all_)), lambda r: r["wording"]), lambda r: r["text"]).alias("wording"),
        F.transform(F.filter(all_, lambda r: r["text"].isNotNull()), lambda r: F.struct(r["opens"].alias("opens"), r["text"].alias("text"))).alias("open"),
        # the collection layout's header is no line of its table
        F.filter(F.transform(F.when(F.col("layout") == "collection", F.slice(all_, 2, F.size(all_))).otherwise(all_), lambda r: r["code"]), lambda c: c.isNotNull()).alias("codes"),
    )
    parsed = _fields()
    field = lambda f: F.coalesce(*(F.when(F.col("layout") == k, fields[f]) for k, fields in parsed.items() if f in fields))
    found = blocks.select(document, "block", "page", "layout", *(field(f).alias(f) for f in FIELDS), "codes")
    return found.where(F.col("name").rlike(f"^{NAME}$"))


def notes(chosen: DataFrame, found: DataFrame, *, document: str) -> DataFrame:
    """(document, severity, message): documents without a layout, without variables, with lost headers, or with few categories."""
    counts = found.groupBy(document).agg(F.count("*").alias("n"), F.count_if(F.size("codes") > 0).alias("coded"))
    both = chosen.join(counts, document, "left").na.fill({"n": 0, "coded": 0})
    text = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    layout, headers, n, coded = F.col("layout"), F.col("headers").cast("string"), F.col("n").cast("string"), F.col("coded").cast("string")
    note = lambda severity, message: F.struct(F.lit(severity).alias("severity"), message.alias("message"))
    unread = F.when(layout.isNull(), note("warning", F.lit("no known layout; text is not parsed")))
    none = F.when((F.col("n") == 0) & layout.isNotNull(), note("warning", text(layout, " layout with ", headers, " headers, but no variable parsed from them")))
    lost = F.when((F.col("n") > 0) & (F.col("n") < F.col("headers") * 0.9), note("info", text(layout, " layout: ", n, " variables from ", headers, " headers")))
    few = F.when((F.col("n") >= 20) & (F.col("coded") < F.col("n") * 0.15), note("info", text(coded, " of ", n, " variables have categories")))
    all_ = both.select(document, F.explode(F.array_compact(F.array(unread, none, lost, few))).alias("note"))
    return all_.select(document, "note.*")
