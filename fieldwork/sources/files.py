"""Readers and writers: CSV, JSON lines, TSV maps, clipboard blocks, nested zip archives."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Reference data: all columns text, quotes doubled inside quotes, missing cells ''."""
    df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', inferSchema=False)
    return df.na.fill("")


def answer_keys(answers: DataFrame, key: str) -> list[str]:
    """All keys of a long answer table, sorted: the columns of an export."""
    return sorted(r[0] for r in answers.select(key).where(F.col(key).isNotNull()).distinct().collect())


def wide(answers: DataFrame, response: str, key: str, value: str, keys: list[str] | None = None) -> DataFrame:
    """One row a response, one column a key; null cells ''."""
    keys = answer_keys(answers, key) if keys is None else keys
    return answers.groupBy(response).pivot(key, keys).agg(F.first(value)).na.fill("") if keys else answers.select(response).distinct()


def write_csv(df: DataFrame, path: str) -> None:
    """Every cell quoted, quotes doubled, nulls ''."""
    df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns)).write.csv(path, header=True, quoteAll=True, quote='"', escape='"', emptyValue="")


def write_paradata_csv(events: DataFrame, payload: str, path: str) -> None:
    """As ``write_csv``, with a structured payload as JSON text."""
    kind = events.schema[payload].dataType.typeName()
    write_csv(events.withColumn(payload, F.to_json(payload)) if kind in ("struct", "map", "array") else events, path)


def fact_key(columns: list[str]) -> Column:
    """A hash of normalised columns: equal facts from different places have equal keys."""
    parts = [F.coalesce(F.lower(F.trim(F.regexp_replace(F.col(c).cast("string"), r"\s+", " "))), F.lit("")) for c in columns]
    return F.sha2(F.concat_ws("\u0001", *parts), 256)


def load_jsonl(spark: SparkSession, path: str, schema: str, *, lang: str | None = None, facts: list[str] | None = None) -> DataFrame:
    """JSON lines; blank lines are skipped; the language filter comes before the dedupe."""
    df = spark.read.schema(schema).json(path)
    df = df.where(F.col("lang") == lang) if lang else df
    return df.withColumn("__fact", fact_key(facts)).dropDuplicates(["__fact"]).drop("__fact") if facts else df


def write_jsonl(df: DataFrame, path: str, order: list[str]) -> None:
    """Sorted JSON lines; absent values are left out."""
    df.orderBy(*order).select(F.to_json(F.struct(*df.columns)).alias("value")).write.text(path)


def read_subjects(spark: SparkSession, path: str, known: list[str]) -> tuple[DataFrame, DataFrame]:
    """(survey, subject) of a TSV map whose fifth column lists subjects by '|', and unknown subjects."""
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").startswith("#"))
    cells = F.split("value", "\t")
    pairs = lines.select(F.trim(cells[0]).alias("survey"), F.explode(F.split(F.coalesce(F.get(cells, F.lit(4)), F.lit("")), r"\|")).alias("subject"))
    pairs = pairs.withColumn("subject", F.trim("subject")).where("subject <> ''").distinct()
    listed = F.col("subject").isin(*known) if known else F.lit(False)
    return pairs.where(listed), pairs.where(~listed)


def pasted_cells(block: Column) -> Column:
    """Rows of cells of a clipboard block: array<array<double>>; what is no number is null.

    Currency signs and thousands separators go; (1,234) is negative; nothing shifts.
    """

    def number(cell: Column) -> Column:
        bare = F.regexp_replace(F.trim(cell), r"[$€£,\s ]", "")
        negative = bare.rlike(r"^\(.*\)$")
        inside = F.regexp_replace(bare, r"[()]", "")
        value = F.when(inside.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), inside.try_cast("double"))
        return F.when(negative, -value).otherwise(value)

    rows = F.split(F.regexp_replace(F.regexp_replace(block, "\r\n?", "\n"), "\n$", ""), "\n")
    return F.transform(rows, lambda r: F.transform(F.split(r, "\t"), number))


_ENTRY = "archive string, bundle string, path string, size long, content binary"


def read_archives(spark: SparkSession, path: str, *, contents: bool = True) -> DataFrame:
    """Entries of zip archives and of the zips inside them.

    One archive is one task; inside it one bundle is opened at a time, in sorted order,
    after the files of the archive itself. Directories are left out.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def entries(data: bytes, archive: str, bundle: str) -> Iterator[tuple]:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            infos = [i for i in z.infolist() if not i.is_dir()]
            nested = sorted((i for i in infos if not bundle and i.filename.lower().endswith(".zip")), key=lambda i: i.filename)
            for i in infos:
                if i not in nested:
                    yield archive, bundle or archive, i.filename, i.file_size, z.read(i) if contents else None
            for i in nested:
                yield from entries(z.read(i), archive, i.filename)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for row in entries(data.as_py(), name.rsplit("/", 1)[-1], ""):
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()), strict=True)], ["archive", "bundle", "path", "size", "content"])

    return files.mapInArrow(walk, _ENTRY)


def page_chunks(pages: DataFrame, document: str, page: str, text: str, *, size: int = 100) -> DataFrame:
    """(document, first_page, pages): pages in order, ``size`` to a chunk."""
    from fieldwork.functions.text import chunk_start

    rows = pages.withColumn("first_page", chunk_start(F.col(page), size))
    listed = F.array_sort(F.collect_list(F.struct(F.col(page).alias("page"), F.col(text).alias("text"))))
    return rows.groupBy(document, "first_page").agg(listed.alias("pages"))
