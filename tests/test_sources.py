"""Readers, writers and stored-table operations."""

import io
import zipfile

from pyspark.sql import functions as F

from fieldwork.operators import tables as T
from fieldwork.sources import files as S


def test_csv_round_trip(spark, tmp_path):
    answers = spark.createDataFrame([("1", "b", 'say "hi"'), ("1", "a", "x,\ny"), ("2", "a", None)], "id string, k string, v string")
    table = S.wide(answers, "id", "k", "v")
    assert table.columns == ["id", "a", "b"]
    S.write_csv(table, str(tmp_path / "out"))
    back = {r.id: (r.a, r.b) for r in S.read_csv(spark, str(tmp_path / "out")).collect()}
    assert back == {"1": ("x,\ny", 'say "hi"'), "2": ("", "")}


def test_jsonl(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"name":"A","lang":"en","page":1}\n\n{"name":" a ","lang":"en","page":2}\n{"name":"B","lang":"fr","page":3}\n')
    load = lambda **k: S.load_jsonl(spark, str(tmp_path / "c.jsonl"), "name string, lang string, page long", **k).count()
    assert (load(lang="en"), load(lang="en", facts=["name"]), load()) == (2, 1, 3)
    S.write_jsonl(spark.createDataFrame([("b", None), ("a", 1)], "k string, v long"), str(tmp_path / "j"), ["k"])
    assert [r.value for r in spark.read.text(str(tmp_path / "j")).collect()] == ['{"k":"a","v":1}', '{"k":"b"}']


def test_subjects_and_paste(spark, tmp_path):
    (tmp_path / "s.tsv").write_text("# map\n\nA\tx\tx\tx\thealth|odd\nB\tx\tx\tx\t\n")
    good, odd = S.read_subjects(spark, str(tmp_path / "s.tsv"), ["health"])
    assert [tuple(r) for r in good.collect()] == [("A", "health")] and [r.subject for r in odd.collect()] == ["odd"]
    cells = spark.createDataFrame([("$1,234\t(5)\r\nabc\t2.5\n",)], "b string").select(S.pasted_cells(F.col("b")).alias("c")).first().c
    assert cells == [[1234.0, -5.0], [None, 2.5]]


def test_nested_archives(spark, tmp_path):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("dir/x.txt", "inside")
    with zipfile.ZipFile(tmp_path / "all.zip", "w") as z:
        z.writestr("b.zip", inner.getvalue())
        z.writestr("readme.txt", "outside")
    got = [(r.bundle, r.path, bytes(r.content)) for r in S.read_archives(spark, str(tmp_path / "all.zip")).collect()]
    assert got == [("all.zip", "readme.txt", b"outside"), ("b.zip", "dir/x.txt", b"inside")]


def test_page_chunks(spark):
    pages = spark.createDataFrame([("d", p, f"t{p}") for p in (101, 1, 100)], "doc string, page long, text string")
    got = {r.first_page: [p.page for p in r.pages] for r in S.page_chunks(pages, "doc", "page", "text").collect()}
    assert got == {1: [1, 100], 101: [101]}


def test_upsert_never_downgrades(spark):
    stored = spark.createDataFrame([("a", "1.10", "old"), ("b", "2.0", "old")], "id string, version string, body string")
    incoming = spark.createDataFrame([("a", "1.9", "new"), ("b", "2.0", "new"), ("c", "1", "new")], "id string, version string, body string")
    assert {r.id: r.body for r in T.upsert_surveys(stored, incoming, "id", "version").collect()} == {"a": "old", "b": "new", "c": "new"}


def test_queue_counts_and_pages(spark):
    cases = spark.createDataFrame([("1", "completed"), ("2", "new"), ("3", "odd")], "case_id string, status string")
    assert [r.case_id for r in T.case_queue(cases, "status", ["case_id"]).collect()] == ["2", "1", "3"]
    codes = spark.createDataFrame([("AB1", "2")], "code string, case_id string")
    assert T.case_of_code(cases, codes, " ab1 ").first().status == "new"
    surveys = spark.createDataFrame([("s", 1), ("t", 2)], "id string, updated long")
    assert [(r.id, r.responses) for r in T.surveys_with_counts(surveys, spark.createDataFrame([("s",)], "id string"), "id", "updated").collect()] == [("t", 0), ("s", 1)]
    items = spark.createDataFrame([("i", n, n in (2, 4)) for n in range(1, 6)], "instrument string, n int, brk boolean")
    assert [r.page for r in T.pages_of(items, "n", F.col("brk")).orderBy("n").collect()] == [1, 2, 2, 3, 3]


def test_what_is_kept_belongs_to_its_table(spark):
    """Filtered, joined and in-memory tables each have their own vocabulary, in one session."""
    from pyspark.sql import functions as F

    from fieldwork.operators import search as S

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    tables = [docs, docs.where("lang = 'fr'"), docs.where("lang = 'de'"), docs.join(docs.where("doc_id < 20").select("doc_id"), "doc_id")]
    tables += [spark.createDataFrame([(t,), (t,)], "text string") for t in ("alpha beta", "delta")]
    for df in [*tables, *tables]:
        got = {(r.term, r.records) for r in S.vocabulary(df, "text").collect()}
        assert got == {(r.term, r.records) for r in S.lexicon(df.select("text"), "text").collect()}
    a, b = (S.postings(docs.where(F.col("lang") == x), "doc_id", "text") for x in ("fr", "de"))
    assert a.select("doc_id").distinct().count() != b.select("doc_id").distinct().count()
    assert a.inputFiles() == S.postings(docs.where(F.col("lang") == "fr"), "doc_id", "text").inputFiles()
