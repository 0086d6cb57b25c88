"""Views and classifiers that SQL can't express, and helpers on awkward rows."""

from pyspark.sql import functions as F

from fieldwork.functions import classify as L
from fieldwork.functions import text as X
from fieldwork.operators import search as Q
from fieldwork.operators import views as V

# Paths of archives with what each tells, worked out by hand: (path, code, kind, acronym, cycle, year, language)
FILES = (
    ("ABCS_EFGS/ABCS_EFGS_2011_2012/ABCS_2011_2012_T15.2_v1_eng.pdf", "T15.2", "data-dictionary", "ABCS", "2011_2012", 2011, "en"),
    ("ABCS_EFGS/ABCS_EFGS_2001_C1.1/EFGS_cycle_f3_T3_v2.pdf", "T3", "record-layout", "ABCS", "C1.1", 2001, "fr"),
    ("LFE_XPA/LFE_T4_DataDictionary_January2020.pdf", "T4", "data-dictionary", "LFE", None, None, "en"),
    ("QRS_TUV_2006/5108_QRS-TUV_C2006_T15.2_fra.doc", "T15.2", "data-dictionary", "QRS", "2006", 2006, "fr"),
    ("QRS_TUV_2006/qrs_2008-2017_t4_f3_T15-2_v2.pdf", "T15.2", "data-dictionary", "QRS", "2006", 2006, "en"),
    ("Vital Statistics/FAQ/ALB_Albumin_E.pdf", None, "reference", None, None, None, "en"),
    ("ABCS_EFGS/ABCS_EFGS_Cycle_6_Wave_3/EFGS_11.1_v1.pdf", "T11.1", "alphabetic-index", "ABCS", "Cycle_6_Wave_3", None, "fr"),
    ("WXY_ZAB/Main_Data_Dictionary_and_Alphabetical_Index.pdf", None, "data-dictionary", "WXY", None, None, "en"),
    ("WXY_ZAB/Guide de l'utilisateur 1999.docx", None, "user-guide", "WXY", None, 1999, "fr"),
    ("WXY_ZAB/notes T05.2.pdf", "T5.2", "reference", "WXY", None, None, "unknown"),
    ("/x\\y/photo", None, "unknown", None, None, None, "unknown"),
    ("DAD_NAC_ABCS/DAD_no freqs_F.xlsx", None, "data-dictionary", "DAD", None, None, "fr"),
)


def loop_rows(items, tolerance=2.0, gap=2.5):
    """A plain loop: the first item of a row decides what is in it."""
    rows = []
    for it in sorted(items, key=lambda i: (-i["y"], i["x"])):
        if rows and abs(it["y"] - rows[-1][0]["y"]) <= tolerance:
            rows[-1].append(it)
        else:
            rows.append([it])
    out = []
    for row in rows:
        line, end = "", None
        for it in sorted(row, key=lambda i: i["x"]):
            if end is not None and it["x"] - end >= gap:
                line += "   "
            line += it["t"]
            end = it["x"] + it["w"]
        out.append(line)
    return out


def test_rows_of_items(spark):
    pages = {
        1: [(0.0, 100.0, 10.0, "a"), (11.0, 99.0, 5.0, "b"), (20.0, 98.0, 5.0, "c"), (0.0, 96.5, 5.0, "d"), (0.0, 50.0, 3.0, "e")],
        2: [(5.0, 10.0, 1.0, "x"), (0.0, 11.9, 1.0, "y"), (9.0, 8.1, 1.0, "z"), (1.0, 7.9, 1.0, "w")],
    }
    rows = [(p, *i) for p, items in pages.items() for i in items]
    df = spark.createDataFrame(rows, "page long, x double, y double, w double, t string")
    got = {}
    for r in V.rows_of_items(df, page=["page"], x="x", y="y", width="w", text="t").orderBy("page", "row").collect():
        got.setdefault(r.page, []).append(r.line)
    assert got == {p: loop_rows([dict(zip("xywt", i, strict=True)) for i in items]) for p, items in pages.items()}
    assert V.rows_of_items(df.limit(0), page=["page"], x="x", y="y", width="w", text="t").count() == 0


def test_classified_files(spark):
    rows = [(i, f[0]) for i, f in enumerate(FILES)] + [(99, ""), (100, None)]
    got = {r.no: r.file for r in L.classified(spark.createDataFrame(rows, "no long, path string"), "path").collect()}
    for i, (_, code, kind, acronym, cycle, year, lang) in enumerate(FILES):
        f = got[i]
        assert (f.tcode, f.doc_kind, f.survey_acronym, f.cycle, f.year, f.lang) == (code, kind, acronym, cycle, year, lang)
    assert got[99].doc_kind == "unknown" and got[99].ext == "" and len(got) == len(rows)


def test_versions_compare_by_number(spark):
    pairs = [("1.2", "1.2.0", 0), ("1.10", "1.9", 1), ("1.2b", "1.2", 0), ("2", "1.9.9", 1), ("", "0", 0), ("1.0.1", "1", 1)]
    df = spark.createDataFrame(pairs, "a string, b string, want int")
    a, b = X.version_key(F.col("a")), X.version_key(F.col("b"))
    assert all(r.got == r.want for r in df.select("want", F.when(a > b, 1).when(a == b, 0).otherwise(-1).alias("got")).collect())


def test_query_weights():
    w = Q.query_weights("The jobs of schools")
    assert w["job"] == 1.0 and w["school"] == 1.0 and w["student"] == 0.5 and w["work"] == 0.5 and "the" not in w
    assert Q.query_weights("of the") == {}


def test_index_is_kept_until_the_table_changes(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame([(1, "alpha beta beta"), (2, "gamma")], "id long, text string").write.parquet(path)
    index = Q.postings(spark.read.parquet(path), "id", "text")
    again = Q.postings(spark.read.parquet(path), "id", "text")
    assert index.inputFiles() == again.inputFiles()
    assert [r.id for r in Q.tfidf_search(index, key="id", query={"beta": 1.0}).collect()] == [1]
    assert Q.tfidf_search(index, key="id", query={}).count() == 0
    spark.createDataFrame([(3, "beta")], "id long, text string").write.mode("append").parquet(path)
    fresh = Q.postings(spark.read.parquet(path), "id", "text")
    assert sorted(r.id for r in Q.tfidf_search(fresh, key="id", query={"beta": 1.0}).collect()) == [1, 3]


def test_search_falls_back_on_a_suggestion(spark):
    docs = spark.createDataFrame([(i, "housing tenure and rent") for i in range(3)], "id long, text string")
    folder = "/tmp/" + __name__
    docs.write.mode("overwrite").parquet(folder)
    docs = spark.read.parquet(folder)
    found = Q.search_or_suggestion(docs, key="id", text="text", query="housin").collect()
    assert len(found) == 3 and {r.searched for r in found} == {"housing"}
    assert Q.search_or_suggestion(docs, key="id", text="text", query="zzzz").count() == 0
    assert {r.searched for r in Q.search_or_suggestion(docs, key="id", text="text", query="tenure").collect()} == {"tenure"}


def test_files_are_classified_on_all_cores(spark, tmp_path):
    spark.createDataFrame([(i, f"AAAS_BBBQ/notes T04.{i % 9}.pdf") for i in range(200)], "no long, path string").coalesce(1).write.parquet(str(tmp_path / "files"))
    few = spark.read.parquet(str(tmp_path / "files"))
    assert few.rdd.getNumPartitions() == 1
    found = L.classified(few, "path")
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert found.where("file.survey_acronym = 'AAAS'").count() == 200


def _shuffled(spark):
    """Rows that stages have shuffled so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    gateway = spark.sparkContext._gateway
    no = gateway.jvm.java.util.ArrayList()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(no, False, False, gateway.new_array(gateway.jvm.double, 0), no)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_postings_are_shuffled_once(spark, tmp_path):
    texts = [(i, " ".join(f"w{(i * 7 + j * j) % 400}" for j in range(150))) for i in range(100)]
    spark.createDataFrame(texts, "id long, text string").write.parquet(str(tmp_path / "docs"))
    before = _shuffled(spark)
    index = Q.postings(spark.read.parquet(str(tmp_path / "docs")), "id", "text")
    taken, n = _shuffled(spark) - before, index.count()
    assert n == sum(len(set(t.split())) for _, t in texts)
    # documents and the parts' vocabularies come on top
    assert taken < n + 4 * 400 + 1000


def test_cells_are_not_dealt_out_by_row_and_column(spark):
    cells = spark.range(2000).select((F.col("id") % 100).alias("who"), F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("r"), F.lit("F").alias("k"), F.lit(1).alias("v"))
    totals = lambda closed: V.cell_totals(cells, spark.createDataFrame(closed, "r string, k string"), response="who", row="r", column="k", value="v")
    found = totals([("A", "F")])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert {(r.who % 2, r.r, r.k, r.total) for r in found.collect()} == {(1, "B", "TOT", 20), (1, "TOT", "F", 20), (1, "TOT", "TOT", 20)}
    assert totals([]).count() == 300
