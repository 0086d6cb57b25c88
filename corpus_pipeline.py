"""A training-corpus pipeline over ``documents``, in five stages.

Every stage works on the rows its predecessor kept; its result is written as Parquet
to the shared folder and read back. All but the last return the columns of
``documents``:

1. quality rules       rejects documents by the base rules and the certified cutoffs
2. n-gram Jaccard join keeps one document of every group of near copies
3. PII                 replaces personal data in the texts by surrogates
4. mixing              repeats or drops whole documents, so that each source's share
                       of the words comes near its target
5. byte-level BPE      encodes the texts, and decodes the ids again

Stage 4 takes from the block mix how many words of a document are used. Divided by
its size that is the expected number of its copies; the fraction is drawn by a hash
of id and text, so reruns agree and rows of one id are drawn apart. Nulls, empty texts, repeated rows and empty tables are
treated as the operators' own docstrings say; a document without words is rejected
in stage 1.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwork.llm import bpe, jaccard_join, mixing, quality_rules, surrogates
from fieldwork.llm.common import read, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # the cutoffs need the counts alone; the rows are counted again as they are judged, and go along
    # as a whole, so that their columns' names can't clash
    counts = quality_rules.features(F.col("text")).alias("f")
    measured = stored(docs.select("doc_id", "lang", counts), "pipeline-measured")
    cutoffs = quality_rules.thresholds(measured, read(spark, sf_dir, "labels"), f="f", id_col="doc_id", stratum_col="lang")
    whole = F.struct(*(docs[c] for c in docs.columns)).alias("row")
    return quality_rules.judged(docs.select(whole, "lang", counts), cutoffs, f="f", stratum_col="lang").where("__kept").select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs, id_col="doc_id", text_col="text")


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = surrogates.replaced(docs, text_col="text")
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    whole = F.struct(*(docs[c] for c in docs.columns)).alias("row")
    sized = docs.select(whole, F.col("doc_id").alias("of"), mixing.word_count(F.col("text")).alias("words"), F.xxhash64(F.lit("copies"), "doc_id", "text").alias("draw"))
    taken = mixing.mixed(docs, size=mixing.word_count(F.col("text")))["taken"].where("taken > 0")
    # rows of equal id and size share what is taken of them
    share = taken.groupBy("id", "size").agg((F.sum("taken") / F.sum("size")).alias("share"))
    both = sized.join(share, F.col("of").eqNullSafe(F.col("id")) & (F.col("words") == F.col("size")))
    drawn = F.pmod("draw", F.lit(1_000_000)) / 1_000_000 < F.col("share") - F.floor("share")
    copies = F.floor("share").cast("int") + drawn.cast("int")
    return both.withColumn("copy", F.explode(F.array_repeat(F.lit(0), copies))).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # the executors hold what the stages before have left, so the workers get by with less memory here
    both = bpe.round_trip(docs, "doc_id", "source", text_col="text", **bpe.public_vocabulary(), memo_pieces=100_000, chunk_bytes=500_000)
    return both.select("doc_id", "source", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("back", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_copies),
    ("PII surrogates", pii),
    ("mixing to target weights", mix),
    ("byte-level BPE", tokens),
]

#: SQL can't express the near-copy components, the surrogates and the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
