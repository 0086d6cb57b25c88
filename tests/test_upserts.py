"""Upserting streams: killed and restarted, they leave what one run leaves."""

import pytest
from pyspark.sql import functions as F

from fieldwork.streaming import upserts as U

SCHEMA = "id string, ver long, value double, at timestamp, kind string, no long"


@pytest.fixture
def folder(spark, tmp_path):
    """Three files that arrive one after the other."""
    rows = [[(f"k{(i * 7 + f) % 11}" if i % 13 else None, i % 5 + f, float(i) if i % 4 else None, None, ("answer", "complete", "view")[i % 3], i) for i in range(60)] for f in range(3)]
    for f, some in enumerate(rows):
        spark.createDataFrame(some, SCHEMA).withColumn("at", F.timestamp_seconds(F.lit(1000 * f) + F.col("no"))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return tmp_path


def read(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))


def start(spark, folder, name, **more):
    checks = {"missing": lambda: F.col("value").isNull(), "large": lambda: F.col("value") > 50}
    return U.upsert(read(spark, folder), path=str(folder / name), checkpoint=str(folder / f"{name}-checkpoint"), key="id", version=lambda: F.struct("ver", "no"), checks=checks, **more)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_a_killed_stream_equals_one_run(spark, folder):
    told = []
    start(spark, folder, "whole", on_batch=lambda n, counts: told.append((n, counts["read"]))).awaitTermination()
    assert told == [(0, 60), (1, 60), (2, 60)]

    def fail(number, counts):
        if number == 1:
            raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        start(spark, folder, "killed", on_batch=fail).awaitTermination()
    start(spark, folder, "killed").awaitTermination()
    batch = spark.read.schema(SCHEMA).parquet(str(folder / "in"))
    whole, killed = (U.current(spark, str(folder / n), key="id", version=F.struct("ver", "no")) for n in ("whole", "killed"))
    # files arrive in order of time, so the later batch has the later of equal versions
    assert rows(whole) == rows(killed) == rows(U.last_records(batch, "id", F.struct("ver", "no", "at")).select(*whole.columns))
    for part in ("issues", "progress"):
        assert rows(spark.read.parquet(str(folder / "whole" / part))) == rows(spark.read.parquet(str(folder / "killed" / part)))
    issues = spark.read.parquet(str(folder / "whole" / "issues"))
    assert issues.count() == batch.where("value IS NULL").count() + batch.where("value > 50").count()
    one = U.compacted(spark, str(folder / "whole"), str(folder / "one"), key="id", version=F.struct("ver", "no"))
    assert one.count() == whole.count() and rows(U.current(spark, str(folder / "one"), key="id", version=F.struct("ver", "no"))) == rows(whole)


def test_sessions_are_resumed_after_a_restart(spark, folder):
    out = []

    def run(most):
        q = U.resumed_sessions(read(spark, folder), session="id", at="at", order="no", kind="kind")
        w = q.writeStream.foreachBatch(lambda df, n: out.extend(df.collect())).outputMode("update").option("checkpointLocation", str(folder / "sessions"))
        w.trigger(availableNow=True).start().awaitTermination()

    run(1)
    extra = [("k3", 9, 1.0, None, "complete", 999)]
    spark.createDataFrame(extra, SCHEMA).withColumn("at", F.timestamp_seconds(F.lit(9000))).coalesce(1).write.mode("append").parquet(str(folder / "in"))
    before = {r.session: r for r in out}
    run(1)
    last = {r.session: r for r in out}
    batch = spark.read.schema(SCHEMA).parquet(str(folder / "in")).where("id IS NOT NULL")
    want = batch.groupBy("id").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "answer").alias("a"), F.max_by("kind", F.struct("at", "no")).alias("k")).collect()
    assert {(r.id, r.n, r.a, r.k) for r in want} == {(s.session, s.events, s.answers, s.last_kind) for s in last.values()}
    assert last["k3"].events == before["k3"].events + 1 and last["k3"].status == "complete"
