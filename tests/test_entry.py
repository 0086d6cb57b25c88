"""The driver contract: queries against their DuckDB oracles on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_point
from fieldwork.plans import catalogue

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SMALL}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


def plain(rows):
    return sorted(tuple(f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracle(spark, duck, name):
    df = entry_point.queries()[name](spark, SMALL)
    names = sorted(df.columns)
    sql = f"SELECT {', '.join(f'\"{n}\"' for n in names)} FROM ({entry_point.oracle_sql()[name]})"
    assert plain(df.select(*names).collect()) == plain(duck.execute(sql).fetchall())


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


def test_streams_equal_the_batch(spark, tmp_path):
    from fieldwork.streaming import paradata as P

    batch = spark.read.parquet(f"{SMALL}/events.parquet")
    batch.write.parquet(str(tmp_path / "in"))
    stream = P.read_events(spark, str(tmp_path / "in"))
    q = P.fold_sessions(stream).writeStream.format("memory").queryName("folded").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(spark.table("folded").collect()) == sorted(P.fold_sessions(batch).collect())
    w = P.append_to(stream.select("event_id", "ts"), str(tmp_path / "out"), str(tmp_path / "cp"))
    w.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == batch.count()
