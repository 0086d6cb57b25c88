"""Streams that write the latest state of each key, and keep sessions for their return.

A micro-batch is checked record by record, reduced to the last record of each key and
written to a folder of its own, named by the batch's number. A batch that is written
again after a failure replaces its own folder, so a stream that was killed and
restarted leaves what one run would have left. ``current`` reads the last record of
each key over all batches; ``compacted`` writes it as one, from time to time.

Nothing is kept in memory between batches but what the state store holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: The columns that a stored batch has beside the records' own.
BATCH = "batch"


def last_records(df: DataFrame, key: str, version: Column) -> DataFrame:
    """The record of each key with the highest version; records without a key are left out."""
    whole = F.struct(*(F.col(c) for c in df.columns))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(whole, version).alias("__r")).select("__r.*")


def upsert(stream: DataFrame, *, path: str, checkpoint: str, key: str, version: Callable[[], Column], checks: dict[str, Callable[[], Column]] | None = None, on_batch: Callable[[int, dict], None] | None = None) -> StreamingQuery:
    """Writes each batch's last records below ``path/records``, what fails a check below ``path/issues``, and counts below ``path/progress``.

    A record that fails a check is written too: checks report, they don't reject. All
    available input is taken, then the stream ends. ``on_batch`` is told a batch's
    number and its counts once it is written.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            last_records(batch, key, version()).write.mode("overwrite").parquet(f"{path}/records/{BATCH}={number}")
            names = [F.when(failed(), F.lit(name)) for name, failed in (checks or {}).items()]
            issues = batch.select(F.col(key), F.explode(F.array_compact(F.array(*names)) if names else F.array().cast("array<string>")).alias("check_id"))
            issues.write.mode("overwrite").parquet(f"{path}/issues/{BATCH}={number}")
            counts = batch.agg(F.count("*").alias("read"), F.count_if(F.col(key).isNull()).alias("without_key"), F.count_distinct(key).alias("keys"))
            counts.write.mode("overwrite").parquet(f"{path}/progress/{BATCH}={number}")
            if on_batch is not None:
                on_batch(number, counts.first().asDict())
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str, *, key: str, version: Column) -> DataFrame:
    """The last record of each key; of equal versions that of the later batch."""
    rows = spark.read.parquet(f"{path}/records")
    columns = [c for c in rows.columns if c != BATCH]
    return last_records(rows, key, F.struct(version, F.col(BATCH))).select(*columns)


def compacted(spark: SparkSession, path: str, target: str, *, key: str, version: Column) -> DataFrame:
    """``current`` written to a new path as one batch, for ``current`` to read there."""
    current(spark, path, key=key, version=version).write.parquet(f"{target}/records/{BATCH}=-1")
    return spark.read.parquet(f"{target}/records")


SESSION = "session string, events long, answers long, last long, last_kind string, status string"
_STATE = "events long, answers long, last long, last_kind string"


def resumed_sessions(stream: DataFrame, *, session: str, at: str, order: str, kind: str, answer: str = "answer", end: str = "complete") -> DataFrame:
    """SESSION, a row for each session with new events: its state so far, which outlives restarts and batches.

    Events are taken in order of time and ``order``; one that is older than the last
    counts, but does not become the last. ``at`` is a timestamp.
    """
    rows = stream.select(F.col(session).cast("string").alias("session"), F.unix_micros(at).alias("at"), F.col(order).alias("no"), F.col(kind).cast("string").alias("kind")).where("session IS NOT NULL")

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        events, answers, last, last_kind = state.get if state.exists else (0, 0, None, None)
        for b in batches:
            events += len(b)
            answers += int((b["kind"] == answer).sum())
            known = b.dropna(subset=["at"]).sort_values(["at", "no"])
            if len(known) and (last is None or known["at"].iloc[-1] >= last):
                last, last_kind = int(known["at"].iloc[-1]), known["kind"].iloc[-1]
        state.update((events, answers, last, last_kind))
        yield pd.DataFrame({"session": [key[0]], "events": [events], "answers": [answers], "last": [last], "last_kind": [last_kind], "status": ["complete" if last_kind == end else "open"]})

    return rows.groupBy("session").applyInPandasWithState(fold, SESSION, _STATE, "update", GroupStateTimeout.NoTimeout)
