"""Tables that are built once from a source and kept in the shared folder: search indexes, vocabularies."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: What is kept by key: the source, the path and the schema.
_KEPT: dict[tuple, list[tuple[DataFrame, str, object]]] = {}
_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where the session is local and names none."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return _OWN.setdefault(sc.applicationId, "file://" + tempfile.mkdtemp(prefix="fieldwork-"))


def _hadoop(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def state_of(source: DataFrame) -> tuple:
    """Path, length and time of each of a source's files: it changes when the source does."""
    out = []
    for path in sorted(source.inputFiles()):
        target, fs = _hadoop(source.sparkSession, path)
        status = fs.getFileStatus(target)
        out.append((path, status.getLen(), status.getModificationTime()))
    return tuple(out)


def kept(source: DataFrame, label: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``make(source)``, written as Parquet at its first use and read back from then on.

    What is kept belongs to the source's analysed plan, its column names and the state
    of its files: another filter, join or table in memory has its own. It is built anew
    if the files have changed, and goes when the application ends. ``label`` names what
    is made, with all parameters that it depends on.
    """
    spark = source.sparkSession
    key = (spark.sparkContext.applicationId, label, tuple(source.columns), source.semanticHash(), state_of(source))
    found = next((k for k in _KEPT.get(key, []) if k[0].sameSemantics(source)), None)
    if found is None:
        df = make(source)
        path = scratch(spark, "kept")
        df.write.parquet(path)
        found = source, path, df.schema
        _KEPT.setdefault(key, []).append(found)
    return spark.read.schema(found[2]).parquet(found[1])


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, which goes when the application ends."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    target, fs = _hadoop(spark, path)
    fs.mkdirs(target.getParent())
    fs.deleteOnExit(target)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: its lineage ends there."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
