"""Exact nearest neighbours by a block matrix join over int8 tiles.

Candidates are dealt into groups of about GROUP_ROWS rows, queries into blocks of
about BLOCK_ROWS, and every (block, group) pair is one tile. A stated query set
meets all rows in blocks; only each query's best rows of a tile leave it.

In a tile, unit vectors are quantised to int8 with a scale of their own. The integer
product of two quantised vectors, times both scales, differs from their cosine by at
most |v - v'| + |u - u'| |v'| (Cauchy and Schwarz; both residuals are measured). A
candidate whose upper bound lies below a query's k-th largest lower bound cannot be
among its k nearest; the rest are recomputed in double precision on the original
vectors and merged by heaps, first within the tile, then over all tiles. The result
equals a full scan.

Integer products are exact: they are computed in float32 while dimensions * 127^2
stays below 2^24, and in float64 above.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components take no part, as query or candidate, nor do rows without an id. A query
is compared with vectors of its own length. Rows with the query's id are its own
and no candidates; other repeated rows are candidates one by one, equal scores in
order of id. Fewer candidates than k are all returned. An empty table gives an empty
result. Other columns are neither read nor changed.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldwork.llm.common import read

GROUP_ROWS = 4096
BLOCK_ROWS = 1024
NEAREST = 5
QUERY_STEP = 50

_TILE = "query_id long, query_no long, vec_id long, score double"


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, residual norms and norms after quantisation."""
    scale = np.abs(unit).max(axis=1) / 127.0
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    return q, scale, np.sqrt(((unit - back) ** 2).sum(axis=1)), np.sqrt((back**2).sum(axis=1))


def cosines(u: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Cosines in double precision; equal vectors get equal scores."""
    return (many * u).sum(axis=1) / (np.sqrt((u * u).sum()) * np.sqrt((many * many).sum(axis=1)))


def tile(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> Iterator[tuple[int, list[tuple[float, int]]]]:
    """(query's row, its k nearest as (score, id)) for one block and one group."""
    unit_q = q / np.abs(q).max(axis=1)[:, None]
    unit_q /= np.sqrt((unit_q**2).sum(axis=1))[:, None]
    unit_c = c / np.abs(c).max(axis=1)[:, None]
    unit_c /= np.sqrt((unit_c**2).sum(axis=1))[:, None]
    qi, qs, qr, _ = quantised(unit_q)
    ci, cs, cr, cn = quantised(unit_c)
    kind = np.float32 if q.shape[1] * 127 * 127 < 1 << 24 else np.float64
    product = qi.astype(kind) @ ci.astype(kind).T
    # the slack covers the rounding of the scales, of the unit vectors and of the sums below
    for i in range(len(q)):
        near = product[i].astype(np.float64) * (qs[i] * cs)
        bound = cr + qr[i] * cn + 1e-9
        own = c_ids == q_ids[i]
        low = np.where(own, -np.inf, near - bound)
        n = len(low) - int(own.sum())
        if n <= 0:
            continue
        least = np.partition(low, len(low) - k)[len(low) - k] if n > k else -np.inf
        stay = np.flatnonzero((near + bound >= least) & ~own)
        scores = cosines(q[i], c[stay])
        best = heapq.nsmallest(k, zip((-scores).tolist(), c_ids[stay].tolist(), strict=True))
        yield i, [(-s, v) for s, v in best]


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(finite & F.exists("v", lambda x: x != 0))


def nearest(queries: DataFrame, candidates: DataFrame, *, id_col: str, vector_col: str, k: int = NEAREST, group_rows: int = GROUP_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest candidates by cosine."""
    c, q = usable(candidates, id_col, vector_col), usable(queries, id_col, vector_col)
    groups = max(1, -(-c.count() // group_rows))
    blocks = max(1, -(-q.count() // block_rows))
    dims = F.size("v").alias("dims")
    # a repeated query row is a query of its own: its number tells it apart
    q = q.withColumn("query_no", F.row_number().over(Window.partitionBy("id").orderBy("v")) - 1)
    left = c.select("id", "v", dims, F.pmod(F.xxhash64("id", "v"), F.lit(groups).cast("long")).alias("g"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
    right = q.select("id", "query_no", "v", dims, F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g"))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, float]] = []
        if len(a) and len(b):
            vectors = [np.asarray(t.column("v").combine_chunks().flatten()).reshape(len(t), -1) for t in (a, b)]
            ids = [t.column("id").to_numpy() for t in (a, b)]
            no = b.column("query_no").to_numpy()
            for i, best in tile(ids[1], vectors[1], ids[0], vectors[0], k):
                out += [(int(ids[1][i]), int(no[i]), v, s) for s, v in best]
        columns = list(zip(*out, strict=True)) or [[]] * 4
        return pa.table({n: pa.array(x, t) for n, x, t in zip(("query_id", "query_no", "vec_id", "score"), columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)})

    key = ["dims", "g", "b"]
    tiles = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, _TILE)
    order = Window.partitionBy("query_id", "query_no").orderBy(F.col("score").desc(), "vec_id")
    return tiles.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return nearest(rows.where(F.col("vec_id") % QUERY_STEP == 0), rows, id_col="vec_id", vector_col="embedding")


ORACLE = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.v, c.v) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % {QUERY_STEP} = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {NEAREST}"""
