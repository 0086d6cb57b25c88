"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A text is the set of its hashed words, their beginnings and bucketed shape features (symbols,
capitals, repeated lines, length and so on). One weight vector over hash buckets,
shared by all grades, gives a text's value f; ordered thresholds t_1 < t_2 < ... cut
the line: P(grade <= k) = sigmoid(t_{k+1} - f). From that come the expected grade and
the tail probability of the highest grade, and the tail decides what is kept.

Ratings: 0 low quality, 1 good but toxic, 2 good and not toxic.

The fit uses the FIT_ROWS labelled documents whose ids hash lowest, a bounded sample;
a fifth of them is held out. The cutoff is the tail probability that all but
LOST_CLEAN of the clean documents reach, at most one half: of all labelled ones that
were not fitted, in one pass over the table. Scoring covers every row and whole texts.

A bucket's weight is a prior, its log ratio between clean and other fitted texts, times
a factor that the regression learns.

Defined results: a null or empty text has shape features only; labels with a null in
any column are not used, and labels that repeat a document count once, by the lowest
quality and highest toxicity; a document id that repeats is fitted once; with no
label, or labels of one grade only, nothing is learnt: f is 0 and all rows are kept.
Other columns are neither read nor changed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldwork.llm.common import ASCII_LOWER, WordHashes, read, stored

FIT_ROWS = 8_000
BUCKETS = 1 << 18
#: A bucket that fewer fitted texts have is left at 0.
LEAST_TEXTS = 5
GRADES = 3
#: Lengths in bytes of the beginnings of words that count as features.
STEMS = (4, 5, 6, 7, 8)
LOST_CLEAN = 0.005
STEPS = 200
RIDGE = 1e-3
SMOOTH = 4.0
LEAST_GAP = 0.01

_NOT_LETTER = bytes(x for x in range(128) if not 97 <= x <= 122)
_BLANK = bytes.maketrans(_NOT_LETTER, b" " * len(_NOT_LETTER))
_TABLE = bytes(_BLANK[ASCII_LOWER[b]] for b in range(256))
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))

_hashes = WordHashes()


def _shape(text: bytes, raw: list[bytes], words: set[bytes]) -> list[bytes]:
    n = max(1, len(raw))
    size = max(1, len(text))
    lines = [x for x in text.split(b"\n") if x.strip()]
    ratios = {
        "symbols": (len(text) - len(text.translate(None, _SYMBOLS))) / n,
        "bars": text.count(b"|") / n,
        "shouts": text.count(b"!") / n,
        "capitals": (len(text) - len(text.translate(None, _UPPER))) / size,
        "same": 1 - len(words) / n,
        "lines": 1 - len(set(lines)) / max(1, len(lines)),
        "next": sum(map(bytes.__eq__, raw[1:], raw[:-1])) / n,
    }
    out = [f"\n{name}>{cut}".encode() for name, x in ratios.items() for cut in (0.02, 0.05, 0.1, 0.2, 0.4, 0.7, 0.95) if x > cut]
    return [*out, *(f"\nwords>{1 << k}".encode() for k in range(3, 14) if len(raw) > 1 << k)]


def features(text: bytes) -> np.ndarray:
    """Sorted hash buckets of a text."""
    raw = text.split()
    words = set(text.translate(_TABLE).split())
    stems = {w[:k] + b"\n" for k in STEMS for w in words if len(w) > k}
    return np.unique(_hashes.of([*words, *stems, *_shape(text, raw, set(raw))]) % np.uint64(BUCKETS)).astype(np.int32)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _features(texts: pa.Array) -> pa.Array:
    return pa.array([features(x.as_py() or b"") for x in texts], pa.list_(pa.int32()))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray
    cutoff: float

    def value(self, buckets: np.ndarray) -> float:
        return float(self.weights[buckets].sum())

    def tails(self, values: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1.. of each value, a column a grade."""
        return _sigmoid(values[:, None] - self.thresholds[None, :])


def fit_weights(rows: list[np.ndarray], grades: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights by bucket and thresholds, by accelerated full-batch gradient steps.

    A bucket's weight is its log ratio between clean and other fitted texts (with
    SMOOTH texts added in their proportion, so that unseen is 0) times a factor that
    the regression learns under a ridge. Common tell-tale words thus move first, and
    words seen in a few texts stay small.
    """
    weights = np.zeros(BUCKETS)
    share = [np.clip((grades >= k).mean(), 1e-3, 1 - 1e-3) if len(grades) else 0.5 for k in range(1, GRADES)]
    t = np.array([-np.log(s / (1 - s)) for s in share])
    for k in range(1, len(t)):
        t[k] = max(t[k], t[k - 1] + LEAST_GAP)
    if len(set(grades.tolist())) < 2:
        return weights, t
    n = len(rows)
    flat = np.concatenate(rows)
    row = np.repeat(np.arange(n, dtype=np.int32), [len(r) for r in rows])
    top = grades == grades.max()
    texts = np.bincount(flat, minlength=BUCKETS)
    clean = np.bincount(flat[top[row]], minlength=BUCKETS)
    used = np.flatnonzero(texts >= LEAST_TEXTS)
    number = np.full(BUCKETS, -1, dtype=np.int32)
    number[used] = np.arange(len(used))
    col = number[flat]
    row, col = row[col >= 0], col[col >= 0]
    part = top.mean()
    ratio = np.log((clean[used] + SMOOTH * part) / part) - np.log((texts[used] - clean[used] + SMOOTH * (1 - part)) / (1 - part))

    def forward(u: np.ndarray) -> np.ndarray:
        return np.bincount(row, weights=(ratio * u)[col], minlength=n)

    def back(d: np.ndarray) -> np.ndarray:
        return ratio * np.bincount(col, weights=d[row], minlength=len(used))

    x = np.ones(len(used))
    for _ in range(10):
        x = back(forward(x / np.sqrt((x * x).sum())))
    rate = 1 / (0.5 * np.sqrt((x * x).sum()) / n + RIDGE)
    at = np.arange(n)
    u = ahead = np.zeros(len(used))
    for step in range(1, STEPS + 1):
        f = forward(ahead)
        cut = np.concatenate([np.full((n, 1), -np.inf), t[None, :] - f[:, None], np.full((n, 1), np.inf)], axis=1)
        s = _sigmoid(cut)
        slope = s * (1 - s)
        up, down = slope[at, grades + 1], slope[at, grades]
        inside = np.maximum(s[at, grades + 1] - s[at, grades], 1e-12)
        # minus the gradients of the log likelihood in f and in the thresholds
        df = (up - down) / inside / n
        dt = np.array([((grades == k + 1) * down / inside - (grades == k) * up / inside).sum() / n for k in range(len(t))])
        new = ahead - rate * (back(df) + RIDGE * ahead)
        ahead = new + (step - 1) / (step + 2) * (new - u)
        u = new
        t = t - dt
        for k in range(1, len(t)):
            t[k] = max(t[k], t[k - 1] + LEAST_GAP)
    weights[used] = ratio * u
    return weights, t


def rated_grades(labels: DataFrame, id_col: str) -> DataFrame:
    """(id, grade, place): labelled documents, in the order in which they are fitted."""
    rated = labels.select(F.col(id_col).alias("id"), "quality", "toxic").dropna().groupBy("id").agg(F.min("quality").alias("q"), F.max("toxic").alias("x"))
    grade = F.when(F.col("q") < 1, 0).when(F.col("x") > 0, 1).otherwise(2)
    return rated.select("id", grade.alias("grade"), F.xxhash64("id").alias("place"))


def fitted(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, fit_rows: int = FIT_ROWS) -> tuple[OrdinalModel, set | None]:
    """A model of the labelled documents whose ids hash lowest, ``fit_rows`` at most, and the ids fitted; None if there is but one grade."""
    rated = rated_grades(labels, id_col)
    sample = rated.orderBy("place", "id").limit(fit_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"))
    rows = texts.join(F.broadcast(sample), "id").select("id", "grade", "place", _features("t").alias("f"))
    table = rows.groupBy("place", "id", "grade").agg(F.min("f").alias("f")).toArrow().sort_by([("place", "ascending"), ("id", "ascending")])
    lists = table.column("f").combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    buckets = np.split(lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())[:-1]) if len(lists) else []
    grades = table.column("grade").to_numpy().astype(np.int64)
    held = np.arange(len(grades)) % 5 == 4
    weights, thresholds = fit_weights([b for b, h in zip(buckets, held, strict=True) if not h], grades[~held])
    ids = {i for i, h in zip(table.column("id").to_pylist(), held, strict=True) if not h}
    return OrdinalModel(weights, thresholds, 0.0), ids if len(set(grades.tolist())) > 1 else None


def train(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, fit_rows: int = FIT_ROWS) -> OrdinalModel:
    """A fitted model with its cutoff."""
    model, ids = fitted(docs, labels, id_col=id_col, text_col=text_col, fit_rows=fit_rows)
    if ids is not None:
        model.cutoff = cutoff(docs.select(F.col(id_col).alias("id"), graded(F.col(text_col), model)["tail"].alias("tail")), rated_grades(labels, id_col), ids)
    return model


def cutoff(tails: DataFrame, rated: DataFrame, fitted_ids: set) -> float:
    """The tail that all but LOST_CLEAN of the labelled clean documents reach that were not fitted.

    ``tails`` has (id, tail) of every document, so no text is joined; ``fitted_ids`` has
    ``fit_rows`` ids at most. The rank of the quantile found is off by a millionth of
    the documents at most.
    """
    spark = tails.sparkSession
    known = spark.createDataFrame([(i,) for i in sorted(fitted_ids)], [("id")], verifySchema=False) if fitted_ids else rated.select("id").limit(0)
    clean = rated.where(F.col("grade") == GRADES - 1).join(F.broadcast(known), "id", "left_anti").select("id")
    found = tails.join(clean, "id").agg(F.percentile_approx("tail", LOST_CLEAN, 1_000_000).alias("p")).first()["p"]
    return 0.0 if found is None else float(min(0.5, found))


_RESULT = T.StructType([T.StructField("expected_grade", T.DoubleType()), T.StructField("tail", T.DoubleType()), T.StructField("kept", T.BooleanType())])


def graded(text: Column, model: OrdinalModel) -> Column:
    """A struct (expected_grade, tail, kept) for a text column."""

    @F.arrow_udf(_RESULT)
    def grade(texts: pa.Array) -> pa.Array:
        values = np.array([model.value(features(x.as_py() or b"")) for x in texts], dtype=np.float64)
        tails = model.tails(values)
        return pa.StructArray.from_arrays([pa.array(tails.sum(axis=1)), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= model.cutoff)], _RESULT.names)

    return grade(text.cast("binary"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model, ids = fitted(docs, labels, id_col="doc_id", text_col="text")
    # every text is graded once; the cutoff comes from the grades
    done = stored(docs.select("doc_id", graded(F.col("text"), model).alias("r")).select("doc_id", "r.expected_grade", "r.tail"), "ordinal-grades")
    if ids is not None:
        model.cutoff = cutoff(done.select(F.col("doc_id").alias("id"), "tail"), rated_grades(labels, "doc_id"), ids)
    return done.withColumn("kept", F.col("tail") >= model.cutoff)
