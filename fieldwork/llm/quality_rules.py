"""Quality rules with risk-controlled cutoffs.

Each rule compares one ratio of a text with a cutoff. The cutoffs are not guessed: the
rules share one path of levels from lenient to strict, fixed in advance, and on a
labelled holdout every level must pass an exact binomial test that all rules together
reject at most ``alpha`` of the good documents of a stratum. The sequence stops at the
first level that fails (fixed-sequence testing, so no error is spent on its length), and
``delta`` is divided by the number of strata (Bonferroni). With probability
``1 - delta`` no stratum loses more than ``alpha`` of its good documents to the rules.

The test is Clopper and Pearson's: k rejected of n good documents certify a rate
of at most a if P(Bin(n, a) <= k) is at most the error allowed.

Defined results: a null or empty text has no words, so all counts are 0 and
``base_failed`` is true. A null stratum is a stratum of its own. A stratum with
no or too few labelled good documents certifies no cutoff, and its documents are
judged by the base rules alone. Repeated rows are judged one by one. Labels that
repeat a document count once, by their smallest rating. Other columns are neither
read nor changed.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldwork.llm.common import given_back, read, stored

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")
FEATURE_TYPE = T.StructType([T.StructField(n, T.LongType()) for n in FEATURES])

_SYMBOLS = b"#*$%&|<>"
_NOT_FIRST_BYTE = bytes(range(0x80, 0xC0))
_UPPER = bytes(range(65, 91))


@dataclass(frozen=True)
class Rule:
    """Rejects if ``1000 * count > cutoff * base``; a cutoff for each level, from lenient to strict."""

    name: str
    count: str
    base: str
    cutoffs: tuple[int, ...]


RULES = (
    Rule("symbols", "n_symbols", "n_words", (2000, 1500, 1000, 800, 600, 500, 400, 300, 200, 100, 50, 20)),
    Rule("dup_lines", "n_dup_lines", "n_lines", (900, 850, 800, 750, 700, 650, 600, 550, 500, 450, 400, 350)),
    Rule("repeats", "n_repeat_words", "n_words", (490, 480, 470, 460, 450, 440, 420, 400, 380, 360, 330, 300)),
    Rule("capitals", "n_upper", "word_chars", (900, 800, 700, 600, 500, 400, 350, 300, 250, 200, 150, 100)),
    Rule("long_words", "word_chars", "n_words", (60000, 40000, 30000, 20000, 15000, 12000, 11000, 10000, 9000, 8000, 7500, 7000)),
)
ALPHA = 0.025
DELTA = 0.05


def measure(text: bytes | None) -> tuple[int, ...]:
    """The counts of FEATURES of one UTF-8 text."""
    if not text:
        return (0,) * len(FEATURES)
    words = text.split()
    n = len(words)
    if not n:
        return (0,) * len(FEATURES)
    word_chars = len(b"".join(words).translate(None, _NOT_FIRST_BYTE))
    n_symbols = len(text) - len(text.translate(None, _SYMBOLS))
    n_upper = len(text) - len(text.translate(None, _UPPER))
    n_lines = n_dup = 0
    seen: set[bytes] = set()
    for line in text.split(b"\n"):
        if line.strip():
            n_lines += 1
            n_dup += line in seen
            seen.add(line)
    n_repeat = 0
    if n > 3:
        ids: dict[bytes, int] = {}
        put = ids.setdefault
        at = np.fromiter((put(w, len(ids)) for w in words), dtype=np.int64, count=n)
        v = len(ids)
        pair = at[:-1] * v + at[1:]
        if v >= 1 << 20:
            pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        window = pair[:-1] * v + at[2:]
        _, place, times = np.unique(window, return_inverse=True, return_counts=True)
        twice = times[place] > 1
        if twice.any():
            covered = np.zeros(n, dtype=bool)
            for k in range(3):
                covered[k : n - 2 + k] |= twice
            n_repeat = int(covered.sum())
    return n, word_chars, n_symbols, n_dup, n_repeat, n_lines, n_upper


@F.arrow_udf(FEATURE_TYPE)
def _measured(texts: pa.Array) -> pa.Array:
    rows = np.array([measure(x.as_py()) for x in texts], dtype=np.int64).reshape(-1, len(FEATURES))
    given_back()
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(rows[:, i])) for i in range(len(FEATURES))], list(FEATURES))


# else a filter on the counts is pushed below them, and a task counts twice, with two workers that hold its texts
_measured = _measured.asNondeterministic()


def features(text: Column) -> Column:
    """A struct of FEATURES for a text column."""
    return _measured(text.cast("binary"))


def base_failed(f: str) -> Column:
    return (F.col(f"{f}.n_words") < 50) | (100 * F.col(f"{f}.n_repeat_words") > 50 * F.col(f"{f}.n_words"))


def _exceeds(f: str, rule: Rule, cutoff: Column) -> Column:
    return 1000 * F.col(f"{f}.{rule.count}") > cutoff * F.col(f"{f}.{rule.base}")


def _rejected(f: str, rules: tuple[Rule, ...], cutoff: Callable[[Rule], Column]) -> Column:
    """Whether any rule rejects; a cutoff that is null rejects nothing."""
    return reduce(or_, (F.coalesce(_exceeds(f, r, cutoff(r)), F.lit(False)) for r in rules))


def certified(n: int, k: int, alpha: float, error: float) -> bool:
    """Whether k rejections among n bound the rate by alpha, with that error."""
    if n == 0 or k >= n:
        return False

    def tail(i: int, step: int) -> float:
        """The terms from i on; they fall away from the mean, and are summed until they no longer count."""
        term = math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(alpha) + (n - i) * math.log1p(-alpha))
        total = 0.0
        while 0 <= i <= n and term > 1e-18 * total:
            total += term
            term *= i * (1 - alpha) / ((n - i + 1) * alpha) if step < 0 else (n - i) * alpha / ((i + 1) * (1 - alpha))
            i += step
        return total

    return (tail(k, -1) if k < n * alpha else 1 - tail(k + 1, 1)) <= error


def thresholds(measured: DataFrame, labels: DataFrame, *, f: str, id_col: str, stratum_col: str, rules: tuple[Rule, ...] = RULES, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row a stratum: ``stratum``, ``n_good``, ``level`` and each rule's certified cutoff (null: none).

    ``measured`` has the struct ``f``; ``labels`` has the id and ``quality`` (1: good).
    The holdout is summed to one row a stratum before anything moves to one place.
    """
    levels = len(rules[0].cutoffs)
    good = labels.groupBy(F.col(id_col).alias("__id")).agg(F.min("quality").alias("__q")).where("__q = 1").select("__id")
    narrow = measured.select(F.col(id_col).alias("__id"), F.col(stratum_col).alias("stratum"), F.col(f).alias("__f"))
    held = narrow.join(good, "__id").where(~base_failed("__f"))
    counts = [F.count_if(_rejected("__f", rules, lambda r, i=i: F.lit(r.cutoffs[i]))).alias(f"level_{i}") for i in range(levels)]
    table = stored(held.groupBy("stratum").agg(F.count("*").alias("n_good"), *counts), "quality-holdout")
    strata = max(1, table.count())

    def choose(batches):
        for batch in batches:
            rows = batch.to_pylist()
            passed = []
            for r in rows:
                i = 0
                while i < levels and certified(r["n_good"], r[f"level_{i}"], alpha, delta / strata):
                    i += 1
                passed.append(i)
            out = {"stratum": [r["stratum"] for r in rows], "n_good": [r["n_good"] for r in rows], "level": passed}
            out |= {rule.name: [rule.cutoffs[i - 1] if i else None for i in passed] for rule in rules}
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.string() if k == "stratum" else pa.int64()) for k, v in out.items()})

    shape = T.StructType([T.StructField("stratum", T.StringType()), *(T.StructField(n, T.LongType()) for n in ("n_good", "level", *(r.name for r in rules)))])
    return stored(table.withColumn("stratum", F.col("stratum").cast("string")).mapInArrow(choose, shape), "quality-cutoffs")


#: Strata up to which the cutoffs go to every task; more are joined by a shuffle.
BROADCAST_STRATA = 1000


def judged(measured: DataFrame, cutoffs: DataFrame, *, f: str, stratum_col: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``measured`` with boolean ``__base_failed`` and ``__kept``; no row is added or lost."""
    table = cutoffs.select(F.col("stratum").alias("__stratum"), *(F.col(r.name).alias(f"__cut_{r.name}") for r in rules))
    if len(table.take(BROADCAST_STRATA + 1)) <= BROADCAST_STRATA:
        table = F.broadcast(table)
    both = measured.join(table, F.col(stratum_col).cast("string").eqNullSafe(F.col("__stratum")), "left")
    hit = _rejected(f, rules, lambda r: F.col(f"__cut_{r.name}"))
    return both.withColumn("__base_failed", base_failed(f)).withColumn("__kept", ~F.col("__base_failed") & ~hit).drop("__stratum", *(f"__cut_{r.name}" for r in rules))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    measured = stored(docs.select("doc_id", "lang", features(F.col("text")).alias("__f")), "quality-features")
    cutoffs = thresholds(measured, read(spark, sf_dir, "labels"), f="__f", id_col="doc_id", stratum_col="lang")
    done = judged(measured, cutoffs, f="__f", stratum_col="lang")
    return done.select("doc_id", *(f"__f.{n}" for n in FEATURES), F.col("__base_failed").alias("base_failed"), F.col("__kept").alias("kept"))


def _oracle() -> str:
    grid = ", ".join(str((i, *(r.cutoffs[i] for r in RULES))) for i in range(len(RULES[0].cutoffs)))
    names = ", ".join(f"c_{r.name}" for r in RULES)
    rejected = " OR ".join(f"1000 * {r.count} > c_{r.name} * {r.base}" for r in RULES)
    return rf"""
WITH words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)
), windows AS (
  SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, a, b, c) AS times
  FROM (SELECT doc_id, pos, word AS a, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c
        FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY pos))
  WHERE c IS NOT NULL
), covered AS (
  SELECT doc_id, count(DISTINCT pos + k) AS n_repeat_words
  FROM windows, (SELECT unnest([0, 1, 2]) AS k) WHERE times > 1 GROUP BY doc_id
), sized AS (
  SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars FROM words GROUP BY doc_id
), lines AS (
  SELECT doc_id, sum(n) AS n_lines, sum(n - 1) AS n_dup_lines FROM (
    SELECT doc_id, line, count(*) AS n
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line)
  GROUP BY doc_id
), f AS (
  SELECT d.doc_id, d.lang, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
    CASE WHEN n_words > 0 THEN length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) ELSE 0 END::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    coalesce(n_lines, 0)::BIGINT AS n_lines,
    CASE WHEN n_words > 0 THEN length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) ELSE 0 END::BIGINT AS n_upper
  FROM documents d LEFT JOIN sized USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f
), grid(level, {names}) AS (VALUES {grid}),
held AS (
  SELECT b.* FROM b JOIN (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1) USING (doc_id) WHERE NOT base_failed
), counted AS (
  SELECT lang, level, count(*) AS n, count(*) FILTER ({rejected}) AS k FROM held, grid GROUP BY ALL
), tests AS (SELECT count(DISTINCT coalesce(lang, '?')) AS m FROM held),
tested AS (
  SELECT lang, level, (
    SELECT sum(exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln({ALPHA}) + (n - i) * ln(1 - {ALPHA})))
    FROM (SELECT unnest(range(0, k + 1)) AS i)) <= {DELTA} / m AS passed
  FROM counted, tests
), chosen AS (
  SELECT lang, max(level) AS level FROM tested t
  WHERE NOT EXISTS (SELECT 1 FROM tested u WHERE u.lang IS NOT DISTINCT FROM t.lang AND u.level <= t.level AND NOT u.passed)
  GROUP BY lang
), hit AS (
  SELECT DISTINCT doc_id FROM b JOIN chosen ON b.lang IS NOT DISTINCT FROM chosen.lang JOIN grid USING (level) WHERE {rejected}
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, base_failed,
  NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM hit) AS kept
FROM b"""


ORACLE = _oracle()
