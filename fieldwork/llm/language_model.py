"""Language-model scoring with a log-frequency Bloom filter.

Unigrams and bigrams of the training documents are counted over the whole table.
A count c is quantised to level 1 + floor(log_BASE c), and an n-gram of level q is
entered into a Bloom filter q times, as (n-gram, 1) to (n-gram, q). Looking a count
up probes level after level until one is missing; the last level found stands for
the count. Errors only ever raise a count, and one level further is reached with the
filter's false-positive rate again, so large errors are rare.

A text's probability is that of its words and an end token, each given the word
before it: ``LAMBDA * c(u v) / c(u) + (1 - LAMBDA) * (c(v) + 1) / (N + V + 1)`` with
counts from the filter, the first part at most LAMBDA, and 0 if c(u) is not found.
``base_score`` uses the exact unigram counts.

The filter is cut into parts by the n-gram's hash, and their number grows with the
text, so no worker ever holds more than one part. Documents are cut into chunks. A
chunk deals its distinct n-grams to the parts, packed, with how often its training
documents have them. A part sums these, sizes its bits as BITS_PER_LEVEL times the
levels really counted (so the false-positive rate is the same at every size), enters
them, and answers each chunk with the levels that probing finds, a byte an n-gram, and
with the exact counts of its words. A second scan cuts the same chunks and sends their
texts, compressed, to the answers. A chunk is named by its place and its content, so
scans that differed would be noticed; rows that come out of a shuffle are stored first.

Words are hashed to 64 bits, pairs to 50. Defined results: a null or empty text is one end token;
a null id has remainder 0 and trains; repeated rows are counted and scored one by
one; if nothing trains, N = V = 0 and every token has probability 1 under the base.
Other columns are neither read nor changed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwork.llm.common import ASCII_LOWER, WordHashes, mix64, packed, planes, read, stored, unpacked, unplanes

FOLDS, HELD_OUT = 7, 2
BASE = 1.5
LAMBDA = 0.6
#: Bits of the filter for each level entered: 0.5% false positives at PROBES probes.
BITS_PER_LEVEL = 12
#: Training text behind a part of the filter; and the least number of parts.
PART_BYTES, LEAST_PARTS = 16 << 20, 256
#: Bytes of text in a chunk.
CHUNK_BYTES = 4 << 20
#: Bits that tell words and pairs apart.
WORD_BITS, PAIR_BITS = 64, 50
PROBES = 5

#: No word holds a newline, so these are no words.
_START, _END = b"\n<s>", b"\n</s>"
_LEVELS = 64
_U = np.uint64

_hashes = WordHashes()


def token_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the words and the end token of each text, A-Z lower-cased, and their numbers."""
    words = [[*t.translate(ASCII_LOWER).split(), _END] for t in texts]
    return _hashes.of([w for x in words for w in x]), np.array([len(x) for x in words], dtype=np.int64)


def bigram_keys(tokens: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Keys of each token with the one before it, the start before the first of a text."""
    before = np.concatenate([tokens[:1], tokens[:-1]])
    before[firsts] = _hashes[_START]
    return mix64(before * _U(0x9E3779B97F4A7C15) + tokens) >> _U(64 - PAIR_BITS)


def level(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log_BASE c), exact at the powers."""
    edges = np.ceil(BASE ** np.arange(1, _LEVELS))
    return 1 + np.searchsorted(edges, counts, side="right")


#: The count that stands for a level: the middle of its range; 0 for none.
LEVEL_COUNT = np.array([0.0, *((np.ceil(BASE**i) + max(np.ceil(BASE**i), np.ceil(BASE ** (i + 1)) - 1)) / 2 for i in range(_LEVELS))])


def _probes(key: np.ndarray, lvl: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """The first position of an entry and the step to the next ones, before the width is known."""
    a = mix64(key ^ (np.asarray(lvl).astype(np.uint64) * _U(0xD6E8FEB86659FD93)))
    return a, mix64(a) | _U(1)


def part_of(key: np.ndarray, bits: int, parts: int) -> np.ndarray:
    """The part that holds an n-gram; rises with the key."""
    return ((key >> _U(bits - 32)) * _U(parts) >> _U(32)).astype(np.int64)


class LogFrequencyFilter:
    """One part's bits."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.width = bits, len(bits) * 8

    @classmethod
    def of(cls, keys: np.ndarray, counts: np.ndarray) -> LogFrequencyFilter:
        """A filter sized for these counts, with all of them entered."""
        levels = level(counts)
        width = -(-int(levels.sum()) * BITS_PER_LEVEL // 8) * 8
        bits = np.zeros(width, dtype=bool)
        for q in range(1, int(levels.max(initial=0)) + 1):
            at, step = _probes(keys[levels >= q], q)
            for _ in range(PROBES):
                bits[(at % _U(width)).astype(np.int64)] = True
                at = at + step
        return cls(np.packbits(bits, bitorder="little"))

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The last level found for each key, by probing until one is missing."""
        out = np.zeros(len(keys), dtype=np.uint8)
        alive = np.arange(len(keys))
        for q in range(1, _LEVELS + 1):
            if not self.width or not len(alive):
                break
            at, step = _probes(keys[alive], q)
            for _ in range(PROBES):
                bit = at % _U(self.width)
                # a bit that is missing settles it: later bits are looked up for the others only
                found = (self.bits[(bit >> _U(3)).astype(np.int64)] >> (bit & _U(7)).astype(np.uint8)) & 1 == 1
                alive, step = alive[found], step[found]
                at = at[found] + step
            out[alive] = q
        return out


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, list[bytes]]]:
    """(chunk, its rows, their texts) of rows whose second column is a text.

    The same for every scan of the same rows and every attempt of a task.
    """
    from pyspark import TaskContext

    place = TaskContext.get().partitionId() << 32
    for batch in batches:
        start, texts, held = 0, [], 0
        for i, x in enumerate(batch.column(1)):
            texts.append(x.as_py() or b"")
            held += len(texts[-1])
            if held >= CHUNK_BYTES or i == len(batch) - 1:
                name = xxhash.xxh64(place.to_bytes(8, "little"))
                for t in texts:
                    name.update(len(t).to_bytes(8, "little"))
                    name.update(t)
                yield name.intdigest() >> 1, batch.slice(start, i + 1 - start), texts
                place += 1
                start, texts, held = i + 1, [], 0


def _dealt(parts: int):
    """Documents -> a row for each (part, chunk, length of n-gram)."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, rows, texts in _chunks(batches):
            trains = np.array(rows.column(2).to_pylist(), dtype=bool)
            tokens, sizes = token_keys(texts)
            counted = np.repeat(trains, sizes)
            part, kind, keys, counts = [], [], [], []
            for k, bits, grams in ((1, WORD_BITS, tokens), (2, PAIR_BITS, bigram_keys(tokens, np.cumsum(sizes) - sizes))):
                distinct, place = np.unique(grams, return_inverse=True)
                n = np.bincount(place[counted], minlength=len(distinct)).astype(np.uint64)
                p = part_of(distinct, bits, parts)
                edges = [0, *(np.flatnonzero(np.diff(p)) + 1).tolist(), len(p)]
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    part.append(int(p[a]))
                    kind.append(k)
                    keys.append(packed(distinct[a:b]))
                    counts.append(planes(n[a:b]))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([chunk] * len(part), pa.int64()), pa.array(kind, pa.int8()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], ["part", "chunk", "kind", "keys", "counts"])

    return deal


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents -> a row for each chunk: ids, lengths, and the texts compressed."""
    for chunk, rows, texts in _chunks(batches):
        body = b"".join(texts)
        lengths = np.array([len(body), *map(len, texts)], dtype=np.int64)
        ids = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows.column(0))
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), ids, pa.array([lengths.tobytes()], pa.binary()), pa.array([pa.compress(body, "zstd", asbytes=True)], pa.binary())], ["chunk", "ids", "lengths", "texts"])


def _answered(key: tuple, rows: pa.Table) -> pa.Table:
    """A part's n-grams -> for each chunk the levels found, and its words' exact counts."""
    kind = rows.column("kind").to_numpy()
    keys = [unpacked(x.as_py()) for x in rows.column("keys")]
    counts = [unplanes(x.as_py()).astype(np.int64) for x in rows.column("counts")]
    asked: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for k in (1, 2):
        mine = np.flatnonzero(kind == k).tolist()
        flat, n = (np.concatenate([np.zeros(0, dtype=t), *(x[i] for i in mine)]) for x, t in ((keys, np.uint64), (counts, np.int64)))
        distinct, place = np.unique(flat, return_inverse=True)
        sums = np.zeros(len(distinct), dtype=np.int64)
        np.add.at(sums, place, n)
        asked[k] = distinct, place, sums
    known = [(distinct[sums > 0], sums[sums > 0]) for distinct, _, sums in asked.values()]
    filter_ = LogFrequencyFilter.of(*map(np.concatenate, zip(*known, strict=True)))
    found: list[bytes | None] = [None] * len(keys)
    exact: list[bytes | None] = [None] * len(keys)
    for k, (distinct, place, sums) in asked.items():
        levels = filter_.levels(distinct)[place]
        times = sums[place].astype(np.uint64)
        at = 0
        for i in np.flatnonzero(kind == k).tolist():
            end = at + len(keys[i])
            found[i] = levels[at:end].tobytes()
            if k == 1:
                exact[i] = planes(times[at:end])
            at = end
    words = known[0][1]
    none = pa.nulls(len(keys), pa.int64())
    out = pa.table({"chunk": rows.column("chunk"), "part": rows.column("part"), "kind": rows.column("kind"), "found": pa.array(found, pa.binary()), "exact": pa.array(exact, pa.binary()), "tokens": none, "distinct": none})
    total = pa.table({"chunk": pa.nulls(1, pa.int64()), "part": pa.nulls(1, pa.int32()), "kind": pa.nulls(1, pa.int8()), "found": pa.nulls(1, pa.binary()), "exact": pa.nulls(1, pa.binary()), "tokens": pa.array([int(words.sum())]), "distinct": pa.array([len(words)])})
    return pa.concat_tables([out, total])


def _scored(tokens: int, distinct: int):
    """A chunk's texts and its answers -> its documents' scores, for N and V."""
    total = tokens + distinct + 1

    def score(key: tuple, chunk: pa.Table, rows: pa.Table) -> pa.Table:
        if len(chunk) != 1 or not len(rows):
            raise ValueError("the documents have changed between two scans of them")
        length, *lengths = np.frombuffer(chunk.column("lengths")[0].as_py(), dtype=np.int64).tolist()
        body = pa.decompress(chunk.column("texts")[0].as_py(), length, "zstd", asbytes=True)
        ends = np.cumsum(lengths).tolist()
        grams, sizes = token_keys([body[end - n : end] for n, end in zip(lengths, ends, strict=True)])
        firsts = np.cumsum(sizes) - sizes
        rows = rows.combine_chunks().sort_by("part")
        kind = rows.column("kind").to_numpy()
        mine = {k: np.flatnonzero(kind == k).tolist() for k in (1, 2)}
        counts = {k: LEVEL_COUNT[np.frombuffer(b"".join(rows.column("found")[i].as_py() for i in mine[k]), dtype=np.uint8)] for k in mine}
        exact = np.concatenate([unplanes(rows.column("exact")[i].as_py()) for i in mine[1]]).astype(np.int64)
        keys, place = np.unique(grams, return_inverse=True)
        pair = counts[2][np.unique(bigram_keys(grams, firsts), return_inverse=True)[1]]
        before = np.concatenate([place[:1], place[:-1]])
        # the start stands once before every training text, as often as the end token
        before[firsts] = np.searchsorted(keys, _U(_hashes[_END]))
        one, context = counts[1][place], counts[1][before]
        given = np.minimum(1.0, np.divide(pair, context, out=np.zeros_like(pair), where=context > 0))
        p = LAMBDA * given + (1 - LAMBDA) * np.minimum(1.0, (one + 1) / total)
        c = exact[place]
        ids = chunk.column("ids").combine_chunks().flatten()
        sums = {"n_known": (c > 0).astype(np.int64), "base_score": np.log10((c + 1) / total), "score": np.log10(p)}
        return pa.table({"id": ids, "n_tokens": sizes, **{name: np.add.reduceat(x, firsts) for name, x in sums.items()}})

    return score


def scored(docs: DataFrame, *, id_col: str, text_col: str, trains: Column) -> tuple[DataFrame, int, int]:
    """(id, n_tokens, n_known, base_score, score) for every row, and N and V of the rows that train."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"), F.coalesce(trains, F.lit(False)).alias("trains"))
    if "Exchange" in rows._jdf.queryExecution().executedPlan().toString():
        rows = stored(rows, "lm-documents")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    parts = max(LEAST_PARTS, -(-size // PART_BYTES))
    kind = dict(docs.dtypes)[id_col]
    dealt = rows.mapInArrow(_dealt(parts), "part int, chunk long, kind tinyint, keys binary, counts binary")
    shape = "chunk long, part int, kind tinyint, found binary, exact binary, tokens long, distinct long"
    answers = stored(dealt.groupBy("part").applyInArrow(_answered, shape), "lm-answers")
    tokens, distinct = answers.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    own = answers.where("chunk IS NOT NULL").select(F.col("chunk").alias("to"), "part", "kind", "found", "exact")
    chunks = rows.mapInArrow(_texts, f"chunk long, ids array<{kind}>, lengths binary, texts binary")
    out = chunks.groupBy("chunk").cogroup(own.groupBy("to")).applyInArrow(_scored(tokens, distinct), f"id {kind}, n_tokens long, n_known long, base_score double, score double")
    return out, tokens, distinct


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    rows, tokens, _ = scored(docs, id_col="doc_id", text_col="text", trains=~held_out(F.col("doc_id")))
    return rows.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
