"""Substring deduplication: count-min sketches first, exact grouping of what is left.

A window is WINDOW consecutive words of one document. A word goes if a window over it
also starts in a document with a smaller id; windows are judged on the input.

First pass. Of a window's runs of ANCHOR words the one with the least hash is its
anchor, so equal windows have equal anchors, and neighbouring windows mostly share
theirs: there are thirteen times fewer anchors than windows, and an anchor is held by
at least as many documents as any of its windows. Every chunk of documents sketches
its anchors; the sketches are dealt by hash to parts, where they are merged to one
count-min sketch of DEPTH x 2^WIDTH_BITS counters. It never counts too little, so a
window whose anchor it counts once is found in one document alone, and is done with.

Second pass. The other windows are grouped exactly, by 96 bits of two independent
hashes: each chunk sends a window's fingerprint once, with the least id that holds it
there, and gets back whether a smaller id holds it elsewhere. No window is lost: the
sketch errs to one side only, and no count or group is cut.

Texts are written once, packed by chunks into a table bucketed by chunk, which both
passes and the last step read without moving texts again; only sketches, fingerprints
and their answers are shuffled. The number of parts and buckets grows with the texts,
and a window or anchor that every document holds costs one entry a chunk.

Nulls and empty texts have no words, no windows and an empty result. Rows without an
id remove nothing and lose nothing, as no id is smaller; rows of one id don't remove
each other's words, and repeated rows come back as often as they came. Texts of any
length are cut into words piece by piece; a text longer than a chunk makes a chunk of
its own. An empty table gives an empty result. Other columns are not read, so their
names can't clash.
"""

from __future__ import annotations

import itertools
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwork.llm.common import WordHashes, mix64, packed, planes, read, scratch_path, stored, unpacked, unplanes

WINDOW, ANCHOR = 50, 25
#: Bytes and rows of a chunk; bytes of a text that are cut into words at once.
CHUNK_BYTES, CHUNK_DOCS, PIECE_BYTES = 4 << 20, 20_000, 4 << 20
#: Bytes of text to one sketch, to one group of the second pass and to one bucket.
SKETCH_BYTES, EXACT_BYTES, BUCKET_BYTES = 128 << 20, 32 << 20, 64 << 20
LEAST_PARTS = 12
DEPTH, WIDTH_BITS = 3, 22

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_U = np.uint64
_hashes = WordHashes()
#: Odd factors of the two window hashes; their powers differ by few factors of two.
_R1, _R2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD95


def pieces(text: bytes) -> Iterator[bytes]:
    """The text in pieces cut at white space."""
    start = 0
    while len(text) - start > PIECE_BYTES and (space := _SPACE.search(text, start + PIECE_BYTES)):
        yield text[start : space.start()]
        start = space.start()
    yield text[start:]


def _powers(r: int, n: int) -> np.ndarray:
    out = np.full(n, r, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _runs(w: np.ndarray, length: int, r: int) -> np.ndarray:
    """The hash of every run of so many words."""
    n = len(w) - length + 1
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(w * _powers(r, len(w)), dtype=np.uint64)])
    return mix64((sums[length:] - sums[:n]) * _powers(pow(r, -1, 1 << 64), n))


def _least(x: np.ndarray, k: int) -> np.ndarray:
    """The least of every k neighbours."""
    n, m, span = len(x) - k + 1, x, 1
    while 2 * span <= k:
        m, span = np.minimum(m[:-span], m[span:]), 2 * span
    return np.minimum(m[:n], m[k - span : k - span + n])


class Windows:
    """The windows of a chunk's texts: ``start`` among all its words and ``owner`` of each.

    Neighbours with one owner and one anchor make a run; ``anchor`` and ``run_owner``
    are of runs, and ``run`` has each window's.
    """

    def __init__(self, texts: list[bytes], has_id: np.ndarray, window: int) -> None:
        self.window, anchor = window, min(ANCHOR, window)
        parts = [(i, _hashes.of(piece.split())) for i, text in enumerate(texts) for piece in pieces(text)]
        self.n = np.zeros(len(texts), dtype=np.int64)
        for i, p in parts:
            self.n[i] += len(p)
        self.w = np.concatenate([p for _, p in parts]) if parts else np.zeros(0, dtype=np.uint64)
        ends = np.cumsum(self.n)
        owner = np.repeat(np.arange(len(texts)), self.n)[: max(0, len(self.w) - window + 1)]
        whole = (np.arange(len(owner)) + window <= ends[owner]) & has_id[owner]
        self.start, self.owner = np.flatnonzero(whole), owner[whole]
        least = _least(_runs(self.w, anchor, _R1), window - anchor + 1)[whole] if len(owner) else np.zeros(0, dtype=np.uint64)
        new = np.ones(len(least), dtype=bool)
        new[1:] = (least[1:] != least[:-1]) | (self.owner[1:] != self.owner[:-1])
        self.run = np.cumsum(new) - 1
        self.anchor, self.run_owner = mix64(least[new]), self.owner[new]

    def fingerprints(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """64 and 32 bits of the words of the chosen windows."""
        at = self.start[chosen]
        return _runs(self.w, self.window, _R1)[at], (_runs(mix64(self.w ^ _U(_R2)), self.window, _R2)[at] >> _U(32)).astype(np.uint32)


def part_of(x: np.ndarray, parts: int) -> np.ndarray:
    """A part for a 64-bit hash; it rises with the hash."""
    return ((x >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64)


def _edges(part: np.ndarray) -> list[tuple[int, int]]:
    if not len(part):
        return []
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    return list(itertools.pairwise(cuts))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) rows -> chunks of them, the texts compressed."""
    from pyspark import TaskContext

    chunk = TaskContext.get().partitionId() << 32
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
        start, held = 0, 0
        for i, size in enumerate(sizes):
            held += size
            if held < CHUNK_BYTES and i + 1 - start < CHUNK_DOCS and i < len(sizes) - 1:
                continue
            some = batch.slice(start, i + 1 - start)
            body = b"".join(x.as_py() or b"" for x in some.column(1))
            lengths = np.array(sizes[start : i + 1], dtype="<i8").tobytes()
            data = pa.compress(lengths + body, codec="zstd", asbytes=True)
            ids = pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), ids, pa.array([len(lengths) + len(body)], pa.int64()), pa.array([data], pa.binary())], ["chunk", "ids", "size", "data"])
            chunk, start, held = chunk + 1, i + 1, 0


def _texts(row: dict) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """A chunk's texts, ids (0 for null) and which ids there are."""
    ids = row["ids"]
    data = pa.decompress(row["data"], decompressed_size=row["size"], codec="zstd", asbytes=True)
    ends = np.cumsum(np.frombuffer(data, dtype="<i8", count=len(ids))) + 8 * len(ids)
    texts = [data[a:b] for a, b in itertools.pairwise([8 * len(ids), *ends.tolist()])]
    return texts, np.array([x or 0 for x in ids], dtype=np.int64), np.array([x is not None for x in ids], dtype=bool)


def bucketed(df: DataFrame, key: str, buckets: int, label: str) -> DataFrame:
    """``df`` written once to the shared folder, bucketed by ``key``, so that later groups by it need no shuffle."""
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.format("parquet").option("path", scratch_path(spark, label)).bucketBy(buckets, key).saveAsTable(name)
    return spark.table(name)


def _sketch_of(windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """A chunk's sketch in sparse form: its anchors in order, and whether more than one of its documents holds each."""
    order = np.lexsort((windows.run_owner, windows.anchor))
    anchor, owner = windows.anchor[order], windows.run_owner[order]
    keys, first = np.unique(anchor, return_index=True)
    many = np.zeros(len(keys), dtype=bool)
    if len(keys):
        many = np.maximum.reduceat(owner, first) > np.minimum.reduceat(owner, first)
    return keys, many


def _sketching(parts: int, window: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                texts, _, has_id = _texts(row)
                keys, many = _sketch_of(Windows(texts, has_id, window))
                edges = _edges(part := part_of(keys, parts))
                columns = [pa.array([int(part[a]) for a, _ in edges], pa.int32()), pa.array([row["chunk"]] * len(edges), pa.int64()), pa.array([packed(keys[a:b]) for a, b in edges], pa.binary()), pa.array([np.packbits(many[a:b]).tobytes() for a, b in edges], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["part", "chunk", "keys", "many"])

    return sketch


def counters_of(keys: np.ndarray) -> list[np.ndarray]:
    """The counter of a key in each row of the sketch."""
    mask, at = _U((1 << WIDTH_BITS) - 1), mix64(keys)
    return [(at >> _U(21 * i) & mask).astype(np.int64) for i in range(DEPTH)]


def merged(sketches: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Sparse sketches of chunks, added up: DEPTH rows of counters."""
    table = np.zeros((DEPTH, 1 << WIDTH_BITS), dtype=np.uint32)
    for keys, many in sketches:
        for row, at in zip(table, counters_of(keys), strict=True):
            np.add.at(row, at, 1 + many.astype(np.uint32))
    return table


def estimates(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """At least as many documents as hold each key."""
    return np.minimum.reduce([row[at] for row, at in zip(table, counters_of(keys), strict=True)])


def _estimated(key: tuple, rows: pa.Table) -> pa.Table:
    """A part's sketches, merged; which keys of each chunk they count more than once."""
    sketches = []
    for keys, many in zip(rows.column("keys"), rows.column("many"), strict=True):
        k = unpacked(keys.as_py())
        sketches.append((k, np.unpackbits(np.frombuffer(many.as_py(), dtype=np.uint8), count=len(k))))
    table = merged(sketches)
    bits = [np.packbits(estimates(table, k) > 1).tobytes() for k, _ in sketches]
    return pa.table({"chunk": rows.column("chunk"), "part": rows.column("part"), "n": pa.array([len(k) for k, _ in sketches], pa.int64()), "bits": pa.array(bits, pa.binary())})


def _answers(rows: pa.Table) -> np.ndarray:
    """The answers to a chunk, part by part."""
    rows = rows.sort_by("part")
    bits = [np.unpackbits(np.frombuffer(b.as_py(), dtype=np.uint8), count=n.as_py()) for n, b in zip(rows.column("n"), rows.column("bits"), strict=True)]
    return np.concatenate([np.zeros(0, dtype=np.uint8), *bits]).astype(bool)


class Candidates:
    """A chunk's windows that the sketch counts more than once: distinct fingerprints in order, with the least id of each."""

    def __init__(self, windows: Windows, ids: np.ndarray, repeated: np.ndarray) -> None:
        at = np.searchsorted(np.unique(windows.anchor), windows.anchor)
        self.chosen = np.flatnonzero(repeated[at][windows.run])
        high, low = windows.fingerprints(self.chosen) if len(self.chosen) else (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint32))
        self.ids = ids[windows.owner[self.chosen]]
        order = np.lexsort((self.ids, low, high))
        high, low = high[order], low[order]
        new = np.concatenate([np.ones(min(1, len(high)), dtype=bool), (high[1:] != high[:-1]) | (low[1:] != low[:-1])])
        self.high, self.low, self.least = high[new], low[new], self.ids[order][new]
        self.group = np.empty(len(order), dtype=np.int64)
        self.group[order] = np.cumsum(new) - 1


def _asking(parts: int, window: int):
    def ask(key: tuple, texts: pa.Table, answers: pa.Table) -> pa.Table:
        bodies, ids, has_id = _texts(texts.to_pylist()[0])
        c = Candidates(Windows(bodies, has_id, window), ids, _answers(answers))
        edges = _edges(part := part_of(c.high, parts))
        return pa.table({
            "part": pa.array([int(part[a]) for a, _ in edges], pa.int32()),
            "chunk": pa.array([key[0].as_py()] * len(edges), pa.int64()),
            "high": pa.array([packed(c.high[a:b]) for a, b in edges], pa.binary()),
            "low": pa.array([c.low[a:b].tobytes() for a, b in edges], pa.binary()),
            "least": pa.array([planes(c.least[a:b].view(np.uint64)) for a, b in edges], pa.binary()),
        })

    return ask


def _grouped(key: tuple, rows: pa.Table) -> pa.Table:
    """A part's fingerprints of all chunks, grouped; which of each chunk's a smaller id holds elsewhere."""
    highs = [unpacked(x.as_py()) for x in rows.column("high")]
    high = np.concatenate(highs)
    low = np.concatenate([np.frombuffer(x.as_py(), dtype=np.uint32) for x in rows.column("low")])
    least = np.concatenate([unplanes(x.as_py()).view(np.int64) for x in rows.column("least")])
    order = np.lexsort((least, low, high))
    h, lo = high[order], low[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (lo[1:] != lo[:-1])]))
    smallest = np.repeat(least[order][first], np.diff(first, append=len(h)))
    smaller = np.empty(len(h), dtype=bool)
    smaller[order] = smallest < least[order]
    ends = np.cumsum([len(x) for x in highs])
    bits = [np.packbits(x).tobytes() for x in np.split(smaller, ends[:-1])]
    return pa.table({"chunk": rows.column("chunk"), "part": rows.column("part"), "n": pa.array([len(x) for x in highs], pa.int64()), "bits": pa.array(bits, pa.binary())})


def _spans(covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _removing(window: int):
    def remove(key: tuple, texts: pa.Table, answers: pa.Table) -> pa.Table:
        row = texts.to_pylist()[0]
        bodies, ids, has_id = _texts(row)
        w = Windows(bodies, has_id, window)
        exact = pc.field("exact")
        c = Candidates(w, ids, _answers(answers.filter(~exact)))
        smaller = _answers(answers.filter(exact))
        gone = (c.ids > c.least[c.group]) | smaller[c.group] if len(c.chosen) else np.zeros(0, dtype=bool)
        steps = np.zeros(len(w.w) + 1, dtype=np.int64)
        starts = w.start[c.chosen[gone]]
        np.add.at(steps, starts, 1)
        np.add.at(steps, starts + window, -1)
        covered = np.cumsum(steps[:-1]) > 0
        kept, removed, at = [], [], 0
        for body, n in zip(bodies, w.n.tolist(), strict=True):
            mine = covered[at : at + n]
            words = itertools.chain.from_iterable(piece.split() for piece in pieces(body))
            kept.append(b" ".join(itertools.compress(words, (~mine).tolist()) if mine.any() else words))
            removed.append([{"first": a, "end": b} for a, b in zip(*(x.tolist() for x in _spans(mine)), strict=True)])
            at += n
        spans = pa.array(removed, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))
        return pa.table({"id": pa.array(row["ids"], pa.int64()), "n_words": pa.array(w.n), "removed": spans, "kept": pa.array(kept, pa.binary()).cast(pa.string())})

    return remove


def without_repeats(docs: DataFrame, *, id_col: str, text_col: str, window: int = WINDOW) -> DataFrame:
    """(id, n_words, removed, kept) for every row of ``docs``; the id must be an integer.

    ``removed`` has the spans of words that go, from ``first`` up to before ``end``,
    counted from 0; ``kept`` has the other words, joined by one space.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t"))
    chunks = bucketed(rows.mapInArrow(_pack, "chunk long, ids array<long>, size long, data binary"), "chunk", max(LEAST_PARTS, -(-size // BUCKET_BYTES)), "dedup_chunks")
    asked, answered = "part int, chunk long, ", "chunk long, part int, n long, bits binary"
    sketches = chunks.mapInArrow(_sketching(max(LEAST_PARTS, -(-size // SKETCH_BYTES)), window), asked + "keys binary, many binary")
    repeated = stored(sketches.groupBy("part").applyInArrow(_estimated, answered), "dedup-repeated")
    windows = chunks.groupBy("chunk").cogroup(repeated.groupBy("chunk")).applyInArrow(_asking(max(LEAST_PARTS, -(-size // EXACT_BYTES)), window), asked + "high binary, low binary, least binary")
    exact = windows.groupBy("part").applyInArrow(_grouped, answered)
    answers = repeated.withColumn("exact", F.lit(False)).unionByName(exact.withColumn("exact", F.lit(True)))
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_removing(window), "id long, n_words long, removed array<struct<first:long,end:long>>, kept string")


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = without_repeats(read(spark, sf_dir, "documents"), id_col="doc_id", text_col="text")
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    return done.select(F.col("id").alias("doc_id"), "n_words", gone.alias("n_removed"), F.sha2(F.col("kept"), 256).alias("kept_sha256"))


ORACLE = rf"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS body
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM texts)
), firsts AS (SELECT body, min(doc_id) AS least FROM windows GROUP BY body),
hit AS (
  SELECT DISTINCT doc_id, i + k AS p
  FROM windows JOIN firsts USING (body), (SELECT unnest(range({WINDOW})) AS k) WHERE least < doc_id
), left_over AS (
  SELECT w.doc_id, count(hit.p) AS n_removed, string_agg(word, ' ' ORDER BY w.p) FILTER (hit.p IS NULL) AS kept
  FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM texts) w
  LEFT JOIN hit ON w.doc_id = hit.doc_id AND w.p = hit.p GROUP BY w.doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM texts LEFT JOIN left_over USING (doc_id)"""
