"""Alignment of two tokenizers' ids over the same bytes, and how often ids go together.

A is a byte-level BPE of the tokenizers library, B a sentencepiece BPE with byte
fallback; both encode ``space + text``. Offsets where a token of A and one of B end
cut the tokens into groups; all A-B pairs of a group are linked. An id pair's count is
the number of documents that hold it linked.

The tokens of B are the intervals of a static index: they lie end to end, so their
sorted ends are the index, and two bisections stab it with an A token and give the B
tokens that it overlaps (for many tokens at once). A gap between A tokens that no B
token spans is a boundary.

A text is worked on in units, cut before white space that follows something else where
neither tokenizer can join across; a unit's ids, groups and links are worked out once
and remembered by each worker, up to MEMO_UNITS. A document is then sums and gathers
over its units, so tokens, groups and links are the same as of the whole text.

Counts over the corpus: texts are tokenized once, into one stored row a chunk of
documents, which has its distinct id pairs and each document's pairs with their number
of links. A chunk sends its pairs, with the number of its documents that hold each, to
parts by A id, where they are added up and the most frequent of each A id is found; a
pair that every document holds costs one entry a chunk. The answers meet the chunk
again, and give each document its sums. Nothing is broadcast.

Texts that are null or empty, or whose bytes either tokenizer does not give back, have
no tokens: zeros and an empty digest. Special tokens' strings are plain text. Rows
without id and repeated rows are documents like others. A text of any length is cut in
SEGMENT_CHARS; only a run of that length without a cut is encoded as a whole. An empty
table gives an empty result. Other columns are not read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwork.llm.common import mix64, packed, planes, read, stored, unpacked, unplanes

#: Characters and documents of a chunk; characters of a text that are worked on at once.
CHUNK_CHARS, CHUNK_DOCS, SEGMENT_CHARS = 4 << 20, 20_000, 2 << 20
MEMO_UNITS = 300_000
#: Links of a group up to which they are made one by one, in numpy.
GROUP_LINKS = 4096
#: Bytes of text to one part of the pair counts.
PART_BYTES, LEAST_PARTS = 256 << 20, 12
_U = np.uint64


def _byte_of_char() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable bytes are themselves, others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Index:
    """Static intervals that lie end to end; ``overlapped`` gives the first and last that each [start, end) stabs."""

    def __init__(self, lengths: np.ndarray) -> None:
        self.ends = np.cumsum(lengths)

    def overlapped(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.searchsorted(self.ends, start, side="right"), np.searchsorted(self.ends, end)


def cut(a_lengths: np.ndarray, b_lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of A and of B each group has, in order; both sides have the same bytes."""
    index, end = Index(b_lengths), np.cumsum(a_lengths)
    _, last = index.overlapped(end - a_lengths, end)
    at = np.flatnonzero(index.ends[last] == end)
    return np.diff(at, prepend=-1), np.diff(last[at], prepend=-1)


#: (tokens of A, of B, groups, links), the groups' digest, the distinct id pairs and the links of each.
Aligned = tuple[list[int], str, np.ndarray, np.ndarray]
NOTHING: Aligned = ([0] * 4, "", np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))


class Aligner:
    """Both tokenizers, and what is remembered of units."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte = _byte_of_char()
        n_a = self.a.get_vocab_size()
        added = set(self.a.get_added_tokens_decoder())
        self.a_bytes = [b"" if i in added else bytes(byte[c] for c in self.a.id_to_token(i)) for i in range(n_a)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.a_names = [f"{i}{end}".encode() for i in range(n_a) for end in ",|"]
        self.b_names = [f"{i}{end}".encode() for i in range(len(pieces)) for end in ",;\n"]
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_lengths, self.b_lengths = (np.array([len(x) for x in side], dtype=np.int64) for side in (self.a_bytes, self.b_bytes))
        # a piece never starts within white space that it also holds further on, so these can't be joined across
        inner = {c for p in pieces for c in p.lstrip("▁")}
        cuts = "".join(c for c in " \n\t" if c not in inner and (c != " " or "▁" not in inner))
        self.odd = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in cuts]
        self.find = re.compile(f"[{cuts}]*[^{cuts}]+|[{cuts}]+" if cuts else r"(?s:.+)").findall
        self.cut = re.compile(rf"(?<=\S)[{cuts}]") if cuts else None
        self.clear()

    def clear(self) -> None:
        self.memo: dict[str, int] = {}
        self.texts: list[bytes] = []
        #: Tokens of A and of B, groups, links, whether the bytes differ.
        self.counts = np.zeros((5, 0), dtype=np.int64)
        self.pairs, self.links, self.first = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(1, dtype=np.int64)

    def segments(self, text: str) -> Iterator[str]:
        start = 0
        while self.cut and len(text) - start > SEGMENT_CHARS and (at := self.cut.search(text, start + SEGMENT_CHARS)):
            yield text[start : at.start()]
            start = at.start()
        yield text[start:]

    def units(self, text: str) -> list[str]:
        """``text`` in units: none begins after white space of another kind, which A might join with what follows."""
        found = self.find(text)
        if not any(c in text for c in self.odd):
            return found
        out = [found[0]]
        for u in found[1:]:
            if out[-1][-1].isspace():
                out[-1] += u
            else:
                out.append(u)
        return out

    def encoded(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = [e.ids for e in self.a.encode_batch(units, add_special_tokens=False)]
        # B puts a space before its text; a line end, which it joins with nothing, parts it from the unit
        b = [ids[2:] for ids in self.b.encode(["\n" + u for u in units], num_threads=1)]
        return a, b

    def groups(self, unit: str, a: list[int], b: list[int]) -> list[tuple[list[int], list[int]]] | None:
        """A unit's groups; None if either side's bytes are not the unit's."""
        if not self._same([unit], a, b):
            return None
        n_a, n_b = (np.cumsum(n).tolist() for n in cut(self.a_lengths[a], self.b_lengths[b]))
        return [(a[p:q], b[x:y]) for (p, q), (x, y) in zip(itertools.pairwise([0, *n_a]), itertools.pairwise([0, *n_b]), strict=True)]

    def _same(self, units: list[str], a: list[int], b: list[int]) -> bool:
        want = "".join(units).encode()
        return b"".join(map(self.a_bytes.__getitem__, a)) == want and b"".join(map(self.b_bytes.__getitem__, b)) == want

    def learn(self, units: Iterable[str]) -> None:
        new = [u for u in dict.fromkeys(units) if u not in self.memo]
        if not new:
            return
        a, b = self.encoded(new)
        wrong = set()
        if not self._same(new, list(itertools.chain.from_iterable(a)), list(itertools.chain.from_iterable(b))):
            wrong = {i for i, u in enumerate(new) if not self._same([u], a[i], b[i])}
            a, b = ([[] if i in wrong else ids for i, ids in enumerate(side)] for side in (a, b))
        for i, u in enumerate(new):
            self.memo[u] = len(self.texts) + i
        size_a, size_b = (np.array([len(x) for x in side], dtype=np.int64) for side in (a, b))
        a, b = (np.fromiter(itertools.chain.from_iterable(side), dtype=np.int64, count=n.sum()) for side, n in ((a, size_a), (b, size_b)))
        n_a, n_b = cut(self.a_lengths[a], self.b_lengths[b]) if len(a) else (size_a[:0], size_b[:0])
        # which unit a group is in: it ends no later than the unit's last token of A
        owner = np.searchsorted(np.cumsum(size_a), np.cumsum(n_a))
        first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        self.texts += self._written(a, b, n_a, n_b, owner, size_a)
        pairs, links, of = self._linked(a, b, n_a, n_b, first_a, first_b, owner)
        n_groups, n_links = np.bincount(owner, minlength=len(new)), np.zeros(len(new), dtype=np.int64)
        np.add.at(n_links, of, links)
        bad = np.array([i in wrong for i in range(len(new))], dtype=np.int64) if wrong else np.zeros(len(new), dtype=np.int64)
        self.counts = np.concatenate([self.counts, np.stack([size_a, size_b, n_groups, n_links, bad])], axis=1)
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.bincount(of, minlength=len(new)))])
        self.pairs, self.links = np.concatenate([self.pairs, pairs]), np.concatenate([self.links, links])

    def _written(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, owner: np.ndarray, size_a: np.ndarray) -> list[bytes]:
        """Each unit's groups in writing."""
        start = np.cumsum(n_a + n_b) - n_a - n_b
        last_a, last_b = start + n_a - 1, start + n_a + n_b - 1
        at = np.arange(len(a) + len(b))
        is_b = at >= np.repeat(start + n_a, n_a + n_b)
        names = np.empty(len(at), dtype=np.int64)
        names[~is_b], names[is_b] = 2 * a, 2 * len(self.a_bytes) + 3 * b
        names[last_a] += 1
        names[last_b] += 1 + (np.diff(owner, append=len(size_a)) > 0)
        done = iter(b"".join(map((self.a_names + self.b_names).__getitem__, names.tolist())).split(b"\n"))
        return [next(done) if n else b"" for n in size_a.tolist()]

    def _linked(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pair, links, unit) in order of units; a group's pairs are counted by id where there are many tokens."""
        small = n_a * n_b <= GROUP_LINKS
        n = np.where(small, n_a * n_b, 0)
        group = np.repeat(np.arange(len(n)), n)
        t = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        pairs = a[first_a[group] + t // n_b[group]].astype(np.uint64) << _U(32) | b[first_b[group] + t % n_b[group]].astype(np.uint64)
        links, of = np.ones(len(pairs), dtype=np.int64), owner[group]
        for g in np.flatnonzero(~small).tolist():
            (x, p), (y, q) = (np.unique(ids[f : f + k], return_counts=True) for ids, f, k in ((a, first_a[g], n_a[g]), (b, first_b[g], n_b[g])))
            pairs = np.concatenate([pairs, (x.astype(np.uint64)[:, None] << _U(32) | y.astype(np.uint64)[None, :]).ravel()])
            links = np.concatenate([links, np.outer(p, q).ravel()])
            of = np.concatenate([of, np.full(len(x) * len(y), owner[g])])
        if not small.all():
            order = np.argsort(of, kind="stable")
            pairs, links, of = pairs[order], links[order], of[order]
        return pairs, links, of

    def documents(self, texts: list[str | None]) -> list[Aligned]:
        """Each text's; the units of all short ones are learned at once."""
        if len(self.memo) > MEMO_UNITS:
            self.clear()
        units = [self.units(" " + t) if t and len(t) < SEGMENT_CHARS else None for t in texts]
        self.learn(itertools.chain.from_iterable(u for u in units if u))
        return [self.document(t, u) if t else NOTHING for t, u in zip(texts, units, strict=True)]

    def document(self, text: str, known: list[str] | None = None) -> Aligned:
        counts, digest, pairs, links = np.zeros(5, dtype=np.int64), hashlib.sha256(), [], []
        for n, units in enumerate([known] if known else map(self.units, self.segments(" " + text))):
            if not known:
                if len(self.memo) > MEMO_UNITS:
                    self.clear()
                self.learn(units)
            elif n == 0 and not all(map(self.memo.__contains__, units)):  # a long text has come between
                self.learn(units)
            at = np.fromiter(map(self.memo.__getitem__, units), dtype=np.int64, count=len(units))
            counts += self.counts[:, at].sum(axis=1)
            if counts[4]:
                return NOTHING
            digest.update((b";" if n else b"") + b";".join(map(self.texts.__getitem__, at.tolist())))
            size = self.first[at + 1] - self.first[at]
            flat = np.arange(size.sum()) + np.repeat(self.first[at] - (np.cumsum(size) - size), size)
            pairs.append(self.pairs[flat])
            links.append(self.links[flat])
        keys, back = np.unique(np.concatenate(pairs), return_inverse=True)
        n_links = np.zeros(len(keys), dtype=np.int64)
        np.add.at(n_links, back, np.concatenate(links))
        return counts[:4].tolist(), digest.hexdigest(), keys, n_links


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """This worker's."""
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
    return _ALIGNERS[a_path, b_path]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str | None]]]:
    """(id, text) rows in chunks of bounded size."""
    for batch in batches:
        start, held = 0, 0
        for i, x in enumerate(batch.column(1)):
            held += len(x.as_py() or "")
            if held >= CHUNK_CHARS or i + 1 - start >= CHUNK_DOCS or i == len(batch) - 1:
                yield batch.column(0).slice(start, i + 1 - start).to_pylist(), batch.column(1).slice(start, i + 1 - start).to_pylist()
                start, held = i + 1, 0


def _small(values: np.ndarray) -> bytes:
    return pa.compress(planes(values.astype(np.uint64)), codec="zstd", asbytes=True)


def _large(data: bytes, n: int) -> np.ndarray:
    return unplanes(pa.decompress(data, decompressed_size=8 * n, codec="zstd", asbytes=True)).view(np.int64)


CHUNK_TYPE = "chunk long, ids array<long>, counts array<long>, digests array<string>, n_pairs long, pairs binary, holders binary, sizes array<long>, at binary, links binary"


def _tokenizing(a_path: str, b_path: str):
    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, both = TaskContext.get().partitionId() << 32, aligner(a_path, b_path)
        for ids, texts in _slices(batches):
            docs = both.documents(texts)
            keys = np.concatenate([d[2] for d in docs])
            distinct, at, holders = np.unique(keys, return_inverse=True, return_counts=True)
            row = {
                "chunk": chunk,
                "ids": ids,
                "counts": [n for d in docs for n in d[0]],
                "digests": [d[1] for d in docs],
                "n_pairs": len(distinct),
                "pairs": packed(distinct),
                "holders": _small(holders),
                "sizes": [len(d[2]) for d in docs],
                "at": _small(at),
                "links": _small(np.concatenate([d[3] for d in docs])),
            }
            types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types, strict=True)], list(row))
            chunk += 1

    return tokenize


def _order(pairs: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """A chunk's pairs by part, and the part of each: all pairs of an A id go to one."""
    part = (mix64(pairs >> _U(32)) % _U(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return order, part[order]


def _asking(parts: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pairs, holders = unpacked(row["pairs"]), _large(row["holders"], row["n_pairs"])
                order, part = _order(pairs, parts)
                edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)] if len(part) else [0]
                cuts = list(itertools.pairwise(edges))
                columns = [pa.array([int(part[a]) for a, _ in cuts], pa.int32()), pa.array([row["chunk"]] * len(cuts), pa.int64())]
                columns += [pa.array([f(x[order[a:b]]) for a, b in cuts], pa.binary()) for f, x in ((packed, pairs), (lambda x: planes(x.astype(np.uint64)), holders))]
                yield pa.RecordBatch.from_arrays(columns, ["part", "chunk", "pairs", "holders"])

    return ask


def totals(pairs: np.ndarray, holders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each entry's pair's total, and whether no pair of its A id has a larger one."""
    keys, back = np.unique(pairs, return_inverse=True)
    n = np.zeros(len(keys), dtype=np.int64)
    np.add.at(n, back, holders)
    a = keys >> _U(32)
    first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    most = np.repeat(np.maximum.reduceat(n, first), np.diff(first, append=len(a)))
    return n[back], (n == most)[back]


def _counted(key: tuple, rows: pa.Table) -> pa.Table:
    pairs = [unpacked(x.as_py()) for x in rows.column("pairs")]
    n, best = totals(np.concatenate(pairs), np.concatenate([unplanes(x.as_py()).view(np.int64) for x in rows.column("holders")]))
    ends = np.cumsum([len(p) for p in pairs])[:-1]
    return pa.table({
        "chunk": rows.column("chunk"),
        "part": rows.column("part"),
        "n": pa.array([planes(x.astype(np.uint64)) for x in np.split(n, ends)], pa.binary()),
        "best": pa.array([np.packbits(x).tobytes() for x in np.split(best, ends)], pa.binary()),
    })


STATISTICS_TYPE = "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _summing(parts: int):
    def summed(key: tuple, chunk: pa.Table, answers: pa.Table) -> pa.Table:
        row = chunk.to_pylist()[0]
        pairs, answers = unpacked(row["pairs"]), answers.sort_by("part")
        order, _ = _order(pairs, parts)
        n, best = np.zeros(len(pairs), dtype=np.int64), np.zeros(len(pairs), dtype=bool)
        if len(pairs):
            found = [unplanes(x.as_py()).view(np.int64) for x in answers.column("n")]
            n[order] = np.concatenate(found)
            best[order] = np.concatenate([np.unpackbits(np.frombuffer(x.as_py(), dtype=np.uint8), count=len(f)) for x, f in zip(answers.column("best"), found, strict=True)])
        sizes = np.array(row["sizes"], dtype=np.int64)
        at, links = _large(row["at"], sizes.sum()), _large(row["links"], sizes.sum())
        owner, sums = np.repeat(np.arange(len(sizes)), sizes), np.zeros((2, len(sizes)), dtype=np.int64)
        np.add.at(sums[0], owner, links * best[at])
        np.add.at(sums[1], owner, links * n[at])
        counts = np.array(row["counts"], dtype=np.int64).reshape(-1, 4)
        columns = [pa.array(row["ids"], pa.int64()), *(pa.array(np.ascontiguousarray(counts[:, i])) for i in range(4)), pa.array(sums[0]), pa.array(sums[1]), pa.array(row["digests"], pa.string())]
        return pa.Table.from_arrays(columns, ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return summed


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))


def aligned(docs: DataFrame, *, id_col: str, text_col: str, a_path: str, b_path: str) -> DataFrame:
    """(id, groups): each text's groups in order, with the ids of both sides; empty without tokens."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(a_path, b_path)
        kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
        for ids, texts in _slices(batches):
            out = []
            for t in texts:
                units = [u for s in both.segments(" " + t) for u in both.units(s)] if t else []
                groups = [both.groups(u, a, b) for u, a, b in zip(units, *both.encoded(units), strict=True)]
                out.append([] if None in groups else [{"a": a, "b": b} for g in groups for a, b in g])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, kind)], ["id", "groups"])

    return _rows(docs, id_col, text_col).mapInArrow(align, "id long, groups array<struct<a:array<int>,b:array<int>>>")


def statistics(docs: DataFrame, *, id_col: str, text_col: str, a_path: str, b_path: str) -> DataFrame:
    """STATISTICS_TYPE, a row for every row of ``docs``; the id must be an integer.

    ``n_best`` counts links whose id pair no other pair of its A id exceeds in
    documents, ``count_sum`` adds up the documents of each link's pair.
    """
    rows = _rows(docs, id_col, text_col)
    size = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    parts = max(LEAST_PARTS, -(-size // PART_BYTES))
    chunks = stored(rows.mapInArrow(_tokenizing(a_path, b_path), CHUNK_TYPE), "alignment-chunks")
    asked = chunks.select("chunk", "n_pairs", "pairs", "holders").mapInArrow(_asking(parts), "part int, chunk long, pairs binary, holders binary")
    answers = asked.groupBy("part").applyInArrow(_counted, "chunk long, part int, n binary, best binary")
    kept = chunks.select("chunk", "ids", "counts", "digests", "pairs", "sizes", "at", "links")
    return kept.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_summing(parts), STATISTICS_TYPE)


def op12_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    paths = {"a_path": public_tokenizers.path("byte_bpe_50k.json"), "b_path": public_tokenizers.path("piece_bpe_32k.model")}
    return statistics(read(spark, sf_dir, "documents"), id_col="doc_id", text_col="text", **paths).withColumnRenamed("id", "doc_id")
