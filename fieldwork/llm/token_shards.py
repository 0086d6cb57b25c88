"""Token ids as raw binary shards with a minimal perfect hash index.

Documents are range-partitioned and sorted by id, and every partition streams one
shard file:

    payload    ids, little-endian, 2 bytes each if the vocabulary has at most
               65,536 entries, else 4
    keys       per document in order: id (int64), null flag (uint8), occurrence (uint32)
    seeds      per bucket of the hash: displacement (uint32)
    slots      per slot: first id (uint64), number of ids (uint64), fingerprint (uint32)
    footer     magic, id width, numbers of documents, ids and buckets

A key is a document id with its occurrence number among the shard's rows of that id. Its
hash names a bucket, the bucket's displacement names the slot, and the slot's stored
fingerprint tells a foreign key with probability 1 - 2^-32. Lookups take constant
time and read only the document's own ids.

A manifest lists the shards in order, each with its first and last id and the number of
rows that its first id has in earlier shards. It leads a key of the data set (id, and
occurrence over all shards) to its shard; an id of many rows may lie in several.

Files go to the shared folder through the file system named in the path. Every
attempt of a task writes a name of its own, and only the rows of successful tasks
name files, so lost executors and repeated tasks leave the result unchanged.

Defined results: a null or empty text has only the end id; a null id comes first;
rows of one id stand next to each other, told apart by occurrence; an added token of the
tokenizer in a text becomes its id, as the library has it; an empty table writes no shard and gives an empty result. Other columns are neither read nor
changed.
"""

from __future__ import annotations

import bisect
import json
import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwork.llm.bpe import chunks, finder, trim
from fieldwork.llm.common import mix64, read, scratch_path

END_ID = 0
_MAGIC = b"FWIDS001"
_FOOTER = struct.Struct("<8sQQQQ")
#: Keys to a bucket of the hash: with two, an eighth of the slots is left for buckets of one key, so few displacements are tried.
_BUCKET_KEYS = 2
MANIFEST = "manifest.json"
#: Shards that a reader keeps open.
OPEN_SHARDS = 64
_WINDOW = 8 << 20
#: Bytes of text that are encoded together.
CHUNK_BYTES = 2_000_000
#: Text behind a shard.
SHARD_BYTES = 32 << 20
#: Pieces that a worker remembers; beyond, the older half is forgotten.
MEMO_PIECES = 1_200_000


class LibraryEncoder:
    """Ids by the tokenizers library, as it encodes a whole text without adding tokens.

    With the ``pattern`` that a byte-level tokenizer cuts texts by, the library encodes
    each distinct match once, and its ids are remembered. Texts that hold one of the
    library's own added tokens, which it cuts out first, are encoded as a whole, and so
    are all texts without a pattern.
    """

    _kept: dict[tuple[str, str | None], LibraryEncoder] = {}

    @classmethod
    def of(cls, path: str, pattern: str | None = None) -> LibraryEncoder:
        if (path, pattern) not in cls._kept:
            cls._kept[path, pattern] = cls(path, pattern)
        return cls._kept[path, pattern]

    def __init__(self, path: str, pattern: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.find = finder(pattern) if pattern else None
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        kind = "H" if self.kind == "<u2" else "I"
        # packed as the machine does; shards are written on little-endian ones
        return [array(kind, x.ids).tobytes() for x in got]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as packed little-endian integers."""
        known = [t.decode() for t in texts]
        if not self.find:
            return self._ids(known)
        whole = [any(x in t for x in self.added) for t in known]
        cut = [[] if w else self.find(t) for t, w in zip(known, whole, strict=True)]
        trim(self.pieces, MEMO_PIECES)
        new = list(set().union(*cut).difference(self.pieces))
        apart = [t for t, w in zip(known, whole, strict=True) if w]
        got = self._ids([*new, *apart])
        self.pieces.update(zip(new, got, strict=False))
        rest = iter(got[len(new) :])
        return [next(rest) if w else b"".join(map(self.pieces.__getitem__, x)) for x, w in zip(cut, whole, strict=True)]


def _hashes(keys: list[tuple[int | None, int]]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(f"{k}:{n}".encode()) for k, n in keys), dtype=np.uint64, count=len(keys))


def _place(h: np.ndarray, seed: np.ndarray | int, n: int) -> np.ndarray:
    return mix64(h ^ (np.asarray(seed).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) % np.uint64(n)


class PerfectHash:
    """Minimal perfect hash by displacement: seeds by bucket, slots 0..n-1.

    Buckets of several keys get the first displacement that puts all of them on free
    slots, larger buckets first. Buckets of one key then get the slots left over: the
    highest bit of their seed marks the rest as the slot itself.
    """

    DIRECT = 1 << 31

    @staticmethod
    def build(h: np.ndarray) -> np.ndarray:
        n = len(h)
        buckets = max(1, -(-n // _BUCKET_KEYS))
        of = h % np.uint64(buckets)
        order = np.argsort(of, kind="stable")
        sizes = np.bincount(of.astype(np.int64), minlength=buckets)
        ends = np.cumsum(sizes)
        seeds = np.zeros(buckets, dtype=np.uint32)
        free = np.ones(n, dtype=bool)
        for b in np.argsort(-sizes, kind="stable"):
            k = int(sizes[b])
            if k < 2:
                break
            keys = h[order[ends[b] - k : ends[b]]]
            seed = 1
            while True:
                tried = np.arange(seed, seed + 64, dtype=np.uint64)
                at = _place(keys[None, :], tried[:, None], n).astype(np.int64)
                good = free[at].all(axis=1)
                for row in np.flatnonzero(good):
                    if len(set(at[row].tolist())) == k:
                        seeds[b] = seed + row
                        free[at[row]] = False
                        break
                else:
                    seed += 64
                    if seed >= PerfectHash.DIRECT:
                        raise ValueError("keys with equal hashes")
                    continue
                break
        left = np.flatnonzero(free)
        single = np.flatnonzero(sizes == 1)
        seeds[single] = left[: len(single)].astype(np.uint32) | np.uint32(PerfectHash.DIRECT)
        return seeds

    @staticmethod
    def slots(h: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
        """The slot of each key of the set; any slot for other keys."""
        s = seeds[(h % np.uint64(len(seeds))).astype(np.int64)]
        direct = s >= PerfectHash.DIRECT
        at = _place(h, s, n)
        return np.where(direct, s & np.uint32(PerfectHash.DIRECT - 1), at).astype(np.int64) % n


class ShardWriter:
    """Streams one shard; rows must come in order."""

    def __init__(self, folder: str, width: int):
        fs, path = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        name = f"shard-{uuid.uuid4().hex}.ids"
        self.path = f"{folder}/{name}"
        self.out = fs.open_output_stream(f"{path}/{name}")
        self.width = width
        self.keys: list[tuple[int | None, int]] = []
        self.lengths: list[int] = []

    def add(self, key: int | None, ids: bytes) -> None:
        n = self.keys[-1][1] + 1 if self.keys and self.keys[-1][0] == key else 0
        self.keys.append((key, n))
        self.lengths.append(len(ids) // self.width)
        self.out.write(ids)

    def close(self) -> tuple[int, int]:
        lengths = np.array(self.lengths, dtype=np.uint64)
        n, total = len(lengths), int(lengths.sum())
        h = _hashes(self.keys)
        seeds = PerfectHash.build(h)
        at = PerfectHash.slots(h, seeds, n)
        table = np.zeros(n, dtype=[("first", "<u8"), ("count", "<u8"), ("print", "<u4")])
        table["first"][at] = np.cumsum(lengths) - lengths
        table["count"][at] = lengths
        table["print"][at] = (h >> np.uint64(32)).astype(np.uint32)
        rows = np.zeros(n, dtype=[("id", "<i8"), ("null", "u1"), ("n", "<u4")])
        rows["id"] = [k or 0 for k, _ in self.keys]
        rows["null"] = [k is None for k, _ in self.keys]
        rows["n"] = [x for _, x in self.keys]
        for part in (rows.tobytes(), seeds.astype("<u4").tobytes(), table.tobytes(), _FOOTER.pack(_MAGIC, self.width, n, total, len(seeds))):
            self.out.write(part)
        self.out.close()
        return n, total


class ShardReader:
    """Keyed access to one shard."""

    def __init__(self, path: str):
        fs, inner = pyarrow.fs.FileSystem.from_uri(path)
        self.file = fs.open_input_file(inner)
        size = self.file.size()
        magic, self.width, self.n, self.total, buckets = _FOOTER.unpack(self.file.read_at(_FOOTER.size, size - _FOOTER.size))
        if magic != _MAGIC:
            raise ValueError(f"{path} is not a token shard")
        at = self.total * self.width
        kinds = ([("id", "<i8"), ("null", "u1"), ("n", "<u4")], self.n), ("<u4", buckets), ([("first", "<u8"), ("count", "<u8"), ("print", "<u4")], self.n)
        parts = []
        for kind, count in kinds:
            bytes_ = np.dtype(kind).itemsize * count
            parts.append(np.frombuffer(self.file.read_at(bytes_, at), dtype=kind))
            at += bytes_
        self.rows, self.seeds, self.table = parts
        self.kind = f"<u{self.width}"
        self.window, self.window_at = b"", 0

    def keys(self) -> list[tuple[int | None, int]]:
        return [(None if null else k, n) for k, null, n in self.rows.tolist()]

    def find(self, keys: list[tuple[int | None, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First id, number of ids, and whether the fingerprint matches, for each key."""
        if not keys or not self.n:
            none = np.zeros(len(keys), dtype=np.uint64)
            return none, none, none.astype(bool)
        h = _hashes(keys)
        got = self.table[PerfectHash.slots(h, self.seeds, self.n)]
        return got["first"], got["count"], got["print"] == (h >> np.uint64(32)).astype(np.uint32)

    def ids(self, first: int, count: int) -> np.ndarray:
        begin, size = first * self.width, count * self.width
        if not (self.window_at <= begin and begin + size <= self.window_at + len(self.window)):
            self.window = self.file.read_at(min(max(size, _WINDOW), self.total * self.width - begin), begin)
            self.window_at = begin
        return np.frombuffer(self.window, dtype=self.kind, count=count, offset=begin - self.window_at)

    def get(self, key: int | None, occurrence: int = 0) -> np.ndarray | None:
        first, count, found = self.find([(key, occurrence)])
        return self.ids(int(first[0]), int(count[0])) if found[0] else None


def _order(key: int | None) -> tuple[bool, int]:
    return (key is not None, key or 0)


@dataclass(frozen=True)
class Shard:
    """A shard's entry in the manifest: its documents, and what lies before it.

    ``before`` counts the rows of ``first``, its first id, in earlier shards: the
    occurrence in the shard and these make the occurrence in the data set.
    """

    path: str
    docs: int
    ids: int
    start: int
    first: int | None
    last: int | None
    before: int


class TokenShards:
    """Keyed access to a data set of shards by its manifest."""

    def __init__(self, shards: list[Shard]):
        self.shards = shards
        self.lasts = [_order(s.last) for s in shards]
        self.open: dict[int, ShardReader] = {}

    @classmethod
    def load(cls, folder: str) -> TokenShards:
        fs, path = pyarrow.fs.FileSystem.from_uri(folder)
        with fs.open_input_stream(f"{path}/{MANIFEST}") as f:
            return cls([Shard(**x) for x in json.loads(f.read())])

    def save(self, folder: str) -> None:
        fs, path = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        with fs.open_output_stream(f"{path}/{MANIFEST}") as f:
            f.write(json.dumps([asdict(s) for s in self.shards]).encode())

    def get(self, key: int | None, occurrence: int = 0) -> np.ndarray | None:
        """The ids of a document, or None; reads the shards that may hold it."""
        for no in range(bisect.bisect_left(self.lasts, _order(key)), len(self.shards)):
            shard = self.shards[no]
            if _order(shard.first) > _order(key):
                break
            local = occurrence - (shard.before if shard.first == key else 0)
            if no not in self.open:
                if len(self.open) >= OPEN_SHARDS:
                    self.open.clear()
                self.open[no] = ShardReader(shard.path)
            if local >= 0 and (ids := self.open[no].get(key, local)) is not None:
                return ids
        return None


def write_shards(docs: DataFrame, folder: str, *, id_col: str, text_col: str, tokenizer_path: str, pattern: str | None = None, end_id: int = END_ID) -> TokenShards:
    """Writes all documents as shards in order of the ids, and their manifest."""
    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("binary").alias("t"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    dealt = rows.repartitionByRange(max(1, -(-size // SHARD_BYTES)), "k", F.xxhash64("t")).sortWithinPartitions("k", F.xxhash64("t"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = LibraryEncoder.of(tokenizer_path, pattern)
        end = np.array([end_id], dtype=encoder.kind).tobytes()
        writer = None
        for batch in batches:
            keys = iter(batch.column(0).to_pylist())
            for texts in chunks(batch.column(1), CHUNK_BYTES):
                writer = writer or ShardWriter(folder, len(end))
                for ids in encoder.encode(texts):
                    writer.add(next(keys), ids + end)
        if writer:
            n, total = writer.close()
            (first, _), (last, again) = writer.keys[0], writer.keys[-1]
            columns = {"no": TaskContext.get().partitionId(), "path": writer.path, "docs": n, "ids": total, "first": first, "last": last, "lasting": again + 1}
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.string() if k == "path" else pa.int64()) for k, v in columns.items()], list(columns))

    found = dealt.mapInArrow(write, "no long, path string, docs long, ids long, first long, last long, lasting long").collect()
    shards: list[Shard] = []
    start, key, rows_of_key = 0, (None, None), 0
    for r in sorted(found, key=lambda r: r["no"]):
        before = rows_of_key if _order(r["first"]) == key else 0
        shards.append(Shard(r["path"], r["docs"], r["ids"], start, r["first"], r["last"], before))
        start += r["ids"]
        key, rows_of_key = _order(r["last"]), r["lasting"] + (before if _order(r["first"]) == _order(r["last"]) else 0)
    out = TokenShards(shards)
    out.save(folder)
    return out


def read_shards(spark: SparkSession, shards: list[Shard]) -> DataFrame:
    """Every document of the shards by keyed access: doc_id, occurrence, start, n_tokens, ids_crc32."""
    listed = spark.createDataFrame([(s.path, s.start, s.first, s.before) for s in shards], "path string, start long, first long, before long")

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, first_key, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shard = ShardReader(path)
                keys = shard.keys()
                for i in range(0, len(keys), 10_000):
                    part = keys[i : i + 10_000]
                    first, count, found = shard.find(part)
                    if not found.all():
                        raise ValueError(f"{path}: a key is missing")
                    crc = [zlib.crc32(shard.ids(a, n).astype("<u4").tobytes()) for a, n in zip(first.tolist(), count.tolist(), strict=True)]
                    columns = {
                        "doc_id": pa.array([k for k, _ in part], pa.int64()),
                        "occurrence": pa.array([n + (before if k == first_key else 0) for k, n in part], pa.int64()),
                        "start": pa.array(first.astype(np.int64) + start),
                        "n_tokens": pa.array(count.astype(np.int64)),
                        "ids_crc32": pa.array(crc, pa.int64()),
                    }
                    yield pa.RecordBatch.from_pydict(columns)

    return listed.mapInArrow(look_up, "doc_id long, occurrence long, start long, n_tokens long, ids_crc32 long")


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents")
    path = public_tokenizers.path("byte_bpe_50k.json")
    written = write_shards(docs, scratch_path(spark, "token-shards"), id_col="doc_id", text_col="text", tokenizer_path=path, pattern=public_tokenizers.PATTERN)
    return read_shards(spark, written.shards).drop("occurrence")
