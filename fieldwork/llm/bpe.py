"""Byte-level BPE encoding and decoding by DuckDB queries, one connection a Python worker.

A text is cut into pieces by a pattern, and each distinct piece is encoded once:
its token-position rows join the merge table, and a recursive query contracts the
leftmost pair of least rank of every piece until no pair is left to merge. Ids of
a text are its pieces' ids in order. Decoding joins the id rows to the vocabulary
and concatenates their bytes by ordered aggregation.

One step contracts a piece's leftmost least pair. A piece over LONG_PIECE bytes is cut
into windows; these are encoded one by one and joined two by two, where some tokens
around a seam are encoded anew until they stand apart from those beside them. Time and
memory for a long piece are so in proportion to its length, with the same ids. Should
that take more than LONG_PIECE bytes around a seam, another query contracts all places
of the least pair in a step, where no merge with the new token has a lower rank.

Texts are worked on in chunks of CHUNK_BYTES. A text over SLICE_BYTES is encoded slice
by slice, cut at spaces that the public pattern always parts (with another pattern, or
without such a space, as a whole), and decoded in queries of SLICE_TOKENS, so a text of
any length takes no more than its own bytes, its ids and a slice's pieces; a connection
keeps to its memory and writes no files. Defined results: a null or empty text has no ids and
decodes to no bytes; repeated rows are encoded one by one; an empty table gives an
empty result. Other columns are neither read nor changed.
"""

from __future__ import annotations

import base64
import itertools
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldwork.llm.common import given_back, read

CHUNK_BYTES = 4_000_000
#: Bytes of a text that are cut into pieces at once, and ids that one decoding query takes.
SLICE_BYTES, SLICE_TOKENS = 2_000_000, 500_000
#: Pieces that a worker remembers; beyond, the older half is forgotten.
MEMO_PIECES = 900_000
#: Bytes of pieces in one recursive query.
QUERY_BYTES = 400_000
#: Bytes above which a piece is cut into windows, and their size.
LONG_PIECE, WINDOW = 64, 16

#: For short pieces: one contraction a step. Rows know the next token and the rank of
#: their pair, so a step looks up the two pairs that change and sorts nothing.
_ONE = """
WITH RECURSIVE s(piece, pos, tok, nxt, ntok, rank, step) AS (
  SELECT piece, pos, tok, nxt, ntok, m.rank, 0
  FROM (SELECT piece, pos, tok, lead(pos) OVER w AS nxt, lead(tok) OVER w AS ntok FROM start WINDOW w AS (PARTITION BY piece ORDER BY pos))
  LEFT JOIN merges m ON m.a = tok AND m.b = ntok
  UNION ALL
  SELECT c.piece, c.pos, c.tok, c.nxt, c.ntok, CASE WHEN c.changed THEN m.rank ELSE c.rank END, c.step
  FROM (
    WITH least AS MATERIALIZED (
      SELECT piece, min(rank * 1048576 + pos) AS best, arg_min(nxt, rank * 1048576 + pos) AS eaten FROM s WHERE rank IS NOT NULL GROUP BY piece
    ), known AS MATERIALIZED (
      SELECT l.piece, best % 1048576 AS at, (best // 1048576)::INTEGER AS new, eaten, x.nxt, x.ntok
      FROM least l JOIN s x ON x.piece = l.piece AND x.pos = l.eaten
    )
    SELECT s.piece, s.pos, CASE WHEN s.pos = k.at THEN k.new ELSE s.tok END AS tok,
      CASE WHEN s.pos = k.at THEN k.nxt ELSE s.nxt END AS nxt,
      CASE WHEN s.pos = k.at THEN k.ntok WHEN s.nxt = k.at THEN k.new ELSE s.ntok END AS ntok,
      (s.pos = k.at OR coalesce(s.nxt = k.at, false)) AS changed, s.rank, s.step + 1 AS step
    FROM s JOIN known k USING (piece) WHERE s.pos <> k.eaten
  ) c LEFT JOIN merges m ON m.a = CASE WHEN c.changed THEN c.tok END AND m.b = c.ntok
)
SELECT piece, list(tok ORDER BY pos) AS ids
FROM s JOIN (SELECT piece, max(step) AS step FROM s GROUP BY piece) USING (piece, step)
GROUP BY piece ORDER BY piece
"""

#: For long spans: all places of the least pair in a step, where that is safe.
_MANY = """
WITH RECURSIVE s(piece, pos, tok, step) AS (
  SELECT piece, pos, tok, 0 FROM start
  UNION ALL
  SELECT piece, pos, tok, step FROM (
    WITH pairs AS (
      SELECT p.piece, p.pos, p.tok, p.step, m.rank, m.safe
      FROM (
        SELECT piece, row_number() OVER w AS pos, tok, step, lead(tok) OVER w AS nxt
        FROM s WINDOW w AS (PARTITION BY piece ORDER BY pos)
      ) p LEFT JOIN merges m ON p.tok = m.a AND p.nxt = m.b
    ), least AS (
      SELECT piece, min(rank) AS rank FROM pairs WHERE rank IS NOT NULL GROUP BY piece
    ), hits AS (
      SELECT piece, pos, rank, safe, pos - row_number() OVER w AS run, first_value(pos) OVER w AS leftmost
      FROM pairs JOIN least USING (piece, rank) WINDOW w AS (PARTITION BY piece ORDER BY pos)
    ), contracted AS (
      SELECT piece, pos, rank FROM (
        SELECT *, (pos - min(pos) OVER (PARTITION BY piece, run)) % 2 = 0 AS apart FROM hits
      ) WHERE CASE WHEN safe THEN apart ELSE pos = leftmost END
    )
    SELECT piece, pos, coalesce(c.rank, q.tok) AS tok, q.step + 1 AS step
    FROM pairs q SEMI JOIN least USING (piece)
    LEFT JOIN contracted c USING (piece, pos)
    ANTI JOIN (SELECT piece, pos + 1 AS pos FROM contracted) eaten USING (piece, pos)
  )
)
SELECT piece, list(tok ORDER BY pos) AS ids
FROM s JOIN (SELECT piece, max(step) AS step FROM s GROUP BY piece) USING (piece, step)
GROUP BY piece ORDER BY piece
"""


def trim(memo: dict, most: int) -> None:
    if len(memo) > most:
        for k in list(itertools.islice(memo, len(memo) - most // 2)):
            del memo[k]


# The public pattern of byte-level vocabularies, and one that cuts ASCII texts alike.
PUBLIC_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ASCII_PATTERN = r""" ?[A-Za-z]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"""


#: A space between two visible ASCII characters; the cut comes after the first.
_SAFE_SPACE = re.compile(rb"[!-~](?= [!-~])")


def finder(pattern: str) -> Callable[[str], list[str]]:
    """Cuts a text into pieces; ASCII texts by the standard library's engine, which is faster."""
    find = regex.compile(pattern).findall
    if pattern != PUBLIC_PATTERN:
        return find
    find_ascii = re.compile(ASCII_PATTERN, re.ASCII).findall
    return lambda t: find_ascii(t) if t.isascii() else find(t)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """Encoder and decoder of one vocabulary; ``of`` keeps one a process."""

    _kept: dict[tuple[str, str], Codec] = {}

    @classmethod
    def of(cls, ranks_path: str, pattern: str) -> Codec:
        key = (ranks_path, pattern)
        if key not in cls._kept:
            cls._kept[key] = cls(load_ranks(ranks_path), pattern)
        return cls._kept[key]

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import duckdb

        self.ranks = ranks
        self.find = finder(pattern)
        self.sliced = pattern == PUBLIC_PATTERN
        # an empty folder name: nothing is written to the worker's own disk
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "200MB", "preserve_insertion_order": False, "temp_directory": ""})
        self.pieces: dict[str, bytes] = {}
        self.chars = {rank: token for token, rank in ranks.items()}
        self.stands: dict[tuple[int, int], bool] = {}
        firsts, seconds, merged = [], [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    firsts.append(a)
                    seconds.append(b)
                    merged.append(rank)
        a, b, rank = (np.array(x, dtype=np.int32) for x in (firsts, seconds, merged))
        unsafe = np.zeros(max(ranks.values(), default=0) + 1, dtype=bool)
        for side in (a, b):
            unsafe[side[rank < side]] = True
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        table = pa.table({"a": a, "b": b, "rank": rank.astype(np.int64), "safe": pa.array(~unsafe[rank])})
        vocabulary = pa.table({"tok": pa.array(list(ranks.values()), pa.int32()), "chars": pa.array([b.decode("latin-1") for b in ranks])})
        self.db.register("_m", table)
        self.db.register("_v", vocabulary)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM _m; CREATE TABLE vocabulary AS SELECT * FROM _v")
        self.db.unregister("_m")
        self.db.unregister("_v")

    def _contract(self, pieces: list[bytes], query: str) -> list[np.ndarray]:
        """The ids that contraction leaves of each piece."""
        lengths = np.array([len(p) for p in pieces])
        piece = np.repeat(np.arange(len(pieces), dtype=np.int32), lengths)
        pos = (np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int64)
        tok = self.byte_ids[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        self.db.register("start", pa.table({"piece": piece, "pos": pos, "tok": tok}))
        got = self.db.sql(query).to_arrow_table().combine_chunks()
        self.db.unregister("start")
        ids = got.column("ids").combine_chunks()
        if isinstance(ids, pa.ChunkedArray):
            ids = pa.concat_arrays(ids.chunks)
        flat = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4")
        return np.split(flat, np.cumsum(np.diff(ids.offsets.to_numpy()))[:-1])

    def _merged(self, pieces: Iterable[bytes]) -> dict[bytes, np.ndarray]:
        """The ids of distinct pieces, by the two queries in batches of QUERY_BYTES."""
        out: dict[bytes, np.ndarray] = {}
        batches: dict[str, list[bytes]] = {_ONE: [], _MANY: []}
        held = {_ONE: 0, _MANY: 0}
        # pieces of a like length end in like steps
        for p in sorted(pieces, key=len):
            query = _MANY if len(p) > LONG_PIECE else _ONE
            batches[query].append(p)
            held[query] += len(p)
            if held[query] >= QUERY_BYTES:
                out.update(zip(batches[query], self._contract(batches[query], query), strict=True))
                batches[query], held[query] = [], 0
        for query, batch in batches.items():
            if batch:
                out.update(zip(batch, self._contract(batch, query), strict=True))
        return out

    def _stand(self, pairs: set[tuple[int, int]]) -> None:
        """Learns which two tokens stay apart when their bytes are encoded together."""
        new = [p for p in pairs if p not in self.stands]
        got = self._merged({self.chars[a] + self.chars[b] for a, b in new})
        for a, b in new:
            self.stands[a, b] = got[self.chars[a] + self.chars[b]].tolist() == [a, b]

    def _seamed(self, sides: list[tuple[list[int], list[int]]]) -> list[list[int]]:
        """The ids of what each two neighbours, encoded one by one, stand for together.

        Some tokens around the seam are encoded anew; that holds if they stand apart
        from those beside them, else more tokens are taken.
        """
        out: list[list[int]] = [[]] * len(sides)
        left, m = list(range(len(sides))), 2
        while left:
            cut = {i: (sides[i][0][-m:] + sides[i][1][:m]) for i in left}
            spans = {i: b"".join(map(self.chars.__getitem__, x)) for i, x in cut.items()}
            got = self._merged(set(spans.values()))
            new = {i: got[spans[i]].tolist() for i in left}
            beside = {i: [*((x, new[i][0]) for x in a[-m - 1 : -m]), *((new[i][-1], x) for x in b[m : m + 1])] for i in left for a, b in (sides[i],)}
            self._stand({p for x in beside.values() for p in x})
            for i in left:
                a, b = sides[i]
                if all(self.stands[p] for p in beside[i]):
                    out[i] = a[: max(0, len(a) - m)] + new[i] + b[m:]
            left = [i for i in left if not out[i]]
            m *= 2
        return out

    def _long(self, piece: bytes) -> np.ndarray:
        """The ids of a long piece: windows of it, joined two by two.

        Ids are the encoding of their bytes if every two neighbours are: until a first
        merge over a token's edge, all goes on as in the two tokens there alone.
        """
        windows = [piece[i : i + WINDOW] for i in range(0, len(piece), WINDOW)]
        got = self._merged(set(windows))
        parts = [got[w].tolist() for w in windows]
        while len(parts) > 1:
            even = len(parts) // 2 * 2
            parts = self._seamed(list(zip(parts[:even:2], parts[1:even:2], strict=True))) + parts[even:]
        trim(self.stands, MEMO_PIECES // 4)
        return np.array(parts[0], dtype="<u4")

    def _learn(self, pieces: Iterable[str]) -> None:
        short = {}
        for p in pieces:
            if p in self.pieces:
                continue
            b = p.encode()
            whole = self.ranks.get(b)
            if whole is not None:
                self.pieces[p] = whole.to_bytes(4, "little")
            elif len(b) > LONG_PIECE:
                self.pieces[p] = self._long(b).tobytes()
            else:
                short[b] = p
        for b, ids in self._merged(short).items():
            self.pieces[short[b]] = ids.tobytes()

    def encode(self, texts: list[bytes], memo_pieces: int = MEMO_PIECES) -> list[bytes]:
        """The ids of each text as packed little-endian integers; a long text goes slice by slice."""
        short = [len(t) <= SLICE_BYTES for t in texts]
        trim(self.pieces, memo_pieces)
        cut = [self.find(t.decode()) if s else () for t, s in zip(texts, short, strict=True)]
        self._learn(set().union(*cut))
        out = [b"".join(map(self.pieces.__getitem__, x)) for x in cut]
        for i, t in enumerate(texts):
            if not short[i]:
                out[i] = b"".join(self._slice(part, memo_pieces) for part in self.slices(t))
        return out

    def _slice(self, text: bytes, memo_pieces: int) -> bytes:
        trim(self.pieces, memo_pieces)
        cut = self.find(text.decode())
        self._learn(set(cut))
        return b"".join(map(self.pieces.__getitem__, cut))

    def slices(self, text: bytes) -> Iterator[bytes]:
        """A text in slices at spaces that the public pattern always parts; by another pattern, the whole."""
        start = 0
        while self.sliced and len(text) - start > SLICE_BYTES and (space := _SAFE_SPACE.search(text, start + SLICE_BYTES)):
            yield text[start : space.start() + 1]
            start = space.start() + 1
        yield text[start:]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes of each row of ids; the inverse of ``encode``. A query takes SLICE_TOKENS at most; long rows take several."""
        out: list[list[bytes]] = [[] for _ in ids]
        batch: list[tuple[int, bytes]] = []
        held, most = 0, 4 * SLICE_TOKENS

        def ask() -> None:
            for (i, _), t in zip(batch, self._decoded([x for _, x in batch]), strict=True):
                out[i].append(t)

        for i, x in enumerate(ids):
            for start in range(0, len(x), most):
                part = x[start : start + most]
                if held + len(part) > most:
                    ask()
                    batch, held = [], 0
                batch.append((i, part))
                held += len(part)
        ask()
        return [b"".join(x) for x in out]

    def _decoded(self, ids: list[bytes]) -> list[bytes]:
        lengths = np.array([len(x) // 4 for x in ids], dtype=np.int64)
        row = np.repeat(np.arange(len(ids), dtype=np.int32), lengths)
        tok = np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int32)
        self.db.register("encoded", pa.table({"row": row, "pos": np.arange(len(tok), dtype=np.int32), "tok": tok}))
        got = self.db.sql("SELECT row, array_to_string(list(chars ORDER BY pos), '') AS t FROM encoded JOIN vocabulary USING (tok) GROUP BY row").to_arrow_table()
        self.db.unregister("encoded")
        out = [b""] * len(ids)
        for k, t in zip(got.column("row").to_pylist(), got.column("t").to_pylist(), strict=True):
            out[k] = t.encode("latin-1")
        return out


def chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[list[bytes]]:
    held: list[bytes] = []
    size = 0
    for x in texts:
        t = x.as_py() or b""
        held.append(t)
        size += len(t)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def encoded(text: Column, *, ranks_path: str, pattern: str, memo_pieces: int = MEMO_PIECES, chunk_bytes: int = CHUNK_BYTES) -> Column:
    """The ids of a text column as binary, little-endian unsigned 32-bit integers.

    A worker's memory depends on ``memo_pieces`` and ``chunk_bytes``, the result does not.
    """

    @F.arrow_udf(T.BinaryType())
    def encode(texts: pa.Array) -> pa.Array:
        codec = Codec.of(ranks_path, pattern)
        return pa.array([x for c in chunks(texts, chunk_bytes) for x in codec.encode(c, memo_pieces)], pa.binary())

    return encode(text.cast("binary"))


def decoded(ids: Column, *, ranks_path: str, pattern: str, chunk_bytes: int = CHUNK_BYTES) -> Column:
    """The bytes of a column of ids as ``encoded`` returns them."""

    @F.arrow_udf(T.BinaryType())
    def decode(rows: pa.Array) -> pa.Array:
        codec = Codec.of(ranks_path, pattern)
        return pa.array([x for c in chunks(rows, chunk_bytes) for x in codec.decode(c)], pa.binary())

    return decode(ids)


def round_trip(docs: DataFrame, *columns: str, text_col: str, ranks_path: str, pattern: str, memo_pieces: int = MEMO_PIECES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``columns`` of ``docs`` with ``ids``, as ``encoded`` has them, and ``back``, the bytes decoded from them.

    Rows leave a worker chunk by chunk, so it never holds more than a chunk's results.
    """
    rows = docs.select(*columns, F.col(text_col).cast("binary").alias("ids"))
    shape = T.StructType([*rows.schema.fields, T.StructField("back", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(ranks_path, pattern)
        for batch in batches:
            start = 0
            for texts in chunks(batch.column(len(columns)), chunk_bytes):
                ids = codec.encode(texts, memo_pieces)
                back = codec.decode(ids)
                kept = batch.slice(start, len(texts)).columns[:-1]
                start += len(texts)
                yield pa.RecordBatch.from_arrays([*kept, pa.array(ids, pa.binary()), pa.array(back, pa.binary())], shape.names)
        batch = texts = ids = back = kept = None
        given_back()

    return rows.mapInArrow(run, shape)


def public_vocabulary() -> dict[str, str]:
    import public_tokenizers

    return {"ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = round_trip(read(spark, sf_dir, "documents"), "doc_id", text_col="text", **public_vocabulary())
    return both.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("back", 256).alias("decoded_sha256"))
