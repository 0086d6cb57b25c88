"""Prefix trie of conversations: succinct level-order tries by prefix shard, heavy upper levels apart.

Conversations are rebuilt first: ``c`` takes the first ``h`` turns of ``c - c % GROUP``
in place of its own first ``h``, ``h = crc32(c) % TURNS``. A turn moves as a 128-bit
digest of role and text with the text's bytes; all conversations of a base lie in one
range of ids, so one range shuffle brings together what is needed. A node is a distinct
beginning of a rebuilt conversation, named by 128 bits over its turns' digests; its
members are the conversations that begin so.

Heavy nodes have more than HEAVY members; their number is at most turns / HEAVY, and
HEAVY rises with the turns so that there are at most UPPER_NODES, which go to every
task. They make up the upper levels. A conversation goes to the shard of its first
light node, so all of a light node lies in one shard, however many conversations share
a beginning, and a shard has a bounded number of them beside its average.

A shard's trie is laid out level by level as LOUDS: for each node in order a one for
each child and a zero, with label arrays in the same order. Parents and degrees are
ranks and selects of the bits, and leaves and savings are rolled up from the last level
to the first by ``np.add.at``. The light roots' sums, added up for each heavy parent,
are leaves of the upper trie, which is rolled up the same way.

Ids that end at a heavy node are hashed as a stream in ascending order: each batch
sends its ids for a node in one row, rows are sorted by node and first id, and a task
holds one row at a time.

Turns are ordered by ``turn``, null first, ties by a digest of role and text; a null
role or text is empty, and repeated rows are turns of their own. Rows without
conversation id belong to none. Texts of any length count by bytes alone. ``%`` keeps
the sign, as in SQL. An empty table has no nodes. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwork.llm.common import mix64, packed, planes, read, stored, unpacked, unplanes

#: Conversations of a base lie within so many ids; turns taken from it are fewer than TURNS.
GROUP, TURNS = 5, 9
#: Least members that make a node heavy, and the most heavy nodes.
LEAST_HEAVY, UPPER_NODES = 64, 1_000_000
#: Turns to one range partition and to one shard.
RANGE_TURNS, SHARD_TURNS, LEAST_PARTS = 2_000_000, 500_000, 12

_U = np.uint64
_R = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD95)
EMPTY = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def rebuilt(turns: DataFrame, *, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(part, conv, keys, bytes): each conversation's turns in order, in ascending ranges ``part`` of ids."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    key = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    conv = F.col(conv_col).cast("long")
    rows = turns.where(conv.isNotNull()).select((conv - conv % GROUP).alias("base"), conv.alias("conv"), F.col(turn_col).alias("turn"), key.alias("key"), F.octet_length(text).cast("long").alias("bytes"))
    rows = stored(rows, "trie-turns")
    parts = max(LEAST_PARTS, -(-rows.count() // RANGE_TURNS))
    ranged = rows.repartitionByRange(parts, "base")
    each = ranged.groupBy("base", "conv").agg(F.sort_array(F.collect_list(F.struct("turn", "key", "bytes"))).alias("own"))
    bases = each.groupBy("base").agg(F.collect_list(F.struct("conv", "own")).alias("all"))
    of_base = F.flatten(F.transform(F.filter("all", lambda c: c["conv"] == F.col("base")), lambda c: c["own"]))
    split = bases.select(of_base.alias("first"), F.explode("all").alias("c")).select("first", "c.*")
    h = (F.crc32(F.col("conv").cast("string")) % TURNS).cast("int")
    whole = F.concat(F.slice("first", 1, h), F.slice("own", h + 1, F.greatest(F.size("own"), F.lit(1))))
    done = split.select(F.spark_partition_id().alias("part"), "conv", whole.alias("t"))
    done = done.select("part", "conv", F.col("t.key").alias("keys"), F.col("t.bytes").alias("bytes"))
    return stored(done.sortWithinPartitions("conv"), "trie-rebuilt")


class Paths:
    """The nodes on the way of each conversation of a batch, flat: names, depths and bytes."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        self.part, self.conv = batch.column("part").to_numpy(), batch.column("conv").to_numpy()
        keys = batch.column("keys")
        self.n = np.diff(keys.offsets.to_numpy()).astype(np.int64)
        flat = keys.flatten()
        digests = np.frombuffer(b"".join(flat.to_pylist()), dtype="<u8").reshape(-1, 2)
        self.bytes = batch.column("bytes").flatten().to_numpy()
        self.first = np.cumsum(self.n) - self.n
        self.owner = np.repeat(np.arange(len(self.n)), self.n)
        self.depth = np.arange(len(flat)) - np.repeat(self.first, self.n) + 1
        self.name = np.stack([self._chained(mix64(digests[:, i] ^ _R[i]), _R[i]) for i in range(2)])
        self.parent = np.where(self.depth == 1, _U(0), np.concatenate([np.zeros((2, 1), dtype=np.uint64), self.name[:, :-1]], axis=1)[:, : len(flat)])

    def _chained(self, keys: np.ndarray, r: np.uint64) -> np.ndarray:
        powers = np.full(int(self.n.max(initial=0)), r, dtype=np.uint64).cumprod(dtype=np.uint64)
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(keys * powers[self.depth - 1], dtype=np.uint64)])
        return mix64(sums[1:] - np.repeat(sums[self.first], self.n))


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node that a batch meets, with its members there; the root first."""
    for batch in batches:
        p = Paths(batch)
        order = np.lexsort((p.conv[p.owner], p.name[1], p.name[0]))
        name = p.name[:, order]
        new = np.flatnonzero(np.concatenate([np.ones(min(1, len(order)), dtype=bool), (name[:, 1:] != name[:, :-1]).any(axis=0)]))
        at = order[new]
        yield pa.RecordBatch.from_arrays(
            [
                _long(np.append(_U(0), p.name[0][at])),
                _long(np.append(_U(0), p.name[1][at])),
                _long(np.append(_U(0), p.parent[0][at])),
                _long(np.append(_U(0), p.parent[1][at])),
                pa.array(np.append(0, p.depth[at])),
                pa.array(np.append(0, p.bytes[at]).astype(np.int64)),
                pa.array(np.append(len(p.conv), np.diff(new, append=len(order)))),
                pa.array(np.append(p.conv.min(initial=np.iinfo(np.int64).max), p.conv[p.owner[at]])),
            ],
            ["p", "q", "up_p", "up_q", "depth", "bytes", "n", "conv"],
        )


class Heavy:
    """The heavy nodes, sorted by name; at most UPPER_NODES."""

    def __init__(self, rows: pa.Table) -> None:
        p, q, conv = (rows.column(c).to_numpy() for c in ("p", "q", "conv"))
        order = np.lexsort((q.view(np.uint64), p.view(np.uint64)))
        self.p, self.q, self.conv = p.view(np.uint64)[order], q.view(np.uint64)[order], conv[order]

    def at(self, name: np.ndarray) -> np.ndarray:
        """Places of names; -1 for light nodes. No two heavy nodes share their first 64 bits, or the second are compared."""
        i = np.minimum(np.searchsorted(self.p, name[0]), len(self.p) - 1)
        found = (self.p[i] == name[0]) & (self.q[i] == name[1])
        twins = np.flatnonzero((self.p[i] == name[0]) & ~found)
        for k in twins.tolist():
            j = int(i[k])
            while j + 1 < len(self.p) and self.p[j] == name[0][k] and self.q[j] != name[1][k]:
                j += 1
            i[k], found[k] = j, self.p[j] == name[0][k] and self.q[j] == name[1][k]
        return np.where(found, i, -1)

    def cut(self, paths: Paths) -> tuple[np.ndarray, np.ndarray]:
        """How deep each conversation stays in heavy nodes (a beginning has no fewer members than what goes on from it), and the last of them."""
        at = self.at(paths.name)
        depth = np.bincount(paths.owner[at >= 0], minlength=len(paths.n))
        root = self.at(np.zeros((2, 1), dtype=np.uint64))[0]
        last = np.full(len(depth), root)
        deep = np.flatnonzero(depth)
        last[deep] = at[paths.first[deep] + depth[deep] - 1]
        return depth, last


def _sharding(heavy, shards: int):
    names = ["shard", "convs", "depths", "ups", "sizes", "p", "q", "bytes"]

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = Paths(batch)
            depth, last = heavy.value.cut(paths)
            light = np.flatnonzero(depth < paths.n)
            of = (mix64(paths.name[0][paths.first[light] + depth[light]]) % _U(shards)).astype(np.int64)
            order = np.argsort(of, kind="stable")
            light, of = light[order], of[order]
            edges = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)] if len(of) else [0]
            rows = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                some = light[a:b]
                size = paths.n[some] - depth[some]
                flat = np.repeat(paths.first[some] + depth[some] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                columns = paths.conv[some], depth[some], heavy.value.conv[last[some]], size, paths.name[0][flat], paths.name[1][flat], paths.bytes[flat]
                rows.append((int(of[a]), *(planes(c.astype(np.int64).view(np.uint64) if c.dtype != np.uint64 else c) for c in columns)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int32() if i == 0 else pa.binary()) for i in range(8)], names)

    return shard


class Louds:
    """A level-order trie: ``bits`` has, for each node in order, a one for each child and then a zero.

    Node 0 is the top. ``levels`` has the range of nodes of each level.
    """

    def __init__(self, degrees: np.ndarray, levels: list[tuple[int, int]]) -> None:
        self.bits = np.ones(len(degrees) + int(degrees.sum()), dtype=bool)
        self.bits[np.cumsum(degrees + 1) - 1] = False
        self.levels = levels

    def degrees(self) -> np.ndarray:
        """Distances of the zeros: select of each, less that of the one before."""
        return np.diff(np.flatnonzero(~self.bits), prepend=-1) - 1

    def parents(self) -> np.ndarray:
        """Zeros before the one of each node but the top."""
        ones = np.flatnonzero(self.bits)
        return np.concatenate([[-1], ones - np.arange(len(ones))])

    def rolled_up(self, values: np.ndarray) -> np.ndarray:
        """Each node's value with those of its subtree, from the last level to the first."""
        total, parents = values.copy(), self.parents()
        for a, b in reversed(self.levels[1:]):
            np.add.at(total, parents[a:b], total[a:b])
        return total


def _ends(nodes: np.ndarray, convs: np.ndarray, n: int) -> list[str]:
    """The digest of the ids that end at each node."""
    out = [EMPTY] * n
    order = np.lexsort((convs, nodes))
    nodes, convs = nodes[order], convs[order]
    edges = [0, *(np.flatnonzero(np.diff(nodes)) + 1).tolist(), len(nodes)] if len(nodes) else [0]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        out[int(nodes[a])] = hashlib.sha256(",".join(map(str, convs[a:b].tolist())).encode()).hexdigest()
    return out


def trie(convs: np.ndarray, depths: np.ndarray, ups: np.ndarray, sizes: np.ndarray, name: np.ndarray, bytes_: np.ndarray) -> pa.Table:
    """A forest of light subtrees below one top -> a row for each of its nodes; ``root`` marks light roots."""
    first = np.cumsum(sizes) - sizes
    node = np.zeros(len(convs), dtype=np.int64)
    active, level, total = np.arange(len(convs)), 0, 1
    degree = [np.zeros(1, dtype=np.int64)]
    levels, counts, least, last_bytes, deep, parent_conv = [(0, 1)], [np.zeros(1, dtype=np.int64)], [np.zeros(1, dtype=np.int64)], [np.zeros(1, dtype=np.int64)], [np.zeros(1, dtype=np.int64)], [np.zeros(1, dtype=np.int64)]
    while len(active):
        at, parent = first[active] + level, node[active]
        order = np.lexsort((convs[active], name[1][at], name[0][at], parent))
        p, at, parent, members = name[:, at[order]], at[order], parent[order], active[order]
        new = np.concatenate([[True], (p[:, 1:] != p[:, :-1]).any(axis=0) | (parent[1:] != parent[:-1])])
        heads = np.flatnonzero(new)
        a, b = levels[-1]
        degree[-1] += np.bincount(parent[heads] - a, minlength=b - a)
        node[members] = total + np.cumsum(new) - 1
        levels.append((total, total + len(heads)))
        degree.append(np.zeros(len(heads), dtype=np.int64))
        counts.append(np.diff(heads, append=len(order)))
        least.append(convs[members[heads]])
        last_bytes.append(bytes_[at[heads]])
        deep.append(depths[members[heads]] + level + 1)
        parent_conv.append(ups[members[heads]] if level == 0 else least[-2][parent[heads] - a])
        total, level = total + len(heads), level + 1
        active = np.sort(members[sizes[members] > level])
    louds = Louds(np.concatenate(degree), levels)
    counts, least, last_bytes, deep, parent_conv = (np.concatenate(x) for x in (counts, least, last_bytes, deep, parent_conv))
    children = louds.degrees()
    leaves, saved = louds.rolled_up((children == 0).astype(np.int64)), louds.rolled_up(np.maximum(counts - 1, 0) * last_bytes)
    columns = [pa.array(x[1:]) for x in (least, deep, parent_conv, counts, children, leaves, saved)]
    root = np.arange(1, total) < levels[min(1, len(levels) - 1)][1]
    return pa.Table.from_arrays([*columns, pa.array(_ends(node, convs, total)[1:], pa.string()), pa.array(root)], [*_NAMES, "root"])


_NAMES = [c.split()[0] for c in NODE.split(", ")]


def _shard(key: tuple, rows: pa.Table) -> pa.Table:
    convs, depths, ups, sizes, p, q, bytes_ = (np.concatenate([unplanes(x.as_py()) for x in rows.column(c)]) for c in ("convs", "depths", "ups", "sizes", "p", "q", "bytes"))
    signed = [x.view(np.int64) for x in (convs, depths, ups, sizes)]
    return trie(*signed, np.stack([p, q]), bytes_.view(np.int64))


def _ending(heavy):
    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = Paths(batch)
            depth, last = heavy.value.cut(paths)
            here = np.flatnonzero(depth == paths.n)
            order = here[np.lexsort((paths.conv[here], paths.part[here], last[here]))]
            if not len(order):
                continue
            new = (np.diff(last[order]) != 0) | (np.diff(paths.part[order]) != 0)
            rows = np.split(order, np.flatnonzero(new) + 1)
            at = last[[r[0] for r in rows]]
            ids = [packed(paths.conv[r].view(np.uint64)) for r in rows]
            yield pa.RecordBatch.from_arrays([_long(heavy.value.p[at]), _long(heavy.value.q[at]), pa.array([int(paths.conv[r[0]]) for r in rows]), pa.array(ids, pa.binary())], ["p", "q", "first", "ids"])

    return end


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by node and first id -> each node's digest; one row is held at a time."""

    def out(key, digest):
        return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([digest.hexdigest()])], ["p", "q", "ends"])

    now, digest, top = None, None, None
    for batch in batches:
        for row in batch.to_pylist():
            key, ids = (row["p"], row["q"]), unpacked(row["ids"]).view(np.int64)
            if key != now:
                if now is not None:
                    yield out(now, digest)
                now, digest = key, hashlib.sha256()
            elif ids[0] <= top:
                raise RuntimeError("ids of a node are out of order")
            else:
                digest.update(b",")
            digest.update(",".join(map(str, ids.tolist())).encode())
            top = ids[-1]
    if now is not None:
        yield out(now, digest)


def _upper(key: tuple, rows: pa.Table) -> pa.Table:
    """The heavy nodes, with what lies below them in the shards."""
    rows = rows.sort_by([("depth", "ascending")])
    col = {c: rows.column(c).to_numpy() for c in ("p", "q", "up_p", "up_q", "depth", "bytes", "n", "conv", "light", "leaves", "saved")}
    depth = col["depth"]
    order, place, levels, degrees, parents = [], {}, [], np.zeros(len(depth), dtype=np.int64), np.full(len(depth), -1)
    for d in range(int(depth[-1]) + 1):
        a, b = np.searchsorted(depth, [d, d + 1])
        up = np.array([place.get((col["up_p"][i], col["up_q"][i]), -1) if d else -1 for i in range(a, b)], dtype=np.int64)
        mine = np.argsort(up, kind="stable")
        for k, i in enumerate((mine + a).tolist()):
            place[col["p"][i], col["q"][i]] = len(order) + k
        parents[len(order) : len(order) + b - a] = up[mine]
        levels.append((len(order), len(order) + b - a))
        order += (mine + a).tolist()
    np.add.at(degrees, parents[1:], 1)
    louds, order = Louds(degrees, levels), np.array(order)
    col = {c: x[order] for c, x in col.items()}
    children = louds.degrees() + col["light"]
    leaves = louds.rolled_up(col["leaves"] + (children == 0))
    saved = louds.rolled_up(col["saved"] + (col["n"] - 1) * col["bytes"])
    above = louds.parents()
    up = pa.array([None if i < 0 else int(col["conv"][i]) for i in above.tolist()], pa.int64())
    numbers = [pa.array(col["conv"]), pa.array(col["depth"]), up, pa.array(col["n"]), pa.array(children), pa.array(leaves), pa.array(saved)]
    return pa.Table.from_arrays([*numbers, rows.column("ends").take(pa.array(order))], _NAMES)


def prefix_trie(turns: DataFrame, *, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """NODE: a row for each node of the trie of rebuilt conversations; (conv_id, depth) is unique."""
    spark = turns.sparkSession
    whole = rebuilt(turns, conv_col=conv_col, turn_col=turn_col, role_col=role_col, text_col=text_col)
    n_turns = whole.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
    least = max(LEAST_HEAVY, -(-n_turns // UPPER_NODES))
    met = whole.mapInArrow(_counting, "p long, q long, up_p long, up_q long, depth long, bytes long, n long, conv long")
    same = [F.any_value(c).alias(c) for c in ("up_p", "up_q", "depth", "bytes")]
    nodes = met.groupBy("p", "q").agg(*same, F.sum("n").alias("n"), F.min("conv").alias("conv"))
    upper = stored(nodes.where((F.col("n") > least) | (F.col("depth") == 0)), "trie-upper")
    table = upper.select("p", "q", "conv").toArrow()
    if not len(table):
        return spark.createDataFrame([], NODE)
    heavy = spark.sparkContext.broadcast(Heavy(table))

    shards = whole.mapInArrow(_sharding(heavy, max(LEAST_PARTS, -(-n_turns // SHARD_TURNS))), "shard int, convs binary, depths binary, ups binary, sizes binary, p binary, q binary, bytes binary")
    light = stored(shards.groupBy("shard").applyInArrow(_shard, NODE + ", root boolean"), "trie-light")
    below = light.where("root").groupBy(F.col("parent_conv_id").alias("conv"), (F.col("depth") - 1).alias("depth"))
    below = below.agg(F.count("*").alias("light"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    ends = whole.mapInArrow(_ending(heavy), "p long, q long, first long, ids binary").repartition("p", "q").sortWithinPartitions("p", "q", "first")
    ends = ends.mapInArrow(_hashed, "p long, q long, ends string")
    full = upper.join(ends, ["p", "q"], "left").join(below, ["conv", "depth"], "left").na.fill({"light": 0, "leaves": 0, "saved": 0, "ends": EMPTY})
    top = full.groupBy(F.lit(0).alias("one")).applyInArrow(_upper, NODE)
    return light.drop("root").unionByName(top)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read(spark, sf_dir, "conversations"), conv_col="conv_id", turn_col="turn", role_col="role", text_col="text")


#: The CRC of a decimal, bit by bit; each node's subtree from the beginnings of all nodes.
ORACLE = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
    md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS key
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, list({{'key': key, 'bytes': strlen(text)}} ORDER BY turn NULLS FIRST, key) AS own,
    xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0],
        lambda a, i: xor(a >> 1, (a & 1) * 3988292384::UBIGINT))), 4294967295::UBIGINT) % {TURNS} AS h
  FROM turns GROUP BY conv_id
), rebuilt AS (
  SELECT c.conv_id, coalesce(b.own, [])[1:c.h::INT] || c.own[c.h::INT + 1:] AS t
  FROM convs c LEFT JOIN convs b ON b.conv_id = c.conv_id - c.conv_id % {GROUP}
), paths AS (
  SELECT conv_id, d AS depth, len(t) = d AS ends, array_to_string(list_transform(t[1:d], lambda x: x.key), '') AS path,
    CASE WHEN d > 0 THEN t[d].bytes ELSE 0 END AS bytes
  FROM (SELECT conv_id, t, unnest(range(len(t) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM paths GROUP BY path, depth
), children AS (
  SELECT path[:-33] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL
), below AS (
  SELECT path[:32 * d] AS path, sum((n_convs - 1) * bytes) AS saved_tokens, count(*) FILTER (n_children IS NULL) AS n_leaves
  FROM (SELECT n.*, n_children, unnest(range(depth + 1)) AS d FROM nodes n LEFT JOIN children USING (path)) GROUP BY ALL
)
SELECT n.conv_id, n.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0)::BIGINT AS n_children,
  n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN children USING (path) JOIN below USING (path)
LEFT JOIN nodes up ON n.depth > 0 AND up.path = n.path[:-33]"""
