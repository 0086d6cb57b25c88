"""N-gram Jaccard self-join by rare-first prefix filtering; links and their components.

A text is the set of 52-bit hashes of its word 5-grams. Texts with equal words form a
class, and one row of a class goes on. Sets are sorted by one global order, rare
shingles first, and two sets that reach the threshold share a shingle within their
prefixes of ``n - ceil(t n) + 1``.

The order is by the number of documents that hold a shingle, counted over all texts.
Texts are cut into chunks; a chunk deals its shingles, packed, to parts by hash, and
the number of parts grows with the text. A part counts, and answers each chunk with
those shingles that another document holds too. All others come first in the order and
meet nothing, so a document whose prefix has only such shingles is done with; the rest
go on with their shared shingles alone, which are all that an overlap can have.

Pairs met in a prefix shingle pass the length filter (5 min >= 4 max at 0.8), the
positional filter (what is left after the shingle can still reach the overlap) and the
suffix filter (what follows the shingle is halved by binary search, SUFFIX_DEPTH times,
which bounds the overlap), and are then verified, once a pair.

A large group of near copies meets in many shingles. Its pairs are never rows:

* shingles of at most SMALL members give all their pairs, larger ones the pairs of one
  leader with every member; the verified links give components;
* where a large shingle's other members lie in several components, the largest of them
  there (the hub) is compared with the members outside, in tiles of blocks;
* members that are then left over in several components are compared in tiles too.

A tile holds two blocks of sets, multiplies their membership matrices and emits as many
links as join the components that link in it, so after these three steps no pair of
different components is untried. Links within a component are counted in tiles as well. A component larger than
a block sends its sets there as differences from one of them: with r the number of the
center's shingles a set lacks, an overlap is |center| - r(a) - r(b) plus the number of
differences in common.

Defined results: null and empty texts have no shingles, no links, and are components
of their own; fewer words than five are one shingle; repeated rows are links of each
other; an id that is null is no component's name unless all ids of it are null. An
empty table gives an empty result. Other columns are neither read nor changed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwork.llm.common import ASCII_LOWER, WordHashes, given_back, mix64, packed, read, stored, unpacked
from fieldwork.llm.components import connected

WORDS = 5
#: The threshold as a fraction.
NUM, DEN = 80, 100
#: Bytes and documents of a chunk; text behind a part, and the least number of parts.
CHUNK_BYTES, CHUNK_DOCS = 2 << 20, 1 << 12
PART_BYTES, LEAST_PARTS = 8 << 20, 64
KEY_BITS, OWNER_BITS = 52, 12
SUFFIX_DEPTH = 3
#: Members of a shingle up to which all pairs are made.
SMALL = 8
#: Pairs of one set that are verified in one group, and pairs of a group.
BLOCK, GROUP_PAIRS = 512, 4096
#: Sets on a side of a tile, and shingles multiplied at once.
TILE, COLUMNS = 2048, 4096
#: Rows of a table that may be broadcast.
BROADCAST_ROWS = 1_000_000

_U = np.uint64
_hashes = WordHashes()
_ODD = [_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9), _U(0xD6E8FEB86659FD93), _U(0xFF51AFD7ED558CCD)]
_OWNER = _U((1 << OWNER_BITS) - 1)
_KEY = _U((1 << KEY_BITS) - 1)


def shingled(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, list[int], list[tuple[int, int]]]:
    """Sorted distinct ``key << OWNER_BITS | text's place``, set sizes, and two hashes of the words."""
    lists = [t.translate(ASCII_LOWER).split() for t in texts]
    counts = np.array([len(x) for x in lists], dtype=np.int64)
    names = []
    for x in lists:
        h = xxhash.xxh3_128_intdigest(b" ".join(x))
        names.append((h & (1 << 63) - 1, h >> 65))
    w = _hashes.of([word for x in lists for word in x])
    ends = np.cumsum(counts)
    if len(w) >= words:
        g = np.zeros(len(w) - words + 1, dtype=np.uint64)
        for i in range(words):
            g += w[i : len(w) - words + 1 + i] * _ODD[i % 5] * _U(2 * (i // 5) + 1)
        owner = np.repeat(np.arange(len(texts)), counts)[: len(g)]
        whole = np.arange(len(g)) + words <= ends[owner]
        owner = owner[whole].astype(np.uint64)
        entries = np.unique((owner << _U(KEY_BITS)) | (mix64(g[whole]) >> _U(64 - KEY_BITS)))
    else:
        entries = np.zeros(0, dtype=np.uint64)
    sizes = np.bincount((entries >> _U(KEY_BITS)).astype(np.int64), minlength=len(texts))
    sizes = np.where((counts > 0) & (counts < words), 1, sizes)
    entries = (entries & _KEY) << _U(OWNER_BITS) | entries >> _U(KEY_BITS)
    entries.sort()
    return entries, sizes.tolist(), names


def prefix_length(n: int) -> int:
    return n - -(-n * NUM // DEN) + 1 if n else 0


def needed(na: int, nb: int) -> int:
    """Least overlap of sets of these sizes that reaches the threshold."""
    return -(-NUM * (na + nb) // (NUM + DEN))


def rarity(df: np.ndarray) -> np.ndarray:
    """A byte that rises with the number of documents: exact to 127, then 12 steps to a doubling."""
    return np.where(df < 128, df, np.minimum(255, 44 + np.floor(12 * np.log2(np.maximum(df, 1))))).astype(np.uint64)


def _dealt(parts: int):
    """Documents -> a row for each (part, chunk), and one that tells a chunk's documents."""
    names = ["part", "chunk", "keys", "ids", "heads"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        # the same for every attempt of a task
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            start, texts, held = 0, [], 0
            for i, x in enumerate(batch.column(2)):
                texts.append(x.as_py() or b"")
                held += len(texts[-1])
                if held < CHUNK_BYTES and len(texts) < CHUNK_DOCS and i < len(batch) - 1:
                    continue
                entries, sizes, hashes = shingled(texts)
                part = ((entries >> _U(OWNER_BITS + KEY_BITS - 32)) * _U(parts) >> _U(32)).astype(np.int64)
                edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)] if len(part) else [0]
                keys = [packed(entries[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
                ids = batch.column(0)[start : i + 1]
                heads = np.array([batch.column(1)[start : i + 1].to_pylist(), sizes, *zip(*hashes, strict=True)], dtype="<i8").tobytes()
                n = len(keys)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([((chunk >> 32) + chunk) % parts, *part[edges[:-1]].tolist()], pa.int32()),
                        pa.array([chunk] * (n + 1), pa.int64()),
                        pa.array([None, *keys], pa.binary()),
                        pa.ListArray.from_arrays(pa.array([0, *[len(ids)] * (n + 1)], pa.int32()), ids),
                        pa.array([heads, *[None] * n], pa.binary()),
                    ],
                    names,
                )
                chunk += 1
                start, texts, held = i + 1, [], 0
        batch = x = texts = ids = entries = part = keys = None
        given_back()

    return deal


def _shared(key: tuple, rows: pa.Table) -> pa.Table:
    """A part's shingles -> for each chunk, those that more than one document holds, with their rarity."""
    dealt = rows.filter(pc.is_valid(rows.column("keys")))
    entries = [unpacked(x.as_py()) for x in dealt.column("keys")]
    found, levels = [], []
    if entries:
        keys = np.concatenate(entries) >> _U(OWNER_BITS)
        keys.sort()
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        df = np.diff(first, append=len(keys))
        many = keys[first[df > 1]]
        level = rarity(df[df > 1]).astype(np.uint8)
        for x in entries:
            mine = x >> _U(OWNER_BITS)
            at = np.minimum(np.searchsorted(many, mine), max(0, len(many) - 1))
            hit = many[at] == mine if len(many) else np.zeros(len(mine), dtype=bool)
            found.append(packed(x[hit]))
            levels.append(level[at[hit]].tobytes())
    out = pa.table({"chunk": dealt.column("chunk"), "keys": pa.array(found, pa.binary()), "levels": pa.array(levels, pa.binary())})
    heads = rows.filter(pc.is_valid(rows.column("heads"))).select(["chunk", "ids", "heads"])
    return pa.concat_tables([out.append_column("ids", pa.nulls(len(out), rows.schema.field("ids").type)).append_column("heads", pa.nulls(len(out), pa.binary())), heads.append_column("keys", pa.nulls(len(heads), pa.binary())).append_column("levels", pa.nulls(len(heads), pa.binary())).select(["chunk", "keys", "levels", "ids", "heads"])])


def _gathered(key: tuple, rows: pa.Table) -> pa.Table:
    """A chunk's answers -> its documents, with the shared shingles of those that may link."""
    head = rows.filter(pc.is_valid(rows.column("heads")))
    body, n, cls, check = np.frombuffer(head.column("heads")[0].as_py(), dtype="<i8").reshape(4, -1)
    answers = rows.filter(pc.is_valid(rows.column("keys")))
    entries = np.concatenate([np.zeros(0, dtype=np.uint64), *(unpacked(x.as_py()) for x in answers.column("keys"))])
    levels = np.concatenate([np.zeros(0, dtype=np.uint8), *(np.frombuffer(x.as_py(), dtype=np.uint8) for x in answers.column("levels"))])
    ordered = levels.astype(np.uint64) << _U(KEY_BITS) | entries >> _U(OWNER_BITS)
    owner = (entries & _OWNER).astype(np.uint16)
    order = np.argsort(ordered)
    order = order[np.argsort(owner[order], kind="stable")]
    ordered = ordered[order]
    ends = np.cumsum(np.bincount(owner, minlength=len(n)))
    reach, sets, start = [], [], 0
    for size, end in zip(n.tolist(), ends.tolist(), strict=True):
        k = prefix_length(size) - (size - (end - start))
        reach.append(max(0, k) if end > start else 0)
        sets.append(ordered[start:end].tobytes() if reach[-1] else None)
        start = end
    ids = head.column("ids").combine_chunks().flatten()
    del answers, entries, levels, ordered, owner, order
    given_back()
    return pa.table({"id": ids, "body": body, "n": n, "class": cls, "check": check, "reach": pa.array(reach, pa.int64()), "set": pa.array(sets, pa.binary())})


def document_sets(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, body, n, class, check, reach, set) for every row.

    ``body`` is a hash of the text and tells rows of one id apart; ``set`` holds the
    shared shingles in order, of which the first ``reach`` lie in the prefix.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    parts = max(LEAST_PARTS, -(-size // PART_BYTES))
    kind = dict(docs.dtypes)[id_]
    rows = docs.select(F.col(id_).alias("id"), F.xxhash64(text).alias("body"), F.col(text).alias("t"))
    dealt = rows.mapInArrow(_dealt(parts), f"part int, chunk long, keys binary, ids array<{kind}>, heads binary")
    answers = dealt.groupBy("part").applyInArrow(_shared, f"chunk long, keys binary, levels binary, ids array<{kind}>, heads binary")
    return answers.groupBy("chunk").applyInArrow(_gathered, f"id {kind}, body long, n long, class long, check long, reach long, set binary")


def _tokens(classes: DataFrame) -> DataFrame:
    """(token, class, at): at packs the set size and the token's place, for the filters."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 2000):
                part = batch.slice(i, 2000)
                cls, n, reach = (part.column(k).to_numpy() for k in range(3))
                sets = [np.frombuffer(s.as_py(), dtype=np.int64) for s in part.column(3)]
                unique = n - np.array([len(s) for s in sets], dtype=np.int64)
                place = np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach) + np.repeat(unique, reach)
                tokens = np.concatenate([s[:k] for s, k in zip(sets, reach.tolist(), strict=True)])
                yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(np.repeat(cls, reach)), pa.array((np.repeat(n, reach) << 32) + place)], ["token", "class", "at"])

    return classes.where("reach > 0").select("class", "n", "reach", "set").mapInArrow(spread, "token long, class long, at long")


def _filtered(pairs: DataFrame) -> DataFrame:
    """Distinct (a, b, at_a, at_b) of (token, a, at_a, b, at_b) that pass the length and positional filters."""
    na, nb = F.shiftright("at_a", 32), F.shiftright("at_b", 32)
    pa_, pb = F.col("at_a").bitwiseAND(0xFFFFFFFF), F.col("at_b").bitwiseAND(0xFFFFFFFF)
    least, most = F.least(na, nb), F.greatest(na, nb)
    overlap = F.ceil(F.lit(NUM) * (na + nb) / F.lit(NUM + DEN))
    kept = pairs.where((DEN * least >= NUM * most) & (1 + F.least(na - pa_ - 1, nb - pb - 1) >= overlap))
    turned = F.col("a") > F.col("b")
    one, other = F.struct("a", "at_a", "b", "at_b"), F.struct(F.col("b").alias("a"), F.col("at_b").alias("at_a"), F.col("a").alias("b"), F.col("at_a").alias("at_b"))
    kept = kept.select("token", F.when(turned, other).otherwise(one).alias("p")).select("token", "p.*")
    return kept.groupBy("a", "b").agg(F.min(F.struct("token", "at_a", "at_b")).alias("m")).select("a", "b", "m.at_a", "m.at_b")


def _bound(x: np.ndarray, y: np.ndarray, depth: int) -> int:
    """At most so many elements are common to two sorted sets."""
    if not depth or not len(x) or not len(y):
        return min(len(x), len(y))
    k = len(y) // 2
    i = int(np.searchsorted(x, y[k]))
    hit = int(i < len(x) and x[i] == y[k])
    return _bound(x[:i], y[:k], depth - 1) + hit + _bound(x[i + hit :], y[k + 1 :], depth - 1)


def _overlap(x: np.ndarray, y: np.ndarray) -> int:
    if not len(x) or not len(y):
        return 0
    return int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())


def _set_of(x: pa.Scalar) -> np.ndarray:
    return np.frombuffer(x.as_py(), dtype=np.uint64)


def _verify(key: tuple, asked: pa.Table, rows: pa.Table) -> pa.Table:
    """Those of the pairs asked for that pass the suffix filter and reach the threshold."""
    sets = {c: _set_of(s) for c, s in zip(rows.column("class").to_pylist(), rows.column("set"), strict=True)}
    out = []
    for a, b, at_a, at_b in zip(*(asked.column(c).to_pylist() for c in ("a", "b", "at_a", "at_b")), strict=True):
        x, y = sets[a], sets[b]
        na, nb = at_a >> 32, at_b >> 32
        i, j = (at_a & 0xFFFFFFFF) - na + len(x), (at_b & 0xFFFFFFFF) - nb + len(y)
        least = needed(na, nb)
        if min(i, j) + 1 + _bound(x[i + 1 :], y[j + 1 :], SUFFIX_DEPTH) >= least and _overlap(x, y) >= least:
            out.append((a, b))
    return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})


def _groups(pairs: DataFrame) -> int:
    return max(1, -(-pairs.count() // GROUP_PAIRS))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The links (a, b) among distinct pairs (a, b, at_a, at_b).

    Pairs are dealt to groups by ``a``, those of a frequent ``a`` by blocks of ``b``; a
    set moves once to each group that asks for it.
    """
    groups = _groups(pairs)
    degree = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = pairs.join(degree, "a").withColumn("g", F.pmod(F.xxhash64("a", F.pmod(F.xxhash64("b"), "blocks")), F.lit(groups)))
    dealt = stored(dealt.select("g", "a", "b", "at_a", "at_b"), "jaccard-dealt")
    wanted = dealt.select(F.col("g").alias("h"), F.col("a").alias("class")).unionByName(dealt.select(F.col("g").alias("h"), F.col("b").alias("class"))).distinct()
    held = wanted.join(sets.select("class", "set"), "class")
    return dealt.groupBy("g").cogroup(held.groupBy("h")).applyInArrow(_verify, "a long, b long")


def links_of_tile(left: list[np.ndarray], right: list[np.ndarray], fixed: int, of_left: np.ndarray, of_right: np.ndarray) -> np.ndarray:
    """Which pairs of two blocks of sets link: a boolean matrix.

    ``(NUM + DEN) * common + fixed >= NUM * (n(a) + n(b))``, where ``of_left`` and
    ``of_right`` hold what each set adds to the right side.
    """
    tokens = [np.concatenate(x) if x else np.zeros(0, dtype=np.uint64) for x in (left, right)]
    both = np.intersect1d(*tokens)
    common = np.zeros((len(left), len(right)), dtype=np.float32)
    places = []
    for side, flat in zip((left, right), tokens, strict=True):
        at = np.minimum(np.searchsorted(both, flat), max(0, len(both) - 1))
        hit = both[at] == flat if len(both) else np.zeros(len(flat), dtype=bool)
        row = np.repeat(np.arange(len(side)), [len(s) for s in side])[hit]
        order = np.argsort(at[hit], kind="stable")
        places.append((row[order], at[hit][order]))
    for start in range(0, len(both), COLUMNS):
        width = min(COLUMNS, len(both) - start)
        matrices = []
        for side, (row, at) in zip((left, right), places, strict=True):
            a, b = np.searchsorted(at, [start, start + width])
            m = np.zeros((len(side), width), dtype=np.float32)
            m[row[a:b], at[a:b] - start] = 1
            matrices.append(m)
        common += matrices[0] @ matrices[1].T
    return (NUM + DEN) * common.astype(np.int64) + fixed >= of_left[:, None] + of_right[None, :]


def _sides(rows: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    return NUM * rows.column("n").to_numpy(), [_set_of(s) for s in rows.column("set")]


def _spanning(linked: np.ndarray, of_left: np.ndarray, of_right: np.ndarray) -> list[tuple[int, int]]:
    """Places (left, right) of as many links as join all components that the links join."""
    _, at = np.unique(np.concatenate([of_left, of_right]), return_inverse=True)
    label = np.arange(len(at))
    left, right = at[: len(of_left)], at[len(of_left) :]
    out = []
    for j in np.flatnonzero(linked.any(axis=0)):
        i = np.flatnonzero(linked[:, j])
        own = label[right[j]]
        met, first = np.unique(label[left[i]], return_index=True)
        new = met != own
        if new.any():
            out += [(int(x), int(j)) for x in i[first[new]]]
            label[np.isin(label, met)] = own
    return out


def _tile_links(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """Links between two blocks, as few as join the components that link there."""
    out: list[tuple[int, int]] = []
    a, b = (t.column("class").to_numpy() for t in (left, right))
    if len(left) and len(right):
        (na, x), (nb, y) = _sides(left), _sides(right)
        out = _spanning(links_of_tile(x, y, 0, na, nb), *(t.column("component").to_numpy() for t in (left, right)))
    return pa.table({"a": pa.array([int(a[i]) for i, _ in out], pa.int64()), "b": pa.array([int(b[j]) for _, j in out], pa.int64())})


def _tiled(left: DataFrame, right: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of ``left`` and ``right``, (g, class, component) both, of equal g and other component."""
    cut = lambda side: F.ceil(F.sum(side) / TILE).cast("int").alias(f"b{side}")
    sides = left.select("g", F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select("g", F.lit(0).alias("l"), F.lit(1).alias("r")))
    blocks = sides.groupBy("g").agg(cut("l"), cut("r"))
    held = lambda side: side.join(sets.select("class", "n", "set"), "class").join(blocks, "g")
    block = lambda n: F.pmod(F.xxhash64("class"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["g", "i", "j", "class", "component", "n", "set"]
    x = held(left).withColumns({"i": block("bl"), "j": every("br")}).select(*columns)
    # both sides may be one table: new columns tell them apart
    y = held(right).withColumns({"j": block("br"), "i": every("bl")}).select(*(F.col(c).alias(c) for c in columns))
    return x.groupBy("g", "i", "j").cogroup(y.groupBy("g", "i", "j")).applyInArrow(_tile_links, "a long, b long")


def _count_within(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Classes of one component, and the rows of other classes that each links with."""
    n, sets = _sides(rows)
    linked = links_of_tile(sets, sets, 0, n, n)
    np.fill_diagonal(linked, False)
    return rows.column("class").to_numpy(), linked @ rows.column("class_size").to_numpy()


_COUNT = "class long, others long"


def _count_group(key: tuple, rows: pa.Table) -> pa.Table:
    """Counts for all components of a group, each of one block at most."""
    rows = rows.combine_chunks().sort_by("component")
    edges = np.flatnonzero(np.diff(rows.column("component").to_numpy())) + 1
    counted = [_count_within(rows.slice(a, b - a)) for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(rows)], strict=True)]
    return pa.table({"class": np.concatenate([c for c, _ in counted]), "others": np.concatenate([k for _, k in counted]).astype(np.int64)})


def _count_tile(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """Counts for two blocks of one component, given by differences from its center."""
    same = key[1].as_py() == key[2].as_py()
    classes, others = [], []
    if len(left) and len(right):
        (na, x), (nb, y) = _sides(left), _sides(right)
        lack = [(NUM + DEN) * t.column("lacks").to_numpy() for t in (left, right)]
        center = (NUM + DEN) * left.column("center")[0].as_py()
        linked = links_of_tile(x, y, center, na + lack[0], nb + lack[1])
        if same:
            linked &= left.column("class").to_numpy()[:, None] != right.column("class").to_numpy()[None, :]
        classes.append(left.column("class").to_numpy())
        others.append(linked @ right.column("class_size").to_numpy())
        if not same:
            classes.append(right.column("class").to_numpy())
            others.append(left.column("class_size").to_numpy() @ linked)
    return pa.table({"class": pa.array(np.concatenate(classes) if classes else [], pa.int64()), "others": pa.array(np.concatenate(others).astype(np.int64) if others else [], pa.int64())})


def _differences(key: tuple, rows: pa.Table, heads: pa.Table) -> pa.Table:
    """Sets -> their differences from the center's, and how many of its shingles they lack."""
    center = _set_of(heads.column("center_set")[0])
    sets, lacks = [], []
    for s in rows.column("set"):
        x = _set_of(s)
        sets.append(np.setxor1d(x, center, assume_unique=True).tobytes())
        lacks.append(len(center) - _overlap(x, center))
    return pa.table({"component": rows.column("component"), "class": rows.column("class"), "class_size": rows.column("class_size"), "block": rows.column("block"), "blocks": rows.column("blocks"), "n": rows.column("n"), "center": pa.array([len(center)] * len(rows), pa.int64()), "lacks": pa.array(lacks, pa.int64()), "set": pa.array(sets, pa.binary())})


def links_within(component: DataFrame, classes: DataFrame) -> DataFrame:
    """(class, others): for each class of a component, the rows of other classes that it links with."""
    rows = component.withColumnRenamed("node", "class").join(classes.select("class", "class_size", "n", "set"), "class")
    sizes = stored(component.groupBy("component").agg(F.count("*").alias("k"), F.min("node").alias("first"), F.max("node").alias("last")), "jaccard-sizes")
    # two classes are a component because they link
    two = sizes.where("k = 2").select(F.explode(F.array(F.struct(F.col("first").alias("class"), F.col("last").alias("other")), F.struct(F.col("last").alias("class"), F.col("first").alias("other")))).alias("p")).select("p.*")
    pairs = two.join(classes.select(F.col("class").alias("other"), F.col("class_size").alias("others")), "other").select("class", "others")
    small = sizes.where(f"k > 2 AND k <= {TILE}")
    groups = max(1, -(-(small.agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0]) // TILE))
    few = rows.join(small.select("component"), "component").withColumn("g", F.pmod(F.xxhash64("component"), F.lit(groups)))
    counted = few.select("g", "component", "class", "class_size", "n", "set").groupBy("g").applyInArrow(_count_group, _COUNT)

    large = sizes.where(f"k > {TILE}").select("component", F.col("first").alias("center"), F.ceil(F.col("k") / TILE).cast("int").alias("blocks"))
    many = rows.join(large.select("component", "blocks"), "component").withColumn("block", F.pmod(F.xxhash64("class"), "blocks").cast("int"))
    heads = large.join(classes.select(F.col("class").alias("center"), F.col("set").alias("center_set")), "center").select("component", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "center_set")
    shape = "component long, class long, class_size long, block int, blocks int, n long, center long, lacks long, set binary"
    apart = many.select("component", "block", "blocks", "class", "class_size", "n", "set").groupBy("component", "block").cogroup(heads.groupBy("component", "block")).applyInArrow(_differences, shape)
    apart = stored(apart, "jaccard-differences")
    block, last = F.col("block"), F.col("blocks") - 1
    x = apart.withColumns({"i": block, "j": F.explode(F.sequence(block, last))})
    y = apart.withColumns({"j": block, "i": F.explode(F.sequence(F.lit(0), block))}).select(*(F.col(c).alias(c) for c in x.columns))
    tiled = x.groupBy("component", "i", "j").cogroup(y.groupBy("component", "i", "j")).applyInArrow(_count_tile, _COUNT)
    return pairs.unionByName(counted).unionByName(tiled).groupBy("class").agg(F.sum("others").alias("others"))


def _named(members: DataFrame, component: DataFrame) -> DataFrame:
    """``members`` with their component; what has no link is one of its own."""
    return members.join(component.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))


def _open(members: DataFrame) -> DataFrame:
    """Members (with component) of tokens that still have several components, and the largest one there as ``hub``."""
    per = members.groupBy("token", "component").agg(F.count("*").alias("c")).groupBy("token").agg(F.max(F.struct("c", "component")).alias("m"), F.count("*").alias("parts"))
    return members.join(per.where("parts > 1").select("token", F.col("m.component").alias("hub")), "token")


def _components(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows of ``document_sets``, the classes, and (node, component) of linked classes."""
    rows = stored(document_sets(docs, "__id", "__t"), "jaccard-rows")
    some = rows.where("reach > 0 OR n = 1")
    classes = some.groupBy("class", "check", "n").agg(F.min("id").alias("id"), F.count("*").alias("class_size"), F.first("reach").alias("reach"), F.first("set").alias("set"))
    classes = stored(classes, "jaccard-classes")
    tokens = stored(_tokens(classes), "jaccard-tokens")
    met = tokens.groupBy("token").agg(F.count("*").alias("k")).where("k > 1")
    members = stored(tokens.join(met, "token"), "jaccard-members")
    sets = classes.where("reach > 0").select("class", "n", "set")

    few, many = members.where(f"k <= {SMALL}"), members.where(f"k > {SMALL}").drop("k")
    lead = many.groupBy("token").agg(F.min_by(F.struct("class", "at"), F.xxhash64("class")).alias("l"))
    led = many.join(lead, "token").where("class <> l.class")
    star = led.select("token", F.col("l.class").alias("a"), F.col("l.at").alias("at_a"), F.col("class").alias("b"), F.col("at").alias("at_b"))
    listed = few.groupBy("token").agg(F.collect_list(F.struct("class", "at")).alias("m"))
    x, y = F.col("m")[F.col("i")], F.col("m")[F.col("j")]
    paired = listed.select("token", "m", F.explode(F.sequence(F.lit(0), F.size("m") - 2)).alias("i")).select("token", "m", "i", F.explode(F.sequence(F.col("i") + 1, F.size("m") - 1)).alias("j"))
    paired = paired.select("token", x["class"].alias("a"), x["at"].alias("at_a"), y["class"].alias("b"), y["at"].alias("at_b"))
    pairs = stored(_filtered(star.unionByName(paired)), "jaccard-pairs")
    edges = stored(verified(pairs, sets), "jaccard-links")
    component = stored(connected(edges, "a", "b"), "jaccard-components")

    # the leader of a token has been tried with all others there
    rest = stored(_open(_named(led.select("token", "class"), component)), "jaccard-open")
    if not rest.isEmpty():
        hub = rest.where("component = hub").select(F.col("hub").alias("g"), "class", "component").distinct()
        outside = rest.where("component <> hub").select(F.col("hub").alias("g"), "class", "component").distinct()
        edges = edges.unionByName(stored(_tiled(hub, outside, sets), "jaccard-links"))
        component = stored(connected(edges, "a", "b"), "jaccard-components")
        left = stored(_open(_named(rest.where("component <> hub").select("token", "class"), component)), "jaccard-open")
        if not left.isEmpty():
            here = left.select(F.col("token").alias("g"), "class", "component")
            edges = edges.unionByName(stored(_tiled(here, here, sets), "jaccard-links"))
            component = stored(connected(edges, "a", "b"), "jaccard-components")
    return rows, classes, component


def joined(docs: DataFrame, *, id_col: str, text_col: str, count_links: bool = False) -> DataFrame:
    """(id, body, n_shingles, class, component, component_id) for every row of ``docs``.

    ``component`` is the least class of a component, ``component_id`` its least id. With
    ``count_links`` there is ``n_links`` too: the number of other rows that reach the
    threshold, those of equal words included.
    """
    docs = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("binary").alias("__t"))
    rows, classes, component = _components(docs)
    named = _named(classes.select("class", "id", "class_size"), component)
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    of_class = named.join(least, "component").select("class", "component", "component_id", "class_size")
    if count_links:
        others = links_within(component, classes)
        of_class = of_class.join(others, "class", "left").withColumn("n_links", F.coalesce("others", F.lit(0)) + F.col("class_size") - 1)
    of_class = stored(of_class, "jaccard-classes")
    alone = F.when(F.col("n") > 0, F.col("class"))
    out = rows.select("id", "body", F.col("n").alias("n_shingles"), alone.alias("class")).join(of_class, "class", "left")
    columns = ["id", "body", "n_shingles", "class", F.coalesce("component", "class").alias("component"), F.coalesce("component_id", "id").alias("component_id")]
    return out.select(*columns, *[F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")] * count_links)


def one_of_each(docs: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with one row of every component; rows without shingles all stay.

    The row with the least id stays (of several, the one whose text hashes least). Rows
    to be dropped are taken out by an anti join, broadcast if they are few, so texts are
    not shuffled for it.
    """
    rows = stored(joined(docs, id_col=id_col, text_col=text_col).where("n_shingles > 0"), "jaccard-rows")
    each = rows.groupBy("component", "id", "body").agg(F.count("*").alias("copies"))
    first = each.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "body")).alias("first"))
    marked = each.join(first, "component").select("id", "body", "copies", (F.col("first.id").eqNullSafe(F.col("id")) & (F.col("first.body") == F.col("body"))).alias("stays"))
    marked = stored(marked.where(~F.col("stays") | (F.col("copies") > 1)), "jaccard-marked")
    repeated = marked.where("stays")

    def held(side: DataFrame) -> DataFrame:
        side = side.select("id", "body")
        return F.broadcast(side) if len(side.take(BROADCAST_ROWS + 1)) <= BROADCAST_ROWS else side

    # a row goes along as a whole, so its columns' names can't clash
    whole = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.col(id_col).alias("of"), F.xxhash64(F.col(text_col).cast("binary")).alias("of_body"))
    same = F.col("of").eqNullSafe(F.col("id")) & (F.col("of_body") == F.col("body"))
    out = whole.join(held(marked), same, "left_anti").select("row.*")
    if repeated.isEmpty():
        return out
    more = whole.join(held(repeated), same, "left_semi").dropDuplicates(["of", "of_body"]).select("row.*")
    return out.unionByName(more)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = joined(read(spark, sf_dir, "documents"), id_col="doc_id", text_col="text", count_links=True)
    return done.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "n_links")
