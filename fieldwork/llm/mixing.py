"""Mixing sources to target weights, with DataFrame functions only.

The words of a source form one stream, packed into blocks of ``block_words``.
Every output slot holds one block, and SHARD_SLOTS slots are an output shard. A shard
draws how many slots each source gets from a multinomial distribution by the sources'
targets: each of its slots draws a keyed number, whose place among the sources' shares
names the source. Over all shards a source's draws differ a little from its target;
what it drew beyond is handed on to the sources that drew too little, so totals are
exact to a slot.

A slot is numbered among its source's slots (shard by shard, then by slot), and that
number, mapped through the source's own pseudorandom permutation of block indices (one
per pass), names its block; blocks are joined by index. A source's words are never used
more than ``ceil(target / size)`` times, 3 at most.

Permutations are swap-or-not shuffles: keyed bijections on 0..n-1 computed from
the index alone, so no sort and no state is needed, and reruns agree.

Positions within a source come from a two-level running sum. Rows equal in id, source
and size are counted first, so no key is hot; then groups by a hash of id and size are
summed within, and the groups' sums are summed again. The numbers of slots come from
the same over shards. Windows without a key run over one row a source.

Defined results: null and empty texts have size 0 and are taken 0 times; a null
source comes last and is a source of its own; repeated rows are mixed one by one
(rows equal in id and size in no stated order among themselves); an empty table
gives an empty result. Other columns are neither read nor changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldwork.llm.common import read, stored

BLOCK_WORDS = 64
SHARD_SLOTS = 1024
WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
#: Rows that one running sum goes over.
GROUP_ROWS = 20_000
ROUNDS = 24


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """Where a keyed bijection on 0..n-1 takes x (swap-or-not shuffle)."""

    def step(at: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(F.lit("turn"), r, *key), n) - at, n)
        swap = F.xxhash64(F.lit("swap"), r, F.greatest(at, partner), *key).bitwiseAND(1) == 1
        return F.when(swap, partner).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x.cast("long"), step)


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Adds ``target`` to (source, size): weights in turn, by code point, null last.

    Targets share the sum of all sizes by weight; none is above 3 times its size, and
    what is cut off goes to the others by weight. In order of cap / weight a source
    is capped if its share, with all before it capped, would exceed its cap.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((place - 1) % len(weights) + 1).cast("int"))
    w = sources.withColumn("weight", weight.cast("double")).withColumn("cap", F.col("size") * float(MOST_REPEATS))
    every = Window.partitionBy(F.lit(1))
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    w = (
        w.withColumn("total", F.sum("size").over(every).cast("double"))
        .withColumn("rest_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("rest", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("capped", F.col("cap") * F.col("rest_weight") < F.col("weight") * F.col("rest"))
    )
    free_weight = F.coalesce(F.sum(F.when(~F.col("capped"), F.col("weight"))).over(every), F.lit(1.0))
    free = F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(every), F.lit(0.0))
    return w.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * free / free_weight)).select("source", "size", "target")


def placed(docs: DataFrame, *, id_col: str, source_col: str, size: Column) -> DataFrame:
    """(id, source, size, start): each document's first word's place in its source's stream."""
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), size.alias("size"))
    sized = stored(sized.groupBy("id", "source", "size").agg(F.count("*").alias("copies")), "mix-sizes")
    groups = max(1, -(-sized.count() // GROUP_ROWS))
    dealt = sized.withColumns({"deal": F.pmod(F.xxhash64("id", "size"), F.lit(groups)), "words": F.col("size") * F.col("copies")})
    inner = Window.partitionBy("source", "deal").orderBy("id", "size").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("source").orderBy("deal").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("source", "deal").agg(F.sum("words").alias("held")).withColumn("base", F.coalesce(F.sum("held").over(outer), F.lit(0)))
    at = dealt.withColumn("within", F.coalesce(F.sum("words").over(inner), F.lit(0))).alias("a")
    s = sums.alias("s")
    both = at.join(s, F.col("a.source").eqNullSafe(F.col("s.source")) & (F.col("a.deal") == F.col("s.deal")))
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("a.copies") - 1)).alias("copy")
    rows = both.select("a.id", "a.source", "a.size", (F.col("s.base") + F.col("a.within")).alias("first"), copy)
    return rows.select("id", "source", "size", (F.col("first") + F.col("copy") * F.col("size")).alias("start"))


def plan(placed_docs: DataFrame, *, block_words: int, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row a source: source, no, source_size, target, blocks, slots, first_slot."""
    sources = placed_docs.groupBy("source").agg(F.sum("size").alias("size"))
    p = source_targets(sources, weights).withColumnRenamed("size", "source_size")
    p = p.withColumn("blocks", F.ceil(F.col("source_size") / block_words).cast("long"))
    even = F.floor(F.col("target") * F.col("blocks") / F.col("source_size") + 0.5).cast("long")
    p = p.withColumn("slots", F.when(F.col("source_size") > 0, F.least(even, F.col("blocks") * MOST_REPEATS)).otherwise(F.lit(0)))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    return p.withColumn("no", F.row_number().over(order)).withColumn("first_slot", F.coalesce(F.sum("slots").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


#: Sources up to which the plan goes to every task; more are joined by a shuffle.
BROADCAST_SOURCES = 10_000
#: Bits of a draw, and of the cells that draws are looked up by; shards summed at once.
DRAW_BITS, CELL_BITS = 53, 16
SUMMED_SHARDS = 4096


def drawn(plan_rows: DataFrame, total: int, *, seed: int, shard_slots: int) -> DataFrame:
    """(shard, slot, no): a source drawn for every slot, so that a shard's counts are multinomial.

    The shares of the sources cut 0..2^DRAW_BITS; cells of equal width name the shares
    that reach into them, so the join is by equality.
    """
    spark = plan_rows.sparkSession
    edge = lambda c: F.floor(c / F.lit(float(total)) * float(1 << DRAW_BITS)).cast("long")
    shares = plan_rows.where("slots > 0").select("no", edge(F.col("first_slot")).alias("low"), edge(F.col("first_slot") + F.col("slots")).alias("high"))
    shift = DRAW_BITS - CELL_BITS
    cells = shares.withColumn("cell", F.explode(F.sequence(F.shiftright("low", shift), F.shiftright(F.col("high") - 1, shift))))
    if len(plan_rows.take(BROADCAST_SOURCES + 1)) <= BROADCAST_SOURCES:
        cells = F.broadcast(cells)
    slots_ = spark.range(total).select(F.floor(F.col("id") / shard_slots).alias("shard"), (F.col("id") % shard_slots).alias("slot"))
    slots_ = slots_.withColumn("draw", F.pmod(F.xxhash64(F.lit("draw"), F.lit(seed), "shard", "slot"), F.lit(1 << DRAW_BITS)))
    hit = slots_.withColumn("cell", F.shiftright("draw", shift)).join(cells, "cell").where("draw >= low AND draw < high")
    return hit.select("shard", "slot", "no")


def slots(plan_rows: DataFrame, *, seed: int, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The mix: (shard, slot, no, block). One row for each output slot."""
    total = plan_rows.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    mine = stored(drawn(plan_rows, total, seed=seed, shard_slots=shard_slots), "mix-draws")
    counts = stored(mine.groupBy("shard", "no").agg(F.count("*").alias("n")).withColumn("group", F.floor(F.col("shard") / SUMMED_SHARDS)), "mix-counts")
    before = lambda *key: Window.partitionBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    outer = counts.groupBy("no", "group").agg(F.sum("n").alias("held")).withColumn("base", F.coalesce(F.sum("held").over(before("no").orderBy("group")), F.lit(0))).select("no", "group", "base")
    inner = counts.withColumn("within", F.coalesce(F.sum("n").over(before("no", "group").orderBy("shard")), F.lit(0)))
    starts = inner.join(outer, ["no", "group"]).select("shard", "no", (F.col("base") + F.col("within")).alias("start"))
    place = F.row_number().over(Window.partitionBy("shard", "no").orderBy("slot")) - 1
    numbered = mine.withColumn("place", place).join(starts, ["shard", "no"]).select("shard", "slot", "no", (F.col("start") + F.col("place")).alias("k"))

    # a source's draws beyond its slots go, in order, to the sources that lack draws
    got = counts.groupBy("no").agg(F.sum("n").alias("got"))
    order = Window.orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    p = plan_rows.join(got, "no", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    p = p.withColumns({"over": F.greatest(F.col("got") - F.col("slots"), F.lit(0)), "lack": F.greatest(F.col("slots") - F.col("got"), F.lit(0))})
    p = stored(p.withColumns({"over_before": F.coalesce(F.sum("over").over(order), F.lit(0)), "lack_before": F.coalesce(F.sum("lack").over(order), F.lit(0))}), "mix-drawn")
    few = len(p.take(BROADCAST_SOURCES + 1)) <= BROADCAST_SOURCES
    side = lambda df: F.broadcast(df) if few else df
    known = numbered.join(side(p.select("no", "slots", "blocks", "over_before")), "no")
    own = known.where("k < slots").select("shard", "slot", "no", "blocks", "k")
    handed = known.where("k >= slots").select("shard", "slot", (F.col("over_before") + F.col("k") - F.col("slots")).alias("e"))
    open_ = p.where("lack > 0").select("no", "blocks", "got", "lack_before", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lack") - 1)).alias("i"))
    taken = handed.join(open_.select("no", "blocks", (F.col("got") + F.col("i")).alias("k"), (F.col("lack_before") + F.col("i")).alias("e")), "e").select("shard", "slot", "no", "blocks", "k")
    every = own.unionByName(taken)
    block = permuted(F.pmod("k", "blocks"), F.col("blocks"), F.lit(seed), F.col("no"), F.floor(F.col("k") / F.col("blocks")))
    return every.select("shard", "slot", "no", block.alias("block"))


def mixed(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", size: Column, block_words: int = BLOCK_WORDS, weights: tuple[int, ...] = WEIGHTS, seed: int = 7) -> dict[str, DataFrame]:
    """``plan`` (a row a source), ``slots`` (a row an output slot), ``taken`` (a row a document).

    ``taken`` counts the words of each document in the blocks that the slots use.
    """
    at = stored(placed(docs, id_col=id_col, source_col=source_col, size=size), "mix-places")
    p = stored(plan(at, block_words=block_words, weights=weights), "mix-plan")
    few = len(p.take(BROADCAST_SOURCES + 1)) <= BROADCAST_SOURCES
    out = slots(p, seed=seed)
    uses = out.groupBy("no", "block").agg(F.count("*").alias("uses"))
    side = p.select(F.col("source").alias("psource"), "no", "source_size", "target")
    known = at.join(F.broadcast(side) if few else side, F.col("source").eqNullSafe(F.col("psource")), "left").drop("psource")
    known = known.withColumn("row", F.struct("id", "source", "size", "start", "source_size", "target"))
    first, last = F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words)
    cut = known.where("size > 0").select("row", "no", F.explode(F.sequence(first, last)).alias("block"))
    begin, end = F.col("block") * block_words, (F.col("block") + 1) * block_words
    share = F.least(end, F.col("row.start") + F.col("row.size")) - F.greatest(begin, F.col("row.start"))
    got = cut.join(uses, ["no", "block"]).groupBy("row").agg(F.sum(share * F.col("uses")).alias("taken"))
    full = got.select("row", "taken").unionByName(known.select("row", F.lit(0).cast("long").alias("taken"))).groupBy("row").agg(F.sum("taken").alias("taken"), F.count("*").alias("__n"))
    # rows equal in all of (id, source, size, start) have size 0 and differ in nothing
    same = full.withColumn("__copies", F.when(F.col("row.size") > 0, F.lit(1)).otherwise(F.col("__n").cast("int")))
    taken = same.select(F.explode(F.array_repeat("row", F.col("__copies").cast("int"))).alias("row"), "taken").select("row.*", "taken")
    return {"plan": p, "slots": out, "taken": taken}


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    taken = mixed(docs, size=word_count(F.col("text")))["taken"]
    return taken.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")

