"""Stemmed text search: positional postings, websearch queries, cover-density ranks.

A text's words are stemmed in the language of its row, and keep the place that they
have among all words; stop words take a place and are not kept. A query reads as in a
search box: words are all wanted, ``or`` parts alternatives, ``-`` excludes a word, and
quotes ask for words side by side. It is stemmed in both languages, and the better
rank counts.

The rank is cover density: a cover is a shortest stretch of a text that has all words
of an alternative. Of n words of the query within a stretch of m places, a cover counts
0.1 / (1 + m - n), and a text the sum over its covers. Phrases restrict which texts are
found; for the rank their words count like others.

Only the postings of a query's words are read. They are ranked within their texts by
window functions over those few places.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldwork.functions import stemming as S
from fieldwork.functions import text as X
from fieldwork.sources.store import kept, written

WORD = "[0-9a-zà-öø-ÿœ]+"
WEIGHT = 0.1
BROADCAST_WORDS = 1_000_000


@dataclass
class Wanted:
    """A query in one language: alternatives of stems, excluded stems, and phrases as (stem, offset)."""

    groups: list[list[str]] = field(default_factory=list)
    excluded: list[str] = field(default_factory=list)
    phrases: list[list[tuple[str, int]]] = field(default_factory=list)

    @property
    def terms(self) -> list[str]:
        return sorted({t for g in self.groups for t in g})


def wanted(query: str, lang: str) -> Wanted:
    """A query's words, stemmed; stop words are left out, and count within phrases as gaps. Phrases hold in all alternatives."""
    out, groups = Wanted(), [[]]
    for quoted, minus, plain in re.findall(r'"([^"]*)"|(-?)([^\s"]+)', query.lower()):
        found = [(S.stem(w, lang), i) for i, w in enumerate(re.findall(WORD, quoted or plain)) if w not in S.STOPWORDS[lang]]
        if quoted:
            groups[-1] += [t for t, _ in found]
            if len(found) > 1:
                out.phrases.append([(t, i - found[0][1]) for t, i in found])
        elif plain == "or" and not minus:
            groups.append([])
        elif minus:
            out.excluded += [t for t, _ in found]
        else:
            groups[-1] += [t for t, _ in found]
    out.groups = [list(dict.fromkeys(g)) for g in groups if g]
    return out


def text_index(df: DataFrame, *, key: str, text: str, lang: str) -> DataFrame:
    """(term, key, places): kept, sorted by term and key; a common term takes many partitions."""

    def make(d: DataFrame) -> DataFrame:
        language = F.when(F.col(lang) == "fr", "fr").otherwise("en")
        # texts travel by key, so that their words need not
        docs = d.select(F.col(key).alias("key"), language.alias("lang"), F.col(text).alias("text")).repartition("key")
        tokens = docs.select("key", "lang", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit(f"({WORD})"), F.lit(1))).alias("place", "word"))
        stop = reduce(lambda a, b: a | b, ((F.col("lang") == k) & F.col("word").isin(v) for k, v in S.STOPWORDS.items()))
        # read twice and sampled, but split into words once
        found = written(tokens.where(~stop).groupBy("key", "lang", "word").agg(F.collect_list("place").alias("places")), "words")
        stems = written(S.stemmed(found.select("lang", "word").distinct(), word="word", lang="lang"), "stems")
        stems = F.broadcast(stems) if stems.count() <= BROADCAST_WORDS else stems
        return found.join(stems, ["lang", "word"]).select("term", "key", "places").repartitionByRange("term", "key").sortWithinPartitions("term", "key")

    return kept(df.select(key, text, lang), "text-index", make)


def _all(columns: list[Column]) -> Column:
    """The least, null if one is."""
    return F.when(reduce(lambda a, b: a & b, (c.isNotNull() for c in columns)), F.least(*columns) if len(columns) > 1 else columns[0])


def ranks(index: DataFrame, asked: Wanted) -> DataFrame:
    """(key, rank) of the texts that a query finds."""
    if not asked.groups:
        return index.limit(0).select("key", F.lit(0.0).alias("rank"))
    hits = index.where(F.col("term").isin(asked.terms)).select("key", "term", F.explode("places").alias("place"))
    for phrase in asked.phrases:
        offsets = F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.lit(i).alias("i")) for t, i in phrase))).alias("o")
        starts = hits.select("key", "term", "place", offsets).where("term = o.t").groupBy("key", (F.col("place") - F.col("o.i")).alias("start")).agg(F.countDistinct("o.i").alias("n"))
        hits = hits.join(starts.where(F.col("n") == len(phrase)).select("key").distinct(), "key", "left_semi")
    if asked.excluded:
        hits = hits.join(index.where(F.col("term").isin(asked.excluded)).select("key").distinct(), "key", "left_anti")
    in_order = Window.partitionBy("key").orderBy("place")
    placed = hits.withColumn("at", F.struct("place", F.row_number().over(in_order).alias("i")))
    so_far = in_order.rowsBetween(Window.unboundedPreceding, 0)
    last = {t: F.max(F.when(F.col("term") == t, F.col("at"))).over(so_far) for t in asked.terms}
    placed = placed.select("key", "at", *(c.alias(f"last_{i}") for i, c in enumerate(last.values())))
    seen = {t: F.col(f"last_{i}") for i, t in enumerate(last)}
    begins = [_all([seen[t] for t in g]) for g in asked.groups]
    begin = F.greatest(*begins) if len(begins) > 1 else begins[0]
    covers = placed.select("key", begin.alias("begin"), F.col("at").alias("end")).where("begin IS NOT NULL").groupBy("key", "begin").agg(F.min("end").alias("end"))
    noise = (F.col("end.place") - F.col("begin.place")) - (F.col("end.i") - F.col("begin.i"))
    return covers.groupBy("key").agg(F.sum(WEIGHT / (1 + noise)).alias("rank"))


def corpus_search(df: DataFrame, *, key: str, name: str, text: str, lang: str, query: str, where: Column | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """(key, name, rank, total): a page of hits by rank, name and key, with the number of all hits.

    An exact name adds 10 to the rank, its beginning 5, and is a hit by itself. ``where``
    is a condition on ``df``'s rows.
    """
    index = text_index(df, key=key, text=text, lang=lang)
    # written, as a union of plans that are dealt out by key, but differ in partitions, can't be run
    both = [written(ranks(index, wanted(query, k)), "ranks") for k in ("en", "fr")]
    found = reduce(DataFrame.unionByName, both).groupBy("key").agg(F.max("rank").alias("__rank"))
    rows = (df if where is None else df.where(where)).select(F.col(key).alias("__key"), F.col(name).alias("__name"))
    mnemonic = X.mnemonic(F.lit(query))
    bonus = F.coalesce(F.when(F.upper("__name") == mnemonic, 10).when(F.upper("__name").startswith(mnemonic), 5), F.lit(0))
    hits = rows.join(found, F.col("__key") == F.col("key"), "left").withColumn("__bonus", bonus).where("__rank IS NOT NULL OR __bonus > 0")
    hits = hits.select(F.col("__key").alias(key), F.col("__name").alias(name), (F.coalesce("__rank", F.lit(0.0)) + F.col("__bonus")).alias("rank"))
    total = hits.agg(F.count("*").alias("total"))
    page = hits.orderBy(F.col("rank").desc(), name, key).offset(max(0, offset)).limit(max(1, min(200, limit)))
    return page.join(F.broadcast(total))
