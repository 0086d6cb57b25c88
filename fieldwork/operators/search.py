"""Vocabulary, spelling suggestions, TF-IDF search and the ranked search page.

What a search reads is built once and kept: the vocabulary, an inverted table of its
trigrams, and postings with their weights and norms, each sorted by what it is looked
up by. A query's words are few, so they filter these tables in the scan.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldwork.functions import text as X
from fieldwork.sources.store import kept, written

# Words that search leaves out.
STOPWORDS = (
    "the", "a", "an", "of", "to", "in", "on", "for", "and", "or", "is", "are", "was", "were", "your", "you", "this", "that",
    "with", "at", "by", "as", "it", "be", "do", "did", "have", "what", "which", "how", "many", "last", "all",
)

# Groups of words that a query is widened by.
SYNONYMS = (
    ("job", "employment", "employ", "employer", "work", "occupation", "labour", "labor", "career"),
    ("unemployed", "unemployment", "jobless", "jobseeker"),
    ("income", "salary", "wage", "earning", "pay"),
    ("sex", "gender"),
    ("marital", "marriage", "married", "spouse"),
    ("household", "home", "family", "house"),
    ("industry", "sector", "business"),
    ("education", "school", "study", "student"),
    ("hour", "time", "duration"),
)
SYNONYM_WEIGHT = 0.5
BROADCAST_TERMS = 1_000_000


def lexicon(df: DataFrame, text: str, *, least: int = 2) -> DataFrame:
    """term, records: words with the number of records that hold them."""
    return df.select(F.explode(X.words(F.col(text))).alias("term")).groupBy("term").agg(F.count("*").alias("records")).where(F.col("records") >= least)


def vocabulary(df: DataFrame, text: str, *, least: int = 2) -> DataFrame:
    """The kept lexicon of a table."""
    return kept(df.select(text), f"vocabulary-{least}", lambda d: lexicon(d, text, least=least))


def inverted(vocabulary_: DataFrame) -> DataFrame:
    """(gram, term, records, grams): a vocabulary by trigram, with the number of a term's trigrams."""
    t = vocabulary_.withColumn("t", X.trigrams(F.col("term")))
    return t.select(F.explode("t").alias("gram"), "term", "records", F.size("t").alias("grams"))


def grams(df: DataFrame, text: str, *, least: int = 2) -> DataFrame:
    """The kept vocabulary of a table by trigram, sorted by it."""
    sorted_ = lambda d: inverted(vocabulary(d, text, least=least)).repartitionByRange("gram").sortWithinPartitions("gram", "term")
    return kept(df.select(text), f"grams-{least}", sorted_)


def suggest(vocabulary_: DataFrame, word: str, *, least: float = 0.3, limit: int = 5) -> DataFrame:
    """Vocabulary terms like a word, by trigram similarity and frequency; best from the table of ``grams``."""
    inverted_ = vocabulary_ if "gram" in vocabulary_.columns else inverted(vocabulary_)
    w = word.lower()
    padded = f"  {w} "
    mine = sorted({padded[i : i + 3] for i in range(len(w) + 1)})
    # a similarity of ``least`` needs no more trigrams than this
    near = inverted_.where(F.col("gram").isin(mine) & (F.col("grams") <= int(len(mine) / least)) & (F.col("term") != w))
    met = near.groupBy("term", "records", "grams").agg(F.count("*").alias("both"))
    scored = met.withColumn("similarity", F.col("both") / (F.col("grams") + len(mine) - F.col("both"))).where(F.col("similarity") >= least)
    scored = scored.select("term", "records", "similarity", X.suggestion_score(F.col("similarity"), F.col("records")).alias("score"))
    return scored.orderBy(F.col("score").desc(), "term").limit(max(1, min(25, limit)))


def postings(df: DataFrame, key: str, text: str) -> DataFrame:
    """(term, key, weight, idf, norm): a document's terms by (1 + ln tf) ln(1 + N / df), sorted by term."""

    def make(d: DataFrame) -> DataFrame:
        # texts travel by key, so that their terms need not
        docs = d.select(key, text).repartition(key)
        tf = docs.select(key, F.explode(X.search_tokens(F.col(text), STOPWORDS)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
        df_ = tf.groupBy("term").agg(F.count("*").alias("df"))
        total = d.agg(F.count("*").alias("total"))
        idf = written(df_.join(F.broadcast(total)).select("term", F.log(1 + F.col("total") / F.col("df")).alias("idf")), "idf")
        idf = F.broadcast(idf) if idf.count() <= BROADCAST_TERMS else idf
        weighted = tf.join(idf, "term").withColumn("weight", (1 + F.log(F.col("tf").cast("double"))) * F.col("idf"))
        norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy(key)))
        # sorting by ranges reads its rows twice
        found = written(weighted.select("term", key, "weight", "idf", norm.alias("norm")), "weighted")
        return found.repartitionByRange("term").sortWithinPartitions("term", key)

    return kept(df.select(key, text), "postings", make)


def query_weights(text: str, *, synonyms: bool = True) -> dict[str, float]:
    """A query's terms with weights: 1 for its own, SYNONYM_WEIGHT for those of a group.

    A group is looked up by the stemmed word among its members as they are written.
    """
    out: dict[str, float] = {}
    for token in re.findall("[a-z0-9]+", text.lower()):
        if len(token) < 2 or token in STOPWORDS:
            continue
        term = stemmed(token)
        out[term] = 1.0
        for group in SYNONYMS if synonyms else ():
            if term in group:
                for other in group:
                    if other != term:
                        out.setdefault(stemmed(other), SYNONYM_WEIGHT)
    return out


def stemmed(word: str) -> str:
    for suffix, new, least in X.STEM_RULES:
        if word.endswith(suffix) and len(word) >= least:
            return word[: len(word) - len(suffix)] + new
    return word


def tfidf_search(index: DataFrame, *, key: str, query: dict[str, float], limit: int = 20) -> DataFrame:
    """(key, score, matched, terms) by the cosine of ``postings`` with a weighted query."""
    if not query:
        return index.limit(0).select(key, F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("matched"), F.array().cast("array<string>").alias("terms"))
    wanted = F.create_map(*(F.lit(x) for t, w in query.items() for x in (t, float(w))))
    hit = index.where(F.col("term").isin(*query)).withColumn("q", wanted[F.col("term")] * F.col("idf"))
    length = hit.groupBy("term").agg(F.first("q").alias("q")).agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("length"))
    scores = hit.groupBy(key).agg(F.sum(F.col("weight") * F.col("q")).alias("dot"), F.first("norm").alias("norm"), F.count("*").alias("matched"), F.array_sort(F.collect_list("term")).alias("terms"))
    # the query's own length is one row
    ranked = scores.join(F.broadcast(length)).select(key, F.round(F.col("dot") / (F.col("norm") * F.col("length")), 6).alias("score"), "matched", "terms")
    return ranked.orderBy(F.col("score").desc(), key).limit(limit)


def search_or_suggestion(df: DataFrame, *, key: str, text: str, query: str, limit: int = 20) -> DataFrame:
    """Hits with the words that were searched; without any, those of the best suggestion if it has some."""
    index = postings(df, key, text)
    hits = tfidf_search(index, key=key, query=query_weights(query), limit=limit).withColumn("searched", F.lit(query))
    if not hits.isEmpty():
        return hits
    best = suggest(grams(df, text), query.strip(), limit=1).first()
    if best is None:
        return hits
    return tfidf_search(index, key=key, query=query_weights(best["term"]), limit=limit).withColumn("searched", F.lit(best["term"]))


def search_rank(name: Column, body: Column, query: str) -> Column:
    """10 for the exact name, 5 for its beginning, plus 1 if the text holds the query; 0 is no hit."""
    q = query.strip().lower()
    return F.when(F.lower(name) == q, 10).when(F.lower(name).startswith(q), 5).otherwise(0) + F.lower(body).contains(q).cast("int")


def search_page(df: DataFrame, *, name: str, body: str, key: str, query: str, where: Column | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of hits by rank, name and key, with the number of all hits beside it."""
    hits = df.where(where) if where is not None else df
    hits = hits.withColumn("rank", search_rank(F.col(name), F.col(body), query)).where("rank > 0")
    total = hits.agg(F.count("*").alias("total"))
    page = hits.orderBy(F.col("rank").desc(), name, key).offset(max(0, offset)).limit(max(1, min(200, limit)))
    return page.join(F.broadcast(total)).select(key, name, "rank", "total")
