"""Stems, websearch queries and cover-density ranks; ranks against the loop that moves covers along a text."""

import random
import re

import pytest

from fieldwork.functions import stemming as S
from fieldwork.operators import textsearch as T


@pytest.mark.parametrize(
    ("lang", "pairs"),
    [
        ("en", "running run hopping hop hoping hope connections connect relational relat happy happi employment employ unemployed unemploy licenses licens licensed licens caresses caress ties tie national nation agreed agre feed feed bled bled sing sing studies studi abilities abil controlling control saying say"),
        ("fr", "logements log logés log chevaux cheval nationale national nationaux national fumer fum fumé fum activités activ entreprises entrepris ménages ménag parlait parl"),
    ],
)
def test_stems(spark, lang, pairs):
    words = pairs.split()
    pairs = list(zip(words[::2], words[1::2], strict=True))
    df = S.stemmed(spark.createDataFrame([(w, lang) for w, _ in pairs], "word string, lang string"), word="word", lang="lang")
    got = {r.word: r.term for r in df.collect()}
    assert got == {w: S.stem(w, lang) for w, _ in pairs}
    assert got == dict(pairs)


def brute(places, asked):
    """Covers found one after the other: up to where the query holds, then back to the latest start."""
    doc = sorted(places)
    holds = lambda some: any(all(t in {x for _, x in some} for t in g) for g in asked.groups)
    total, start = 0.0, 0
    while True:
        end = next((e for e in range(start, len(doc)) if holds(doc[start : e + 1])), None)
        if end is None:
            return total
        begin = next(b for b in range(end, start - 1, -1) if holds(doc[b : end + 1]))
        total += 0.1 / (1 + (doc[end][0] - doc[begin][0]) - (end - begin))
        start = begin + 1


@pytest.mark.parametrize("query", ["cat", "cat dogs", "cat or dog", "cat dog or bird", "the of", '"cat dog"', 'bird "cat the dog"', "cat -dog", "cat dog -bird or bird"])
def test_ranks_by_moving_covers(spark, query):
    rng = random.Random(len(query))
    texts = [" ".join(rng.choice(["cat", "cats", "dog", "bird", "the", "x1", "filler", "Dog."]) for _ in range(rng.randrange(40))) for _ in range(120)] + [None, "", "cat", "cat the dog", "cat dog"]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "key long, body string, lang string")
    asked = T.wanted(query, "en")
    want = {}
    for i, t in enumerate(texts):
        words = [(k, S.stem(w, "en")) for k, w in enumerate(re.findall(T.WORD, (t or "").lower())) if w not in S.STOPWORDS["en"]]
        at = {t: {k for k, x in words if x == t} for t in asked.terms}
        side = all(any(all(p + o in at[t] for t, o in phrase) for p in at[phrase[0][0]]) for phrase in asked.phrases)
        if asked.groups and side and not any(x in asked.excluded for _, x in words):
            rank = brute([(k, x) for k, x in words if x in asked.terms], asked)
            if rank:
                want[i] = rank
    got = {r.key: r.rank for r in T.ranks(T.text_index(df, key="key", text="body", lang="lang"), asked).collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want)


def test_names_count_and_pages_follow_each_other(spark):
    rows = [(1, "SMK_01", "smoking at home", "en"), (2, "SMK_02", "nothing", "en"), (3, "OTHER", "smk_01 asks who smokes", "en"), (4, "ABC", "fumeurs et fumer", "fr"), (5, None, None, None)]
    df = spark.createDataFrame(rows, "id long, name string, body string, lang string")
    search = lambda q, **k: [(r.id, round(r["rank"], 3), r.total) for r in T.corpus_search(df, key="id", name="name", text="body", lang="lang", query=q, **k).collect()]
    assert search("smk_01") == [(1, 10.0, 2), (3, 0.1, 2)]
    assert search("SMK") == [(1, 5.0, 3), (2, 5.0, 3), (3, 0.1, 3)]
    assert search("SMK", limit=1, offset=1) == [(2, 5.0, 3)]
    assert [x[0] for x in search("smoking")] == [3, 1]  # of one rank, by name
    assert search("fumée") == [(4, 0.1, 1)]
    assert search("") == [] and search("the") == []
    assert [x[0] for x in search("smoking", where=df.id > 1)] == [3]


def test_exclusion_without_broadcasts(spark):
    rows = [(i, f"N{i}", "cat dog" if i % 3 else "cat apache", "en") for i in range(30)]
    df = spark.createDataFrame(rows, "id long, name string, body string, lang string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = [r.id for r in T.corpus_search(df, key="id", name="name", text="body", lang="lang", query="cats -apache or dog").collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(got) == [i for i, *_ in rows if i % 3]
