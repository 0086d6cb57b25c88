"""The corpus operators on awkward rows, and against brute force on small tables."""

import collections
import hashlib
import math
import os
import re
import subprocess
import sys
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from fieldwork.llm import bpe, jaccard_join, language_model, licenses, mixing, neighbours, ordinal, quality_rules, surrogates, token_shards

SMALL = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977} x{i % 31}" for i in range(30_000))
TEXTS = [None, "", "  \n\t ", "a", "one two three four", "Same text here, five words.", "Same text here, five words.", LONG, "é ü ß 日本語 \U0001f600 x", "Licensed under the Apache License, Version 2.0.\nLicensed under CC BY-NC 4.0."]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept boolean, class long, id string, __size long"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, repeated rows, columns with clashing names."""
    rows = [(i, t, None if i == 3 else "en", None if i % 4 == 0 else f"s{i % 2}", None, 7, None, None, None, None) for i, t in enumerate(TEXTS)]
    rows += [rows[5], (None, "no id but words in it", None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def small():
    t = pq.read_table(f"{SMALL}/documents.parquet").to_pandas()
    return dict(zip(t.doc_id.tolist(), t.text.tolist(), strict=True))


def saved(spark, tmp_path_factory, **tables):
    path = str(tmp_path_factory.mktemp("tables"))
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}.parquet")
    return path


def words(text):
    return (text or "").encode().split()


# -- 1


def brute_quality(text):
    w = words(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    times = collections.Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if times[x] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.encode().strip()]
    return len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", text or "")) if w else 0, len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("text", [*TEXTS, "a b c a b c a", "x\nx\nx", "# $\n# $", "a a a a"])
def test_quality_measures(text):
    assert quality_rules.measure(text.encode() if text else None)[:5] == brute_quality(text)


def test_certified_is_clopper_pearson():
    for n, k in ((100, 0), (500, 2), (1000, 20)):
        p = sum(math.comb(n, i) * 0.02**i * 0.98 ** (n - i) for i in range(k + 1))
        assert quality_rules.certified(n, k, 0.02, p * 1.001)
        assert not quality_rules.certified(n, k, 0.02, p * 0.999)
    assert not quality_rules.certified(0, 0, 0.02, 0.5)


def test_quality_on_odd_rows(spark, odd, none, tmp_path_factory):
    labels = spark.createDataFrame([(5, 1, 0), (None, 1, None), (5, None, 1)], "doc_id long, quality int, toxic int")
    for docs, n in ((odd, odd.count()), (none, 0)):
        rows = quality_rules.op1_quality_rules(spark, saved(spark, tmp_path_factory, documents=docs, labels=labels)).collect()
        assert len(rows) == n
        for r in rows:
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
            assert not (r.base_failed and r.kept)


def test_cutoffs_limit_false_rejection(spark):
    """Where good documents shout as often as bad ones, no cutoff is certified."""
    text = "\n".join(" ".join(f"word{i}{j}" for i in range(12)) for j in range(6))
    rows = [(i, text if i % 5 else "*** " * 30 + text, "en" if i < 3000 else "xx") for i in range(3100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("f", quality_rules.features(F.col("text")))
    clean = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(3100)], "doc_id long, quality int")
    noisy = clean.withColumn("quality", F.lit(1))
    got = {r.stratum: r.symbols for r in quality_rules.thresholds(docs, clean, f="f", id_col="doc_id", stratum_col="lang").collect()}
    assert got["en"] is not None and got["xx"] is None
    assert quality_rules.thresholds(docs, noisy, f="f", id_col="doc_id", stratum_col="lang").where("stratum = 'en'").first().symbols >= 1000


def test_all_strata_certify_as_the_sql_does(spark, tmp_path_factory):
    """Strata that certify all, some and no levels: kept equals the SQL's, and the rules reject."""
    import duckdb

    rng = np.random.default_rng(8)
    rows, labels, no = [], [], 0
    for lang, n, noisy in (("aa", 400, 0.0), ("bb", 500, 0.01), ("cc", 400, 0.2), ("dd", 60, 0.0), (None, 300, 0.0)):
        for i in range(n + 80):
            w = [f"{lang or 'ee'}{rng.integers(0, 500)}" for _ in range(80)]
            if i >= n or rng.random() < noisy:
                w[:30] = ["$$$"] * 30
            rows.append((no, "\n".join(" ".join(w[j : j + 8]) for j in range(0, 80, 8)), lang))
            labels.append((no, int(i < n)))
            no += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    rated = spark.createDataFrame(labels, "doc_id long, quality int")
    path = saved(spark, tmp_path_factory, documents=docs, labels=rated)
    got = {r.doc_id: r.kept for r in quality_rules.op1_quality_rules(spark, path).collect()}
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/{t}.parquet/*.parquet')")
    want = dict(con.execute(f"SELECT doc_id, kept FROM ({quality_rules.ORACLE})").fetchall())
    assert got == want
    junk = {i for i, (_, text, lang) in enumerate(rows) if "$$$" in text and lang in ("aa", "bb", None)}
    assert len(junk) > 200 and not any(got[i] for i in junk)
    measured = docs.withColumn("f", quality_rules.features(F.col("text")))
    level = {r.stratum: r.level for r in quality_rules.thresholds(measured, rated, f="f", id_col="doc_id", stratum_col="lang").collect()}
    assert level["aa"] == level[None] == 12 and level["dd"] == 0 and 0 < level["cc"] < 12


# -- 2


def test_surrogates(spark):
    rows = [
        ("Mail A.b@mail7.example.com, then a.B@MAIL7.example.com; call +1 (017) 555-7713 or 1.2.3.4.",),
        ('TOKEN = "24BE64439E3E49CF46B2D7C90F3602A3D0B907FF" and token="24be64439e3e49cf46b2d7c90f3602a3d0b907ff"',),
        ("Card 4111-1111-1111-1111 is 4111 1111 1111 1111, not 10.0.0.7; call +1-017-555-7713.",),
        ("Mr. John Smith met Mrs. Smith; г-жа Анна Иванова",),
        (None,),
        ("",),
        ("clean text, 12 words. On 2020-01-02 v1.2",),
    ]
    df = spark.createDataFrame([(i, *r, "x") for i, r in enumerate([*rows, rows[0]])], "doc_id long, text string, kind string")
    out = {r.doc_id: r for r in surrogates.replaced(df).collect()}
    assert set(df.columns) < set(next(iter(out.values())).asDict())
    a, b = re.findall(r"\S+@\S+?\.com", out[0].text)
    assert a.lower() == b.lower() and "mail7" not in a and a.endswith(".example.com")
    assert "555-7713" not in out[0].text and "1.2.3.4" not in out[0].text
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", out[0].text)[0].translate(str.maketrans("", "", " ()-")) == re.search(r"\+1-\d{3}-\d{3}-\d{4}", out[2].text)[0].replace("-", "")
    x, y = re.findall(r'(?i)token ?= ?"([0-9a-f]{40})"', out[1].text)
    assert x.lower() == y and x == x.upper() and y != "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    p, q = re.findall(r"\d{4}(?:[ -]\d{4}){3}", out[2].text)
    assert p.replace("-", "") == q.replace(" ", "") and p[0] == "4" and "10.0.0.7" not in out[2].text and " 10." in out[2].text
    digits = [int(c) for c in p.replace("-", "")]
    assert sum(d if i % 2 else (2 * d - 9 * (d > 4)) for i, d in enumerate(digits)) % 10 == 0
    family = re.match(r"Mr\. (\w+) (\w+) met Mrs\. (\w+); г-жа (\w+)а (\w+ова)", out[3].text)
    assert family and family[2] == family[3] != "Smith"
    assert (out[4].text, out[5].text, out[6].text) == (None, "", rows[6][0]) and out[6]["__n_entities"] == 0
    assert out[7].text == out[0].text


def test_surrogates_have_no_limits_of_length(spark):
    """Many labels, long names and wide gaps are replaced too, and cost no stack."""
    rows = ["bob@a.b.c.d.e.f.g.h.i.example.com", "x" * 300 + "@mail.example.org", "token    =    abcdefghijkl", "a@" + "b." * 20_000 + "com", "z" * 200_000 + "@" + "q" * 200_000, "no.address@", "end bob@example.com. Next"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r for r in surrogates.replaced(df).collect()}
    assert [got[i]["__n_entities"] for i in range(7)] == [1, 1, 1, 1, 0, 0, 1]
    assert all(got[i].text != rows[i] for i in (0, 1, 2, 3, 6)) and got[4].text == rows[4] and got[6].text.endswith(". Next")
    assert "abcdefghijkl" not in got[2].text and got[2].text.startswith("token    =    ")


def test_surrogates_hang_on_the_key(spark):
    df = spark.createDataFrame([(1, "Mail ann@example.net, call Mr. John R. Smith")], "doc_id long, text string")
    one, same, other = (surrogates.replaced(df, key=k).first().text for k in ("first key", "first key", "it's another"))
    assert one == same != other


def test_surrogates_replace_whole_runs(spark):
    secret = "".join(f"{i:x}Z" for i in range(300))[:700]
    key = "0f1e2d3c4b5a69788796a5b4c3d2e1f0" * 5
    rows = [f'token="{secret}" end', f"key {key} end", "Mrs. Mary Jane Watson went.", "Mr John F. Kennedy spoke.", "Mr. J.R. O'Hara left."]
    out = {r.doc_id: r for r in surrogates.replaced(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    new = re.fullmatch(r'token="(\w{700})" end', out[0].text)[1]
    assert not any(secret[i : i + 12] in new for i in range(0, 700, 4))
    new = re.fullmatch(r"key ([0-9a-f]{160}) end", out[1].text)[1]
    assert not any(key[i : i + 12] in new for i in range(20))
    assert re.fullmatch(r"Mrs\. [A-Z]\w+ [A-Z]\w+ [A-Z]\w+ went\.", out[2].text) and not re.search("Mary|Jane|Watson", out[2].text)
    assert re.fullmatch(r"Mr [A-Z]\w+ [A-Z]\. [A-Z]\w+ spoke\.", out[3].text) and not re.search("John|Kennedy", out[3].text)
    assert re.fullmatch(r"Mr\. [A-Z]\. ?[A-Z]\. [A-Z]\w+ left\.", out[4].text) and "Hara" not in out[4].text
    assert all(r["__n_entities"] == 1 for r in out.values())


def test_surrogates_of_international_phones(spark):
    rows = ["+15557713123", "+33 1 23 45 67 89", "+49 30 1234567", "+1 (017) 555-7713", "+44 (0)20 7946 0958", "about +3.1415926 and +12345 units"]
    out = [r.text for r in surrogates.replaced(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).orderBy("doc_id").collect()]
    for before, after in zip(rows[:5], out, strict=False):
        assert after != before and re.sub(r"\d", "0", after) == re.sub(r"\d", "0", before)
    assert out[5] == rows[5]


def test_surrogates_stay_distinct(spark):
    """Few possible surrogates: collisions are drawn again until all differ."""
    locals_ = list("abcdefghijklm")
    out = [r.surrogate for r in surrogates.assign(spark.createDataFrame([("local", x) for x in locals_], "kind string, canon string")).collect()]
    assert len(out) == len(set(out)) == len(locals_) and not set(out) & set(locals_)
    # all 26 are taken: surrogates become longer
    locals_ = list("abcdefghijklmnopqrstuvwxyz")
    out = [r.surrogate for r in surrogates.assign(spark.createDataFrame([("local", x) for x in locals_], "kind string, canon string"), growing=2).collect()]
    assert len(out) == len(set(out)) == 26 and not set(out) & set(locals_) and all(x.isalpha() and x.islower() for x in out)
    assert surrogates.replaced(spark.createDataFrame([], "text string")).count() == 0


def test_surrogates_keep_parts_apart_and_equal(spark):
    """Brute force over a table: parts map one to one, whatever they stand with."""
    rng = np.random.default_rng(5)
    domains = [f"{c}{i}.org" for c in "abcdefgh" for i in range(10)]
    locals_ = [f"{a}.{b}" for a in "xyz" for b in ("one", "two", "three", "four")]
    given, family = ["Ann", "Bea", "Cid", "Dora", "Eve"], ["Smith", "Jones", "Lee", "Woods", "Hall", "Moore"]
    rows = [f"{rng.choice(locals_)}@{rng.choice(domains)} and Mrs. {rng.choice(given)} {rng.choice(family)} or Mr {rng.choice(family)}" for _ in range(600)]
    out = {r.doc_id: r.text for r in surrogates.replaced(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    form = re.compile(r"(\S+)@(\S+) and Mrs\. (\w+) (\w+) or Mr (\w+)")
    maps = collections.defaultdict(lambda: collections.defaultdict(set))
    for i, t in enumerate(rows):
        for kind, x, y in zip(("local", "domain", "given", "family", "family"), form.fullmatch(t).groups(), form.fullmatch(out[i]).groups(), strict=True):
            maps[kind][x].add(y)
    for kind, m in maps.items():
        assert all(len(v) == 1 for v in m.values()), kind
        new = {y for v in m.values() for y in v}
        assert len(new) == len(m) and not new & set(m), kind


def test_surrogates_of_one_phone_in_many_forms(spark):
    same = [["(555) 123-4567", "+1 (555) 123-4567", "555-123-4567", "+15551234567"], ["+44 (0)20 7946 0958", "+44 20 7946 0958", "+442079460958"], ["+49 30 1234567", "+49301234567"]]
    flat = [x for g in same for x in g]
    out = [r.text for r in surrogates.replaced(spark.createDataFrame(list(enumerate(flat)), "doc_id long, text string")).orderBy("doc_id").collect()]
    ends, at = [], 0
    for g, n in zip(same, (10, 10, 9), strict=True):
        mine = {re.sub(r"\D", "", x)[-n:] for x in out[at : at + len(g)]}
        assert len(mine) == 1 and all(re.sub(r"\d", "0", x) == re.sub(r"\d", "0", y) for x, y in zip(g, out[at:], strict=False))
        ends.append(mine.pop())
        at += len(g)
    assert len(set(ends)) == 3 and not {"5551234567", "2079460958", "301234567"} & set(ends)
    assert out[4].startswith("+44 (0)") and out[1].startswith("+1 ")


def test_surrogates_keep_the_script(spark):
    rows = ["Mr Γιώργος Παπαδόπουλος", "г-н Иван Иванов и г-жа Анна Иванова", "Mr J. Doe and Mr K. Doe"]
    out = [r.text for r in surrogates.replaced(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert re.fullmatch(r"Mr [\u0370-\u03ff]+ [\u0370-\u03ff]+", out[0]) and out[0] != rows[0]
    man, woman = re.fullmatch(r"г-н [А-Яа-я]+ ([А-Я][а-я]+) и г-жа [А-Яа-я]+ ([А-Я][а-я]+)", out[1]).groups()
    assert woman == man + "а" and man != "Иванов"
    j, x, k, y = re.fullmatch(r"Mr ([A-Z])\. (\w+) and Mr ([A-Z])\. (\w+)", out[2]).groups()
    assert x == y != "Doe" and j != k and j != "J"


def test_surrogates_on_odd_rows(spark, odd, none):
    assert surrogates.replaced(none).count() == 0
    long = "filler words " * 20_000
    clash = odd.selectExpr("*", "'x' AS hits", "1 AS row", "2 AS key", "3 AS new", "4 AS n", "5 AS kinds").unionByName(spark.createDataFrame([(99, f"{long} a.b@c.example.com {long}")], "doc_id long, text string"), allowMissingColumns=True)
    got = surrogates.replaced(clash)
    assert got.columns == [*clash.columns, "__n_entities", "__kinds"]
    rows = got.collect()
    assert len(rows) == clash.count()
    found = next(r for r in rows if r.doc_id == 99)
    assert found["__n_entities"] == 1 and len(found.text) > 2 * len(long) and "a.b@c" not in found.text
    assert collections.Counter(r.text for r in rows if r.doc_id != 99) == collections.Counter(r.text for r in odd.select("text").collect())


# -- 3


def brute_license(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hits = [(i, label) for p, label in licenses.BASE_PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in hits]
    return len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def test_license_scan(spark, odd, none, small, tmp_path_factory):
    for docs in (odd, spark.createDataFrame(list(small.items()), "doc_id long, text string"), none):
        texts = [r.text for r in docs.select("text").collect()]
        got = licenses.op3_license_scan(spark, saved(spark, tmp_path_factory, documents=docs)).collect()
        mine = collections.Counter((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got)
        assert mine == collections.Counter(map(brute_license, texts))
        assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)


def test_notice_needs_its_mandatory_phrase():
    index = licenses.Index(10, {}, [])
    assert "apache-2.0" in index.scan(b"Licensed under the Apache License, Version 2.0")[5]
    assert "apache-2.0" not in index.scan(b"Licensed under the Apache License, Version 2.1")[5]


def brute_labels(index, text):
    """Every template at every start, without postings."""
    w = licenses.words_of(text)
    labels, score, segments = set(), 0.0, collections.defaultdict(set)
    for no, t in enumerate(index.templates):
        for s in range(1 - len(t.words), len(w)):
            share = index.share(no, w, s)
            inside = w[max(s, 0) : s + len(t.words)]
            stands = all(any(tuple(inside[i : i + len(p)]) == p for i in range(len(inside))) for p in t.phrases)
            if t.kind == "segment" and share >= licenses.SCORE:
                segments[t.label].add(no)
            elif t.kind == "base" and share == 1 and stands or t.kind == "notice" and share >= licenses.SCORE and stands:
                labels.add(t.label)
                score = max(score, min(1.0, share))
    for label, found in segments.items():
        share, title = len(found) / index.segments[label], index.titles[label]
        if share >= licenses.TEXT_SHARE and any(tuple(w[i : i + len(title)]) == title for i in range(len(w))):
            labels.add(label)
            score = max(score, share)
    return ",".join(sorted(labels)), pytest.approx(score)


def test_licence_labels_by_brute_force(small):
    rng = np.random.default_rng(6)
    texts = [(f"own-{k}", (" ".join(f"title{k} of own licence" if k < 2 else f"l{rng.integers(0, 90)}" for _ in range(1)) + " " + " ".join(f"l{rng.integers(0, 90)}" for _ in range(200))).encode()) for k in range(3)]
    vocabulary = {w for _, t in texts for w in licenses.words_of(t)}
    index = licenses.Index(500, {w: int(rng.integers(0, 400)) for w in vocabulary}, texts)
    docs = [(t or "").encode() for t in list(small.values())[:40]]
    for _, t in texts:
        w = t.decode().split()
        for share in (0.0, 0.1, 0.3, 0.6):
            edited = [x if rng.random() > share else "zz" for x in w]
            docs += [" ".join(edited).encode(), " ".join(["start"] * 3 + edited[: len(w) // 2]).encode(), " ".join(edited[4:]).encode()]
    docs += [" ".join(x if rng.random() > 0.15 else "zz" for x in n[1].split()).encode() for n in licenses.NOTICES for _ in range(3)]
    for d in docs:
        assert index.scan(d)[5:] == brute_labels(index, d)
    assert {"own-0", "own-1"} <= set(",".join(index.scan(t)[5] for _, t in texts).split(","))


def test_licence_texts_of_the_system_are_found():
    folder = "/usr/share/common-licenses"
    if not os.path.isdir(folder):
        pytest.skip("no licence texts on this machine")
    texts = licenses.license_texts(folder)
    index = licenses.Index(100, {}, texts)
    for name, text in texts:
        assert name in index.scan(b"Some preface. " + text.replace(b"\n", b" ") + b" and more")[5].split(",")
    assert licenses.license_texts(None) == []
    with pytest.raises(FileNotFoundError):
        licenses.license_texts("/nowhere")


# -- 4


def shingle_set(text):
    w = [x.translate(jaccard_join.ASCII_LOWER) for x in words(text)]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(texts):
    sets = list(map(shingle_set, texts))
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def near_copies():
    """A chain of edits, a large group of near copies and a passage that many share."""
    base = [f"b{i}" for i in range(120)]
    out = [" ".join(base[:100])]
    for k in range(6):
        edited = base[: 100 + 6 * k]
        edited[10 * k] = f"edit{k}"
        out.append(" ".join(edited))
    rng = np.random.default_rng(1)
    for _ in range(60):
        w = [f"g{i}" for i in range(100)]
        for p in rng.choice(100, rng.integers(1, 5), replace=False):
            w[p] = f"r{rng.integers(1e9)}"
        out.append(" ".join(w))
    passage = " ".join(f"p{i}" for i in range(40))
    out += [f"{' '.join(f'q{k}x{i}' for i in range(40))} {passage}" for k in range(30)]
    return [*out, *out[:3], "Tiny text", "tiny TEXT", "", None]


def test_jaccard_join(spark, small, none, tmp_path_factory):
    for texts in (near_copies(), list(small.values())):
        docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, component_id long")
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.op4_jaccard_join(spark, saved(spark, tmp_path_factory, documents=docs)).collect()}
        assert [got[i] for i in range(len(texts))] == brute_components(texts)
        left = [r.doc_id for r in jaccard_join.one_of_each(docs, id_col="doc_id", text_col="text").collect()]
        assert sorted(left) == sorted({c for _, c in got.values()})
    assert jaccard_join.op4_jaccard_join(spark, saved(spark, tmp_path_factory, documents=none)).count() == 0


def test_jaccard_join_counts_every_link(spark, tmp_path_factory):
    texts = near_copies()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_links for r in jaccard_join.op4_jaccard_join(spark, saved(spark, tmp_path_factory, documents=docs)).collect()}
    sets = list(map(shingle_set, texts))
    want = [sum(i != j and bool(a and b) and 100 * len(a & b) >= 80 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    assert [got[i] for i in range(len(texts))] == want


def test_jaccard_join_on_odd_rows(odd):
    rows = jaccard_join.joined(odd, id_col="doc_id", text_col="text").collect()
    assert len(rows) == odd.count()
    assert {r.component_id for r in rows if r.id in (5, 6)} == {5}
    kept = jaccard_join.one_of_each(odd, id_col="doc_id", text_col="text")
    assert kept.columns == odd.columns and kept.where("doc_id = 5").count() == 1 and kept.where("doc_id = 6").count() == 0
    assert kept.where("text IS NULL").count() == 2


# -- 5


def test_lm_score(spark, small, tmp_path_factory):
    docs = spark.createDataFrame(list(small.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in language_model.op5_lm_score(spark, saved(spark, tmp_path_factory, documents=docs)).collect()}
    tokens = {i: [*(w.translate(language_model.ASCII_LOWER) for w in words(t)), None] for i, t in small.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in small}
    c = collections.Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
    tested = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in tested) > sum(r.base_score for r in tested)


def test_lm_on_odd_rows(odd, none):
    for trains in (True, False):
        rows, n, v = language_model.scored(odd, id_col="doc_id", text_col="text", trains=F.lit(trains))
        got = rows.collect()
        assert len(got) == odd.count()
        texts = [r.text for r in odd.select("text").collect()]
        c = collections.Counter(w for t in texts if trains for w in [*(w.translate(language_model.ASCII_LOWER) for w in words(t)), None])
        assert (n, v) == (sum(c.values()), len(c))
        assert sum(r.n_tokens for r in got) == sum(len(words(t)) + 1 for t in texts)
        assert all(r.n_known == (r.n_tokens if trains else 0) and (trains or r.base_score == 0) for r in got)
    assert language_model.scored(none, id_col="doc_id", text_col="text", trains=F.lit(True))[0].count() == 0


def test_filter_never_lowers_a_count():
    keys = np.random.default_rng(2).integers(0, 2**63, 5000, dtype=np.uint64)
    counts = np.arange(1, 5001)
    found = language_model.LogFrequencyFilter.of(keys, counts).levels(keys)
    assert (found >= language_model.level(counts)).all() and (found == language_model.level(counts)).mean() > 0.9


def test_filter_grows_with_the_levels_counted():
    """The bits follow the levels, so errors are as rare at every size."""
    rng = np.random.default_rng(7)
    new = rng.integers(0, 2**63, 20_000, dtype=np.uint64)
    for n in (100, 10_000, 300_000):
        for most in (1, 2, 1000):
            counts = rng.integers(1, most + 1, n)
            filter_ = language_model.LogFrequencyFilter.of(rng.integers(0, 2**63, n, dtype=np.uint64), counts)
            assert language_model.BITS_PER_LEVEL <= filter_.width / language_model.level(counts).sum() < language_model.BITS_PER_LEVEL + 0.1
            assert (filter_.levels(new) > 0).mean() < 0.01


def test_lm_levels_come_back_in_place(spark):
    """Scores with the dealt filter equal those from exact counts at their levels, but for false positives."""
    texts = [" ".join(f"t{(i * k) % 97}" for k in range(200)) for i in range(1, 60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: r.score for r in language_model.scored(docs, id_col="doc_id", text_col="text", trains=F.lit(True))[0].collect()}
    one, two = collections.Counter(), collections.Counter()
    tokens = [[None, *t.split(), ""] for t in texts]
    for w in tokens:
        one.update(w[1:])
        two.update(zip(w, w[1:], strict=False))
    mid = lambda c: language_model.LEVEL_COUNT[int(language_model.level(np.array([c]))[0])]
    n, v = sum(one.values()), len(one)
    off = []
    for i, w in enumerate(tokens):
        p = [0.6 * min(1, mid(two[a, b]) / mid(one[a or ""])) + 0.4 * min(1, (mid(one[b]) + 1) / (n + v + 1)) for a, b in zip(w, w[1:], strict=False)]
        off.append(abs(got[i] - sum(map(math.log10, p))) / len(p))
    assert np.mean(off) < 0.01


# -- 6


def test_ascii_texts_are_cut_alike():
    import public_tokenizers
    import regex

    assert bpe.PUBLIC_PATTERN == public_tokenizers.PATTERN
    rng = np.random.default_rng(14)
    whole, quick = regex.compile(public_tokenizers.PATTERN).findall, bpe.finder(public_tokenizers.PATTERN)
    for letters in ("".join(map(chr, range(128))), "ab '\n\t s", "'stremvld 1a", " \n\r\x0b\x0c\x1c\x1f.x"):
        for _ in range(300):
            t = "".join(rng.choice(list(letters), rng.integers(0, 40)))
            assert quick(t) == whole(t)


def long_words():
    """Words without a break: each is one piece of thousands of bytes."""
    rng = np.random.default_rng(11)
    draw = lambda letters, n: "".join(rng.choice(list(letters), n))
    alphabets = ("abcdefghijklmnopqrstuvwxyz", "0123456789", "etaoin", "абвгдежз", "日本語中文字", "!#$%&/()=?-_")
    return [*(draw(x, 3000) for x in alphabets), draw(alphabets[0], 200_000), "abc" * 3000, " " * 5000 + "x", "=" * 1000 + "-" * 777, "a" * 3001]


def test_bpe_equals_the_library(spark, odd, none, small, tmp_path_factory):
    import tiktoken

    v = bpe.public_vocabulary()
    ranks = bpe.load_ranks(v["ranks_path"])
    library = tiktoken.Encoding("own", pat_str=v["pattern"], mergeable_ranks=ranks, special_tokens={})
    texts = [*small.values(), *TEXTS, "a" * 3000, "ab" * 2000, "  two", "x \n y\n\nz\n", "don't <|endoftext|> 12345", "a\tb  c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.op6_byte_bpe(spark, saved(spark, tmp_path_factory, documents=docs)).collect()}
    for i, t in enumerate(texts):
        ids = np.array(library.encode_ordinary(t or ""), dtype="<u4")
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    for docs, n in ((odd, odd.count()), (none, 0)):
        assert bpe.op6_byte_bpe(spark, saved(spark, tmp_path_factory, documents=docs)).count() == n


# -- 7


def water_fill(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    capped, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        rest, w = total - sum(capped.values()), sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * rest / w > 3 * sizes[s]]
        if not over:
            return {**capped, **{s: weight[s] * rest / w for s in free}}
        capped |= {s: 3.0 * sizes[s] for s in over}


def test_bpe_of_very_long_texts(spark):
    """Texts of 20 MB, with and without spaces to cut at, beside short ones."""
    import tiktoken

    paths = bpe.public_vocabulary()
    library = tiktoken.Encoding("own", pat_str=paths["pattern"], mergeable_ranks=bpe.load_ranks(paths["ranks_path"]), special_tokens={})
    spaced = " ".join(f"Word{i % 4001} it's  {i % 97}\n" for i in range(900_000))
    tight = "\n".join(f"line{i % 997}" for i in range(500_000))
    texts = [spaced, "short", tight, "", None, "été " * 1_000_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.round_trip(df, "doc_id", text_col="text", **paths).collect()}
    for i, t in enumerate(texts):
        assert bytes(got[i].back) == (t or "").encode()
        assert np.frombuffer(bytes(got[i].ids), dtype="<u4").tolist() == library.encode_ordinary(t or "")


def test_bpe_slices_are_cut_where_the_pattern_does(monkeypatch):
    monkeypatch.setattr(bpe, "SLICE_BYTES", 9)
    codec = bpe.Codec.of(**bpe.public_vocabulary())
    for text in ["a b  c d\ne f 's it's x", "word " * 20, "é à b c d e f g h", "no-cut-here-at-all", " " * 40, "1 2 3 4 5 6 7 8 9 0 a\u00a0b c d e f"]:
        parts = [p.decode() for p in codec.slices(text.encode())]
        assert "".join(parts) == text and [x for p in parts for x in codec.find(p)] == codec.find(text)


def test_mixing(spark, odd, none, small, tmp_path_factory):
    t = pq.read_table(f"{SMALL}/documents.parquet").to_pandas()
    skewed = [(i, x, "a" if i % 20 == 0 else None if i % 3 else "b") for i, x in zip(t.doc_id.tolist(), t.text, strict=True)]
    for docs in (spark.createDataFrame(skewed, "doc_id long, text string, source string"), odd, none):
        path = saved(spark, tmp_path_factory, documents=docs)
        rows = mixing.op7_mixing(spark, path).collect()
        want = docs.select("doc_id", "text", "source").collect()
        assert sorted(str((r.doc_id, r["size"])) for r in rows) == sorted(str((r.doc_id, len(words(r.text)))) for r in want)
        assert sorted(map(str, rows)) == sorted(map(str, mixing.op7_mixing(spark, path).collect()))
        assert all(r.taken <= 3 * r["size"] for r in rows)
        sizes = collections.Counter()
        for r in want:
            sizes[r.source] += len(words(r.text))
        if sizes.total():
            target = water_fill(dict(sizes))
            by_size = {(r.source_size, round(r.target, 6)) for r in rows}
            assert by_size == {(sizes[s], round(target[s], 6)) for s in sizes}
    taken = collections.Counter()
    rows = mixing.op7_mixing(spark, saved(spark, tmp_path_factory, documents=spark.createDataFrame(skewed, "doc_id long, text string, source string"))).collect()
    for r in rows:
        taken[r.target] += r.taken
    assert all(abs(n - t) <= max(0.03 * t, 2 * mixing.BLOCK_WORDS) for t, n in taken.items())


def test_mixing_draws_each_shard(spark):
    """Each shard's counts are a multinomial draw; totals are exact, and blocks are used evenly."""
    plan = spark.createDataFrame([("a", 4000, 8000, 1), ("b", 1000, 3000, 2), (None, 7000, 5384, 3)], "source string, blocks long, slots long, no int")
    plan = plan.withColumn("first_slot", F.when(F.col("no") == 1, 0).when(F.col("no") == 2, 8000).otherwise(11000).cast("long"))
    rows = mixing.slots(plan, seed=3, shard_slots=256).collect()
    assert sorted((r.shard, r.slot) for r in rows) == [(s, k) for s in range(64) for k in range(256)]
    per_shard = collections.Counter((r.shard, r.no) for r in rows)
    p = {1: 8000 / 16384, 2: 3000 / 16384, 3: 5384 / 16384}
    for no, share in p.items():
        n = np.array([per_shard[s, no] for s in range(64)])
        assert n.sum() == {1: 8000, 2: 3000, 3: 5384}[no]
        # the counts vary from shard to shard as draws do, neither fixed nor clustered
        assert 0.5 < n.var() / (256 * share * (1 - share)) < 1.8
    used = {no: collections.Counter(r.block for r in rows if r.no == no) for no in p}
    assert set(used[1].values()) == {2} and len(used[1]) == 4000
    assert set(used[2].values()) == {3} and len(used[2]) == 1000
    assert set(used[3].values()) == {1} and len(used[3]) == 5384 and max(used[3]) < 7000


def test_mixing_taken_by_brute_force(spark):
    """What is taken of each document is what the slots' blocks hold of it; repeated and null ids too."""
    rng = np.random.default_rng(9)
    rows = [(int(i) if i % 5 else None, int(rng.integers(0, 300)), str(rng.choice(["a", "b", "c"], p=[0.6, 0.3, 0.1]))) for i in range(400)] + [(7, 50, "a")] * 40
    docs = spark.createDataFrame(rows, "doc_id long, n long, source string")
    out = mixing.mixed(docs, size=F.col("n"))
    plan = {r.source: r for r in out["plan"].collect()}
    uses = collections.Counter((r.no, r.block) for r in out["slots"].collect())
    taken = out["taken"].collect()
    assert collections.Counter((r.id, r["size"], r.source) for r in taken) == collections.Counter((i, n, s) for i, n, s in rows)
    for source, p in plan.items():
        mine = sorted((r.taken, r["size"]) for r in taken if r.source == source)
        words = min(p.blocks * mixing.BLOCK_WORDS, p.source_size)
        held = sum(n * (min((b + 1) * mixing.BLOCK_WORDS, p.source_size) - b * mixing.BLOCK_WORDS) for (no, b), n in uses.items() if no == p.no)
        assert sum(t for t, _ in mine) == held and words == p.source_size
        assert abs(held - p.target) <= max(0.03 * p.target, 2 * mixing.BLOCK_WORDS)
        assert all(0 <= t <= 3 * n for t, n in mine)


def test_permutation_is_one(spark):
    for n in (1, 2, 7, 100):
        got = [r.x for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(3)).alias("x")).collect()]
        assert sorted(got) == list(range(n))


# -- 8


def test_token_shards(spark, odd, none, small, tmp_path_factory):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.createDataFrame(list(small.items()), "doc_id long, text string")
    rows = sorted(token_shards.op8_token_shards(spark, saved(spark, tmp_path_factory, documents=docs)).collect(), key=lambda r: r.doc_id)
    start = 0
    for r in rows:
        ids = np.array([*t.encode(small[r.doc_id], add_special_tokens=False).ids, 0], dtype="<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(rows) == len(small)
    for docs, n in ((odd, odd.count()), (none, 0)):
        rows = token_shards.op8_token_shards(spark, saved(spark, tmp_path_factory, documents=docs)).collect()
        assert len(rows) == n and sum(r.n_tokens == 1 for r in rows) >= min(n, 2)


@pytest.mark.parametrize("n", [1, 2, 3, 50, 3000])
def test_perfect_hash_is_minimal(n):
    h = token_shards._hashes([(i, 0) for i in range(n)])
    at = token_shards.PerfectHash.slots(h, token_shards.PerfectHash.build(h), n)
    assert sorted(at.tolist()) == list(range(n))


def test_keyed_access(tmp_path):
    w = token_shards.ShardWriter(f"file://{tmp_path}", 2)
    for k, ids in ((None, [1]), (3, [2, 3]), (3, [4]), (9, [])):
        w.add(k, np.array(ids, dtype="<u2").tobytes())
    w.close()
    r = token_shards.ShardReader(w.path)
    assert [r.get(k, n).tolist() for k, n in ((None, 0), (3, 0), (3, 1), (9, 0))] == [[1], [2, 3], [4], []]
    assert r.get(4) is None and r.get(3, 2) is None


def test_library_encoder_equals_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    points = [c for c in range(1, 0x32000) if not 0xD800 <= c < 0xE000]
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "don't  stop\n\n x\t y ", *(t for t in TEXTS if t and t != LONG)]
    texts += ["".join(f"a{chr(c)}b {chr(c)}{chr(c)} 1" for c in points[i : i + 64]) for i in range(0, len(points), 64)]
    for pattern in (public_tokenizers.PATTERN, None):
        encoder = token_shards.LibraryEncoder(path, pattern)
        got = encoder.encode([x.encode() for x in texts])
        off = [x for x, ids in zip(texts, got, strict=True) if np.frombuffer(ids, encoder.kind).tolist() != t.encode(x, add_special_tokens=False).ids]
        assert not off


def test_keys_are_unique_over_shards(spark, tmp_path, monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(token_shards, "SHARD_BYTES", 20_000)
    rows = [(7, f"row {i}") for i in range(4000)] + [(None, f"none {i}") for i in range(3000)] + [(i, f"own {i}") for i in range(8, 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    folder = f"file://{tmp_path}/shards"
    written = token_shards.write_shards(docs, folder, id_col="doc_id", text_col="text", tokenizer_path=public_tokenizers.path("byte_bpe_50k.json"), pattern=public_tokenizers.PATTERN)
    assert len(written.shards) >= 3
    got = token_shards.read_shards(spark, written.shards).collect()
    assert len({(r.doc_id, r.occurrence) for r in got}) == len(got) == len(rows)
    data = token_shards.TokenShards.load(folder)
    for r in got[::37]:
        assert zlib.crc32(data.get(r.doc_id, r.occurrence).astype("<u4").tobytes()) == r.ids_crc32
    assert data.get(7, 4000) is None and data.get(6) is None and data.get(10**9) is None and data.get(None, 2999) is not None


# -- 9


def test_ordinal_classifier(spark, odd, none, tmp_path_factory):
    rng = np.random.default_rng(3)
    plain = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(1500):
        w = list(rng.choice(plain, 60))
        grade = i % 3
        if grade == 0:
            w = [x + "$$" for x in w]
        elif grade == 1:
            w[7] = rng.choice(["vileone", "viletwo", "nasty"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(grade > 0), int(grade == 1)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rated = spark.createDataFrame([*labels[:1000], (1, None, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in ordinal.op9_quality_classifier(spark, saved(spark, tmp_path_factory, documents=docs, labels=rated)).collect()}
    fresh = [got[i] for i in range(1000, 1500)]
    assert np.mean([r.kept for r in fresh if r.doc_id % 3 == 2]) > 0.97
    assert np.mean([r.kept for r in fresh if r.doc_id % 3 < 2]) < 0.1
    means = [np.mean([r.expected_grade for r in fresh if r.doc_id % 3 == g]) for g in range(3)]
    assert means == sorted(means)
    for d, l in ((odd, rated.limit(0)), (none, rated), (odd, rated)):
        assert ordinal.op9_quality_classifier(spark, saved(spark, tmp_path_factory, documents=d, labels=l)).count() == d.count()


def test_grades_by_brute_force(spark, small):
    """Scores are the model's weights summed over a text's features, worked out word by word."""
    import xxhash

    rng = np.random.default_rng(12)
    model = ordinal.OrdinalModel(rng.normal(0, 0.02, ordinal.BUCKETS), np.array([-0.4, 0.9]), 0.31)
    rows = list(small.items())[:60] + [(10_001, None), (10_002, ""), (10_003, LONG)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.r for r in docs.select("doc_id", ordinal.graded(F.col("text"), model).alias("r")).collect()}
    for i, text in rows:
        raw = (text or "").encode().split()
        plain = set(re.sub("[^a-z\u0080-\U0010ffff]+", " ", (text or "").translate({c: c + 32 for c in range(65, 91)})).encode().split())
        features = plain | {w[:k] + b"\n" for w in plain for k in (4, 5, 6, 7, 8) if len(w) > k} | set(ordinal._shape((text or "").encode(), raw, set(raw)))
        f = sum(model.weights[b] for b in {xxhash.xxh64_intdigest(x) % ordinal.BUCKETS for x in features})
        tails = [1 / (1 + math.exp(t - f)) for t in model.thresholds]
        assert got[i].tail == pytest.approx(tails[-1]) and got[i].expected_grade == pytest.approx(sum(tails)) and got[i].kept == (got[i].tail >= 0.31)


def test_cutoff_covers_all_labelled_documents(spark):
    """The cutoff is the quantile of every clean document outside of the fit."""
    rng = np.random.default_rng(13)
    rows = [(i, " ".join(["good" if i % 2 else "bad", *(f"w{x}" for x in rng.integers(0, 60, 20))])) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(900)], "doc_id long, quality int, toxic int")
    model = ordinal.train(docs, labels, id_col="doc_id", text_col="text", fit_rows=200)
    tails = {r.doc_id: r.r.tail for r in docs.select("doc_id", ordinal.graded(F.col("text"), model).alias("r")).collect()}
    order = [r.id for r in ordinal.rated_grades(labels, "doc_id").orderBy("place", "id").collect()]
    fitted = {i for n, i in enumerate(order[:200]) if n % 5 != 4}
    clean = sorted(tails[i] for i in range(1, 900, 2) if i not in fitted)
    assert model.cutoff == min(0.5, clean[math.ceil(ordinal.LOST_CLEAN * len(clean)) - 1])


# -- 10


def test_nearest(spark, tmp_path_factory):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(600, 16)).astype("float32")
    v[10:40] = v[5]
    rows = [(i, [float(x) for x in v[i]], i) for i in range(600)]
    rows += [(600, None, 0), (650, [0.0] * 16, 0), (700, [float("nan")] * 16, 0), (701, [None] * 16, 0), (702, [], 0), (750, [1.0, 2.0], 0), (800, [1.0, 3.0], 0), (None, rows[3][1], 0), (0, rows[0][1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = neighbours.op10_nearest(spark, saved(spark, tmp_path_factory, embeddings=df)).collect()
    d = v.astype("float64")
    for q in range(0, 600, 50):
        score = (d * d[q]).sum(1) / (np.sqrt((d[q] ** 2).sum()) * np.sqrt((d**2).sum(1)))
        cand = [(-s, i) for i, s in enumerate(score) if i != q] + ([(-score[0], 0)] if q else [])
        want = sorted(cand)[:5]
        for repeat in range(2 if q == 0 else 1):
            mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])[repeat :: 2 if q == 0 else 1]
            assert [r.vec_id for r in mine] == [i for _, i in want]
            assert np.allclose([r.score for r in mine], [-s for s, _ in want], atol=1e-12)
    assert {(r.query_id, r.vec_id) for r in got if r.query_id in (750, 800)} == {(750, 800), (800, 750)}
    assert not {600, 650, 700} & {r.query_id for r in got}
    assert neighbours.op10_nearest(spark, saved(spark, tmp_path_factory, embeddings=df.limit(0))).count() == 0


def test_workers_need_no_earlier_arrow_code():
    """A worker that has run nothing else yet: the functions of a group, in a new interpreter."""
    code = """
import pyarrow as pa
from fieldwork.llm import jaccard_join as j
entries, sizes, names = j.shingled([b"a b c d e f g", b"a b c d e f h"])
heads = j.np.array([[1, 2], sizes, *zip(*names, strict=True)], dtype="<i8").tobytes()
rows = pa.table({"chunk": pa.array([0, 0]), "keys": pa.array([None, j.packed(entries)], pa.binary()), "ids": pa.array([[1, 2]] * 2, pa.list_(pa.int64())), "heads": pa.array([heads, None], pa.binary())})
assert j._gathered((0,), j._shared((0,), rows)).num_rows == 2
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), timeout=120)
