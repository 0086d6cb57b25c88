"""Substring deduplication against brute force."""

import collections
import hashlib
import random

import numpy as np
import pytest

from fieldwork.llm import substring_dedup as S

SCHEMA = "doc_id long, text string, id string, chunk long, kept boolean, size long"


def brute(rows, window):
    """(id, text) rows -> sorted (id, n_words, removed words' places, kept)."""
    least = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - window + 1) if i is not None else ():
            key = tuple(w[k : k + window])
            least[key] = min(i, least.get(key, i))
    out = []
    for i, w in split:
        gone = {k + d for k in range(len(w) - window + 1) if i is not None and least[tuple(w[k : k + window])] < i for d in range(window)}
        out.append((i, len(w), tuple(sorted(gone)), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.id, r.n_words, tuple(k for s in r.removed for k in range(s.first, s.end)), r.kept) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    vocabulary = ["a", "b", "é", "日本", "x.", "Y", " z"]
    passages = [[rng.choice(vocabulary) for _ in range(n)] for n in (6, 9, 40, 200)]
    out = []
    for i in range(300):
        w = []
        for _ in range(rng.randrange(5)):
            w += rng.choice(passages) if rng.random() < 0.6 else [rng.choice(vocabulary) for _ in range(rng.randrange(30))]
        out.append((rng.choice([None, -3, 7, *range(500)]), rng.choice([" ", "\n", " \t "]).join(w)))
    return [*out, *out[:20], (1, None), (None, None), (2, ""), (3, " \n "), (4, "one"), *[(1000 + i, " ".join(passages[3])) for i in range(100)]]


@pytest.mark.parametrize("window", [6, 30])
def test_removed_words_by_brute_force(spark, rows, window, monkeypatch):
    monkeypatch.setattr(S, "CHUNK_DOCS", 37)
    df = spark.createDataFrame([(i, t, "clash", 9, None, None) for i, t in rows], SCHEMA).repartition(3)
    assert found(S.without_repeats(df, id_col="doc_id", text_col="text", window=window)) == brute(rows, window)


def test_empty_table(spark):
    assert S.without_repeats(spark.createDataFrame([], SCHEMA), id_col="doc_id", text_col="text").count() == 0


def test_very_long_texts(spark, monkeypatch):
    """Texts of 12 MB, one a copy of the other's second half."""
    monkeypatch.setattr(S, "PIECE_BYTES", 1 << 18)
    w = [f"{i % 99991:x}-{i % 7}" for i in range(1_500_000)]
    df = spark.createDataFrame([(5, " ".join(w)), (9, "begin " + " ".join(w[700_000:])), (9, "x" * 3_000_000)], "doc_id long, text string")
    got = {(r.id, r.n_words): r for r in S.without_repeats(df, id_col="doc_id", text_col="text").collect()}
    assert got[5, 1_500_000].removed == [] and got[5, 1_500_000].kept == " ".join(w)
    assert [tuple(s) for s in got[9, 800_001].removed] == [(1, 800_001)] and got[9, 800_001].kept == "begin"
    assert got[9, 1].removed == []


def test_pieces_make_up_the_text(monkeypatch):
    monkeypatch.setattr(S, "PIECE_BYTES", 7)
    for text in (b"", b"abc", b"a b c d e f g h i j", b"x" * 50, b"aa bbbbbbbbbbbbbbbbbb\ncc  dd\te", b" " * 30):
        assert b"".join(S.pieces(text)) == text
        assert [w for p in S.pieces(text) for w in p.split()] == text.split()


def test_sketch_never_counts_too_little(monkeypatch):
    """Even with far too few counters."""
    monkeypatch.setattr(S, "WIDTH_BITS", 8)
    rng = np.random.default_rng(1)
    sketches = [(np.unique(rng.integers(0, 2000, 300).astype(np.uint64)), None) for _ in range(20)]
    sketches = [(k, rng.random(len(k)) < 0.1) for k, _ in sketches]
    true = collections.Counter()
    for k, many in sketches:
        true.update(dict(zip(k.tolist(), (1 + many).tolist(), strict=True)))
    keys = np.array(sorted(true), dtype=np.uint64)
    assert (S.estimates(S.merged(sketches), keys) >= [true[k] for k in keys.tolist()]).all()


def test_equal_windows_have_equal_anchors():
    w = np.arange(400, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    both = np.concatenate([w, w[100:300]])
    runs = S._least(S._runs(both, S.ANCHOR, S._R1), S.WINDOW - S.ANCHOR + 1)
    assert (runs[100 : 300 - S.WINDOW + 1] == runs[400 : 600 - S.WINDOW + 1]).all()


def test_query_digests(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, text), (2, "head " + text + " tail"), (3, None)], "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in S.op11_substring_dedup(spark, str(tmp_path)).collect()}
    assert [got[i].n_removed for i in (1, 2, 3)] == [0, 60, 0]
    assert got[2].kept_sha256 == hashlib.sha256(b"head tail").hexdigest() and got[3].kept_sha256 == hashlib.sha256(b"").hexdigest()
