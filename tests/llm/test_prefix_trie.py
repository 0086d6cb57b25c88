"""The prefix trie of conversations against brute force."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from fieldwork.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string, base long, key string, part int"
NAMES = {"conv_col": "conv_id", "turn_col": "turn", "role_col": "role", "text_col": "text"}


def brute(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [(t[3], t[4]) for t in sorted(ts)] for c, ts in own.items()}
    members = collections.defaultdict(list)
    length = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(math.fmod(c, 5))
        seq = tuple(own.get(base, [])[:h] + own[c][h:])
        length[c] = len(seq)
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    out = []
    for seq, convs in members.items():
        below = [s for s in members if s[: len(seq)] == seq]
        children = [s for s in below if len(s) == len(seq) + 1]
        leaves = [s for s in below if not any(len(o) == len(s) + 1 and o[: len(s)] == s for o in below)]
        saved = sum((len(members[s]) - 1) * len(s[-1][1].encode()) for s in below if s)
        ends = ",".join(map(str, sorted(c for c in convs if length[c] == len(seq))))
        out.append((min(convs), len(seq), min(members[seq[:-1]]) if seq else None, len(convs), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    pool = [(r, t) for r in ("user", "", None) for t in ("hi", "héllo 日本", "", None, "x" * 300)]
    out = []
    for c in [*range(-12, 60), 10**15 + 3]:
        if c % 7 != 3:
            out += [(c, rng.choice([None, 0, 1, 2, 2, 3, 9]), *rng.choice(pool)) for _ in range(rng.randrange(1, 12))]
    for c in range(100, 190):  # one conversation in a third of all
        out += [(c, k, "user", f"turn {k}") for k in range(6)]
    for c in range(200, 230):  # one first turn
        out += [(c, 0, "user", "turn 0"), (c, 1, "user", f"answer {c}")]
    return [*out, *out[:15], (None, 1, "user", "of none"), (None, None, None, None)]


@pytest.mark.parametrize("heavy", [1, 8, 64])
def test_nodes_by_brute_force(spark, rows, heavy, monkeypatch):
    monkeypatch.setattr(P, "LEAST_HEAVY", heavy)
    df = spark.createDataFrame([(*r, 5, "clash", None) for r in rows], SCHEMA).repartition(3)
    assert sorted(map(tuple, P.prefix_trie(df, **NAMES).collect()), key=lambda r: r[:2]) == brute(rows)


def test_deep_conversation(spark, monkeypatch):
    monkeypatch.setattr(P, "LEAST_HEAVY", 1)
    rows = [(c, k, "user", str(k)) for c in (5, 10) for k in range(3000)] + [(15, 0, "user", "0")]
    got = {(r.conv_id, r.depth): r for r in P.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), **NAMES).collect()}
    assert got[5, 0].n_convs == 3 and max(d for _, d in got) == 3000 and all(r.n_leaves >= 1 for r in got.values())


def test_very_long_text(spark):
    rows = [(5, 0, "user", "é" * 10_000_000), (10, 0, "user", "é" * 10_000_000)]
    got = {r.depth: r for r in P.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), **NAMES).collect()}
    assert got[1].n_convs == 2 and got[0].saved_tokens == got[1].saved_tokens == 20_000_000


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert P.prefix_trie(none, **NAMES).count() == 0
    assert P.prefix_trie(spark.createDataFrame([(None, 1, "a", "b", None, None, None)], SCHEMA), **NAMES).count() == 0


def test_louds_gives_degrees_and_parents_back():
    degrees = np.array([3, 0, 2, 1, 0, 0, 0])
    trie = P.Louds(degrees, [(0, 1), (1, 4), (4, 7)])
    assert trie.degrees().tolist() == degrees.tolist() and trie.parents().tolist() == [-1, 0, 0, 0, 2, 2, 3]
    assert trie.rolled_up(np.array([1, 2, 3, 4, 5, 6, 7])).tolist() == [28, 2, 14, 11, 5, 6, 7]
    assert len(trie.bits) == 2 * len(degrees) - 1


def test_names_that_share_their_first_half():
    import pyarrow as pa

    heavy = P.Heavy(pa.table({"p": [5, 5, 0], "q": [9, 7, 0], "conv": [1, 2, 3]}))
    names = np.array([[5, 5, 5, 0, 6], [7, 9, 8, 0, 1]], dtype=np.uint64)
    at = heavy.at(names)
    assert [heavy.conv[i] if i >= 0 else None for i in at] == [2, 1, None, 3, None]
