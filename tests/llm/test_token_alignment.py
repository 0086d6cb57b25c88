"""Cross-tokenizer alignment against a plain computation on whole texts."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from fieldwork.llm import token_alignment as X

SMALL = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def brute():
    """texts -> rows, from whole texts and sets of offsets."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    chars = dict(zip([*range(33, 127), *range(161, 173), *range(174, 256)], [*range(33, 127), *range(161, 173), *range(174, 256)], strict=True))
    for x in range(256):
        if x not in chars:
            chars[x] = 256 + sum(1 for y in range(x) if not (33 <= y < 127 or 161 <= y < 173 or 174 <= y < 256))
    back = {chr(c): x for x, c in chars.items()}

    def sides(text):
        if not text:
            return None
        ai, bi = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        at = [bytes(back[c] for c in a.id_to_token(i)) for i in ai]
        bt = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in bi]
        if not (b"".join(at) == b"".join(bt) == (" " + text).encode()):
            return None
        ae, be = [sum(map(len, at[: i + 1])) for i in range(len(at))] if len(at) < 3000 else cumulated(at), cumulated(bt)
        groups, n, m = [], 0, 0
        for end in sorted(set(ae) & set(be)):
            p, q = ae.index(end, n) + 1, be.index(end, m) + 1
            groups.append((ai[n:p], bi[m:q]))
            n, m = p, q
        return ai, bi, groups

    def cumulated(tokens):
        out, at = [], 0
        for t in tokens:
            at += len(t)
            out.append(at)
        return out

    def rows(docs):
        all_ = [(i, sides(t)) for i, t in docs]
        links = [collections.Counter((x, y) for xs, ys in s[2] for x in xs for y in ys) if s else {} for _, s in all_]
        counts = collections.Counter(p for l in links for p in l)
        most = {}
        for (x, _), n in counts.items():
            most[x] = max(n, most.get(x, 0))
        out = []
        for (i, s), l in zip(all_, links, strict=True):
            text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in s[2]) if s else ""
            best, total = sum(n for p, n in l.items() if counts[p] == most[p[0]]), sum(n * counts[p] for p, n in l.items())
            out.append((i, *((len(s[0]), len(s[1]), len(s[2])) if s else (0, 0, 0)), sum(l.values()), best, total, hashlib.sha256(text.encode()).hexdigest() if s else ""))
        return sorted(out, key=repr), {i: s[2] if s else [] for i, s in all_}

    return rows


ODD = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a\n\nb", "a \n b", "\ta\t\tb\t", "x\r\ny;\r\nz", "▁", "a ▁b", "a\xa0 b", "a　\n b", "\x1c a\x1c b", "\x0b \x0c x",
    "<|endoftext|> <s></s> <unk> <0x41>", "日本語のテキスト 漢字", "\U0001f600\U0001f468‍\U0001f469 \U0001f600", "é é ﬁ ①", "'s 'll don't I'm", "\x00 \x01", "a" * 5000, "กข ฃ", "    indented\n        more\n", "if (x) {\r\n  y();\r\n}\r\n",
]


def test_odd_texts_by_brute_force(spark, brute):
    rng = random.Random(7)
    pool = list("ab é\n\t\r 　\xa0日\U0001f600'1;)(▁ \x1c\x85 ") + ["the", " the ", "ing", "<s>", "\r\n", "  "]
    texts = ODD + ["".join(rng.choice(pool) for _ in range(rng.randrange(1, 40))) for _ in range(400)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (3, "again"), (3, "again")]
    want, groups = brute(docs)
    df = spark.createDataFrame([(i, t, 1, "clash") for i, t in docs], "doc_id long, text string, chunk long, pairs string").repartition(3)
    got = X.statistics(df, id_col="doc_id", text_col="text", a_path=A, b_path=B).collect()
    assert sorted(map(tuple, got), key=repr) == want
    shown = {r.id: [(g.a, g.b) for g in r.groups] for r in X.aligned(df.where("doc_id > 3"), id_col="doc_id", text_col="text", a_path=A, b_path=B).collect()}
    assert shown == {i: g for i, g in groups.items() if i is not None and i > 3}


def test_small_tables_by_brute_force(spark, brute, monkeypatch):
    monkeypatch.setattr(X, "CHUNK_DOCS", 17)
    t = pq.read_table(f"{SMALL}/documents.parquet").to_pandas()
    want, _ = brute(list(zip(t.doc_id.tolist(), t.text.tolist(), strict=True)))
    got = X.op12_cross_tokenizer(spark, SMALL)
    assert got.columns[0] == "doc_id" and sorted(map(tuple, got.collect()), key=repr) == want


def test_long_texts_are_cut_alike(brute, monkeypatch):
    """Segments and a memo that is cleared change nothing."""
    monkeypatch.setattr(X, "SEGMENT_CHARS", 50)
    monkeypatch.setattr(X, "MEMO_UNITS", 10)
    text = " ".join(f"word{i % 37} été\n\n{'x' * (i % 90)}\t日本" for i in range(300))
    (_, n_a, n_b, n_groups, n_links, _, _, sha), = brute([(1, text)])[0]
    assert X.Aligner(A, B).document(text)[:2] == ([n_a, n_b, n_groups, n_links], sha)


def test_very_long_text(spark):
    text = " ".join(f"w{i % 9973} and" for i in range(1_500_000))
    df = spark.createDataFrame([(1, text), (2, "and so on")], "doc_id long, text string")
    got = {r.id: r for r in X.statistics(df, id_col="doc_id", text_col="text", a_path=A, b_path=B).collect()}
    assert got[1].n_a >= 3_000_000 and got[1].n_links >= got[1].n_groups > 0 and got[2].n_a == 3


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert X.statistics(df, id_col="doc_id", text_col="text", a_path=A, b_path=B).count() == 0


def test_groups_end_where_both_do():
    def sizes(a, b):
        return [x.tolist() for x in X.cut(np.array(a), np.array(b))]

    assert sizes([1, 2, 3], [3, 3]) == [[2, 1], [1, 1]]
    assert sizes([4], [1, 2, 1]) == [[1], [3]]
    assert sizes([2, 2], [1, 2, 1]) == [[2], [3]]


def test_large_groups_are_counted_by_id(brute, monkeypatch):
    texts = [t for t in ODD if t]
    want = [X.Aligner(A, B).document(t) for t in texts]
    monkeypatch.setattr(X, "GROUP_LINKS", 1)
    for one, other in zip(want, X.Aligner(A, B).documents(texts), strict=True):
        assert one[:2] == other[:2] and one[2].tolist() == other[2].tolist() and one[3].tolist() == other[3].tolist()
