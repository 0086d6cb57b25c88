"""Licence scan by a positional index of rare words.

Templates are word sequences: base phrases, sentences from the notices of public
licences, and segments of whole licence texts, if a folder with them is named. Every
template is indexed by its rarest words: a posting holds the template and the word's
position in it. Rarity is measured on the table itself (document frequency of every
template word over all documents), so the words looked up for a file are those of its
licence words with the highest IDF.

A file's occurrences of indexed words are matched with the postings; an occurrence
at place p of a word at position q starts the template at p - q. A start is verified
word by word there:

* a base phrase needs all its words consecutively, so looking up its one rarest word
  finds every place;
* a notice or segment is scored by the IDF share of its words that stand at their
  relative position, and is accepted at SCORE or more if its mandatory phrases stand
  consecutively inside the aligned stretch. Its indexed words weigh more than 1 - SCORE
  of it, so no start that would be accepted is missed;
* a licence text is found if TEXT_SHARE of its segments are, and its title stands
  somewhere in the file.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased.

Defined results: a null or empty text has no words, no places and no labels, and a
score of 0; repeated rows are scanned one by one; in an empty table all IDFs are
equal; without the folder there are no licence texts. Other columns are neither read
nor changed.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldwork.llm.common import ASCII_LOWER, read

# The base phrases and their labels.
BASE_PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Notices of public licences, each with its label and mandatory phrases.
NOTICES = (
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-3.0", "either version 3 of the license or at your option any later version", ("version 3 of the license", "any later version")),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    ("agpl", "licensed under the gnu affero general public license", ("gnu affero general public license",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ("in compliance with the license", "obtain a copy of the license")),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("cc-by", "licensed under a creative commons attribution", ("creative commons attribution",)),
    ("mit-text", "released under the mit license", ("mit license",)),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)
SCORE = 0.8
#: Words of a segment and of a title, and the share of a text's segments that tells it.
SEGMENT_WORDS, TITLE_WORDS, TEXT_SHARE = 40, 4, 0.5

_NOT_WORD = bytes(x for x in range(128) if not (48 <= x <= 57 or 97 <= x <= 122))
_WORDS = bytes.maketrans(_NOT_WORD, b" " * len(_NOT_WORD))
# lower-case first, then blank what is no word byte
_TABLE = bytes(_WORDS[ASCII_LOWER[b]] for b in range(256))

RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_base", T.LongType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()),
        T.StructField("base_labels", T.StringType()),
        T.StructField("labels", T.StringType()),
        T.StructField("score", T.DoubleType()),
    ]
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    phrases: tuple[tuple[bytes, ...], ...]
    kind: str


def license_texts(folder: str | None) -> list[tuple[str, bytes]]:
    """(label, text) of the files of a folder; links to other files and short files are left out.

    Without a folder there are none; one that is named must be there.
    """
    found = sorted(Path(folder).iterdir()) if folder else []
    texts = [(p.name.lower(), p.read_bytes()) for p in found if p.is_file() and not p.is_symlink()]
    return [(name, text) for name, text in texts if len(words_of(text)) >= SEGMENT_WORDS]


def templates(texts: list[tuple[str, bytes]]) -> list[Template]:
    split = lambda s: tuple(s.encode().split())
    out = [Template(label, split(p), (split(p),), "base") for p, label in BASE_PHRASES]
    out += [Template(label, split(t), tuple(map(split, ps)), "notice") for label, t, ps in NOTICES]
    for label, text in texts:
        w = words_of(text)
        out += [Template(label, tuple(w[i : i + SEGMENT_WORDS]), (), "segment") for i in range(0, len(w) - SEGMENT_WORDS + 1, SEGMENT_WORDS)]
    return out


def document_frequencies(docs: DataFrame, text_col: str, known: list[Template]) -> tuple[int, dict[bytes, int]]:
    """Number of documents, and of those with each template word; over the whole table.

    Each task sends a count for a template word at most, so what arrives is bounded by
    the vocabulary.
    """
    vocabulary = frozenset(w for t in known for w in t.words)

    def count(batches):
        n, df = 0, Counter()
        for batch in batches:
            for x in batch.column(0):
                n += 1
                df.update(vocabulary.intersection(words_of(x.as_py() or b"")))
        yield pa.RecordBatch.from_pydict({"word": [b"", *df], "n": [n, *df.values()]}, schema=pa.schema([("word", pa.binary()), ("n", pa.int64())]))

    rows = docs.select(F.col(text_col).cast("binary").alias("t")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    got = {bytes(r["word"]): r["n"] for r in rows}
    return got.pop(b"", 0), got


class Index:
    """Postings of the templates' rarest words, and the scan of one text."""

    def __init__(self, n_docs: int, df: dict[bytes, int], texts: list[tuple[str, bytes]]):
        self.templates = templates(texts)
        self.idf = {w: math.log(1 + (n_docs + 1) / (df.get(w, 0) + 1)) for t in self.templates for w in t.words}
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        self.weight: list[float] = []
        for no, t in enumerate(self.templates):
            total = math.fsum(self.idf[w] for w in t.words)
            held, anchors = 0.0, set()
            for w in sorted(set(t.words), key=lambda w: (-self.idf[w], w)):
                anchors.add(w)
                held += self.idf[w] * t.words.count(w)
                # a start that stands without any of these is below SCORE
                if t.kind == "base" or held > (1 - SCORE) * total * (1 + 1e-9):
                    break
            for q, w in enumerate(t.words):
                if w in anchors:
                    self.postings.setdefault(w, []).append((no, q))
            self.weight.append(total)
        self.anchors = frozenset(self.postings)
        self.segments = Counter(t.label for t in self.templates if t.kind == "segment")
        self.titles = {label: tuple(words_of(text)[:TITLE_WORDS]) for label, text in texts}

    def share(self, no: int, words: list[bytes], s: int) -> float:
        """IDF share of a template's words that stand where they should for a start."""
        t = self.templates[no].words
        lo, hi = max(s, 0), min(s + len(t), len(words))
        return math.fsum(self.idf[t[p - s]] for p in range(lo, hi) if words[p] == t[p - s]) / self.weight[no]

    def scan(self, text: bytes) -> tuple:
        words = words_of(text)
        n_words = len(words)
        if self.anchors.isdisjoint(words):
            return n_words, 0, None, None, "", "", 0.0
        starts = {(no, p - q) for p, w in enumerate(words) if w in self.anchors for no, q in self.postings[w]}
        places: set[int] = set()
        n_base, base, labels, score = 0, set(), set(), 0.0
        segments: dict[str, set[int]] = {}
        for no, s in starts:
            t = self.templates[no]
            if t.kind == "base":
                if s >= 0 and tuple(words[s : s + len(t.words)]) == t.words:
                    n_base += 1
                    places.add(s)
                    base.add(t.label)
                    score = 1.0
                continue
            share = self.share(no, words, s)
            if share < SCORE:
                continue
            if t.kind == "segment":
                segments.setdefault(t.label, set()).add(no)
            elif all(self._stands(phrase, words, max(s, 0), min(s + len(t.words), n_words)) for phrase in t.phrases):
                labels.add(t.label)
                score = max(score, min(1.0, share))
        for label, found in segments.items():
            share = len(found) / self.segments[label]
            if share >= TEXT_SHARE and self._stands(self.titles[label], words, 0, n_words):
                labels.add(label)
                score = max(score, share)
        labels |= base
        return n_words, n_base, min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score

    @staticmethod
    def _stands(phrase: tuple[bytes, ...], words: list[bytes], lo: int, hi: int) -> bool:
        return any(tuple(words[i : i + len(phrase)]) == phrase for i in range(lo, hi - len(phrase) + 1))


def scanned(text: Column, n_docs: int, df: dict[bytes, int], texts: list[tuple[str, bytes]]) -> Column:
    """A struct RESULT for a text column, by the index over these frequencies."""
    held: list[Index] = []

    @F.arrow_udf(RESULT)
    def scan(rows: pa.Array) -> pa.Array:
        if not held:
            held.append(Index(n_docs, df, texts))
        columns = list(zip(*(held[0].scan(x.as_py() or b"") for x in rows), strict=True)) or [[]] * len(RESULT)
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], RESULT.names)

    return scan(text.cast("binary"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    # whole licence texts are the caller's to name; the result must not hang on what a machine has
    texts = license_texts(None)
    n, df = document_frequencies(docs, "text", templates(texts))
    return docs.select("doc_id", scanned(F.col("text"), n, df, texts).alias("r")).select("doc_id", "r.*")
