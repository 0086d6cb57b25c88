"""String helpers of the metadata corpus, as column functions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[a-zà-öø-ÿœ][a-zà-öø-ÿœ'-]{2,}"


def normalize_key(c: Column) -> Column:
    """Lower case; runs of anything but a-z and 0-9 become one space; trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def mnemonic(c: Column) -> Column:
    """A trimmed variable name in capitals, else null."""
    t = F.trim(c)
    return F.when(t.rlike("^[A-Za-z][A-Za-z0-9_]{1,31}$"), F.upper(t))


def words(c: Column) -> Column:
    """Distinct words of three letters or more; tokens with digits or underscores are left out."""
    plain = F.regexp_replace(F.lower(c), r"\S*[0-9_]\S*", " ")
    return F.array_distinct(F.regexp_extract_all(plain, F.lit(f"({WORD})"), F.lit(1)))


def trigrams(c: Column) -> Column:
    """Distinct trigrams of a word with two spaces before and one after."""
    padded = F.concat(F.lit("  "), c, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) + 1), lambda i: F.substr(padded, i, F.lit(3))))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def suggestion_score(similarity: Column, records: Column) -> Column:
    return similarity * (1 + F.log(F.greatest(F.lit(1), records).cast("double")))


def years(c: Column) -> Column:
    """Years 1980 to 2026 that no letter or digit touches, in order."""
    return F.regexp_extract_all(c, F.lit(r"(?<![A-Za-z0-9])(19[89]\d|20[01]\d|202[0-6])(?![A-Za-z0-9])"), F.lit(1))


def uuid5(namespace: uuid.UUID, name: Column) -> Column:
    """Name-based UUIDs (version 5) without a Python worker."""
    space = F.unhex(F.lit(namespace.hex))
    digest = F.sha1(F.concat(space, F.encode(name, "UTF-8")))
    variant = F.substr(F.lit("89ab"), F.conv(F.substr(digest, F.lit(17), F.lit(1)), 16, 10).cast("int") % 4 + 1, F.lit(1))
    part = lambda a, n: F.substr(digest, F.lit(a), F.lit(n))
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


# Suffix rules of the light stemmer, longest first: suffix, replacement, least length.
STEM_RULES = (("ies", "y", 5), ("ing", "", 6), ("es", "", 5), ("s", "", 4))


def stem(c: Column) -> Column:
    out = c
    for suffix, new, least in reversed(STEM_RULES):
        out = F.when(c.endswith(suffix) & (F.length(c) >= least), F.concat(F.substr(c, F.lit(1), F.length(c) - len(suffix)), F.lit(new))).otherwise(out)
    return out


def search_tokens(c: Column, stopwords: tuple[str, ...] = ()) -> Column:
    """Stemmed tokens of [a-z0-9] of two characters or more, stop words left out."""
    raw = F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.transform(F.filter(raw, lambda x: (F.length(x) >= 2) & ~x.isin(*stopwords) if stopwords else F.length(x) >= 2), stem)


def version_key(c: Column) -> Column:
    """A dotted version as an array of its parts' leading digits, for comparison; zeros at the end don't count."""
    parts = F.transform(F.split(c, r"\."), lambda x: F.coalesce(F.regexp_extract(x, r"^\s*(\d+)", 1).try_cast("int"), F.lit(0)))
    filled = F.array_max(F.transform(parts, lambda x, i: F.when(x != 0, i + 1).otherwise(0)))
    return F.slice(parts, F.lit(1), filled)


def citation(*parts: Column) -> Column:
    """Parts joined by a middle dot, blank ones left out."""
    return F.concat_ws(" · ", *(F.when(F.trim(p) != "", F.trim(p)) for p in parts))


def chunk_start(page: Column, size: int = 100) -> Column:
    """First page of the chunk that a page is in; pages below 1 count as 1."""
    return F.floor((F.greatest(page, F.lit(1)) - 1) / size) * size + 1
