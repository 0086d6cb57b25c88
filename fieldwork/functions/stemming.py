"""Suffix stemming of English and French words, as ordered rules.

A stemmer is a list of steps, a step a list of (pattern, replacement): the first
pattern that a word matches rewrites it, none leaves it as it is. The rules follow the
published suffix tables of the Snowball stemmers (English without its list of
exceptions, French with its verb endings in one step). Patterns are plain enough for
every engine: no look-around, no back references, ``\\1`` alone in replacements.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = tuple[str, str]

# Words that are not searched for.
STOPWORDS = {
    "en": "a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing don down during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own s same she should so some such t than that the their theirs them themselves then there these they this those through to too under until up very was we were what when where which while who whom why will with you your yours yourself yourselves".split(),
    "fr": "ai aie aient aies ait as au aura aurai auraient aurais aurait auras aurez auriez aurions aurons auront aux avaient avais avait avec avez aviez avions avons ayant ayez ayons c ce ces d dans de des du elle en es est et eu eue eues eurent eus eusse eussent eusses eussiez eussions eut eux eûmes eût eûtes fus fusse fussent fusses fussiez fussions fut fûmes fût fûtes furent ils il j je l la le leur lui m ma mais me mes moi mon même n ne nos notre nous on ont ou par pas pour qu que qui s sa se sera serai seraient serais serait seras serez seriez serions serons seront ses soient sois soit sommes son sont soyez soyons suis sur t ta te tes toi ton tu un une vos votre vous y à étaient étais était étant étiez étions été étée étées étés êtes".split(),
}

_V, _C = "[aeiouy]", "[^aeiouy]"
_R1 = f"{_C}*{_V}+{_C}"
_R2 = f"{_C}*{_V}+{_C}+{_V}+{_C}"
_FV, _FC = "[aeiouyâàëéêèïîôûù]", "[^aeiouyâàëéêèïîôûù]"
_FR2 = f"{_FC}*{_FV}+{_FC}+{_FV}+{_FC}"
_FR1 = f"{_FC}*{_FV}+{_FC}"
_FRV = f"(?:{_FV}{_FV}.|{_FC}+{_FV}|{_FV}{_FC}+{_FV})"


def _within(region: str, pairs: str) -> list[Rule]:
    """``suffix>replacement`` words, longest first: rewritten within the region, else the word stays."""
    out = []
    for pair in pairs.split():
        suffix, new = pair.split(">")
        out += [(f"^({region}.*){suffix}$", rf"\1{new}"), (f"^(.*{suffix})$", r"\1")]
    return out


#: ``+`` marks a word that has lost its ending, until the second half of the step.
_ENGLISH: list[list[Rule]] = [
    [("^y(.*)$", r"Y\1")],
    [("([aeiou])y", r"\1Y")],
    [(f"^(.*)sses$", r"\1ss"), ("^(..+)ie[sd]$", r"\1i"), ("^(.)ie[sd]$", r"\1ie"), ("^(.*[us]s)$", r"\1"), (f"^(.*{_V}.+)s$", r"\1")],
    [(f"^({_R1}.*)eed(?:ly)?$", r"\1ee"), ("^(.*eed(?:ly)?)$", r"\1"), (f"^(.*{_V}.*)(?:ingly|edly|ing|ed)$", r"\1+")],
    [(r"^(.*(?:at|bl|iz))\+$", r"\1e"), *((rf"^(.*{x}){x}\+$", r"\1") for x in "bdfgmnprt"), (rf"^({_C}*{_V}[^aeiouywxY])\+$", r"\1e"), (r"^(.*)\+$", r"\1")],
    [(f"^(.+{_C})[yY]$", r"\1i")],
    [*_within(_R1, "ational>ate fulness>ful iveness>ive ization>ize ousness>ous biliti>ble lessli>less tional>tion alism>al aliti>al ation>ate entli>ent fulli>ful iviti>ive ousli>ous abli>able alli>al anci>ance ator>ate enci>ence izer>ize bli>ble"), (f"^({_R1}.*l|{_C}*{_V}+l)ogi$", r"\1og"), (f"^({_R1}.*[cdeghkmnrt]|{_C}*{_V}+[cdghkmnrt])li$", r"\1")],
    [(f"^({_R2}.*)ative$", r"\1"), *_within(_R1, "ational>ate tional>tion alize>al icate>ic iciti>ic ical>ic ness> ful>")],
    [*_within(_R2, "ement> ance> ence> able> ible> ment> ant> ent> ism> ate> iti> ous> ive> ize>"), (f"^({_R2}.*[st]|{_C}*{_V}+{_C}+{_V}+[st])ion$", r"\1"), *_within(_R2, "al> er> ic>")],
    [(f"^({_R2}.*)e$", r"\1"), (f"^(.*{_C}{_V}[^aeiouywxY]e)$", r"\1"), (f"^({_V}{_C}e)$", r"\1"), (f"^({_R1}.*)e$", r"\1"), (f"^({_R2}.*l|{_C}*{_V}+{_C}+{_V}+l)l$", r"\1")],
    [("Y", "y")],
]
_FRENCH: list[list[Rule]] = [
    [
        (f"^({_FR2}.*)(?:atrices?|ateurs?|ations?|ances?|iques?|ismes?|ables?|istes?)$", r"\1"), (f"^({_FR2}.*)logies?$", r"\1log"), (f"^({_FR2}.*)(?:usions?|utions?)$", r"\1u"), (f"^({_FR2}.*)ences?$", r"\1ent"),
        (f"^({_FR1}.*{_FC})issements?$", r"\1"), (f"^({_FRV}.*)amment$", r"\1ant"), (f"^({_FRV}.*)emment$", r"\1ent"), (f"^({_FRV}.*)ements?$", r"\1"), (f"^({_FRV}.*{_FV})ments?$", r"\1"),
        (f"^({_FR2}.*)ités?$", r"\1"), (f"^({_FR2}.*)(?:ives?|ifs?)$", r"\1"), ("^(.*eau)x$", r"\1"), (f"^({_FR1}.*)aux$", r"\1al"), (f"^({_FR2}.*)(?:euses?|eux)$", r"\1"), (f"^({_FR1}.*)euses?$", r"\1eux"),
    ],
    [
        (f"^({_FRV}.*{_FC})(?:issaient|issais|issait|issantes?|issants?|issent|issez|issiez|issions|issons|isses?|iraient|irais|irait|irent|iriez|irions|irons|iront|irez|irai|iras|ira|ir|îmes|îtes|ît|ies|ie|is|it|i)$", r"\1"),
        (f"^({_FRV}.*)(?:eraient|erais|erait|erions|èrent|eriez|erons|eront|erez|erai|eras|era|ées|ée|és|iez|ez|er|é)$", r"\1"), (f"^({_FR2}.*)ions$", r"\1"),
        (f"^({_FRV}.*)(?:assions|assent|assiez|aient|antes?|ants?|asses?|âmes|âtes|ais|ait|ât|as|ai|a)$", r"\1"),
    ],
    [(f"^(.*[^aiouès])s$", r"\1")],
    [(f"^({_FR2}.*[st])ion$", r"\1"), (f"^({_FRV}.*)(?:ière|Ière|ier)$", r"\1i"), (f"^({_FRV}.*)e$", r"\1")],
    [("^(.*en)n$", r"\1"), ("^(.*on)n$", r"\1"), ("^(.*et)t$", r"\1"), ("^(.*el)l$", r"\1"), ("^(.*eil)l$", r"\1")],
    [(f"^(.*)[éè]({_FC}+)$", r"\1e\2")],
]
STEMMERS = {"en": _ENGLISH, "fr": _FRENCH}


def stem(word: str, lang: str) -> str:
    """One word, for a query's few."""
    for step in STEMMERS[lang]:
        for pattern, new in step:
            if re.search(pattern, word):
                word = re.sub(pattern, new, word)
                break
    return word


def _step(word: Column, rules: list[Rule]) -> Column:
    out = word
    for pattern, new in reversed(rules):
        out = F.when(word.rlike(pattern), F.regexp_replace(word, pattern, new.replace("\\", "$"))).otherwise(out)
    return out


def stemmed(words: DataFrame, *, word: str, lang: str, term: str = "term") -> DataFrame:
    """``words`` with their stems; French rules where ``lang`` is ``fr``, else English. Best on distinct words."""
    out = words.withColumn(term, F.col(word))
    for k in range(max(map(len, STEMMERS.values()))):
        t = F.col(term)
        en, fr = (_step(t, steps[k]) if k < len(steps) else t for steps in (STEMMERS["en"], STEMMERS["fr"]))
        out = out.withColumn(term, F.when(F.col(lang) == "fr", fr).otherwise(en))
    return out
