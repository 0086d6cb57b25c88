"""PII surrogates with DataFrame and SQL functions only.

Entities are found by one pattern: secrets after a telling key, e-mail addresses,
hexadecimal keys, IPv4 addresses, IBANs, social security, phone and card numbers, and
persons' names after a title. An entity is one part or several: an address has a local
part and a domain, a name its given names and its family name. Every distinct part
(kind and canonical form) gets one surrogate for the whole table, made from a keyed
hash:

* of its own type and format: digits for digits, letters of the same case and script
  for letters, the same separators; a card keeps its first digit and its Luhn
  remainder, a phone its country code, a private IPv4 address its network, an address
  its reserved top domain; given names get names of the gender that the title tells, in
  the same script (Latin, Cyrillic, Greek), built from syllables; an initial is moved
  along its alphabet by a keyed distance, so different ones stay different;
* coreferent: forms that differ in case or separators only are one part, and so are a
  phone number with and without its country code or trunk zero; equal domains, given
  names and family names stay equal wherever they stand, and so do the forms of a
  Cyrillic family name for men and women;
* distinct: a surrogate that another part of the kind has, or that is itself a part in
  the table, is drawn again, in rounds over those that are left. As parts are distinct,
  so are the entities composed of them. From the round GROWING on, names, local parts,
  domains, secrets and keys become longer, and numbers may take forms of the table that
  are not their own; after LAST_ROUND a number gets digits of its hash in addition.

The pattern is run over a text for its hits, which are stored with their rows, and again
over texts with hits, to part them. A document's
replacements depend on its list of hits alone. Each distinct list is worked out once
and joined to the documents that hold it, so texts without entities are never shuffled,
and groups of copies need no key but their list; the join's hot lists are split by the
adaptive planner.

Defined results: a null text stays null, an empty one empty, both with 0 entities;
repeated rows get equal texts; an empty table stays empty. All other columns are
returned as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwork.llm.common import read, stored

KEY = "fieldwork"
GROWING, LAST_ROUND = 12, 40

_SECRET = r"""(?i:(?<![\p{L}\p{N}])(?:token|api[_-]?key|secret|password|passwd)\s*+[=:]\s*+["']?)"""
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
# Titles by gender.
_MEN = r"(?:Mr|MR|Herr|HERR|Monsieur|MONSIEUR|Señor|SEÑOR|г-н|Г-Н)"
_WOMEN = r"(?:Mrs|MRS|Ms|MS|Frau|FRAU|Madame|MADAME|Mme|MME|Señora|SEÑORA|г-жа|Г-ЖА)"
_NAME_TITLE = rf"(?<![\p{{L}}\p{{N}}])(?:{_MEN}|{_WOMEN})\.? "
# A word of a name or an initial with its dot; further ones may be bare initials.
_WORD = r"(?:\p{Lu}\.|\p{Lu}(?:\p{L}|['’](?=\p{Lu}))++)"
KINDS = {
    "secret": _SECRET + r"[A-Za-z0-9_+/=.-]{8,}+",
    # runs of single characters without bounds: neither long names nor many labels are left out
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-][\p{L}\p{N}.-]*\.\p{L}{2,}+",
    "hex": r"(?<![A-Za-z0-9])[0-9a-fA-F]{32,}+(?![A-Za-z0-9])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d.+])(?!\+\d+\.\d+(?![ .-]?\d))\+[1-9](?:[ .-]?[()]?[ .-]?\d){6,14}(?!\d)|(?<![\d+])\+?\d{0,3}[ .-]?\(\d{2,4}\)[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\d.+])\+\d{1,3}(?:[ .-]\d{2,4}){2,5}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])",
    "card": r"(?<![\d.])\d(?:[ -]?\d){12,18}(?!\.?\d)",
    "name": _NAME_TITLE + _WORD + rf"(?:(?:[ -]|(?<=\.))(?:{_WORD}|\p{{Lu}}(?=[ -]\p{{Lu}})))*+",
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())

#: What any entity must hold; texts without it are not searched by the whole pattern.
_GUARD = rf"[0-9@=:]|[a-fA-F]{{32}}|{_MEN}|{_WOMEN}"

# Syllables, and the endings of a man's, a woman's and a family name.
_SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe ga go ha he ka ke ki ko la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se si so ta te ti to va ve vi vo".split(),
    "cyrillic": "ба бе би бо ва ве ви во га го да де ди до за зе ка ко ла ле ли ло ма ме ми мо на не ни но па по ра ре ри ро са се си со та те ти то".split(),
    "greek": "βα βε βι βο γα γε γι γο δα δε δι δο κα κε κι κο λα λε λι λο μα με μι μο να νε νι νο πα πε πι πο ρα ρε ρι ρο τα τε τι το".split(),
}
_ENDINGS = {"latin": ("n", "na", "rd"), "cyrillic": ("н", "на", "ров"), "greek": ("ν", "να", "ς")}
# The alphabets that letters are drawn from.
_LETTERS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}
# Country codes of one and two digits; all others have three.
_CODE = r"^(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: Stands for the key in SQL until ``_keyed`` puts it in.
_KEY_MARK = ":key:"


def _hash(*parts: str) -> str:
    """SQL for a keyed hash of SQL strings, 128 hexadecimal digits."""
    return f"sha2(concat({_KEY_MARK}, sha2(concat_ws('|', {_KEY_MARK}, {', '.join(parts)}), 512)), 512)"


def _keyed(sql: str, key: str) -> Column:
    return F.expr(sql.replace(_KEY_MARK, _quoted(key)))


def _mapped(s: str, salt: str, hex_only: str = "false") -> str:
    """SQL: every letter and digit of s replaced by one of its class, drawn from the salt."""
    h = f"transform(sequence(0, length({s}) div 60), b -> {_hash(salt, 'attempt', 'b')})"
    c = "c"
    v = "cast(conv(substr(h[j div 60], 1 + 2 * (j % 60), 2), 16, 10) AS INT)"
    pick = lambda letters: f"substr('{letters}', 1 + {v} % {len(letters)}, 1)"
    low = _LETTERS["latin"]
    one = f"CASE WHEN {c} BETWEEN '0' AND '9' THEN {pick('0123456789')} WHEN {hex_only} AND {c} BETWEEN 'a' AND 'f' THEN {pick('abcdef')} "
    for letters, (first, last) in zip(_LETTERS.values(), ("az", "ая", "αω"), strict=True):
        one += f"WHEN {c} BETWEEN '{first}' AND '{last}' THEN {pick(letters)} WHEN {c} BETWEEN '{first.upper()}' AND '{last.upper()}' THEN {pick(letters.upper())} "
    one += f"WHEN {c} RLIKE '\\\\p{{Lu}}' THEN {pick(low.upper())} WHEN {c} RLIKE '\\\\p{{L}}' THEN {pick(low)} ELSE {c} END"
    # the hashes are bound once and read at every place; characters are taken apart once, as a place in a string is found by counting
    return f"array_join(flatten(transform(array({h}), h -> transform(regexp_extract_all({s}, '(?s).', 0), (c, j) -> {one}))), '')"


def _luhn(s: str) -> str:
    """SQL: the Luhn remainder of a string of digits."""
    d = f"cast(substr({s}, i, 1) AS INT)"
    twice = f"(length({s}) - i) % 2 = 1"
    return f"aggregate(sequence(1, length({s})), 0, (t, i) -> t + CASE WHEN {twice} THEN 2 * {d} - CASE WHEN {d} > 4 THEN 9 ELSE 0 END ELSE {d} END) % 10"


def _more(letters: str) -> str:
    """SQL: letters that are added from the round GROWING on, one more each two rounds."""
    h = _hash("kind", "canon", "attempt", "'more'")
    return f"CASE WHEN attempt < {GROWING} THEN '' ELSE translate(substr({h}, 1, 1 + (attempt - {GROWING}) div 2), '0123456789abcdef', '{letters}') END"


def _name_part() -> str:
    """SQL for a given or family name's surrogate: four syllables, more in later rounds, and an ending."""

    def of(script: str) -> str:
        syllables = "array(" + ", ".join(map(_quoted, _SYLLABLES[script])) + ")"
        at = f"1 + cast(conv(substr(h, 4 * k - 3, 4), 16, 10) AS INT) % {len(_SYLLABLES[script])}"
        drawn = f"transform(sequence(1, least(30, 4 + attempt div 6)), k -> element_at({syllables}, {at}))"
        man, woman, family = _ENDINGS[script]
        end = f"CASE kind WHEN 'given_m' THEN '{man}' WHEN 'given_w' THEN '{woman}' ELSE '{family}' END"
        return f"concat(array_join(flatten(transform(array({_hash('kind', 'canon', 'attempt')}), h -> {drawn})), ''), {end})"

    return f"CASE WHEN canon RLIKE '\\\\p{{IsCyrillic}}' THEN {of('cyrillic')} WHEN canon RLIKE '\\\\p{{IsGreek}}' THEN {of('greek')} ELSE {of('latin')} END"


def _initial() -> str:
    """SQL: a letter moved along its alphabet by a keyed distance."""
    h = f"cast(conv(substr({_hash(_quoted('initial'))}, 1, 6), 16, 10) AS INT)"
    out = "CASE "
    for letters in _LETTERS.values():
        n = len(letters)
        out += f"WHEN instr('{letters}', canon) > 0 THEN substr('{letters}', 1 + (instr('{letters}', canon) + {h} % {n - 1}) % {n}, 1) "
    return out + "ELSE canon END"


def _surrogate() -> str:
    """SQL for a part's surrogate from the columns kind, canon and attempt."""
    low = _LETTERS["latin"][:16]
    label, top = "substring_index(canon, '.', 1)", "substring_index(canon, '.', -1)"
    domain = f"concat({_mapped(label, 'canon')}, {_more(low)}, '.example.', CASE WHEN {top} IN ('com', 'net', 'org') THEN {top} ELSE 'com' END)"
    body = f"concat(substr(canon, 1, 1), {_mapped('substr(canon, 2, length(canon) - 2)', 'canon')})"
    lead = f"concat({body}, '0')"
    card = f"concat({body}, cast(pmod({_luhn('canon')} - {_luhn(lead)}, 10) AS STRING))"
    national = "substring_index(canon, '|', -1)"
    phone = f"concat(substring_index(canon, '|', 1), '|', {_mapped(national, 'canon')})"
    octet = lambda k, least, n: f"cast({least} + cast(conv(substr({_hash(_quoted('ip'), 'canon', 'attempt')}, {1 + 8 * k}, 8), 16, 10) AS BIGINT) % {n} AS STRING)"
    parts = "split(canon, '\\\\.')"
    private = "canon RLIKE '^(10|127)\\\\.|^192\\\\.168\\\\.'"
    ip = f"concat_ws('.', CASE WHEN {private} THEN {parts}[0] ELSE {octet(0, 11, 116)} END, CASE WHEN canon LIKE '192.168.%' THEN '168' ELSE {octet(1, 0, 256)} END, {octet(2, 0, 256)}, {octet(3, 0, 256)})"
    is_hex = "(canon RLIKE '^[0-9a-f]+$')"
    more = f"CASE WHEN kind IN ('local', 'secret') THEN {_more(low)} WHEN kind = 'hex' THEN {_more('0123456789abcdef')} ELSE '' END"
    return (
        f"CASE WHEN kind = 'domain' THEN {domain} WHEN kind = 'card' THEN {card} WHEN kind = 'phone' THEN {phone} WHEN kind = 'ip' THEN {ip} "
        f"WHEN kind IN ('given_m', 'given_w', 'family') THEN {_name_part()} ELSE concat({_mapped('canon', 'canon', hex_only=is_hex)}, {more}) END"
    )


def kind_of(hit: Column) -> Column:
    out = F.lit("name")
    for kind in reversed([k for k in KINDS if k != "name"]):
        out = F.when(hit.rlike(f"^(?:{KINDS[kind]})$"), kind).otherwise(out)
    return out


def _value(hit: Column) -> Column:
    """The part of a hit that is replaced: without a secret's key or a name's title."""
    return F.regexp_replace(F.regexp_replace(hit, "^" + _SECRET, ""), "^" + _NAME_TITLE, "")


def parts_of(kind: Column, hit: Column) -> Column:
    """The parts of a hit in order: an array of (kind, canon, after); ``after`` is what stands behind a part."""
    value, digits = _value(hit), F.regexp_replace(hit, r"\D", "")
    none = F.lit("")
    part = lambda k, canon, after=none: F.struct(k.alias("kind"), canon.alias("canon"), after.alias("after"))
    address = F.lower(value)
    email = F.array(part(F.lit("local"), F.substring_index(address, "@", 1), F.lit("@")), part(F.lit("domain"), F.substring_index(address, "@", -1)))

    # a number of ten digits without a code is one of code 1; a trunk zero is no part of it
    plain = ~hit.startswith("+")
    american = plain & ((F.length(digits) == 10) | ((F.length(digits) == 11) & digits.startswith("1")))
    code = F.when(american, "1").when(plain, "").otherwise(F.regexp_extract(digits, _CODE, 1))
    rest = F.when(american, F.right(digits, F.lit(10))).when(plain, digits).otherwise(F.regexp_replace(F.substr(digits, F.length(code) + 1), "^0", ""))

    woman = hit.rlike(rf"^{_WOMEN}\b")
    tokens = F.filter(F.split(value, r"(?<=[ -])|(?<=\.)(?=[^ -])"), lambda t: t != "")

    def of_word(t: Column, i: Column) -> Column:
        word, after = F.lower(F.regexp_replace(t, r"\.?[ -]?$", "")), F.regexp_extract(t, r"\.?[ -]?$", 0)
        last = i == F.size(tokens) - 1
        one = F.length(word) == 1
        family = F.when(woman & word.rlike(r"\p{IsCyrillic}"), F.regexp_replace(word, "а$", "")).otherwise(word)
        return part(F.when(one, "initial").when(last, "family").when(woman, "given_w").otherwise("given_m"), F.when(last & ~one, family).otherwise(word), after)

    exact = (kind == "secret") & ~F.lower(value).rlike("^[0-9a-f]+$")
    canon = F.when(kind.isin("card", "ssn"), digits).when(kind == "phone", F.concat(code, F.lit("|"), rest)).when(kind == "iban", F.regexp_replace(hit, " ", "")).when(exact, value).otherwise(F.lower(value))
    return F.when(kind == "email", email).when(kind == "name", F.transform(tokens, of_word)).otherwise(F.array(part(kind, canon)))


def rendered(kind: Column, hit: Column, surrogates: Column) -> Column:
    """A hit with its parts' surrogates, an array of (surrogate, kind, after), in its own form: separators, case, key or title."""
    value = _value(hit)
    woman = hit.rlike(rf"^{_WOMEN}\b")

    def word(p: Column) -> Column:
        ends = (p["kind"] == "family") & woman & p["surrogate"].rlike(r"\p{IsCyrillic}")
        full = F.concat(p["surrogate"], F.when(ends, "а").otherwise(""))
        return F.concat(F.when(kind == "name", F.initcap(full)).otherwise(full), p["after"])

    text = F.array_join(F.transform(surrogates, word), "")
    plain = F.substring_index(text, "|", -1)
    # what a number has before its own digits, a country code or trunk zero, stays
    skipped = F.length(F.regexp_replace(hit, "[^A-Z0-9]", "")) - F.length(plain)

    def fill(state: Column, i: Column) -> Column:
        c = F.substr(hit, i, F.lit(1))
        mine = c.rlike("[A-Z0-9]")
        return F.struct(F.concat(state["s"], F.when(mine & (state["k"] >= 1), F.substr(plain, state["k"], F.lit(1))).otherwise(c)).alias("s"), F.when(mine, state["k"] + 1).otherwise(state["k"]).alias("k"))

    laid_out = F.aggregate(F.sequence(F.lit(1), F.length(hit)), F.struct(F.lit("").alias("s"), (1 - skipped).cast("int").alias("k")), fill, lambda x: F.concat(x["s"], F.when(F.length(plain) >= x["k"], F.substr(plain, x["k"])).otherwise("")))
    shaped = F.when((value == F.upper(value)) & value.rlike(r"\p{Lu}"), F.upper(text)).when((kind == "email") & value.rlike(r"^\p{Lu}"), F.concat(F.upper(F.substr(text, F.lit(1), F.lit(1))), F.substr(text, F.lit(2)))).otherwise(text)
    exact = (kind == "secret") & ~F.lower(value).rlike("^[0-9a-f]+$")
    before = F.substr(hit, F.lit(1), F.length(hit) - F.length(value))
    return F.when(kind.isin("card", "ssn", "phone", "iban"), laid_out).otherwise(F.concat(before, F.when(exact, text).otherwise(shaped)))


def assign(entities: DataFrame, *, growing: int = GROWING, key: str = KEY) -> DataFrame:
    """(kind, canon, surrogate) for distinct (kind, canon); surrogates are distinct and new."""
    initials = entities.where("kind = 'initial'").select("kind", "canon", _keyed(_initial(), key).alias("sur"))
    found = stored(initials, "pii-round")
    left = entities.where("kind <> 'initial'")
    own = left.select("kind", F.col("canon").alias("sur"), F.lit(None).cast("string").alias("canon"), F.lit(True).alias("old"))
    taken = None
    for attempt in range(LAST_ROUND):
        drawn = left.withColumn("attempt", F.lit(attempt)).withColumn("sur", _keyed(_surrogate(), key)).where("sur <> canon").select("kind", "sur", "canon", F.lit(False).alias("old"))
        # numbers can't become longer: in late rounds they may take forms of the table
        both = drawn.unionByName(own if attempt < growing else own.where("kind IN ('local', 'domain', 'given_m', 'given_w', 'family', 'secret', 'hex')"))
        if taken is not None:
            both = both.unionByName(taken)
        # one row of a drawn surrogate wins, unless the surrogate is taken
        won = both.groupBy("kind", "sur").agg(F.min("canon").alias("canon"), F.max("old").alias("used")).where("NOT used AND canon IS NOT NULL").select("kind", "canon", "sur")
        won = stored(won, "pii-round")
        found = found.unionByName(won)
        left = stored(left.join(won.select("kind", "canon"), ["kind", "canon"], "left_anti"), "pii-left")
        if left.isEmpty():
            return found.withColumnRenamed("sur", "surrogate")
        mine = won.select("kind", "sur", F.lit(None).cast("string").alias("canon"), F.lit(True).alias("old"))
        taken = mine if taken is None else taken.unionByName(mine)
    digits = f"concat(sur, translate(substr({_hash('kind', 'canon')}, 1, 20), 'abcdef', '012345'))"
    rest = left.withColumn("attempt", F.lit(LAST_ROUND)).withColumn("sur", _keyed(_surrogate(), key)).select("kind", "canon", _keyed(digits, key).alias("sur"))
    return found.unionByName(rest).withColumnRenamed("sur", "surrogate")


def replaced(docs: DataFrame, *, text_col: str = "text", key: str = KEY) -> DataFrame:
    """``docs`` with ``text_col`` replaced and two columns more: __n_entities, __kinds.

    ``key`` should be a secret of the data's owner; the default is for tests alone.
    ``__kinds`` lists the kinds found, distinct, sorted and joined by commas.
    """
    text = F.col(text_col)
    hits = F.when(text.rlike(_GUARD), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))
    # a row goes along as a whole, so its columns' names can't clash
    rows = stored(docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), hits.alias("hits")), "pii-rows")
    some = F.coalesce(F.size("hits") > 0, F.lit(False))
    holding = rows.where(some).withColumn("key", F.sha2(F.array_join("hits", "\u0001"), 256))
    lists = stored(holding.select("key", "hits").groupBy("key").agg(F.first("hits").alias("hits")), "pii-lists")
    each = lists.select("key", F.posexplode("hits").alias("pos", "hit")).withColumn("of", kind_of(F.col("hit")))
    each = each.select("key", "pos", "hit", "of", F.posexplode(parts_of(F.col("of"), F.col("hit"))).alias("no", "p")).select("key", "pos", "hit", "of", "no", "p.*")
    each = stored(each, "pii-parts")
    chosen = assign(stored(each.select("kind", "canon").distinct(), "pii-entities"), key=key)
    whole = each.join(chosen, ["kind", "canon"]).groupBy("key", "pos", "of", "hit").agg(F.sort_array(F.collect_list(F.struct("no", "surrogate", "kind", "after"))).alias("s"))
    out = whole.select("key", "pos", "of", rendered(F.col("of"), F.col("hit"), F.col("s")).alias("new"))
    new = out.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("pos", "new", "of"))).alias("r"))
    new = stored(new.select("key", F.col("r.new").alias("new"), F.array_join(F.array_sort(F.array_distinct("r.of")), ",").alias("kinds")), "pii-replacements")
    pieces = F.zip_with(F.split(F.col("row")[text_col], PATTERN, -1), F.col("new"), lambda p, r: F.concat(p, F.coalesce(r, F.lit(""))))
    filled = holding.join(new, "key").select(F.col("row").withField(text_col, F.array_join(pieces, "")).alias("row"), F.size("hits").cast("long").alias("n"), "kinds")
    every = rows.where(~some).select("row", F.lit(0).cast("long").alias("n"), F.lit("").alias("kinds")).unionByName(filled)
    return every.select("row.*", F.col("n").alias("__n_entities"), F.col("kinds").alias("__kinds"))


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = replaced(read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return done.select("doc_id", "text", "lang", "source", F.col("__n_entities").alias("n_entities"), F.col("__kinds").alias("kinds"))
