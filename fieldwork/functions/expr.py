"""The survey expression language, compiled to Spark columns.

Sources are parsed once on the driver; a node is lowered to a typed cell, so the
rules of a dynamic language (loose equality, numeric comparison, short circuits,
empty values) become plain column arithmetic inside whole-stage code generation.

A cell carries the numeric, text and boolean reading of a value and whether it is
blank. NaN is kept out of comparisons: a number that is no number is null there.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


class ExpressionError(ValueError):
    """The source is not an expression."""


@dataclass(frozen=True)
class Node:
    kind: str
    value: object = None
    args: tuple[Node, ...] = ()


_TOKEN = re.compile(r"""\s*(?:(?P<number>\d+(?:\.\d*)?|\.\d+)|(?P<var>\$[A-Za-z_][\w.]*)|(?P<name>[A-Za-z_]\w*)|(?P<text>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|(?P<op>&&|\|\||==|!=|<=|>=|[-+*/%<>!(),]))""")
_LEVELS = {"||": 1, "or": 1, "&&": 2, "and": 2, "==": 3, "!=": 3, "<": 4, "<=": 4, ">": 4, ">=": 4, "+": 5, "-": 5, "*": 6, "/": 6, "%": 6}


def tokens(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    source = source.rstrip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise ExpressionError(f"unexpected character at {at}: {source[at:at + 10]!r}")
        out.append((m.lastgroup, m.group(m.lastgroup)))
        at = m.end()
    return out


class _Parser:
    def __init__(self, source: str):
        self.rest = tokens(source)[::-1]

    def peek(self) -> tuple[str, str]:
        return self.rest[-1] if self.rest else ("end", "")

    def take(self, value: str | None = None) -> tuple[str, str]:
        got = self.peek()
        if got[0] == "end" or value is not None and got[1] != value:
            raise ExpressionError(f"expected {value or 'a value'}, found {got[1] or 'the end'}")
        return self.rest.pop()

    def binary(self, least: int = 1) -> Node:
        left = self.unary()
        while (kind := self.peek()[0]) in ("op", "name") and _LEVELS.get(self.peek()[1], 0) >= least:
            op = self.take()[1]
            right = self.binary(_LEVELS[op] + 1)
            left = Node("binary", {"and": "&&", "or": "||"}.get(op, op), (left, right))
        del kind
        return left

    def unary(self) -> Node:
        if self.peek()[1] in ("-", "!", "not") and self.peek()[0] in ("op", "name"):
            op = self.take()[1]
            return Node("unary", "!" if op == "not" else op, (self.unary(),))
        return self.primary()

    def primary(self) -> Node:
        kind, value = self.take()
        if kind == "number":
            return Node("literal", float(value))
        if kind == "text":
            return Node("literal", re.sub(r"\\(.)", r"\1", value[1:-1]))
        if kind == "var":
            return Node("variable", value[1:])
        if kind == "name":
            if value in ("true", "false", "null"):
                return Node("literal", {"true": True, "false": False, "null": None}[value])
            if self.peek()[1] != "(":
                raise ExpressionError(f"{value} stands alone")
            self.take("(")
            args = []
            while self.peek()[1] != ")":
                args.append(self.binary())
                if self.peek()[1] != ")":
                    self.take(",")
            self.take(")")
            return Node("call", value, tuple(args))
        if value == "(":
            inside = self.binary()
            self.take(")")
            return inside
        raise ExpressionError(f"unexpected {value}")


def parse(source: str) -> Node:
    """The tree of a source; blank is the literal true."""
    if not source.strip():
        return Node("literal", True)
    p = _Parser(source)
    out = p.binary()
    if p.rest:
        raise ExpressionError(f"unexpected {p.peek()[1]}")
    return out


def variables(source: str) -> set[str]:
    """Names that a source reads; none if it does not parse."""
    try:
        todo, out = [parse(source)], set()
    except ExpressionError:
        return set()
    while todo:
        n = todo.pop()
        todo += n.args
        if n.kind == "variable":
            out.add(n.value)
    return out


_NUMERAL = r"^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|Infinity)\s*$"


@dataclass
class Cell:
    """num: double, null if not a number; text: null for null; flag: boolean, never null.

    kind is what is known of the type on the driver: number, text, bool or null.
    """

    kind: str
    num: Column
    text: Column
    flag: Column
    blank: Column
    items: list[Cell] = field(default_factory=list)


def number_text(x: Column) -> Column:
    """A double as the language writes it: no fraction for whole numbers."""
    whole = (F.floor(x) == x) & (F.abs(x) < 1e15)
    return F.when(whole, x.cast("decimal(38,0)").cast("string")).otherwise(x.cast("string"))


def numeral(s: Column) -> Column:
    return F.when(s.rlike(_NUMERAL), F.trim(s).try_cast("double"))


def of_number(x: Column) -> Cell:
    x = F.nanvl(x.cast("double"), F.lit(None).cast("double"))
    return Cell("number", x, number_text(x), F.coalesce(x != 0, F.lit(False)), x.isNull())


def of_text(s: Column) -> Cell:
    return Cell("text", numeral(s), s, F.coalesce(s != "", F.lit(False)), F.coalesce(s == "", F.lit(True)))


def of_bool(b: Column) -> Cell:
    return Cell("bool", b.cast("int").cast("double"), F.when(b, "true").when(~b, "false"), F.coalesce(b, F.lit(False)), b.isNull())


def of_null() -> Cell:
    none = F.lit(None)
    return Cell("null", none.cast("double"), none.cast("string"), F.lit(False), F.lit(True))


def of_column(c: Column, dtype: str) -> Cell:
    if dtype == "boolean":
        return of_bool(c)
    return of_text(c.cast("string")) if dtype in ("string", "date", "timestamp") else of_number(c)


def _equal(a: Cell, b: Cell) -> Column:
    missing = lambda c: F.lit(True) if c.kind == "null" else (c.text.isNull() if c.kind == "text" else c.blank)
    if "number" in (a.kind, b.kind):
        same = F.coalesce(a.num == b.num, F.lit(False))
    elif "bool" in (a.kind, b.kind):
        same = a.flag == b.flag
    else:
        same = F.coalesce(a.text == b.text, F.lit(False))
    ma, mb = missing(a), missing(b)
    return F.when(ma | mb, ma & mb).otherwise(same)


def _plus(a: Cell, b: Cell) -> Cell:
    total = a.num + b.num
    if "text" not in (a.kind, b.kind):
        return of_number(total)
    joined = F.concat(F.coalesce(a.text, F.lit("")), F.coalesce(b.text, F.lit("")))
    numeric = total.isNotNull()
    return Cell("text", F.when(numeric, total).otherwise(numeral(joined)), F.when(numeric, number_text(total)).otherwise(joined), F.when(numeric, total != 0).otherwise(joined != ""), F.lit(False))


def _divide(x: Column, y: Column) -> Column:
    over_zero = F.when(x > 0, F.lit(float("inf"))).when(x < 0, F.lit(float("-inf")))
    return F.when(y == 0, over_zero).otherwise(F.try_divide(x, y))


def _fold(cells: list[Cell], pick: Callable, empty: float) -> Cell:
    if not cells:
        return of_number(F.lit(empty))
    nums = [c.num for c in cells]
    some_missing = nums[0].isNull()
    for n in nums[1:]:
        some_missing = some_missing | n.isNull()
    best = nums[0] if len(nums) == 1 else pick(*nums)
    return of_number(F.when(~some_missing, best))


def _matches(a: Cell, pattern: Node) -> Column:
    if pattern.kind != "literal":
        return F.coalesce(F.regexp_like(F.coalesce(a.text, F.lit("")), lower(pattern, {}).text), F.lit(False))
    try:
        re.compile(str(pattern.value))
    except re.error:
        return F.lit(False)
    return F.coalesce(F.coalesce(a.text, F.lit("")).rlike(str(pattern.value)), F.lit(False))


def _units(s: Column) -> Column:
    return F.octet_length(F.encode(s, "UTF-16BE")) / 2


_CALLS: dict[str, Callable[[list[Cell]], Cell]] = {
    "count": lambda a: of_number(F.lit(float(len(a[0].items)))) if a[0].items else of_number(F.when(a[0].blank, 0.0).otherwise(1.0)),
    "sum": lambda a: of_number(sum((F.coalesce(c.num, F.lit(0.0)) for c in a), F.lit(0.0))),
    "isAnswered": lambda a: of_bool(~a[0].blank),
    "len": lambda a: of_number(F.coalesce(_units(a[0].text), F.lit(0.0))),
    "contains": lambda a: of_bool(F.coalesce(F.contains(a[0].text, F.coalesce(a[1].text, F.lit(""))), F.lit(False)) if a[0].kind == "text" else F.lit(False)),
    "upper": lambda a: of_text(F.upper(F.coalesce(a[0].text, F.lit("")))),
    "lower": lambda a: of_text(F.lower(F.coalesce(a[0].text, F.lit("")))),
    "abs": lambda a: of_number(F.abs(a[0].num)),
    "round": lambda a: of_number(F.floor(a[0].num + 0.5)),
    "floor": lambda a: of_number(F.floor(a[0].num)),
    "ceil": lambda a: of_number(F.ceil(a[0].num)),
    "min": lambda a: _fold(a, F.least, float("inf")),
    "max": lambda a: _fold(a, F.greatest, float("-inf")),
}


def lower(node: Node, env: dict[str, Cell]) -> Cell:
    """A node as a cell; names that env lacks are null."""
    if node.kind == "literal":
        v = node.value
        if v is None:
            return of_null()
        return of_bool(F.lit(v)) if isinstance(v, bool) else of_number(F.lit(v)) if isinstance(v, float) else of_text(F.lit(v))
    if node.kind == "variable":
        return env.get(node.value) or of_null()
    if node.kind == "unary":
        a = lower(node.args[0], env)
        return of_number(-a.num) if node.value == "-" else of_bool(~a.flag)
    if node.kind == "call":
        if node.value == "matches":
            return of_bool(_matches(lower(node.args[0], env), node.args[1]))
        call = _CALLS.get(node.value)
        if call is None:
            # an unknown function fails where it is evaluated, not where it is compiled
            return Cell("null", *(F.raise_error(F.lit(f"unknown function {node.value}")).cast(t) for t in ("double", "string", "boolean", "boolean")))
        return call([lower(x, env) for x in node.args])
    a, b = (lower(x, env) for x in node.args)
    op = node.value
    if op in ("&&", "||"):
        return of_bool(F.when(a.flag, b.flag).otherwise(False) if op == "&&" else F.when(a.flag, True).otherwise(b.flag))
    if op in ("==", "!="):
        return of_bool(_equal(a, b) if op == "==" else ~_equal(a, b))
    if op in ("<", "<=", ">", ">="):
        x, y = a.num, b.num
        return of_bool(F.coalesce({"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op], F.lit(False)))
    if op == "+":
        return _plus(a, b)
    return of_number({"-": a.num - b.num, "*": a.num * b.num, "/": _divide(a.num, b.num), "%": F.when(b.num != 0, a.num % b.num)}[op])


def environment(df, names: dict[str, str] | None = None) -> dict[str, Cell]:
    """Cells for the columns of a DataFrame, under their own or the given names."""
    names = names or {c: c for c in df.columns}
    types = dict(df.dtypes)
    return {name: of_column(F.col(c), types[c]) for name, c in names.items()}


def compile_number(source: str, env: dict[str, Cell]) -> Column:
    return lower(parse(source), env).num


def compile_text(source: str, env: dict[str, Cell]) -> Column:
    return lower(parse(source), env).text


def compile_condition(source: str, env: dict[str, Cell]) -> Column:
    return lower(parse(source), env).flag


def visible(source: str | None, env: dict[str, Cell]) -> Column:
    """A visibility condition: blank or malformed shows."""
    try:
        return compile_condition(source or "", env)
    except ExpressionError:
        return F.lit(True)


def piped(template: str, env: dict[str, Cell]) -> Column:
    """A text with ``${...}`` filled in; what does not resolve is empty."""
    parts = []
    for i, part in enumerate(re.split(r"\$\{([^}]*)\}", template)):
        if i % 2 == 0:
            parts.append(F.lit(part))
            continue
        source = f"${part.strip()}" if re.fullmatch(r"[A-Za-z_]\w*", part.strip()) else part
        try:
            parts.append(F.coalesce(compile_text(source, env), F.lit("")))
        except ExpressionError:
            parts.append(F.lit(""))
    return F.concat(*parts)
