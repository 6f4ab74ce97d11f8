"""A small, safe expression language that compiles to Spark columns.

Loosest to tightest: ``||``, ``&&``, ``== !=``, ``< <= > >=``, ``+ -``,
``* / %``, the pipe ``x | f(a)`` (which is f(x, a)), unary ``! -``. ``and or
not`` are words for operators. Names may have dots, which reach into structs,
arrays, maps and JSON strings; backticks quote any name.

Logic has two values: a comparison with a blank is false and its negation true.
In a filter's top level comparisons of typed columns stay plain, so that they
can be pushed into the scan.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ParseError
from . import coerce as co

TOKEN = re.compile(r"""\s*(?:(?P<num>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|(?P<str>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|(?P<tick>`[^`]*`)|(?P<name>[A-Za-z_$][\w$]*(?:\.[\w$]+)*)|(?P<op>\|\||&&|===|!==|==|!=|>=|<=|[-+*/%<>!|(),=]))""", re.S)
WORDS = {"and": "&&", "or": "||", "not": "!", "AND": "&&", "OR": "||", "NOT": "!"}


@dataclass
class Node:
    kind: str  # literal, name, unary, binary, call
    value: object = None
    args: list = field(default_factory=list)


def tokens(text: str) -> list[tuple[str, object]]:
    out, at = [], 0
    while text[at:].strip():
        m = TOKEN.match(text, at)
        if not m:
            raise ParseError(f"unexpected {text[at:].strip()[0]!r} at {at} in {text!r}")
        at = m.end()
        if m["num"]:
            out.append(("literal", float(m["num"]) if re.search(r"[.eE]", m["num"]) else int(m["num"])))
        elif m["str"]:
            out.append(("literal", re.sub(r"\\(.)", r"\1", m["str"][1:-1], flags=re.S)))
        elif m["tick"]:
            out.append(("tick", m["tick"][1:-1]))
        elif m["name"]:
            word = m["name"]
            if word in WORDS:
                out.append(("op", WORDS[word]))
            elif word in ("true", "false", "null", "NULL"):
                out.append(("literal", {"true": True, "false": False}.get(word)))
            else:
                out.append(("name", word))
        else:
            out.append(("op", {"===": "==", "!==": "!=", "=": "=="}.get(m["op"], m["op"])))
    return out


class Parser:
    LEVELS = (("||",), ("&&",), ("==", "!="), (">", ">=", "<", "<="), ("+", "-"), ("*", "/", "%"))

    def __init__(self, text: str):
        self.text, self.t, self.i = text, tokens(text), 0

    def peek(self, *ops: str) -> bool:
        return self.i < len(self.t) and self.t[self.i][0] == "op" and self.t[self.i][1] in ops

    def take(self, op: str) -> None:
        if not self.peek(op):
            raise ParseError(f"expected {op!r} in {self.text!r}")
        self.i += 1

    def parse(self) -> Node:
        node = self.level(0)
        if self.i < len(self.t):
            raise ParseError(f"unexpected {self.t[self.i][1]!r} in {self.text!r}")
        return node

    def level(self, n: int) -> Node:
        if n == len(self.LEVELS):
            return self.piped()
        left = self.level(n + 1)
        while self.peek(*self.LEVELS[n]):
            op = self.t[self.i][1]
            self.i += 1
            left = Node("binary", op, [left, self.level(n + 1)])
        return left

    def piped(self) -> Node:
        left = self.unary()
        while self.peek("|"):
            self.i += 1
            if self.i >= len(self.t) or self.t[self.i][0] != "name":
                raise ParseError(f"a pipe needs a function in {self.text!r}")
            name = self.t[self.i][1]
            self.i += 1
            left = Node("call", name, [left, *(self.arguments() if self.peek("(") else [])])
        return left

    def unary(self) -> Node:
        if self.peek("!", "-"):
            op = self.t[self.i][1]
            self.i += 1
            return Node("unary", op, [self.unary()])
        return self.primary()

    def arguments(self) -> list[Node]:
        self.take("(")
        out = []
        while not self.peek(")"):
            out.append(self.level(0))
            if not self.peek(")"):
                self.take(",")
        self.take(")")
        return out

    def primary(self) -> Node:
        if self.peek("("):
            self.i += 1
            node = self.level(0)
            self.take(")")
            return node
        if self.i >= len(self.t):
            raise ParseError(f"unexpected end of {self.text!r}")
        kind, value = self.t[self.i]
        if kind == "op":
            raise ParseError(f"unexpected {value!r} in {self.text!r}")
        self.i += 1
        if kind == "name" and self.peek("("):
            return Node("call", value, self.arguments())
        return Node("name" if kind in ("name", "tick") else "literal", value)


@dataclass
class Val:
    """A compiled column, the kind of its values, and the literal if it is one."""

    col: Column
    kind: str
    literal: object = None
    is_literal: bool = False
    type: T.DataType | None = None

    @property
    def num(self) -> Column:
        return co.num(self.col, self.kind)

    @property
    def num0(self) -> Column:
        return F.coalesce(self.num, F.lit(0.0))

    @property
    def text(self) -> Column:
        return F.coalesce(co.text(self.col, self.kind), F.lit(""))

    @property
    def blank(self) -> Column:
        return co.is_blank(self.col, self.kind)

    @property
    def truth(self) -> Column:
        return co.truthy(self.col, self.kind)

    @property
    def time(self) -> Column:
        return co.to_time(self.col, self.kind)


def literal(value: object) -> Val:
    if value is None:
        return Val(F.lit(None).cast("string"), "null", None, True)
    kind = "bool" if isinstance(value, bool) else "num" if isinstance(value, (int, float)) else "str"
    return Val(F.lit(value), kind, value, True)


def _num(c: Column) -> Val:
    return Val(c, "num")


def _str(c: Column) -> Val:
    return Val(c, "str")


def _bool(c: Column) -> Val:
    return Val(F.coalesce(c, F.lit(False)), "bool")


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


#: Patterns and code lists of the semantic detectors. Fixed values.
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
URL = r"(?i)^https?://[^\s/$.?#].[^\s]*$"
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
UNITS = {"days": 86400000, "hours": 3600000, "minutes": 60000, "seconds": 1000, "years": 31557600000}
BYTE_UNITS = ("B", "KB", "MB", "GB", "TB", "PB")


def _arg(a: list[Val], i: int, default: object = None) -> Val:
    return a[i] if i < len(a) else literal(default)


def _int(v: Val) -> Column:
    return v.num0.cast("int")


def _part(name: str):
    return lambda a: _num(getattr(F, name)(a[0].time).cast("double"))


def _in(a: list[Val]) -> Column:
    hits = [F.coalesce(a[0].num == x.num, F.lit(False)) if x.kind == "num" else a[0].text == x.text for x in a[1:]]
    found = F.lit(False)
    for h in hits:
        found = found | h
    return F.when(a[0].col.isNull(), F.lit(False)).otherwise(found)


def _between(a: list[Val]) -> Column:
    v = F.when(a[0].blank, F.lit(0.0)).otherwise(a[0].num)
    return (v >= a[1].num0) & (v <= a[2].num0)


def _substr(a: list[Val]) -> Column:
    s, n = a[0].text, F.length(a[0].text)
    start = _int(_arg(a, 1, 0))
    begin = F.when(start < 0, F.greatest(n + start, F.lit(0))).otherwise(F.least(start, n))
    size = F.greatest(_int(a[2]), F.lit(0)) if len(a) > 2 else n
    return F.substring(s, begin + 1, size)


def _pad(side: Callable) -> Callable:
    def run(a: list[Val]) -> Val:
        s, n, fill = a[0].text, _int(_arg(a, 1, 0)), _arg(a, 2, " ").text
        return _str(F.when(F.length(s) >= n, s).otherwise(side(s, n, fill)))

    return run


def _round(a: list[Val]) -> Column:
    scale = F.pow(F.lit(10.0), F.floor(_arg(a, 1, 0).num0))
    return F.floor(a[0].num0 * scale + 0.5) / scale


def _clamp(a: list[Val]) -> Column:
    v = a[0].num0
    if len(a) > 1 and not (a[1].is_literal and a[1].literal is None):
        v = F.greatest(v, a[1].num)
    if len(a) > 2 and not (a[2].is_literal and a[2].literal is None):
        v = F.least(v, a[2].num)
    return v


def _widest(f: Callable) -> Callable:
    return lambda a: _num(f(*(x.num0 for x in a)) if len(a) > 1 else a[0].num0)


def _same_kind(values: list[Val]) -> tuple[list[Column], str]:
    """Columns brought to one type: their own if they agree, else strings."""
    kinds = {v.kind for v in values if v.kind != "null"}
    if len(kinds) == 1:
        k = kinds.pop()
        if k == "num":
            return [v.num if v.kind != "null" else F.lit(None).cast("double") for v in values], k
        if k == "time":
            return [v.time if v.kind != "null" else F.lit(None).cast("timestamp") for v in values], k
        return [v.col if v.kind != "null" else F.lit(None).cast({"bool": "boolean"}.get(k, "string")) for v in values], k
    return [co.text(v.col, v.kind) if v.kind != "null" else F.lit(None).cast("string") for v in values], "str"


def _if(a: list[Val]) -> Val:
    (yes, no), kind = _same_kind([a[1], _arg(a, 2)])
    return Val(F.when(a[0].truth, yes).otherwise(no), kind)


def _coalesce(a: list[Val]) -> Val:
    cols, kind = _same_kind(a)
    return Val(F.coalesce(*(F.when(~v.blank, c) for v, c in zip(a, cols, strict=True))), kind)


def _null_if(a: list[Val]) -> Val:
    return Val(F.when(~equal(a[0], a[1], strict=True), a[0].col), a[0].kind)


def _bytes(v: Column) -> Column:
    n = F.least(F.greatest(F.floor(F.log(1024.0, F.greatest(v, F.lit(1.0))) + 1e-12), F.lit(0)), F.lit(len(BYTE_UNITS) - 1)).cast("int")
    size = co.half_up(v / F.pow(F.lit(1024.0), n), 2)
    return F.concat(F.regexp_replace(F.format_string("%.2f", size), r"\.?0+$", ""), F.lit(" "), F.element_at(F.array(*map(F.lit, BYTE_UNITS)), n + 1))


def _parse_bytes(s: Column) -> Column:
    unit = F.upper(F.regexp_extract(s, r"(?i)^\s*[\d.]+\s*([KMGTP]?)I?B?\s*$", 1))
    power = F.instr(F.lit("KMGTP"), unit)
    return F.regexp_extract(s, r"(?i)^\s*([\d.]+)\s*[KMGTP]?I?B?\s*$", 1).try_cast("double") * F.pow(F.lit(1024.0), F.when(unit == "", 0).otherwise(power))


def _json(v: Val, path: str) -> Val:
    steps = "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in path.split("."))
    source = v.col if v.kind == "str" else F.to_json(v.col)
    return _str(F.get_json_object(source, "$" + steps))


_TRUE = ("true", "1", "yes", "t", "y")
FUNCTIONS: dict[str, Callable[[list[Val]], Val]] = {
    "in": lambda a: _bool(_in(a)),
    "notin": lambda a: _bool(~_in(a)),
    "between": lambda a: _bool(_between(a)),
    "year": _part("year"), "month": _part("month"), "day": _part("dayofmonth"), "hour": _part("hour"), "minute": _part("minute"),
    "dayofweek": lambda a: _num((F.dayofweek(a[0].time) - 1).cast("double")),
    "datediff": lambda a: _num(F.floor((F.unix_millis(a[0].time) - F.unix_millis(a[1].time)) / F.lit(float(UNITS.get(str(_arg(a, 2, "days").literal), UNITS["days"]))) + 0.5).cast("double")),
    "ispast": lambda a: _bool(a[0].time < F.current_timestamp()),
    "isfuture": lambda a: _bool(a[0].time > F.current_timestamp()),
    "istoday": lambda a: _bool(F.to_date(a[0].time) == F.current_date()),
    "concat": lambda a: _str(F.concat(*(x.text for x in a))),
    "substr": lambda a: _str(_substr(a)),
    "replace": lambda a: _str(F.when(a[1].text == "", a[0].text).otherwise(F.replace(a[0].text, a[1].text, _arg(a, 2, "").text))),
    "splitindex": lambda a: _str(F.split_part(a[0].text, _arg(a, 1, ",").text, _int(_arg(a, 2, 0)) + 1)),
    "indexof": lambda a: _num((F.locate(str(a[1].literal), a[0].text) - 1 if a[1].is_literal else F.instr(a[0].text, a[1].text) - 1).cast("double")),
    "padleft": _pad(F.lpad), "padright": _pad(F.rpad),
    "contains": lambda a: _bool(F.lower(a[0].text).contains(F.lower(a[1].text))),
    "startswith": lambda a: _bool(a[0].text.startswith(a[1].text)),
    "endswith": lambda a: _bool(a[0].text.endswith(a[1].text)),
    "lower": lambda a: _str(F.lower(a[0].text)), "upper": lambda a: _str(F.upper(a[0].text)),
    "trim": lambda a: _str(F.regexp_replace(a[0].text, r"^[\s\u00a0\ufeff]+|[\s\u00a0\ufeff]+$", "")),
    "length": lambda a: _num(F.length(a[0].text).cast("double")),
    "matches": lambda a: _bool(a[0].text.rlike(_pattern(a[1]))),
    "abs": lambda a: _num(F.abs(a[0].num0)), "ceil": lambda a: _num(F.ceil(a[0].num0).cast("double")), "floor": lambda a: _num(F.floor(a[0].num0).cast("double")), "sqrt": lambda a: _num(F.sqrt(a[0].num0)),
    "round": lambda a: _num(_round(a)), "clamp": lambda a: _num(_clamp(a)),
    "min": _widest(F.least), "max": _widest(F.greatest),
    "pow": lambda a: _num(F.pow(a[0].num0, _arg(a, 1, 1).num0)),
    "log": lambda a: _num(F.log(F.when(a[0].blank, F.lit(1.0)).otherwise(a[0].num))),
    "if": _if, "iif": _if,
    "isnull": lambda a: _bool(a[0].blank), "isnotnull": lambda a: _bool(~a[0].blank),
    "coalesce": _coalesce, "nvl": lambda a: _coalesce(a[:2]), "nullif": _null_if,
    "isnumber": lambda a: _bool(a[0].num.isNotNull() & ~a[0].blank),
    "isemail": lambda a: _bool(a[0].text.rlike(EMAIL)), "isurl": lambda a: _bool(a[0].text.rlike(URL)), "isuuid": lambda a: _bool(a[0].text.rlike(UUID)),
    "isdate": lambda a: _bool(a[0].time.isNotNull() & ~a[0].blank),
    "toint": lambda a: _num(F.when(~a[0].blank, F.regexp_extract(a[0].text, r"^\s*([+-]?\d+)", 1).try_cast("double"))),
    "tofloat": lambda a: _num(co.parse_float(a[0].text, "str")),
    "tostring": lambda a: _str(a[0].text),
    "tobool": lambda a: _bool(F.lower(a[0].text).isin(*_TRUE)),
    "formatbytes": lambda a: _str(_bytes(a[0].num0)),
    "parsebytes": lambda a: _num(F.coalesce(_parse_bytes(a[0].text), F.lit(0.0))),
    "formatnumber": lambda a: _str(F.regexp_replace(F.format_number(a[0].num0, 3), r"\.?0+$", "")),
    "jsonget": lambda a: _json(a[0], str(a[1].literal)),
}
for _name, _same in (("substring", "substr"), ("prettybytes", "formatbytes"), ("humanbytes", "formatbytes")):
    FUNCTIONS[_name] = FUNCTIONS[_same]


def register_function(name: str, build: Callable[[list[Val]], Val]) -> None:
    """Add a function; ``build`` makes a Val from the compiled arguments."""
    FUNCTIONS[name.lower()] = build


def _pattern(v: Val) -> str:
    """A literal pattern; one that is no regular expression matches nothing."""
    try:
        re.compile(str(v.literal))
    except re.error:
        return r"(?!)"
    return str(v.literal)


def equal(a: Val, b: Val, strict: bool = False) -> Column:
    """Two-valued equality."""
    for x, y in ((a, b), (b, a)):
        if y.is_literal:
            if y.literal is None:
                return x.blank
            if y.kind == "bool" and not strict:
                return x.truth == y.col
            if y.kind == "num":
                return F.coalesce(x.num == y.num, F.lit(False))
            if y.kind == "str":
                return F.coalesce(co.text(x.col, x.kind) == y.col, F.lit(False))
    if "num" in (a.kind, b.kind):
        return F.when(a.col.isNull() | b.col.isNull(), a.col.isNull() & b.col.isNull()).otherwise(F.coalesce(a.num == b.num, F.lit(False)))
    if a.kind == b.kind:
        return a.col.eqNullSafe(b.col)
    return co.text(a.col, a.kind).eqNullSafe(co.text(b.col, b.kind))


class Compiler:
    def __init__(self, schema: T.StructType):
        self.types = {f.name: f.dataType for f in schema.fields}

    def name(self, name: str) -> Val:
        if name in self.types:
            return Val(quoted(name), co.kind_of(self.types[name]), type=self.types[name])
        parts = name.split(".")
        for n in range(1, len(parts)):
            if (head := ".".join(parts[:n])) in self.types:
                return self.inside(Val(quoted(head), co.kind_of(self.types[head]), type=self.types[head]), parts[n:])
        if len(parts) > 1 and parts[0] in ("payload", "row", "data"):
            return self.name(".".join(parts[1:]))
        return literal(None)

    def inside(self, v: Val, path: list[str]) -> Val:
        if not path:
            return v
        t, p = v.type, path[0]
        if isinstance(t, T.StructType):
            if p not in t.names:
                return literal(None)
            return self.inside(Val(v.col.getField(p), co.kind_of(t[p].dataType), type=t[p].dataType), path[1:])
        if isinstance(t, T.ArrayType) and p.isdigit():
            return self.inside(Val(F.try_element_at(v.col, F.lit(int(p) + 1)), co.kind_of(t.elementType), type=t.elementType), path[1:])
        if isinstance(t, T.MapType):
            return self.inside(Val(F.try_element_at(v.col, F.lit(p)), co.kind_of(t.valueType), type=t.valueType), path[1:])
        return _json(v, ".".join(path)) if v.kind == "str" else literal(None)

    def value(self, node: Node) -> Val:
        if node.kind == "literal":
            return literal(node.value)
        if node.kind == "name":
            return self.name(node.value)
        if node.kind == "unary":
            v = self.value(node.args[0])
            if node.value == "!":
                return _bool(~v.truth)
            return literal(-v.literal) if v.is_literal and v.kind == "num" else _num(-v.num0)
        if node.kind == "call":
            build = FUNCTIONS.get(node.value.lower())
            if build is None:
                raise ParseError(f"unknown function {node.value!r}")
            try:
                return build([self.value(x) for x in node.args])
            except IndexError:
                raise ParseError(f"too few arguments for {node.value!r}") from None
        op = node.value
        a, b = (self.value(x) for x in node.args)
        if op == "&&":
            return _bool(a.truth & b.truth)
        if op == "||":
            return _bool(a.truth | b.truth)
        if op == "==":
            return _bool(equal(a, b))
        if op == "!=":
            return Val(~F.coalesce(equal(a, b), F.lit(False)), "bool")
        if op in ("<", "<=", ">", ">="):
            return _bool(self.compared(op, a, b))
        if op == "+":
            if "str" in (a.kind, b.kind):
                return _str(F.concat(a.text, b.text))
            return _num(a.num0 + b.num0)
        if op in "-*":
            return _num(a.num0 - b.num0 if op == "-" else a.num0 * b.num0)
        low = F.when(b.num0 == 0, F.lit(1.0)).otherwise(b.num0)
        return _num(a.num0 / low if op == "/" else a.num0 % low)

    @staticmethod
    def compared(op: str, a: Val, b: Val) -> Column:
        plain = a.kind == b.kind == "num" or a.kind == b.kind == "time"
        if a.kind == "time" and b.is_literal and b.kind == "str":  # typed times compare with written ones
            x, y = a.time, b.time
        else:
            x, y = (a.col, b.col) if plain else (a.num, b.num)
        return {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]

    def predicate(self, node: Node) -> Column:
        """A filter's condition: null counts as false, so comparisons of typed columns need no cover."""
        if node.kind == "binary" and node.value in ("&&", "||"):
            a, b = (self.predicate(x) for x in node.args)
            return a & b if node.value == "&&" else a | b
        if node.kind == "binary" and node.value in ("<", "<=", ">", ">="):
            return self.compared(node.value, *(self.value(x) for x in node.args))
        if node.kind == "binary" and node.value == "==":
            a, b = (self.value(x) for x in node.args)
            if a.is_literal:
                a, b = b, a
            if b.is_literal and b.literal is not None and a.kind == b.kind and a.kind in ("num", "str"):
                return a.col == b.col
        return self.value(node).truth


def compile_value(text: str, schema: T.StructType) -> Val:
    return Compiler(schema).value(Parser(text).parse()) if text.strip() else literal(None)


def compile_column(text: str, df: DataFrame) -> Column:
    return compile_value(text, df.schema).col


def compile_filter(text: str, df: DataFrame) -> Column:
    return Compiler(df.schema).predicate(Parser(text).parse()) if text.strip() else F.lit(True)
