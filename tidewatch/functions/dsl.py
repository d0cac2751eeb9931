"""A small rule language compiled to Columns on the driver, so that rules run inside generated code.

Expressions are Python syntax restricted to names, numbers, texts, tuples,
and / or / not, + - * / // %, chained comparisons, in / not in, x if c else y,
and min, max, abs, log1p, clamp. Division by zero is 0. A missing or null feature
is 0. ``and`` and ``or`` give truth values; numbers are true when not zero.
``sql`` writes the same expression as SQL text.
"""

from __future__ import annotations

import ast
from collections.abc import Collection
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_CHARS, MAX_NODES = 500, 200
FUNCTIONS = ("min", "max", "abs", "log1p", "clamp")


class RuleSyntaxError(ValueError):
    pass


@dataclass(frozen=True)
class Typed:
    """A value and what it is: ``num``, ``bool`` or ``text``; as a Column or as SQL text."""

    value: object
    kind: str


class _Columns:
    def name(self, n):
        return F.coalesce(F.col(n).cast("double"), F.lit(0.0))

    def num(self, v):
        return F.lit(float(v))

    def text(self, v):
        return F.lit(v)

    def boolean(self, v):
        return F.lit(bool(v))

    def truth(self, t):
        return t.value if t.kind == "bool" else (t.value != F.lit(0.0)) if t.kind == "num" else (F.length(t.value) > 0)

    def number(self, t):
        return t.value if t.kind == "num" else F.when(t.value, 1.0).otherwise(0.0)

    def all(self, xs):
        return reduce(lambda a, b: a & b, xs)

    def any(self, xs):
        return reduce(lambda a, b: a | b, xs)

    def inverse(self, x):
        return ~x

    def arith(self, op, a, b):
        if op in "+-*":
            return {"+": a + b, "-": a - b, "*": a * b}[op]
        quotient = a / F.when(b == 0, F.lit(None)).otherwise(b)
        if op == "/":
            return F.coalesce(quotient, F.lit(0.0))
        floor = F.floor(quotient).cast("double")
        return F.coalesce(floor if op == "//" else a - b * floor, F.lit(0.0))

    def compare(self, op, a, b):
        return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "==": a == b, "!=": a != b}[op]

    def choose(self, c, a, b):
        return F.when(c, a).otherwise(b)

    def call(self, f, xs):
        if f == "abs":
            return F.abs(xs[0])
        if f == "log1p":
            return F.log1p(xs[0])  # null at -1 and below: the rule is then false
        if f == "clamp":
            return F.greatest(xs[1], F.least(xs[2], xs[0]))
        return {"min": F.least, "max": F.greatest}[f](*xs)


class _Sql:
    def name(self, n):
        return f"coalesce({n}, 0)::DOUBLE"

    def num(self, v):
        return f"{float(v)!r}::DOUBLE"

    def text(self, v):
        return "'" + v.replace("'", "''") + "'"

    def boolean(self, v):
        return str(bool(v)).lower()

    def truth(self, t):
        return t.value if t.kind == "bool" else f"({t.value} <> 0)" if t.kind == "num" else f"(length({t.value}) > 0)"

    def number(self, t):
        return t.value if t.kind == "num" else f"(CASE WHEN {t.value} THEN 1.0 ELSE 0.0 END)::DOUBLE"

    def all(self, xs):
        return "(" + " AND ".join(xs) + ")"

    def any(self, xs):
        return "(" + " OR ".join(xs) + ")"

    def inverse(self, x):
        return f"(NOT {x})"

    def arith(self, op, a, b):
        if op in "+-*":
            return f"({a} {op} {b})"
        if op == "/":
            return f"coalesce({a} / nullif({b}, 0), 0)"
        floor = f"floor({a} / nullif({b}, 0))"
        return f"coalesce({floor}, 0)" if op == "//" else f"coalesce({a} - {b} * {floor}, 0)"

    def compare(self, op, a, b):
        return f"({a} {'=' if op == '==' else '<>' if op == '!=' else op} {b})"

    def choose(self, c, a, b):
        return f"(CASE WHEN {c} THEN {a} ELSE {b} END)"

    def call(self, f, xs):
        if f == "log1p":
            return f"(CASE WHEN {xs[0]} > -1 THEN ln(1 + {xs[0]}) END)"
        if f == "clamp":
            return f"greatest({xs[1]}, least({xs[2]}, {xs[0]}))"
        return {"min": "least", "max": "greatest", "abs": "abs"}[f] + "(" + ", ".join(xs) + ")"


_ARITH = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.FloorDiv: "//", ast.Mod: "%"}
_COMPARE = {ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">=", ast.Eq: "==", ast.NotEq: "!="}


class Compiler:
    def __init__(self, out, known: Collection[str]):
        self.out, self.known, self.names = out, set(known), set()

    def visit(self, node: ast.AST) -> Typed:
        handler = getattr(self, "on_" + type(node).__name__, None)
        if handler is None:
            raise RuleSyntaxError(f"{type(node).__name__} is not allowed")
        return handler(node)

    def number(self, node: ast.AST):
        t = self.visit(node)
        if t.kind == "text":
            raise RuleSyntaxError("a text is not a number")
        return self.out.number(t)

    def truth(self, node: ast.AST):
        return self.out.truth(self.visit(node))

    def on_Expression(self, n):
        return self.visit(n.body)

    def on_Constant(self, n):
        if isinstance(n.value, bool):
            return Typed(self.out.boolean(n.value), "bool")
        if isinstance(n.value, int | float):
            return Typed(self.out.num(n.value), "num")
        if isinstance(n.value, str):
            return Typed(self.out.text(n.value), "text")
        raise RuleSyntaxError(f"the constant {n.value!r} is not allowed")

    def on_Name(self, n):
        if n.id not in self.known:
            raise RuleSyntaxError(f"unknown name {n.id}")
        self.names.add(n.id)
        return Typed(self.out.name(n.id), "num")

    def on_BoolOp(self, n):
        parts = [self.truth(v) for v in n.values]
        return Typed(self.out.all(parts) if isinstance(n.op, ast.And) else self.out.any(parts), "bool")

    def on_UnaryOp(self, n):
        if isinstance(n.op, ast.Not):
            return Typed(self.out.inverse(self.truth(n.operand)), "bool")
        if isinstance(n.op, ast.USub):
            return Typed(self.out.arith("-", self.out.num(0), self.number(n.operand)), "num")
        if isinstance(n.op, ast.UAdd):
            return Typed(self.number(n.operand), "num")
        raise RuleSyntaxError("this operator is not allowed")

    def on_BinOp(self, n):
        op = _ARITH.get(type(n.op))
        if op is None:
            raise RuleSyntaxError("this operator is not allowed")
        return Typed(self.out.arith(op, self.number(n.left), self.number(n.right)), "num")

    def equal(self, a: Typed, b: Typed, op: str):
        if (a.kind == "text") != (b.kind == "text"):
            return self.out.boolean(op == "!=")
        return self.out.compare(op, *((a.value, b.value) if a.kind == "text" else (self.out.number(a), self.out.number(b))))

    def on_Compare(self, n):
        parts, left = [], n.left
        for op, right in zip(n.ops, n.comparators, strict=True):
            if isinstance(op, ast.In | ast.NotIn):
                if not isinstance(right, ast.Tuple | ast.List):
                    raise RuleSyntaxError("in needs a tuple")
                one = self.visit(left)
                hits = [self.equal(one, self.visit(x), "==") for x in right.elts]
                found = self.out.any(hits) if hits else self.out.boolean(False)
                parts.append(found if isinstance(op, ast.In) else self.out.inverse(found))
            else:
                sign = _COMPARE.get(type(op))
                if sign is None:
                    raise RuleSyntaxError("this comparison is not allowed")
                a, b = self.visit(left), self.visit(right)
                mixed = (a.kind == "text") != (b.kind == "text")
                parts.append(self.out.boolean(False) if mixed and sign not in ("==", "!=") else self.equal(a, b, sign))
            left = right
        return Typed(self.out.all(parts), "bool")

    def on_IfExp(self, n):
        a, b = self.visit(n.body), self.visit(n.orelse)
        if a.kind == b.kind:
            return Typed(self.out.choose(self.truth(n.test), a.value, b.value), a.kind)
        return Typed(self.out.choose(self.truth(n.test), self.out.number(a), self.out.number(b)), "num")

    def on_Call(self, n):
        f = n.func.id if isinstance(n.func, ast.Name) else ""
        if f not in FUNCTIONS or n.keywords:
            raise RuleSyntaxError("this call is not allowed")
        xs = [self.number(a) for a in n.args]
        if len(xs) != {"abs": 1, "log1p": 1, "clamp": 3}.get(f, len(xs)) or not xs:
            raise RuleSyntaxError(f"{f} has a wrong number of arguments")
        return Typed(xs[0] if f in ("min", "max") and len(xs) == 1 else self.out.call(f, xs), "num")


def _compiled(source: str, known: Collection[str], out) -> tuple[Compiler, Typed]:
    if len(source) > MAX_CHARS:
        raise RuleSyntaxError("the expression is too long")
    try:
        tree = ast.parse(source, mode="eval")
    except SyntaxError as e:
        raise RuleSyntaxError(str(e)) from e
    if sum(1 for _ in ast.walk(tree)) > MAX_NODES:
        raise RuleSyntaxError("the expression is too large")
    c = Compiler(out, known)
    return c, c.visit(tree)


def names(source: str, known: Collection[str]) -> set[str]:
    return _compiled(source, known, _Sql())[0].names


def number(source: str, known: Collection[str]) -> Column:
    c, t = _compiled(source, known, _Columns())
    return c.out.number(t)


def condition(source: str, known: Collection[str]) -> Column:
    """True where the expression holds; false, never null, where it fails."""
    c, t = _compiled(source, known, _Columns())
    return F.coalesce(c.out.truth(t), F.lit(False))


def sql(source: str, known: Collection[str]) -> str:
    c, t = _compiled(source, known, _Sql())
    return f"coalesce({c.out.truth(t)}, false)"
