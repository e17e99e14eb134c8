"""The small numeric expression language, lowered to Spark columns.

Values are doubles; NULL is a missing value. Any missing operand makes a result missing, `and` and `or` included;
comparisons follow IEEE (NaN is unordered), equality has an absolute tolerance, a zero divisor gives a missing value,
names are lower case, and `not` binds tighter than comparisons. Python's own parser reads the expressions, after a
rewriting of their tokens: `not` becomes the tight unary `~`, and names get a prefix so that none is a keyword.
"""

from __future__ import annotations

import ast
import math
import re
import sys
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from weir.errors import ExpressionError

EPSILON = sys.float_info.epsilon
_TOKEN = re.compile(r"\s+|(?P<number>[0-9.]+)|(?P<name>[^\W\d]\w*)|(?P<op>==|!=|<=|>=|[-+*/()<>])")
_NAMED_NUMBERS = {"nan": math.nan, "inf": math.inf, "infinity": math.inf}
_OPERATORS = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/"}
_COMPARISONS = {ast.Eq: "==", ast.NotEq: "!=", ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">="}


class Expression:
    """A parsed expression. str() gives a text that parses to the same tree."""

    def __init__(self, text: str):
        self.text = text
        self.tree = _parsed(text)

    def __str__(self) -> str:
        return _text(self.tree)

    def __eq__(self, other) -> bool:
        return isinstance(other, Expression) and str(self) == str(other)

    def __hash__(self) -> int:
        return hash(str(self))

    @property
    def names(self) -> set[str]:
        return {n.id[2:] for n in ast.walk(self.tree) if isinstance(n, ast.Name)}

    def value(self, columns: list[str]) -> Column:
        """The DOUBLE value; a name that isn't exactly one of columns is a missing value."""
        return _value(self.tree, _resolver(columns))

    def condition(self, columns: list[str]) -> Column:
        """A BOOLEAN that is true where the value is neither zero nor missing; conjuncts stay apart for pushdown."""
        return _condition(self.tree, _resolver(columns))


def _parsed(text: str) -> ast.expr:
    out, at, operand = [], 0, True  # operand: one is expected here
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ExpressionError(f"unexpected {text[at]!r} at {at} in {text!r}")
        at = m.end()
        if m["number"]:
            try:
                out.append(repr(float(m["number"])))
            except ValueError:
                raise ExpressionError(f"{m['number']!r} is no number") from None
            if not operand:
                raise ExpressionError(f"unexpected {m['number']!r} in {text!r}")
            operand = False
        elif m["name"]:
            name = m["name"].lower()
            if name == "not" and operand:
                out.append("~")
            elif name in ("and", "or") and not operand:
                out.append(name)
                operand = True
            elif operand:
                out.append(f"c_{name}" if name not in _NAMED_NUMBERS else f"n_{name}")
                operand = False
            else:
                raise ExpressionError(f"unexpected {name!r} in {text!r}")
        elif m["op"]:
            out.append(m["op"])
            operand = m["op"] != ")"
    if not out:
        raise ExpressionError("unexpected end of an empty expression")
    try:
        tree = ast.parse(f"({' '.join(out)}\n)", mode="eval").body
    except (SyntaxError, RecursionError) as e:
        raise ExpressionError(f"{text!r}: {e}") from None
    for n in ast.walk(tree):
        if isinstance(n, ast.Compare) and len(n.ops) > 1:
            raise ExpressionError(f"comparisons don't chain: {text!r}")
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.UAdd) or isinstance(n, ast.Tuple | ast.Call | ast.Starred):
            raise ExpressionError(f"unexpected token in {text!r}")
    return tree


def _text(n: ast.expr) -> str:
    if isinstance(n, ast.Constant):
        s = format(n.value, "f") if abs(n.value) < 1e15 else format(n.value, ".0f")
        return s if float(s) == n.value else format(n.value, ".340f").rstrip("0")
    if isinstance(n, ast.Name):
        return n.id[2:]
    if isinstance(n, ast.UnaryOp):
        return ("not " if isinstance(n.op, ast.Invert) else "-") + f"({_text(n.operand)})"
    if isinstance(n, ast.BoolOp):
        word = " and " if isinstance(n.op, ast.And) else " or "
        return word.join(f"({_text(v)})" for v in n.values)
    if isinstance(n, ast.Compare):
        return f"({_text(n.left)}) {_COMPARISONS[type(n.ops[0])]} ({_text(n.comparators[0])})"
    return f"({_text(n.left)}) {_OPERATORS[type(n.op)]} ({_text(n.right)})"


Resolver = Callable[[str], Column]


def _resolver(columns: list[str]) -> Resolver:
    known = set(columns)

    def resolve(name: str) -> Column:
        return F.col(f"`{name}`").cast("double") if name in known else F.lit(None).cast("double")

    return resolve


def _literal(n: ast.expr) -> float | None:
    if isinstance(n, ast.Constant):
        return float(n.value)
    if isinstance(n, ast.Name) and n.id[0] == "n":
        return _NAMED_NUMBERS[n.id[2:]]
    if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.USub) and (x := _literal(n.operand)) is not None:
        return -x
    return None


def _strict(operands: list[Column], result: Column) -> Column:
    missing = operands[0].isNull()
    for o in operands[1:]:
        missing = missing | o.isNull()
    return F.when(missing, F.lit(None).cast("double")).otherwise(result.cast("double"))


def _value(n: ast.expr, column: Resolver) -> Column:
    if (x := _literal(n)) is not None:
        return F.lit(x)
    if isinstance(n, ast.Name):
        return column(n.id[2:])
    if isinstance(n, ast.UnaryOp):
        v = _value(n.operand, column)
        return -v if isinstance(n.op, ast.USub) else (v == 0).cast("double")
    if isinstance(n, ast.BoolOp):
        values = [_value(v, column) for v in n.values]
        result = values[0] != 0
        for v in values[1:]:
            result = result & (v != 0) if isinstance(n.op, ast.And) else result | (v != 0)
        return _strict(values, result)
    if isinstance(n, ast.Compare):
        return _strict([_value(n.left, column), _value(n.comparators[0], column)], _compared(n, column))
    left, right = _value(n.left, column), _value(n.right, column)
    if isinstance(n.op, ast.Div):
        return F.try_divide(left, right)
    return {ast.Add: left + right, ast.Sub: left - right, ast.Mult: left * right}[type(n.op)]


def _number(c: Column, literal: float | None) -> Column | None:
    """A guard that c isn't NaN, where it can be."""
    if literal is None:
        return ~F.isnan(c)
    return F.lit(False) if math.isnan(literal) else None


def _compared(n: ast.Compare, column: Resolver) -> Column:
    """The comparison as a BOOLEAN, NaN unordered; NULL only if an operand is missing."""
    a, b = n.left, n.comparators[0]
    left, right = _value(a, column), _value(b, column)
    op = _COMPARISONS[type(n.ops[0])]
    if op in ("==", "!="):
        gap = left - right
        near = F.abs(gap) < EPSILON if op == "==" else F.abs(gap) >= EPSILON
        return ~F.isnan(gap) & near
    out, guard = {
        "<": (left < right, _number(right, _literal(b))),
        "<=": (left <= right, _number(right, _literal(b))),
        ">": (left > right, _number(left, _literal(a))),
        ">=": (left >= right, _number(left, _literal(a))),
    }[op]
    return out if guard is None else out & guard


def _condition(n: ast.expr, column: Resolver) -> Column:
    if isinstance(n, ast.BoolOp) and isinstance(n.op, ast.And):  # false and missing both drop the row here
        out = _condition(n.values[0], column)
        for v in n.values[1:]:
            out = out & _condition(v, column)
        return out
    if isinstance(n, ast.Compare):
        out = _compared(n, column)
        for side, other in ((n.left, n.comparators[0]), (n.comparators[0], n.left)):
            x = _literal(other)
            if isinstance(n.ops[0], ast.Eq) and isinstance(side, ast.Name) and side.id[0] == "c" and x is not None and math.isfinite(x):
                slack = 1e-9 * max(1.0, abs(x))  # a wider range, which scans can use to skip row groups
                out = (column(side.id[2:]) >= x - slack) & (column(side.id[2:]) <= x + slack) & out
        return out
    return _value(n, column) != 0
