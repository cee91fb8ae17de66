"""The small expression language of ``compute`` and ``filter``, as Columns.

Python syntax: names, numbers, strings, arithmetic, comparisons (chained ones
are joined by and), and/or/not, and the functions of ``FUNCTIONS``. Division by
zero and logarithms out of range give null; a comparison with null is false,
and ``!=`` is true.
"""

from __future__ import annotations

import ast
import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _or_null(ok, f):
    return lambda x: F.when(ok(x), f(x))


FUNCTIONS = {
    "abs": F.abs, "exp": F.exp, "sin": F.sin, "cos": F.cos, "tan": F.tan, "floor": F.floor, "ceil": F.ceil,
    "sqrt": _or_null(lambda x: x >= 0, F.sqrt), "log": _or_null(lambda x: x > 0, F.log),
    "log10": _or_null(lambda x: x > 0, F.log10), "log2": _or_null(lambda x: x > 0, F.log2),
    "round": lambda x, n=None: F.bround(x.cast("double"), 0 if n is None else n),
    "isna": lambda x: x.isNull() | (x.try_cast("double").isNotNull() & F.isnan(x.try_cast("double"))),
    "notna": lambda x: ~FUNCTIONS["isna"](x), "where": lambda c, a, b: F.when(c, a).otherwise(b),
    "min": lambda *x: F.least(*x), "max": lambda *x: F.greatest(*x),
}
_COMPARE = {
    ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b, ast.Lt: lambda a, b: a < b,
    ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b,
}
_ARITHMETIC = {
    ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b,
    ast.Div: lambda a, b: F.try_divide(a.cast("double"), b.cast("double")),
    ast.FloorDiv: lambda a, b: F.floor(F.try_divide(a.cast("double"), b.cast("double"))),
    ast.Mod: lambda a, b: a - b * F.floor(F.try_divide(a.cast("double"), b.cast("double"))), ast.Pow: F.pow,
}


def compile_expression(text: str, columns: list[str]) -> Column:
    """The Column of an expression over ``columns``; anything else is a ValueError."""

    def build(node) -> Column:
        match node:
            case ast.Expression(body=body):
                return build(body)
            case ast.Constant(value=int() | float() | str() | bool() | None):
                return F.lit(node.value)
            case ast.Name(id=name) if name in columns:
                return F.col(f"`{name}`")
            case ast.Name(id="pi" | "e"):
                return F.lit(getattr(math, node.id))
            case ast.UnaryOp(op=ast.USub()):
                return -build(node.operand)
            case ast.UnaryOp(op=ast.UAdd()):
                return build(node.operand)
            case ast.UnaryOp(op=ast.Not()):
                return ~build(node.operand)
            case ast.BinOp(op=op) if type(op) in _ARITHMETIC:
                return _ARITHMETIC[type(op)](build(node.left), build(node.right))
            case ast.BoolOp(op=op):
                parts = [build(v) for v in node.values]
                out = parts[0]
                for p in parts[1:]:
                    out = out & p if isinstance(op, ast.And) else out | p
                return out
            case ast.Compare():
                items = [build(x) for x in (node.left, *node.comparators)]
                out = None
                for op, a, b in zip(node.ops, items, items[1:], strict=False):
                    if type(op) not in _COMPARE:
                        raise ValueError(f"comparison {type(op).__name__} is not known")
                    one = F.coalesce(_COMPARE[type(op)](a, b), F.lit(isinstance(op, ast.NotEq)))
                    out = one if out is None else out & one
                return out
            case ast.Call(func=ast.Name(id=name), keywords=[]) if name in FUNCTIONS:
                args = [a.value if name == "round" and i == 1 and isinstance(a, ast.Constant) else build(a) for i, a in enumerate(node.args)]
                return FUNCTIONS[name](*args)
        raise ValueError(f"not allowed in an expression: {ast.unparse(node)}")

    return build(ast.parse(text, mode="eval"))
