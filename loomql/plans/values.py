"""Typed column expressions with the language's value semantics.

Missing is NULL.  Arithmetic is in doubles and division never fails.  Comparisons are strict about classes of values:
a number is never less than a string, booleans and dates have no order.  ``dynamic`` marks text cells of
stores without types, whose class follows from each value.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGER, DECIMAL, BOOLEAN = r"^-?[0-9]+$", r"^-?[0-9]+\.(?:[0-9]*|[0-9]+[Ee][0-9]+)$", r"^(?i:true|false)$"
NUMBER = rf"{INTEGER}|{DECIMAL}"


class CompileError(ValueError):
    """The statement can't be evaluated over this source."""


@dataclass(frozen=True)
class Val:
    """A value expression; ``name`` and ``position`` tell where it was bound."""

    col: Column
    dtype: T.DataType
    dynamic: bool = False
    name: Column | None = None
    position: Column | None = None


def kind(v: Val) -> str:
    """number, string, boolean, date, dynamic or complex."""
    t = v.dtype
    if v.dynamic and isinstance(t, T.StringType):
        return "dynamic"
    if isinstance(t, T.NumericType):
        return "number"
    if isinstance(t, T.StringType):
        return "string"
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "date"
    return "complex"


def literal(value) -> Val:
    kinds = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType()}
    return Val(F.lit(value).cast(kinds[type(value)]), kinds[type(value)])


def _is_number(col: Column) -> Column:
    return F.regexp_like(col, F.lit(NUMBER))


def _inferred(col: Column) -> Column:
    return F.when(_is_number(col), col.cast("double"))


def number(v: Val, where: str) -> Column:
    """The value as a double; an error where it can't be a number."""
    k = kind(v)
    if k == "number":
        return v.col.cast("double")
    if k == "dynamic":
        bad = F.raise_error(F.concat(F.lit(f"{where} needs numbers, found: "), v.col))
        return F.when(v.col.isNotNull(), F.when(_is_number(v.col), v.col.cast("double")).otherwise(bad.cast("double")))
    raise CompileError(f"{where} needs numbers, not {v.dtype.simpleString()}")


def arithmetic(op: str, a: Val, b: Val) -> Val:
    x, y = number(a, op), number(b, op)
    if op == "/":
        infinity = F.when(x == 0, F.lit(float("nan"))).when(F.isnan(x), F.lit(float("nan"))).when(x > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
        col = F.when(y == 0, F.when(x.isNotNull(), infinity)).otherwise(x / F.when(y != 0, y))
    else:
        col = {"+": x + y, "-": x - y, "*": x * y}[op]
    return Val(col, T.DoubleType())


_OPS = {
    "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
    "=": lambda a, b: a == b, "!=": lambda a, b: a != b,
}


def compare(op: str, a: Val, b: Val) -> Column:
    """The comparison; NULL where a side is missing."""
    f, ka, kb = _OPS[op], kind(a), kind(b)
    both = a.col.isNotNull() & b.col.isNotNull()
    differ = F.when(both, F.lit(op == "!="))  # values of different classes
    if "dynamic" in (ka, kb):
        if ka == kb:
            na, nb = _inferred(a.col), _inferred(b.col)
            text = F.when(na.isNull() & nb.isNull(), f(a.col, b.col)).otherwise(F.lit(op == "!="))
            return F.when(both, F.when(na.isNotNull() & nb.isNotNull(), f(na, nb)).otherwise(text))
        cell, other, turned = (a, kb, False) if ka == "dynamic" else (b, ka, True)
        fixed = b if not turned else a
        g = (lambda x: f(x, fixed.col)) if not turned else (lambda x: f(fixed.col, x))
        if other == "number":
            n = _inferred(cell.col)
            return F.when(both, F.when(n.isNotNull(), g(n)).otherwise(F.lit(op == "!=")))
        if other == "string":
            plain = ~_is_number(cell.col) & ~F.regexp_like(cell.col, F.lit(BOOLEAN))
            return F.when(both, F.when(plain, g(cell.col)).otherwise(F.lit(op == "!=")))
        if other == "boolean" and op in ("=", "!="):
            is_bool = F.regexp_like(cell.col, F.lit(BOOLEAN))
            return F.when(both, F.when(is_bool, g(F.lower(cell.col) == "true")).otherwise(F.lit(op == "!=")))
        return differ
    if ka != kb or ka == "complex" and a.dtype != b.dtype:
        return differ
    if op in ("=", "!="):
        if ka == "complex":
            same = F.to_json(a.col) == F.to_json(b.col)
            return same if op == "=" else ~same
        return f(a.col, b.col)
    return f(a.col, b.col) if ka in ("number", "string") else F.when(both, F.lit(False))


def common(types: list[T.DataType]) -> T.DataType:
    """One type that can hold children of these types: numbers stay numbers, a mixture becomes text."""
    if not types:
        return T.StringType()
    if all(t == types[0] for t in types):
        return types[0]
    if all(isinstance(t, T.IntegralType) for t in types):
        return T.LongType()
    if all(isinstance(t, T.NumericType) for t in types):
        return T.DoubleType()
    return T.StringType()


def as_type(col: Column, have: T.DataType, want: T.DataType) -> Column:
    if have == want:
        return col
    if isinstance(want, T.StringType) and isinstance(have, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(col)
    return col.cast(want)


def tokens(v: Val, delimiter: str) -> Column:
    """Split by a regular expression; trailing empty strings go, an empty text has one empty token."""
    if kind(v) not in ("string", "dynamic"):
        raise CompileError("split() needs a string")
    last = lambda p: F.array_max(F.transform(p, lambda x, i: F.when(x != "", i + 1).otherwise(0)))
    whole = lambda p: (F.size(p) == 1) | (F.element_at(p, -1) != "")
    # the lambda gives the pieces a name, so that the text is split once
    kept = F.transform(F.array(F.split(v.col, delimiter, -1)), lambda p: F.when(whole(p) & ((F.size(p) > 1) | (v.col == "") | (p[0] != "")), p).otherwise(F.slice(p, 1, last(p))))
    return F.get(kept, 0)
