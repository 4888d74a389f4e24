"""Scalar functions by name; users add theirs with ``register``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomql.plans.values import CompileError, Val, number

#: Name → (dialects or None for all, builder of a Val from Vals and the root's schema).
_FUNCTIONS: dict[str, list[tuple[frozenset[str] | None, Callable]]] = {}


def register(name: str, dialects: tuple[str, ...] | None = None):
    """Decorator: make ``build(*arguments: Val, root) -> Val`` callable as ``name`` (in some dialects only)."""

    def add(build: Callable) -> Callable:
        _FUNCTIONS.setdefault(name, []).insert(0, (frozenset(dialects) if dialects else None, build))
        return build

    return add


def unregister(name: str) -> None:
    _FUNCTIONS.pop(name, None)
    _AGGREGATES.pop(name, None)


#: Aggregates that users add: name → builder of (aggregate column, type) from a Val.
_AGGREGATES: dict[str, Callable] = {}


def register_aggregate(name: str):
    """Decorator: make ``build(value: Val, *arguments) -> (Column, DataType)`` an aggregate called ``name``.

    The column is an aggregate expression over ``value.col``: built-in functions, or a grouped-aggregate Pandas UDF.
    """

    def add(build: Callable) -> Callable:
        _AGGREGATES[name] = build
        return build

    return add


def own_aggregate(name: str) -> Callable | None:
    return _AGGREGATES.get(name)


def lookup(name: str, in_dialect: str, out_dialect: str) -> Callable:
    """The function for the source's dialect, else the sink's, else the one of all dialects."""
    found = _FUNCTIONS.get(name, [])
    for dialect in (in_dialect, out_dialect, None):
        for dialects, build in found:
            if dialect is None and dialects is None or dialects is not None and dialect in dialects:
                return build
    raise CompileError(f"unknown function {name}")


def _one(arguments: tuple[Val, ...], name: str) -> Val:
    if len(arguments) != 1:
        raise CompileError(f"{name} takes one argument")
    return arguments[0]


@register("PI")
def _pi(*arguments: Val, root) -> Val:
    return Val(F.pi(), T.DoubleType())


@register("EXP")
def _exp(*arguments: Val, root) -> Val:
    return Val(F.exp(number(_one(arguments, "EXP"), "EXP")), T.DoubleType())


@register("SQRT")
def _sqrt(*arguments: Val, root) -> Val:
    return Val(F.sqrt(number(_one(arguments, "SQRT"), "SQRT")), T.DoubleType())


@register("ABS")
def _abs(*arguments: Val, root) -> Val:
    return Val(F.abs(number(_one(arguments, "ABS"), "ABS")), T.DoubleType())


@register("COL_COUNT", ("tabular",))
def _col_count(*arguments: Val, root) -> Val:
    """Attributes of the row that are present."""
    cells = [F.when(F.col(f"`{f.name}`").isNotNull(), 1).otherwise(0) for f in root.fields]
    return Val(sum(cells, F.lit(0)).cast("long"), T.LongType())


@register("COL_COUNT", ("column",))
def _cell_count(*arguments: Val, root) -> Val:
    """Cells of the row, or of the family that a string names."""
    families = [f.name for f in root.fields if isinstance(f.dataType, T.MapType)]
    cells = {f: F.coalesce(F.size(F.map_keys(F.col(f"`{f}`"))), F.lit(0)) for f in families}
    sizes = [F.when(arguments[0].col == f, n).otherwise(0) if arguments else n for f, n in cells.items()]
    return Val(sum(sizes, F.lit(0)).cast("long"), T.LongType())


@register("LIST_COUNT", ("document", "key-value"))
def _list_count(*arguments: Val, root) -> Val:
    v = _one(arguments, "LIST_COUNT")
    if isinstance(v.dtype, T.ArrayType):
        n = F.size(v.col)
    elif isinstance(v.dtype, T.MapType):
        n = F.size(F.map_keys(v.col))
    elif isinstance(v.dtype, T.StructType):
        n = sum((F.when(v.col.getField(f.name).isNotNull(), 1).otherwise(0) for f in v.dtype.fields), F.lit(0))
    else:
        raise CompileError("LIST_COUNT needs a list or an object")
    return Val(F.when(v.col.isNotNull(), n).cast("long"), T.LongType())


@register("HASH", ("document",))
def _hash(*arguments: Val, root) -> Val:
    """MD5 of the text in hexadecimal without leading zeros."""
    v = _one(arguments, "HASH")
    return Val(F.ltrim(F.md5(v.col.cast("string").cast("binary")), F.lit("0")), T.StringType())


def fresh_id() -> Column:
    """A new id of 24 hexadecimal digits; the first eight are the time in seconds."""
    return F.concat(F.lpad(F.lower(F.hex(F.unix_seconds(F.current_timestamp()))), 8, "0"), F.substring(F.regexp_replace(F.expr("uuid()"), "-", ""), 1, 16))


@register("OBJECT_ID", ("document",))
def _object_id(*arguments: Val, root) -> Val:
    """A fresh id of 24 hexadecimal digits."""
    return Val(fresh_id(), T.StringType())
