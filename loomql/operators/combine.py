"""Combining results: keyed upsert and addition of changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _pairs(old: DataFrame, new: DataFrame) -> tuple[DataFrame, list[str], dict[str, T.DataType]]:
    """Full outer join on ``_id``: columns o (old row), n (new row), ``_id``; all attributes and their types."""
    names = list(dict.fromkeys([*old.columns, *new.columns]))
    types = {f.name: f.dataType for f in old.schema.fields} | {f.name: f.dataType for f in new.schema.fields}
    row = lambda df: F.struct(*[F.col(f"`{c}`") for c in df.columns])
    o = old.select(F.col("_id").alias("_o"), row(old).alias("o"))
    n = new.select(F.col("_id").alias("_n"), row(new).alias("n"))
    return o.join(n, F.col("_o").eqNullSafe(F.col("_n")), "full_outer"), names, types


def _of(side: str, df: DataFrame, name: str, t: T.DataType) -> Column:
    return F.col(f"{side}.`{name}`").cast(t) if name in df.columns else F.lit(None).cast(t)


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old rows with the attributes that new rows of the same ``_id`` give, and the new rows."""
    joined, names, types = _pairs(old, new)
    return joined.select(*[F.coalesce(_of("n", new, c, types[c]), _of("o", old, c, types[c])).alias(c) for c in names])


def replace_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    """New rows, and the old rows whose ``_id`` is not among theirs; attributes that only one side has are null on the other."""
    joined, names, types = _pairs(old, new)
    return joined.select(*[F.when(F.col("n").isNotNull(), _of("n", new, c, types[c])).otherwise(_of("o", old, c, types[c])).alias(c) for c in names])


def add_changes(old: DataFrame, delta: DataFrame, sums: dict) -> DataFrame:
    """Results after a change: attributes in ``sums`` (a tree of names; True for a sum) are old plus delta, others new or else old;
    the name * stands for attributes that aren't named.

    Maps of dynamic attributes add by name.  Sums stay in double (or long for counts).
    """
    joined, names, types = _pairs(old, delta)

    def merge(o: Column, n: Column, t: T.DataType, how) -> Column:
        if how is True and isinstance(t, T.NumericType):
            both = F.coalesce(o, F.lit(0).cast(t)) + F.coalesce(n, F.lit(0).cast(t))
            return F.when(o.isNotNull() | n.isNotNull(), both.cast(t))
        if isinstance(t, T.StructType) and isinstance(how, dict):
            inner = F.struct(*[merge(o.getField(f.name), n.getField(f.name), f.dataType, how.get(f.name, False)).alias(f.name) for f in t.fields])
            return F.when(o.isNotNull() | n.isNotNull(), inner)
        if isinstance(t, T.MapType) and how:
            empty = F.create_map().cast(t)
            zipped = F.map_zip_with(F.coalesce(o, empty), F.coalesce(n, empty), lambda _, a, b: merge(a, b, t.valueType, how is True or how.get("*", True) if isinstance(how, dict) else True))
            return F.when(o.isNotNull() | n.isNotNull(), zipped)
        if isinstance(t, T.MapType):
            empty = F.create_map().cast(t)
            zipped = F.map_zip_with(F.coalesce(o, empty), F.coalesce(n, empty), lambda _, a, b: F.coalesce(b, a))
            return F.when(o.isNotNull() | n.isNotNull(), zipped)
        return F.coalesce(n, o)

    return joined.select(*[merge(_of("o", old, c, types[c]), _of("n", delta, c, types[c]), types[c], sums.get(c, sums.get("*", False) if c != "_id" else False)).alias(c) for c in names])
