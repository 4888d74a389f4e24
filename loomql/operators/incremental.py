"""Changes of a table as signed rows: every changed row as (old, -1) and (new, +1).

Filters, expressions and groupings then apply to either row alone, and weighted sums of them are the change of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WEIGHT = "_weight"


def _comparable(df: DataFrame) -> Column:
    """The row in a form that null-safe equality compares: maps as text with sorted keys."""

    def plain(col: Column, t: T.DataType) -> Column:
        if isinstance(t, T.MapType):
            entries = F.array_sort(F.transform(F.map_entries(col), lambda e: F.struct(e["key"].cast("string").alias("k"), F.to_json(F.struct(e["value"])).alias("v"))))
            return F.when(col.isNotNull(), F.to_json(entries))
        if isinstance(t, (T.StructType, T.ArrayType, T.VariantType)):
            return F.to_json(col)
        return col

    return F.struct(*[plain(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def align(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables with the columns of either (missing ones null), in one order and with one type each."""
    types = {f.name: f.dataType for f in old.schema.fields} | {f.name: f.dataType for f in new.schema.fields}
    cols = lambda df: [F.col(f"`{c}`").cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in types.items()]
    return old.select(*cols(old)), new.select(*cols(new))


def _digests(df: DataFrame) -> list[Column]:
    """128 bits of each row as two longs; nulls count by their place."""
    c = _comparable(df)
    cells = [x for f in df.schema.fields for x in (c.getField(f.name), c.getField(f.name).isNull())]
    return [F.xxhash64(*cells), F.xxhash64(F.lit("second"), *cells)]


def signed_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` that differ from ``old`` (+1) and rows of ``old`` that differ from ``new`` (-1), by ``_id``.

    Only ``_id`` and a digest of 128 bits of each row are shuffled; the changed rows are then fetched by their ``_id``, so
    the cost of wide rows follows the changes.  An ``_id`` that occurs twice on a side is an error when the result is computed.
    """
    old, new = align(old, new)

    def marked(df: DataFrame, side: int) -> DataFrame:
        first, second = _digests(df)
        return df.select("_id", F.lit(side).alias("s"), first.alias("a"), second.alias("b"))

    of = lambda side, x: F.max(F.when(F.col("s") == side, F.col(x))).alias(f"{x}{side}")
    times = [F.count(F.when(F.col("s") == side, 1)).alias(f"n{side}") for side in (0, 1)]
    ids = marked(old, 0).unionByName(marked(new, 1)).groupBy("_id").agg(*[of(side, x) for side in (0, 1) for x in "ab"], *times)
    twice = F.raise_error(F.concat(F.lit("an _id occurs more than once: "), F.to_json(F.struct("_id")))).cast("boolean")
    differ = ~(F.col("a0").eqNullSafe(F.col("a1")) & F.col("b0").eqNullSafe(F.col("b1")))
    changed = ids.where(F.when(F.greatest("n0", "n1") > 1, twice).otherwise(differ)).select(F.col("_id").alias("_changed"))
    rows = lambda df, weight: df.join(changed, F.col("_id").eqNullSafe(F.col("_changed")), "left_semi").withColumn(WEIGHT, F.lit(weight))
    return rows(old, -1).unionByName(rows(new, 1))


def inserted(rows: DataFrame) -> DataFrame:
    """Rows that are all new."""
    return rows.withColumn(WEIGHT, F.lit(1))


def require_unique(df: DataFrame, what: str) -> None:
    """Raise if an ``_id`` occurs twice: a join on it would multiply rows."""
    twice = df.groupBy("_id").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{what}: _id {twice[0]['_id']!r} occurs {twice[0]['count']} times")


def net_changes(log: DataFrame, order: str = "seq") -> DataFrame:
    """Signed rows from change events (``_id``, ``order``, ``before``, ``after``): the first ``before`` and last ``after`` of each ``_id``.

    A row that was put several times counts once; one that is back to what it was not at all.
    """
    ends = log.groupBy("_id").agg(F.min_by(F.struct("before"), order).alias("b"), F.max_by(F.struct("after"), order).alias("a"))
    changed = ends.where(~F.to_json("b").eqNullSafe(F.to_json("a")))
    rows = F.array(F.struct(F.col("b.before").alias("r"), F.lit(-1).alias("w")), F.struct(F.col("a.after").alias("r"), F.lit(1).alias("w")))
    return changed.select(F.explode(rows).alias("x")).where("x.r IS NOT NULL").select("x.r.*", F.col("x.w").alias(WEIGHT))
