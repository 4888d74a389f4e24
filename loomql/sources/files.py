"""File engines: parquet, csv, json, and tables held in memory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomql.lang.parser import DOCUMENT, TABULAR
from loomql.operators.combine import replace_rows
from loomql.plans.compiler import DYNAMIC, widen
from loomql.plans.values import BOOLEAN, DECIMAL, INTEGER
from loomql.sources import paths
from loomql.sources.registry import Engine, EngineError, register


@register
class Parquet(Engine):
    """``parquet(path)``: typed tables with any nesting."""

    name, dialect, required, combining = "parquet", DOCUMENT, ("path",), True

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.parameters["path"])

    def store(self, result: DataFrame) -> None:
        paths.replace_parquet(widen(result), self.parameters["path"])

    def read_result(self) -> DataFrame | None:
        return self.read() if paths.exists(self.spark, self.parameters["path"]) else None


def infer_columns(df: DataFrame) -> DataFrame:
    """Text columns with the type that all their cells share: boolean, integer, decimal, else text (one pass)."""
    cells = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not cells:
        return df
    fits = lambda c, pattern: F.min(F.when(F.col(f"`{c}`").isNotNull(), F.regexp_like(F.col(f"`{c}`"), F.lit(pattern))))
    checks = [fits(c, p).alias(f"{k}{i}") for i, c in enumerate(cells) for k, p in (("b", BOOLEAN), ("i", INTEGER), ("d", f"{INTEGER}|{DECIMAL}"))]
    found = df.agg(*checks).first()
    typed = {}
    for i, c in enumerate(cells):
        t = "boolean" if found[f"b{i}"] else "bigint" if found[f"i{i}"] else "double" if found[f"d{i}"] else None
        if t is not None:
            typed[c] = F.col(f"`{c}`").cast(t)
    return df.withColumns(typed) if typed else df


@register
class Csv(Engine):
    """``csv(path, [delimiter])``: first line names the columns; lines equal to it are dropped wherever they stand.

    Each column gets the type that all its cells fit; a column that mixes types stays text.  An empty cell is the empty string.
    """

    name, dialect, required, optional = "csv", TABULAR, ("path",), ("delimiter",)

    def read(self) -> DataFrame:
        raw = self.spark.read.csv(self.parameters["path"], header=True, sep=self.parameters.get("delimiter", ","), inferSchema=False, nullValue="\u0000", emptyValue="", escape='"')
        raw = raw.fillna("")
        again = [F.col(f"`{c}`") == c for c in raw.columns]
        repeated = again[0]
        for x in again[1:]:
            repeated = repeated & x
        return infer_columns(raw.where(~repeated))

    def store(self, result: DataFrame) -> None:
        path = self.parameters["path"]
        if paths.exists(self.spark, path):
            raise EngineError(f"{path} exists already")
        wide = widen(result)
        flat = [F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) else F.col(f"`{f.name}`") for f in wide.schema.fields]
        wide.select(*flat).write.csv(path, header=True, sep=self.parameters.get("delimiter", ","), nullValue="", emptyValue="", escape='"')


@register
class Json(Engine):
    """``json(path)``: one object a line, or an array with one object a line; a missing path has no rows, a malformed line is an error."""

    name, dialect, required, combining = "json", DOCUMENT, ("path",), True

    def read(self) -> DataFrame:
        path = self.parameters["path"]
        if not paths.exists(self.spark, path):
            return self.spark.createDataFrame([], "_id string")
        lines = self.spark.read.text(path).where("trim(value) NOT IN ('[', ']', '')").select(F.regexp_replace(F.trim("value"), ",$", "").alias("value"))
        strings = getattr(lines._jdf, "as")(self.spark.sparkContext._jvm.org.apache.spark.sql.Encoders.STRING())
        try:
            rows = DataFrame(self.spark.read.option("mode", "FAILFAST")._jreader.json(strings), self.spark)
        except Exception as error:
            raise EngineError(f"{path} holds a line that is no JSON object: {str(error)[:300]}") from error
        return rows if rows.columns else self.spark.createDataFrame([], "_id string")

    def store(self, result: DataFrame) -> None:
        """Lines of text, so that dynamic names need no list of all names."""
        fixed = F.to_json(F.struct(*[F.col(f"`{c}`") for c in result.columns if c != DYNAMIC])) if set(result.columns) != {DYNAMIC} else F.lit("{}")
        if DYNAMIC in result.columns:
            names = [c for c in result.columns if c != DYNAMIC]
            more = F.to_json(F.map_filter(DYNAMIC, lambda k, v: v.isNotNull() & ~k.isin(names)))
            bare = lambda x: F.coalesce(x, F.lit("{}")).isin("{}")
            both = F.concat(F.expr("substring(f, 1, length(f) - 1)"), F.lit(","), F.expr("substring(m, 2)"))
            lines = result.select(fixed.alias("f"), more.alias("m")).select(F.when(bare(F.col("m")), F.col("f")).when(bare(F.col("f")), F.col("m")).otherwise(both).alias("value"))
        else:
            lines = result.select(fixed.alias("value"))
        paths.replace(self.spark, self.parameters["path"], lambda staging: lines.write.text(staging))

    def read_result(self) -> DataFrame | None:
        return self.read() if paths.exists(self.spark, self.parameters["path"]) else None


#: Tables of the memory engine by name, and results that it stored.
TABLES: dict[str, DataFrame] = {}


@register
class Memory(Engine):
    """``memory([name])``: a registered DataFrame or temporary view; results are kept as plans under the name."""

    name, dialect, optional, combining = "memory", DOCUMENT, ("name",), True

    def read(self) -> DataFrame:
        name = self.parameters.get("name", "result")
        if name in TABLES:
            return TABLES[name]
        return self.spark.table(name)

    def store(self, result: DataFrame) -> None:
        name = self.parameters.get("name", "result")
        old = TABLES.get(name)
        if old is not None and "_id" in result.columns and "_id" in old.columns and set(old.columns) == set(result.columns) and DYNAMIC not in result.columns:
            result = replace_rows(old, result)
        TABLES[name] = result

    def replace(self, result: DataFrame) -> None:
        TABLES[self.parameters.get("name", "result")] = result

    def read_result(self) -> DataFrame | None:
        return TABLES.get(self.parameters.get("name", "result"))
