"""Document, wide-column and key-value stores, kept as Parquet folders under one root.

Names and parameters are those of the stores whose data model they have, so scripts run unchanged; the root is
``spark.loomql.stores`` (default: ``stores`` in the warehouse folder).  All three support full reads, snapshots and keyed
upserts; documents and wide columns also timestamps, wide columns also triggers.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomql.lang.parser import COLUMN, DOCUMENT, KEY_VALUE
from loomql.functions import fresh_id
from loomql.operators.combine import add_changes, replace_rows, upsert
from loomql.operators.incremental import inserted, signed_diff
from loomql.plans.compiler import DYNAMIC, widen
from loomql.sources import paths
from loomql.sources.registry import DELETES, UPDATES, Engine, EngineError, Mode, register


class UserDefinedIdError(EngineError):
    """A timestamp scan needs generated ids, which carry their time."""


class NoVersionsError(EngineError):
    """A timestamp scan needs a table that keeps at least two versions of a cell."""


def stores_root(spark: SparkSession) -> str:
    return spark.conf.get("spark.loomql.stores", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/stores"


class Folder:
    """One collection, table or database: a Parquet folder that can be copied and replaced."""

    def __init__(self, spark: SparkSession, kind: str, *names: str):
        self.spark, self.path = spark, "/".join([stores_root(spark), kind, *map(str, names)])

    def exists(self) -> bool:
        return paths.exists(self.spark, self.path)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def replace(self, df: DataFrame) -> None:
        paths.replace_parquet(df, self.path)

    def append(self, df: DataFrame) -> None:
        df.write.mode("append").parquet(self.path)

    def drop(self) -> None:
        paths.delete(self.spark, self.path)

    def snapshot(self, target: Folder) -> None:
        """Copy everything to another folder."""
        target.replace(self.read())


class Store(Engine):
    """Common to the three: a folder, perhaps a snapshot of it."""

    combining = True
    kind = ""
    location: tuple[str, ...] = ()
    snapshot_parameter = ""

    def folder(self) -> Folder:
        return Folder(self.spark, self.kind, *[self.parameters[p] for p in self.location])

    def snapshot_folder(self) -> Folder:
        return Folder(self.spark, self.kind, *[self.parameters[p] for p in self.location[:-1]], self.parameters[self.snapshot_parameter])

    def empty(self) -> DataFrame:
        return self.spark.createDataFrame([], "_id string")

    def rows(self, folder: Folder) -> DataFrame:
        return folder.read() if folder.exists() else self.empty()

    def read(self) -> DataFrame:
        return self.rows(self.folder())

    def read_result(self) -> DataFrame | None:
        return self.read() if self.folder().exists() else None

    def marks(self) -> dict[str, int]:
        return paths.marks(self.spark, self.folder().path)

    def read_changes(self) -> DataFrame:
        mode = self.mode()
        if mode is not None and mode.name == "snapshot":
            return signed_diff(self.rows(self.snapshot_folder()), self.read())
        return super().read_changes()

    def take_snapshot(self) -> None:
        """Copy the store to the snapshot that the parameters name."""
        if self.folder().exists():
            self.folder().snapshot(self.snapshot_folder())


@register
class Documents(Store):
    """``mongodb(database_name, collection_name, ...)``: documents with ``_id``, upserted as a whole.

    Results that are only an ``_id`` are not stored.  Timestamp mode takes the insertion time from the first eight
    hexadecimal digits of generated ids, so it sees inserts alone.  That time has whole seconds: each run notes which ids of the
    second in which it began (or later ones) it has read, and the run that goes on from there takes all others from that second on.
    """

    name, dialect, kind = "mongodb", DOCUMENT, "documents"
    location, required = ("database_name", "collection_name"), ("database_name", "collection_name")
    optional = ("timestamp", "snapshot_collection_name", UPDATES, DELETES)
    snapshot_parameter = "snapshot_collection_name"
    modes = {"snapshot_collection_name": Mode("snapshot", True, True), "timestamp": Mode("timestamp", False, False)}

    def read_changes(self) -> DataFrame:
        if self.mode().name != "timestamp":
            return super().read_changes()
        rows = self.read()
        generated = F.col("_id").cast("string").rlike("^[0-9a-f]{24}$")
        if rows.where(~F.coalesce(generated, F.lit(False))).limit(1).count():
            raise UserDefinedIdError("the collection has ids that carry no time")
        since = int(self.parameters["timestamp"])
        found, seen = rows.where(self._seconds() >= since // 1000), self._seen(since)
        if paths.exists(self.spark, seen):
            known = self.spark.read.parquet(seen).withColumnRenamed("_id", "_seen")
            found = found.join(known, F.col("_id").cast("string") == F.col("_seen"), "left_anti")
        return inserted(found)

    @staticmethod
    def _seconds() -> Column:
        return F.conv(F.substring("_id", 1, 8), 16, 10).cast("long")

    def _seen(self, started: int) -> str:
        return f"{self.folder().path}.seen/{started}"

    def remember(self, rows: DataFrame, started: int) -> None:
        if "_id" not in rows.columns:
            return
        recent = rows.select(F.col("_id").cast("string").alias("_id")).where(F.col("_id").rlike("^[0-9a-f]{24}$")).where(self._seconds() >= started // 1000)
        if recent.take(1):
            recent.write.mode("overwrite").parquet(self._seen(started))

    def store(self, result: DataFrame) -> None:
        wide = widen(result)
        if "_id" not in wide.columns:
            wide = wide.withColumn("_id", fresh_id())
        others = [F.col(f"`{c}`").isNotNull() for c in wide.columns if c != "_id"]
        if others:
            keep = others[0]
            for x in others[1:]:
                keep = keep | x
            wide = wide.where(keep)
        else:
            wide = wide.limit(0)
        folder = self.folder()
        folder.replace(replace_rows(folder.read(), wide) if folder.exists() else wide)

    def combine(self, delta: DataFrame, sums: dict) -> None:
        folder, wide = self.folder(), widen(delta)
        self.store(add_changes(folder.read(), wide, sums) if folder.exists() else wide)


def cells_of(result: DataFrame) -> DataFrame:
    """(row, family, column, value) of a result: families are structs or maps, other attributes belong to no family."""
    if "_id" not in result.columns:
        raise EngineError("rows of this store need an _id")
    if isinstance(result.schema["_id"].dataType, (T.StructType, T.ArrayType, T.MapType)):
        raise EngineError("_id must be an atom")
    parts: list[Column] = []
    cell = lambda family, column, value: F.struct(F.lit(family).alias("family"), column.cast("string").alias("column"), value.cast("string").alias("value"))
    shape = "array<struct<family:string,column:string,value:string>>"
    of_map = lambda family, col: F.coalesce(F.transform(F.map_entries(col), lambda e: cell(family, e["key"], e["value"])).cast(shape), F.array().cast(shape))
    for f in result.schema.fields:
        col = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StructType):
            for g in f.dataType.fields:
                inner = col.getField(g.name)
                if isinstance(g.dataType, T.MapType):
                    parts.append(of_map(f.name, inner))
                else:
                    parts.append(F.array(cell(f.name, F.lit(g.name), inner)))
        elif isinstance(f.dataType, T.MapType):
            parts.append(of_map("default" if f.name == DYNAMIC else f.name, col))
        elif f.name != "_id":
            parts.append(F.array(cell("default", F.lit(f.name), col)))
    if not parts:
        return result.select(F.col("_id").cast("string").alias("row")).selectExpr("row", "'' AS family", "'' AS column", "'' AS value").limit(0)
    all_cells = F.concat(*parts) if len(parts) > 1 else parts[0]
    return result.select(F.col("_id").cast("string").alias("row"), F.explode(all_cells).alias("c")).select("row", "c.*").where("value IS NOT NULL")


def rows_of(cells: DataFrame, families: list[str] | None = None) -> DataFrame:
    """``_id`` and one map of cells for each family, from (row, family, column, value)."""
    if families is None:
        families = sorted(r[0] for r in cells.select("family").distinct().collect())
    entry = F.struct("column", "value")
    maps = [F.map_from_entries(F.collect_list(F.when(F.col("family") == f, entry))).alias(f) for f in families]
    grouped = cells.groupBy(F.col("row").alias("_id"))
    return grouped.agg(*maps) if maps else cells.select(F.col("row").alias("_id")).distinct()


def latest(cells: DataFrame, upto: int | None = None) -> DataFrame:
    """The newest version of each cell (not later than ``upto``; of one time the greatest value); deleted cells (null) are left out."""
    seen = cells if upto is None else cells.where(F.col("ts") <= upto)
    return seen.groupBy("row", "family", "column").agg(F.max_by("value", F.struct("ts", "value")).alias("value")).where("value IS NOT NULL")


#: Columns of a wide-column folder; ``batch`` tells which batch of a stream wrote a cell.
CELLS = "row string, family string, column string, ts long, value string, batch string"


@register
class WideColumns(Store):
    """``hbase(table_id, ...)``: versioned text cells (row, family, column, ts, value), appended and never changed.

    The type of a cell follows from its text.  Timestamp mode compares the newest versions up to that time with the newest
    of all; with ``boolean_updates_expected`` and ``boolean_deletes_expected`` both false it takes cells since then as inserts.
    """

    name, dialect, kind, dynamic = "hbase", COLUMN, "columns", True
    location, required = ("table_id",), ("table_id",)
    optional = ("timestamp", "snapshot_table_id", "triggerbased", UPDATES, DELETES)
    snapshot_parameter = "snapshot_table_id"
    modes = {"snapshot_table_id": Mode("snapshot", True, True), "timestamp": Mode("timestamp", True, False), "triggerbased": Mode("trigger", True, True)}

    def properties(self) -> dict:
        path = f"{self.folder().path}.properties"
        if not paths.exists(self.spark, path):
            return {"max_versions": 3}
        return json.loads(self.spark.read.text(path).first()[0])

    def create(self, max_versions: int = 3) -> None:
        """Set how many versions the table is declared to keep."""
        row = self.spark.createDataFrame([(json.dumps({"max_versions": max_versions}),)], "value string")
        row.write.mode("overwrite").text(f"{self.folder().path}.properties")

    def empty(self) -> DataFrame:
        return self.spark.createDataFrame([], "_id string, default map<string,string>")

    def cells(self, folder: Folder | None = None) -> DataFrame:
        """All versions of all cells."""
        return self.spark.read.schema(CELLS).parquet((folder or self.folder()).path)

    def marks(self) -> dict[str, int]:
        return {}  # a batch that comes again replaces its own cells (see ``combine``)

    def rows(self, folder: Folder) -> DataFrame:
        if not folder.exists():
            return self.empty()
        found = rows_of(latest(self.cells(folder)))
        return found if len(found.columns) > 1 else self.empty()

    def put(self, cells: DataFrame, ts: int | None = None) -> None:
        """Append versions of cells (row, family, column, value); a null value deletes a cell."""
        stamp = int(time.time() * 1000) if ts is None else ts
        batch = json.dumps(paths.current_marks(), sort_keys=True) if paths.current_marks() else None
        self.folder().append(cells.select("row", "family", "column", F.lit(stamp).cast("long").alias("ts"), F.col("value").cast("string").alias("value"), F.lit(batch).cast("string").alias("batch")))

    def read_changes(self) -> DataFrame:
        if self.mode().name != "timestamp":
            return super().read_changes()
        if self.properties()["max_versions"] < 2:
            raise NoVersionsError("the table keeps a single version of each cell")
        since, cells = int(self.parameters["timestamp"]), self.cells()
        families = sorted(r[0] for r in cells.select("family").distinct().collect())
        if self.parameters.get(UPDATES) is False and self.parameters.get(DELETES) is False:
            return inserted(rows_of(latest(cells.where(F.col("ts") > since)), families))
        return signed_diff(rows_of(latest(cells, since), families), rows_of(latest(cells), families))

    def store(self, result: DataFrame) -> None:
        self.put(cells_of(result))

    def combine(self, delta: DataFrame, sums: dict) -> None:
        """Sums are added to the newest version of their cells, others replace it."""
        new = cells_of(delta)
        if not self.folder().exists():
            return self.put(new)
        named = [F.lit(c) for family, inner in sums.items() if isinstance(inner, dict) for c, s in inner.items() if s is True and c != "*"]
        named += [F.lit(c) for c, s in sums.items() if s is True and c != "*"]
        others = any(isinstance(inner, dict) and inner.get("*") for inner in sums.values()) or bool(sums.get("*"))
        plain = [F.lit(c) for family, inner in sums.items() if isinstance(inner, dict) for c, s in inner.items() if s is False]
        is_sum = F.col("column").isin(*named) if named else F.lit(False)
        if others:
            is_sum = is_sum | (~F.col("column").isin(*plain) if plain else F.lit(True))
        held = self.cells()
        if paths.current_marks():  # what this batch wrote before a crash doesn't count
            held = held.where(~F.col("batch").eqNullSafe(F.lit(json.dumps(paths.current_marks(), sort_keys=True))))
        old = latest(held).withColumnRenamed("value", "old")
        joined = new.join(old, ["row", "family", "column"], "left")
        number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        whole = F.col("value").rlike("^-?[0-9]+$") & F.coalesce(F.col("old").rlike("^-?[0-9]+$"), F.lit(True))
        total = F.when(whole, (F.coalesce(F.col("old").cast("long"), F.lit(0)) + F.when(whole, F.col("value")).cast("long")).cast("string")).otherwise((number("old") + F.when(is_sum, F.col("value")).cast("double")).cast("string"))
        rows = joined.select("row", "family", "column", F.when(is_sum, total).otherwise(F.col("value")).alias("value"))
        self.put(rows)


@register
class KeyValues(Store):
    """``redis(database_id, ...)``: keys with one kind of value: text, a list of texts, or a hash of texts.

    Storing an atom replaces it, a list is pushed to the front of what is there (so it ends up reversed), a hash is updated
    field by field.  A missing value isn't stored.  Snapshots live in at most ``SLOTS`` databases; the one used longest ago goes.
    """

    name, dialect, kind, dynamic = "redis", KEY_VALUE, "keys", True
    location, required = ("database_id",), ("database_id",)
    optional = ("snapshot_database_id", UPDATES, DELETES)
    snapshot_parameter = "snapshot_database_id"
    modes = {"snapshot_database_id": Mode("snapshot", True, True)}
    SLOTS = 6

    def empty(self) -> DataFrame:
        return self.spark.createDataFrame([], "_id string, _v map<string,string>")

    def shaped(self, result: DataFrame) -> DataFrame:
        """A result as (_id, _v) with texts."""
        if "_id" not in result.columns:
            raise EngineError("rows of this store need a key")
        value = None
        if "_v" in result.columns:
            t = result.schema["_v"].dataType
            if isinstance(t, T.StructType):
                fixed = [f.name for f in t.fields if not isinstance(f.dataType, T.MapType)]
                value = F.create_map(*[x for c in fixed for x in (F.lit(c), F.col("_v").getField(c).cast("string"))]) if fixed else F.create_map().cast("map<string,string>")
                for f in t.fields:
                    if isinstance(f.dataType, T.MapType):
                        value = F.map_concat(value, F.coalesce(F.col("_v").getField(f.name).cast("map<string,string>"), F.create_map().cast("map<string,string>")))
                value = F.map_filter(value, lambda _, v: v.isNotNull())
            elif isinstance(t, T.MapType):
                value = F.col("_v").cast("map<string,string>")
            elif isinstance(t, T.ArrayType):
                value = F.col("_v").cast("array<string>")
            else:
                value = F.col("_v").cast("string")
        if value is None:
            return self.spark.createDataFrame([], "_id string, _v string")
        return result.select(F.col("_id").cast("string").alias("_id"), value.alias("_v")).where("_v IS NOT NULL")

    def store(self, result: DataFrame) -> None:
        new, folder = self.shaped(result), self.folder()
        t = new.schema["_v"].dataType
        if isinstance(t, T.ArrayType):
            new = new.withColumn("_v", F.reverse("_v"))
        if not folder.exists():
            return folder.replace(new)
        old = folder.read()
        if old.schema["_v"].dataType.simpleString() != t.simpleString():
            raise EngineError("the database holds another kind of value")
        if isinstance(t, (T.MapType, T.ArrayType)):
            o, n = old.withColumnRenamed("_v", "o"), new.withColumnRenamed("_v", "n")
            joined = o.join(n, "_id", "full_outer")
            if isinstance(t, T.ArrayType):
                merged = F.concat(F.coalesce("n", F.array().cast(t)), F.coalesce("o", F.array().cast(t)))
            else:
                empty = F.create_map().cast(t)
                merged = F.map_zip_with(F.coalesce("o", empty), F.coalesce("n", empty), lambda _, a, b: F.coalesce(b, a))
            return folder.replace(joined.select("_id", merged.alias("_v")))
        folder.replace(upsert(old, new))

    def combine(self, delta: DataFrame, sums: dict) -> None:
        new, folder = self.shaped(delta), self.folder()
        if not folder.exists():
            return folder.replace(new)
        old, t = folder.read(), new.schema["_v"].dataType
        how = sums.get("_v", sums)
        add = lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).when(a.rlike("^-?[0-9]+$") & b.rlike("^-?[0-9]+$"), (a.cast("decimal(38,0)") + b.cast("decimal(38,0)")).cast("string")).otherwise((a.try_cast("double") + b.try_cast("double")).cast("string"))
        joined = old.withColumnRenamed("_v", "o").join(new.withColumnRenamed("_v", "n"), "_id", "full_outer")
        if isinstance(t, T.MapType):
            empty = F.create_map().cast(t)
            named = [k for k, s in how.items() if s is True and k != "*"] if isinstance(how, dict) else []
            known = list(how) if isinstance(how, dict) else []
            rest = bool(how.get("*")) if isinstance(how, dict) else bool(how)
            is_sum = lambda k: (k.isin(named) if named else F.lit(False)) | ((~k.isin(known) if known else F.lit(True)) & F.lit(rest))
            merged = F.map_zip_with(F.coalesce("o", empty), F.coalesce("n", empty), lambda k, a, b: F.when(is_sum(k), add(a, b)).otherwise(F.coalesce(b, a)))
        else:
            merged = add(F.col("o"), F.col("n")) if how is True else F.coalesce("n", "o")
        folder.replace(joined.select("_id", merged.alias("_v")))

    def take_snapshot(self) -> None:
        super().take_snapshot()
        used = f"{stores_root(self.spark)}/{self.kind}.snapshots"
        known = [r[0] for r in self.spark.read.text(used).collect()] if paths.exists(self.spark, used) else []
        mine = str(self.parameters[self.snapshot_parameter])
        known = [mine, *[k for k in known if k != mine]]
        for gone in known[self.SLOTS :]:
            Folder(self.spark, self.kind, gone).drop()
        self.spark.createDataFrame([(k,) for k in known[: self.SLOTS]], "value string").coalesce(1).write.mode("overwrite").text(used)
