"""Registered queries that go through ``run``: scripts that read and write stores, files and streams in the scratch folder.

Each returns what a store holds at the end; its SQL gives the same from the tables alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomql import functions
from loomql.advisor import Advisor
from loomql.operators.combine import add_changes
from loomql.operators.incremental import WEIGHT, net_changes
from loomql.plans.compiler import DYNAMIC, compile_transformation
from loomql.plans.run import result, run, sums_of
from loomql.plans.scratch import new_folder
from loomql.lang.parser import parse
from loomql.sources.registry import create
from loomql.sources.stores import UserDefinedIdError
from loomql.streaming import triggers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
ROOT = "spark.loomql.stores"
SUMS = "OUT._id <- IN.type, OUT.total <- SUM(IN.value), OUT.n <- COUNT(IN._id)"
BY_TYPE = "SELECT event_type AS _id, round(sum(round(value, 2)), 2) AS total, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1"


def _stored(name: str, sql: str):
    """Decorator: register a query that gets (spark, folder of tables, a folder of its own) with a root of stores of its own."""

    def add(query: Callable[[SparkSession, str, str], DataFrame]):
        def run_alone(spark: SparkSession, sf_dir: str) -> DataFrame:
            folder, before = new_folder(spark, name), spark.conf.get(ROOT, None)
            spark.conf.set(ROOT, f"{folder}/stores")
            try:
                return query(spark, sf_dir, folder)
            finally:
                spark.conf.unset(ROOT) if before is None else spark.conf.set(ROOT, before)

        QUERIES[name], ORACLES[name] = run_alone, sql
        return query

    return add


def _plain(name: str, sql: str):
    """Decorator: register a query that needs no folder."""

    def add(query: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name], ORACLES[name] = query, sql
        return query

    return add


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as documents with text ids."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").cast("string").alias("_id"), F.col("event_type").alias("type"), F.round("value", 2).alias("value"), F.col("event_id").alias("k"))


def _older(events: DataFrame) -> DataFrame:
    """An earlier state: rows missing, rows of other values and groups, rows deleted since."""
    old = events.where("k % 10 <> 0").withColumn("value", F.when(F.col("k") % 10 == 1, F.col("value") + 10).otherwise(F.col("value")))
    old = old.withColumn("type", F.when(F.col("k") % 10 == 2, F.lit("view")).otherwise(F.col("type")))
    return old.unionByName(events.where("k % 10 = 3").withColumn("_id", F.concat(F.lit("gone"), F.col("_id"))))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("_id", F.round(F.col("total").cast("double"), 2).alias("total"), F.col("n").cast("double").cast("long").alias("n"))


def _documents(spark: SparkSession, **more):
    return create(spark, "mongodb", {"database_name": "d", "collection_name": "in", **more})


def _script(source: str, sink: str, body: str) -> str:
    return f"IN-ENGINE: {source}, OUT-ENGINE: {sink}, {body}"


IN_DOCUMENTS, OUT_DOCUMENTS = "mongodb(database_name <- 'd', collection_name <- 'in'{})", "mongodb(database_name <- 'd', collection_name <- 'out')"


# --- files


@_stored("csv_round_trip", "SELECT n_nationkey AS _id, n_name AS name, CAST(n_regionkey AS DOUBLE) * 2 AS twice, CAST(3 AS BIGINT) AS cells FROM nation")
def _csv(spark, sf_dir, folder):
    run(spark, _script(f"parquet(path <- '{sf_dir}/nation.parquet')", f"csv(path <- '{folder}/a', delimiter <- ';')", "OUT.key <- IN.n_nationkey, OUT.name <- IN.n_name, OUT.region <- IN.n_regionkey"))
    return result(spark, _script(f"csv(path <- '{folder}/a', delimiter <- ';')", "memory()", "OUT._id <- IN.key, OUT.name <- IN.name, OUT.twice <- IN.region * 2, OUT.cells <- COL_COUNT()"))


@_stored("json_round_trip", "SELECT user_id AS _id, event_type AS n, CAST(count(*) AS BIGINT) AS v FROM events GROUP BY 1, 2")
def _json(spark, sf_dir, folder):
    """Dynamic names written as JSON objects without a list of all names."""
    run(spark, _script(f"parquet(path <- '{sf_dir}/events.parquet')", f"json(path <- '{folder}/a')", "OUT._id <- IN.user_id, OUT.$(IN.event_type) <- COUNT(1)"))
    back = result(spark, _script(f"json(path <- '{folder}/a')", "memory()", "OUT._id <- IN._id, OUT.$(IN.*.name()) <- IN.@"))
    return back.select("_id", F.explode(DYNAMIC).alias("n", "v"))


@_stored("two_statements", "SELECT CAST(count(*) AS BIGINT) AS n, max(c) AS most FROM (SELECT o_custkey, CAST(count(*) AS BIGINT) AS c FROM orders GROUP BY 1)")
def _two(spark, sf_dir, folder):
    """A script whose second statement reads what the first stored."""
    first = _script(f"parquet(path <- '{sf_dir}/orders.parquet')", f"parquet(path <- '{folder}/mid')", "OUT._id <- IN.o_custkey, OUT.c <- COUNT(1)")
    run(spark, f"{first}; " + _script(f"parquet(path <- '{folder}/mid')", f"parquet(path <- '{folder}/end')", "OUT.n <- COUNT(1), OUT.most <- MAX(IN.c)"))
    return spark.read.parquet(f"{folder}/end")


# --- documents


@_stored("documents_upsert", "SELECT CAST(o_custkey AS VARCHAR) AS _id, CAST(count(*) AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS total FROM orders GROUP BY 1")
def _upsert(spark, sf_dir, folder):
    """A document that is stored again is replaced as a whole: attributes that went are gone."""
    source = f"parquet(path <- '{folder}/orders')"
    spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").cast("string").alias("customer"), "o_totalprice").write.parquet(f"{folder}/orders")
    run(spark, _script(source, OUT_DOCUMENTS, "OUT._id <- IN.customer, OUT.total <- SUM(IN.o_totalprice)"))
    run(spark, _script(source, OUT_DOCUMENTS, "OUT._id <- IN.customer, OUT.n <- COUNT(1)"))
    return create(spark, "mongodb", {"database_name": "d", "collection_name": "out"}).read().select("_id", "n", "total")


@_stored("documents_snapshot", BY_TYPE)
def _snapshot(spark, sf_dir, folder):
    new = _events(spark, sf_dir)
    _documents(spark).folder().replace(_older(new))
    run(spark, _script(IN_DOCUMENTS.format(""), OUT_DOCUMENTS, SUMS))
    _documents(spark, snapshot_collection_name="old").take_snapshot()
    _documents(spark).folder().replace(new)
    run(spark, _script(IN_DOCUMENTS.format(", snapshot_collection_name <- 'old'"), OUT_DOCUMENTS, SUMS))
    return _rounded(create(spark, "mongodb", {"database_name": "d", "collection_name": "out"}).read())


@_stored("documents_timestamp", BY_TYPE)
def _timestamp(spark, sf_dir, folder):
    """Inserts by the time in their ids: those of the second in which the first run began count once, whether it saw them or not."""
    second = 1_000 + F.col("k") % 3
    events = _events(spark, sf_dir).withColumn("_id", F.concat(F.lpad(F.lower(F.hex(second)), 8, "0"), F.lpad(F.lower(F.hex("k")), 16, "0")))
    early = events.where("k % 3 = 0 or (k % 3 = 1 and k % 2 = 0)")
    source = _documents(spark)
    source.folder().replace(early)
    source.remember(source.read(), 1_001_500)  # a run that began in the middle of second 1001
    run(spark, _script(IN_DOCUMENTS.format(""), OUT_DOCUMENTS, SUMS))
    source.folder().replace(events)
    run(spark, _script(IN_DOCUMENTS.format(", timestamp <- 1001500"), OUT_DOCUMENTS, SUMS))
    return _rounded(create(spark, "mongodb", {"database_name": "d", "collection_name": "out"}).read())


@_stored("documents_own_ids", "SELECT 'refused' AS outcome")
def _own_ids(spark, sf_dir, folder):
    """Ids that carry no time can't be read by timestamp."""
    _documents(spark).folder().replace(_events(spark, sf_dir))
    try:
        run(spark, _script(IN_DOCUMENTS.format(", timestamp <- 5"), OUT_DOCUMENTS, SUMS))
        outcome = "accepted"
    except UserDefinedIdError:
        outcome = "refused"
    return spark.range(1).select(F.lit(outcome).alias("outcome"))


def _log(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(old state, new state, change events between them, some of them undone or overtaken by later ones)."""
    new = _events(spark, sf_dir).select("_id", "type", "value")
    k = F.col("_id").cast("long")
    old = new.where(k % 4 != 0).withColumn("value", F.when(k % 4 == 1, F.col("value") * 0).otherwise(F.col("value")))
    row = lambda side: F.when(F.col(f"{side}._id").isNotNull(), F.struct(*[F.col(f"{side}.{c}") for c in new.columns]))
    both = old.alias("o").join(new.alias("n"), F.col("o._id") == F.col("n._id"), "full_outer").where("cast(n._id as long) % 4 in (0, 1)")
    middle = F.struct(F.col("n._id").alias("_id"), F.lit("between").alias("type"), F.lit(7.0).alias("value"))
    event = lambda seq, before, after: F.struct(F.lit(seq).cast("long").alias("seq"), before.alias("before"), after.alias("after"))
    events = F.array(event(1, row("o"), middle), event(2, middle, row("n")))
    return old, new, both.select(F.col("n._id").alias("_id"), F.explode(events).alias("e")).select("_id", "e.*")


@_stored("documents_stream", BY_TYPE)
def _stream(spark, sf_dir, folder):
    """Triggers: two batches of a stream of changes; starting the stream again applies nothing twice."""
    old, new, log = _log(spark, sf_dir)
    _documents(spark).folder().replace(old)
    text = _script(IN_DOCUMENTS.format(""), OUT_DOCUMENTS, SUMS)
    run(spark, text)
    for seq in (1, 2):
        log.where(F.col("seq") == seq).write.mode("append").parquet(f"{folder}/log")
        for _ in range(2):
            triggers.start(spark, text, spark.readStream.schema(log.schema).parquet(f"{folder}/log"), f"{folder}/checkpoint").awaitTermination()
    out = create(spark, "mongodb", {"database_name": "d", "collection_name": "out"}).read()
    return _rounded(out.where("type is null" if "type" in out.columns else "true")).where("_id <> 'between'")


@_stored("change_log", BY_TYPE)
def _change_log(spark, sf_dir, folder):
    """An append-only log read from a place on: events up to it are already in the result."""
    old, new, log = _log(spark, sf_dir)
    log.write.parquet(f"{folder}/log")
    (t,) = parse(_script("memory()", "memory()", SUMS))
    state = compile_transformation(t, old)
    for since, upto in ((0, 1), (1, 2)):
        part = triggers.read_log(spark, f"{folder}/log", since).where(F.col("seq") <= upto)
        state = add_changes(state, compile_transformation(t, net_changes(part), weight=WEIGHT), sums_of(t.specs))
    return _rounded(state).where("_id <> 'between'")


# --- wide columns


def _put(spark, table: str, rows: DataFrame, ts: int) -> None:
    """Rows (_id, attributes) as cells of the default family; null attributes are deleted cells."""
    names = [c for c in rows.columns if c != "_id"]
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in names])).alias("c")
    create(spark, "hbase", {"table_id": table}).put(rows.select(F.col("_id").alias("row"), F.lit("default").alias("family"), cells).select("row", "family", "c.*"), ts)


def _cells(spark, table: str, *names: str) -> DataFrame:
    return create(spark, "hbase", {"table_id": table}).read().select("_id", *[F.col("default")[c].alias(c) for c in names])


COLUMN_SUMS = "OUT._r <- IN.type, OUT.total <- SUM(IN.value), OUT.n <- COUNT(IN._r)"


@_stored("columns_round_trip", "SELECT CAST(n_nationkey AS VARCHAR) AS _id, n_name AS name, CAST(n_regionkey AS VARCHAR) AS region FROM nation")
def _columns(spark, sf_dir, folder):
    """Attributes without a family go to the default one, others to the family that their path names."""
    run(spark, _script(f"parquet(path <- '{sf_dir}/nation.parquet')", "hbase(table_id <- 't')", "OUT._id <- IN.n_nationkey, OUT.name <- IN.n_name, OUT.f:region <- IN.n_regionkey"))
    return create(spark, "hbase", {"table_id": "t"}).read().select("_id", F.col("default")["name"].alias("name"), F.col("f")["region"].alias("region"))


def _two_states(spark, sf_dir) -> DataFrame:
    new = _events(spark, sf_dir).select("_id", "type", "value")
    _put(spark, "in", _older(_events(spark, sf_dir)).where("_id not like 'gone%'").select("_id", "type", "value"), 1_000)
    run(spark, _script("hbase(table_id <- 'in')", "hbase(table_id <- 'out')", COLUMN_SUMS))
    return new


@_stored("columns_snapshot", BY_TYPE)
def _columns_snapshot(spark, sf_dir, folder):
    new = _two_states(spark, sf_dir)
    create(spark, "hbase", {"table_id": "in", "snapshot_table_id": "old"}).take_snapshot()
    _put(spark, "in", new, 2_000)
    run(spark, _script("hbase(table_id <- 'in', snapshot_table_id <- 'old')", "hbase(table_id <- 'out')", COLUMN_SUMS))
    return _rounded(_cells(spark, "out", "total", "n"))


@_stored("columns_timestamp", BY_TYPE)
def _columns_timestamp(spark, sf_dir, folder):
    """The versions of cells tell what changed since a time: inserts and updates."""
    _put(spark, "in", _two_states(spark, sf_dir), 2_000)
    run(spark, _script("hbase(table_id <- 'in', timestamp <- 1500)", "hbase(table_id <- 'out')", COLUMN_SUMS))
    return _rounded(_cells(spark, "out", "total", "n"))


@_stored("columns_inserts", BY_TYPE)
def _columns_inserts(spark, sf_dir, folder):
    """With hints that nothing is updated or deleted, cells since the time are inserts."""
    new = _events(spark, sf_dir)
    for part, ts, more in (("k % 5 <> 0", 1_000, ""), ("k % 5 = 0", 2_000, ", timestamp <- 1500, boolean_updates_expected <- false, boolean_deletes_expected <- false")):
        _put(spark, "in", new.where(part).select("_id", "type", "value"), ts)
        run(spark, _script(f"hbase(table_id <- 'in'{more})", "hbase(table_id <- 'out')", COLUMN_SUMS))
    return _rounded(_cells(spark, "out", "total", "n"))


@_stored("family_count", "SELECT CAST(n_nationkey AS VARCHAR) AS _id, CAST(2 AS BIGINT) AS f, CAST(3 AS BIGINT) AS n FROM nation")
def _family_count(spark, sf_dir, folder):
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("string").alias("_id"), F.create_map(F.lit("a"), F.col("n_name"), F.lit("b"), F.col("n_regionkey").cast("string")).alias("f"), F.create_map(F.lit("c"), F.lit("x")).alias("g"))
    (t,) = parse(_script("hbase(table_id <- 'x')", "memory()", "OUT._id <- IN._r, OUT.f <- MAX(COL_COUNT('f')), OUT.n <- MAX(COL_COUNT())"))
    return compile_transformation(t, rows, dynamic=True)


# --- keys and values


def _keys(spark, rows: DataFrame) -> None:
    create(spark, "redis", {"database_id": "in"}).folder().replace(rows)


@_stored("keys_lists", "SELECT CAST(vec_id AS VARCHAR) AS _id, CAST(list_reverse(embedding)[1] AS DOUBLE) AS first, CAST(len(embedding) AS INTEGER) AS n FROM embeddings")
def _lists(spark, sf_dir, folder):
    """Lists are pushed to the front, so a copy is reversed."""
    _keys(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("_id"), F.transform("embedding", lambda x: x.cast("double").cast("string")).alias("_v")))
    run(spark, _script("redis(database_id <- 'in')", "redis(database_id <- 'out')", "OUT._k <- IN._k, OUT._v <- IN._v"))
    return create(spark, "redis", {"database_id": "out"}).read().select("_id", F.col("_v")[0].cast("double").alias("first"), F.size("_v").alias("n"))


HASHES = "OUT._k <- IN._v.type, OUT._v <- HM(total <- SUM(IN._v.value), n <- COUNT(IN._k))"


@_stored("keys_snapshot", BY_TYPE)
def _keys_snapshot(spark, sf_dir, folder):
    """Hashes built by HM, brought up to date from a snapshot."""
    new = _events(spark, sf_dir)
    hashes = lambda df: df.select("_id", F.create_map(F.lit("type"), F.col("type"), F.lit("value"), F.col("value").cast("string")).alias("_v"))
    _keys(spark, hashes(_older(new)))
    run(spark, _script("redis(database_id <- 'in')", "redis(database_id <- 'out')", HASHES))
    create(spark, "redis", {"database_id": "in", "snapshot_database_id": "9"}).take_snapshot()
    _keys(spark, hashes(new))
    run(spark, _script("redis(database_id <- 'in', snapshot_database_id <- '9')", "redis(database_id <- 'out')", HASHES))
    return _rounded(create(spark, "redis", {"database_id": "out"}).read().select("_id", F.col("_v")["total"].alias("total"), F.col("_v")["n"].alias("n")))


# --- advisor


@_stored("advisor", BY_TYPE)
def _advisor(spark, sf_dir, folder):
    """Three runs in modes that the advisor chooses; the result is the same whatever it chooses."""
    new, advisor = _events(spark, sf_dir), Advisor(spark, randomness=0.5, seed=3)
    for state in (_older(new), new.where("k % 7 <> 0"), new):
        _documents(spark).folder().replace(state)
        advisor.evaluate(_script(IN_DOCUMENTS.format(""), OUT_DOCUMENTS, SUMS))
    return _rounded(create(spark, "mongodb", {"database_name": "d", "collection_name": "out"}).read())


# --- values and functions


def _memory(spark, rows: DataFrame, body: str) -> DataFrame:
    return result(spark, _script("memory()", "memory()", body), rows)


@_plain("deref_input", "SELECT n_nationkey AS _id, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE CAST(n_regionkey AS VARCHAR) END AS v FROM nation")
def _deref(spark, sf_dir):
    """The attribute that another attribute names."""
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").withColumn("pick", F.when(F.col("n_nationkey") % 2 == 0, "n_name").otherwise("n_regionkey"))
    return _memory(spark, rows, "OUT._id <- IN.n_nationkey, OUT.v <- IN.$(IN.pick)")


@_plain("arithmetic_many", "SELECT vec_id AS _id, round(sum(2 * CAST(x AS DOUBLE) + 1), 4) AS s FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) GROUP BY 1")
def _arithmetic_many(spark, sf_dir):
    return _memory(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "OUT._id <- IN.vec_id, OUT.s <- SUM(IN.embedding[*] * 2 + 1)").withColumn("s", F.round("s", 4))


@_plain("call_many", "SELECT vec_id AS _id, round(sum(abs(CAST(x AS DOUBLE))), 4) AS s FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) GROUP BY 1")
def _call_many(spark, sf_dir):
    return _memory(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "OUT._id <- IN.vec_id, OUT.s <- SUM(ABS(IN.embedding[*]))").withColumn("s", F.round("s", 4))


@_plain("scalar_left", "SELECT o_orderkey AS _id FROM orders WHERE 1000 < o_totalprice AND 'O' = o_orderstatus")
def _scalar_left(spark, sf_dir):
    return _memory(spark, spark.read.parquet(f"{sf_dir}/orders.parquet"), "IN-FILTER: 1000 < IN.o_totalprice && 'O' = IN.o_orderstatus, OUT._id <- IN.o_orderkey")


@_plain("aggregate_in_filter", "SELECT vec_id AS _id FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) GROUP BY 1 HAVING sum(CAST(x AS DOUBLE)) > 0.1 AND count(*) >= 2")
def _aggregate_in_filter(spark, sf_dir):
    return _memory(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "IN-FILTER: SUM(IN.embedding[*]) > 0.1 && COUNT(IN.embedding[*]) >= 2, OUT._id <- IN.vec_id")


@_stored("col_count", "SELECT c_custkey AS _id, CAST(8 AS BIGINT) AS n FROM customer")
def _col_count(spark, sf_dir, folder):
    """Attributes of tabular rows."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    filled = rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("x")).alias(c) for c in rows.columns], *[F.lit("y").alias(f"more{k}") for k in range(8 - len(rows.columns))])
    filled.select(*filled.columns[:8]).write.csv(f"{folder}/c", header=True, escape='"')
    return result(spark, _script(f"csv(path <- '{folder}/c')", "memory()", "OUT._id <- IN.c_custkey, OUT.n <- COL_COUNT()"))


@_plain("own_functions", "SELECT n_regionkey AS _id, sum(len(n_name)) AS letters, max(upper(n_name)) AS last, CAST(count(DISTINCT n_name) AS BIGINT) AS names FROM nation GROUP BY 1")
def _own_functions(spark, sf_dir):
    """A scalar function and an aggregate that a user adds."""

    @functions.register("LETTERS")
    def _letters(*arguments, root):
        return functions.Val(F.length(arguments[0].col).cast("long"), T.LongType())

    @functions.register("UPPER")
    def _upper(*arguments, root):
        return functions.Val(F.upper(arguments[0].col), T.StringType())

    @functions.register_aggregate("NAMES")
    def _names(value, *arguments):
        return F.count_distinct(value.col), T.LongType()

    try:
        out = _memory(spark, spark.read.parquet(f"{sf_dir}/nation.parquet"), "OUT._id <- IN.n_regionkey, OUT.letters <- SUM(LETTERS(IN.n_name)), OUT.last <- MAX(UPPER(IN.n_name)), OUT.names <- NAMES(IN.n_name)")
    finally:
        for name in ("LETTERS", "UPPER", "NAMES"):
            functions.unregister(name)
    return out.withColumn("letters", F.col("letters").cast("long"))
