"""Registered queries of the transformation engine and their SQL counterparts.

Each query is a script over the given tables, or an incremental run whose result must equal full recomputation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomql.lang.parser import parse
from loomql.operators.combine import add_changes, upsert
from loomql.operators.incremental import WEIGHT, inserted, net_changes, signed_diff
from loomql.plans.compiler import DYNAMIC, compile_transformation, widen
from loomql.plans.run import result, sums_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def script(table: str, body: str, sf_dir: str) -> str:
    return f"IN-ENGINE: parquet(path <- '{sf_dir}/{table}.parquet'), OUT-ENGINE: memory(), {body}"


def _plain(name: str, table: str, body: str, sql: str, then: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Register a script over one table with its SQL."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = result(spark, script(table, body, sf_dir))
        return then(out) if then else out

    QUERIES[name], ORACLES[name] = query, sql


def _rounded(digits: int, *columns: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.withColumns({c: F.round(c, digits) for c in columns})


# --- projection, filters
_plain("copy_project", "customer", "OUT._id <- IN.c_custkey, OUT.name <- IN.c_name", "SELECT c_custkey AS _id, c_name AS name FROM customer")
_plain("filter_rel", "orders", "IN-FILTER: IN.o_totalprice > 1000 && IN.o_orderstatus != 'F', OUT._id <- IN.o_orderkey, OUT.total <- IN.o_totalprice", "SELECT o_orderkey AS _id, o_totalprice AS total FROM orders WHERE o_totalprice > 1000 AND o_orderstatus <> 'F'")
_plain(
    "filter_bool", "lineitem", "IN-FILTER: (IN.l_quantity >= 10 && IN.l_discount < 0.05) || !(IN.l_returnflag = 'N'), OUT._id <- IN.l_returnflag, OUT.n <- COUNT(IN.l_orderkey)",
    "SELECT l_returnflag AS _id, count(l_orderkey) AS n FROM lineitem WHERE (l_quantity >= 10 AND l_discount < 0.05) OR NOT (l_returnflag = 'N') GROUP BY 1",
)
_plain("filter_not_missing", "events", "IN-FILTER: !(IN.no_such_attribute = 5), OUT._id <- IN.event_type, OUT.n <- COUNT(1)", "SELECT event_type AS _id, count(*) AS n FROM events GROUP BY 1")
_plain("filter_exists", "events", "IN-FILTER: IN.value && !IN.no_such_attribute, OUT._id <- IN.event_type, OUT.n <- COUNT(IN.value)", "SELECT event_type AS _id, count(value) AS n FROM events WHERE value IS NOT NULL GROUP BY 1")
_plain("filter_expression", "part", "IN-FILTER: IN.p_size * 2 + 1 > 50, OUT._id <- IN.p_partkey, OUT.size <- IN.p_size", "SELECT p_partkey AS _id, p_size AS size FROM part WHERE p_size * 2 + 1 > 50")
_plain("filter_class_strict", "part", "IN-FILTER: IN.p_size < 'zzz' || IN.p_brand != 5, OUT.n <- COUNT(1)", "SELECT count(*) AS n FROM part WHERE p_brand IS NOT NULL")
_plain("out_filter", "orders", "OUT-FILTER: IN.n > 2900, OUT._id <- IN.o_orderpriority, OUT.n <- COUNT(1)", "SELECT o_orderpriority AS _id, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 2900")

# --- aggregation
_plain("sum_count_group", "orders", "OUT._id <- IN.o_orderpriority, OUT.total <- SUM(IN.o_totalprice), OUT.n <- COUNT(IN.o_orderkey)", "SELECT o_orderpriority AS _id, round(sum(o_totalprice), 2) AS total, count(o_orderkey) AS n FROM orders GROUP BY 1", _rounded(2, "total"))
_plain("global_agg", "lineitem", "OUT.total <- SUM(IN.l_quantity), OUT.n <- COUNT(1)", "SELECT round(sum(l_quantity), 2) AS total, count(*) AS n FROM lineitem", _rounded(2, "total"))
_plain("constant_id", "lineitem", "OUT._id <- 'result', OUT.total <- SUM(IN.l_quantity)", "SELECT 'result' AS _id, round(sum(l_quantity), 2) AS total FROM lineitem", _rounded(2, "total"))
_plain("implicit_group", "lineitem", "OUT.flag <- IN.l_returnflag, OUT.status <- IN.l_linestatus, OUT.n <- COUNT(1), OUT.qty <- SUM(IN.l_quantity)", "SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY 1, 2", _rounded(2, "qty"))
_plain("implicit_distinct", "lineitem", "OUT.flag <- IN.l_returnflag, OUT.status <- IN.l_linestatus", "SELECT DISTINCT l_returnflag AS flag, l_linestatus AS status FROM lineitem")
_plain("first_of_group", "customer", "OUT._id <- IN.c_nationkey, OUT.segment <- IN.c_mktsegment", "SELECT c_nationkey AS _id, min(c_mktsegment) AS segment FROM customer GROUP BY 1")
_plain("avg_minmax", "part", "OUT._id <- IN.p_brand, OUT.mean <- AVG(IN.p_retailprice), OUT.low <- MIN(IN.p_size), OUT.high <- MAX(IN.p_name)", "SELECT p_brand AS _id, round(avg(p_retailprice), 4) AS mean, min(p_size) AS low, max(p_name) AS high FROM part GROUP BY 1", _rounded(4, "mean"))
_plain("implode_sorted", "nation", "OUT._id <- IN.n_regionkey, OUT.names <- IMPLODE(IN.n_name, ';')", "SELECT n_regionkey AS _id, string_agg(n_name, ';' ORDER BY n_name) AS names FROM nation GROUP BY 1")
_plain("list_distinct", "orders", "OUT._id <- IN.o_orderstatus, OUT.prios <- LIST(IN.o_orderpriority)", "SELECT o_orderstatus AS _id, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS prios FROM orders GROUP BY 1", lambda df: df.withColumn("prios", F.array_join("prios", ",")))
_plain(
    "list_nested", "orders", "OUT._id <- IN.o_orderpriority, OUT.statuses <- LIST(OBJECT(s <- IN.o_orderstatus, n <- COUNT(1))), OUT.n <- COUNT(1)",
    "SELECT p AS _id, string_agg(s || '=' || n, ',' ORDER BY s) AS statuses, CAST(sum(n) AS BIGINT) AS n FROM (SELECT o_orderpriority AS p, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1",
    lambda df: df.withColumn("statuses", F.array_join(F.transform("statuses", lambda x: F.concat(x["s"], F.lit("="), x["n"].cast("string"))), ",")),
)
_plain(
    "object_nested", "orders", "OUT._id <- IN.o_orderstatus, OUT.stats.total <- SUM(IN.o_totalprice), OUT.stats.count.orders <- COUNT(1), OUT.pick <- OBJECT(most <- MAX(IN.o_totalprice))",
    "SELECT o_orderstatus AS _id, round(sum(o_totalprice), 2) AS total, count(*) AS orders, max(o_totalprice) AS most FROM orders GROUP BY 1",
    lambda df: df.select("_id", F.round("stats.total", 2).alias("total"), F.col("stats.count.orders").alias("orders"), F.col("pick.most").alias("most")),
)
_plain("arith_row", "lineitem", "OUT._id <- IN.l_returnflag, OUT.revenue <- SUM(IN.l_extendedprice*(1-IN.l_discount))", "SELECT l_returnflag AS _id, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY 1", _rounded(2, "revenue"))
_plain("arith_over_agg", "lineitem", "OUT._id <- IN.l_returnflag, OUT.mean <- SUM(IN.l_quantity) / COUNT(IN.l_quantity) + 1", "SELECT l_returnflag AS _id, round(sum(l_quantity) / count(l_quantity) + 1, 6) AS mean FROM lineitem GROUP BY 1", _rounded(6, "mean"))
_plain(
    "div_by_zero", "region", "OUT._id <- IN.r_regionkey, OUT.up <- 1 / (IN.r_regionkey - 1), OUT.none <- (IN.r_regionkey - 1) / (IN.r_regionkey - 1)",
    "SELECT r_regionkey AS _id, CASE WHEN r_regionkey = 1 THEN 'Infinity' ELSE CAST(round(1.0 / (r_regionkey - 1), 4) AS VARCHAR) END AS up, r_regionkey = 1 AS none FROM region",
    lambda df: df.select("_id", F.when(F.col("up") == float("inf"), "Infinity").otherwise(F.format_number("up", 4)).alias("up"), F.isnan("none").alias("none")),
)
ORACLES["div_by_zero"] = "SELECT r_regionkey AS _id, CASE WHEN r_regionkey = 1 THEN 'Infinity' ELSE printf('%.4f', 1.0 / (r_regionkey - 1)) END AS up, r_regionkey = 1 AS none FROM region"

# --- functions
_plain(
    "math_funcs", "supplier", "OUT._id <- IN.s_suppkey, OUT.a <- ABS(IN.s_acctbal), OUT.r <- SQRT(ABS(IN.s_acctbal)), OUT.e <- EXP(IN.s_nationkey / 10), OUT.p <- PI() * 2",
    "SELECT s_suppkey AS _id, abs(s_acctbal) AS a, round(sqrt(abs(s_acctbal)), 6) AS r, round(exp(s_nationkey / 10.0), 6) AS e, round(pi() * 2, 6) AS p FROM supplier", _rounded(6, "r", "e", "p"),
)
_plain("hash_fn", "nation", "OUT._id <- IN.n_nationkey, OUT.h <- HASH(IN.n_name)", "SELECT n_nationkey AS _id, ltrim(md5(n_name), '0') AS h FROM nation")
_plain("list_count", "embeddings", "OUT._id <- IN.vec_id, OUT.n <- LIST_COUNT(IN.embedding)", "SELECT vec_id AS _id, CAST(len(embedding) AS BIGINT) AS n FROM embeddings")
_plain("object_id", "nation", "OUT._id <- IN.n_regionkey, OUT.id <- OBJECT_ID(), OUT.n <- COUNT(1)", "SELECT n_regionkey AS _id, 24 AS len, count(*) AS n FROM nation GROUP BY 1", lambda df: df.select("_id", F.length("id").alias("len"), "n"))

# --- paths
_plain("word_count", "documents", "OUT._id <- IN.text.split(' ')[*], OUT.n <- COUNT(1)", "SELECT w AS _id, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents) GROUP BY 1")
_plain("list_index", "embeddings", "OUT._id <- IN.vec_id, OUT.first <- IN.embedding[0], OUT.none <- IN.embedding[99]", "SELECT vec_id AS _id, embedding[1] AS first, CAST(NULL AS FLOAT) AS none FROM embeddings")
_plain("horiz_sum", "embeddings", "OUT._id <- IN.label, OUT.s <- SUM(IN.embedding[*]), OUT.n <- COUNT(IN.embedding[*])", "SELECT label AS _id, round(sum(list_sum([CAST(x AS DOUBLE) FOR x IN embedding])), 3) AS s, CAST(sum(len(embedding)) AS BIGINT) AS n FROM embeddings GROUP BY 1", _rounded(3, "s"))
ORACLES["horiz_sum"] = "SELECT label AS _id, round(sum(CAST(x AS DOUBLE)), 3) AS s, count(*) AS n FROM (SELECT label, unnest(embedding) AS x FROM embeddings) GROUP BY 1"
_plain("predicate_step", "embeddings", "OUT._id <- IN.vec_id, OUT.n <- COUNT(IN.embedding[?(@ > 0)])", "SELECT v AS _id, CAST(sum(CASE WHEN x > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n FROM (SELECT vec_id AS v, unnest(embedding) AS x FROM embeddings) GROUP BY 1")
_plain("index_method", "embeddings", "OUT._id <- IN.embedding[*].index(), OUT.s <- MAX(IN.embedding[@])", "SELECT i AS _id, max(x) AS s FROM (SELECT unnest(range(len(embedding))) AS i, unnest(embedding) AS x FROM embeddings) GROUP BY 1")
_plain("any_compare", "embeddings", "IN-FILTER: IN.embedding[*] > 0.35, OUT._id <- IN.vec_id, OUT.label <- IN.label", "SELECT DISTINCT v AS _id, l AS label FROM (SELECT vec_id AS v, label AS l, unnest(embedding) AS x FROM embeddings) WHERE x > 0.35")
_plain("wildcard_copy", "region", "OUT._id <- IN.r_regionkey, OUT.$(IN.*.name()) <- IN.@", "SELECT r_regionkey AS _id, r_name, CAST(r_regionkey AS VARCHAR) AS r_regionkey FROM region", widen)
_plain(
    "transpose", "region", "OUT._id <- IN.*.name(), OUT.$(IN.r_name) <- IN.@",
    "SELECT 'r_name' AS _id, r_name AS n, r_name AS v FROM region UNION ALL SELECT 'r_regionkey', r_name, CAST(r_regionkey AS VARCHAR) FROM region",
    lambda df: df.select("_id", F.explode(DYNAMIC).alias("n", "v")),
)
_plain(
    "dynamic_pivot", "events", "OUT._id <- IN.user_id, OUT.$(IN.event_type) <- SUM(IN.value)",
    "SELECT user_id AS _id, event_type AS n, round(sum(value), 4) AS v FROM events GROUP BY 1, 2",
    lambda df: df.select("_id", F.explode(DYNAMIC).alias("n", "v")).withColumn("v", F.round("v", 4)),
)
_plain(
    "dynamic_and_static", "events", "OUT._id <- IN.user_id, OUT.$(IN.event_type) <- COUNT(1), OUT.total <- COUNT(IN.event_id)",
    "SELECT user_id AS _id, count(event_id) AS total, CAST(count(*) FILTER (WHERE event_type = 'click') AS BIGINT) AS clicks FROM events GROUP BY 1",
    lambda df: df.select("_id", "total", F.coalesce(F.try_element_at(DYNAMIC, F.lit("click")), F.lit(0)).alias("clicks")),
)
_plain("ignored_attr", "events", "OUT._ <- IN.user_id, OUT.type <- IN.event_type, OUT.n <- COUNT(1)", "SELECT event_type AS type, count(*) AS n FROM events GROUP BY user_id, event_type")


def _json_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested attribute of a parsed JSON column."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("props", F.from_json("props", "k bigint"))
    return result(spark, "IN-ENGINE: memory(), OUT-ENGINE: memory(), OUT._id <- IN.props.k, OUT.n <- COUNT(IN.event_id)", rows)


QUERIES["json_path"] = _json_path
ORACLES["json_path"] = "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS _id, count(event_id) AS n FROM events GROUP BY 1"


def _nested_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of objects: one binding gives the key, the same child gives the values."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").groupBy(F.col("n_regionkey").alias("_id")).agg(F.array_sort(F.collect_list(F.struct(F.col("n_name").alias("name"), F.col("n_nationkey").alias("key")))).alias("nations"))
    out = result(spark, "IN-ENGINE: memory(), OUT-ENGINE: memory(), OUT._id <- IN.nations[*].name, OUT.regions <- LIST(OBJECT(region <- IN._id, key <- IN.nations[@].key))", nations)
    return out.select("_id", F.col("regions")[0]["region"].alias("region"), F.col("regions")[0]["key"].alias("key"), F.size("regions").alias("n"))


QUERIES["nested_objects"] = _nested_objects
ORACLES["nested_objects"] = "SELECT n_name AS _id, n_regionkey AS region, n_nationkey AS key, 1 AS n FROM nation"

# --- wide-column and key-value dialects over the given tables


def _in_dialect(spark: SparkSession, source: str, body: str, rows: DataFrame) -> DataFrame:
    (t,) = parse(f"IN-ENGINE: {source}, OUT-ENGINE: memory(), {body}")
    return compile_transformation(t, rows, dynamic=True)


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rows of a wide-column table: text cells in one family."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select(F.col("o_orderkey").cast("string").alias("_id"), F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("price"), F.col("o_totalprice").cast("string"), F.lit("priority"), F.col("o_orderpriority")).alias("default"))


def _column_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _in_dialect(spark, "hbase(table_id <- 'x')", "IN-FILTER: IN.price > 1000, OUT._id <- IN.status, OUT.total <- SUM(IN.default:price), OUT.cells <- COUNT(IN._v), OUT.width <- MAX(COL_COUNT())", _cells(spark, sf_dir)).withColumn("total", F.round("total", 2))


QUERIES["column_sum"] = _column_sum
ORACLES["column_sum"] = "SELECT o_orderstatus AS _id, round(sum(o_totalprice), 2) AS total, 3 * count(*) AS cells, CAST(3 AS BIGINT) AS width FROM orders WHERE o_totalprice > 1000 GROUP BY 1"


def _column_transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _in_dialect(spark, "hbase(table_id <- 'x')", "IN-FILTER: IN.status = 'O', OUT._id <- IN._c, OUT.$(IN._r) <- IN._v", _cells(spark, sf_dir))
    return out.select("_id", F.size(F.map_keys(DYNAMIC)).alias("n"))


QUERIES["column_transpose"] = _column_transpose
ORACLES["column_transpose"] = "SELECT c AS _id, CAST(count(*) AS INTEGER) AS n FROM orders, (SELECT unnest(['price', 'priority', 'status']) AS c) WHERE o_orderstatus = 'O' GROUP BY 1"


def _hash_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cells(spark, sf_dir).withColumnRenamed("default", "_v")
    return _in_dialect(spark, "redis(database_id <- '0')", "IN-FILTER: IN._v.price > 1000, OUT._id <- IN._k, OUT.n <- COUNT(IN._v.*), OUT.price <- MAX(IN._v.price), OUT.size <- MAX(LIST_COUNT(IN._v))", rows)


QUERIES["hash_values"] = _hash_copy
ORACLES["hash_values"] = "SELECT CAST(o_orderkey AS VARCHAR) AS _id, CAST(3 AS BIGINT) AS n, o_totalprice AS price, CAST(3 AS BIGINT) AS size FROM orders WHERE o_totalprice > 1000"

# --- incremental runs: an old state is derived from the table; the result must be that of the new state

SUM_BY_TYPE = "OUT._id <- IN.event_type, OUT.total <- SUM(IN.value), OUT.n <- COUNT(IN._id)"
SUM_ALL = "OUT._id <- 'result', OUT.total <- SUM(IN.value), OUT.n <- COUNT(IN._id)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("_id"), "user_id", "event_type", F.round("value", 2).alias("value"))


def _older(events: DataFrame) -> DataFrame:
    """An earlier state: a tenth of the rows missing, a tenth with other values, some in other groups, some deleted since."""
    k = F.col("_id") % 10
    old = events.where(k != 0).withColumn("value", F.when(k == 1, F.col("value") + 10).otherwise(F.col("value"))).withColumn("event_type", F.when(k == 2, F.lit("other")).otherwise(F.col("event_type")))
    return old.unionByName(events.where(k == 3).withColumn("_id", -F.col("_id") - 1))


def incremental(body: str, old: DataFrame, new: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """The result on ``old``, brought up to ``new`` by the signed rows between them."""
    (t,) = parse(f"IN-ENGINE: memory(), OUT-ENGINE: memory(), {body}")
    before = compile_transformation(t, old)
    delta = compile_transformation(t, signed_diff(old, new) if changes is None else changes, weight=WEIGHT)
    return add_changes(before, delta, sums_of(t.specs))


def _incremental(name: str, body: str, sql: str, shape: Callable[[DataFrame], DataFrame] | None = None) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        new = _events(spark, sf_dir)
        out = incremental(body, _older(new), new).withColumn("total", F.round("total", 2))
        return shape(out) if shape else out

    QUERIES[name], ORACLES[name] = query, sql


_TYPES = "SELECT event_type AS _id, round(sum(round(value, 2)), 2) AS total, count(*) AS n FROM events"
_incremental("snapshot_sum", SUM_ALL, "SELECT 'result' AS _id, round(sum(round(value, 2)), 2) AS total, count(*) AS n FROM events")
_incremental("snapshot_group_change", SUM_BY_TYPE, f"{_TYPES} GROUP BY 1 UNION ALL SELECT 'other', 0, 0")
ORACLES["snapshot_group_change"] = f"{_TYPES} GROUP BY 1 UNION ALL SELECT 'other' AS _id, CAST(0 AS DOUBLE) AS total, CAST(0 AS BIGINT) AS n"
_incremental("snapshot_filter_flip", f"IN-FILTER: IN.value > 50, {SUM_BY_TYPE}", f"{_TYPES} WHERE round(value, 2) > 50 GROUP BY 1", lambda df: df.where("n > 0"))


def _timestamp_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = _events(spark, sf_dir)
    old = new.where("_id % 5 <> 0")
    return incremental(SUM_BY_TYPE, old, new, inserted(new.where("_id % 5 = 0"))).withColumn("total", F.round("total", 2))


QUERIES["timestamp_inserts"] = _timestamp_inserts
ORACLES["timestamp_inserts"] = f"{_TYPES} GROUP BY 1"


def _change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change events, several for one row: only their net effect counts."""
    new = _events(spark, sf_dir)
    old = new.where("_id % 4 <> 0").withColumn("value", F.when(F.col("_id") % 4 == 1, F.col("value") * 0).otherwise(F.col("value")))
    n = F.struct(*[F.col(f"n.`{c}`") for c in new.columns])
    o = F.struct(*[F.col(f"o.`{c}`") for c in new.columns])
    both = old.alias("o").join(new.alias("n"), F.col("o._id") == F.col("n._id"), "full_outer").where("n._id % 4 IN (0, 1)")
    none = F.lit(None).cast(new.schema)
    middle = F.struct(F.col("n._id").alias("_id"), F.col("n.user_id"), F.lit("between").alias("event_type"), F.lit(7.0).alias("value"))
    event = lambda seq, before, after: F.struct(F.lit(seq).alias("seq"), before.alias("before"), after.alias("after"))
    first = F.when(F.col("o._id").isNotNull(), o).otherwise(none)
    events = F.array(event(1, first, middle), event(2, middle, n))
    log = both.select(F.col("n._id").alias("_id"), F.explode(events).alias("e")).select("_id", "e.*")
    return incremental(SUM_BY_TYPE, old, new, net_changes(log)).withColumn("total", F.round("total", 2))


QUERIES["trigger_batch"] = _change_log
ORACLES["trigger_batch"] = f"{_TYPES} GROUP BY 1"


def _copy_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A copy only writes changed rows again."""
    (t,) = parse("IN-ENGINE: memory(), OUT-ENGINE: memory(), OUT._id <- IN._id, OUT.value <- IN.value, OUT.type <- IN.event_type")
    new = _events(spark, sf_dir)
    old = new.where("_id % 10 <> 0").withColumn("value", F.when(F.col("_id") % 10 == 1, F.col("value") + 1).otherwise(F.col("value")))
    changed = signed_diff(old, new).where(f"{WEIGHT} > 0").drop(WEIGHT)
    return upsert(compile_transformation(t, old), compile_transformation(t, changed))


QUERIES["copy_incremental"] = _copy_incremental
ORACLES["copy_incremental"] = "SELECT event_id AS _id, round(value, 2) AS value, event_type AS type FROM events"


def _no_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = _events(spark, sf_dir)
    return incremental(SUM_BY_TYPE, new, new).withColumn("total", F.round("total", 2))


QUERIES["no_change"] = _no_change
ORACLES["no_change"] = f"{_TYPES} GROUP BY 1"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered, grouped SUM and COUNT of orders."""
    body = "IN-FILTER: IN.o_totalprice > 1000, OUT._id <- IN.o_orderpriority, OUT.total <- SUM(IN.o_totalprice), OUT.n <- COUNT(IN.o_orderkey)"
    return result(spark, script("orders", body, sf_dir))
