"""Mixing sources to target weights by weighted sampling without replacement.

Targets: the sources share ``share`` of all words by their weights; no target passes ``cap`` times
its source's size, and what is over goes to the others by weight until none is above.

Sampling: each document draws an exponential key -ln(u)/w (Efraimidis-Spirakis), u from a hash of
the document and the seed, w its quality weight.  Within a source, documents in key order are a weighted sample
without replacement.  A source first gives all its complete epochs (target div size); for the rest of the target
the documents' sizes are summed in key order, and a document is taken once more while the middle
of its span of words lies within the rest.

The running sum never needs a source in one place: documents are first counted by (source, key
bucket), ``BUCKETS`` per source, and those few sums are scanned; only the distinct keys of the one bucket of each
source in which the budget ends are sorted.  The result of that is one key a source, the last that is taken, so
whole rows are read, judged by their own key and never moved.  Rows that share the one key in which a budget ends are
numbered by the partitions in which they lie.

Defined cases: a null text has no words and is taken 0 times in effect (size 0); a very long text counts whole; a null
source is a source of its own, last in order; null doc_ids draw their key from the text alone; repeated rows draw equal
keys and are told apart only by number; without any words all targets are 0; an empty table gives none;
other columns of the input are ignored by ``mix`` and kept by ``mixed_rows``, whatever their names.  Rerunning gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomql.llm.text import whole, word_count
from loomql.plans.scratch import cut, small_side

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, CAP, SEED = 1.5, 2.0, 7
BUCKETS = 4096


def quality_weight(text: Column) -> Column:
    """Share of a text's characters that aren't digits or symbols, between 0.05 and 1; 0.05 for an empty text."""
    symbols = F.length(F.regexp_replace(text, r"[^\x21-\x2B\x2F-\x40\x5B-\x60\x7B-\x7E]+", ""))
    return F.greatest(F.lit(0.05), F.when(F.length(text) > 0, 1.0 - symbols / F.length(text)).otherwise(0.05))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, target, epochs, rest) from (source, source_size).

    Sources in code point order, null last, get the weights in turn.  The level L at which sum(min(cap * size, L * weight))
    meets the shared total follows from the sources in order of cap * size / weight: those below the level are
    full.  One row a source, so plain windows over that table do.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sizes.withColumn("weight", F.element_at(cycle, (F.row_number().over(order) - 1) % len(weights) + 1)).withColumn("most", F.col("source_size") * cap)
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), F.encode("source", "UTF-8"))
    upto, every = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    total = F.least(F.sum("source_size").over(every) * share, F.sum("most").over(every))
    left = total - F.coalesce(F.sum("most").over(upto), F.lit(0.0))
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))
    level = weighed.withColumn("level", left / open_weight)
    level = level.withColumn("full", F.col("most") <= F.col("weight") * F.col("level"))
    last = F.max(F.when(~F.col("full"), F.col("level"))).over(every)  # the first source that isn't full sets the level; later values fall
    target = F.when(F.col("full"), F.col("most")).otherwise(F.col("weight") * last)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + F.lit(1e-12))).otherwise(F.lit(0)).cast("long")
    return level.withColumn("target", target).withColumn("epochs", epochs).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("source_size"))).select("source", "source_size", "target", "epochs", "rest")


def _drawn(docs: DataFrame, seed: int, row: Column | None = None) -> DataFrame:
    """Every row's size, key and key bucket (and the row itself as a struct)."""
    text = whole(F.col("text"))
    name = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text)
    draw = F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("long")  # 52 bits
    u = (draw.cast("double") + 0.5) / float(1 << 52)
    kept = [] if row is None else [row.alias("row")]
    rows = docs.select(*kept, F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), draw.alias("draw"), (-F.log(u) / quality_weight(text)).alias("mix_key"))
    return rows.withColumn("bucket", F.floor(BUCKETS * (1 - F.exp(-F.col("mix_key")))).cast("int"))


def _plan(keyed: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """One row a source: its target; ``last``, the greatest key of which all rows are taken once more; and
    ``part``, the key of which only ``n_part`` rows are (null where no budget ends among equal keys)."""
    keyed = cut(keyed.select("source", "bucket", "mix_key", "draw", "doc_id", "size"))
    sums = cut(keyed.groupBy("source", "bucket").agg(F.sum("size").alias("n")))
    goals = cut(targets(sums.groupBy("source").agg(F.sum("n").alias("source_size")), weights, share, cap))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = sums.withColumn("before", before).alias("s").join(goals.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source")))
    edge = edge.where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("n")))
    edge = cut(edge.select(F.col("g.source").alias("edge_source"), F.col("bucket").alias("edge_bucket"), F.col("before").alias("edge_before"), F.col("rest").alias("edge_rest")))
    at_edge = keyed.join(small_side(edge), F.col("source").eqNullSafe(F.col("edge_source")) & (F.col("bucket") == F.col("edge_bucket")))
    equal = at_edge.groupBy("source", "mix_key", "draw", "doc_id", "size", "edge_before", F.col("edge_rest").alias("rest")).agg(F.count("*").alias("n"))
    running = Window.partitionBy("source").orderBy("mix_key", "draw", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.col("edge_before") - F.coalesce(F.sum(F.col("size") * F.col("n")).over(running), F.lit(0))
    # the middles of the rows' spans are at size / 2, 3 size / 2, ...: those within what is left are taken
    within = F.when(F.col("size") > 0, F.floor(left / F.when(F.col("size") > 0, F.col("size")) + 0.5)).otherwise(F.when(left >= 0, F.col("n")).otherwise(0))
    judged = equal.withColumn("took", F.when(F.col("rest") > 0, F.greatest(F.lit(0), F.least(F.col("n"), within))).otherwise(0).cast("long"))
    key = F.struct("mix_key", "draw", "doc_id")
    partial = (F.col("took") > 0) & (F.col("took") < F.col("n"))
    ends = judged.groupBy(F.col("source").alias("end_source")).agg(F.max(F.when(F.col("took") == F.col("n"), key)).alias("last"), F.max(F.when(partial, key)).alias("part"), F.max(F.when(partial, F.col("took"))).alias("n_part"))
    joined = goals.join(edge, F.col("source").eqNullSafe(F.col("edge_source")), "left").join(ends, F.col("source").eqNullSafe(F.col("end_source")), "left")
    return cut(joined.select(*goals.columns, F.coalesce("edge_bucket", F.lit(BUCKETS + 1)).alias("edge_bucket"), "last", "part", "n_part"))


def _taken(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds ``copies`` to rows with their keys."""
    placed = rows.alias("k").join(small_side(plan).alias("p"), F.col("k.source").eqNullSafe(F.col("p.source"))).select("k.*", "p.source_size", "p.target", "p.epochs", "p.rest", "p.edge_bucket", "p.last", "p.part", "p.n_part")
    key = F.struct("mix_key", "draw", "doc_id")
    whole_key = (F.col("bucket") < F.col("edge_bucket")) | ((F.col("bucket") == F.col("edge_bucket")) & F.coalesce(key <= F.col("last"), F.lit(False)))
    placed = placed.withColumn("extra", (whole_key & (F.col("rest") > 0)).cast("long"))
    shared = F.coalesce((F.col("bucket") == F.col("edge_bucket")) & key.eqNullSafe(F.col("part")) & F.col("part").isNotNull(), F.lit(False))
    if not plan.where("part is not null").isEmpty():
        # the budget ends among rows of one key: number them inside the partitions where a checkpoint holds them
        tied = cut(placed.where(shared).withColumn("held_by", F.spark_partition_id()))
        counts = tied.groupBy("source", "held_by").agg(F.count("*").alias("rows"))
        before = F.coalesce(F.sum("rows").over(Window.partitionBy("source").orderBy("held_by").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        offsets = counts.withColumn("ahead", before).alias("o")
        numbered = tied.withColumn("number", F.row_number().over(Window.partitionBy("source", "held_by").orderBy("draw"))).alias("t")
        numbered = numbered.join(small_side(cut(offsets)).alias("o"), F.col("t.source").eqNullSafe(F.col("o.source")) & (F.col("t.held_by") == F.col("o.held_by")))
        some = numbered.select("t.*", "ahead").withColumn("extra", (F.col("number") + F.col("ahead") <= F.col("n_part")).cast("long"))
        placed = placed.where(~shared).unionByName(some.drop("ahead", "number", "held_by"))
    return placed.drop("last", "part", "n_part").withColumn("copies", F.col("epochs") + F.col("extra"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken, mix_key) for every row of ``docs``.

    ``copies`` is how often the mix takes the document and ``taken`` the words that gives.
    """
    keyed = cut(_drawn(docs, seed))
    out = _taken(keyed, _plan(keyed, weights, share, cap))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "mix_key")


def mixed_rows(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it takes them; texts are read twice and never shuffled."""
    plan = _plan(_drawn(docs, seed), weights, share, cap)
    rows = _taken(_drawn(docs, seed, F.struct(*[F.col(f"`{c}`") for c in docs.columns])), plan)
    return rows.where("copies > 0").select(F.explode(F.array_repeat("row", F.col("copies").cast("int"))).alias("row")).select("row.*")


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    """The mix of the contract; ``target`` is rounded to six places."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("mix_key").withColumn("target", F.round("target", 6))


#: The same rows without buckets: plain running sums over each source.
ORACLE = rf"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
d AS (
  SELECT doc_id, source, CAST(len(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size,
    CAST('0x' || substr(md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || text), 1, 13) AS BIGINT) AS draw,
    CASE WHEN length(text) > 0 THEN greatest(0.05, 1.0::DOUBLE - CAST(length(regexp_replace(text, '[^\x21-\x2B\x2F-\x40\x5B-\x60\x7B-\x7E]+', '', 'g')) AS DOUBLE) / length(text)) ELSE 0.05 END AS w
  FROM t),
k AS (SELECT *, -ln((CAST(draw AS DOUBLE) + 0.5) / {1 << 52}) / w AS mix_key FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
o AS (SELECT *, CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight, source_size * CAST({CAP} AS DOUBLE) AS most FROM s),
l AS (
  SELECT *, (least(CAST(sum(source_size) OVER () AS DOUBLE) * {SHARE}, sum(most) OVER ()) - coalesce(sum(most) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM o WINDOW b AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT source, source_size, CASE WHEN most <= weight * level THEN most ELSE weight * max(CASE WHEN most > weight * level THEN level END) OVER () END AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size + 1e-12) AS BIGINT) ELSE 0 END AS epochs FROM g),
r AS (SELECT *, greatest(0, target - epochs * source_size) AS rest FROM p),
x AS (
  SELECT k.*, r.source_size, r.target, r.epochs, r.rest, coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY mix_key, draw, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM k JOIN r ON k.source IS NOT DISTINCT FROM r.source),
y AS (SELECT *, epochs + CASE WHEN rest > 0 AND start + size / 2.0 <= rest THEN 1 ELSE 0 END AS copies FROM x)
SELECT doc_id, source, size, source_size, round(target, 6) AS target, copies, copies * size AS taken FROM y
"""
