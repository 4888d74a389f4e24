"""Resharding by minimum-cost flow.

Old shards have sizes, new shards have capacities; a byte that stays costs nothing, a byte that moves costs
one.  ``min_cost_flow`` solves the transport problem exactly on the shard graph (as many nodes as shards,
whatever the data).

A shard is a set of block files.  ``lay_out`` writes them: a block holds one size class of a shard's documents (octaves, larger
ones first), or a hash part of it of about ``BLOCK_BYTES``, in order of size, and each row knows its number and the bytes
before it in its block.  ``reshard`` turns the flows into stretches of each old shard's bytes: what stays is cut
off the front, each transfer takes the next stretch, so large documents stay and cuts fall among small ones.  A block that
lies in one stretch is kept or transferred as a file and not touched; only the blocks in which a stretch ends (at most
one for each flow) are read and written again, each document going where the middle of its span falls.  So a
shard misses its capacity by at most half a document at each end of a stretch.  ``read_shards`` reads kept and rewritten files.

The driver sees one row a shard and the blocks that are cut; positions are running sums inside blocks plus sums over blocks.

Law: ``bytes``.  The query's old shards are ``OLD_SHARDS`` hash shards of doc_id; new ones are 24 equal ones.

Defined cases: a null text counts 0 bytes (plus 8) and crc32 0; a very long text is one document and is never cut; null doc_ids
hash like any value; repeated rows are ordered arbitrarily among themselves but each has its slot; an empty table gives
none; extra columns are carried whatever their names.
"""

from __future__ import annotations

import heapq
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomql.plans.scratch import ROW_GROUP, cut, new_folder, small_side

SHARDS, OLD_SHARDS = 24, 16
BLOCK_BYTES = 64 << 20
SMALL = 12  # documents below 2 ** SMALL bytes are one size class
OVERHEAD = 8


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Flows[i][j] that ship all supply within capacity at least cost (successive shortest paths with potentials).

    sum(capacity) must be sum(supply) or more; costs must not be negative.
    """
    n, m = len(supply), len(capacity)
    if sum(capacity) < sum(supply):
        raise ValueError("the new shards can't hold the old ones")
    flow = [[0] * m for _ in range(n)]
    left, room = list(supply), list(capacity)
    height = [0] * (n + m)
    while any(left):
        dist: list[float] = [float("inf")] * (n + m)
        back = [-1] * (n + m)
        queue = []
        for i in range(n):
            if left[i]:
                dist[i] = 0
                queue.append((0, i))
        heapq.heapify(queue)
        while queue:
            d, x = heapq.heappop(queue)
            if d > dist[x]:
                continue
            if x < n:
                steps = ((n + j, cost[x][j]) for j in range(m))
            else:
                steps = ((i, -cost[i][x - n]) for i in range(n) if flow[i][x - n])
            for y, c in steps:
                if (e := d + c + height[x] - height[y]) < dist[y]:
                    dist[y], back[y] = e, x
                    heapq.heappush(queue, (e, y))
        end = min((n + j for j in range(m) if room[j]), key=lambda y: dist[y] + height[y])
        far = dist[end]
        height = [h + int(min(d, far)) for h, d in zip(height, dist)]
        path = [end]
        while back[path[-1]] >= 0:
            path.append(back[path[-1]])
        path.reverse()
        amount = min(left[path[0]], room[end - n], *(flow[y][x - n] for x, y in zip(path, path[1:]) if x >= n))
        for x, y in zip(path, path[1:]):
            if x < n:
                flow[x][y - n] += amount
            else:
                flow[y][x - n] -= amount
        left[path[0]] -= amount
        room[end - n] -= amount
    return flow


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def _stretches(flow: list[list[int]]) -> list[tuple[int, int, int, int]]:
    """(old, new, from byte, to byte): what stays comes first, then transfers by new shard."""
    out = []
    for i, row in enumerate(flow):
        at = 0
        for j in sorted((j for j, f in enumerate(row) if f), key=lambda j: (j != i, j)):
            out.append((i, j, at, at + row[j]))
            at += row[j]
    return out


def _size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD


def _crc(text: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(0)).cast("long")


def _files(spark: SparkSession, folder: str, row: T.DataType, *partitions: str) -> DataFrame:
    fields = [("row", row), *[(c, T.LongType()) for c in ("number", "start", "size", "text_crc32")], *[(c, T.IntegerType()) for c in partitions]]
    return spark.read.schema(T.StructType([T.StructField(n, t) for n, t in fields])).parquet(folder)


def lay_out(docs: DataFrame, old_shard: Column, folder: str) -> T.DataType:
    """Write every row of ``docs`` into the block files of its shard (an integer from 0 on); returns the type of the rows."""
    text = F.col("text").cast("string")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    size_class = (63 - F.greatest(F.lit(SMALL), F.floor(F.log2(F.col("size").cast("double"))))).cast("int")  # larger first
    rows = docs.select(row.alias("row"), old_shard.cast("int").alias("old_shard"), _size(text).alias("size"), _crc(text).alias("text_crc32"), F.col("doc_id").alias("id")).withColumn("class", size_class)
    slim = docs.select(old_shard.cast("int").alias("old_shard"), _size(text).alias("size")).withColumn("class", size_class)
    parts = slim.groupBy("old_shard", "class").agg(F.ceil(F.sum("size") / BLOCK_BYTES).cast("int").alias("parts"))  # shards x size classes
    block = (F.col("class") * (1 << 24) + F.pmod(F.xxhash64("id", "text_crc32"), F.col("parts"))).cast("int")
    blocked = rows.join(F.broadcast(parts), ["old_shard", "class"]).withColumn("block", block).drop("class", "parts")
    run = Window.partitionBy("old_shard", "block").orderBy(F.desc("size"), "id", "text_crc32")
    placed = blocked.repartition("old_shard", "block").withColumn("number", (F.row_number().over(run) - 1).cast("long"))
    placed = placed.withColumn("start", F.sum("size").over(run.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    placed.select("row", "number", "start", "size", "text_crc32", "old_shard", "block").write.partitionBy("old_shard", "block").options(**{"parquet.block.size": str(ROW_GROUP)}).parquet(folder)
    return rows.schema["row"].dataType


def reshard(spark: SparkSession, folder: str, row: T.DataType, out: str, capacities: list[int] | None = None, n_old: int = OLD_SHARDS, n_new: int = SHARDS) -> tuple[DataFrame, list[list[int]]]:
    """(manifest of the new shards, the flows in bytes): rewrites the cut blocks of ``folder`` into ``out``.

    The manifest has a row for each file of a new shard: ``shard``, ``old_shard``, ``block``, ``n`` rows, ``offset`` of their slots, and ``rewritten``.
    """
    old = _files(spark, folder, row, "old_shard", "block")
    meta = cut(old.groupBy("old_shard", "block").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")))
    supply = [0] * n_old
    for r in meta.groupBy("old_shard").agg(F.sum("bytes").alias("bytes")).collect():
        supply[r["old_shard"]] = r["bytes"]
    flow = min_cost_flow(supply, capacities or equal_capacities(sum(supply), n_new), [[int(i != j) for j in range(n_new)] for i in range(n_old)])
    stretches: dict[int, list] = {i: [] for i in range(n_old)}
    for i, j, a, b in _stretches(flow):
        stretches[i].append({"from": a, "to": b, "shard": j})
    plan = F.broadcast(spark.createDataFrame(list(stretches.items()), "old_shard int, stretches array<struct<from: long, to: long, shard: int>>"))  # a row an old shard
    before = Window.partitionBy("old_shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = meta.withColumn("at", F.coalesce(F.sum("bytes").over(before), F.lit(0))).join(plan, "old_shard")
    inside = F.filter("stretches", lambda s: (s["from"] < F.col("at") + F.col("bytes")) & (s["to"] > F.col("at")))
    blocks = cut(blocks.withColumn("stretches", inside))
    whole = blocks.where(F.size("stretches") == 1).select(F.col("stretches")[0]["shard"].alias("shard"), "old_shard", "block", "n", F.lit(False).alias("rewritten"))
    cuts = blocks.where(F.size("stretches") > 1).select("old_shard", "block", "at", "stretches").collect()  # at most one a flow
    names = [(F.col("old_shard") == i) & F.col("block").isin([c["block"] for c in cuts if c["old_shard"] == i]) for i in {c["old_shard"] for c in cuts}]
    touched = old.where(reduce(lambda a, b: a | b, names, F.lit(False)))  # partition columns: other files aren't opened
    parts = F.broadcast(spark.createDataFrame([tuple(c) for c in cuts], "old_shard int, block int, at long, stretches array<struct<from: long, to: long, shard: int>>"))
    middle = F.col("at") + F.col("start") + F.col("size") / 2
    target = F.element_at(F.filter("stretches", lambda s: (s["from"] <= middle) | (s["from"] <= F.col("at"))), -1)["shard"]
    dealt = touched.join(parts, ["old_shard", "block"]).withColumn("shard", target)
    group = Window.partitionBy("shard", "old_shard", "block")
    first = dealt.withColumn("number", F.col("number") - F.min("number").over(group)).withColumn("start", F.col("start") - F.min("start").over(group))
    first.select("row", "number", "start", "size", "text_crc32", "shard", "old_shard", "block").write.partitionBy("shard", "old_shard", "block").parquet(out)
    again = _files(spark, out, row, "shard", "old_shard", "block").groupBy("shard", "old_shard", "block").agg(F.count("*").alias("n")).withColumn("rewritten", F.lit(True))
    files = whole.unionByName(again)
    ahead = Window.partitionBy("shard").orderBy("old_shard", "block").rowsBetween(Window.unboundedPreceding, -1)
    return cut(files.withColumn("offset", F.coalesce(F.sum("n").over(ahead), F.lit(0)).cast("long"))), flow


def read_shards(spark: SparkSession, folder: str, out: str, row: T.DataType, manifest: DataFrame) -> DataFrame:
    """(row, old_shard, shard, slot, size, text_crc32) of all documents of the new shards."""
    columns = ["row", "old_shard", "shard", (F.col("offset") + F.col("number")).alias("slot"), "size", "text_crc32"]
    kept, rewritten = (small_side(manifest.where(F.col("rewritten") == x).drop("n", "rewritten")) for x in (False, True))
    stayed = _files(spark, folder, row, "old_shard", "block").join(kept, ["old_shard", "block"]).select(*columns)
    return stayed.unionByName(_files(spark, out, row, "shard", "old_shard", "block").join(rewritten, ["shard", "old_shard", "block"]).select(*columns))


def op2_resharding(spark, sf_dir: str) -> DataFrame:
    """Sizes and checksums are those of the texts as the shards' files hold them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    folder, out = new_folder(spark, "old-shards"), new_folder(spark, "shards")
    row = lay_out(docs, F.pmod(F.xxhash64("doc_id"), F.lit(OLD_SHARDS)), folder)
    manifest, _ = reshard(spark, folder, row, out)
    text = F.col("row.text")
    read = read_shards(spark, folder, out, row, manifest)
    return read.select(F.col("row.doc_id").alias("doc_id"), _size(text).alias("size"), _crc(text).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
