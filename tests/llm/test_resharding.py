"""Resharding: optimal flows, whole documents, gapless slots, files."""

import itertools
import random
import zlib

from llm.conftest import texts_of
from pyspark.sql import functions as F

from loomql.llm import op2_resharding as op


def cost(flow, costs):
    return sum(f * c for row, crow in zip(flow, costs) for f, c in zip(row, crow))


def test_flow_is_optimal():
    rng = random.Random(2)
    for _ in range(60):
        n, m = rng.randint(1, 3), rng.randint(1, 3)
        supply = [rng.randint(0, 4) for _ in range(n)]
        capacity = [rng.randint(0, 5) for _ in range(m)]
        costs = [[rng.randint(0, 6) for _ in range(m)] for _ in range(n)]
        if sum(capacity) < sum(supply):
            continue
        flow = op.min_cost_flow(supply, capacity, costs)
        assert [sum(r) for r in flow] == supply and all(sum(c) <= k for c, k in zip(zip(*flow), capacity))
        units = [i for i, s in enumerate(supply) for _ in range(s)]
        best = min((sum(costs[i][j] for i, j in zip(units, to)) for to in itertools.product(range(m), repeat=len(units)) if all(to.count(j) <= capacity[j] for j in range(m))), default=0) if len(units) <= 7 else None
        if best is not None:
            assert cost(flow, costs) == best


def test_fewest_bytes_move():
    old, new = [100, 300, 50], [150, 150, 150]
    flow = op.min_cost_flow(old, new, [[int(i != j) for j in range(3)] for i in range(3)])
    assert cost(flow, [[int(i != j) for j in range(3)] for i in range(3)]) == sum(max(0, o - n) for o, n in zip(old, new))


def check(rows, sizes, shards):
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())
    assert sorted(r["size"] for r in rows) == sorted(sizes)
    return {j: sum(r["size"] for r in by.get(j, [])) for j in range(shards)}


def test_query_holds_every_document_in_near_equal_shards(spark, docs, small):
    rows = op.op2_resharding(spark, small).collect()
    texts = dict(texts_of(docs))
    assert {r["doc_id"]: r["text_crc32"] for r in rows} == {i: zlib.crc32(t.encode()) for i, t in texts.items()}
    sizes = check(rows, [len(t.encode()) + 8 for t in texts.values()], 24)
    mean = sum(sizes.values()) / 24
    assert max(sizes.values()) <= mean + max(len(t.encode()) for t in texts.values())
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("bytes", None)}


def resharded(spark, docs, old, folder, **more):
    """(rows, manifest, flows) after laying out and resharding."""
    row = op.lay_out(docs, old, f"{folder}/old")
    manifest, flow = op.reshard(spark, f"{folder}/old", row, f"{folder}/new", **more)
    return op.read_shards(spark, f"{folder}/old", f"{folder}/new", row, manifest).collect(), manifest.collect(), flow


def test_few_documents_move_and_only_cut_files_are_written(spark, docs, tmp_path):
    old = (F.col("doc_id") % 4).cast("int")
    held = [r["b"] for r in docs.groupBy(old.alias("s")).agg(F.sum(F.octet_length("text") + 8).alias("b")).orderBy("s").collect()]
    capacities = [held[0], held[1], held[2] - 20000, held[3], 20000]
    rows, manifest, flow = resharded(spark, docs, old, tmp_path, capacities=capacities, n_old=4, n_new=5)
    went = sum(r["size"] for r in rows if r["shard"] != r["old_shard"])
    assert abs(went - 20000) < 4000 and {r["old_shard"] for r in rows if r["shard"] == 4} == {2}
    assert sorted(r["row"]["doc_id"] for r in rows) == sorted(i for i, _ in texts_of(docs))
    assert {r["old_shard"] for r in manifest if r["rewritten"]} == {2} and len({r["block"] for r in manifest if r["rewritten"]}) == 1
    written = spark.read.parquet(str(tmp_path / "new"))
    assert written.count() == sum(r["n"] for r in manifest if r["rewritten"]) < docs.count() / 2
    assert written.select("row.*").columns == docs.columns


def test_equal_shards_stay_as_they_are(spark, docs, tmp_path):
    old = (F.col("doc_id") % 4).cast("int")
    held = [r["b"] for r in docs.groupBy(old.alias("s")).agg(F.sum(F.octet_length("text") + 8).alias("b")).orderBy("s").collect()]
    rows, manifest, _ = resharded(spark, docs, old, tmp_path, capacities=held, n_old=4, n_new=4)
    assert not any(r["rewritten"] for r in manifest) and all(r["shard"] == r["old_shard"] for r in rows) and len(rows) == docs.count()


def test_blocks_of_bounded_bytes(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(op, "BLOCK_BYTES", 20_000)
    rows, manifest, _ = resharded(spark, docs, F.lit(0), tmp_path, n_old=1, n_new=3)
    sizes = check(rows, [len(t.encode()) + 8 for _, t in texts_of(docs)], 3)
    assert max(sizes.values()) - min(sizes.values()) < 20_000 and len(manifest) > 10


def test_awkward_rows(spark, odd, empty, tmp_path):
    rows, _, _ = resharded(spark, odd, F.pmod(F.xxhash64("doc_id"), F.lit(3)), tmp_path / "a", n_old=3, n_new=4)
    check(rows, [len((r["text"] or "").encode()) + 8 for r in odd.collect()], 4)
    assert sorted((repr(r["row"]["doc_id"]), r["text_crc32"]) for r in rows) == sorted((repr(i), zlib.crc32((t or "").encode())) for i, t in texts_of(odd))
    assert resharded(spark, empty, F.lit(0), tmp_path / "b", n_old=2, n_new=3)[0] == []


def test_very_long_text(spark, tmp_path):
    df = spark.createDataFrame([(1, "word " * 300_000), *[(i, "x" * 100) for i in range(2, 200)]], "doc_id long, text string")
    rows, _, _ = resharded(spark, df, (F.col("doc_id") % 2).cast("int"), tmp_path, n_old=2, n_new=3)
    check(rows, [1_500_008] + [108] * 198, 3)


def test_reruns_agree(spark, docs, small):
    one, two = (op.op2_resharding(spark, small).select("doc_id", "shard", "slot") for _ in range(2))
    assert one.exceptAll(two).count() == 0
