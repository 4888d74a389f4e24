"""Mixing: targets, budgets, whole epochs, weights, reruns."""

import math

import pytest
from llm.conftest import prose, rows_of
from pyspark.sql import functions as F

from loomql.llm import op7_mixing as op


def targets(sizes, weights=(3.0, 1.0, 2.0), share=1.5, cap=2.0):
    """Resharing by weight until no source is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, out = share * sum(sizes.values()), {}
    while weight:
        total = sum(weight.values())
        over = [s for s in weight if left * weight[s] / total > cap * sizes[s]]
        if not over:
            return out | {s: left * w / total for s, w in weight.items()}
        for s in over:
            out[s] = cap * sizes[s]
        left -= sum(out[s] for s in over)
        weight = {s: w for s, w in weight.items() if s not in over}
    return out


def size(text):
    return len([w for w in (text or "").encode().split()])


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, "c": 10, None: 5, "z": 0}, {"a": 5}, {"a": 0, "b": 0}, {"é": 10, "z": 200, "Z": 50, "": 7}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    got = {r["source"]: r["target"] for r in op.targets(df).collect()}
    assert got == pytest.approx(targets(sizes))


def check(df):
    rows = op.mix(df).collect()
    assert len(rows) == df.count()
    held = {}
    for r in df.select("source", "text").collect():
        held[r["source"]] = held.get(r["source"], 0) + size(r["text"])
    goal, taken, most = targets(held), {}, {}
    for r in rows:
        assert r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"] and r["source_size"] == held[r["source"]]
        assert r["target"] == pytest.approx(goal[r["source"]]) and r["copies"] >= math.floor(r["target"] / max(1, r["source_size"]) - 1e-9) * (r["source_size"] > 0)
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        most[r["source"]] = max(most.get(r["source"], 0), r["size"])
    for s in held:
        assert abs(taken[s] - goal[s]) <= most[s] / 2 + 1
    return rows


def test_query(spark, docs, odd, empty):
    check(docs)
    check(odd)
    assert op.mix(empty).count() == 0
    assert rows_of(op.mix(docs)) == rows_of(op.mix(docs.repartition(7)))


def test_one_hot_source(spark, rng):
    check(spark.createDataFrame([(i, prose(rng, rng.randint(1, 60)), "hot" if i % 3 else f"s{i % 5}") for i in range(600)], "doc_id long, text string, source string"))


def test_a_budget_that_ends_among_equal_rows(spark, rng):
    """Repeated rows share one key; some of them are taken, so that the target is met all the same."""
    same = [(None, "one two three four", "hot")] * 400 + [(7, "five six", "other")] * 90 + [(None, None, "hot")] * 5
    df = spark.createDataFrame(same + [(i, prose(rng, 9), "third") for i in range(50)], "doc_id long, text string, source string").repartition(5)
    rows = check(df)
    assert {len({r["copies"] for r in rows if r["source"] == s and r["size"]}) for s in ("hot", "other")} == {1, 2} or len({r["copies"] for r in rows if r["source"] == "hot" and r["size"]}) == 2
    mixed = op.mixed_rows(df.withColumn("row", F.lit(1))).groupBy("source").agg(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), " "))).alias("n"))
    taken = {s: sum(r["taken"] for r in rows if r["source"] == s) for s in ("other", "third")}
    assert {r["source"]: r["n"] for r in mixed.where("source <> 'hot'").collect()} == taken


def test_rows_are_repeated(spark, docs):
    copies = {r["doc_id"]: r["copies"] for r in op.mix(docs).collect()}
    mixed = op.mixed_rows(docs)
    assert mixed.columns == docs.columns
    got = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert got == {i: n for i, n in copies.items() if n}


def test_heavier_documents_are_taken_more_often(spark):
    rows = [(i, ("word " * 20) if i % 2 else ("w#$ " * 20), "s") for i in range(2000)] + [(5000, "x " * 80000, "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = op.mix(df, share=0.25, weights=(1.0,)).where("source = 's'").groupBy((F.col("doc_id") % 2).alias("k")).agg(F.avg("copies").alias("c")).collect()
    share = {r["k"]: r["c"] for r in got}
    assert share[1] > 1.3 * share[0]
