"""Toxicity: trees, calibration, held-out accuracy, awkward rows."""

import zlib

import numpy as np

from loomql.llm import boosting
from loomql.llm import op3_toxicity as op


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = boosting.fit(x[:2000], y[:2000], np.ones(2000))
    assert ((model.margin(x[2000:]) > 0) == y[2000:]).mean() > 0.95


def test_isotonic_is_the_least_squares_rising_fit():
    rng = np.random.default_rng(2)
    s, y, w = rng.normal(size=40), rng.integers(0, 2, 40), rng.integers(1, 4, 40).astype(float)
    xs, ys = boosting.isotonic(s, y, w)
    assert (np.diff(ys) >= 0).all() and ys.min() >= 0 and ys.max() <= 1
    fitted = np.interp(np.sort(s), xs, ys)
    v, w = y[np.argsort(s)].astype(float), w[np.argsort(s)]
    n = len(v)
    for i in range(n):  # min-max formula
        assert abs(fitted[i] - max(min(np.average(v[a : b + 1], weights=w[a : b + 1]) for b in range(i, n)) for a in range(i + 1))) < 1e-9


def test_features_see_each_signal():
    f = lambda t: op.features(t, op.Lexicon({"zork": 3.0}, {"blar": 2.0}))
    plain = f("a quiet river in the winter")
    assert f("you idiot")[0] == 0.5 and f("you idiot")[8] > 0 and f("the idiot")[8] == 0
    assert f("zork blarney")[2] == 1.0 and plain[2] == 0
    assert f("SHOUT at me")[11] > plain[11] and f("what!! no!!")[12] > 0
    assert f("you 1d1ot")[17] > f("you friend")[17] and f("i d i o t s")[17] > 0
    assert len(f("")) == op.N_FEATURES == len(plain)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op.op3_toxicity(spark, sf).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    held = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([a > b for a in good for b in bad]) > 0.9
    assert np.mean([(s >= 0.5) == y for s, y in held]) > 0.93


def test_labels_of_the_held_out_fold_and_other_columns_do_not_matter(spark, docs, small):
    from pyspark.sql import functions as F

    labels = spark.read.parquet(f"{small}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(op.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = [{r["doc_id"]: r["score"] for r in op.score_documents(docs.withColumn("lang", F.lit(x)), op.train(docs, t)).collect()} for t, x in ((labels, "en"), (turned, "zz"))]
    assert scores[0] == scores[1]


def test_one_law_at_any_number_of_labels(spark, docs, small):
    """Few labels, one class, or none: trees and calibration all the same, and insults score above prose."""
    labels = spark.read.parquet(f"{small}/labels.parquet")
    for known in (labels, labels.where("toxic = 0"), labels.where("toxic = 1").limit(1), labels.limit(0)):
        model = op.train(docs, known)
        assert len(model.trees.leaves) == 60 and len(model.knots[0]) >= 2
        bad, good = model.score(["you are a worthless idiot and a pathetic clown"])[0], model.score(["the river runs past the old mill and the market"])[0]
        assert 0 <= good < 0.5 and bad > good


def test_very_long_text(spark, docs, small):
    model = op.train(docs, spark.read.parquet(f"{small}/labels.parquet"))
    text = "the river and the mill " * 60_000
    df = spark.createDataFrame([(1, text), (2, text + "you worthless idiot " * 30_000)], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in op.score_documents(df, model).collect()}
    assert got[1] == model.score([text])[0] and got[2] >= got[1]


def test_awkward_rows_and_missing_classes(spark, odd, empty, docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    model = op.train(odd, labels)
    rows = op.score_documents(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows) and all(r["held_out"] for r in rows if r["doc_id"] is None)
    assert op.score_documents(empty, op.train(empty, labels.limit(0))).count() == 0
    assert op.without_toxic(odd, model).columns == odd.columns
