"""What must not be lost or doubled: crashes, boundaries in time, malformed input, repeated ids."""

import pytest
from pyspark.sql import functions as F

from loomql.operators.incremental import signed_diff
from loomql.plans.run import run
from loomql.sources import paths
from loomql.sources.registry import EngineError, create
from loomql.streaming import triggers

SOURCE = {"database_name": "d", "collection_name": "in"}
SUM = "IN-ENGINE: mongodb(database_name <- 'd', collection_name <- 'in'{}), OUT-ENGINE: mongodb(database_name <- 'd', collection_name <- 'out'), OUT._id <- 'all', OUT.s <- SUM(IN.v)"


def total(spark):
    return create(spark, "mongodb", {"database_name": "d", "collection_name": "out"}).read().first()["s"]


def documents(spark, rows):
    create(spark, "mongodb", SOURCE).folder().replace(spark.createDataFrame(rows, "_id string, v int"))


def test_a_batch_whose_stream_crashed_after_its_result_is_not_applied_again(spark, stores, tmp_path, monkeypatch):
    documents(spark, [("a", 1)])
    run(spark, SUM.format(""))
    schema = "_id string, seq int, before struct<_id:string,v:int>, after struct<_id:string,v:int>"
    spark.createDataFrame([("b", 1, None, ("b", 5))], schema).write.parquet(str(tmp_path / "log"))
    start = lambda: triggers.start(spark, SUM.format(""), spark.readStream.schema(schema).parquet(str(tmp_path / "log")), str(tmp_path / "c"))
    applied = triggers.apply_batch

    def crash(*arguments):
        applied(*arguments)
        raise RuntimeError("crash")

    monkeypatch.setattr(triggers, "apply_batch", crash)
    with pytest.raises(Exception, match="crash"):
        start().awaitTermination()
    monkeypatch.setattr(triggers, "apply_batch", applied)
    start().awaitTermination()
    assert total(spark) == 6.0


def test_documents_of_the_second_in_which_a_run_began(spark, stores):
    at = lambda second, n: f"{second:08x}{n:016x}"
    documents(spark, [(at(1000, 1), 1)])
    source = create(spark, "mongodb", SOURCE)
    source.remember(source.read(), 1_000_500)
    run(spark, SUM.format(""))
    documents(spark, [(at(1000, 1), 1), (at(1000, 2), 10), (at(1001, 3), 100)])
    run(spark, SUM.format(", timestamp <- 1000500"))
    assert total(spark) == 111.0


def test_documents_are_replaced_as_a_whole(spark, stores):
    store = create(spark, "mongodb", SOURCE)
    store.store(spark.createDataFrame([("x", 1, 2)], "_id string, a int, b int"))
    store.store(spark.createDataFrame([("x", 9)], "_id string, a int"))
    assert [tuple(r) for r in store.read().select("_id", "a", "b").collect()] == [("x", 9, None)]


def test_malformed_json_is_an_error(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"_id": "a", "v": 1}\n{"_id": "b", "v": \n')
    with pytest.raises(EngineError, match="no JSON object"):
        create(spark, "json", {"path": str(tmp_path / "a.json")}).read().collect()


def test_repeated_ids_are_an_error(spark):
    one = spark.createDataFrame([("a", 1), ("a", 2)], "_id string, v int")
    with pytest.raises(Exception, match="occurs more than once"):
        signed_diff(one, one.limit(0)).collect()


def test_rows_that_differ_only_in_the_place_of_a_null(spark):
    old = spark.createDataFrame([("a", None, 1)], "_id string, x int, y int")
    new = spark.createDataFrame([("a", 1, None)], "_id string, x int, y int")
    assert sorted(r["_weight"] for r in signed_diff(old, new).collect()) == [-1, 1]


def test_a_folder_put_aside_comes_back(spark, tmp_path):
    path = str(tmp_path / "t")
    paths.replace_parquet(spark.range(3), path)
    with paths.marked("s", 4):
        paths.replace_parquet(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5 and paths.marks(spark, path) == {"s": 4}
    (tmp_path / "t").rename(tmp_path / f"t{paths.ASIDE}x")  # a crash between the two renames
    assert paths.exists(spark, path) and spark.read.parquet(path).count() == 5


def test_json_sink_takes_any_number_of_names(spark, tmp_path):
    spark.range(300).select(F.concat(F.lit("n"), "id").alias("name"), F.lit("all").alias("g")).write.parquet(str(tmp_path / "in"))
    run(spark, f"IN-ENGINE: parquet(path <- '{tmp_path}/in'), OUT-ENGINE: json(path <- '{tmp_path}/out'), OUT._id <- IN.g, OUT.$(IN.name) <- COUNT(1)")
    assert len(create(spark, "json", {"path": str(tmp_path / "out")}).read().columns) == 301
