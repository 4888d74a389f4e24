"""File engines, stores, the advisor, configuration and the command line."""

import json
import random

import pytest
from pyspark.sql import functions as F

from loomql.__main__ import main
from loomql.advisor import Advisor, Statistic, Statistics, distance
from loomql.config import Config
from loomql.lang.parser import parse
from loomql.operators.components import connected_components
from loomql.plans.run import run
from loomql.sources.files import TABLES
from loomql.sources.registry import EngineError, create, engine_names
from loomql.sources.stores import cells_of


def test_engines_and_their_parameters(spark):
    assert {"csv", "json", "mongodb", "hbase", "redis", "parquet", "memory"} <= set(engine_names())
    for name, parameters in (("csv", {}), ("json", {"path": "x", "more": 1}), ("nowhere", {})):
        with pytest.raises(EngineError):
            create(spark, name, parameters)


def test_csv_reads_types_by_column(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id;flag;n;d;mixed;text\n1;true;1;1.5;1;"a;b"\nid;flag;n;d;mixed;text\n2;FALSE;-2;2;x;\n')
    df = create(spark, "csv", {"path": str(tmp_path / "a.csv"), "delimiter": ";"}).read()
    assert dict(df.dtypes) == {"id": "bigint", "flag": "boolean", "n": "bigint", "d": "double", "mixed": "string", "text": "string"}
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, True, 1, 1.5, "1", "a;b"), (2, False, -2, 2.0, "x", "")]


def test_csv_round_trip_and_cells(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,x,y\na,1,2\nb,3,4\n")
    out = str(tmp_path / "out")
    text = f"IN-ENGINE: csv(path <- '{tmp_path}/a.csv'), OUT-ENGINE: csv(path <- '{out}'), OUT.k <- IN.k, OUT.sum <- IN.x + IN.y, OUT.n <- COL_COUNT()"
    run(spark, text)
    assert sorted(tuple(r) for r in create(spark, "csv", {"path": out}).read().collect()) == [("a", 3.0, 3), ("b", 7.0, 3)]
    with pytest.raises(EngineError):
        run(spark, text)  # the path exists
    run(spark, f"IN-ENGINE: csv(path <- '{tmp_path}/a.csv'), OUT-ENGINE: memory(name <- 'cells'), IN-FILTER: IN.x > 0, OUT.name <- IN._c, OUT.n <- COUNT(IN._v)")
    assert sorted(tuple(r) for r in TABLES["cells"].collect()) == [("k", 2), ("x", 2), ("y", 2)]


def test_json_lines_and_arrays(spark, tmp_path):
    (tmp_path / "a.json").write_text('[\n{"_id": "a", "v": {"x": 1}},\n{"_id": "b", "v": {"x": 2}, "l": [1, 2]}\n]\n')
    out = str(tmp_path / "out")
    text = f"IN-ENGINE: json(path <- '{tmp_path}/a.json'), OUT-ENGINE: json(path <- '{out}'), OUT._id <- 'all', OUT.s <- SUM(IN.v.x), OUT.l <- COUNT(IN.l[*])"
    for _ in range(2):  # overwrites
        run(spark, text)
    assert [r.asDict() for r in create(spark, "json", {"path": out}).read().collect()] == [{"_id": "all", "s": 3.0, "l": 2}]
    assert create(spark, "json", {"path": str(tmp_path / "none")}).read().count() == 0


def test_scripts_run_in_order(spark, tmp_path):
    spark.createDataFrame([("a", 1), ("b", 2)], "_id string, v int").write.parquet(str(tmp_path / "in"))
    run(spark, f"IN-ENGINE: parquet(path <- '{tmp_path}/in'), OUT-ENGINE: parquet(path <- '{tmp_path}/mid'), OUT._id <- IN._id, OUT.$(IN._id) <- IN.v; IN-ENGINE: parquet(path <- '{tmp_path}/mid'), OUT-ENGINE: memory(name <- 'end'), OUT._id <- 'x', OUT.n <- COUNT(IN.?(@))")
    assert [tuple(r) for r in TABLES["end"].collect()] == [("x", 4)]


def test_wide_column_cells(spark, stores):
    df = spark.createDataFrame([("r", {"a": "1"}, (2, None), 5.5)], "_id string, f map<string,string>, g struct<x:int,y:int>, z double")
    assert sorted(tuple(r) for r in cells_of(df).collect()) == [("r", "default", "z", "5.5"), ("r", "f", "a", "1"), ("r", "g", "x", "2")]
    with pytest.raises(EngineError):
        cells_of(spark.createDataFrame([(1,)], "a int"))


def test_wide_column_families(spark, stores):
    table = create(spark, "hbase", {"table_id": "t"})
    table.put(spark.createDataFrame([("r", "f", "a", "1"), ("r", "g", "a", "x"), ("r", "g", "b", "2.5"), ("s", "g", "b", "3")], "row string, family string, column string, value string"))
    run(spark, "IN-ENGINE: hbase(table_id <- 't'), OUT-ENGINE: memory(name <- 'w'), OUT._id <- IN._r, OUT.any <- IN.b, OUT.fixed <- IN.g:a, OUT.n <- MAX(COL_COUNT()), OUT.g <- MAX(COL_COUNT('g')), OUT.sum <- SUM(IN.f:_v)")
    assert sorted(tuple(r) for r in TABLES["w"].select("_id", "any", "fixed", "n", "g", "sum").collect()) == [("r", "2.5", "x", 3, 2, 1.0), ("s", "3", None, 1, 1, 0.0)]


def test_key_value_kinds(spark, stores):
    lists = create(spark, "redis", {"database_id": "lists"})
    lists.folder().replace(spark.createDataFrame([("k", ["1", "2"]), ("l", ["5"])], "_id string, _v array<string>"))
    run(spark, "IN-ENGINE: redis(database_id <- 'lists'), OUT-ENGINE: redis(database_id <- 'out'), OUT._k <- IN._k, OUT._v <- SUM(IN._v[*])")
    assert {r["_id"]: r["_v"] for r in create(spark, "redis", {"database_id": "out"}).read().collect()} == {"k": "3.0", "l": "5.0"}
    for _ in range(2):
        run(spark, "IN-ENGINE: redis(database_id <- 'lists'), OUT-ENGINE: redis(database_id <- 'copy'), OUT._k <- IN._k, OUT._v <- IN._v")
    assert {r["_id"]: r["_v"] for r in create(spark, "redis", {"database_id": "copy"}).read().collect()} == {"k": ["2", "1", "2", "1"], "l": ["5", "5"]}
    run(spark, "IN-ENGINE: redis(database_id <- 'lists'), OUT-ENGINE: redis(database_id <- 'hash'), OUT._k <- 'h', OUT._v <- HM($(IN._k) <- COUNT(IN._v[*]))")
    assert [tuple(r) for r in create(spark, "redis", {"database_id": "hash"}).read().collect()] == [("h", {"k": "2", "l": "1"})]


def test_documents_without_attributes_are_not_stored(spark, stores):
    TABLES["src"] = spark.createDataFrame([("a", None), ("b", 1)], "_id string, v int")
    run(spark, "IN-ENGINE: memory(name <- 'src'), OUT-ENGINE: mongodb(database_name <- 'd', collection_name <- 'c'), OUT._id <- IN._id, OUT.v <- IN.v")
    assert [tuple(r) for r in create(spark, "mongodb", {"database_name": "d", "collection_name": "c"}).read().collect()] == [("b", 1)]


# --- advisor


def stat(mode, ms, rows=100.0, aggregating=1):
    return Statistic("mongodb", mode, ms, aggregating, rows, rows)


def test_distance_and_prediction(tmp_path):
    assert distance(stat("full", 1), stat("full", 2)) == 0 and distance(stat("full", 1), stat("snapshot", 1)) == 1
    known = Statistics(str(tmp_path / "s.jsonl"))
    assert known.predict(stat("full", 0)) == -1
    for ms, rows in ((100, 100.0), (200, 100.0), (9000, 1.0)):
        known.add(stat("full", ms, rows))
    assert known.predict(stat("full", 0)) == 150
    again = Statistics(str(tmp_path / "s.jsonl"))
    assert again.predict(stat("full", 0)) == 150 and len(again.known) == 3
    assert again.unfiltered("mongodb") == 1.0 and again.filtered("mongodb") == 67.0


def test_statistics_are_bounded():
    known = Statistics()
    for i in range(1100):
        known.add(stat("full", i))
    assert len(known.known) == 1000 and known.known[0].milliseconds == 100


def test_advisor_learns_and_falls_back(spark, stores):
    folder = create(spark, "mongodb", {"database_name": "d", "collection_name": "in"}).folder()
    folder.replace(spark.createDataFrame([("a", 1), ("b", 2)], "_id string, v int"))
    hints = ", boolean_updates_expected <- false, boolean_deletes_expected <- false"
    text = f"IN-ENGINE: mongodb(database_name <- 'd', collection_name <- 'in'{hints}), OUT-ENGINE: mongodb(database_name <- 'd', collection_name <- 'out'), OUT._id <- 'x', OUT.s <- SUM(IN.v)"
    assert [m for m, _ in Advisor(spark).candidates(parse(text.replace(hints, ""))[0])] == ["full"]
    (t,) = parse(text)
    advisor = Advisor(spark, randomness=0.0)
    assert [d.mode for d in advisor.evaluate(text)] == ["full"]
    assert [m for m, _ in advisor.candidates(t)] == ["full", "timestamp"]
    # the timestamp mode is unknown, so it is tried first; user-defined ids make it fall back
    assert [d.mode for d in advisor.evaluate(text)] == ["full"]
    advisor.random = random.Random(1)
    advisor.randomness = 1.0
    advisor.evaluate(text)
    advisor.randomness = 0.0
    assert "snapshot" in [m for m, _ in advisor.candidates(t)]
    folder.replace(spark.createDataFrame([("a", 5), ("b", 2)], "_id string, v int"))
    assert advisor.evaluate(text)[0].mode in ("snapshot", "full")
    out = create(spark, "mongodb", {"database_name": "d", "collection_name": "out"}).read().first()
    assert out["s"] == 7.0
    advisor.invalidate(t)
    assert [m for m, _ in advisor.candidates(t)] == ["full"]
    (average,) = parse(text.replace("SUM", "AVG"))
    assert [m for m, _ in advisor.candidates(average)] == ["full"]


# --- configuration, command line, components


def test_config(tmp_path):
    (tmp_path / "c").write_text("spark_master=local[2]\nparallelism = 3 # partitions\nkryo=true\nredis_host=somewhere\nspark.sql.ansi.enabled=true\n")
    config = Config.read(str(tmp_path / "c"))
    assert (config.spark_master, config.parallelism, config.kryo, config.spark) == ("local[2]", 3, True, {"spark.sql.ansi.enabled": "true"})
    (tmp_path / "c").write_text("nonsense=1\n")
    with pytest.raises(ValueError):
        Config.read(str(tmp_path / "c"))


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.json").write_text(json.dumps({"_id": "a", "v": 2}))
    text = f"IN-ENGINE: json(path <- '{tmp_path}/a.json'), OUT-ENGINE: json(path <- '{tmp_path}/o'), OUT._id <- IN._id, OUT.w <- IN.v * 2"
    assert main(["--parse", text]) == 0 and "Transformation" in capsys.readouterr().out
    (tmp_path / "script").write_text(text)
    assert main([f"@{tmp_path}/script"]) == 0 and capsys.readouterr().out.startswith("full:")
    assert create(spark, "json", {"path": f"{tmp_path}/o"}).read().first()["w"] == 4.0


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 9), (9, 8), (5, 5), (3, 4), (20, 21), (21, 4)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 20: 1, 21: 1, 8: 8, 9: 8, 10: 8}
    chain = spark.range(200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert connected_components(chain).agg(F.count("*"), F.max("root")).first()[:] == (201, 0)
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
