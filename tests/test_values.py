"""Semantics of paths, predicates, functions and grouping on small rows."""

import math

import pytest
from pyspark.sql import functions as F

from loomql import functions
from loomql.plans.compiler import DYNAMIC, widen
from loomql.plans.run import result
from loomql.plans.values import CompileError, Val, number

PEOPLE = "_id string, salary bigint, bonus bigint, employer string, tags array<string>, children array<struct<name: string, allowance: double>>, text string"


@pytest.fixture(scope="module")
def people(spark):
    rows = [
        ("A", 10, 1, "X", ["p", "q"], [("Kim", 1.0), ("Lee", 2.0)], "a b  c "),
        ("B", 20, None, "X", ["q"], [("Kim", 3.0)], ""),
        ("C", 30, 3, "Y", [], None, " "),
        ("D", None, 4, None, None, [("Max", None)], None),
    ]
    return spark.createDataFrame(rows, PEOPLE)


def rows(spark, body, df):
    out = result(spark, f"IN-ENGINE: memory(), OUT-ENGINE: memory(), {body}", df)
    return sorted((r.asDict(recursive=True) for r in out.collect()), key=repr)


def ids(spark, predicate, df):
    return [r["_id"] for r in rows(spark, f"IN-FILTER: {predicate}, OUT._id <- IN._id", df)]


def test_missing_first_attribute_drops_the_row(spark, people):
    assert rows(spark, "OUT._id <- IN.employer, OUT.n <- COUNT(1)", people) == [{"_id": "X", "n": 2}, {"_id": "Y", "n": 1}]


def test_missing_later_attribute_is_left_out(spark, people):
    assert rows(spark, "OUT._id <- IN._id, OUT.e <- IN.employer", people)[3] == {"_id": "D", "e": None}


def test_missing_operand_adds_nothing(spark, people):
    assert rows(spark, "OUT._id <- IN.employer, OUT.s <- SUM(IN.salary + IN.bonus)", people) == [{"_id": "X", "s": 11.0}, {"_id": "Y", "s": 33.0}]


def test_empty_aggregates(spark, people):
    got = rows(spark, "OUT._id <- IN._id, OUT.s <- SUM(IN.none), OUT.c <- COUNT(IN.none), OUT.a <- AVG(IN.none), OUT.m <- MIN(IN.none)", people)
    assert got[0] == {"_id": "A", "s": 0.0, "c": 0, "a": 0.0, "m": None}


@pytest.mark.parametrize(
    ("predicate", "expected"),
    [
        ("IN.salary > 15", "BC"), ("15 < IN.salary", "BC"), ("IN.salary >= 20 && IN.bonus", "C"), ("!(IN.bonus = 1)", "BCD"), ("IN.bonus != 1", "CD"),
        ("IN.salary = 10.0", "A"), ("IN.salary = '10'", ""), ("IN.salary != '10'", "ABC"), ("IN.salary < 'z'", ""), ("IN.employer < 'Y'", "AB"),
        ("IN.tags[*] = 'q'", "AB"), ("'p' = IN.tags[*]", "A"), ("IN.tags[*] != 'q'", "A"), ("IN.tags", "ABC"), ("IN.tags[0]", "AB"),
        ("IN.children[?(@.allowance > 2)]", "B"), ("!IN.employer", "D"), ("IN.salary + IN.bonus > 10", "AC"), ("SUM(IN.children[*].allowance) >= 3", "AB"),
        ("COUNT(IN.tags[*]) = 0", "CD"), ("IN.nothing.at.all", ""),
    ],
)
def test_predicates(spark, people, predicate, expected):
    assert "".join(ids(spark, predicate, people)) == expected


def test_both_sides_with_several_values_is_an_error(spark, people):
    with pytest.raises(CompileError):
        ids(spark, "IN.tags[*] = IN.children[*].name", people)


def test_one_binding_gives_name_and_value(spark, people):
    body = "OUT._id <- IN.children[*].name, OUT.parents <- LIST(OBJECT(name <- IN._id, allowance <- IN.children[@].allowance))"
    got = {r["_id"]: r["parents"] for r in rows(spark, body, people)}
    assert got["Kim"] == [{"name": "A", "allowance": 1.0}, {"name": "B", "allowance": 3.0}]
    assert got["Max"] == [{"name": "D", "allowance": None}]


def test_binding_twice_and_reuse_without_binding_are_errors(spark, people):
    with pytest.raises(CompileError):
        rows(spark, "OUT._id <- IN.tags[*], OUT.b <- IN.tags[*]", people)
    with pytest.raises(CompileError):
        rows(spark, "OUT._id <- IN.tags[@]", people)


def test_wildcards_inside_aggregates_do_not_multiply_rows(spark, people):
    got = rows(spark, "OUT._id <- IN.employer, OUT.tags <- COUNT(IN.tags[*]), OUT.sum <- SUM(IN.children[*].allowance), OUT.mean <- AVG(IN.children[*].allowance), OUT.n <- COUNT(1)", people)
    assert got[0] == {"_id": "X", "tags": 3, "sum": 6.0, "mean": 2.0, "n": 2}


def test_wildcards_outside_multiply_rows_and_keep_empty_ones_later(spark, people):
    assert rows(spark, "OUT._id <- IN.tags[*], OUT.n <- COUNT(1)", people) == [{"_id": "p", "n": 1}, {"_id": "q", "n": 2}]
    got = rows(spark, "OUT.id <- IN._id, OUT.tag <- IN.tags[*]", people)
    assert got == [{"id": "A", "tag": "p"}, {"id": "A", "tag": "q"}, {"id": "B", "tag": "q"}, {"id": "C", "tag": None}, {"id": "D", "tag": None}]


def test_index_of_children(spark, people):
    assert rows(spark, "OUT._id <- IN.tags[*].index(), OUT.n <- COUNT(IN.tags[@])", people) == [{"_id": 0, "n": 2}, {"_id": 1, "n": 1}]


def test_correlated_children_inside_an_aggregate(spark, people):
    got = rows(spark, "OUT._id <- 'all', OUT.s <- SUM(IN.children[*].allowance * IN.children[@].allowance)", people)
    assert got == [{"_id": "all", "s": 14.0}]


def test_split_drops_trailing_empty_tokens(spark, people):
    got = {r["_id"]: r["t"] for r in rows(spark, "OUT._id <- IN._id, OUT.t <- LIST(IN.text.split()[*]), OUT.n <- COUNT(IN.text.split()[*])", people)}
    assert got == {"A": ["", "a", "b", "c"], "B": [""], "C": [], "D": []}
    counts = {r["_id"]: r["n"] for r in rows(spark, "OUT._id <- IN._id, OUT.n <- COUNT(IN.text.split('[ ]+')[*])", people)}
    assert counts == {"A": 3, "B": 1, "C": 0, "D": 0}


def test_min_max_implode_list(spark, people):
    got = rows(spark, "OUT._id <- 'all', OUT.low <- MIN(IN.salary), OUT.high <- MAX(IN.employer), OUT.all <- IMPLODE(IN._id), OUT.each <- IMPLODE(IN.tags[*], '|'), OUT.set <- LIST(IN.tags[*])", people)
    assert got == [{"_id": "all", "low": 10, "high": "Y", "all": "A,B,C,D", "each": "p|q|q", "set": ["p", "q"]}]


def test_arithmetic_never_fails(spark, people):
    got = rows(spark, "OUT._id <- IN._id, OUT.q <- IN.salary / (IN.salary - 10), OUT.z <- (IN.salary - 10) / (IN.salary - 10)", people)
    assert got[0]["q"] == math.inf and math.isnan(got[0]["z"]) and got[1]["q"] == 2.0 and got[3]["q"] is None


def test_aggregates_on_both_sides_of_arithmetic(spark, people):
    assert rows(spark, "OUT._id <- 'all', OUT.x <- (SUM(IN.salary) + SUM(IN.bonus)) / COUNT(IN._id)", people) == [{"_id": "all", "x": 17.0}]


def test_sum_of_text_is_an_error(spark, people):
    with pytest.raises(CompileError):
        rows(spark, "OUT._id <- 'all', OUT.x <- SUM(IN.employer)", people)


def test_objects_and_nested_paths(spark, people):
    got = rows(spark, "OUT._id <- IN.employer, OUT.a.b <- SUM(IN.salary), OUT.a.c.d <- COUNT(1), OUT.o <- OBJECT(first <- IN._id, most <- MAX(IN.salary))", people)
    assert got[0] == {"_id": "X", "a": {"b": 30.0, "c": {"d": 2}}, "o": {"first": "A", "most": 20}}
    with pytest.raises(CompileError):
        rows(spark, "OUT.a <- IN._id, OUT.a.b <- 1", people)


def test_nested_grouping(spark, people):
    got = rows(spark, "OUT._id <- 'all', OUT.by <- LIST(OBJECT(e <- IN.employer, s <- SUM(IN.salary), tags <- COUNT(IN.tags[*]))), OUT.n <- COUNT(1)", people)
    assert got[0]["n"] == 4 and {"e": "X", "s": 30.0, "tags": 3} in got[0]["by"] and {"e": "Y", "s": 30.0, "tags": 0} in got[0]["by"]


def test_dynamic_names(spark, people):
    out = result(spark, "IN-ENGINE: memory(), OUT-ENGINE: memory(), OUT._id <- IN.employer, OUT.$(IN._id) <- IN.salary, OUT.n <- COUNT(1)", people)
    got = {r["_id"]: (r[DYNAMIC], r["n"]) for r in out.collect()}
    assert got == {"X": ({"A": 10, "B": 20}, 2), "Y": ({"C": 30}, 1)}
    assert set(widen(out).columns) == {"_id", "n", "A", "B", "C"}


def test_dereference(spark):
    df = spark.createDataFrame([("A", "x", {"x": 1, "y": 2}, [5, 6], 1)], "_id string, key string, m map<string,int>, l array<int>, i int")
    got = rows(spark, "OUT._id <- IN._id, OUT.a <- IN.m.$(IN.key), OUT.b <- IN.l[$(IN.i)]", df)
    assert got == [{"_id": "A", "a": 1, "b": 6}]
    assert rows(spark, "OUT._id <- IN._id, OUT.c <- SUM(IN.m.*), OUT.d <- SUM(IN.m.$(IN.key))", df) == [{"_id": "A", "c": 3.0, "d": 1.0}]
    with pytest.raises(CompileError):  # the place is bound by then
        rows(spark, "OUT.a <- IN.m.$(IN.key), OUT.c <- SUM(IN.m.*)", df)


def test_hidden_names_are_not_children(spark):
    df = spark.createDataFrame([("A", 1, 2, 3)], "_id string, _hidden int, v1 int, v2 int")
    assert rows(spark, "OUT._id <- IN._id, OUT.sum <- SUM(IN.*), OUT.count <- COUNT(IN.*)", df) == [{"_id": "A", "sum": 5.0, "count": 2}]
    assert rows(spark, "OUT._id <- IN._id, OUT.n <- COUNT(IN.?(@))", df.withColumnRenamed("_id", "id").withColumn("_id", F.col("id")))[0]["n"] == 5


def test_mixed_children_are_read_as_text(spark):
    df = spark.createDataFrame([("A", 1, "2.5", "x")], "_id string, a int, b string, c string")
    assert rows(spark, "OUT._id <- IN._id, OUT.n <- COUNT(IN.?(@ > 2))", df) == [{"_id": "A", "n": 1}]


def test_ignored_attribute_groups_but_is_not_returned(spark, people):
    assert rows(spark, "OUT._ <- IN._id, OUT.e <- IN.employer, OUT.n <- COUNT(1)", people) == [{"e": "X", "n": 1}, {"e": "X", "n": 1}, {"e": "Y", "n": 1}, {"e": None, "n": 1}]


def test_out_filter(spark, people):
    assert rows(spark, "OUT-FILTER: IN.n > 1, OUT._id <- IN.employer, OUT.n <- COUNT(1)", people) == [{"_id": "X", "n": 2}]


def test_functions(spark, people):
    got = rows(spark, "OUT._id <- IN._id, OUT.a <- ABS(0 - IN.salary), OUT.s <- SQRT(0 - 1), OUT.e <- EXP(0), OUT.p <- PI(), OUT.h <- HASH(IN.employer), OUT.l <- LIST_COUNT(IN.tags)", people)[0]
    assert got["a"] == 10.0 and math.isnan(got["s"]) and got["e"] == 1.0 and got["p"] == math.pi and got["l"] == 2
    assert got["h"] == "02129bb861061d1a052c592e2dc6b383"[1:]
    with pytest.raises(CompileError):
        rows(spark, "OUT._id <- NO_SUCH(1)", people)


def test_functions_over_aggregates_and_own_functions(spark, people):
    @functions.register("TWICE")
    def twice(v: Val, root) -> Val:
        return Val(number(v, "TWICE") * 2, v.dtype)

    try:
        assert rows(spark, "OUT._id <- 'all', OUT.x <- TWICE(SUM(IN.salary)), OUT.y <- SUM(TWICE(IN.salary))", people) == [{"_id": "all", "x": 120.0, "y": 120.0}]
    finally:
        functions.unregister("TWICE")


def test_own_aggregates(spark, people):
    @functions.register_aggregate("SPREAD")
    def spread(v: Val, *arguments) -> tuple:
        return F.max(v.col) - F.min(v.col), v.dtype

    try:
        assert rows(spark, "OUT._id <- 'all', OUT.x <- SPREAD(IN.salary), OUT.n <- COUNT(1)", people) == [{"_id": "all", "x": 20, "n": 4}]
        with pytest.raises(CompileError):
            rows(spark, "OUT._id <- 'all', OUT.x <- SPREAD(IN.tags[*])", people)
    finally:
        functions.unregister("SPREAD")


def test_fresh_ids_are_made_per_group(spark, people):
    got = rows(spark, "OUT._id <- IN.employer, OUT.id <- OBJECT_ID(), OUT.n <- COUNT(1)", people)
    assert [r["n"] for r in got] in ([2, 1], [1, 2]) and len({r["id"] for r in got}) == 2 and all(len(r["id"]) == 24 for r in got)


def test_plan_prunes_and_pushes_down(spark):
    df_path = "/root/testdata/sf0.001/lineitem.parquet"
    out = result(spark, f"IN-ENGINE: parquet(path <- '{df_path}'), OUT-ENGINE: memory(), IN-FILTER: IN.l_quantity > 10 && IN.l_returnflag = 'N', OUT._id <- IN.l_returnflag, OUT.s <- SUM(IN.l_tax)")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity" in plan and "EqualTo(l_returnflag,N)" in plan
    assert "l_comment" not in plan and "l_shipdate" not in plan and "Python" not in plan
