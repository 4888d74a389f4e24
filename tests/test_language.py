"""Lexer and parser: grammar, dialects, errors."""

import pytest

from loomql.lang import ast as A
from loomql.lang.lexer import ParseError, tokenize
from loomql.lang.parser import COLUMN, KEY_VALUE, parse, parse_predicate

DOC = "IN-ENGINE: memory(name <- 'a'), OUT-ENGINE: memory(name <- 'b'), "
WIDE = "IN-ENGINE: hbase(table_id <- 'a'), OUT-ENGINE: hbase(table_id <- 'b'), "
KEYS = "IN-ENGINE: redis(database_id <- '0'), OUT-ENGINE: redis(database_id <- '1'), "
CSV = "IN-ENGINE: csv(path <- 'a'), OUT-ENGINE: csv(path <- 'b'), "


def only(text):
    (t,) = parse(text)
    return t


def value(text, engine=DOC):
    return only(f"{engine}OUT.x <- {text}").specs[0].value


def steps(text, engine=DOC):
    return value(text, engine).path.steps


def test_tokens_know_their_place_and_comments_are_skipped():
    tokens = tokenize("OUT.a # all of it <- \n <- 1.5")
    assert [t.text for t in tokens] == ["OUT", ".", "a", "<-", "1.5", ""]
    assert (tokens[3].line, tokens[3].column) == (2, 1)


def test_statement_parts():
    t = only(DOC + "IN-FILTER: IN.a > 1, OUT-FILTER: IN.x > 2, OUT._id <- IN.k, OUT.x <- SUM(IN.a)")
    assert t.source == A.Engine("memory", {"name": "a"}) and t.sink.parameters == {"name": "b"}
    assert isinstance(t.in_filter, A.Compare) and isinstance(t.out_filter, A.Compare)
    assert [s.path.steps[0].name for s in t.specs] == ["_id", "x"]


def test_scripts_hold_several_statements():
    assert len(parse(f"{DOC}OUT.a <- 1; {DOC}OUT.b <- 2;")) == 2


def test_precedence():
    v = value("IN.a + IN.b * 2 - 1")
    assert v.op == "-" and v.left.op == "+" and v.left.right.op == "*"
    p = only(DOC + "IN-FILTER: IN.a = 1 || IN.b = 2 && !IN.c, OUT.x <- 1").in_filter
    assert isinstance(p, A.Or) and isinstance(p.right, A.And) and isinstance(p.right.right, A.Not)


def test_star_is_a_wildcard_after_a_dot_and_a_product_after_a_name():
    assert steps("IN.*") == (A.Wild(),)
    assert value("IN.a * IN.b").op == "*"
    assert value("SUM(IN.salary+IN.bonus)").value.op == "+"


def test_brackets_in_predicates():
    p = only(DOC + "IN-FILTER: (IN.a + 1) * 2 > 5 && (IN.b = 1 || (IN.c)), OUT.x <- 1").in_filter
    assert isinstance(p.left, A.Compare) and isinstance(p.right, A.Or) and isinstance(p.right.right, A.Exists)


def test_literals():
    assert [value(x).value for x in ("1", "1.5", "'a b'", "true", "false")] == [1, 1.5, "a b", True, False]


def test_document_paths():
    assert steps("IN.a[3].b") == (A.Name("a"), A.Index(3), A.Name("b"))
    assert steps("IN.a[*].index()") == (A.Name("a"), A.Wild(), A.IndexOf())
    assert steps("IN.*.name()") == (A.Wild(), A.NameOf())
    assert steps("IN.a[@].b") == (A.Name("a"), A.Current(), A.Name("b"))
    assert steps("IN.a.$(IN.k)") == (A.Name("a"), A.Deref(A.Path((A.Name("k"),))))
    assert steps("IN.t.split()[*]") == (A.Name("t"), A.Split(" "), A.Wild())
    assert steps("IN.t.split(';')[0]") == (A.Name("t"), A.Split(";"), A.Index(0))
    assert steps("IN.split.name") == (A.Name("split"), A.Name("name"))
    assert steps("IN.7.x") == (A.Name("7"), A.Name("x"))
    where = steps("IN.?(@.x > 5)")[0]
    assert where.predicate.left.path == A.Path((A.Name("x"),), absolute=False)


def test_wide_column_paths():
    assert steps("IN._r", WIDE) == (A.Name("_id"),)
    assert steps("IN._c", WIDE) == (A.Wild(reuse=True), A.NameOf())
    assert steps("IN.fam:_v", WIDE) == (A.Wild(reuse=True, family="fam"),)
    assert steps("IN.fam:col", WIDE) == (A.Name("col", "fam"),)
    assert steps("IN.fam:$(IN._r)", WIDE) == (A.Deref(A.Path((A.Name("_id"),)), "fam"),)
    assert isinstance(steps("IN._v?(@ > 5)", WIDE)[0], A.Where)
    assert steps("IN.col.split(',')", WIDE) == (A.Name("col"), A.Split(","), A.Wild(reuse=True))


def test_key_value_and_table_paths():
    assert steps("IN._k", KEYS) == (A.Name("_id"),)
    assert steps("IN._v.a:b", KEYS) == (A.Name("_v"), A.Name("a:b"))
    assert steps("IN._v.*.name()", KEYS) == (A.Name("_v"), A.Wild(), A.NameOf())
    assert steps("IN._v[*].index()", KEYS) == (A.Name("_v"), A.Wild(), A.IndexOf())
    assert steps("IN._v.split(';')", KEYS) == (A.Name("_v"), A.Split(";"), A.Wild(reuse=True))
    assert steps("IN.col", CSV) == (A.Name("col"),)
    assert steps("IN._v", CSV) == (A.Wild(reuse=True),)


def test_output_paths_by_dialect():
    out = lambda engine, path: only(f"{engine}OUT.{path} <- 1").specs[0].path.steps
    assert out(DOC, "a.b") == (A.Name("a"), A.Name("b"))
    assert out(WIDE, "_r") == (A.Name("_id"),)
    assert out(WIDE, "x") == (A.Name("default"), A.Name("x"))
    assert out(WIDE, "f:x") == (A.Name("f"), A.Name("x"))
    assert out(KEYS, "_k") == (A.Name("_id"),)
    assert out(KEYS, "x") == (A.Name("_v"), A.Name("x"))
    assert out(KEYS, "_v") == (A.Name("_v"),)


def test_constructors_and_functions():
    v = value("LIST(OBJECT(a <- IN.x, $(IN.k) <- SUM(IN.y)))")
    assert isinstance(v.value, A.Construct) and isinstance(v.value.specs[1].path.steps[0], A.Deref)
    assert value("HM(f <- IN._v)", KEYS).name == "HM"
    assert value("EXP(IN.a, 2)") == A.Call("EXP", (A.PathValue(A.Path((A.Name("a"),))), A.Literal(2)))
    assert value("IMPLODE(IN.a, ';')").arguments == (";",)


@pytest.mark.parametrize("text", ["", "OUT.a <- 1", DOC, DOC + "OUT.a <-", DOC + "OUT.a <- SUM()", DOC + "OUT.a <- IN", DOC + "OUT.a <- 'open", DOC + "OUT.a <- 1 extra", DOC + "OUT.a <- -1", "IN-ENGINE: nowhere(), OUT-ENGINE: memory(), OUT.a <- 1", DOC + "OUT-FILTER: IN.a, IN-FILTER: IN.b, OUT.a <- 1", KEYS + "OUT.a <- IN.x"])
def test_syntax_errors(text):
    with pytest.raises(ParseError) as error:
        parse(text)
    assert error.value.line >= 1


def test_predicates_alone():
    assert isinstance(parse_predicate("IN.a.b"), A.Exists)
    assert parse_predicate("IN._v.a > 1", KEY_VALUE).op == ">"
    assert parse_predicate("IN.f:c = 'x'", COLUMN).left.path.steps == (A.Name("c", "f"),)
