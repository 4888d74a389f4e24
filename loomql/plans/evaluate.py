"""Evaluation of paths, values and predicates to Spark columns.

Paths navigate a row by its schema.  A step that can yield several children *binds*: in row mode it explodes the
DataFrame once and later steps at the same place reuse that child; inside aggregates and predicates it becomes a
higher-order function over the children, so the row isn't multiplied.  Evaluation is written in continuation style: a binding step
calls the rest of the expression for each child, with that child in scope.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomql import functions
from loomql.lang import ast as A
from loomql.lang.parser import COLUMN, DOCUMENT
from loomql.plans.values import CompileError, Val, arithmetic, as_type, common, compare, literal, number, tokens

ROOT = ("row",)
#: Functions whose value is made anew for each result row.
VOLATILE = ("OBJECT_ID",)
_names = count()


@dataclass(frozen=True)
class Scope:
    """Bound children by place (the path of the parent), and the child under test in a predicate."""

    bound: dict = field(default_factory=dict)
    current: Val | None = None
    depth: int = 0

    def bind(self, place: tuple, child: Val) -> Scope:
        return replace(self, bound={**self.bound, place: child})

    def test(self, child: Val) -> Scope:
        return replace(self, current=child, depth=self.depth + 1)


class Items(tuple):
    """The children of a list, as ``Evaluator.children`` gives them, with the list itself."""

    whole: Column

    def __new__(cls, cells: Column, t: T.DataType, dynamic: bool, whole: Column):
        made = super().__new__(cls, (cells, t, dynamic))
        made.whole = whole
        return made


class Evaluator:
    """Columns over one DataFrame; ``df`` grows by exploded children in row mode."""

    def __init__(self, df: DataFrame, in_dialect: str = DOCUMENT, out_dialect: str = DOCUMENT, dynamic: bool = False):
        self.df, self.in_dialect, self.out_dialect, self.dynamic = df, in_dialect, out_dialect, dynamic
        self.schema = T.StructType([f for f in df.schema.fields if not f.name.startswith("__")])
        self.scope = Scope()

    # --- children of a place
    def _root_child(self, name: str, family: str | None) -> Val | None:
        if self.in_dialect == COLUMN and name != "_id":
            families = [f for f in self.schema.fields if isinstance(f.dataType, T.MapType) and family in (None, f.name)]
            if not families:
                return None
            found = [F.try_element_at(F.col(f"`{f.name}`"), F.lit(name)) for f in families]
            return Val(F.coalesce(*found) if len(found) > 1 else found[0], families[0].dataType.valueType, self.dynamic, F.lit(name))
        for f in self.schema.fields:
            if f.name == name:
                return Val(F.col(f"`{name}`"), f.dataType, self.dynamic, F.lit(name))
        return None

    def child(self, parent: Val | None, step, family: str | None = None) -> Val | None:
        """The child at a fixed name or position; None if the schema has none."""
        if parent is None:
            return self._root_child(step, family)
        t = parent.dtype
        if isinstance(t, T.StructType) and step in t.names:
            return Val(parent.col.getField(step), t[step].dataType, parent.dynamic, F.lit(step))
        if isinstance(t, T.MapType):
            return Val(F.try_element_at(parent.col, F.lit(str(step))), t.valueType, parent.dynamic, F.lit(str(step)))
        if isinstance(t, T.ArrayType) and (isinstance(step, int) or str(step).isdigit()):
            return Val(F.get(parent.col, F.lit(int(step))), t.elementType, parent.dynamic, None, F.lit(int(step)))
        return None

    def children(self, parent: Val | None, family: str | None = None, hidden: bool = False) -> tuple[Column, T.DataType, bool]:
        """(array of structs n, i, v; type of v; dynamic) of all children that are present."""
        if parent is None and self.in_dialect == COLUMN:
            maps = [f for f in self.schema.fields if isinstance(f.dataType, T.MapType) and family in (None, f.name)]
            if not maps:
                raise CompileError("the table has no such column family")
            arrays = [self._entries(F.col(f"`{f.name}`"), hidden) for f in maps]
            return (F.concat(*[F.coalesce(a, F.array().cast(self._child_type(maps[0].dataType.valueType))) for a in arrays]) if len(arrays) > 1 else arrays[0]), maps[0].dataType.valueType, self.dynamic
        if parent is None or isinstance(parent.dtype, T.StructType):
            fields = [f for f in (self.schema if parent is None else parent.dtype).fields if hidden or not f.name.startswith("_")]
            if not fields:
                return F.array().cast(self._child_type(T.StringType())), T.StringType(), True
            t = common([f.dataType for f in fields])
            of = (lambda n: F.col(f"`{n}`")) if parent is None else (lambda n: parent.col.getField(n))
            cells = [F.struct(F.lit(f.name).alias("n"), F.lit(None).cast("int").alias("i"), as_type(of(f.name), f.dataType, t).alias("v")) for f in fields]
            mixed = isinstance(t, T.StringType) and any(not isinstance(f.dataType, T.StringType) for f in fields)
            dynamic = mixed or (self.dynamic if parent is None else parent.dynamic)
            return F.filter(F.array(*cells), lambda c: c["v"].isNotNull()), t, dynamic
        if isinstance(parent.dtype, T.MapType):
            return self._entries(parent.col, hidden), parent.dtype.valueType, parent.dynamic
        if isinstance(parent.dtype, T.ArrayType):
            cells = F.transform(parent.col, lambda x, i: F.struct(F.lit(None).cast("string").alias("n"), i.alias("i"), x.alias("v")))
            return Items(F.filter(cells, lambda c: c["v"].isNotNull()), parent.dtype.elementType, parent.dynamic, parent.col)
        raise CompileError(f"{parent.dtype.simpleString()} has no children")

    @staticmethod
    def _child_type(value: T.DataType) -> T.ArrayType:
        return T.ArrayType(T.StructType([T.StructField("n", T.StringType()), T.StructField("i", T.IntegerType()), T.StructField("v", value)]))

    @staticmethod
    def _entries(col: Column, hidden: bool) -> Column:
        cells = F.transform(F.map_entries(col), lambda e: F.struct(e["key"].cast("string").alias("n"), F.lit(None).cast("int").alias("i"), e["value"].alias("v")))
        return F.filter(cells, lambda c: c["v"].isNotNull() & (F.lit(True) if hidden else ~F.startswith(c["n"], F.lit("_"))))

    # --- binding
    def each(self, found: tuple[Column, T.DataType, bool], then: Callable[[Val], Column], keep: Callable[[Val], Column] | None = None) -> Column:
        """An array with the results of ``then`` for each child that ``keep`` accepts."""
        cells, t, dynamic = found
        val = lambda c: Val(c["v"], t, dynamic, c["n"], c["i"])
        if keep is not None:
            cells = F.filter(cells, lambda c: F.coalesce(keep(val(c)), F.lit(False)))
        return F.flatten(F.filter(F.transform(cells, lambda c: then(val(c))), lambda inner: inner.isNotNull()))

    def explode(self, found: tuple[Column, T.DataType, bool], outer: bool, keep: Callable[[Val], Column] | None = None) -> Val:
        """One row for each accepted child; with ``outer`` a row without any stays, its child missing."""
        cells, t, dynamic = found
        if isinstance(found, Items) and not outer:  # plain rows, without an array of structs
            at, item = (f"__b{next(_names)}" for _ in range(2))
            self.df = self.df.select("*", F.posexplode(found.whole).alias(at, item)).where(F.col(item).isNotNull())
            child = Val(F.col(item), t, dynamic, F.lit(None).cast("string"), F.col(at))
            if keep is not None:
                self.df = self.df.where(F.coalesce(keep(child), F.lit(False)))
            return child
        val = lambda c: Val(c["v"], t, dynamic, c["n"], c["i"])
        if keep is not None:
            cells = F.filter(cells, lambda c: F.coalesce(keep(val(c)), F.lit(False)))
        name = f"__b{next(_names)}"
        self.df = self.df.withColumn(name, (F.explode_outer if outer else F.explode)(cells))
        return val(F.col(name))

    # --- paths
    def walk(self, path: A.Path, scope: Scope, then: Callable[[Scope, Val], Column], bind) -> Column:
        """Follow ``path``; ``bind(found, keep, place, scope, go)`` handles steps that can yield several children."""

        def go(i: int, node: Val | None, place: tuple, scope: Scope) -> Column:
            if i == len(path.steps):
                if node is None:
                    raise CompileError("a path must name something in the row")
                return then(scope, node)
            step = path.steps[i]
            if isinstance(step, A.Name):
                found = self.child(node, step.name, step.family)
                if found is None:
                    return then(scope, Val(F.lit(None).cast("string"), T.StringType(), True, F.lit(None).cast("string"), F.lit(None).cast("int")))
                return go(i + 1, found, (*place, step.name), scope)
            if isinstance(step, A.Index):
                found = self.child(node, step.position)
                if found is None:
                    raise CompileError("a position needs a list")
                return go(i + 1, found, (*place, step.position), scope)
            if isinstance(step, A.NameOf):
                if node is None or node.name is None:
                    raise CompileError("name() needs a child of an object")
                return then(scope, Val(node.name, T.StringType()))
            if isinstance(step, A.IndexOf):
                if node is None or node.position is None:
                    raise CompileError("index() needs a child of a list")
                return then(scope, Val(F.when(node.col.isNotNull(), node.position).cast("long"), T.LongType()))
            if isinstance(step, A.Split):
                parts = Val(tokens(node, step.delimiter), T.ArrayType(T.StringType()), node.dynamic)
                return go(i + 1, parts, (*place, ("split", step.delimiter)), scope)
            if isinstance(step, A.Current) or getattr(step, "reuse", False) and place in scope.bound:
                if place not in scope.bound:
                    raise CompileError("@ needs an earlier step that chose a child here")
                if isinstance(step, A.Where):
                    raise CompileError("this place is already bound")
                return go(i + 1, scope.bound[place], (*place, "@"), scope)
            if place in scope.bound:
                raise CompileError("this place is already bound; use @")
            keep, family = None, getattr(step, "family", None)
            if isinstance(step, A.Where):
                keep = lambda c: self.predicate(step.predicate, scope.bind(place, c).test(c))
            if isinstance(step, A.Deref):
                return self._deref(step, node, scope, lambda s, c: go(i + 1, c, (*place, "@"), s.bind(place, c)), bind, place)
            found = self.children(node, family, hidden=isinstance(step, A.Where))
            return bind(found, keep, scope, lambda c: go(i + 1, c, (*place, "@"), scope.bind(place, c)), place)

        if path.absolute:
            return go(0, None, ROOT, scope)
        if scope.current is None:
            raise CompileError("a relative path stands only inside ?()")
        return go(0, scope.current, ("test", scope.depth), scope)

    def _deref(self, step: A.Deref, node: Val | None, scope: Scope, then, bind, place: tuple) -> Column:
        """Children whose name or position is a value of the inner path."""
        if not self.free(A.PathValue(step.path), scope):
            holder: list[Val] = []
            self.walk(step.path, scope, lambda s, v: holder.append(v) or v.col, bind)
            wanted = holder[0]
            if node is not None and isinstance(node.dtype, T.MapType):
                key = wanted.col.cast("string")
                return then(scope, Val(F.try_element_at(node.col, key), node.dtype.valueType, node.dynamic, key))
            if node is not None and isinstance(node.dtype, T.ArrayType):
                at = wanted.col.cast("int")
                return then(scope, Val(F.get(node.col, at), node.dtype.elementType, node.dynamic, None, at))
            keep = lambda c: c.name == wanted.col.cast("string")
            return bind(self.children(node, step.family, hidden=True), keep, scope, lambda c: then(scope, c), place)
        names = self.many(A.PathValue(step.path), scope)
        by_position = node is not None and isinstance(node.dtype, T.ArrayType)
        keep = lambda c: F.array_contains(F.transform(names, lambda x: x.cast("string")), (c.position if by_position else c.name).cast("string"))
        return bind(self.children(node, step.family, hidden=True), keep, scope, lambda c: then(scope, c), place)

    def free(self, node, scope: Scope) -> bool:
        """Whether an expression holds a step that would bind a new child (outside nested aggregates)."""
        if isinstance(node, A.Path):
            place = ROOT if node.absolute else ("test", scope.depth)
            for step in node.steps:
                if isinstance(step, (A.Wild, A.Where)) and place not in scope.bound:
                    return True
                if isinstance(step, A.Deref):
                    if place not in scope.bound:
                        return True
                    place = (*place, "@")
                    continue
                mark = {A.Name: lambda s: s.name, A.Index: lambda s: s.position, A.Split: lambda s: ("split", s.delimiter)}.get(type(step), lambda s: "@")(step)
                place = (*place, mark)
            return False
        if isinstance(node, (A.Aggregate, A.Construct)):
            return False
        if isinstance(node, tuple):
            return any(self.free(x, scope) for x in node)
        if hasattr(node, "__dataclass_fields__"):
            return any(self.free(getattr(node, f), scope) for f in node.__dataclass_fields__)
        return False

    # --- values
    def value(self, node, scope: Scope, then: Callable[[Scope, Val], Column], bind) -> Column:
        """Evaluate an expression without vertical aggregates, left to right."""
        if isinstance(node, A.Literal):
            return then(scope, literal(node.value))
        if isinstance(node, A.PathValue):
            return self.walk(node.path, scope, then, bind)
        if isinstance(node, A.Arithmetic):
            return self.value(node.left, scope, lambda s, a: self.value(node.right, s, lambda s2, b: then(s2, arithmetic(node.op, a, b)), bind), bind)
        if isinstance(node, A.Call):
            build = functions.lookup(node.name, self.in_dialect, self.out_dialect)

            def rest(s: Scope, done: tuple[Val, ...]) -> Column:
                if len(done) == len(node.arguments):
                    return then(s, build(*done, root=self.schema))
                return self.value(node.arguments[len(done)], s, lambda s2, v: rest(s2, (*done, v)), bind)

            return rest(scope, ())
        if isinstance(node, A.Aggregate):  # inside one row, as in a predicate
            return then(scope, self.fold(node, scope))
        raise CompileError(f"{type(node).__name__} can't stand here")

    def single(self, node, scope: Scope) -> Val:
        """The value of an expression that binds nothing new."""
        out: list[Val] = []

        def no_binding(*_):
            raise CompileError("several values where one is needed")

        self.value(node, scope, lambda s, v: out.append(v) or v.col, no_binding)
        if not out:
            raise CompileError("the path doesn't exist")
        return out[0]

    def many_typed(self, node, scope: Scope) -> tuple[Column, Val]:
        """(array of the values that an expression yields for a row, one of them as an example of type)."""
        sample: list[Val] = []

        def take(_: Scope, v: Val) -> Column:
            sample.append(v)
            return F.array(v.col)

        def bind(found, keep, scope, go, place):
            return self.each(found, go, keep)

        cells = self.value(node, scope, take, bind)
        return F.filter(cells, lambda x: x.isNotNull()), sample[0]

    def many(self, node, scope: Scope) -> Column:
        return self.many_typed(node, scope)[0]

    def row(self, node, outer: bool) -> Val:
        """The value in row mode: new children multiply the rows and stay bound in ``self.scope``."""
        out: list[tuple[Scope, Val]] = []

        def bind(found, keep, scope, go, place):
            return go(self.explode(found, outer, keep))

        self.value(node, self.scope, lambda s, v: out.append((s, v)) or v.col, bind)
        self.scope, v = out[0]
        return v

    def fold(self, node: A.Aggregate, scope: Scope) -> Val:
        """An aggregate over the values of one row."""
        cells, sample = self.many_typed(node.value, scope)
        each = lambda x: number(replace(sample, col=x), node.function)
        if node.function == "COUNT":
            return Val(F.coalesce(F.size(cells), F.lit(0)).cast("long"), T.LongType())
        total = lambda: F.aggregate(cells, F.lit(0.0), lambda a, x: a + each(x))
        if node.function == "SUM":
            return Val(F.coalesce(total(), F.lit(0.0)), T.DoubleType())
        if node.function == "AVG":
            return Val(F.when(F.size(cells) > 0, total() / F.size(cells)).otherwise(0.0), T.DoubleType())
        if node.function in ("MIN", "MAX"):
            return replace(sample, col=(F.array_min if node.function == "MIN" else F.array_max)(cells))
        if node.function == "IMPLODE":
            return Val(F.array_join(F.transform(cells, lambda x: x.cast("string")), str(node.arguments[0]) if node.arguments else ","), T.StringType())
        return Val(F.array_sort(F.array_distinct(cells)), T.ArrayType(sample.dtype))

    # --- predicates
    def predicate(self, node, scope: Scope) -> Column:
        """Two-valued: what can't be compared is false.  NULL stands for false where the caller reads it as false."""
        if isinstance(node, A.And):
            return self.predicate(node.left, scope) & self.predicate(node.right, scope)
        if isinstance(node, A.Or):
            return self.predicate(node.left, scope) | self.predicate(node.right, scope)
        if isinstance(node, A.Not):
            return ~F.coalesce(self.predicate(node.inner, scope), F.lit(False))
        if isinstance(node, A.Exists):
            path = A.PathValue(node.path)
            if self.free(path, scope):
                return F.size(self.many(path, scope)) > 0
            return self.single(path, scope).col.isNotNull()
        if isinstance(node, A.Compare):
            left, right = self.free(node.left, scope), self.free(node.right, scope)
            if left and right:
                raise CompileError("only one side of a comparison may have several values")
            if not left and not right:
                return compare(node.op, self.single(node.left, scope), self.single(node.right, scope))
            cells, sample = self.many_typed(node.left if left else node.right, scope)
            fixed = self.single(node.right if left else node.left, scope)
            test = (lambda x: compare(node.op, replace(sample, col=x), fixed)) if left else (lambda x: compare(node.op, fixed, replace(sample, col=x)))
            return F.exists(cells, lambda x: F.coalesce(test(x), F.lit(False)))
        raise CompileError(f"{type(node).__name__} is no predicate")

