"""Transformation + source DataFrame → result DataFrame, as one lazy plan.

Attribute specifications are read left to right.  Values without aggregates are columns (new wildcards explode the
rows); with aggregates they become aggregate expressions.  The group key is ``_id`` alone if it is given as a plain value,
else all plain attributes; attributes outside the key keep their least value.  Without aggregates this
is a distinct.  Dynamic names and nested LIST(OBJECT(...)) need a second grouping and are computed in branches that
share the key and are joined on it; a result's dynamic attributes are a map column until a sink (or ``widen``) spreads them.

With ``weight`` (a column of +1 and -1), SUM and COUNT are weighted, which turns signed rows into changes of a result.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomql import functions
from loomql.lang import ast as A
from loomql.lang.parser import DIALECTS, DOCUMENT
from loomql.plans.analyze import nest, unresolved
from loomql.plans.evaluate import VOLATILE, Evaluator
from loomql.plans.values import CompileError, Val, arithmetic, number

#: The map column of attributes with dynamic names.
DYNAMIC = "_dynamic"
IGNORED = "_"
_KEY, _AGG = "__k", "__a"


@dataclass
class Leaf:
    """An aggregate of the grouping: its expression and the type of its result."""

    column: Column
    name: str


def _orderable(t: T.DataType) -> bool:
    if isinstance(t, T.StructType):
        return all(_orderable(f.dataType) for f in t.fields)
    if isinstance(t, T.ArrayType):
        return _orderable(t.elementType)
    return not isinstance(t, (T.MapType, T.VariantType))


class Compiler:
    """Compiles one transformation over one DataFrame."""

    def __init__(self, transformation: A.Transformation, df: DataFrame, dynamic: bool = False, weight: str | None = None):
        self.t, self.weight, self.dynamic = transformation, weight, dynamic
        self.in_dialect, self.out_dialect = DIALECTS[transformation.source.name], DIALECTS[transformation.sink.name]
        self.df = df
        self.counter = 0

    def fresh(self, prefix: str) -> str:
        self.counter += 1
        return f"{prefix}{self.counter}"

    # --- one level of attributes
    def result(self) -> DataFrame:
        ev = self.evaluator(self.df)
        if self.weight:
            ev.df = ev.df.withColumnRenamed(self.weight, "__weight")
        if self.t.in_filter is not None:
            ev.df = ev.df.where(ev.predicate(self.t.in_filter, ev.scope))
        specs = nest(self.t.specs)
        out = self.level(ev, specs, [])
        out = out.drop(*[c for c in out.columns if c.startswith("__") or c == IGNORED or c.startswith(f"{IGNORED}#")])
        if self.t.out_filter is not None:
            late = Evaluator(out, DOCUMENT, DOCUMENT)
            out = out.where(late.predicate(self.t.out_filter, late.scope))
        return out

    def evaluator(self, df: DataFrame) -> Evaluator:
        return Evaluator(df, self.in_dialect, self.out_dialect, self.dynamic)

    def level(self, ev: Evaluator, specs: tuple, outer_keys: list[str]) -> DataFrame:
        """Group ``ev.df`` by ``outer_keys`` and this level's own key; columns named by attribute."""
        plain: dict[str, str] = {}  # attribute → column of its value
        late: list[tuple[str, object, object]] = []  # attribute, value, scope at that point
        dynamic: list[tuple[A.Spec, object]] = []
        empty = True
        for n, spec in enumerate(specs):
            head = spec.path.steps[0]
            if isinstance(head, A.Deref):
                dynamic.append((spec, ev.scope))
            elif unresolved(spec.value):
                late.append((head.name, spec.value, ev.scope))
            else:
                name = head.name if head.name != IGNORED else f"{IGNORED}#{n}"
                v = ev.row(spec.value, outer=not empty)
                column = self.fresh("__p")
                ev.df = ev.df.withColumn(column, v.col)
                if empty:
                    ev.df = ev.df.where(F.col(column).isNotNull())
                plain[name] = column
            empty = False
        # a single resolved dynamic name can explode as well, but stays inside its object
        keyed = ["_id"] if "_id" in plain else list(plain)
        keys = [*outer_keys, *[plain[a] for a in keyed]]
        for c in keys:
            if isinstance(ev.df.schema[c].dataType, (T.MapType, T.VariantType)):
                ev.df = ev.df.withColumn(c, F.to_json(c))
        firsts = {a: c for a, c in plain.items() if a not in keyed}
        return self.grouped(ev, keys, {plain[a]: a for a in keyed}, firsts, late, dynamic, outer_keys)

    def grouped(self, ev, keys, key_names, firsts, late, dynamic, outer_keys) -> DataFrame:
        leaves: list[Leaf] = []
        branches: list[tuple[str, DataFrame]] = []  # column, (keys, column)
        finished: list[tuple[str, Column]] = []
        for attribute, column in firsts.items():
            name = self.fresh(_AGG)
            t = ev.df.schema[column].dataType
            leaves.append(Leaf(self.kept(F.col(column), t), name))
            finished.append((attribute, F.col(name)))
        for attribute, value, scope in late:
            finished.append((attribute, self.unresolved(ev, value, scope, leaves, branches, keys).col))
        if dynamic:
            name = self.fresh("__d")
            branches.append((name, self.dynamic_branch(ev, dynamic, keys, name)))
            finished.append((DYNAMIC, F.col(name)))

        aggregated = [leaf.column.alias(leaf.name) for leaf in leaves]
        if keys:
            grouped = ev.df.groupBy(*keys).agg(*aggregated) if aggregated else ev.df.select(*keys).distinct()
        else:
            grouped = ev.df.agg(*(aggregated or [F.count(F.lit(1)).alias("__n")]))
            if self.weight is None:
                # an empty input has no result row either
                grouped = ev.df.agg(*aggregated, F.count(F.lit(1)).alias("__n")).where("__n > 0") if aggregated else grouped.where("__n > 0")
        for name, branch in branches:
            if keys:
                other = branch.select(*[F.col(k).alias(f"{k}_o") for k in keys], name)
                same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}_o")) for k in keys])
                grouped = grouped.join(other, same, "left").drop(*[f"{k}_o" for k in keys])
            else:
                grouped = grouped.crossJoin(branch.select(name))  # one row on either side
        columns = [F.col(c).alias(a) for c, a in key_names.items()] + [c.alias(a) for a, c in finished]
        return grouped.select(*[F.col(k) for k in outer_keys], *columns)

    def kept(self, col: Column, t: T.DataType) -> Column:
        """The value of an attribute outside the key: the least, or any where there is no order."""
        if self.weight:
            col = F.when(F.col("__weight") > 0, col)
        return F.min(col) if _orderable(t) else F.first(col, ignorenulls=True)

    # --- values known after grouping
    def unresolved(self, ev: Evaluator, node, scope, leaves: list[Leaf], branches, keys) -> Val:
        """The value as an expression over aggregate columns; adds what it needs to ``leaves`` and ``branches``."""
        if isinstance(node, A.Literal):
            return ev.single(node, scope)
        if isinstance(node, A.Aggregate):
            if node.function == "LIST" and isinstance(node.value, A.Construct):
                name = self.fresh("__l")
                branch = self.list_branch(ev, node.value, scope, keys, name)
                branches.append((name, branch))
                return Val(F.coalesce(F.col(name), F.array().cast(branch.schema[name].dataType)), branch.schema[name].dataType)
            column, t = self.aggregate(ev, node, scope)
            name = self.fresh(_AGG)
            leaves.append(Leaf(column, name))
            return Val(F.col(name), t)
        if isinstance(node, A.Arithmetic):
            return arithmetic(node.op, self.unresolved(ev, node.left, scope, leaves, branches, keys), self.unresolved(ev, node.right, scope, leaves, branches, keys))
        if isinstance(node, A.Call):
            build = functions.lookup(node.name, self.in_dialect, self.out_dialect)
            return build(*[self.unresolved(ev, x, scope, leaves, branches, keys) for x in node.arguments], root=ev.schema)
        if isinstance(node, A.Construct):
            return self.construct(ev, node, scope, leaves, branches, keys)
        if ev.free(node, scope):  # several values of one row in an object: the least
            cells, sample = ev.many_typed(node, scope)
            name = self.fresh(_AGG)
            leaves.append(Leaf(F.min(F.array_min(cells)), name))
            return replace(sample, col=F.col(name))
        v = ev.single(node, scope)
        name = self.fresh(_AGG)
        leaves.append(Leaf(self.kept(v.col, v.dtype), name))
        return replace(v, col=F.col(name))

    def construct(self, ev: Evaluator, node: A.Construct, scope, leaves, branches, keys) -> Val:
        """OBJECT(...): a struct, or a map where names are dynamic."""
        fields, maps = [], []
        for spec in nest(node.specs):
            head = spec.path.steps[0]
            if isinstance(head, A.Deref):
                maps.append((spec, scope))
                continue
            v = self.unresolved(ev, spec.value, scope, leaves, branches, keys)
            fields.append((head.name, v))
        if not maps:
            return Val(F.struct(*[v.col.alias(a) for a, v in fields]), T.StructType([T.StructField(a, v.dtype) for a, v in fields]))
        name = self.fresh("__d")
        branch = self.dynamic_branch(ev, maps, keys, name)
        branches.append((name, branch))
        t = branch.schema[name].dataType
        found = F.coalesce(F.col(name), F.create_map().cast(t))
        if fields:
            fixed = F.create_map(*[x for a, v in fields for x in (F.lit(a), v.col.cast(t.valueType))])
            found = F.map_concat(F.map_filter(fixed, lambda _, v: v.isNotNull()), F.map_filter(found, lambda k, _: ~k.isin([a for a, _ in fields])))
        return Val(found, t)

    def aggregate(self, ev: Evaluator, node: A.Aggregate, scope) -> tuple[Column, T.DataType]:
        """An aggregate over the group and over the values that each row yields."""
        if unresolved(node.value):
            raise CompileError("aggregates can't be nested")
        if not ev.free(node.value, scope):
            v = ev.single(node.value, scope)
            return self.over_values(node, v)
        if functions.own_aggregate(node.function):
            raise CompileError(f"{node.function} takes one value a row")
        cells, sample = ev.many_typed(node.value, scope)
        name = self.fresh("__m")
        ev.df = ev.df.withColumn(name, cells)
        return self.over_arrays(node, F.col(name), sample)

    def signed(self, col: Column) -> Column:
        return col * F.col("__weight") if self.weight else col

    def over_values(self, node: A.Aggregate, v: Val) -> tuple[Column, T.DataType]:
        f = node.function
        if (build := functions.own_aggregate(f)) is not None:
            return build(v, *node.arguments)
        if f == "COUNT":
            if self.weight:
                return F.coalesce(F.sum(F.when(v.col.isNotNull(), F.col("__weight"))), F.lit(0)).cast("long"), T.LongType()
            return F.count(v.col), T.LongType()
        if f == "SUM":
            return F.coalesce(F.sum(self.signed(number(v, f))), F.lit(0.0)), T.DoubleType()
        if f == "AVG":
            return F.coalesce(F.avg(number(v, f)), F.lit(0.0)), T.DoubleType()
        if f in ("MIN", "MAX"):
            v = self.comparable(v, f)
            return (F.min if f == "MIN" else F.max)(v.col), v.dtype
        if f == "IMPLODE":
            return F.array_join(F.array_sort(F.collect_list(v.col.cast("string"))), str(node.arguments[0]) if node.arguments else ","), T.StringType()
        if isinstance(v.dtype, (T.MapType, T.VariantType)):
            v = Val(F.to_json(v.col), T.StringType())
        return F.array_sort(F.collect_set(v.col)), T.ArrayType(v.dtype)

    def over_arrays(self, node: A.Aggregate, cells: Column, sample: Val) -> tuple[Column, T.DataType]:
        f = node.function
        each = lambda x: number(replace(sample, col=x), f)
        total = lambda: F.aggregate(cells, F.lit(0.0), lambda a, x: a + each(x))
        if f == "COUNT":
            return F.coalesce(F.sum(self.signed(F.size(cells).cast("long"))), F.lit(0)).cast("long"), T.LongType()
        if f == "SUM":
            return F.coalesce(F.sum(self.signed(total())), F.lit(0.0)), T.DoubleType()
        if f == "AVG":
            n = F.sum(F.size(cells))
            return F.when(n > 0, F.sum(total()) / n).otherwise(0.0), T.DoubleType()
        if f in ("MIN", "MAX"):
            self.comparable(sample, f)
            return (F.min(F.array_min(cells)) if f == "MIN" else F.max(F.array_max(cells))), sample.dtype
        if f == "IMPLODE":
            text = F.transform(F.flatten(F.collect_list(cells)), lambda x: x.cast("string"))
            return F.array_join(F.array_sort(text), str(node.arguments[0]) if node.arguments else ","), T.StringType()
        return F.array_sort(F.array_distinct(F.flatten(F.collect_set(cells)))), T.ArrayType(sample.dtype)

    @staticmethod
    def comparable(v: Val, f: str) -> Val:
        if not _orderable(v.dtype) or isinstance(v.dtype, (T.StructType, T.ArrayType)):
            raise CompileError(f"{f} needs atoms")
        if v.dynamic and isinstance(v.dtype, T.StringType):
            return Val(number(v, f), T.DoubleType())
        return v

    # --- branches
    def list_branch(self, ev: Evaluator, node: A.Construct, scope, keys, name: str) -> DataFrame:
        """LIST(OBJECT(...)): items with equal plain attributes merge, so this is a grouping inside the group."""
        inner = self.evaluator(ev.df)
        inner.schema, inner.scope = ev.schema, scope
        items = self.level(inner, nest(node.specs), list(keys))
        attributes = [c for c in items.columns if c not in keys and not c.startswith(f"{IGNORED}#")]
        item = F.struct(*[F.col(f"`{a}`") for a in attributes])
        if not all(_orderable(items.schema[a].dataType) for a in attributes):
            return self.by_key(items, keys, F.collect_list(item).alias(name))
        return self.by_key(items, keys, F.array_sort(F.collect_list(item)).alias(name))

    @staticmethod
    def by_key(df: DataFrame, keys, *columns: Column) -> DataFrame:
        return df.groupBy(*keys).agg(*columns) if keys else df.agg(*columns)

    def dynamic_branch(self, ev: Evaluator, specs, keys, name: str) -> DataFrame:
        """(keys, map of dynamic attributes): entries by (key, name), then one map a key."""
        parts = []
        for spec, scope in specs:
            parts.append(self.entries(ev, spec, scope, keys))
        types = [p.schema["v"].dataType for p in parts]
        if any(t != types[0] for t in types):
            parts = [p.withColumn("v", F.col("v").cast("string")) for p in parts]
        long = reduce(lambda a, b: a.unionByName(b), parts).where("n IS NOT NULL AND v IS NOT NULL")
        if len(parts) > 1:
            t = long.schema["v"].dataType
            long = long.groupBy(*keys, "n").agg((F.min("v") if _orderable(t) else F.first("v")).alias("v"))
        entry = F.struct("n", "v")
        cells = F.collect_list(entry)
        ordered = F.array_sort(cells, lambda a, b: F.when(a["n"] < b["n"], -1).when(a["n"] > b["n"], 1).otherwise(0))
        return self.by_key(long, keys, F.map_from_entries(ordered).alias(name))

    def entries(self, ev: Evaluator, spec: A.Spec, scope, keys) -> DataFrame:
        """(keys, n, v): one row for each key and dynamic name of one specification."""
        path, value = A.PathValue(spec.path.steps[0].path), spec.value
        branch = self.evaluator(ev.df)
        branch.schema, branch.scope = ev.schema, scope
        # the name binds first, so that @ in the value means the same child; names only multiply rows in this branch
        n = branch.row(path, outer=False)
        branch.df = branch.df.withColumn("__name", n.col.cast("string")).where("__name IS NOT NULL")
        if not unresolved(value):
            v = branch.row(value, outer=False)
            branch.df = branch.df.withColumn("__value", v.col)
            found = branch.df.groupBy(*keys, F.col("__name").alias("n")).agg(self.kept(F.col("__value"), v.dtype).alias("v"))
            return found
        leaves: list[Leaf] = []
        branches: list[tuple[str, DataFrame]] = []
        v = self.unresolved(branch, value, branch.scope, leaves, branches, [*keys, "__name"])
        long = branch.df.groupBy(*keys, "__name").agg(*[x.column.alias(x.name) for x in leaves]) if leaves else branch.df.select(*keys, "__name").distinct()
        for column, other in branches:
            both = [*keys, "__name"]
            renamed = other.select(*[F.col(k).alias(f"{k}_o") for k in both], column)
            long = long.join(renamed, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}_o")) for k in both]), "left")
        return long.select(*keys, F.col("__name").alias("n"), v.col.alias("v"))


def compile_transformation(transformation: A.Transformation, df: DataFrame, dynamic: bool = False, weight: str | None = None) -> DataFrame:
    """The result of ``transformation`` over ``df`` (the source's rows)."""
    return Compiler(transformation, df, dynamic, weight).result()


def widen(df: DataFrame, most: int = 10_000) -> DataFrame:
    """Spread the map of dynamic attributes to columns; their distinct names (at most ``most``) come from one job."""
    if DYNAMIC not in df.columns:
        return df
    names = [r[0] for r in df.select(F.explode(F.map_keys(DYNAMIC))).distinct().limit(most + 1).collect()]
    if len(names) > most:
        raise CompileError(f"more than {most} dynamic attributes; keep them as a map")
    fixed = set(df.columns) - {DYNAMIC}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != DYNAMIC], *[F.try_element_at(F.col(DYNAMIC), F.lit(n)).alias(n) for n in sorted(set(names) - fixed)])


__all__ = ["DYNAMIC", "VOLATILE", "Compiler", "compile_transformation", "widen"]
