"""Running scripts: full recomputation, incremental runs, and change batches."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from loomql.lang import ast as A
from loomql.lang.parser import parse
from loomql.operators.incremental import WEIGHT
from loomql.plans.analyze import check_incremental, is_aggregating, nest, unresolved
from loomql.plans.compiler import DYNAMIC, compile_transformation
from loomql.plans.evaluate import Evaluator
from loomql.plans.scratch import cut
from loomql.plans.values import CompileError
from loomql.sources.registry import Engine, create
from loomql.sources.stores import Store


@dataclass(frozen=True)
class Run:
    """What one transformation did: its mode, when it started (ms; the next timestamp), and how long it took."""

    mode: str
    started: int
    milliseconds: float
    stored: bool = True


def sums_of(specs: tuple) -> dict:
    """Tree of attributes: True for sums and counts, which add up; False for others; * for dynamic names."""
    out: dict = {}
    for spec in nest(specs):
        head = spec.path.steps[0]
        how = sums_of(spec.value.specs) if isinstance(spec.value, A.Construct) else isinstance(spec.value, A.Aggregate)
        if isinstance(head, A.Deref):
            out["*"] = out[DYNAMIC] = how
        else:
            out[head.name] = how
    return out


def evaluate(spark: SparkSession, transformation: A.Transformation, rows: DataFrame | None = None) -> DataFrame:
    """The lazy result of a transformation over its source (or over given rows)."""
    source = create(spark, transformation.source.name, transformation.source.parameters)
    return compile_transformation(transformation, source.read() if rows is None else rows, source.dynamic)


def result(spark: SparkSession, text: str, rows: DataFrame | None = None) -> DataFrame:
    """The result of a script of one transformation, without storing it."""
    transformations = parse(text)
    if len(transformations) != 1:
        raise CompileError("a result needs a script of one transformation")
    return evaluate(spark, transformations[0], rows)


def filtered(spark: SparkSession, transformation: A.Transformation) -> DataFrame:
    """The source's rows that pass the input filter."""
    source = create(spark, transformation.source.name, transformation.source.parameters)
    df = source.read()
    ev = Evaluator(df, source.dialect, source.dialect, source.dynamic)
    return df if transformation.in_filter is None else df.where(ev.predicate(transformation.in_filter, ev.scope))


def apply_changes(transformation: A.Transformation, changes: DataFrame, source: Engine, sink: Engine) -> bool:
    """Bring the sink up to date for signed rows of the source; False if nothing changed."""
    check_incremental(transformation)
    adds_up = is_aggregating(transformation)
    if adds_up and not sink.combining:
        raise CompileError(f"results in {sink.name} can't be combined with changes")
    if adds_up and not any(isinstance(s.path.steps[0], A.Name) and s.path.steps[0].name == "_id" and not unresolved(s.value) for s in transformation.specs):
        raise CompileError("combining results needs an _id")
    changes = cut(changes)  # read again below, and their source may be the sink
    if changes.isEmpty():
        return False
    if not adds_up:
        sink.store(compile_transformation(transformation, changes.where(f"{WEIGHT} > 0").drop(WEIGHT), source.dynamic))
        return True
    delta = cut(compile_transformation(transformation, changes, source.dynamic, WEIGHT))
    if delta.isEmpty():
        return False
    sums = sums_of(transformation.specs)
    if isinstance(sink, Store):
        sink.combine(delta, sums)
    else:
        from loomql.operators.combine import add_changes
        from loomql.plans.compiler import widen

        old = sink.read_result()
        merged = widen(delta) if old is None else add_changes(old, widen(delta), sums)
        sink.replace(merged)
    return True


def run_one(spark: SparkSession, transformation: A.Transformation, hints: dict | None = None) -> Run:
    """Run a transformation in the mode that its source's parameters ask for."""
    began, started = time.monotonic(), int(time.time() * 1000)
    source = create(spark, transformation.source.name, {**transformation.source.parameters, **(hints or {})})
    sink = create(spark, transformation.sink.name, transformation.sink.parameters)
    mode = source.mode()
    stored = True
    if mode is None:
        rows = source.read()
        source.remember(rows, started)
        sink.store(compile_transformation(transformation, rows, source.dynamic))
    else:
        check_incremental(transformation)
        changes = source.read_changes()
        if mode.name == "timestamp":
            source.remember(source.read(), started)
        stored = apply_changes(transformation, changes, source, sink)
    return Run(mode.name if mode else "full", started, (time.monotonic() - began) * 1000, stored)


def run(spark: SparkSession, text: str, group: str | None = None) -> list[Run]:
    """Run the transformations of a script one after the other; later ones can read what earlier ones stored.

    With a ``group`` its jobs can be stopped from another thread (``cancel``).
    """
    if group is not None:
        spark.sparkContext.setJobGroup(group, text[:200], interruptOnCancel=True)
    try:
        return [run_one(spark, t) for t in parse(text)]
    finally:
        if group is not None:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def cancel(spark: SparkSession, group: str) -> None:
    """Stop the jobs of a script that was given this group."""
    spark.sparkContext.cancelJobGroup(group)
