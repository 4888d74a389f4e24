"""Engines by name: how to read rows, how to store results, which incremental modes exist.

An engine is looked up by the name in ``IN-ENGINE`` / ``OUT-ENGINE``.  Every engine reads to a DataFrame and stores a
result DataFrame (static columns, and perhaps the map of dynamic attributes).
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from loomql.lang.parser import DIALECTS, TABULAR
from loomql.sources import paths

UPDATES, DELETES = "boolean_updates_expected", "boolean_deletes_expected"


class EngineError(ValueError):
    """Wrong parameters, or something the engine can't do."""


@dataclass(frozen=True)
class Mode:
    """An incremental mode: what kinds of change it sees."""

    name: str
    updates: bool
    deletes: bool


class Engine(ABC):
    """One kind of store.  Subclasses name their dialect and parameters."""

    name = ""
    dialect = TABULAR
    required: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()
    #: Whether results can be combined with what the store holds.
    combining = False
    #: Whether cells are text whose type is inferred from each value.
    dynamic = False
    modes: dict[str, Mode] = {}

    def __init__(self, spark: SparkSession, parameters: dict):
        missing = [p for p in self.required if p not in parameters]
        unknown = [p for p in parameters if p not in (*self.required, *self.optional)]
        if missing or unknown:
            raise EngineError(f"{self.name}: " + "; ".join([f"{p} is missing" for p in missing] + [f"{p} is unknown" for p in unknown]))
        self.spark, self.parameters = spark, parameters
        self.check_hints()

    def mode(self) -> Mode | None:
        """The incremental mode that the parameters ask for, None for full recomputation."""
        for parameter, mode in self.modes.items():
            if parameter in self.parameters and self.parameters[parameter] is not False:
                return mode
        return None

    def check_hints(self) -> None:
        """Changes that the user expects must be among those that the mode sees."""
        mode = self.mode()
        if mode is None:
            return
        for hint, able in ((UPDATES, mode.updates), (DELETES, mode.deletes)):
            if self.parameters.get(hint) is True and not able:
                raise EngineError(f"{self.name}: mode {mode.name} doesn't see what {hint} announces")

    @abstractmethod
    def read(self) -> DataFrame:
        """All rows."""

    def read_changes(self) -> DataFrame:
        """Signed rows (column ``_weight``: +1 or -1) in the mode that the parameters ask for."""
        raise EngineError(f"{self.name} has no incremental mode")

    @abstractmethod
    def store(self, result: DataFrame) -> None:
        """Write a result; combining engines update what they hold by ``_id``."""

    def remember(self, rows: DataFrame, started: int) -> None:
        """Note what a later timestamp run needs to know about a run that read ``rows`` and began at ``started`` (ms)."""

    def marks(self) -> dict[str, int]:
        """Numbers of the last batches that streams have put into this store."""
        return paths.marks(self.spark, self.parameters["path"]) if "path" in self.parameters else {}

    def replace(self, result: DataFrame) -> None:
        """Write a whole result that was already combined with what the store held."""
        self.store(result)

    def read_result(self) -> DataFrame | None:
        """What the store holds, in the shape of a result; None if there is nothing."""
        raise EngineError(f"results in {self.name} can't be combined")


_ENGINES: dict[str, type[Engine]] = {}


def register(engine: type[Engine]) -> type[Engine]:
    """Class decorator: make an engine available under its name."""
    _ENGINES[engine.name] = engine
    DIALECTS[engine.name] = engine.dialect
    return engine


def engine_names() -> list[str]:
    return sorted(_ENGINES)


def create(spark: SparkSession, name: str, parameters: dict) -> Engine:
    if name not in _ENGINES:
        raise EngineError(f"unknown engine {name}")
    return _ENGINES[name](spark, parameters)


from loomql.sources import files, stores  # noqa: E402, F401  they register their engines
