"""Syntax tree of the transformation language; paths are already free of dialect spelling."""

from __future__ import annotations

from dataclasses import dataclass, field


# --- path steps -------------------------------------------------------------------------
@dataclass(frozen=True)
class Name:
    """A fixed attribute; ``family`` restricts it to one column family (wide-column dialect)."""

    name: str
    family: str | None = None


@dataclass(frozen=True)
class Index:
    position: int


@dataclass(frozen=True)
class Wild:
    """All children; binds.  ``reuse`` binds or takes the existing binding; ``keep_hidden`` also sees names that start with _."""

    reuse: bool = False
    family: str | None = None


@dataclass(frozen=True)
class Current:
    """The child that an earlier step bound at this place."""


@dataclass(frozen=True)
class Where:
    """Children that satisfy a predicate; binds."""

    predicate: object
    reuse: bool = False
    family: str | None = None


@dataclass(frozen=True)
class Deref:
    """Children whose name or position equals a value of the inner path; binds."""

    path: Path
    family: str | None = None


@dataclass(frozen=True)
class NameOf:
    """The name of the bound child."""


@dataclass(frozen=True)
class IndexOf:
    """The position of the bound child."""


@dataclass(frozen=True)
class Split:
    """Tokens of a string; the delimiter is a regular expression."""

    delimiter: str = " "


@dataclass(frozen=True)
class Path:
    """An input path: from the row (absolute) or from the child under test (relative)."""

    steps: tuple
    absolute: bool = True


@dataclass(frozen=True)
class OutPath:
    """An output path; its steps are ``Name`` and ``Deref``."""

    steps: tuple


# --- value expressions -------------------------------------------------------------------
@dataclass(frozen=True)
class Literal:
    value: int | float | str | bool


@dataclass(frozen=True)
class Arithmetic:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Aggregate:
    """SUM, COUNT, AVG, MIN, MAX, IMPLODE or LIST over a value, with further literal arguments."""

    function: str
    value: object
    arguments: tuple = ()


@dataclass(frozen=True)
class Construct:
    """OBJECT(...) or an engine's own constructor."""

    specs: tuple
    name: str = "OBJECT"


@dataclass(frozen=True)
class Call:
    name: str
    arguments: tuple


@dataclass(frozen=True)
class PathValue:
    path: Path


# --- predicates ---------------------------------------------------------------------------
@dataclass(frozen=True)
class Compare:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class And:
    left: object
    right: object


@dataclass(frozen=True)
class Or:
    left: object
    right: object


@dataclass(frozen=True)
class Not:
    inner: object


@dataclass(frozen=True)
class Exists:
    path: Path


# --- statements ---------------------------------------------------------------------------
@dataclass(frozen=True)
class Spec:
    """Output path ← value."""

    path: OutPath
    value: object


@dataclass(frozen=True)
class Engine:
    name: str
    parameters: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Transformation:
    source: Engine
    sink: Engine
    specs: tuple
    in_filter: object = None
    out_filter: object = None


def walk(node):
    """The node and all nodes below it, paths and steps included."""
    yield node
    if isinstance(node, tuple):
        children = node
    elif hasattr(node, "__dataclass_fields__"):
        children = tuple(getattr(node, f) for f in node.__dataclass_fields__)
    else:
        return
    for child in children:
        if isinstance(child, tuple) or hasattr(child, "__dataclass_fields__"):
            yield from walk(child)


def aggregates(node) -> bool:
    """Whether an aggregate or a constructor occurs (then the value is only known after grouping)."""
    return any(isinstance(x, (Aggregate, Construct)) for x in walk(node))
