"""Declarations of the operators. They hold no data; ``strata.plans.lower`` turns them into DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from strata.errors import ConfigurationError
from strata.names import AlgorithmName, Selector, TypeTag


@dataclass
class Node:
    """What all nodes have: a name, inputs, and the predicates that gate it (all must hold)."""

    name: AlgorithmName
    inputs: tuple[Selector, ...] = ()
    when: tuple[str, ...] = ()
    #: Accepted for the reader; Spark sets the parallelism. ``serial`` isn't enforced: keep functions free of hidden state.
    concurrency: int | str = "serial"

    @property
    def key(self) -> str:
        return str(self.name)


@dataclass
class Producer(Node):
    suffixes: tuple[str, ...] = ("",)
    types: tuple[TypeTag | None, ...] = (None,)

    def __post_init__(self):
        if len(self.types) != len(self.suffixes):
            self.types = (*self.types, *[None] * len(self.suffixes))[: len(self.suffixes)]
        if len(set(zip(self.suffixes, self.types))) != len(self.suffixes):
            raise ConfigurationError(f"Node '{self.key}' makes two products of the same suffix and type")


@dataclass
class Provider(Producer):
    """A value on each cell of a layer: ``fn`` gets the cell's key columns by layer name."""

    fn: Callable = None
    layer: str = ""
    creator: str = ""
    stage: str = "CURRENT"


@dataclass
class Transform(Producer):
    """One value (or one for each suffix) on each cell of the deepest input."""

    fn: Callable = None


@dataclass
class Predicate(Node):
    """A decision on each cell; makes no product."""

    fn: Callable = None


@dataclass
class Fold(Producer):
    """One value on each cell of the partition layer, from all cells below it.

    ``fn`` gets the inputs' columns and returns one aggregate column, or a dict
    of them. ``initial`` is the value (or dict) of a partition without cells;
    ``combine(initial, aggregate)`` says how it counts otherwise (default: added
    to numbers, else replaced). ``finish`` makes the product from the result.
    """

    fn: Callable = None
    partition: str = "job"
    initial: object = 0
    combine: Callable | None = None
    finish: Callable | None = None
    #: For a fold in Python: (zero, step, merge, finish) and the Spark type of its result.
    python: tuple | None = None
    type: str = "double"


@dataclass
class Unfold(Producer):
    """A child layer below the deepest input: ``fn`` gets the inputs' columns and returns an array column, an element a child."""

    fn: Callable = None
    layer: str = ""


@dataclass
class Observer(Node):
    """A side effect on each cell: ``fn`` gets rows of a partition, or ``check`` a boolean column that must hold."""

    fn: Callable | None = None
    check: Callable | None = None


@dataclass
class Output(Node):
    """A sink: ``fn`` gets (name, path, frame) of every node that makes products."""

    fn: Callable = None


@dataclass
class Bundle:
    """What a source offers for a selector: an implicit provider."""

    fn: Callable
    creator: str
    layer: str
    suffix: str = ""
    stage: str = "CURRENT"
    type: TypeTag | None = None


@dataclass
class Source:
    """Asked for providers when nothing else makes a product, and for the cells it knows."""

    name: str
    create_providers: Callable[[Selector], Sequence[Bundle]]
    indices: Callable | None = None
    made: dict = field(default_factory=dict)
