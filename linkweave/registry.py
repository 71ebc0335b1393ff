"""Operators by kind and id, with their parameters: the built-in ones and those that users add."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field

KINDS = ("transformer", "metric", "aggregator", "source", "sink")
_TRUE = {"true": True, "false": False}


@dataclass(frozen=True)
class Parameter:
    name: str
    kind: type
    default: object = inspect.Parameter.empty

    def read(self, text):
        """The parameter from its text."""
        if not isinstance(text, str) or self.kind is str:
            return text
        if self.kind is bool:
            return _TRUE[text.lower()]
        return self.kind(text)


@dataclass(frozen=True)
class Operator:
    kind: str
    id: str
    label: str
    build: Callable
    parameters: tuple[Parameter, ...] = field(default=())

    def __call__(self, **given):
        """The operator with its parameters. One without default must be given; unknown ones are ignored."""
        args = {}
        for p in self.parameters:
            if p.name in given:
                args[p.name] = p.read(given[p.name])
            elif p.default is inspect.Parameter.empty:
                raise ValueError(f"{self.kind} {self.id} needs the parameter {p.name}")
        return self.build(**args)


_operators: dict[tuple[str, str], Operator] = {}


def register(kind: str, id: str, label: str = ""):
    """Decorator: adds a factory, whose parameters with types and defaults become the operator's."""
    if kind not in KINDS:
        raise ValueError(f"no kind of operator: {kind}")

    def add(build: Callable):
        types = {"str": str, "int": int, "float": float, "bool": bool}
        params = tuple(Parameter(n, types.get(p.annotation, p.annotation) if p.annotation is not p.empty else str, p.default) for n, p in inspect.signature(build).parameters.items())
        _operators[kind, id] = Operator(kind, id, label or id, build, params)
        return build

    return add


def lookup(kind: str, id: str) -> Operator:
    _load()
    if (kind, id) not in _operators:
        raise KeyError(f"no {kind} with the id {id}")
    return _operators[kind, id]


def _load() -> None:
    from linkweave.functions import transforms  # noqa: F401
    from linkweave.operators import aggregators, metrics  # noqa: F401
    from linkweave.sources import readers, sinks  # noqa: F401


def describe(spark):
    """A DataFrame of all operators: kind, id, label, and parameters with type and default."""
    _load()
    none = inspect.Parameter.empty
    rows = [(o.kind, o.id, o.label, [(p.name, p.kind.__name__, None if p.default is none else str(p.default)) for p in o.parameters]) for o in _operators.values()]
    return spark.createDataFrame(sorted(rows), "kind string, id string, label string, parameters array<struct<name string, type string, default string>>")
