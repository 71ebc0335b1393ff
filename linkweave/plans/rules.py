"""Linkage rules: what is compared, how, and how the results are put together."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class PathInput:
    """The values of a path, such as '?a/rdfs:label'. Its variable says which of the two entities it starts from."""

    path: str


@dataclass(frozen=True)
class TransformInput:
    function: str
    inputs: tuple[Input, ...]
    params: dict = field(default_factory=dict, hash=False)


Input = PathInput | TransformInput


@dataclass(frozen=True)
class Compare:
    """A comparison. threshold is the greatest distance of a match; None: 1 minus the rule's filter threshold."""

    metric: str
    source: Input
    target: Input
    threshold: float | None = None
    required: bool = False
    weight: int = 1
    params: dict = field(default_factory=dict, hash=False)


@dataclass(frozen=True)
class Aggregate:
    function: str
    children: tuple[Operator, ...]
    required: bool = False
    weight: int = 1
    params: dict = field(default_factory=dict, hash=False)


Operator = Compare | Aggregate


@dataclass(frozen=True)
class Dataset:
    """A side of a rule: the source it comes from, the variable of its paths, and a restriction of its entities."""

    source: str
    variable: str
    restriction: str = ""


@dataclass(frozen=True)
class Filter:
    threshold: float = 1.0
    limit: int | None = None


@dataclass(frozen=True)
class Output:
    """Where links go whose confidence is at least min and below max."""

    sink: str
    params: dict = field(default_factory=dict, hash=False)
    min_confidence: float | None = None
    max_confidence: float | None = None


@dataclass(frozen=True)
class LinkRule:
    id: str
    source: Dataset
    target: Dataset
    condition: Operator | None
    filter: Filter = Filter()
    link_type: str = "http://www.w3.org/2002/07/owl#sameAs"
    prefixes: dict = field(default_factory=dict, hash=False)
    outputs: tuple[Output, ...] = ()
    blocking: bool = True

    def threshold_of(self, c: Compare) -> float:
        return 1.0 - self.filter.threshold if c.threshold is None else c.threshold


def paths_of(node: Operator | Input | None) -> list[str]:
    """All paths of a rule's tree, each once, in order of first use."""
    if node is None:
        return []
    if isinstance(node, PathInput):
        return [node.path]
    parts = node.inputs if isinstance(node, TransformInput) else node.children if isinstance(node, Aggregate) else (node.source, node.target)
    return list(dict.fromkeys(p for x in parts for p in paths_of(x)))


def variable_of(path: str) -> str:
    """The variable at a path's start, without its question mark."""
    body = path.strip().removeprefix("?")
    for k, c in enumerate(body):
        if c in "/\\[":
            return body[:k].strip()
    return body
