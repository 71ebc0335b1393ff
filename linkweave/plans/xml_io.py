"""Rules and configurations as XML, read strictly and written back."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from dataclasses import dataclass, field

from linkweave.plans.paths import resolve
from linkweave.plans.rules import Aggregate, Compare, Dataset, Filter, Input, LinkRule, Operator, Output, PathInput, TransformInput
from linkweave.registry import lookup

#: The id of a source and its type and parameters.
Sources = dict[str, tuple[str, dict]]


@dataclass
class Configuration:
    prefixes: dict[str, str] = field(default_factory=dict)
    sources: Sources = field(default_factory=dict)
    rules: list[LinkRule] = field(default_factory=list)
    outputs: tuple[Output, ...] = ()
    blocks: int = 100

    def merge(self, other: Configuration) -> Configuration:
        return Configuration(self.prefixes | other.prefixes, self.sources | other.sources, self.rules + other.rules, self.outputs + other.outputs, self.blocks)

    def outputs_of(self, rule: LinkRule) -> tuple[Output, ...]:
        """Every link is offered to the configuration's outputs and the rule's own."""
        return self.outputs + rule.outputs


def _need(e: ET.Element, name: str) -> str:
    if (v := e.get(name)) is None:
        raise ValueError(f"<{e.tag}> needs the attribute {name}")
    return v


def _only(e: ET.Element, *tags: str) -> None:
    for c in e:
        if c.tag not in tags:
            raise ValueError(f"<{c.tag}> doesn't belong into <{e.tag}>")


def _params(e: ET.Element) -> dict[str, str]:
    return {_need(p, "name"): _need(p, "value") for p in e.findall("Param")}


def _flag(text: str | None) -> bool:
    if text not in (None, "true", "false", "1", "0"):
        raise ValueError(f"neither true nor false: {text}")
    return text in ("true", "1")


def _input(e: ET.Element) -> Input:
    if e.tag == "Input":
        return PathInput(_need(e, "path"))
    if e.tag != "TransformInput":
        raise ValueError(f"<{e.tag}> is no input")
    _only(e, "Input", "TransformInput", "Param")
    inputs = tuple(_input(c) for c in e if c.tag != "Param")
    if not inputs:
        raise ValueError("a <TransformInput> needs an input")
    lookup("transformer", _need(e, "function"))
    return TransformInput(_need(e, "function"), inputs, _params(e))


def _operator(e: ET.Element) -> Operator:
    required, weight = _flag(e.get("required")), int(e.get("weight", "1"))
    if e.tag == "Compare":
        _only(e, "Input", "TransformInput", "Param")
        inputs = [_input(c) for c in e if c.tag != "Param"]
        if len(inputs) != 2:
            raise ValueError("a <Compare> needs two inputs")
        lookup("metric", _need(e, "metric"))
        t = e.get("threshold")
        return Compare(_need(e, "metric"), inputs[0], inputs[1], None if t is None else float(t), required, weight, _params(e))
    if e.tag != "Aggregate":
        raise ValueError(f"<{e.tag}> is no operator")
    _only(e, "Compare", "Aggregate", "Param")
    lookup("aggregator", _need(e, "type"))
    return Aggregate(_need(e, "type"), tuple(_operator(c) for c in e if c.tag != "Param"), required, weight, _params(e))


def _outputs(e: ET.Element | None) -> tuple[Output, ...]:
    number = lambda o, k: None if o.get(k) is None else float(o.get(k))
    return () if e is None else tuple(Output(_need(o, "type"), _params(o), number(o, "minConfidence"), number(o, "maxConfidence")) for o in e.findall("Output"))


def _dataset(e: ET.Element) -> Dataset:
    return Dataset(_need(e, "dataSource"), _need(e, "var"), (e.findtext("RestrictTo") or "").strip())


def read_rule(e: ET.Element, prefixes: dict[str, str], blocking: bool = True) -> LinkRule:
    _only(e, "Prefixes", "LinkType", "SourceDataset", "TargetDataset", "LinkCondition", "LinkageRule", "Filter", "Outputs")
    link_type, source, target = e.findtext("LinkType"), e.find("SourceDataset"), e.find("TargetDataset")
    if link_type is None or source is None or target is None:
        raise ValueError("an <Interlink> needs a LinkType, a SourceDataset and a TargetDataset")
    condition, filter_ = e.find("LinkCondition"), e.find("Filter")
    roots = [] if condition is None else [_operator(c) for c in condition]
    if len(roots) > 1:
        raise ValueError("a <LinkCondition> has one root")
    f = Filter() if filter_ is None else Filter(float(filter_.get("threshold", "1.0")), None if filter_.get("limit") is None else int(filter_.get("limit")))
    return LinkRule(_need(e, "id"), _dataset(source), _dataset(target), roots[0] if roots else None, f, resolve(link_type.strip(), prefixes), dict(prefixes), _outputs(e.find("Outputs")), blocking)


def read_configuration(text: str) -> Configuration:
    """A configuration from XML; anything that doesn't belong is an error."""
    root = ET.fromstring(text)
    for e in root.iter():
        e.tag = e.tag.rpartition("}")[2]
    if root.tag == "Interlink":
        return Configuration(rules=[read_rule(root, _prefixes(root))])
    _only(root, "Prefixes", "DataSources", "Blocking", "Interlinks", "Outputs")
    prefixes = _prefixes(root)
    sources = {_need(s, "id"): (_need(s, "type"), _params(s)) for s in root.findall("DataSources/DataSource")}
    block = root.find("Blocking")
    # no element means blocking, with the default number of blocks
    on, blocks = (True, 100) if block is None else (block.get("enabled", "true") in ("true", "1"), int(block.get("blocks", "100")))
    rules = [read_rule(e, prefixes | _prefixes(e), on) for e in root.findall("Interlinks/Interlink")]
    return Configuration(prefixes, sources, rules, _outputs(root.find("Outputs")), blocks)


def _prefixes(e: ET.Element) -> dict[str, str]:
    return {_need(p, "id"): _need(p, "namespace") for p in e.findall("Prefixes/Prefix")}


def _write_params(parent: ET.Element, params: dict) -> None:
    for k, v in params.items():
        ET.SubElement(parent, "Param", name=k, value=str(v))


def _write(parent: ET.Element, node) -> None:
    if isinstance(node, PathInput):
        ET.SubElement(parent, "Input", path=node.path)
        return
    if isinstance(node, TransformInput):
        e, parts = ET.SubElement(parent, "TransformInput", function=node.function), node.inputs
    else:
        keep = {"required": "true"} if node.required else {}
        keep |= {"weight": str(node.weight)} if node.weight != 1 else {}
        if isinstance(node, Compare):
            keep |= {} if node.threshold is None else {"threshold": repr(node.threshold)}
            e, parts = ET.SubElement(parent, "Compare", metric=node.metric, **keep), (node.source, node.target)
        else:
            e, parts = ET.SubElement(parent, "Aggregate", type=node.function, **keep), node.children
    for p in parts:
        _write(e, p)
    _write_params(e, node.params)


def _write_outputs(parent: ET.Element, outputs: tuple[Output, ...]) -> None:
    if not outputs:
        return
    box = ET.SubElement(parent, "Outputs")
    for o in outputs:
        keep = {k: repr(v) for k, v in (("minConfidence", o.min_confidence), ("maxConfidence", o.max_confidence)) if v is not None}
        _write_params(ET.SubElement(box, "Output", type=o.sink, **keep), o.params)


def rule_element(rule: LinkRule) -> ET.Element:
    e = ET.Element("Interlink", id=rule.id)
    if rule.prefixes:
        box = ET.SubElement(e, "Prefixes")
        for k, v in rule.prefixes.items():
            ET.SubElement(box, "Prefix", id=k, namespace=v)
    ET.SubElement(e, "LinkType").text = f"<{rule.link_type}>"
    for tag, d in (("SourceDataset", rule.source), ("TargetDataset", rule.target)):
        side = ET.SubElement(e, tag, dataSource=d.source, var=d.variable)
        if d.restriction:
            ET.SubElement(side, "RestrictTo").text = d.restriction
    condition = ET.SubElement(e, "LinkCondition")
    if rule.condition is not None:
        _write(condition, rule.condition)
    ET.SubElement(e, "Filter", {"threshold": repr(rule.filter.threshold)} | ({} if rule.filter.limit is None else {"limit": str(rule.filter.limit)}))
    _write_outputs(e, rule.outputs)
    return e


def write_configuration(c: Configuration) -> str:
    root = ET.Element("Config")
    box = ET.SubElement(root, "Prefixes")
    for k, v in c.prefixes.items():
        ET.SubElement(box, "Prefix", id=k, namespace=v)
    box = ET.SubElement(root, "DataSources")
    for k, (kind, params) in c.sources.items():
        _write_params(ET.SubElement(box, "DataSource", id=k, type=kind), params)
    on = all(r.blocking for r in c.rules)
    ET.SubElement(root, "Blocking", enabled=str(on).lower(), blocks=str(c.blocks))
    box = ET.SubElement(root, "Interlinks")
    box.extend(rule_element(r) for r in c.rules)
    _write_outputs(root, c.outputs)
    ET.indent(root)
    return ET.tostring(root, encoding="unicode")


def rule_jobs(spark, config: Configuration):
    """(rule, LinkJob) for each rule: triples are read from the sources, entities and the rule's paths taken from them."""
    from linkweave.plans.engine import Entities, LinkJob
    from linkweave.plans.paths import entities_of, parse_path, parse_restriction
    from linkweave.plans.rules import paths_of, variable_of

    triples = {k: lookup("source", kind)(**params)(spark) for k, (kind, params) in config.sources.items()}
    for rule in config.rules:
        sides = []
        for d in (rule.source, rule.target):
            got = triples[d.source]
            if isinstance(got, Entities):  # from a cache
                sides.append(got)
                continue
            paths = {p: parse_path(p, rule.prefixes) for p in paths_of(rule.condition) if variable_of(p) == d.variable}
            sides.append(entities_of(got, parse_restriction(d.restriction, rule.prefixes), paths))
        yield rule, LinkJob(rule, *sides)
