"""Stored specs: inputs, rules, fusions, targets and pipelines, each under a chosen name.

Rules, fusions and targets belong to one input. A catalog is one JSON document::

    {"inputs":    {input: source spec},
     "rules":     {input: {rule: rule spec}},
     "fusions":   {input: {fusion: [steps]}},
     "targets":   {input: {target: target spec}},
     "pipelines": {pipeline: [{"layer_type": ..., "layer_selection": name}, ...]}}
"""

from __future__ import annotations

import copy
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession

from weftline.errors import SpecError

LAYER_TYPES = ("Source", "Processor", "Fusion", "Target")
_SCOPED = {"Processor": "rules", "Fusion": "fusions", "Target": "targets"}


@dataclass
class Catalog:
    inputs: dict[str, dict] = field(default_factory=dict)
    rules: dict[str, dict] = field(default_factory=dict)
    fusions: dict[str, dict] = field(default_factory=dict)
    targets: dict[str, dict] = field(default_factory=dict)
    pipelines: dict[str, list[dict]] = field(default_factory=dict)

    @classmethod
    def from_json(cls, text: str) -> Catalog:
        document = json.loads(text)
        try:
            return cls(**document)
        except TypeError as error:
            raise SpecError(f"not a catalog: {error}") from error

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Catalog:
        """Read a catalog document from any place Spark can read."""
        documents = spark.read.text(path, wholetext=True).take(2)
        if len(documents) != 1:
            found = "several documents" if documents else "no document"
            raise SpecError(f"{path} holds {found}, expected one")
        return cls.from_json(documents[0].value)

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2)

    def resolve(self, pipeline: str) -> list[dict]:
        """The layers of a pipeline with each name replaced by the spec it stands for."""
        layers = copy.deepcopy(_look_up(self.pipelines, pipeline, "pipeline"))
        check_layers(layers)
        source = layers[0]["layer_selection"]
        for layer in layers:
            name = layer["layer_selection"]
            if not isinstance(name, str):
                continue
            layer["name"] = name
            if layer["layer_type"] == "Source":
                stored = _look_up(self.inputs, name, "input")
            else:
                group = _SCOPED[layer["layer_type"]]
                if not isinstance(source, str):
                    raise SpecError(f"{name!r} belongs to a named input; the source is inline")
                scope = getattr(self, group).get(source, {})
                stored = _look_up(scope, name, f"{group} of input {source!r}:")
            layer["layer_selection"] = copy.deepcopy(stored)
        return layers


def _look_up(specs: dict, name: str, kind: str):
    if name not in specs:
        raise SpecError(f"{kind} {name!r} not found; known: {sorted(specs)}")
    return specs[name]


def check_layers(layers: list[dict]) -> None:
    if not layers:
        raise SpecError("the pipeline is empty")
    for layer in layers:
        if layer.get("layer_type") not in LAYER_TYPES:
            raise SpecError(
                f"unknown layer type {layer.get('layer_type')!r}, expected {LAYER_TYPES}"
            )
        if not layer.get("layer_selection"):
            raise SpecError(f"a {layer['layer_type']} layer selects nothing")
    if layers[0]["layer_type"] != "Source":
        raise SpecError("the first layer must be a Source layer")
