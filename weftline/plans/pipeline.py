"""Runs the layers of a pipeline: Source, then any mix of Processor, Fusion and Target.

Source, Processor and Fusion layers extend logical plans, but for medians and look-ups of hot
join keys, which run jobs; Target layers start the rest, as batch writes or streaming queries. Starting a stream does not block, so one session can run
many pipelines.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from weftline.errors import PipelineError, SpecError
from weftline.operators.fusion import run_fusion
from weftline.operators.rules import apply_rule
from weftline.plans.catalog import check_layers
from weftline.plans.counts import Counter, LayerCount
from weftline.scratch import new_folder, shared_root
from weftline.sinks.export import RunPlace, export
from weftline.sources.importer import import_sources
from weftline.workspace import Workspace


@dataclass(frozen=True)
class LayerLog:
    layer_type: str
    status: str
    percent: int
    detail: str


@dataclass
class PipelineResult:
    name: str
    workspace: Workspace
    paths: dict[str, str] = field(default_factory=dict)
    queries: list[StreamingQuery] = field(default_factory=list)
    log: list[LayerLog] = field(default_factory=list)
    counter: Counter | None = None

    def counts(self) -> list[LayerCount]:
        """Rows of every dataset after every layer that made or rewrote it (``count_rows``)."""
        if self.counter is None:
            raise SpecError("the pipeline was run without count_rows")
        return self.counter.read(self.queries)

    def __getitem__(self, dataset: str) -> DataFrame:
        return self.workspace[dataset]

    @property
    def is_streaming(self) -> bool:
        return bool(self.queries)

    def wait(self, seconds: float | None = None) -> None:
        """Block until every stream has ended; raises what a stream failed with."""
        for query in self.queries:
            query.awaitTermination(seconds)

    def stop(self) -> None:
        for query in self.queries:
            query.stop()


def _has_streams(result: PipelineResult, target: dict) -> bool:
    known = result.workspace.current
    return any(d in known and known[d].isStreaming for d in target.get("datasets") or [])


def _demand(layers: list[dict], source: int) -> dict[str, list[dict]]:
    """Per dataset the processes of the Processor layers that directly follow a Source layer.

    Datasets that a later layer resets, or whose statistics another dataset uses, are left out: their
    other columns are used as well.
    """
    found: dict[str, list[dict]] = {}
    whole = set()
    for layer in layers[source + 1 :]:
        if layer["layer_type"] != "Processor":
            continue
        for dataset, processes in layer["layer_selection"].items():
            if layer.get("reset"):
                whole.add(dataset)
            for process in processes:
                whole.add((process.get("data_map") or {}).get("stats_from"))
    for layer in layers[source + 1 :]:
        if layer["layer_type"] != "Processor":
            break
        for dataset, processes in layer["layer_selection"].items():
            found.setdefault(dataset, []).extend(processes)
    return {dataset: processes for dataset, processes in found.items() if dataset not in whole}


def run_pipeline(
    spark: SparkSession,
    layers: list[dict],
    name: str | None = None,
    output_dir: str | None = None,
    checkpoint_root: str | None = None,
    on_layer: Callable[[LayerLog], None] | None = None,
    count_rows: bool = False,
) -> PipelineResult:
    """Run resolved layers; ``on_layer`` hears of each as it finishes or fails.

    Streams continue where they stopped if ``name`` and ``checkpoint_root`` are the same. The
    checkpoint root defaults to the shared folder that ``spark.checkpoint.dir`` names. A run
    without a name gets one of its own, so its streams start from the beginning. ``count_rows``
    counts the rows of every layer in the same jobs; filters then stay above the counts.
    """
    check_layers(layers)
    name = name or f"unnamed-{uuid.uuid4().hex}"
    result = PipelineResult(name, Workspace(spark))
    if count_rows:
        result.counter = Counter(uuid.uuid4().hex)
    targets = 0

    def note(entry: LayerLog) -> None:
        result.log.append(entry)
        if on_layer:
            on_layer(entry)

    for index, layer in enumerate(layers):
        kind, spec = layer["layer_type"], layer["layer_selection"]
        try:
            if kind == "Source":
                made = import_sources(result.workspace, spec, demand=_demand(layers, index))
                detail = f"imported {made}"
            elif kind == "Processor":
                apply_rule(result.workspace, spec, reset=bool(layer.get("reset")))
                made = list(spec)
                detail = f"rewrote {made}"
            elif kind == "Fusion":
                steps = [spec] if isinstance(spec, dict) else spec
                made = run_fusion(result.workspace, steps)
                detail = f"fused {made}"
            else:
                place = RunPlace(
                    output_dir or new_folder(spark, "output"),
                    checkpoint_root or f"{shared_root(spark)}/streams",
                    name,
                    layer.get("name", f"target_{targets}"),
                )
                targets += 1
                made = []
                if name.startswith("unnamed-") and output_dir and _has_streams(result, spec):
                    raise SpecError("a pipeline that streams into output_dir needs a name")
                if result.counter:
                    result.counter.ran += [result.workspace[d] for d in spec.get("datasets") or []]
                exported = export(result.workspace, spec, place)
                result.paths.update(exported.paths)
                result.queries.extend(exported.queries)
                detail = f"exported {spec['datasets']}"
            if result.counter:
                result.counter.mark(result.workspace, index, kind, made)
        except Exception as error:
            result.stop()
            percent = round(100 * index / len(layers))
            note(LayerLog(kind, "failed", percent, str(error)))
            raise PipelineError(f"layer {index} ({kind}): {error}", result.log) from error
        percent = round(100 * (index + 1) / len(layers))
        note(LayerLog(kind, "done", percent, detail))
    return result
