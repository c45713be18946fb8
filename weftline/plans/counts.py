"""Row counts of the layers of a run, gathered by the jobs that the run has anyway.

Every dataset that a layer makes is observed. A batch count is known once a target has written
something that is built on the dataset; a stream's is the sum over the batches it has finished.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.workspace import Workspace


@dataclass(frozen=True)
class LayerCount:
    layer: int
    layer_type: str
    dataset: str
    #: None as long as nothing that was run needs the dataset.
    rows: int | None


@dataclass
class Counter:
    """Marks datasets and reads what was counted."""

    run: str
    marked: list[tuple[int, str, str, str, Observation | None]] = field(default_factory=list)
    ran: list[DataFrame] = field(default_factory=list)

    def mark(self, workspace: Workspace, layer: int, kind: str, datasets: list[str]) -> None:
        for dataset in datasets:
            df = workspace[dataset]
            name = f"{self.run}/{layer}/{dataset}"
            rows = F.count(F.lit(1)).alias("rows")
            if df.isStreaming:
                observed, found = df.observe(name, rows), None
            else:
                found = Observation(name)
                observed = df.observe(found, rows)
            workspace.replace(dataset, observed, imported=kind != "Processor")
            self.marked.append((layer, kind, dataset, name, found))

    def read(self, queries: list[StreamingQuery]) -> list[LayerCount]:
        streamed: dict[str, int] = {}
        for query in queries:
            seen: dict[str, int] = {}
            for progress in query.recentProgress:
                for name, row in progress.observedMetrics.items():
                    seen[name] = seen.get(name, 0) + row["rows"]
            for name, n in seen.items():  # several queries over one dataset read it anew
                streamed[name] = max(n, streamed.get(name, 0))
        plans = "\n".join(df._jdf.queryExecution().analyzed().toString() for df in self.ran)
        counts = []
        for layer, kind, dataset, name, found in self.marked:
            if found is not None:  # asking for one that no job has gathered would wait for ever
                rows = found.get["rows"] if f"CollectMetrics {name}," in plans else None
            else:
                rows = streamed.get(name)
            counts.append(LayerCount(layer, kind, dataset, rows))
        return counts
