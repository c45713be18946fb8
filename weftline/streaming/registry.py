"""Remembers which pipelines are streaming, so that a restarted application resumes them.

Starts and stops are appended to a folder any Spark session of the application can read; the
latest entry of a pipeline decides. After ``COMPACT_AFTER`` entries, the active pipelines are written
to a folder of the next generation, and the older ones are removed: the registry grows with the
pipelines that run, not with how often they were started. Progress itself lives in the stream
checkpoints. One application writes a registry at a time.
"""

from __future__ import annotations

import json
import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.errors import PipelineError
from weftline.plans.pipeline import PipelineResult, run_pipeline
from weftline.scratch import remove

_SCHEMA = "pipeline string, event string, run string, at long"
#: Entries of one generation, besides those it began with.
COMPACT_AFTER = 20


class ActiveStreams:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.running: dict[str, PipelineResult] = {}
        self.entries = 0
        whole = self._generations()
        self.generation = whole[-1] if whole else 0
        if not whole:
            self._write([], 0)
        self._retire()

    def start(self, name: str, layers: list[dict], **places: str) -> PipelineResult:
        """Run a pipeline and remember it if it streams."""
        result = run_pipeline(self.spark, layers, name, **places)
        if result.is_streaming:
            self.running[name] = result
            run = json.dumps({"layers": layers, "places": places})
            self._note([(name, "start", run, time.time_ns())])
        return result

    def stop(self, name: str) -> None:
        """Stop the queries of a pipeline and forget it."""
        if name in self.running:
            self.running.pop(name).stop()
        self._note([(name, "stop", None, time.time_ns())])

    def active(self) -> dict[str, dict]:
        rows = self._latest().where("last.event = 'start'").select("pipeline", "last.run").collect()
        return {row.pipeline: json.loads(row.run) for row in rows}

    def _latest(self) -> DataFrame:
        entries = self.spark.read.schema(_SCHEMA).json(self._folder(self.generation))
        return entries.groupBy("pipeline").agg(
            F.max_by(F.struct("event", "run", "at"), "at").alias("last")
        )

    def resume(self) -> list[str]:
        """Relaunch every active pipeline that this object does not run yet.

        One that fails does not keep the others from starting; failures are raised together at
        the end.
        """
        resumed, failed = [], {}
        for name, run in sorted(self.active().items()):
            if name in self.running:
                continue
            try:
                self.running[name] = run_pipeline(
                    self.spark, run["layers"], name, **run["places"]
                )
                resumed.append(name)
            except PipelineError as error:
                failed[name] = error
        if failed:
            reasons = "; ".join(f"{name}: {error}" for name, error in failed.items())
            log = [entry for error in failed.values() for entry in error.log]
            raise PipelineError(f"not resumed: {reasons}", log)
        return resumed

    def _folder(self, generation: int) -> str:
        return f"{self.folder}/generation={generation}"

    def _generations(self) -> list[int]:
        """Those that were written whole, oldest first."""
        listing = self.spark.read.format("binaryFile").option("recursiveFileLookup", True)
        try:
            paths = listing.option("pathGlobFilter", "part-*").load(self.folder).select("path")
        except AnalysisException:
            return []
        found = paths.select(F.regexp_extract("path", "/generation=([0-9]+)/", 1).alias("g"))
        return sorted({int(row.g) for row in found.distinct().collect() if row.g})

    def _note(self, rows: list[tuple]) -> None:
        self._write(rows, self.generation)
        self.entries += len(rows)
        if self.entries >= COMPACT_AFTER:
            kept = self._latest().where("last.event = 'start'").select("pipeline", "last.*")
            self._write([tuple(row) for row in kept.collect()], self.generation + 1)
            self.generation += 1
            self.entries = 0
            self._retire()

    def _retire(self) -> None:
        for generation in self._generations():
            if generation < self.generation:
                remove(self.spark, self._folder(generation))

    def _write(self, rows: list[tuple], generation: int) -> None:
        entries = self.spark.createDataFrame(rows, _SCHEMA).coalesce(1)
        entries.write.mode("append").json(self._folder(generation))
