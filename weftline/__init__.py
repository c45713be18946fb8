"""Weftline: data integration from plain specs, executed as Spark DataFrame plans."""

from weftline.plans.catalog import Catalog
from weftline.plans.pipeline import PipelineResult, run_pipeline
from weftline.workspace import Workspace

__all__ = ["Catalog", "PipelineResult", "Workspace", "run_pipeline"]
