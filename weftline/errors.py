"""Errors raised while a spec is validated or executed."""


class WeftlineError(Exception):
    """Base class of all errors of this package."""


class SpecError(WeftlineError, ValueError):
    """A spec document misses a field or holds an unusable value."""


class SourceError(WeftlineError):
    """A source cannot be read."""


class StreamError(WeftlineError):
    """An operation that Spark does not support on a stream."""


class FusionError(WeftlineError):
    """A fusion step that cannot be planned."""


class RuleError(WeftlineError):
    """A process of a rule failed; says which one."""

    def __init__(self, dataset: str, index: int, operation: str, reason: object):
        self.dataset, self.index, self.operation = dataset, index, operation
        super().__init__(f"{dataset}[{index}] {operation}: {reason}")


class PipelineError(WeftlineError):
    """A layer failed; ``log`` holds the entries up to and including it."""

    def __init__(self, message: str, log: list):
        self.log = log
        super().__init__(message)
