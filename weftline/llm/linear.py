"""A hashed linear scorer: sparse presence features, logistic loss, numpy only."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.hashing import batches, mix, shingles, word_hashes

BITS = 22
SIZE = 1 << BITS

#: features(raw bytes, row ends) -> (row of each feature, its hash), repeats allowed
Features = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def index_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def tagged(rows: np.ndarray, values: np.ndarray, tag: int) -> tuple[np.ndarray, np.ndarray]:
    """Small numbers as features of a kind of their own."""
    return rows, mix(values.astype(np.uint64) * np.uint64(1024) + mix(np.uint64([tag])))


def distinct(rows: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(rows * SIZE + index)
    return both // SIZE, both % SIZE


def presence(column: pa.Array, features: Features, useful: np.ndarray | None = None):
    """(row, index) of the distinct features of all texts, only ``useful`` ones if given."""
    rows, index = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for start, raw, ends in batches(column):
        row, hashed = features(raw, ends)
        at = index_of(hashed)
        if useful is not None:
            row, at = row[useful[at]], at[useful[at]]
        row, at = distinct(row, at)
        rows.append(row + start)
        index.append(at)
    return np.concatenate(rows), np.concatenate(index)


def copy_weights(column: pa.Array) -> np.ndarray:
    """One over the number of texts with the same smallest 5-word shingle: copies count as one."""
    smallest = np.zeros(len(column), np.uint64)
    for start, raw, ends in batches(column):
        hashes, rows, _ = word_hashes(raw, ends)
        items, owner = shingles(hashes, rows, len(ends))
        least = np.full(len(ends), np.iinfo(np.uint64).max)
        np.minimum.at(least, owner, mix(items + np.uint64(11)))
        smallest[start : start + len(ends)] = least
    _, where, sizes = np.unique(smallest, return_inverse=True, return_counts=True)
    return 1.0 / sizes[where]


def train(
    rows: np.ndarray,
    index: np.ndarray,
    target: np.ndarray,
    weight: np.ndarray,
    steps: int = 300,
    least_z: float = 6.0,
) -> np.ndarray:
    """Weights of SIZE features, and the bias last, from soft targets between 0 and 1.

    ``weight`` is how much each text counts. Only features whose share differs between the classes
    by ``least_z`` standard errors, in five texts at least, get a weight of their own: most words of a text say nothing, and together they would drown
    the few that do. Full-batch gradient steps with a step size per feature.
    """
    n = max(float(weight.sum()), 1e-9)
    total = np.bincount(index, weights=weight[rows], minlength=SIZE)
    with_one = np.bincount(index, weights=(weight * target)[rows], minlength=SIZE)
    base = float(np.clip((weight * target).sum() / n, 1 / (n + 2), 1 - 1 / (n + 2)))
    spread = np.sqrt(np.maximum(total * base * (1 - base), 1e-9))
    useful = (total >= 5) & (np.abs(with_one - total * base) >= least_z * spread)
    keep = useful[index]
    rows, index = rows[keep], index[keep]
    weights, squares = np.zeros(SIZE + 1), np.full(SIZE + 1, 1e-8)
    weights[SIZE] = np.log(base / (1 - base))
    for _ in range(steps):
        scores = weights[SIZE] + np.bincount(rows, weights=weights[index], minlength=len(target))
        error = (sigmoid(scores) - target) * weight
        slope = np.bincount(index, weights=error[rows], minlength=SIZE + 1) / n
        slope[SIZE] = error.sum() / n
        slope[:SIZE] += 1e-5 * weights[:SIZE]
        squares += slope * slope
        weights -= 0.3 * slope / np.sqrt(squares)
    return weights


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def sample(docs: DataFrame, n: int, extra: list[Column] | None = None) -> DataFrame:
    """About ``n`` rows, chosen by a hash of doc_id, and never more than twice as many."""
    total = max(docs.count(), 1)
    share = int(min(1.0, n / total) * (1 << 30))
    chosen = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < share
    return docs.where(chosen).select("text", *(extra or [])).limit(2 * n)


@dataclass(frozen=True)
class Weights:
    """The features with a weight, and the bias."""

    index: np.ndarray
    value: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(SIZE)
        out[self.index] = self.value
        return out


def fit(
    sampled: DataFrame, features: Features, targets: Callable[[pa.Table], np.ndarray]
) -> Weights:
    """Train in one task on a bounded sample; ``targets`` gives each row's soft label."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = [p for p in parts if len(p)]
        if some:
            table = pa.Table.from_batches(some)
            text = table.column("text").combine_chunks()
            text = text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text
            rows, index = presence(text, features)
            weights = train(rows, index, targets(table), copy_weights(text))
            used = np.flatnonzero(weights[:SIZE])
            columns = [pa.array(used), pa.array(weights[used])]
            both = [pa.array([c.tolist()], pa.list_(c.type)) for c in columns]
            bias = pa.array([weights[SIZE]])
            yield pa.RecordBatch.from_arrays([*both, bias], ["index", "value", "bias"])

    schema = "index array<long>, value array<double>, bias double"
    found = sampled.coalesce(1).mapInArrow(run, schema).first()
    if not found:
        return Weights(np.zeros(0, np.int64), np.zeros(0), 0.0)
    return Weights(np.array(found[0], np.int64), np.array(found[1], float), found[2])


def scorer(weights: Weights, features: Features, keep: list[str]):
    """For mapInArrow: the columns ``keep`` and ``score``, whole texts, null as empty."""

    def score(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = weights.dense()
        useful = dense != 0
        for part in parts:
            rows, index = presence(part.column("text"), features, useful)
            sums = np.bincount(rows, weights=dense[index], minlength=len(part))
            values = pa.array(sigmoid(weights.bias + sums))
            yield pa.RecordBatch.from_arrays(
                [*[part.column(c) for c in keep], values], [*keep, "score"]
            )

    return score
