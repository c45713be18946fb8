"""A multiway hyperplane tree with distance ranges, and the search of score windows in it.

The tree is fitted on a bounded sample. A node has up to ``WAYS`` split points; a row goes to the
nearest one, ties to the first. For every split point and every child, the node holds the least and
the largest distance between that point and the rows of that child, over all indexed rows. A query
asks for rows whose inner product with it lies in a window: with |x|^2 between two bounds in a
subtree, such rows lie in an annulus around the query, and a child is left out if for some split
point its range of distances cannot meet the annulus.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

WAYS = 8
#: Sample rows of a node that is split no further.
LEAF = 64
#: Distances are floats: ranges are taken this much wider, relatively.
SLACK = 1e-9


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


@dataclass
class Node:
    points: np.ndarray
    #: Per child the number of a node, or -1 - the number of a leaf.
    children: list[int]
    low: np.ndarray | None = None  # split points x children
    high: np.ndarray | None = None
    norm_low: np.ndarray | None = None  # per child, of |x|^2
    norm_high: np.ndarray | None = None


class Tree:
    def __init__(self, sample: np.ndarray):
        self.nodes: list[Node] = []
        self.leaves = 0
        self.root = self._grow(sample.astype(np.float64))

    def _leaf(self) -> int:
        self.leaves += 1
        return -self.leaves

    def _grow(self, sample: np.ndarray) -> int:
        if len(sample) <= LEAF:
            return self._leaf()
        # far apart: each next split point is the sample row farthest from those taken
        chosen, near = [0], distances(sample, sample[:1])[:, 0]
        while len(chosen) < WAYS and near.max() > SLACK * (1 + np.abs(sample).max()):
            chosen.append(int(near.argmax()))
            near = np.minimum(near, distances(sample, sample[chosen[-1:]])[:, 0])
        if len(chosen) < 2:
            return self._leaf()
        points = sample[chosen]
        child = distances(sample, points).argmin(1)
        if len(np.unique(child)) < 2:
            return self._leaf()
        number = len(self.nodes)
        self.nodes.append(Node(points, []))
        for i in range(len(points)):
            self.nodes[number].children.append(self._grow(sample[child == i]))
        return number

    def route(self, rows: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
        """The leaf of every row; and per (node, child) met the least and largest distances to the
        node's split points and the least and largest |x|^2 of the rows that went there."""
        rows = rows.astype(np.float64)
        norms = (rows * rows).sum(1)
        leaf, seen = np.zeros(len(rows), dtype=np.int64), []
        waiting = [(self.root, np.arange(len(rows)))]
        while waiting:
            at, mine = waiting.pop()
            if at < 0:
                leaf[mine] = -1 - at
                continue
            node = self.nodes[at]
            away = distances(rows[mine], node.points)
            child = away.argmin(1)
            for i in np.unique(child).tolist():
                here = child == i
                some = mine[here]
                low, high = away[here].min(0), away[here].max(0)
                seen.append((at, i, low, high, norms[some].min(), norms[some].max()))
                waiting.append((node.children[i], some))
        return leaf, seen

    def set_ranges(self, ranges: list[tuple]) -> None:
        for node in self.nodes:
            ways = len(node.children)
            node.low, node.high = np.full((ways, ways), np.inf), np.full((ways, ways), -np.inf)
            node.norm_low, node.norm_high = np.full(ways, np.inf), np.full(ways, -np.inf)
        for at, child, low, high, norm_low, norm_high in ranges:
            node = self.nodes[at]
            node.low[:, child], node.high[:, child] = low, high
            node.norm_low[child], node.norm_high[child] = norm_low, norm_high

    def visits(self, queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> dict[int, np.ndarray]:
        """Per leaf the queries (by place) that may have rows there with a score from ``low`` to
        ``high`` in one of their windows; both are queries x windows, an empty window has low > high.
        """
        queries = queries.astype(np.float64)
        norms = (queries * queries).sum(1)
        low, high = low.astype(np.float64), high.astype(np.float64)
        asks = (low <= high).any(1)
        found: dict[int, np.ndarray] = {}
        waiting = [(self.root, np.flatnonzero(asks))]
        while waiting:
            at, mine = waiting.pop()
            if not len(mine):
                continue
            if at < 0:
                found[-1 - at] = mine
                continue
            node = self.nodes[at]
            away = distances(queries[mine], node.points)
            for i, child in enumerate(node.children):
                if node.low[0, i] == np.inf:
                    continue  # no row went there
                size = norms[mine][:, None]
                slack = SLACK * (1 + size + node.norm_high[i])
                outer = size + node.norm_high[i] - 2 * low[mine] + slack
                inner = size + node.norm_low[i] - 2 * high[mine] - slack
                use = (low[mine] <= high[mine]) & (outer >= 0)
                outer = np.sqrt(np.maximum(outer, 0))[:, :, None]
                inner = np.sqrt(np.maximum(inner, 0))[:, :, None]
                gap = away[:, None, :]
                wide = np.sqrt(SLACK) * (1 + gap)
                meets = (
                    (gap - outer <= node.high[:, i] + wide)
                    & (gap + outer >= node.low[:, i] - wide)
                    & (gap + node.high[:, i] >= inner - wide)
                )
                waiting.append((child, mine[(use & meets.all(2)).any(1)]))
        return found
