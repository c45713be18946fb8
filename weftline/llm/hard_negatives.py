"""Hard negatives by score windows, mined with a GNAT-style tree over all rows.

1. Rows with equal vector and label are one point, which keeps its smallest vec_ids: enough, since
   among equal scores the smaller vec_id comes first.
2. The tree (``gnat``) is fitted on ``FIT`` points, the ones with the smallest hashes. Every point is
   routed to its leaf, and the distance ranges of the tree are taken over all points.
3. Leaves are cut into chunks of about ``CHUNK`` points. A query descends the tree with a window of
   scores, whose lower end is raised to the score that enough sample points already reach, and is
   then compared with all points of the leaves that are left: exactly, block by block.
4. This runs twice: for the best points of the anchor's label, then for each window under the
   positives' scores. Anchors with equal vector and label are one query.

Results are exact: the sample decides only what is read. Inner products are exact integers while
they fit in 63 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import materialize, ship_package
from weftline.llm.gnat import Tree

#: Points the tree is fitted on, at most; the ranges in it cover all points.
FIT = 4096
CHUNK = 1024
#: Chunks of a leaf that one task compares with the queries of that leaf.
CHUNKS_TOGETHER = 16
#: Queries that descend together.
BLOCK = 512

_KEY = ["label", "k1", "k2"]
_OPEN = np.int64(1) << np.int64(62)


def usable(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id``, ``label`` and the vector as whole numbers, floor(scale * x), of all rows that have
    a vec_id, a label and a vector without null or non-finite components."""
    finite = F.forall(
        "embedding",
        lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)),
    )
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return embeddings.where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    ).where(finite).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("long").alias("label"),
        whole.alias("vec"),
    )


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """Rows of equal width; short vectors are filled with zeros, which add nothing to a score."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    if (lengths == dim).all():
        return flat.reshape(len(vectors), dim)
    out = np.zeros((len(vectors), dim), dtype=np.int64)
    row = np.repeat(np.arange(len(vectors)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def scores(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, in floating point where that is exact."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(points).max(initial=0))
    if most * max(queries.shape[1], 1) < 2**53:
        return (queries.astype(np.float64) @ points.T.astype(np.float64)).astype(np.int64)
    return queries @ points.T


def _windows(positive_scores: list[list[int]], low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole scores s with low * p <= 100 * s <= high * p, for each positive score p."""
    width = max(map(len, positive_scores), default=0)
    lows = np.ones((len(positive_scores), width), dtype=np.int64)
    highs = np.zeros_like(lows)
    for i, own in enumerate(positive_scores):
        for j, p in enumerate(own):
            lows[i, j], highs[i, j] = -(-low * p // 100), high * p // 100
    return lows, highs


class Index:
    """The fitted tree, its sample and the chunked points."""

    def __init__(self, tree: Tree, sample: np.ndarray, labels: np.ndarray, dim: int):
        self.tree, self.sample, self.labels, self.dim = tree, sample, labels, dim

    def raised(self, q: np.ndarray, labels: np.ndarray, low, high, same: bool, k: int) -> np.ndarray:
        """Lower ends of the windows, no higher than the k-th best score in any of them."""
        found = scores(q, self.sample)
        fits = (labels[:, None] == self.labels[None, :]) == same
        low = low.copy()
        for j in range(low.shape[1]):
            inside = fits & (found >= low[:, j, None]) & (found <= high[:, j, None])
            enough = np.flatnonzero(inside.sum(1) >= k)
            if len(enough):
                kept = np.where(inside[enough], found[enough], -_OPEN)
                low[enough, j] = -np.partition(-kept, k - 1, axis=1)[:, k - 1]
        return low


def _descend(index: Index, same: bool, k: int, low: int, high: int):
    """Queries, block by block, to one row per leaf with the queries that must look into it."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for begin in range(0, part.num_rows, BLOCK):
                some = part.slice(begin, BLOCK)
                ids = some.column("q").to_numpy()
                labels = some.column("label").to_numpy()
                vecs = _matrix(some.column("vec"), index.dim)
                if same:
                    targets = np.zeros((len(ids), 1), dtype=np.int64)
                    lows, highs = np.full_like(targets, -_OPEN), np.full_like(targets, _OPEN)
                else:
                    own = some.column("targets").to_pylist()
                    lows, highs = _windows(own, low, high)
                    targets = np.zeros_like(lows)
                    for i, one in enumerate(own):
                        targets[i, : len(one)] = one
                lows = index.raised(vecs, labels, lows, highs, same, k)
                rows = []
                for leaf, mine in index.tree.visits(vecs, lows, highs).items():
                    arrays = (vecs, targets, lows, highs)
                    rows.append(
                        (leaf, ids[mine], labels[mine], *(a[mine].ravel() for a in arrays))
                    )
                names = ("leaf", "q", "label", "vec", "targets", "low", "high")
                columns = [pa.array([r[0] for r in rows], pa.int64())]
                columns += [
                    pa.array([r[i] for r in rows], pa.list_(pa.int64())) for i in range(1, len(names))
                ]
                yield pa.RecordBatch.from_arrays(columns, list(names))

    return run


def _compare(index: Index, same: bool, k: int):
    """Rows (leaf's queries, a chunk of the leaf) to the best rows of each window in the chunk."""
    names = ("q", "label", "vec", "targets", "low", "high")

    def one(row: pa.RecordBatch) -> Iterator[tuple[int, int, int, int]]:
        flat = {c: row.column(c).flatten().to_numpy() for c in names}
        q = flat["q"]
        vecs = flat["vec"].reshape(len(q), index.dim)
        targets, lows, highs = (flat[c].reshape(len(q), -1) for c in ("targets", "low", "high"))
        points = row.column("points").flatten()
        matrix = _matrix(points.field("vec"), index.dim)
        ids = points.field("ids").to_pylist()
        labels = points.field("label").to_numpy()
        found = scores(vecs, matrix)
        fits = (flat["label"][:, None] == labels[None, :]) == same
        for j in range(lows.shape[1]):
            inside = fits & (found >= lows[:, j, None]) & (found <= highs[:, j, None])
            for i in np.flatnonzero(inside.any(1)).tolist():
                at = np.flatnonzero(inside[i])
                if len(at) > k:  # those with the k best scores, and all that tie with the last
                    last = np.partition(found[i, at], len(at) - k)[len(at) - k]
                    at = at[found[i, at] >= last]
                best = sorted((-int(found[i, a]), n) for a in at.tolist() for n in ids[a])
                for score, vec_id in best[:k]:
                    yield int(q[i]), int(targets[i, j]), -score, vec_id

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i in range(part.num_rows):
                rows = list(one(part.slice(i, 1)))
                columns = list(zip(*rows)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns], ["q", "target", "score", "vec_id"]
                )

    return run


def _search(
    queries: DataFrame, chunks: DataFrame, leaves: DataFrame, index: Index, same: bool, k: int,
    low: int = 0, high: int = 0,
) -> DataFrame:
    """(q, target, score, vec_id, rank): the first k rows in each window of each query."""
    asked = queries.mapInArrow(
        _descend(index, same, k, low, high),
        "leaf long, " + ", ".join(
            f"{c} array<long>" for c in ("q", "label", "vec", "targets", "low", "high")
        ),
    )
    asked = asked.join(leaves, "leaf").withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("last_part")))
    )
    found = (
        asked.drop("last_part").join(chunks, ["leaf", "part"])
        .select("q", "label", "vec", "targets", "low", "high", "points")
        .mapInArrow(_compare(index, same, k), "q long, target long, score long, vec_id long")
    )
    order = Window.partitionBy("q", "target").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _points(rows: DataFrame, anchor: Column, keep: int) -> DataFrame:
    """(point, label, k1, k2, vec, ids, n_anchors) per distinct vector and label."""
    keyed = rows.withColumns(
        {"k1": F.xxhash64("vec"), "k2": F.xxhash64(F.lit(1), "vec"), "is_anchor": anchor}
    )
    slim = keyed.select(*_KEY, "vec_id", "is_anchor").distinct()
    order = Window.partitionBy(*_KEY).orderBy("vec_id")
    first = slim.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep)
    first = first.groupBy(*_KEY).agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    counted = slim.groupBy(*_KEY).agg(F.count_if("is_anchor").alias("n_anchors"))
    vectors = keyed.groupBy(*_KEY).agg(F.first("vec").alias("vec"))
    joined = vectors.join(first, _KEY).join(counted, _KEY)
    return joined.withColumn("point", F.monotonically_increasing_id())


def _routed(tree: Tree, dim: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            leaf, _ = tree.route(_matrix(part.column("vec"), dim))
            columns = [part.column(c) for c in ("point", "label", "vec", "ids")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(leaf)], ["point", "label", "vec", "ids", "leaf"]
            )

    return run


def _ranged(tree: Tree, dim: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["node", "child", "split", "low", "high", "norm_low", "norm_high"]
        for part in parts:
            rows = [
                (at, child, i, low[i], high[i], norm_low, norm_high)
                for at, child, low, high, norm_low, norm_high in tree.route(
                    _matrix(part.column("vec"), dim)
                )[1]
                for i in range(len(low))
            ]
            columns = list(zip(*rows)) or [()] * len(names)
            types = [pa.int64()] * 3 + [pa.float64()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], names
            )

    return run


def build(points: DataFrame) -> tuple[Index, DataFrame, DataFrame]:
    """(index, chunks, leaves) over all ``points``. What comes to the driver is bounded by ``FIT``:
    the sample, and the ranges of a tree that has no more nodes than the sample has rows."""
    chosen = points.orderBy(F.xxhash64("k1", "k2", "label")).limit(FIT).select("label", "vec").collect()
    dim = points.agg(F.max(F.size("vec"))).first()[0] or 0
    sample = _matrix(pa.array([r.vec for r in chosen], pa.list_(pa.int64())), dim)
    tree = Tree(sample)
    ranges = (
        points.select("vec")
        .mapInArrow(
            _ranged(tree, dim),
            "node long, child long, split long, low double, high double, norm_low double,"
            " norm_high double",
        )
        .groupBy("node", "child", "split")
        .agg(F.min("low"), F.max("high"), F.min("norm_low"), F.max("norm_high"))
        .collect()
    )
    merged: dict[tuple[int, int], list] = {}
    for node, child, split, *values in ranges:
        merged.setdefault((node, child), []).append((split, *values))
    tree.set_ranges(
        [
            (*at, np.array([r[1] for r in sorted(of)]), np.array([r[2] for r in sorted(of)]),
             of[0][3], of[0][4])
            for at, of in merged.items()
        ]
    )
    routed = points.select("point", "label", "vec", "ids").mapInArrow(
        _routed(tree, dim),
        "point long, label long, vec array<long>, ids array<long>, leaf long",
    )
    routed = materialize(routed, "gnat-points")
    leaves = routed.groupBy("leaf").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("n_chunks"))
    chunk = F.pmod(F.xxhash64("point"), F.col("n_chunks")).cast("int")
    chunks = (
        routed.join(leaves, "leaf")
        .withColumn("chunk", chunk)
        .groupBy("leaf", "chunk")
        .agg(F.collect_list(F.struct("label", "vec", "ids")).alias("points"))
        .withColumn("part", F.floor(F.col("chunk") / CHUNKS_TOGETHER).cast("int"))
    )
    last = F.floor((F.col("n_chunks") - 1) / CHUNKS_TOGETHER).cast("int")
    labels = np.array([r.label for r in chosen], dtype=np.int64)
    return (
        Index(tree, sample, labels, dim),
        materialize(chunks, "gnat-chunks"),
        materialize(leaves.select("leaf", last.alias("last_part")), "gnat-leaves"),
    )


def mine(
    rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30,
    high: int = 90,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``rows`` has ``vec_id``, ``label`` and ``vec`` (whole numbers; see ``usable``), ``anchor`` tells
    the anchors among them. A row's score is its inner product with the anchor; higher scores come
    first, ties by smaller vec_id. An anchor's positives are its first ``positives`` other rows of
    the same label; per positive the first ``negatives`` rows of other labels are returned whose
    score is between ``low`` and ``high`` per cent of the positive's. A positive without such rows,
    or an anchor without positives, gives no row.

    Repeated rows count once. Rows of one vec_id that differ in label or vector are different rows,
    but not each other's positives; such an anchor may get fewer positives than there are. Vectors of unlike lengths are filled with
    zeros. An empty table gives an empty result.
    """
    ship_package(rows.sparkSession)
    points = materialize(_points(rows, anchor, max(positives + 1, negatives)), "gnat-distinct")
    index, chunks, leaves = build(points)
    queries = points.where("n_anchors > 0").select(F.col("point").alias("q"), "label", "vec")
    # one more than asked for: the anchor itself is among them or comes after them
    near = _search(queries, chunks, leaves, index, same=True, k=positives + 1)
    near = materialize(
        near.groupBy("q").agg(
            F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("near")
        ),
        "gnat-near",
    )
    targets = F.array_distinct(F.col("near.score")).alias("targets")
    windows = _search(
        queries.join(near.select("q", targets), "q"), chunks, leaves, index, False, negatives,
        low, high,
    )
    hard = windows.groupBy("q").agg(
        F.collect_list(F.struct("target", "rank", "vec_id", "score")).alias("hard")
    )
    found = materialize(near.join(hard, "q"), "gnat-hard")

    # anchors of one point may be many: its results are copied for every 512 of them
    copies = F.ceil(F.col("n_anchors") / 512).cast("int")
    spread = points.where("n_anchors > 0").select(*_KEY, F.col("point").alias("q"), copies.alias("copies"))
    results = found.join(spread.select("q", "copies"), "q").withColumn(
        "copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))
    )
    anchors = rows.where(anchor).select(
        F.col("vec_id").alias("anchor_id"), "label", F.xxhash64("vec").alias("k1"),
        F.xxhash64(F.lit(1), "vec").alias("k2"),
    )
    anchors = anchors.distinct().join(spread, _KEY)
    anchors = anchors.withColumn("copy", F.pmod(F.xxhash64("anchor_id"), F.col("copies")).cast("int"))
    others = F.filter("near", lambda p: p["vec_id"] != F.col("anchor_id"))
    return (
        anchors.select("anchor_id", "q", "copy")
        .join(results.drop("copies"), ["q", "copy"])
        .select("anchor_id", F.explode(F.slice(others, 1, positives)).alias("p"), "hard")
        .select(
            "anchor_id",
            "p",
            F.explode(F.filter("hard", lambda h: h["target"] == F.col("p.score"))).alias("h"),
        )
        .select(
            "anchor_id",
            F.col("p.vec_id").alias("positive_id"),
            F.col("h.rank").alias("rank"),
            F.col("h.vec_id").alias("negative_id"),
            F.col("p.score").alias("positive_score"),
            F.col("h.score").alias("negative_score"),
        )
    )
