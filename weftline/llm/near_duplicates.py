"""Near-duplicate classes by BagMinHash signatures, banding and exact multiset overlap.

1. Texts are keyed by a digest; rows with equal texts are one node from there on.
2. A node's signature is drawn from its multiset of 5-word shingles. Every shingle owns Poisson
   processes over a hierarchy of weight intervals [0,1), [1,2), [2,4), [4,8), ...; a shingle that
   occurs ``w`` times uses the part of them below ``w``. Each point falls on one register, which
   keeps the earliest. Two texts agree on a register with a probability equal to their weighted
   Jaccard similarity. A process is followed only until all registers are sure to be hit.
3. Registers are banded. Nodes that share a band bucket, directly or through others, go to one
   search block (``blocks``). There, each node is compared with those before it that share a bucket
   and are not in its component yet: four bits of every register go along as a sketch, and pairs
   whose sketches agree in fewer places than a pair at the threshold does (by 3.6 standard
   deviations) are left out; the others are compared exactly, the likeliest first. Only links that
   join two components are sent on, so a block of n nodes gives less than n rows.
4. The class of a row is the smallest doc_id in its component.

Nodes are compared on the multisets of 64-bit shingle hashes. Labels, links and components are
DataFrames throughout; each round of components is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.blocks import Forest, search_blocks
from weftline.llm.common import materialize, pack, ship_package, small_batches
from weftline.llm.hashing import batches, mix, shingles, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 32
ROWS = 7
#: Four bits of each register, 16 registers to a long.
SKETCH_LONGS = BANDS * ROWS // 16
#: Equal places of two sketches at similarity 0.8 have mean 182 and standard deviation 5.8; this is
#: 3.6 deviations below the mean, which leaves out one pair in 6,000 at the very threshold.
SKETCH_EQUAL = 161
#: Points of Poisson processes drawn at a time, which bounds memory whatever the texts are.
DRAWN = 1 << 19


def text_key(text: Column) -> Column:
    """16 bytes of SHA-256; null where the text has no words, which is like nothing else."""
    digest = F.unhex(F.substring(F.sha2(text, 256), 1, 32))
    return F.when(text.rlike(r"[^\x20\x09-\x0D]"), digest)


def _uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1], from the top 53 bits."""
    return ((x >> np.uint64(11)) + np.uint64(1)) * (1.0 / (1 << 53))


def bag_minhash(
    items: np.ndarray, owner: np.ndarray, n_rows: int, registers: int
) -> np.ndarray:
    """Signatures (rows x registers) of multisets: ``items`` are hashes, repeats are weights."""
    signature = np.full(n_rows * registers, np.inf)
    if not len(items):
        return signature.reshape(n_rows, registers)
    order = np.lexsort((items, owner))
    items, owner = items[order], owner[order]
    first = np.ones(len(items), dtype=bool)
    first[1:] = (items[1:] != items[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(first)
    weight = np.diff(np.append(at, len(items))).astype(np.float64)
    items, owner = items[at], owner[at]
    total = np.bincount(owner, weights=weight, minlength=n_rows)

    # one process per item and weight interval: level 0 is [0, 1), level k is [2^(k-1), 2^k)
    levels = 1 + np.ceil(np.log2(weight)).astype(np.int64)
    element = np.repeat(np.arange(len(items)), levels)
    level = np.arange(len(element)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level > 0, 2.0 ** (level - 1), 0.0)
    width = np.where(level > 0, low, 1.0)
    seed = mix(items[element] + mix(level.astype(np.uint64) + np.uint64(0xB5)))
    row, limit = owner[element], weight[element]

    horizon = registers * (np.log(registers) + 3) / np.maximum(total, 1)
    todo = total > 0
    while todo.any():
        live = np.flatnonzero(todo[row])
        time, drawn, block = np.zeros(len(live)), 0, 1
        while len(live):
            step = np.arange(drawn, drawn + block, dtype=np.uint64) * np.uint64(3)
            base = seed[live][:, None]
            gaps = -np.log(_uniform(mix(base + step))) / width[live][:, None]
            # one after another, so that times do not depend on how many are drawn at once
            gaps[:, 0] += time
            times = np.cumsum(gaps, axis=1)
            use = times <= horizon[row[live]][:, None]
            i, j = np.nonzero(use)
            if len(i):
                hit = live[i]
                register = mix(seed[hit] + step[j] + np.uint64(1)) % np.uint64(registers)
                height = low[hit] + width[hit] * _uniform(mix(seed[hit] + step[j] + np.uint64(2)))
                below = height <= limit[hit]
                cell = row[hit[below]] * registers + register[below].astype(np.int64)
                np.minimum.at(signature, cell, times[i, j][below])
            time = times[:, -1]
            keep = use[:, -1]
            live, time = live[keep], time[keep]
            drawn, block = drawn + block, max(1, min(2 * block, DRAWN // max(len(live), 1)))
        todo &= np.isinf(signature.reshape(n_rows, registers)).any(axis=1)
        horizon = horizon * 2
    return signature.reshape(n_rows, registers)


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = np.ascontiguousarray(signature).view(np.uint64).reshape(len(signature), bands, rows)
    out = np.broadcast_to(mix(np.arange(bands, dtype=np.uint64)), bits.shape[:2])
    for i in range(rows):
        out = mix(out * np.uint64(5) + bits[:, :, i])
    return out.view(np.int64)


def sketches(signature: np.ndarray) -> np.ndarray:
    bits = mix(np.ascontiguousarray(signature).view(np.uint64)) & np.uint64(15)
    places = bits.reshape(len(signature), SKETCH_LONGS, 16)
    shifts = np.arange(0, 64, 4, dtype=np.uint64)
    return np.bitwise_or.reduce(places << shifts, axis=2).view(np.int64)


def _lists(values: np.ndarray) -> pa.ListArray:
    n, width = values.shape
    offsets = pa.array(np.arange(0, n * width + 1, width, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(values.ravel()))


def _signatures(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        keys = part.column("key")
        for start, raw, ends in batches(part.column("text")):
            n = len(ends)
            hashes, rows, _ = word_hashes(raw, ends)
            items, owner = shingles(hashes, rows, n, SHINGLE)
            signature = bag_minhash(items, owner, n, BANDS * ROWS)
            buckets = _lists(band_hashes(signature, BANDS, ROWS))
            size = pa.array(np.bincount(owner, minlength=n))
            columns = [keys.slice(start, n), buckets, _lists(sketches(signature)), size]
            yield pa.RecordBatch.from_arrays(columns, ["key", "buckets", "sketch", "size"])


def _item_rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to their multisets of shingle hashes: distinct ones in order, and how often each."""
    kept = ["node", "part", "blocks", "buckets", "sketch"]
    for part in parts:
        for start, raw, ends in batches(part.column("text")):
            n = len(ends)
            hashes, rows, _ = word_hashes(raw, ends)
            items, owner = shingles(hashes, rows, n, SHINGLE)
            order = np.lexsort((items, owner))
            items, owner = items[order], owner[order]
            new = np.ones(len(items), dtype=bool)
            new[1:] = (items[1:] != items[:-1]) | (owner[1:] != owner[:-1])
            at = np.flatnonzero(new)
            times = np.diff(np.append(at, len(items))).astype(np.int32)
            offsets = np.concatenate(([0], np.cumsum(np.bincount(owner[at], minlength=n))))
            offsets = pa.array(offsets.astype(np.int32))
            columns = [part.column(c).slice(start, n) for c in kept]
            columns.append(pa.ListArray.from_arrays(offsets, pa.array(items[at].view(np.int64))))
            columns.append(pa.ListArray.from_arrays(offsets, pa.array(times)))
            yield pa.RecordBatch.from_arrays(columns, [*kept, "items", "times"])


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets (distinct items in order, times)."""
    (items, times), (others, other_times) = a, b
    place = np.minimum(np.searchsorted(others, items), max(len(others) - 1, 0))
    same = others[place] == items if len(others) else np.zeros(len(items), dtype=bool)
    shared = int(np.minimum(times[same], other_times[place[same]]).sum())
    total = int(times.sum() + other_times.sum()) - shared
    return shared / total if total else 0.0


def _agreeing(sketch: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Equal places of a sketch with each of the others."""
    x = sketch[None, :] ^ others
    half = x | (x >> np.uint64(1))
    odd = (half | (half >> np.uint64(2))) & np.uint64(0x1111111111111111)
    return BANDS * ROWS - np.bitwise_count(odd).sum(axis=1, dtype=np.int64)


def link_block(
    bags: list[tuple[np.ndarray, np.ndarray]],
    buckets: np.ndarray,
    sketch: np.ndarray,
    parts: np.ndarray,
    least: float = SIMILARITY,
) -> list[tuple[int, int]]:
    """Links (i, j) that join the components of the nodes; not those that close a ring.

    Where ``parts`` has two values, links within a part are left to the part's own block.
    """
    n = len(bags)
    forest, links = Forest(n), []
    apart = len(np.unique(parts)) > 1
    flat = buckets.ravel()
    node = np.repeat(np.arange(n), buckets.shape[1] if n else 0)
    order = np.lexsort((node, flat))
    flat, node = flat[order], node[order]
    first = np.ones(len(flat), dtype=bool)
    first[1:] = flat[1:] != flat[:-1]
    starts = np.flatnonzero(first)[np.cumsum(first) - 1] if len(flat) else np.zeros(0, np.int64)
    place = np.flatnonzero(starts < np.arange(len(flat)))  # entries with a node before them
    by_node = place[np.argsort(node[place], kind="stable")]
    bounds = np.cumsum(np.bincount(node[place], minlength=n))
    for i in range(n):
        mine = by_node[(bounds[i - 1] if i else 0) : bounds[i]]
        if not len(mine):
            continue
        met = np.concatenate([node[a:b] for a, b in zip(starts[mine].tolist(), mine.tolist())])
        met = met[forest.of[met] != forest.of[i]]
        if apart:
            met = met[parts[met] != parts[i]]
        met = np.unique(met)
        equal = _agreeing(sketch[i], sketch[met])
        likely = np.argsort(-equal, kind="stable")
        for j in met[likely[equal[likely] >= SKETCH_EQUAL]].tolist():
            if forest.of[j] != forest.of[i] and similarity(bags[i], bags[j]) >= least:
                forest.join(i, j)
                links.append((i, j))
    return links


def _linked(table: pa.Table) -> pa.Table:
    table = table.combine_chunks()
    columns = {c: table.column(c).chunk(0) for c in ("items", "times", "buckets", "sketch")}
    ends = np.cumsum(columns["items"].value_lengths().to_numpy())[:-1]
    items = np.split(columns["items"].flatten().to_numpy().view(np.uint64), ends)
    times = np.split(columns["times"].flatten().to_numpy(), ends)
    nodes = table.column("node").to_numpy()
    buckets = columns["buckets"].flatten().to_numpy().reshape(len(nodes), BANDS)
    sketch = columns["sketch"].flatten().to_numpy().reshape(len(nodes), SKETCH_LONGS)
    found = link_block(
        list(zip(items, times)), buckets, sketch.view(np.uint64), table.column("part").to_numpy()
    )
    a, b = [nodes[i] for i, _ in found], [nodes[j] for _, j in found]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def components(links: DataFrame) -> DataFrame:
    """(node, root) of all nodes in a link; root is the smallest node that links lead to.

    Links join different nodes; an edge leads from a node to a smaller one. In each round, first the
    smaller neighbours of a node are tied to the least of them, then every edge goes on to the least
    neighbour of its smaller end, until each node has one edge, to its root. Edges that come to be
    equal are merged, so later rounds join few more rows than there are nodes, whatever the number
    of links, and long chains shorten geometrically.
    """
    edges = links.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("near"))
    edges = materialize(edges.distinct(), "near-edges")
    while True:
        least = edges.groupBy("node").agg(F.min("near").alias("low"))
        tied = edges.join(least, "node").where("near > low").select("near", "low")
        edges = materialize(least.union(tied).toDF("node", "near").distinct(), "near-edges")
        least = edges.groupBy(F.col("node").alias("near")).agg(F.min("near").alias("low"))
        onward = edges.join(least, "near", "left").groupBy(
            "node", F.coalesce("low", "near").alias("root")
        )
        onward = materialize(onward.agg(F.max(F.expr("low IS NOT NULL")).alias("moved")), "near-edges")
        edges = onward.select("node", F.col("root").alias("near"))
        per_node = onward.groupBy("node").agg(F.max("moved").alias("moved"), F.count("*").alias("n"))
        if per_node.where("moved OR n > 1").isEmpty():
            roots = onward.select(F.col("root").alias("node"), "root").distinct()
            return onward.select("node", "root").union(roots)


def _with_root(df: DataFrame, labels: DataFrame) -> DataFrame:
    return df.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))


def classify(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``row`` (all columns, or ``carry``), ``doc_id``, ``class_id``, ``class_size``, ``root`` and
    ``n_first``, the number of rows of the class that bear ``class_id`` as their doc_id.

    ``class_id`` is the smallest doc_id among all rows of the class; ``class_size`` counts rows.
    Null and wordless texts are alike to nothing: the class is the row's own doc_id, the size 1,
    ``root`` null. A class of rows without any doc_id has a null id. Texts under five words are
    one shingle. Repeated rows share a class. An empty table gives an empty result.
    """
    ship_package(docs.sparkSession)
    texts = docs.select("doc_id", "text", text_key(F.col("text")).alias("key"))
    worded = texts.where("key IS NOT NULL")
    drawn = worded.select("key", "text").mapInArrow(
        _signatures, "key binary, buckets array<long>, sketch array<long>, size long"
    )
    with small_batches(docs.sparkSession):
        signed = materialize(drawn, "near-signed")
    by_id = worded.groupBy("key", "doc_id").agg(F.count("*").alias("n"))
    ids = by_id.groupBy("key").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "n")).alias("first"),
        F.sum("n").alias("n"),
    )
    nodes = (
        signed.groupBy("key")
        .agg(F.first(F.struct("buckets", "sketch", "size")).alias("drawn"))
        .select("key", "drawn.*")
        .join(ids, "key")
        .withColumn("node", F.monotonically_increasing_id())
    )
    nodes = materialize(nodes, "near-nodes")
    spread = nodes.select("node", F.explode("buckets").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.min("node").alias("a"), F.max("node").alias("high"))
    stars = spread.withColumnRenamed("node", "b").join(shared.where("a < high"), "bucket")
    groups = components(stars.where("a < b").select("a", "b").distinct())
    sized = groups.join(nodes.select("node", F.col("size").alias("n")), "node")
    needed = search_blocks(materialize(sized, "near-groups")).join(
        nodes.select("node", "key", "buckets", "sketch"), "node"
    )
    # rows with the same text are one node: one of them is enough
    texts = worded.select("key", "text").join(needed, "key").groupBy("node").agg(
        F.first(F.struct("text", "part", "blocks", "buckets", "sketch")).alias("one")
    )
    rows = texts.select("node", "one.*").mapInArrow(
        _item_rows,
        "node long, part int, blocks array<string>, buckets array<long>, sketch array<long>,"
        " items array<long>, times array<int>",
    )
    found = (
        rows.withColumn("block", F.explode("blocks"))
        .drop("blocks")
        .groupBy("block")
        .applyInArrow(_linked, "a long, b long")
    )
    with small_batches(docs.sparkSession):
        found = materialize(found, "near-links")
    labels = components(found)

    rooted = _with_root(nodes.select("node", "key", "first", "n"), labels)
    firsts = rooted.groupBy("root", "first.none", "first.doc_id").agg(
        F.sum("first.n").alias("n_first"), F.sum("n").alias("n")
    )
    classes = firsts.groupBy("root").agg(
        F.min(F.struct("none", "doc_id", "n_first")).alias("first"), F.sum("n").alias("class_size")
    )
    by_text = rooted.select("root", "key").join(classes, "root").select(
        "key", "root", "class_size", "first.n_first", F.col("first.doc_id").alias("class_id")
    )
    by_text = materialize(by_text, "near-classes")
    rows = pack(docs, carry, doc_id=F.col("doc_id"), key=text_key(F.col("text")))
    alone = F.col("root").isNull()
    return rows.join(by_text, "key", "left").select(
        "row",
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"),
        "root",
        F.coalesce("n_first", F.lit(1).cast("long")).alias("n_first"),
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each class, with the columns of ``docs``: the one with the smallest doc_id."""
    firsts = classify(docs).where("root IS NULL OR doc_id <=> class_id")
    single = firsts.where("n_first = 1").select("row")
    repeated = firsts.where("n_first > 1").dropDuplicates(["root"]).select("row")
    return single.union(repeated).select("row.*")
