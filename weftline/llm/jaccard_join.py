"""Jaccard join of word-shingle sets: T-occurrence search by DivideSkip, links joined to components.

Two sets of sizes n and m link at 90 % if they share t(n + m) = ceil(90 (n + m) / 190) shingles or
more, so a set can only link with one that holds ceil(0.9 n) of its own shingles.

1. Texts become sets of 64-bit shingle hashes; equal sets are one node from there on.
2. Any two linked sets share a shingle among the first n - ceil(0.9 n) + 1 of each, in any order
   that is the same for all sets. The order used here: shingles of a hashed part of all shingles
   (one in ``PART``), rare ones first, by their counts over all sets; then the rest, by hash. Only
   shingles that two sets hold can link them, so most sets are settled by this alone.
3. Sets that share such a shingle, directly or through others, go to one search block, together
   with other small groups; a very large group is cut into parts, and every two parts form a block
   (``blocks``). Sets of different blocks cannot link.
4. In a block, an inverted index is built and every set is searched by DivideSkip: its L longest
   lists are set aside, a heap merges the others (entries outside the size window, or already in the
   set's own component, are skipped), sets met T - L times or more are kept, and probed for in the
   long lists by binary search until they reach t or cannot. Links that join nothing new are not
   sent on, so a block of n sets gives less than n rows.
5. Components of the links, with the smallest doc_id of each.

Nothing is estimated: the links are exactly those of the definition, as far as 64-bit hashes of
different shingles differ.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.blocks import Forest, search_blocks
from weftline.llm.common import materialize, pack, ship_package
from weftline.llm.hashing import LOWER, batches, mix, shingles, word_hashes
from weftline.llm.near_duplicates import components, text_key

SHINGLE = 3
#: Two sets link when 100 * |intersection| >= PERCENT * |union|.
PERCENT = 90
#: One in PART shingles is counted over all sets.
PART = 4
#: Weight of a heap step against a probe, from the paper on DivideSkip; and the entries from which
#: on as many lists as possible are set aside, since a probe costs less here than a heap step.
MU, LONG_MERGE = 0.0085, 2048


def required(n: np.ndarray | int, percent: int = PERCENT):
    """How many of its own n shingles a set must share with any set it links with."""
    return -(-percent * n // 100)


def gram_sets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, distinct shingle hashes in order of row and hash, their rows) by chunks."""
    for start, raw, ends in batches(column):
        hashes, rows, _ = word_hashes(raw, ends, fold=LOWER)
        grams, owner = shingles(hashes, rows, len(ends), SHINGLE)
        order = np.lexsort((grams, owner))
        grams, owner = grams[order], owner[order]
        new = np.ones(len(grams), dtype=bool)
        new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
        yield start, len(ends), grams[new], owner[new]


def _ranges(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ..., for each length anew."""
    return np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _sketched(percent: int):
    """Set size, set digest and the shingles that the common order puts first, for every text."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for start, n, grams, owner in gram_sets(part.column("text")):
                size = np.bincount(owner, minlength=n)
                sums = []
                for salt in (1, 2):
                    total = np.zeros(n + 1, dtype=np.uint64)
                    np.add.at(total, owner, mix(grams ^ mix(np.uint64([salt]))))
                    sums.append(total[:n])
                digest = np.stack([*sums, size.astype(np.uint64)], axis=1).tobytes()
                keys = [digest[24 * i : 24 * i + 24] if k else None for i, k in enumerate(size)]
                counted = grams % np.uint64(PART) == 0
                short = size - required(size, percent) + 1
                short -= np.bincount(owner[counted], minlength=n)
                rest, rest_owner = grams[~counted], owner[~counted]  # in the order of their hashes
                extra = _ranges(np.bincount(rest_owner, minlength=n)) < short[rest_owner]
                some = np.concatenate((grams[counted], rest[extra]))
                of = np.concatenate((owner[counted], rest_owner[extra]))
                order = np.argsort(of, kind="stable")
                posted = _lists(some[order], np.bincount(of, minlength=n))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").slice(start, n),
                        part.column("text_key").slice(start, n),
                        pa.array(size.astype(np.int64)),
                        pa.array(keys, pa.binary()),
                        posted,
                    ],
                    ["doc_id", "text_key", "n", "key", "posted"],
                )

    return run


def _gram_rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for start, n, grams, owner in gram_sets(part.column("text")):
            columns = [part.column(c).slice(start, n) for c in ("node", "part", "blocks")]
            columns.append(_lists(grams, np.bincount(owner, minlength=n)))
            yield pa.RecordBatch.from_arrays(columns, ["node", "part", "blocks", "grams"])


def search_block(
    sets: list[np.ndarray], parts: np.ndarray, percent: int = PERCENT
) -> list[tuple[int, int]]:
    """Links (i, j) that join the components of the sets; not those that close a ring.

    Where ``parts`` has two values, links within a part are left to the part's own block.
    """
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    by_size = np.argsort(sizes, kind="stable")
    n_sets, rank = len(sets), np.empty(len(sets), dtype=np.int64)
    rank[by_size] = np.arange(n_sets)
    sorted_sizes, side = sizes[by_size], parts[by_size]
    apart = len(np.unique(parts)) > 1

    # the inverted index: lists of ranks, one after another, each in order
    owner = np.repeat(rank, sizes)
    grams = np.concatenate(sets) if n_sets else np.zeros(0, np.uint64)
    order = np.lexsort((owner, grams))
    grams, entries = grams[order], owner[order]
    first = np.ones(len(grams), dtype=bool)
    first[1:] = grams[1:] != grams[:-1]
    list_of = np.cumsum(first) - 1
    starts = np.flatnonzero(first)
    lengths = np.diff(np.append(starts, len(grams)))
    key = list_of * n_sets + entries  # sorted: a probe of list l for set r is a search for this
    shared = lengths[list_of] > 1
    mine = np.argsort(entries[shared], kind="stable")
    own_lists = np.split(
        list_of[shared][mine], np.cumsum(np.bincount(entries[shared], minlength=n_sets))[:-1]
    )

    forest, links = Forest(n_sets), []
    for q in range(n_sets):
        n, lists = int(sorted_sizes[q]), own_lists[q]
        t = max(int(required(n, percent)), 1)
        smallest = int(np.searchsorted(sorted_sizes, required(n, percent)))
        if len(lists) < t or smallest >= q:
            continue
        # only sets that come before q by size, and are large enough
        begin = np.searchsorted(key, lists * n_sets + smallest)
        end = np.searchsorted(key, lists * n_sets + q)
        some = end > begin
        lists, begin, end = lists[some], begin[some], end[some]
        if len(lists) < t:
            continue
        by_length = np.argsort(end - begin, kind="stable")
        lists, begin, end = lists[by_length], begin[by_length], end[by_length]
        found = _merge(entries, begin, end, t, forest.of, q, side if apart else None)
        for other in _probe(key, n_sets, lists, found, n, sorted_sizes, percent):
            if forest.join(q, int(other)):
                links.append((int(by_size[q]), int(by_size[other])))
    return links


def _merge(entries, begin, end, t, component, q, side) -> tuple[np.ndarray, np.ndarray, int]:
    """Sets met often enough in the short lists: (sets, times met, number of short lists)."""
    sizes = end - begin
    set_aside = min(t - 1, int(t / (MU * log2(max(int(sizes[-1]), 2)) + 1)))
    if sizes[: len(sizes) - set_aside].sum() > LONG_MERGE:
        set_aside = t - 1
    n_short, least = len(sizes) - set_aside, t - set_aside
    short = []
    for b, e in zip(begin[:n_short].tolist(), end[:n_short].tolist()):
        run = entries[b:e]
        use = component[run] != component[q]
        if side is not None:
            use &= side[run] != side[q]
        run = run[use]
        if len(run):
            short.append(run.tolist())
    sets, times = [], []
    for one, same in groupby(heapq.merge(*short)):
        met = sum(1 for _ in same)
        if met >= least:
            sets.append(one)
            times.append(met)
    return np.array(sets, dtype=np.int64), np.array(times, dtype=np.int64), n_short


def _probe(key, n_sets, lists, found, n, sizes, percent) -> np.ndarray:
    """Of the sets found in the short lists, those that share enough: binary search in the rest."""
    sets, times, n_short = found
    need = -(-percent * (n + sizes[sets]) // (100 + percent))
    long, step = lists[n_short:], 32
    for at in range(0, len(long), step):
        left = len(long) - at
        alive = times + left >= need
        sets, times, need = sets[alive], times[alive], need[alive]
        if not len(sets):
            break
        wanted = long[at : at + step, None] * n_sets + sets[None, :]
        place = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
        times = times + (key[place] == wanted).sum(axis=0)
    return sets[times >= need]


def _search(percent: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        nodes = table.column("node").to_numpy()
        grams = table.column("grams").chunk(0) if len(table) else pa.array([], pa.list_(pa.int64()))
        values = grams.flatten().to_numpy().view(np.uint64)
        ends = np.cumsum(grams.value_lengths().to_numpy())
        found = search_block(
            np.split(values, ends[:-1]), table.column("part").to_numpy(), percent
        )
        a, b = [nodes[i] for i, _ in found], [nodes[j] for _, j in found]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _prefixes(nodes: DataFrame) -> DataFrame:
    """(node, gram): the first shingles of each set in the common order, where two sets hold them.

    Shingles of one set only come first in that order, so their number is enough.
    """
    postings = nodes.select("node", F.explode("posted").alias("gram"))
    counts = postings.groupBy("gram").agg(F.count("*").alias("sets")).where("sets > 1")
    outside = F.pmod(F.col("gram"), F.lit(PART)) != 0
    held = postings.join(counts, "gram").groupBy("node").agg(
        F.sort_array(F.collect_list(F.struct(outside.alias("outside"), "sets", "gram"))).alias("held")
    )
    single = F.size("posted") - F.size("held")
    return (
        held.join(nodes.select("node", "posted", "n_first"), "node")
        .where(F.col("n_first") > single)
        .select("node", F.explode(F.slice("held", F.lit(1), F.col("n_first") - single)).alias("one"))
        .select("node", "one.gram")
    )


def links(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(by_text, nodes, links): ``text_key, n, key`` per distinct text, ``key, node, doc_id`` per
    distinct set, and ``a, b`` of links between nodes, enough to connect every component."""
    ship_package(docs.sparkSession)
    worded = docs.select("doc_id", "text", text_key(F.col("text")).alias("text_key")).where(
        "text_key IS NOT NULL"
    )
    sketched = worded.mapInArrow(
        _sketched(percent),
        "doc_id long, text_key binary, n long, key binary, posted array<long>",
    )
    by_text = sketched.groupBy("text_key").agg(
        F.first(F.struct("n", "key", "posted")).alias("set"), F.min("doc_id").alias("doc_id")
    )
    by_text = materialize(by_text.select("text_key", "doc_id", "set.*"), "join-texts")
    n_first = F.col("n") - F.ceil(F.col("n") * F.lit(percent) / 100) + 1
    nodes = (
        by_text.groupBy("key")
        .agg(
            F.min("doc_id").alias("doc_id"),
            F.min(F.struct("text_key", "n", "posted")).alias("one"),
        )
        .select("key", "doc_id", "one.*")
        .withColumns({"n_first": n_first.cast("int"), "node": F.monotonically_increasing_id()})
    )
    nodes = materialize(nodes, "join-nodes")
    prefixes = materialize(_prefixes(nodes), "join-prefixes")
    hubs = prefixes.groupBy("gram").agg(F.min("node").alias("a"), F.max("node").alias("top"))
    stars = prefixes.withColumnRenamed("node", "b").join(hubs.where("a < top"), "gram")
    groups = components(stars.where("a < b").select("a", "b").distinct())
    sized = materialize(groups.join(nodes.select("node", "n", "text_key"), "node"), "join-groups")
    needed = sized.select("node", "text_key").join(search_blocks(sized), "node")
    # rows with the same text are the same set: one of them is enough
    texts = worded.select("text_key", "text").join(needed, "text_key")
    texts = texts.groupBy("node").agg(F.first(F.struct("text", "part", "blocks")).alias("one"))
    rows = texts.select("node", "one.*").mapInArrow(
        _gram_rows, "node long, part int, blocks array<string>, grams array<long>"
    )
    found = (
        rows.select("node", "part", F.explode("blocks").alias("block"), "grams")
        .groupBy("block")
        .applyInArrow(_search(percent), "a long, b long")
    )
    return by_text.drop("posted"), nodes.drop("posted"), materialize(found, "join-links")


def join(docs: DataFrame, carry: list[str] | None = None, percent: int = PERCENT) -> DataFrame:
    """``row`` (all columns, or ``carry``), ``doc_id``, ``n_shingles`` and ``component_id``.

    ``component_id`` is the smallest doc_id that links lead to, the row's own included. Null, empty
    and wordless texts are empty sets, which link with nothing: the size is 0, the component the
    row's own doc_id. Texts under three words are one shingle. Repeated rows and equal sets share a
    component; one whose rows all lack a doc_id is null. An empty table gives an empty result. Long
    texts are sets like others, read in whole; ties do not occur, since a set's order is its hashes'.
    """
    by_text, nodes, found = links(docs, percent)
    rooted = nodes.select("node", "key", "doc_id").join(components(found), "node", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "node"))
    smallest = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    by_set = rooted.select("key", "root").join(smallest, "root").select("key", "component_id")
    known = by_text.select("text_key", "n", "key").join(by_set, "key").drop("key")
    known = materialize(known, "join-components")
    rows = pack(docs, carry, doc_id=F.col("doc_id"), text_key=text_key(F.col("text")))
    alone = F.col("n").isNull()
    return rows.join(known, "text_key", "left").select(
        "row",
        "doc_id",
        F.coalesce("n", F.lit(0).cast("long")).alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
