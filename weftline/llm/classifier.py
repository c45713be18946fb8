"""Quality classifier from weak labels.

Overlapping heuristic labellers vote for or against every document, as built-in expressions. The
counts of vote patterns over all documents go to expectation-maximisation, which estimates how
accurate each labeller is; the posterior of a document's pattern is its soft label. A hashed
linear scorer learns them from a bounded sample (``SAMPLE`` documents) and scores every document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm import label_model, linear
from weftline.llm.common import let, pack, ship_package, words
from weftline.llm.hashing import LOWER, word_hashes

SAMPLE = 12_000
KEEP_FROM = 0.5
#: A labeller that speaks against more good documents than this is not one.
FALSE_ALARM = 0.005


def labellers(text: Column) -> Column:
    """Array of votes (0 bad, 1 nothing against it), from a few counts of the whole text."""
    text = F.coalesce(text, F.lit(""))
    count = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.length(line) > 0)
    by_word = let(
        words(text),
        lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")),
    )
    by_line = let(
        lines,
        lambda rows: F.struct(
            F.size(rows).alias("n"),
            F.size(F.array_distinct(rows)).alias("distinct"),
            F.coalesce(F.array_max(F.transform(rows, lambda r: F.length(r))), F.lit(0)).alias("longest"),
        ),
    )
    stats = F.struct(
        by_word.alias("word"),
        by_line.alias("line"),
        count(" \t\n\x0b\x0c\r").alias("spaces"),
        count("#*$%&|<>").alias("symbols"),
        count("0123456789").alias("digits"),
        count(".!?").alias("stops"),
        F.length(text).alias("chars"),
    )

    def votes(s: Column) -> Column:
        n = F.greatest(s["word"]["n"], F.lit(1))
        n_lines = F.greatest(s["line"]["n"], F.lit(1))
        letters = F.greatest(s["chars"] - s["spaces"], F.lit(1))
        mean = letters / n
        fresh = s["word"]["distinct"] / n
        dup = 1 - s["line"]["distinct"] / n_lines
        bad = [
            n < 3,
            s["symbols"] / n >= 0.1,
            dup >= 0.5,
            (n >= 20) & (fresh < 0.25),
            (mean > 12) | (mean < 2),
            s["line"]["longest"] > 5 * F.greatest(s["chars"] / n_lines, F.lit(1000)),
            s["digits"] / letters >= 0.3,
            (n >= 30) & (s["stops"] / n < 0.005),
        ]
        return F.array(*[F.when(b, 0).otherwise(1) for b in bad])

    return let(stats, votes)


def features(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, their last byte with the one before, and shares of the whole text in steps."""
    n = len(ends)
    hashes, rows, _ = word_hashes(raw, ends, fold=LOWER)
    counts = np.bincount(rows, minlength=n)
    at_least = np.maximum(counts, 1)
    again = np.zeros(len(hashes), dtype=bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    runs = np.bincount(rows, weights=again, minlength=n) / at_least
    lengths = np.diff(np.concatenate(([0], ends)))
    sums = np.concatenate(([0], np.cumsum(np.isin(raw, np.frombuffer(b"#*$%&|<>", np.uint8)))))
    symbols = np.diff(sums[np.concatenate(([0], ends))]) / at_least
    order = np.lexsort((hashes, rows))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (rows[order][1:] != rows[order][:-1])
    fresh = np.bincount(rows[order][new], minlength=n) / at_least
    every = np.arange(n)
    step = lambda x: np.floor(np.clip(x, 0, 4) * 20)
    parts = [
        (rows, hashes),
        linear.tagged(every, step(runs), 1),
        linear.tagged(every, step(symbols), 2),
        linear.tagged(every, step(fresh) + 100 * (counts >= 20), 3),
        linear.tagged(every, np.floor(np.log2(counts + 1.0)), 4),
        linear.tagged(every, np.floor(np.clip(lengths / at_least, 0, 40)), 5),
    ]
    return np.concatenate([r for r, _ in parts]), np.concatenate([h for _, h in parts])


def posteriors(voted: DataFrame) -> dict[str, float]:
    """Pattern of votes to the probability of a good document; all rows count."""
    patterns = voted.groupBy("votes").count().orderBy("votes").collect()  # 2^8 patterns at most
    if not patterns:
        return {}
    votes = np.array([[int(v) for v in p.votes] for p in patterns])
    counts = np.array([p["count"] for p in patterns], dtype=float)
    start = np.where((votes == 0).any(axis=1), 0.05, 0.95)
    found = label_model.fit(votes, counts, start=start, false_alarm=FALSE_ALARM)
    return {p.votes: float(q) for p, q in zip(patterns, found, strict=True)}


def score(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``row`` (all columns, or ``carry``), ``score`` (probability of good) and ``kept``.

    One row per row of ``docs``. Null and empty texts get a score like any short text. Repeated
    rows score alike. An empty table gives an empty result.
    """
    ship_package(docs.sparkSession)
    voted = docs.select(
        "doc_id", "text", F.array_join(labellers(F.col("text")).cast("array<string>"), "").alias("votes")
    )
    soft = posteriors(voted.select("votes"))

    def targets(table: pa.Table) -> np.ndarray:
        return np.array([soft.get(v, 0.5) for v in table.column("votes").to_pylist()])

    weights = linear.fit(linear.sample(voted, SAMPLE, [F.col("votes")]), features, targets)
    rows = pack(docs, carry, text=F.col("text"))
    schema = rows.select("row").schema.add("score", "double")
    scored = rows.mapInArrow(linear.scorer(weights, features, ["row"]), schema)
    return scored.withColumn("kept", F.col("score") >= KEEP_FROM)
