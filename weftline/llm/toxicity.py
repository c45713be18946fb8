"""Toxicity scores by weak supervision.

1. A lexicon is learned from labelled documents of the training fold (a bounded sample): words and
   beginnings of words that occur in toxic documents and hardly in others, strongest first, as long
   as they explain documents that earlier entries do not. Copies count as one document.
2. Voters look at every document: ``LEXICON_VOTERS`` of them at overlapping parts of the lexicon,
   others at patterns (several different entries, entries per length, repeated entries, shouting).
3. A generative model estimates from the counts of vote patterns over all documents, with the
   training fold's labels where they are known, how accurate the voters are in either class and
   how far they only repeat each other.
4. Its posteriors are the soft labels of a hashed linear classifier, trained on a bounded sample
   and applied to every document. Labels, language, source and doc_id are no inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm import label_model, linear
from weftline.llm.common import pack, ship_package
from weftline.llm.hashing import LOWER, PUNCTUATION, batches, mix, word_hashes

#: Labelled training documents that the lexicon is learned from, and documents for the classifier.
LABELLED_SAMPLE = 15_000
SAMPLE = 15_000
#: Length of the word beginnings that may enter the lexicon.
PREFIXES = (4, 5, 6)
LEXICON_VOTERS = 6
LEXICON_SIZE = 400
EXCLAMATION = np.arange(256) == ord("!")
CAPITALS = (np.arange(256) >= 65) & (np.arange(256) <= 90)
THRESHOLD = 0.7


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _share(raw: np.ndarray, ends: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Per text the share of its bytes that are ``wanted``."""
    sums = np.concatenate(([0], np.cumsum(wanted[raw])))
    starts = np.concatenate(([0], ends[:-1]))
    return (sums[ends] - sums[starts]) / np.maximum(ends - starts, 1)


def shouting(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _share(raw, ends, EXCLAMATION), _share(raw, ends, CAPITALS)


def entries_of(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case words and beginnings of words."""
    hashes, rows, heads = word_hashes(raw, ends, PUNCTUATION, LOWER, PREFIXES)
    all_rows, all_hashes = [rows], [hashes]
    for head in heads.values():
        all_rows.append(rows[head != 0])
        all_hashes.append(head[head != 0])
    return np.concatenate(all_rows), np.concatenate(all_hashes)


def features(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries, and how much of the text is shouted."""
    rows, hashes = entries_of(raw, ends)
    every = np.arange(len(ends))
    marks, capitals = shouting(raw, ends)
    parts = [
        (rows, hashes),
        linear.tagged(every, np.floor(np.minimum(marks, 0.2) * 50), 1),
        linear.tagged(every, np.floor(capitals * 10), 2),
    ]
    return np.concatenate([r for r, _ in parts]), np.concatenate([h for _, h in parts])


def learn_lexicon(text: pa.Array, toxic: np.ndarray) -> np.ndarray:
    """Sorted hashes of the strongest entries; empty if a class is missing."""
    rows, entries = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for start, raw, ends in batches(text):
        row, hashed = entries_of(raw, ends)
        order = np.lexsort((hashed, row))
        row, hashed = row[order], hashed[order]
        new = np.ones(len(row), dtype=bool)
        new[1:] = (hashed[1:] != hashed[:-1]) | (row[1:] != row[:-1])
        rows.append(row[new] + start)
        entries.append(hashed[new])
    rows, entries = np.concatenate(rows), np.concatenate(entries)
    n_toxic, n_clean = int(toxic.sum()), int(len(toxic) - toxic.sum())
    if not n_toxic or not n_clean:
        return np.zeros(0, np.uint64)
    weight = linear.copy_weights(text)
    names, where = np.unique(entries, return_inverse=True)
    support = np.bincount(where, weights=(weight * toxic)[rows])
    against = np.bincount(where, weights=(weight * (1 - toxic))[rows])
    fit = (support >= 3) & (support >= 8 * against)
    # strongest first; a document that an entry explains counts half for the next one
    by_entry = np.argsort(where, kind="stable")
    first = np.concatenate(([0], np.cumsum(np.bincount(where))))
    left = weight * toxic
    chosen = []
    for entry in np.flatnonzero(fit)[np.argsort(-support[fit], kind="stable")]:
        mine = rows[by_entry[first[entry] : first[entry + 1]]]
        if left[mine].sum() >= 2:
            chosen.append(entry)
            left[mine] *= 0.5
        if len(chosen) == LEXICON_SIZE:
            break
    return np.sort(names[np.array(chosen, dtype=np.int64)])


def vote(text: pa.Array, lexicon: np.ndarray) -> np.ndarray:
    """(texts x voters), 1 for toxic."""
    votes = np.zeros((len(text), LEXICON_VOTERS + 4), dtype=np.int8)
    lexicon = lexicon if len(lexicon) else np.zeros(1, np.uint64)
    for start, raw, ends in batches(text):
        n = len(ends)
        row, hashed = entries_of(raw, ends)
        place = np.minimum(np.searchsorted(lexicon, hashed), len(lexicon) - 1)
        hit = lexicon[place] == hashed
        row, entry = row[hit], hashed[hit]
        part = mix(entry + np.uint64(7)) % np.uint64(LEXICON_VOTERS)
        for j in range(LEXICON_VOTERS):  # each entry belongs to two voters
            mine = (part == j) | ((part + np.uint64(1)) % np.uint64(LEXICON_VOTERS) == j)
            votes[start + row[mine], j] = 1
        hits = np.bincount(row, minlength=n)
        pairs = np.unique(np.stack((row.astype(np.uint64), entry)), axis=1) if len(row) else row
        kinds = np.bincount(pairs[0].astype(np.int64), minlength=n) if len(row) else hits
        size = np.diff(np.concatenate(([0], ends)))
        votes[start : start + n, LEXICON_VOTERS] = kinds >= 2
        votes[start : start + n, LEXICON_VOTERS + 1] = hits * 2000 >= np.maximum(size, 1)
        votes[start : start + n, LEXICON_VOTERS + 2] = hits >= 3
        marks, capitals = shouting(raw, ends)
        votes[start : start + n, LEXICON_VOTERS + 3] = (marks >= 0.02) | (capitals >= 0.3)
    return votes


def _patterns(votes: np.ndarray) -> list[str]:
    return ["".join(map(str, row)) for row in votes.tolist()]


def _lexicon(labelled: DataFrame) -> np.ndarray:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = [p for p in parts if len(p)]
        if some:
            table = pa.Table.from_batches(some).combine_chunks()
            text = pa.concat_arrays(table.column("text").chunks)
            found = learn_lexicon(text, table.column("toxic").to_numpy().astype(float))
            yield pa.RecordBatch.from_arrays([pa.array([found.tobytes()])], ["lexicon"])

    found = labelled.coalesce(1).mapInArrow(run, "lexicon binary").first()
    return np.frombuffer(found[0], np.uint64) if found else np.zeros(0, np.uint64)


def _posteriors(voted: DataFrame) -> dict[str, float]:
    """Vote pattern to the probability of toxic, over all documents."""
    # 2^10 patterns with three kinds of label at most
    rows = voted.groupBy("votes", "known").count().orderBy("votes", "known").collect()
    if not rows:
        return {}
    votes = np.array([[int(v) for v in r.votes] for r in rows])
    counts = np.array([r["count"] for r in rows], dtype=float)
    known = np.array([r.known for r in rows])
    start = np.clip(votes.mean(axis=1) * 2, 0.02, 0.98)
    label_model_known = known.copy()
    guess = label_model.fit(votes, counts, label_model_known, start, correlated=True)
    hidden = {r.votes: float(g) for r, g, k in zip(rows, guess, known, strict=True) if k < 0}
    for r, g in zip(rows, guess, strict=True):  # patterns that only labelled rows have
        hidden.setdefault(r.votes, float(g))
    return hidden


def score(docs: DataFrame, labels: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``row`` (all columns, or ``carry``), ``held_out``, ``score`` and ``predicted``.

    One row per row of ``docs``. Null texts are empty; empty texts get the score of a text without
    features. A null doc_id is not held out and has no label. A document with several labels is
    toxic if one of them says so. Repeated rows score alike; an empty table gives an empty result.
    """
    ship_package(docs.sparkSession)
    train = labels.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(
        F.max("toxic").alias("toxic")
    )
    train = train.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    slim = docs.select("doc_id", "text")
    marked = linear.sample(train.select("doc_id", "toxic", F.lit("").alias("text")), LABELLED_SAMPLE, [F.col("doc_id"), F.col("toxic")])
    labelled = slim.join(marked.drop("text"), "doc_id").select("text", "toxic").limit(2 * LABELLED_SAMPLE)
    lexicon = _lexicon(labelled)

    def voting(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = pa.array(_patterns(vote(part.column("text"), lexicon)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), found], ["doc_id", "votes"])

    voted = slim.mapInArrow(voting, "doc_id long, votes string")
    known = voted.join(train, "doc_id", "left").select("votes", F.coalesce("toxic", F.lit(-1)).alias("known"))
    soft = _posteriors(known)

    def targets(table: pa.Table) -> np.ndarray:
        text = pa.concat_arrays(table.column("text").chunks)
        guess = np.array([soft.get(p, 0.5) for p in _patterns(vote(text, lexicon))])
        seen = table.column("known").to_numpy()
        return np.where(seen >= 0, seen, guess)

    chosen = linear.sample(slim, SAMPLE, [F.col("doc_id")]).join(train, "doc_id", "left")
    chosen = chosen.select("text", F.coalesce("toxic", F.lit(-1)).alias("known"))
    weights = linear.fit(chosen, features, targets)
    rows = pack(docs, carry, held_out=held_out(F.col("doc_id")), text=F.col("text"))
    schema = rows.select("row", "held_out").schema.add("score", "double")
    scored = rows.mapInArrow(linear.scorer(weights, features, ["row", "held_out"]), schema)
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
