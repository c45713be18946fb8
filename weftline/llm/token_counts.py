"""Token counts per section, from one encoding of the whole document.

The document is encoded once, so counts add up to the whole and no section is charged for a cut.
Tokens and sections are intervals of characters; joined, they say which sections a token touches.
A token that touches several is allocated by an explicit rule: ``start`` (the section of its first
character), ``end`` (of its last) or ``longest`` (most of its characters, the earlier one on a tie).

Sections are lines; a line break belongs to the line it ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.bpe import encode_spans
from weftline.llm.common import pack, ship_package

RULES = ("start", "end", "longest")
#: Texts encoded at a time in a worker.
TEXTS = 64


def line_starts(text: str) -> np.ndarray:
    """First character of each line; an empty text has one empty line."""
    lengths = [len(line) + 1 for line in text.split("\n")]
    return np.cumsum([0, *lengths])[:-1]


def allocate(spans: np.ndarray, starts: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens per section, and how many tokens touch more than one."""
    first = np.searchsorted(starts, spans[:, 0], side="right") - 1
    final = np.maximum(spans[:, 1] - 1, spans[:, 0])
    last = np.searchsorted(starts, final, side="right") - 1
    crossing = np.flatnonzero(last > first)
    to = last.copy() if rule == "end" else first
    if rule == "longest" and len(crossing):
        # one row for each crossing token and section it touches
        n = last[crossing] - first[crossing] + 1
        token = np.repeat(crossing, n)
        section = first[token] + np.arange(len(token)) - np.repeat(np.cumsum(n) - n, n)
        ends = np.append(starts[1:], np.iinfo(np.int64).max)
        shared = np.minimum(spans[token, 1], ends[section]) - np.maximum(
            spans[token, 0], starts[section]
        )
        order = np.lexsort((-section, shared, token))
        token, section = token[order], section[order]
        top = np.append(token[1:] != token[:-1], True)
        to[token[top]] = section[top]
    return np.bincount(to, minlength=len(starts)), len(crossing)


def _counter(tokenizer: str, rule: str):
    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for begin in range(0, len(part), TEXTS):
                some = part.slice(begin, TEXTS)
                texts = some.column("text").fill_null("").to_pylist()
                found = [
                    allocate(spans, line_starts(text), rule)
                    for text, spans in zip(texts, encode_spans(texts, tokenizer), strict=True)
                ]
                sizes = np.cumsum([0, *(len(counts) for counts, _ in found)])
                sections = pa.ListArray.from_arrays(
                    pa.array(sizes, pa.int32()),
                    pa.array(np.concatenate([counts for counts, _ in found]).astype(np.int64)),
                )
                crossing = pa.array([n for _, n in found], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [some.column("row"), sections, crossing], ["row", "section_tokens", "n_crossing"]
                )

    return count


def attribute(
    docs: DataFrame, tokenizer: str, rule: str = "longest", carry: list[str] | None = None
) -> DataFrame:
    """``row`` (all columns, or ``carry``), ``section_tokens`` (one count per line), ``n_tokens``
    and ``n_crossing`` (tokens that touch several lines).

    One row per row of ``docs``. Null and empty texts are one line without tokens. Repeated rows
    count alike; an empty table gives an empty result.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}, not {rule!r}")
    ship_package(docs.sparkSession)
    rows = pack(docs, carry, text=F.col("text"))
    schema = rows.select("row").schema.add("section_tokens", T.ArrayType(T.LongType()))
    schema = schema.add("n_crossing", "long")
    counted = rows.mapInArrow(_counter(tokenizer, rule), schema)
    total = F.aggregate("section_tokens", F.lit(0).cast("long"), lambda a, b: a + b)
    return counted.withColumn("n_tokens", total)
