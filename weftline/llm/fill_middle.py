"""Fill-in-the-middle: texts cut between lines, by a Fenwick tree over fixed blocks of the text.

A text's UTF-8 bytes are laid out in blocks of ``BLOCK`` bytes. Two Fenwick trees over the blocks
hold how many lines end in a block and how many code points begin there. For a cut after ``c`` lines
a descent by powers of two finds the block in which the c-th line ends, summing the code points of
the blocks before it; the boundary is then sought in that one block. All cuts of a chunk of texts
descend together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import pack, ship_package
from weftline.llm.hashing import batches

BLOCK = 512
#: Cuts whose blocks are looked into at a time.
AT_ONCE = 4096
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
#: Of 100 texts, those cut at all; and of those, the ones with the suffix first.
CUT_SHARE, SUFFIX_FIRST_SHARE = 100, 50

_LINE_END = 10


class BlockTree:
    """Counts over the blocks of several texts: one Fenwick tree per text, all in one array."""

    def __init__(self, blocks: np.ndarray, *counts: np.ndarray):
        """``blocks`` is the number of blocks of each text; ``counts`` has a value per block."""
        self.size = blocks
        self.offset = np.cumsum(blocks) - blocks
        within = np.arange(int(blocks.sum())) - np.repeat(self.offset, blocks)
        span = (within + 1) & -(within + 1)  # place i + 1 sums so many blocks up to block i
        self.trees = []
        for count in counts:
            sums = np.concatenate(([0], np.cumsum(count)))
            at = np.arange(len(within)) + 1
            self.trees.append(sums[at] - sums[at - span])

    def descend(self, text: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
        """For each (text, target): the number of whole blocks whose first counts stay below
        ``target``, and the sums of all counts over those blocks."""
        place = np.zeros(len(text), dtype=np.int64)
        sums = [np.zeros(len(text), dtype=np.int64) for _ in self.trees]
        step = 1 << max(int(self.size.max(initial=0)), 1).bit_length()
        while step:
            next_place = place + step
            inside = next_place <= self.size[text]
            node = self.offset[text] + np.where(inside, next_place, 1) - 1
            node = np.minimum(node, max(len(self.trees[0]) - 1, 0))
            take = inside
            if len(self.trees[0]):
                take = inside & (sums[0] + self.trees[0][node] < target)
                for total, tree in zip(sums, self.trees):
                    total += np.where(take, tree[node], 0)
            place = np.where(take, next_place, place)
            step >>= 1
        return [place, *sums]


def line_counts(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Lines of each text; a last line need not end in a line break."""
    starts = np.concatenate(([0], ends[:-1]))
    breaks = np.concatenate(([0], np.cumsum(raw == _LINE_END)))
    filled = ends > starts
    open_end = filled.copy()
    open_end[filled] = raw[ends[filled] - 1] != _LINE_END
    return breaks[ends] - breaks[starts] + open_end


def locate(
    raw: np.ndarray, ends: np.ndarray, text: np.ndarray, lines: np.ndarray, cut: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """(byte, code point) in its text after which each cut falls, ``cut`` lines after the start."""
    starts = np.concatenate(([0], ends[:-1]))
    size = ends - starts
    blocks = -(-size // BLOCK)
    first = np.repeat(starts, blocks)
    within = np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    edges = first + within * BLOCK
    stops = np.minimum(edges + BLOCK, np.repeat(ends, blocks))
    breaks = np.concatenate(([0], np.cumsum(raw == _LINE_END)))
    points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    tree = BlockTree(blocks, breaks[stops] - breaks[edges], points[stops] - points[edges])
    del breaks, points

    byte, point = np.zeros(len(text), dtype=np.int64), np.zeros(len(text), dtype=np.int64)
    for begin in range(0, len(text), AT_ONCE):
        some = slice(begin, begin + AT_ONCE)
        of, wanted = text[some], cut[some]
        # after the last line there may be no break to look for: that cut is the end of the text
        at_end, at_start = wanted >= lines[some], wanted <= 0
        target = np.where(at_end, np.iinfo(np.int64).max, wanted)
        place, ended, points_before = tree.descend(of, target)
        begin_byte = np.minimum(starts[of] + place * BLOCK, ends[of])
        columns = begin_byte[:, None] + np.arange(BLOCK)
        known = columns < ends[of][:, None]
        window = np.where(known, raw[np.minimum(columns, max(len(raw) - 1, 0))], 0) if len(raw) else (
            np.zeros(columns.shape, dtype=np.uint8)
        )
        nth = np.cumsum(window == _LINE_END, axis=1) == (wanted - ended)[:, None]
        length = np.where(at_end | at_start, 0, np.argmax(nth, axis=1) + 1)
        used = known & (np.arange(BLOCK) < length[:, None])
        more = (used & ((window & 0xC0) != 0x80)).sum(axis=1)
        byte[some] = np.where(at_start, 0, np.where(at_end, size[of], begin_byte - starts[of] + length))
        point[some] = np.where(at_start, 0, points_before + more)
    return byte, point


def _arranged(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        spins = [part.column(f"h{i}").to_numpy() for i in (1, 2)]
        form_of = part.column("form").to_pylist()
        for start, raw, ends in batches(part.column("text")):
            n_texts = len(ends)
            lines = line_counts(raw, ends)
            cuts = np.stack([spin[start : start + n_texts] % (lines + 1) for spin in spins])
            text = np.tile(np.arange(n_texts), 2)
            cut = np.concatenate((cuts.min(axis=0), cuts.max(axis=0)))
            byte, point = locate(raw, ends, text, np.tile(lines, 2), cut)
            data, begin, outputs = raw.tobytes(), 0, []
            chars = [(int(point[i]), int(point[n_texts + i] - point[i])) for i in range(n_texts)]
            for i, form in enumerate(form_of[start : start + n_texts]):
                whole = data[begin : int(ends[i])]
                begin = int(ends[i])
                a, b = int(byte[i]), int(byte[n_texts + i])
                if form == "plain":
                    outputs.append(whole)
                    chars[i] = (None, None)
                    continue
                pieces = [(PREFIX, whole[:a]), (SUFFIX, whole[b:])]
                if form == "spm":
                    pieces.reverse()
                pieces.append((MIDDLE, whole[a:b]))
                outputs.append(b"".join(mark.encode() + piece for mark, piece in pieces))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("row").slice(start, n_texts),
                    pa.array(lines.astype(np.int64)),
                    part.column("form").slice(start, n_texts),
                    pa.array([c[0] for c in chars], pa.int64()),
                    pa.array([c[1] for c in chars], pa.int64()),
                    pa.array(outputs, pa.binary()).cast(pa.string()),
                ],
                ["row", "n", "form", "prefix_chars", "middle_chars", "output"],
            )


def transform(docs: DataFrame, carry: list[str] | None = None, seed: int = SEED) -> DataFrame:
    """``row`` (all columns, or ``carry``), ``n`` lines, ``form``, ``prefix_chars``,
    ``middle_chars`` and ``output``, the rearranged text.

    The cuts, whether a text is cut and which part comes first follow from ``seed`` and doc_id, so
    a task that runs again gives the same. Null and empty texts, and texts that hold a marker, are
    ``plain``: the output is the text (empty for null), the counts of characters null. A null doc_id
    counts as the empty string; rows with one doc_id draw the same numbers. Repeated rows stay. An
    empty table gives an empty result. Long texts are cut like others: any line may be the cut, and
    the memory used beside the text is a few bytes for each of its bytes.
    """
    ship_package(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h1, h2, h3, h4 = (
        F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)
    )
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    form = (
        F.when((text == "") | marked | (h3 % 100 >= CUT_SHARE), F.lit("plain"))
        .when(h4 % 100 < SUFFIX_FIRST_SHARE, F.lit("spm"))
        .otherwise(F.lit("psm"))
    )
    packed = pack(docs, carry, text=text, form=form, h1=h1, h2=h2)
    schema = packed.select("row").schema.add("n", "long").add("form", "string")
    for name in ("prefix_chars", "middle_chars"):
        schema = schema.add(name, "long")
    return packed.mapInArrow(_arranged, schema.add("output", "string"))


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from. Markers are found from the left; a text that is cut
    holds none, and no marker can begin inside another."""
    body = F.substr(output, F.lit(len(PREFIX) + 1))

    def after(text: Column, mark: str) -> Column:
        return F.substr(text, F.length(F.substring_index(text, mark, 1)) + len(mark) + 1)

    def parts(second: str) -> tuple[Column, Column, Column]:
        rest = after(body, second)
        return (
            F.substring_index(body, second, 1),
            F.substring_index(rest, MIDDLE, 1),
            after(rest, MIDDLE),
        )

    prefix, suffix, middle = parts(SUFFIX)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(PREFIX)
    spm = F.concat(prefix, middle, suffix)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
