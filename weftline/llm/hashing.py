"""Word hashes and hashed features of many texts at once, with numpy over their UTF-8 bytes.

A word's hash is a sum of random byte values times powers of an odd number (mod 2^64), taken as a
difference of two running sums, then mixed. Nothing is done per word in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at a time; bounds memory for long texts as well.
CHUNK = 1 << 20
#: Rows of a chunk, at most.
ROWS = 4096

_RNG = np.random.default_rng(20240229)
_BYTE_VALUES = _RNG.integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)

#: Separators: white space as the word definition has it, or everything but letters and digits.
WHITE = np.zeros(256, dtype=bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True
PUNCTUATION = np.zeros(256, dtype=bool)
PUNCTUATION[:128] = [not chr(i).isalnum() for i in range(128)]
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: a bijection that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_cached = {"n": 0}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _cached["n"] < n:
        size = max(n, CHUNK + 4096)
        _cached.update(n=size, up=_powers(_BASE, size), down=_powers(_INVERSE, size))
    return _cached["up"][:n], _cached["down"][:n]


def batches(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row ends) of runs of up to ROWS rows and about CHUNK bytes; null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(ends, ends[row] + CHUNK, side="right")) - 1)
        last = min(last, len(column), row + ROWS)
        yield row, raw[ends[row] : ends[last]], ends[row + 1 : last + 1] - ends[row]
        row = last


def _spans(raw: np.ndarray, ends: np.ndarray, separators: np.ndarray):
    inside = ~separators[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[0] = edge[-1] = True
    edge[ends] = True
    before = np.empty(len(raw), dtype=bool)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(raw), dtype=bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    stops = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, stops


def word_hashes(
    raw: np.ndarray, ends: np.ndarray, separators: np.ndarray = WHITE, fold: np.ndarray = SAME,
    prefixes: tuple[int, ...] = (),
) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """Hash and row of every word in order; for each length in ``prefixes`` the hash of the word's
    first bytes (0 where the word is no longer than that)."""
    hashes, rows, heads = [], [], {k: [] for k in prefixes}
    begin = 0
    while begin < len(raw):
        stop = min(begin + CHUNK, len(raw))
        if stop < len(raw):  # move to the next separator or row end, so that no word is cut
            step = stop
            while step < len(raw):
                window = raw[step : step + 4096]
                found = np.flatnonzero(separators[window])
                row_end = ends[np.searchsorted(ends, step)]
                near = step + int(found[0]) if len(found) else len(raw)
                if len(found) or row_end <= step + 4096:
                    stop = min(near, int(row_end))
                    break
                step += 4096
            else:
                stop = len(raw)
            stop = max(stop, begin + 1)
        piece = raw[begin:stop]
        cut = ends[(ends >= begin) & (ends <= stop)] - begin
        starts, stops = _spans(piece, cut, separators)
        up, down = _power_tables(len(piece) + 1)
        sums = np.zeros(len(piece) + 1, dtype=np.uint64)
        np.cumsum(_BYTE_VALUES[fold[piece]] * up[: len(piece)], out=sums[1:])
        low, scale = sums[starts], down[starts]
        hashes.append(mix((sums[stops] - low) * scale))
        rows.append(np.searchsorted(ends, starts + begin, side="right"))
        for k in prefixes:
            long = stops - starts > k
            head = mix((sums[np.minimum(starts + k, stops)] - low) * scale + np.uint64(k))
            heads[k].append(np.where(long, head, np.uint64(0)))
        begin = stop
    if not hashes:
        none = np.zeros(0, np.uint64)
        return none, np.zeros(0, np.int64), {k: none for k in prefixes}
    join = np.concatenate
    return join(hashes), join(rows), {k: join(v) for k, v in heads.items()}


def shingles(hashes: np.ndarray, rows: np.ndarray, n_rows: int, size: int = 5):
    """Hash and row of every run of ``size`` words; a shorter text is one shingle of all words."""
    counts = np.bincount(rows, minlength=n_rows)
    firsts = np.concatenate(([0], np.cumsum(counts)))[:-1]
    length = np.minimum(counts, size)
    n_shingles = np.where(counts > 0, np.maximum(counts - size + 1, 1), 0)
    owner = np.repeat(np.arange(n_rows), n_shingles)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(n_shingles) - n_shingles, n_shingles)
    at = firsts[owner] + within
    out = np.zeros(len(owner), dtype=np.uint64)
    for i in range(size):
        used = length[owner] > i
        value = hashes[np.minimum(at + i, max(len(hashes) - 1, 0))] if len(hashes) else out
        out = np.where(used, mix(out * np.uint64(3) + value + np.uint64(i + 1)), out)
    return out, owner
