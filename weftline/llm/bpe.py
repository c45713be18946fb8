"""Byte-level BPE of whole texts with the ``tokenizers`` library, each distinct piece once.

The pre-tokenizer of these vocabularies starts a new pre-token at every space that stands between
two other characters, and makes a lone line break a pre-token of its own, so a text may be cut
there without changing its ids. Pieces repeat, and a worker keeps what it has encoded, up to a
bound in bytes; new pieces are encoded many at a time, one to a line, punctuation at the end of a
word apart from it. Texts with other white space are cut only at lone spaces. Texts that hold the
string of a special or added token are encoded as they are, as the library does it, and so is every
text of any other kind of tokenizer; whole texts are not kept.

Where only ids are asked for, Arrow finds the distinct pieces of many texts and lays out their ids,
so that a piece is looked up once and not wherever it stands. New words of letters are one pre-token
and go to the library's model without its pre-tokenizer.
"""

from __future__ import annotations

import json
import os
import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LONE_SPACE = re.compile(r"(?<=\S)(?= \S)")
#: White space besides space and line break, and the mark that cuts.
OTHER_ASCII = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\0"
OTHER_WIDE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
RUNS = ("  ", " \n", "\n ", "\n\n")
#: Bytes that one Python worker keeps of what it has encoded; more is encoded anew. A piece counts
#: with its text, its ids and ``OVERHEAD`` for the objects that hold them.
KEPT_BYTES, OVERHEAD = 160 << 20, 180
#: A longer piece is no word, and is not kept.
KEPT_PIECE = 64
#: Punctuation after a word is a pre-token of its own; an apostrophe may begin one with letters.
MARKS = re.compile(r"[!-&(-/:-@\[-`{-~]+$")
#: Latin, Greek and Cyrillic letters, which are letters in every version of Unicode since 5.0, so that
#: a run of them is a pre-token and marks after it another, whatever table the library was built with.
LETTERS = "A-Za-zÀ-ÖØ-öø-\u024f\u0391-\u03a1\u03a3-\u03ce\u0400-\u0481"
WORD = re.compile(f" ?[{LETTERS}]+")
#: For Arrow: the marks between a letter and a cut.
WORD_MARKS = rf"([{LETTERS}])([!-&(-/:-@\[-`{{-~]+)\x00"
#: How byte-level vocabularies spell bytes: printable ones as they are, the others from U+0100 on.
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
SPELLED = {b: 0x100 + i for i, b in enumerate(sorted(set(range(0x100)).difference(PRINTABLE)))}
#: Pieces encoded in one call; the library holds several times their size.
LINES = 2_000


class _Known(dict):
    """What is encoded; notes what it is asked for in vain."""

    def __init__(self):
        self.asked: list[str] = []

    def __missing__(self, piece: str) -> bytes:
        self.asked.append(piece)
        return b""


class PieceEncoder:
    """Encodes texts to arrays: token ids, or (first, end) character positions with ``spans``."""

    def __init__(self, path: str, spans: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        before = spec.get("pre_tokenizer") or {}
        self.cuts = (
            before.get("type") == "ByteLevel"
            and before.get("use_regex", True)
            and not before.get("add_prefix_space", True)
            and not spec.get("normalizer")
        )
        added = [re.escape(token["content"]) for token in spec.get("added_tokens") or []]
        self.special = re.compile("|".join(added)) if added else None
        self.spans = spans
        self.known, self.kept = _Known(), 0
        if self.cuts:
            self.line_break = self._run(["\n"])[0].ids
            self.known["\n"] = self._values(self._run(["\n"])[0]).tobytes()

    def _run(self, texts: list[str]):
        encode = self.tokenizer.encode_batch if self.spans else self.tokenizer.encode_batch_fast
        return encode(texts, add_special_tokens=False)

    def _values(self, encoding) -> np.ndarray:
        values = encoding.offsets if self.spans else encoding.ids
        return np.array(values, dtype="<u4").reshape((-1, 2) if self.spans else -1)

    @staticmethod
    def _plain(text: str) -> bool:
        """Is all white space lone spaces and lone line breaks inside the text?"""
        return (
            not any(run in text for run in RUNS)
            and text[:1] not in (" ", "\n")
            and text[-1:] not in (" ", "\n")
            and not any(mark in text for mark in OTHER_ASCII)
            and (text.isascii() or not OTHER_WIDE.search(text))
        )

    def _cut(self, text: str) -> tuple[list[str], bool]:
        if not self.cuts or not text or (self.special and self.special.search(text)):
            return [text], False
        if self._plain(text):
            return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0"), True
        return LONE_SPACE.split(text), False

    def _encode_lines(self, pieces: list[str]) -> dict[str, bytes]:
        """Pieces without line breaks, joined by them: their ids show where each piece ends."""
        out = {}
        for begin in range(0, len(pieces), LINES):
            some = pieces[begin : begin + LINES]
            encoding = self._run(["\n".join(some)])[0]
            values = self._values(encoding)
            ids = values if not self.spans else np.array(encoding.ids)
            ends = [*np.flatnonzero(ids == self.line_break[0]).tolist(), len(values)]
            first, chars = 0, 0
            if not self.spans:
                raw = values.tobytes()
                for piece, end in zip(some, ends, strict=True):
                    out[piece] = raw[4 * first : 4 * end]
                    first = end + 1
                continue
            for piece, end in zip(some, ends, strict=True):
                out[piece] = (values[first:end] - np.uint32(chars)).tobytes()
                first, chars = end + 1, chars + len(piece) + 1
        return out

    def _encode_words(self, pieces: set[str]) -> tuple[dict[str, bytes], set[str]]:
        """Ids of the pieces that are words of known letters, and the other pieces."""
        out, others, tokenize = {}, set(), self.tokenizer.model.tokenize
        for piece in pieces:
            if not WORD.fullmatch(piece):
                others.add(piece)
                continue
            if piece.isascii():
                spelled = piece.replace(" ", "\u0120")
            else:
                spelled = piece.encode().decode("latin-1").translate(SPELLED)
            ids = [one.id for one in tokenize(spelled)]
            out[piece] = struct.pack(f"<{len(ids)}I", *ids)
        return out, others

    def _shift(self, value: bytes, by: int) -> bytes:
        return (np.frombuffer(value, "<u4") + np.uint32(by)).tobytes() if self.spans else value

    def _encode_new(self, pieces: set[str], plain: bool) -> dict[str, bytes]:
        """What the pieces encode to, and the words and marks that some are made of."""
        if not plain:
            new = list(pieces)
            found = zip(new, self._run(new), strict=True)
            return {piece: self._values(one).tobytes() for piece, one in found}
        words: dict[str, bytes] = {}
        if not self.spans:
            words, pieces = self._encode_words(pieces)
        alone = {piece for piece in pieces if piece[-1].isalpha()}
        known, split = self.known, []
        for piece in pieces - alone:
            marks = MARKS.search(piece)
            if marks and piece[: marks.start()][-1:].isalpha():
                word, mark = piece[: marks.start()], marks[0]
                split.append((piece, word, mark))
                if word not in known:
                    alone.add(word)
                if mark not in known:
                    alone.add(mark)
            else:
                alone.add(piece)
        out = self._encode_lines(list(alone))
        for piece, word, mark in split:
            first = out[word] if word in out else known[word]
            last = out[mark] if mark in out else known[mark]
            out[piece] = first + (self._shift(last, len(word)) if self.spans else last)
        return words | out

    def _keep(self, new: dict[str, bytes]) -> None:
        """Put new pieces into ``known`` while they fit."""
        if self.kept + OVERHEAD > KEPT_BYTES:
            return
        for piece, value in new.items():
            size = 4 * len(piece) + len(value) + OVERHEAD
            if len(piece) <= KEPT_PIECE and self.kept + size <= KEPT_BYTES:
                self.kept += size
                self.known[piece] = value

    def encode(self, texts: list[str]) -> list[tuple[list[str], list[bytes]]]:
        """Per text its pieces and the packed values of each."""
        cut = [self._cut(text) for text in texts]
        get, asked = self.known.__getitem__, self.known.asked
        asked.clear()
        got, again, new = [], [], {True: set(), False: set()}
        for i, (pieces, plain) in enumerate(cut):
            before = len(asked)
            got.append(list(map(get, pieces)))
            if len(asked) > before:
                again.append(i)
                new[plain].update(asked[before:])
        extra: dict[str, bytes] = {}
        for plain, some in new.items():
            if some:
                extra |= self._encode_new(some, plain)
        for i in again:
            pieces, values = cut[i][0], got[i]
            at = values.index(b"")
            while True:
                values[at] = extra[pieces[at]]
                try:
                    at = values.index(b"", at + 1)
                except ValueError:
                    break
        self._keep(extra)
        asked.clear()
        return [(pieces, values) for (pieces, _), values in zip(cut, got, strict=True)]

    def _looked_up(self, pieces: list[str]) -> list[bytes]:
        """Values of distinct pieces of plain texts."""
        found = list(map(self.known.get, pieces))
        new = {piece for piece, value in zip(pieces, found, strict=True) if value is None}
        if new:
            extra = self._encode_new(new, True)
            found = [extra[p] if v is None else v for p, v in zip(pieces, found, strict=True)]
            self._keep(extra)
        return found

    def _packed_plain(self, texts: list[str]) -> list[bytes]:
        marked = pc.replace_substring(pa.array(texts, pa.large_string()), "\n", "\0\n\0")
        marked = pc.replace_substring(marked, " ", "\0 ")
        marked = pc.replace_substring_regex(marked, WORD_MARKS, "\\1\0\\2\0")
        cut = pc.split_pattern(marked, "\0")
        pieces = cut.flatten().dictionary_encode()
        distinct = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        values = pa.array(self._looked_up(distinct), pa.large_binary()).take(pieces.indices)
        _, offsets, raw = values.buffers()
        ends = np.frombuffer(offsets, np.int64)[cut.offsets.to_numpy()].tolist()
        return [raw[a:b].to_pybytes() for a, b in zip(ends, ends[1:], strict=False)]

    def packed(self, texts: list[str]) -> list[bytes]:
        """The packed values of each text as a whole; for ids, not for spans."""
        plain, rest = [], []
        for i, text in enumerate(texts):
            whole = not self.cuts or not text or (self.special and self.special.search(text))
            (rest if whole or not self._plain(text) else plain).append(i)
        out: list[bytes] = [b""] * len(texts)
        if plain:
            for i, value in zip(plain, self._packed_plain([texts[i] for i in plain]), strict=True):
                out[i] = value
        for i, (_, values) in zip(rest, self.encode([texts[i] for i in rest]), strict=True):
            out[i] = b"".join(values)
        return out


@lru_cache(maxsize=4)
def encoder(path: str, spans: bool = False) -> PieceEncoder:
    return PieceEncoder(path, spans)


def forget() -> None:
    """Give back what this worker keeps of encoded pieces."""
    encoder.cache_clear()


def vocabulary_size(path: str) -> int:
    """One more than the largest id."""
    return 1 + max(encoder(path).tokenizer.get_vocab(with_added_tokens=True).values())


def encode_packed(texts: list[str], path: str) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit integers."""
    return encoder(path).packed(texts)


def encode_ids(texts: list[str], path: str) -> list[np.ndarray]:
    return [np.frombuffer(value, dtype="<u4") for value in encode_packed(texts, path)]


def encode_spans(texts: list[str], path: str) -> list[np.ndarray]:
    """(tokens x 2) first and end character of each token in the whole text."""
    out = []
    for pieces, values in encoder(path, True).encode(texts):
        spans = np.frombuffer(b"".join(values), dtype="<u4").reshape(-1, 2).astype(np.int64)
        starts = np.cumsum([0, *map(len, pieces)])[:-1]
        counts = np.fromiter(map(len, values), np.int64, len(values)) // 8
        out.append(spans + np.repeat(starts, counts)[:, None])
    return out
