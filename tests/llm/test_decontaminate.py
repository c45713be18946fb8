"""Decontamination of long texts and against benchmarks of any size."""

import random

import pytest
from weftline.llm import decontaminate


def _judged(docs, benchmark):
    return {r.row.doc_id: (r.n_items, r.item_ids) for r in decontaminate.judge(docs, benchmark).collect()}


@pytest.mark.parametrize("broadcast", [1_000_000, 0], ids=["broadcast", "shuffled"])
def test_a_long_text_that_hits_everywhere_fits(spark, monkeypatch, broadcast):
    """Rows that hit once carried all tokens of their text: 14 GB for this one."""
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", broadcast)
    before, after = " ".join(f"a{i}" for i in range(15)), " ".join(f"b{i}" for i in range(15))
    items = [(1, f"{before} {'de ' * 8} {after}"), (2, f"{after} {before}")]
    texts = [(1, "de " * 30_000), (2, f"{'de ' * 30_000} {after} {before}"), (3, f"{before} {'de ' * 8} {after}")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = _judged(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert got == {1: (0, []), 2: (2, [1, 2]), 3: (1, [1])}


def _rows():
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(14)]
    items = []
    for i in range(60):
        size = rnd.choice((3, 6, 7, 10, 19, 20, 21, 35, 70))
        items.append((i if i % 7 else None, " ".join(rnd.choices(words[: rnd.choice((2, 14))], k=size))))
    items.append(items[20])
    texts = []
    for d in range(120):
        text = rnd.choices(words, k=rnd.choice((0, 3, 15, 80, 300)))
        for _ in range(rnd.randrange(3)):
            at = rnd.randrange(len(text) + 1)
            copy = rnd.choice(items)[1].split()
            text[at:at] = [w if rnd.random() > 0.12 else "other" for w in copy]
        texts.append((d, " ".join(text)))
    return texts, items


def _leaks(texts, items):
    """(text, item): the definition, token by token."""
    found = set()
    for d, text in texts:
        t = text.split()
        for number, (_, item) in enumerate(items):
            w = item.split()
            size = min(len(w), decontaminate.WINDOW)
            masks = decontaminate.MASKS if len(w) >= decontaminate.SHORTEST else ["1" * len(w)]
            for mask in masks:
                for p in range(len(w) - len(mask) + 1):
                    for q in range(len(t) - len(mask) + 1):
                        if any(b == "1" and t[q + i] != w[p + i] for i, b in enumerate(mask)):
                            continue
                        equal = [0 <= j + q - p < len(t) and t[j + q - p] == w[j] for j in range(len(w))]
                        starts = range(max(p - size + 1, 0), min(p, len(w) - size) + 1)
                        need = size * decontaminate.TOLERANCE if len(w) >= decontaminate.SHORTEST else size
                        if any(sum(equal[s : s + size]) >= need for s in starts):
                            found.add((d, number))
    return found


@pytest.mark.parametrize("block", [4096, 16, 33])
@pytest.mark.parametrize("broadcast", [1_000_000, 0], ids=["broadcast", "shuffled"])
def test_leaks_are_those_of_plain_python(spark, monkeypatch, broadcast, block):
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", broadcast)
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    texts, items = _rows()
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = _judged(docs, spark.createDataFrame(items, "item_id long, text string"))
    want = {d: (0, []) for d, _ in texts}
    for d, number in _leaks(texts, items):
        n, ids = want[d]
        want[d] = (n + 1, sorted({*ids, items[number][0]} - {None}))
    assert got == want


def test_a_full_sieve_loses_nothing(spark, monkeypatch):
    texts, items = _rows()
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = _judged(docs, benchmark)
    monkeypatch.setattr(decontaminate, "SIEVE_ROWS", 1)
    monkeypatch.setattr(decontaminate, "SIEVE_WORDS", 2)
    monkeypatch.setattr(decontaminate, "BROADCAST_TOKENS", 0)
    assert _judged(docs, benchmark) == want
