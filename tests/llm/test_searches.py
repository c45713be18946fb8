"""Jaccard join, hard negatives and fill-in-the-middle against brute force, with awkward rows."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import blocks, fill_middle, hard_negatives, jaccard_join, near_duplicates
from weftline.llm.gnat import Tree

SCHEMA = "doc_id long, text string, lang string"
EXTRA = SCHEMA + ", row string, key string, n long, form string, node long, `odd ``name` int"
WORD = re.compile("[^\x20\x09-\x0D]+")


def _frame(spark, rows, extra):
    if not extra:
        return spark.createDataFrame(rows, SCHEMA).repartition(3)
    return spark.createDataFrame([(*r, "r", "k", 1, "f", 2, 3) for r in rows], EXTRA).repartition(3)


def _components(n, linked):
    root = list(range(n))
    for i, j in linked:
        a, b = root[i], root[j]
        root = [min(a, b) if r in (a, b) else r for r in root]
    return root


# -- Jaccard join -----------------------------------------------------------------------------


def _shingles(text, size=3):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def _texts(seed=3):
    """Drifting chains of copies, texts of very common words, short, empty, null and long ones."""
    draw = random.Random(seed)
    rare = [f"r{i}" for i in range(4000)]
    texts = []
    for _ in range(12):
        words = draw.sample(rare, draw.choice([30, 60, 120]))
        for _ in range(draw.choice([2, 5, 12])):
            for _ in range(draw.choice([0, 1, 2])):
                words[draw.randrange(len(words))] = draw.choice(rare)
            texts.append(" ".join(words))
    base = draw.sample(rare, 100)  # one large group around the threshold
    for _ in range(60):
        words = list(base)
        for _ in range(draw.choice([1, 2, 3])):
            words[draw.randrange(100)] = draw.choice(rare)
        texts.append(" ".join(words))
    texts += [" ".join(draw.choices(["the", "of", "a", "and"], k=draw.choice([4, 9, 40]))) for _ in range(60)]
    texts += ["", " \n\t", None, "one", "ONE", "one two", "one\ntwo", "a b c", "A B c", "  x", "É b c", "é b c"]
    texts += [texts[0], texts[0].upper(), texts[5].replace(" ", "\n  ")]
    long = " ".join(draw.choices(rare, k=30_000))
    texts += [long, long + " more words here", long[: len(long) // 2]]
    return texts


def _linked(sets, percent):
    found = []
    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j])
            if a and shared and 100 * shared >= percent * (len(a) + len(sets[j]) - shared):
                found.append((j, i))
    return found


@pytest.mark.parametrize("extra", [False, True])
@pytest.mark.parametrize("percent", [90, 60])
def test_jaccard_join_equals_brute_force(spark, monkeypatch, extra, percent):
    if extra:  # small blocks: large groups are cut into parts
        monkeypatch.setattr(blocks, "BLOCK", 2_000)
        monkeypatch.setattr(blocks, "BIN", 1_000)
    texts = _texts()
    rows = [(100 + 7 * i % 1000, t, "en") for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[7], None), (None, None, None), (None, "only here twice", "x"),
             (None, "only  here twice", "x")]
    sets = [_shingles(t) for _, t, _ in rows]
    roots = _components(len(rows), _linked(sets, percent))
    smallest = {}
    for root, (doc_id, _, _) in zip(roots, rows):
        known = [x for x in (smallest.get(root), doc_id) if x is not None]
        smallest[root] = min(known) if known else None
    joined = jaccard_join.join(_frame(spark, rows, extra), percent=percent)
    got = sorted(
        ((r.row.doc_id, r.row.text, r.n_shingles, r.component_id) for r in joined.collect()), key=repr
    )
    want = sorted(
        ((r[0], r[1], len(s), smallest[root]) for r, s, root in zip(rows, sets, roots)), key=repr
    )
    assert got == want
    assert len({c for *_, c in got}) < len(rows) - 60  # there is something to link


def test_jaccard_join_of_nothing(spark):
    for rows in ([], [(1, None, "en"), (2, "", "en"), (2, " ", "en")]):
        found = jaccard_join.join(_frame(spark, rows, False), carry=["doc_id"]).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == [
            (i, 0, i) for i, *_ in rows
        ]


@pytest.mark.parametrize("parts", [1, 2])
def test_divide_skip_finds_every_component(parts):
    """Heavily overlapping sets, where long lists are set aside and probed."""
    rng = np.random.default_rng(5)
    base = rng.integers(1, 2**62, 300)
    sets = []
    for _ in range(250):
        kept = rng.random(300) > rng.choice([0.01, 0.04, 0.08])
        own = rng.integers(1, 2**62, rng.integers(0, 20))
        sets.append(np.unique(np.concatenate((base[kept], own))).astype(np.uint64))
    side = np.arange(250) % parts
    plain = [set(s.tolist()) for s in sets]
    want = _components(250, [(i, j) for i, j in _linked(plain, 90) if parts == 1 or side[i] != side[j]])
    links = jaccard_join.search_block(sets, side)
    assert _components(250, links) == want and len(links) < 250
    assert jaccard_join.search_block([], np.zeros(0)) == []


# -- near duplicates --------------------------------------------------------------------------


def test_points_do_not_depend_on_the_block_they_are_drawn_in(monkeypatch):
    rng = np.random.default_rng(1)
    items = rng.integers(1, 50, 400).astype(np.uint64)
    owner = np.sort(rng.integers(0, 9, 400))
    whole = near_duplicates.bag_minhash(items, owner, 9, 224)
    monkeypatch.setattr(near_duplicates, "DRAWN", 64)
    assert (near_duplicates.bag_minhash(items, owner, 9, 224) == whole).all()
    alone = near_duplicates.bag_minhash(items[owner == 4], owner[owner == 4] * 0, 1, 224)
    assert (alone[0] == whole[4]).all()


def test_similarity_of_multisets():
    a = (np.array([1, 5, 9], np.uint64), np.array([2, 1, 4]))
    b = (np.array([5, 9, 11], np.uint64), np.array([3, 2, 1]))
    empty = (np.zeros(0, np.uint64), np.zeros(0, int))
    assert near_duplicates.similarity(a, b) == 3 / (7 + 6 - 3)
    assert near_duplicates.similarity(a, a) == 1 and near_duplicates.similarity(a, empty) == 0


# -- hard negatives ---------------------------------------------------------------------------


def _mined(rows, positives=5, negatives=10):
    """Brute force over (vec_id, label, whole numbers); rows that repeat count once."""
    rows = list({(i, label, tuple(v)): None for i, label, v in rows})
    out = set()

    def score(a, b):
        return sum(x * y for x, y in zip(a, b))

    for anchor, label, v in rows:
        if anchor % 100:
            continue
        others = [(-score(v, w), i, other) for i, other, w in rows if i != anchor]
        same = sorted(o for o in others if o[2] == label)[:positives]
        for p, positive, _ in same:
            window = [o for o in others if o[2] != label and -30 * p <= -100 * o[0] <= -90 * p]
            for rank, (s, i, _) in enumerate(sorted(window)[:negatives], 1):
                out.add((anchor, positive, rank, i, -p, -s))
    return out


def _quantized(rows):
    good = [r for r in rows if None not in (r[0], r[1], r[2])]
    good = [r for r in good if all(x is not None and math.isfinite(x) for x in r[2])]
    return [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in good]


def _vectors(kind):
    rng = np.random.default_rng(11)
    n = 1500
    if kind == "random":
        v = rng.normal(size=(n, 16)).astype(np.float32) / 4
    elif kind == "clusters":
        v = (rng.normal(size=(40, 16))[rng.integers(0, 40, n)] + rng.normal(size=(n, 16)) / 20) / 4
    else:  # a third is one vector, and many scores tie
        v = rng.integers(-2, 3, size=(n, 6)) / 4
        v[rng.random(n) < 0.34] = [0.5, 0.25, 0, 0, -0.25, 0.5]
    rows = [(i * 4, int(rng.integers(0, 4)), [float(x) for x in np.float32(row)]) for i, row in enumerate(v)]
    rows += [rows[0], rows[25], rows[25]]
    nan, inf = float("nan"), float("inf")
    rows += [(400_001, None, [1.0] * 6), (400_002, 1, None), (400_003, 1, [1.0, None]), (None, 1, [1.0] * 6),
             (400_004, 1, [nan] * 6), (400_005, 1, [inf] * 6), (400_006, 1, []), (400_100, 2, [0.0] * 6),
             (400_200, 9, [0.5] * 6), (400_008, 1, [0.5, 0.5])]
    return rows


@pytest.mark.parametrize("kind", ["random", "clusters", "ties"])
@pytest.mark.parametrize("sample", [4096, 200])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, kind, sample):
    monkeypatch.setattr(hard_negatives, "FIT", sample)
    monkeypatch.setattr(hard_negatives, "CHUNK", 64)
    rows = _vectors(kind)
    schema = "vec_id long, embedding array<float>, label int, q int, `part` string"
    df = spark.createDataFrame([(i, v, label, 1, "x") for i, label, v in rows], schema)
    usable = hard_negatives.usable(df.repartition(4))
    found = hard_negatives.mine(usable, F.col("vec_id") % 100 == 0).collect()
    want = _mined(_quantized(rows))
    assert {tuple(r) for r in found} == want and len(found) == len(want)
    assert len(want) > 200


def test_hard_negatives_of_nothing(spark):
    schema = "vec_id long, embedding array<float>, label int"
    for rows in ([], [(100, [1.0], 1)], [(100, [1.0], 1), (200, [1.0], 1)], [(100, None, 1)]):
        usable = hard_negatives.usable(spark.createDataFrame(rows, schema))
        assert hard_negatives.mine(usable, F.col("vec_id") % 100 == 0).collect() == []


def test_the_tree_skips_leaves_without_losing_rows():
    rng = np.random.default_rng(2)
    centres = rng.integers(-4000, 4000, size=(30, 8))
    points = centres[rng.integers(0, 30, 6000)] + rng.integers(-60, 60, size=(6000, 8))
    tree = Tree(points[:1500])
    leaf, ranges = tree.route(points)
    tree.set_ranges(ranges)
    queries = points[rng.integers(0, 6000, 40)]
    found = queries @ points.T
    top = np.sort(found, axis=1)[:, -20:]
    low, high = top[:, :1], top[:, -1:]
    visits = tree.visits(queries, low, high)
    inside = (found >= low) & (found <= high)
    for i in range(40):
        seen = {at for at, mine in visits.items() if i in mine}
        assert set(leaf[inside[i]].tolist()) <= seen
    assert sum(len(mine) for mine in visits.values()) < 0.5 * 40 * len(np.unique(leaf))


def test_scores_of_large_numbers_are_exact():
    a, b = np.array([[2**28 + 1, 3]]), np.array([[2**28 - 1, 5], [1, 1]])
    assert hard_negatives.scores(a, b).tolist() == [[2**56 - 1 + 15, 2**28 + 4]]


# -- fill in the middle -----------------------------------------------------------------------


def _cut(doc_id, text, seed=7):
    text = text or ""
    units = re.findall("[^\n]*\n|[^\n]+", text)
    n = len(units)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")):
        return (n, "plain", None, None, text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 50:
        return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def _cut_texts():
    draw = random.Random(4)
    parts = ["a", "é", "日本", "𝄞", "\n", "\n", "\r\n", "word " * 9, "<", "<P", "S>", "<M", "\0", "x" * 700]
    texts = ["".join(draw.choices(parts, k=draw.choice([1, 3, 20, 400]))) for _ in range(200)]
    texts += ["", None, "\n", "\n\n", "no break", "ends\n", "\nstarts", "<P>x\ny", "y\n<S>", "<M>"]
    texts += ["line\n" * 50_000, "x" * 300_000, ("é" * 511 + "\n") * 300, "\n" * 2_000, "a" * 511 + "\n", "b" * 512]
    return texts


@pytest.mark.parametrize("extra", [False, True])
def test_fill_middle_equals_brute_force(spark, extra):
    rows = [(i, t, "en") for i, t in enumerate(_cut_texts())]
    rows += [rows[2], rows[2], (None, "a\nb\nc", "en"), (None, None, None)]
    cut = fill_middle.transform(_frame(spark, rows, extra))
    cut = cut.withColumn("again", fill_middle.restored(F.col("output"), F.col("form")))
    got = sorted(
        ((r.row.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.again) for r in cut.collect()),
        key=repr,
    )
    want = sorted(((i, *_cut(i, t), t or "") for i, t, _ in rows), key=repr)
    assert got == want
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.transform(_frame(spark, [], extra)).collect() == []


def test_block_trees_against_plain_sums():
    rng = np.random.default_rng(3)
    sizes = np.array([0, 1, 7, 64, 0, 33])
    ones, twos = rng.integers(0, 4, sizes.sum()), rng.integers(0, 9, sizes.sum())
    tree = fill_middle.BlockTree(sizes, ones, twos)
    starts = np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(6), 40)
    target = np.tile(np.arange(40), 6)
    place, first, second = tree.descend(text, target)
    for i in range(len(text)):
        s = starts[text[i]]
        mine, other = ones[s : s + sizes[text[i]]], twos[s : s + sizes[text[i]]]
        k = int((np.cumsum(mine) < target[i]).sum())
        assert (place[i], first[i], second[i]) == (k, mine[:k].sum(), other[:k].sum())
