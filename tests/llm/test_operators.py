"""The training-data operators on small tables with the awkward cases in them."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import (
    bpe,
    classifier,
    common,
    decontaminate,
    mixing,
    near_duplicates,
    quality_rules,
    secret_scan,
    token_counts,
    token_store,
    toxicity,
    url_filter,
)
from weftline.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = SCHEMA + ", row string, key string, kept boolean, node long, `odd ``name` int"
WORDS = [f"w{i * 7919 % 1000}" for i in range(400)]


def _text(start, n=80):
    return " ".join(WORDS[start : start + n])


NEAR = _text(0).replace(WORDS[70], "changed")
ROWS = [
    (1, _text(0), "en", "src1", 1),
    (2, _text(0), "en", "src1", 1),
    (2, _text(0), "en", "src1", 1),
    (3, NEAR, "de", "src2", 1),
    (4, _text(100), None, None, None),
    (5, "", "en", "src0", 0),
    (6, None, "en", "src0", None),
    (None, _text(200), "fr", "x", 1),
    (None, None, None, None, None),
    (7, "one two", "en", "src3", 1),
    (8, " ".join(_text(0, 300) for _ in range(30)), "en", "src4", 1),
]


@pytest.fixture(scope="module", params=["plain", "extra"])
def docs(request, spark):
    if request.param == "plain":
        return spark.createDataFrame(ROWS, SCHEMA).coalesce(2)
    return spark.createDataFrame([(*r, "r", "k", True, 5, 6) for r in ROWS], EXTRA).coalesce(2)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(
        [(1, 1, 0), (1, 0, 1), (8, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int"
    )


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(1, _text(120, 30)), (None, _text(220, 20)), (3, None), (4, "too short"), (5, "")]
    return spark.createDataFrame(rows, "item_id long, text string")


def test_quality_rules(docs, empty, labels):
    judged = quality_rules.judge(docs, labels).collect()
    assert len(judged) == len(ROWS)
    assert {r.row.doc_id for r in judged if r.base_failed} == {5, 6, 7, 8, None}
    kept = quality_rules.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 6
    assert quality_rules.keep_good(empty, labels).count() == 0
    assert quality_rules.keep_good(docs, labels.limit(0)).count() == 6


def test_binomial_tail_is_exact(spark):
    from math import comb

    cases = [(0, 10), (1, 100), (5, 400), (40, 4000)]
    rows = spark.createDataFrame(cases, "k long, n long")
    p = 0.0125
    for r in rows.select("k", "n", quality_rules.binomial_tail(rows.k, rows.n, p).alias("t")).collect():
        want = sum(comb(r.n, i) * p**i * (1 - p) ** (r.n - i) for i in range(r.k + 1))
        assert r.t == pytest.approx(want if r.k <= r.n * p else 1.0, rel=1e-9)


def test_near_duplicates(docs, empty):
    rows = near_duplicates.classify(docs).collect()
    by_id = {(r.doc_id, r.row.text is None): r.class_id for r in rows}
    assert len(rows) == len(ROWS)
    assert by_id[1, False] == by_id[2, False] == by_id[3, False] == 1
    assert by_id[5, False] == 5 and by_id[6, True] == 6 and by_id[4, False] == 4
    kept = near_duplicates.keep_first(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 4, 5, 6, 7, 8, None, None])
    assert near_duplicates.keep_first(empty).count() == 0


def _drifting_chains():
    """Chains of copies, each with one to three words of the one before changed; some words repeat."""
    rng = np.random.default_rng(3)
    texts = []
    for chain in range(12):
        words = [f"c{chain}x{i}" for i in rng.integers(0, 400, 100)]
        words += words[:20]
        for _ in range(15):
            for at in rng.integers(0, len(words), rng.integers(1, 4)):
                words[at] = f"n{rng.integers(10**9)}"
            texts.append(" ".join(words))
    return texts


def test_near_duplicates_equal_exact_components(spark):
    texts = _drifting_chains()
    bags = [Counter(zip(*[t.split()[i:] for i in range(5)])) for t in texts]
    smallest = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if (bags[a] & bags[b]).total() >= 0.8 * (bags[a] | bags[b]).total():
                low, high = sorted((smallest[a], smallest[b]))
                smallest = [low if s == high else s for s in smallest]
    assert 12 < len(set(smallest)) < len(texts) // 2  # chains break, and hold over several steps
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_duplicates.classify(docs).collect()}
    assert got == dict(enumerate(smallest))


def test_components_join_links_once_and_few_rows_later(spark, monkeypatch):
    rng = np.random.default_rng(5)
    dense = {(int(min(p)), int(max(p))) for p in rng.integers(0, 200, (4000, 2)) if p[0] != p[1]}
    chain = (1000 + rng.permutation(60)).tolist()
    links = sorted(dense) + list(zip(chain, chain[1:]))
    made, join = [], type(spark.range(1)).join

    def counting(self, *args, **named):
        out = join(self, *args, **named)
        made.append(out.count())
        return out

    monkeypatch.setattr(type(spark.range(1)), "join", counting)
    frame = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.root for r in near_duplicates.components(frame).collect()}
    assert got == dict.fromkeys(range(200), 0) | dict.fromkeys(chain, 1000)
    assert sum(made) < 3 * len(links)  # one round over all links, both ways, makes two thirds of it
    assert near_duplicates.components(frame.where("a < 0")).count() == 0


def test_near_duplicates_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(common, "BATCH_BYTES", 4096)
    texts = _drifting_chains()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    small = {tuple(r) for r in near_duplicates.classify(docs, ["doc_id"]).select("doc_id", "class_id").collect()}
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None
    monkeypatch.undo()
    whole = near_duplicates.classify(docs, ["doc_id"]).select("doc_id", "class_id").collect()
    assert small == {tuple(r) for r in whole}


def test_encoding_workers_are_handed_bounded_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "BATCH_BYTES", 1 << 16, raising=False)
    make = token_store._writer

    def watched(*args):
        write = make(*args)

        def run(parts):
            def bounded():
                for part in parts:
                    assert part.nbytes < 1 << 18, part.nbytes  # vectors may be half empty
                    yield part

            return write(bounded())

        return run

    monkeypatch.setattr(token_store, "_writer", watched)
    docs = spark.range(800).select(
        F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("ab "), 3000), "id").alias("text")
    )
    got = token_store.digests(spark, docs, str(tmp_path / "store"), tokenizer_path()).collect()
    assert sorted(r.doc_id for r in got) == list(range(800))


def test_bag_minhash_is_unbiased():
    rng = np.random.default_rng(1)
    a = rng.integers(1, 2**63, 300).astype(np.uint64)
    left, right = np.repeat(a, 3), np.concatenate((np.repeat(a[:200], 2), a[200:], a[200:]))
    signature = near_duplicates.bag_minhash(
        np.concatenate((left, right)), np.repeat([0, 1], [len(left), len(right)]), 2, 4096
    )
    assert (signature[0] == signature[1]).mean() == pytest.approx(600 / 900, abs=0.04)


def test_decontamination(docs, empty, benchmark):
    found = decontaminate.judge(docs, benchmark).collect()
    assert len(found) == len(ROWS)
    assert {(r.row.doc_id, tuple(r.item_ids)) for r in found if r.contaminated} == {
        (4, (1,)), (None, ()), (8, (1, )),
    }
    clean = decontaminate.keep_clean(docs, benchmark)
    assert clean.columns == docs.columns and clean.count() == len(ROWS) - 3
    assert decontaminate.keep_clean(empty, benchmark).count() == 0
    assert decontaminate.keep_clean(docs, benchmark.limit(0)).count() == len(ROWS)


def test_decontamination_tolerates_substitutions(spark, benchmark):
    words = _text(120, 30).split()
    for i in (4, 12, 20):
        words[i] = "other"
    docs = spark.createDataFrame([(1, "Before " + " ".join(words).upper() + ".")], "doc_id long, text string")
    assert decontaminate.judge(docs, benchmark).first().contaminated


def test_mixing(docs, empty):
    mixed = mixing.keep_mixture(docs)
    assert mixed.columns == docs.columns
    words = sum(len((r[1] or "").split()) for r in ROWS)
    got = sum(len((r.text or "").split()) for r in mixed.collect())
    assert 0 < got <= words * 9 // 10
    assert mixing.keep_mixture(empty).count() == 0


def test_token_store_round_trip(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    whole = Tokenizer.from_file(path)
    keys = token_store.write_store(docs, str(tmp_path / "store"), path)
    read = token_store.read_store(spark, str(tmp_path / "store"), keys, ids=True).collect()
    want = Counter(
        (r[0], tuple([*whole.encode(r[1] or "", add_special_tokens=False).ids, 2])) for r in ROWS
    )
    assert Counter((None if r.k2 % 2 else r.k1, tuple(r.value)) for r in read) == want
    starts = sorted((r.start, r.n_tokens) for r in read)
    assert [s for s, _ in starts] == np.cumsum([0, *(n for _, n in starts)])[:-1].tolist()
    foreign = spark.createDataFrame([(99, 0)], "k1 long, k2 long")
    assert token_store.look_up(spark, str(tmp_path / "store"), foreign).count() == 0
    assert token_store.digests(spark, empty, str(tmp_path / "none"), path).count() == 0


def test_perfect_hash_is_minimal():
    keys = np.arange(5000) * 37 - 99
    sizes, bits = token_store.build_levels(keys, keys % 3)
    assert sorted(token_store.slots(sizes, bits, keys, keys % 3)) == list(range(5000))


ODD = ["", " ", "\n", "a  b", " a\n\n b\t c", "don't 's\n'd", "x y\u3000z\x85 q", "日本語 です。 a.b, c!",
       "x<|endoftext|>y", "a <|endoftext|> b\nc d", "word### it's we're, '### 12%."]


def test_pieces_encode_as_whole_texts():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    for text, ids, spans in zip(
        ODD, bpe.encode_ids(ODD, tokenizer_path()), bpe.encode_spans(ODD, tokenizer_path()), strict=True
    ):
        want = whole.encode(text, add_special_tokens=False)
        assert ids.tolist() == want.ids
        assert [tuple(s) for s in spans.tolist()] == want.offsets


def test_letters_and_marks_encode_as_whole_texts():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    chars = [c for c in map(chr, range(0x21, 0x3000)) if not c.isspace()]
    texts = [f"{c} a{c}b {c}, {c}{c}. ab{c}, x'{c}; {c}-a\n{c}\nx{c}." for c in chars]
    for text, ids in zip(texts, bpe.encode_ids(texts, tokenizer_path()), strict=True):
        assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_words_are_looked_up_once_and_need_no_pre_tokenizer(monkeypatch):
    class Counted(bpe._Known):
        looked = 0

        def __getitem__(self, piece):
            self.looked += 1
            return super().__getitem__(piece)

        def get(self, piece):
            self.looked += 1
            return super().get(piece)

    bpe.forget()
    one, sent = bpe.encoder(tokenizer_path()), []
    known, run = Counted(), one._run
    known.update(one.known)
    monkeypatch.setattr(one, "known", known)
    monkeypatch.setattr(one, "_run", lambda texts: sent.extend(texts) or run(texts))
    words = [f"{a}{b}lér" for a in "abcdefghij" for b in "klmnopqrst"]
    texts = [" ".join(words[i % 50 :]) + ", and\nword" for i in range(400)]
    found = bpe.encode_packed(texts, tokenizer_path())
    assert known.looked < 500  # of about 30,000 pieces
    assert not any(word in text for word in words for text in sent)
    bpe.forget()
    assert found == [bpe.encode_packed([text], tokenizer_path())[0] for text in texts]


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(docs, empty, rule):
    rows = token_counts.attribute(docs, tokenizer_path(), rule).collect()
    for r in rows:
        assert len(r.section_tokens) == (r.row.text or "").count("\n") + 1
        assert sum(r.section_tokens) == r.n_tokens
    assert len(rows) == len(ROWS)
    assert token_counts.attribute(empty, tokenizer_path(), rule).count() == 0


def test_crossing_tokens_follow_the_rule():
    spans, starts = np.array([[0, 2], [2, 7], [7, 8]]), np.array([0, 3, 6])
    assert token_counts.allocate(spans, starts, "start")[0].tolist() == [2, 0, 1]
    assert token_counts.allocate(spans, starts, "end")[0].tolist() == [1, 0, 2]
    assert token_counts.allocate(spans, starts, "longest")[0].tolist() == [1, 1, 1]


def test_trigram_queries():
    assert secret_scan.trigram_query("[0-9a-f]{24,}") == []
    assert secret_scan.trigram_query("AKIA[A-Z0-9]{16,}") == [frozenset({frozenset({"aki", "kia"})})]
    (part,) = secret_scan.trigram_query(secret_scan.BASE_RULES[0].pattern)
    assert frozenset({"pas", "ass", "ssw", "swd", "swo"}) not in part and len(part) == 6


def test_secret_scan(spark, empty):
    texts = [
        "password = hunter22 PASSWORD: x token=abcdef",
        "é AKIA" + "A" * 16 + " " + "0" * 24 + " ghp_" + "a1" * 12,
        "secret=token:abcdef",  # the short match uses up its text
        "", None, "nothing here",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.row.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secret_scan.scan(docs).collect()}
    assert got[0] == [("assign", 0, 19), ("assign", 32, 44)]
    assert got[1] == [("access", 2, 22), ("hex", 23, 47), ("github", 48, 76), ("hex", 52, 76)]
    assert got[2] == got[3] == got[4] == got[5] == []
    assert secret_scan.scan(empty).count() == 0


def test_long_url_passwords_and_tokens_are_found(spark):
    token = "github_pat_" + "1A" * 11 + "_" + "b2C" * 19 + "dE"  # 93 characters
    texts = {
        1: f"git clone https://x:{token}@example.com/a", 2: "ftp://" + "u" * 65 + ":" + "p" * 200 + "@b.org", 3: f"key {token}",
        4: "http://u:" + "p" * 64 + "@h", 5: "http://u:short@h", 6: "http://u:" + "p" * 70 + "/@h", 7: "github_pat_short",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.row.doc_id: [(s.kind, texts[r.row.doc_id][s.start : s.end]) for s in r.spans] for r in secret_scan.scan(docs).collect()}
    assert len(token) == 93
    assert got[1] == [("url_password", f"://x:{token}@"), ("github_pat", token)]
    assert got[2] == [("url_password", texts[2][3:-5])] and got[3] == [("github_pat", token)]
    assert got[4] == [("url_password", texts[4][4:-1])] and got[6] == got[7] == []
    assert got[5] == []


URLS = [
    None, "", "nohost", "http://WWW.Example.com/en/a?x#y", "http://example.com/en/", "http://a.example.com/fr/",
    "https://x.net/es/1", "https://net/fr/", "http://spam-farm.example.org/z", "http://b.org", "x://com", "a://b?c/d",
]


@pytest.mark.parametrize("max_bytes", [1 << 30, 0], ids=["mapped", "joined"])
def test_url_filter(spark, max_bytes):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    got = {r.row.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, max_bytes=max_bytes).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("www.example.com", "/en/a", "www.example.com/en/", "allow")
    assert got[4][2:] == ("example.com/en/", "block") and got[5][2:] == ("com/", "allow")
    assert got[6][2:] == ("net/es/", "block") and got[7][2:] == ("net/fr/", "block")
    assert got[8][2:] == (None, "block") and got[9][2:] == (None, "allow")
    assert got[10] == ("com", "", None, "allow") and got[11] == ("b", "", None, "allow")


SPAM = {
    "http://m.adult-x.example.net/en/1": "block", "http://blog.adult-x.example.net": "block",
    "http://www.Casino-Win.example.org/a": "block", "http://freecasinos.example.org/": "block",
    "http://a.cheap-pills.b.example.org?q": "block", "http://spam-farm.example.org": "block",
    "http://m.casino-win.example.com/fr/": "allow", "http://example.net/": "allow",
    "http://sussex.example.org/": "allow", "http://best.casino/": "allow", "http://betterads.org/": "allow",
    "http://www.adult-x.example.net/es/": "block", "nohost": "allow",
}


@pytest.mark.parametrize("max_bytes", [1 << 30, 0], ids=["mapped", "joined"])
def test_spam_hosts_of_the_pages_are_blocked(spark, max_bytes):
    pages = spark.createDataFrame([(u,) for u in [*SPAM, *SPAM, None]], "url string")
    listed = url_filter.spam_hosts(pages)
    assert sorted(r.entry for r in listed.collect()) == [
        "adult-x.example.net", "casino-win.example.com", "casino-win.example.org",
        "cheap-pills.b.example.org", "freecasinos.example.org", "spam-farm.example.org",
    ]
    entries = url_filter.default_entries(spark).unionByName(listed)
    got = url_filter.judge(pages, entries, max_bytes=max_bytes).collect()
    assert len(got) == 2 * len(SPAM) + 1
    for r in got:
        assert r.verdict == SPAM.get(r.row.url, "allow"), r
        assert (r.rule is not None) == (".com/" in (r.row.url or "") or "/es/" in (r.row.url or ""))


@pytest.mark.parametrize("broadcast", [1_000_000, 0], ids=["broadcast", "shuffled"])
def test_items_without_a_seed_leak_if_copied_whole(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", broadcast)
    items = [(1, "Who wrote Emma?"), (2, "who wrote emma"), (3, "这是一个问题。"), (4, "Emma wrote who"), (5, "?"),
             (6, "one two three four five six"), (7, None), (None, "Who, wrote; Emma")]
    texts = {
        1: "Q: Who wrote Emma? Who wrote\nEMMA", 2: "who wrote the Emma", 3: "他说，这是一个问题。好", 4: "wrote Emma", 5: None,
        6: "zero one two three four five six", 7: "one two three four five", 8: "", 9: "who wrote emma",
    }
    docs = spark.createDataFrame([*texts.items(), (9, "who wrote emma")], "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.judge(docs, benchmark).collect()
    want = {1: (3, [1, 2]), 3: (1, [3]), 6: (1, [6]), 9: (3, [1, 2])}
    assert len(got) == 10
    for r in got:
        assert (r.n_items, r.item_ids) == want.get(r.row.doc_id, (0, []))
        assert r.contaminated == (r.row.doc_id in want)


def test_scorers_on_awkward_rows(docs, empty, labels):
    rows = classifier.score(docs).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert classifier.score(empty).count() == 0
    rows = toxicity.score(docs, labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    for r in rows:
        want = r.row.doc_id is not None and zlib.crc32(str(r.row.doc_id).encode()) % 3 == 1
        assert r.held_out == want
    assert toxicity.score(empty, labels).count() == 0
