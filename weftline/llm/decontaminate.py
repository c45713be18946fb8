"""Benchmark decontamination with spaced seeds.

A mask such as ``1101100111`` selects some of the tokens in a window and ignores the others, so a
window still matches where ignored tokens were substituted. Every benchmark window is hashed under
each fixed mask and joined with the training windows. Around each hit, item and text are laid side
by side: the text leaks the item if, in some window of ``WINDOW`` tokens (the whole item, if it is
shorter) that holds the hit, at least ``TOLERANCE`` of the aligned tokens are equal.

Tokens are lower-case runs of letters and digits. Items with fewer tokens than the shortest mask have
no seed: they leak where all their tokens follow each other in a text, without a substitution. In
writing without spaces a run is one token, so such an item is found between marks or line ends, not
within a longer run. Built-in expressions only.

Memory does not follow how long a text is or how often it hits. Texts are searched in blocks of
``BLOCK`` positions, a broadcast sieve of at most 32 MB drops nearly all seeds that no item has, and a
seed that passes carries the tokens around it, as many as a comparison may look at. Those that pass are
shuffled before they are joined, since Spark holds all rows that generated code makes of one row: by
place if the benchmark side is broadcast, as it is if it has at most ``BROADCAST_SEEDS`` seeds (24 bytes
each), or else by seed, where adaptive execution splits hot partitions. The result is the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import let, materialize, pack

MASKS = ["1111111", "1101100111", "11100101011"]
SHORTEST = min(map(len, MASKS))
WINDOW = 20
TOLERANCE = 0.8
BROADCAST_SEEDS = 1_000_000
#: Token hashes of the items (and ten more for each) that are broadcast.
BROADCAST_TOKENS = 4_000_000
#: Positions of a text that are searched at once.
BLOCK = 4096
#: The sieve: bits for a seed and how many of them it sets, longs in a row, rows at most. With more
#: seeds than it has room for it lets more through, which the join drops.
SIEVE_BITS = 32
SIEVE_PROBES = 4
SIEVE_WORDS = 1024
SIEVE_ROWS = 4096


def tokens(text: Column) -> Column:
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1)
    return F.array_remove(parts, "")


def token_hashes(text: Column) -> Column:
    return F.transform(tokens(text), lambda t: F.xxhash64(t))


def _blocks(docs: DataFrame) -> DataFrame:
    """Texts in blocks of ``BLOCK`` positions: ``doc_id``, ``text_hash``, ``h`` and ``begin``.

    ``h`` has the tokens that windows around the block's positions may hold, from the position
    ``begin`` on, and the block's own positions are those after the first ``lead`` tokens.
    """
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), tokens(F.col("text")).alias("t"))
    starts = F.when(F.size("t") > 0, F.sequence(F.lit(0), F.size("t") - 1, F.lit(BLOCK)))
    parts = texts.select("doc_id", "text_hash", "t", F.explode(starts).alias("start"))
    lead = F.least(F.col("start"), F.lit(WINDOW - 1)).alias("lead")
    part = F.slice("t", F.col("start") - lead + 1, lead + (BLOCK + WINDOW - 1))
    return parts.select("doc_id", "text_hash", "start", lead, part.alias("part")).select(
        "doc_id",
        "text_hash",
        "lead",
        (F.col("start") - F.col("lead")).alias("begin"),
        F.transform("part", lambda t: F.xxhash64(t)).alias("h"),
    )


def seeds(df: DataFrame, keep: list[str], hashed: str = "h", lead: Column | None = None) -> DataFrame:
    """One row per window and mask: ``keep``, ``pos`` (from 0) and ``seed``.

    With ``lead`` only those of a block's own positions, ``pos`` being the place in ``hashed``.
    """
    h = F.col(hashed)
    last = F.size(h) - SHORTEST
    first = F.lit(0) if lead is None else lead
    last = last if lead is None else F.least(last, lead + (BLOCK - 1))
    starts = F.when(last >= first, F.sequence(first, last))
    windows = df.select(*df.columns, F.explode(starts).alias("pos"))
    at = [F.get(h, F.col("pos") + i) for i in range(max(map(len, MASKS)))]
    per_mask = [
        F.when(
            at[len(mask) - 1].isNotNull(),
            F.xxhash64(F.lit(k), *[at[i] for i, bit in enumerate(mask) if bit == "1"]),
        )
        for k, mask in enumerate(MASKS)
    ]
    found = windows.select(*keep, "pos", F.explode(F.array(*per_mask)).alias("seed"))
    return found.where("seed IS NOT NULL")


def _around(h: Column, pos: Column) -> Column:
    """The tokens that share a window with the one at ``pos``: those from ``pos - WINDOW + 1`` on."""
    low = F.greatest(pos - (WINDOW - 1), F.lit(0))
    return F.slice(h, low + 1, pos + WINDOW - low)


def _overlap(near: Column, item: Column, pos: Column, item_pos: Column) -> Column:
    """Does a window around the hit hold enough equal tokens? ``near`` is ``_around`` the hit."""
    n_item = F.size(item)
    length = F.least(n_item, F.lit(WINDOW))
    low = F.greatest(item_pos - length + 1, F.lit(0))
    high = F.least(item_pos + length, n_item)
    over = F.least(pos, F.lit(WINDOW - 1)) - item_pos  # token j of the item lies over near[j + over]
    # most leaks are whole copies, and two slices are compared far sooner than token by token
    start = F.least(item_pos, n_item - length)
    copied = F.when(
        start + over >= 0,
        F.slice(near, start + over + 1, length) == F.slice(item, start + 1, length),
    )
    equal = F.transform(
        F.slice(item, low + 1, high - low),
        lambda t, j: F.coalesce(F.get(near, low + over + j) == t, F.lit(False)),
    )
    # a bit for each token, the last one lowest
    bits = F.aggregate(equal, F.lit(0).cast("long"), lambda a, e: a * 2 + e.cast("long"))
    window = F.call_function("shiftleft", F.lit(1).cast("long"), length) - 1

    def enough(b: Column) -> Column:
        def held(s: Column) -> Column:
            return F.bit_count(F.call_function("shiftright", b, s).bitwiseAND(window))

        starts = F.sequence(F.lit(0), F.greatest(high - low - length, F.lit(0)))
        return (F.bit_count(b) >= length * TOLERANCE) & F.exists(
            starts, lambda s: held(s) >= length * TOLERANCE
        )

    return F.coalesce(copied, F.lit(False)) | let(bits, enough)


def _sieve_places(seed: Column, rows: int) -> tuple[Column, list[Column]]:
    """The row of the sieve that a seed belongs to, and its bits there."""
    n_bits = 64 * SIEVE_WORDS
    row = F.pmod(F.shiftrightunsigned(seed, 32), F.lit(rows).cast("long"))
    first = seed.bitwiseAND(F.lit(n_bits - 1).cast("long")).cast("int")
    step = F.shiftrightunsigned(seed, 16).bitwiseAND(F.lit(n_bits - 1).cast("long")).cast("int")
    odd = step.bitwiseOR(F.lit(1))
    return row, [(first + odd * k).bitwiseAND(F.lit(n_bits - 1)) for k in range(SIEVE_PROBES)]


def _sieved(asked: DataFrame, known: DataFrame, n_known: int) -> DataFrame:
    """The rows of ``asked`` whose ``seed`` is in ``known``, and a few others (a Bloom filter)."""
    rows = max(1, min(SIEVE_ROWS, -(-n_known * SIEVE_BITS // (64 * SIEVE_WORDS))))
    row, bits = _sieve_places(F.col("seed"), rows)
    bit = F.col("bit")
    words = known.select(row.alias("sieve_row"), F.explode(F.array(*bits)).alias("bit")).select(
        "sieve_row",
        F.shiftright(bit, 6).alias("word"),
        F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63))).alias("bits"),
    )
    none = asked.sparkSession.range(rows * SIEVE_WORDS).select(
        F.floor(F.col("id") / SIEVE_WORDS).alias("sieve_row"),
        (F.col("id") % SIEVE_WORDS).cast("int").alias("word"),
        F.lit(0).cast("long").alias("bits"),
    )
    words = words.unionByName(none).groupBy("sieve_row", "word").agg(F.bit_or("bits").alias("bits"))
    sieve = words.groupBy("sieve_row").agg(
        F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words")
    )
    sieve = materialize(sieve.select("sieve_row", F.col("words.bits").alias("words")), "bench-sieve")
    passed = F.lit(True)
    for b in bits:
        word = F.get("words", F.shiftright(b, 6))
        passed = passed & (F.getbit(word, b.bitwiseAND(F.lit(63))) == 1)
    held = asked.withColumn("sieve_row", row).join(F.broadcast(sieve), "sieve_row").where(passed)
    return held.select(*asked.columns)


def _short_leaks(blocks: DataFrame, items: DataFrame) -> DataFrame | None:
    """The same for items without a seed, whose tokens are compared with windows of their length."""
    short = items.where(F.size("item_h").between(1, SHORTEST - 1))
    sizes = sorted(r.n for r in short.select(F.size("item_h").alias("n")).distinct().collect())
    if not sizes:
        return None

    def windows(n: int) -> Column:
        last = F.least(F.size("h") - n, F.col("lead") + (BLOCK - 1))
        starts = F.sequence(F.col("lead"), last)
        return F.when(last >= F.col("lead"), F.transform(starts, lambda i: F.slice("h", i + 1, n)))

    each = F.flatten(F.array_compact(F.array(*[windows(n) for n in sizes])))
    asked = blocks.select("doc_id", "text_hash", F.explode(each).alias("item_h"))
    n_short = short.count()
    if n_short <= BROADCAST_SEEDS:
        short = F.broadcast(short)
    else:
        seed = F.xxhash64("item_h").alias("seed")
        asked = _sieved(asked.select("*", seed), short.select(seed), n_short).drop("seed")
    hits = asked.join(short, "item_h")
    return hits.groupBy("doc_id", "text_hash", "item").agg(F.count(F.lit(1)).alias("n_hits"))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_hash, item_id, n_hits): one row per text and benchmark item it leaks.

    Items of the same tokens are searched once; ``item`` numbers them.
    """
    listed = benchmark.select("item_id", token_hashes(F.col("text")).alias("item_h"))
    listed = materialize(listed, "bench-listed")
    items = listed.select("item_h").distinct().withColumn("item", F.monotonically_increasing_id())
    items = materialize(items, "bench-items")
    ids = materialize(listed.join(items, "item_h").select("item", "item_id"), "bench-ids")
    known = seeds(items, ["item"], "item_h").withColumnRenamed("pos", "item_pos")
    known = materialize(known, "bench-seeds")
    seeded = items.where(F.size("item_h") >= SHORTEST)
    blocks = _blocks(docs)
    n_known = known.count()
    asked = seeds(blocks, ["doc_id", "text_hash", "begin", "h"], lead=F.col("lead"))
    asked = _sieved(asked, known, n_known).select(
        "doc_id",
        "text_hash",
        (F.col("begin") + F.col("pos")).alias("pos"),
        _around(F.col("h"), F.col("pos")).alias("near"),
        "seed",
    )
    if n_known <= BROADCAST_SEEDS:
        n_parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        asked, known = asked.repartition(n_parts, "text_hash", "pos"), F.broadcast(known)
    else:
        known = known.hint("merge")
    held = seeded.agg(F.sum(F.size("item_h") + 10)).first()[0] or 0
    seeded = F.broadcast(seeded) if held <= BROADCAST_TOKENS else seeded
    hits = asked.join(known, "seed").join(seeded, "item")
    close = hits.where(
        _overlap(F.col("near"), F.col("item_h"), F.col("pos"), F.col("item_pos"))
    )
    found = close.groupBy("doc_id", "text_hash", "item").agg(F.count(F.lit(1)).alias("n_hits"))
    short = _short_leaks(blocks, items)
    found = found if short is None else found.unionByName(short)
    return found.join(ids, "item").select("doc_id", "text_hash", "item", "item_id", "n_hits")


def judge(docs: DataFrame, benchmark: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``row`` (all columns, or ``carry``), ``contaminated``, ``n_items`` and sorted ``item_ids``.

    One row per row of ``docs``. Null and empty texts leak nothing, null items match nothing, an
    item without an id counts but is not listed. Repeated rows are judged alike. Empty tables give
    empty results; with an empty benchmark nothing is contaminated.
    """
    found = leaks(docs, benchmark).groupBy("doc_id", "text_hash").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.sort_array(F.collect_set("item_id")).alias("item_ids"),
    )
    found = materialize(
        found.withColumnsRenamed({"doc_id": "leak_id", "text_hash": "leak_hash"}), "bench-leaks"
    )
    rows = pack(docs, carry, doc_id=F.col("doc_id"), text_hash=F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("leak_id")) & (F.col("text_hash") == F.col("leak_hash"))
    none = F.array().cast("array<bigint>")
    return rows.join(found, same, "left").select(
        "row",
        F.col("n_items").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("item_ids", none).alias("item_ids"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that leak no benchmark item, with their columns."""
    return judge(docs, benchmark).where("NOT contaminated").select("row.*")
