"""Mixing sources to target weights by hierarchical token budgets.

Documents are leaves of a tree domain > language > source. A token budget flows from the root to
the leaves by weight. A child whose tokens (times ``epochs``) fall short of its share keeps what
it has, and the shortage goes to its siblings by weight; only what a whole family cannot use goes
to the family's own siblings, because a family is a child of its parent with the sum of its tokens
as its limit. Budgets are whole tokens, rounded down.

A leaf then reads its documents in epochs. Each epoch is a permutation seeded by (seed, epoch,
doc_id); whole epochs are taken first, then the longest prefix of the next one that fits. Hashes
are uniform, so a prefix is found by summing tokens over hash intervals and ordering only the
interval in which the budget ends; no task orders a whole leaf, however large.

Tokens are words. Weights are whole numbers; a name without one has weight 1.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm.common import materialize, pack, word_count

SEED = "mix-1"
EPOCHS = 2
#: Share of the words of all documents that the mixture holds.
KEEP = (9, 10)
DOMAIN_WEIGHTS = {"d0": 2, "d1": 1, "d2": 1, "none": 1}
LANGUAGE_WEIGHTS = {"en": 4, "de": 2, "fr": 2, "es": 2}
SOURCE_WEIGHTS = {"src0": 3}
LEVELS = ["domain", "language", "source"]
#: Rows of a leaf that one hash interval should hold at most.
INTERVAL_ROWS = 4096

WIDE = "decimal(38,0)"


def domain_of(source: Column) -> Column:
    """The number at the end of a source's name, modulo 3; sources without one are ``none``."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), r"([0-9]{1,9})$", 1)
    return F.when(number == "", "none").otherwise(
        F.concat(F.lit("d"), (number.try_cast("long") % 3).cast("string"))
    )


def _weight(column: Column, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for name, weight in weights.items():
        out = F.when(column == name, weight).otherwise(out)
    return out


def _fill(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds ``given``: the share of each child of the parent's ``budget``, at most ``limit``."""
    family = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    by_need = family.orderBy((F.col("limit") / F.col("weight")).cast("double"), name)
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_need.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    df = children.withColumn(
        "left", F.col("budget") - F.coalesce(F.sum("limit").over(before), F.lit(0)).cast(WIDE)
    ).withColumn("weights", F.sum("weight").over(rest).cast("long"))
    # children are ordered by need: the first one that gets less than it could take sets the rate
    short = F.col("limit") * F.col("weights") > F.col("left") * F.col("weight")
    first = F.first(
        F.when(short, F.struct("left", "weights")), ignorenulls=True
    ).over(by_need.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    df = df.withColumn("rate", first)
    share = F.expr("greatest(rate.left, 0) * weight div rate.weights").cast(WIDE)
    given = F.when(F.col("rate").isNull(), F.col("limit")).otherwise(
        F.least(F.col("limit"), share)
    )
    return df.withColumn("given", given.cast(WIDE)).drop("left", "weights", "rate")


def budgets(leaves: DataFrame, total: int) -> DataFrame:
    """(domain, language, source, tokens, n_docs, budget) from (..., tokens, n_docs)."""
    weights = [DOMAIN_WEIGHTS, LANGUAGE_WEIGHTS, SOURCE_WEIGHTS]
    given = None
    for depth, (level, named) in enumerate(zip(LEVELS, weights, strict=True)):
        path, parent = LEVELS[: depth + 1], LEVELS[:depth]
        nodes = leaves.groupBy(*path).agg((F.sum("tokens") * EPOCHS).cast(WIDE).alias("limit"))
        nodes = nodes.withColumn("weight", _weight(F.col(level), named))
        if given is None:
            nodes = nodes.withColumn("budget", F.lit(total).cast(WIDE))
        else:
            nodes = nodes.join(given, parent)
        given = _fill(nodes, parent, level).select(*path, F.col("given").alias("budget"))
    return leaves.join(given.withColumn("budget", F.col("budget").cast("long")), LEVELS)


def _order_key(epoch: Column) -> Column:
    return F.md5(
        F.concat_ws(
            ":", F.lit(SEED), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
        )
    )


def plan(slim: DataFrame, total: int) -> DataFrame:
    """Per leaf: ``full`` whole epochs, then documents with an order key up to ``last``.

    ``slim`` has doc_id, the levels and ``tokens``. Rows with one doc_id share an order key and are
    taken together or not at all.
    """
    leaves = slim.groupBy(*LEVELS).agg(
        F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs")
    )
    funded = budgets(materialize(leaves, "mix-leaves"), total)
    each = F.greatest(F.col("tokens"), F.lit(1))
    full = F.floor(F.col("budget") / each).cast("long")
    digits = F.ceil(F.log(F.greatest(F.col("n_docs") / INTERVAL_ROWS, F.lit(1.0))) / math.log(16))
    funded = funded.select(
        *LEVELS,
        "budget",
        full.alias("full"),
        (F.col("budget") - full * F.col("tokens")).alias("rest"),
        digits.cast("int").alias("digits"),
    )
    funded = materialize(funded, "mix-budgets")
    keyed = (
        slim.join(funded, LEVELS)
        .where("rest > 0")
        .select(*LEVELS, "tokens", "rest", "digits", _order_key(F.col("full")).alias("key"))
        .withColumn("part", F.expr("substring(key, 1, digits)"))
    )
    parts = keyed.groupBy(*LEVELS, "rest", "part").agg(F.sum("tokens").alias("part_tokens"))
    in_leaf = Window.partitionBy(*LEVELS).orderBy("part")
    parts = parts.withColumn("upto", F.sum("part_tokens").over(in_leaf)).withColumn(
        "before", F.col("upto") - F.col("part_tokens")
    )
    # the interval in which the budget ends; every interval before it is taken whole
    end = parts.where("upto > rest AND before <= rest").select(*LEVELS, "part", "before")
    inside = keyed.join(materialize(end, "mix-ends"), [*LEVELS, "part"])
    along = Window.partitionBy(*LEVELS, "part").orderBy("key")  # peers share a key
    taken = inside.withColumn("upto", F.col("before") + F.sum("tokens").over(along)).where(
        "upto <= rest"
    )
    last = taken.groupBy(*LEVELS).agg(F.max("key").alias("in_part"))
    cut = end.join(last, LEVELS, "left").select(
        *LEVELS,
        # keys below the interval's own digits lie in earlier intervals
        F.coalesce("in_part", F.col("part")).alias("last"),
    )
    return funded.join(cut, LEVELS, "left").select(
        *LEVELS,
        "full",
        # no end interval: the budget takes all of the next epoch ("g" is above any hex digit), or none
        F.coalesce("last", F.when(F.col("rest") > 0, F.lit("g")).otherwise(F.lit(""))).alias("last"),
    )


def mix(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``row`` (all columns, or ``carry``) and ``epoch``: a row for each time a document is read.

    Null language and source are leaves named ``""``. Texts without words cost nothing and go with
    whole epochs or by their key. Rows with one doc_id (or none) are taken together. An empty table
    gives an empty mixture.
    """
    levels = {
        "domain": domain_of(F.col("source")),
        "language": F.coalesce(F.col("lang"), F.lit("")),
        "source": F.coalesce(F.col("source"), F.lit("")),
    }
    slim = materialize(
        docs.select(
            "doc_id",
            word_count(F.col("text")).alias("tokens"),
            *[v.alias(k) for k, v in levels.items()],
        ),
        "mix-documents",
    )
    words = slim.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    leaves = materialize(plan(slim, words * KEEP[0] // KEEP[1]), "mix-plan")
    rows = pack(docs, carry, doc_id=F.col("doc_id"), **levels)
    chosen = rows.join(leaves, LEVELS)
    copies = F.col("full") + (_order_key(F.col("full")) <= F.col("last")).cast("long")
    return (
        chosen.withColumn("copies", copies)
        .where("copies > 0")
        .select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("epoch"))
    )


def keep_mixture(docs: DataFrame) -> DataFrame:
    return mix(docs).select("row.*")
