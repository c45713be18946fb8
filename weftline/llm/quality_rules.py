"""Quality rules whose cutoffs carry a guarantee on how many good documents they reject.

Every rule scores a document (higher is worse) and has a fixed ladder of cutoffs, lenient first.
On labelled documents an exact binomial test asks, per language and cutoff, whether the rule
rejects more than its share of good documents. Cutoffs are tested down the ladder until the first
failure (fixed-sequence testing), at a level split over all languages and rules (Bonferroni), so
that with probability ``1 - delta`` no language loses more than ``alpha`` of its good documents
to all rules together. A language with too few labels keeps a rule switched off.

Built-in column expressions only; one shuffle of slim rows (the labelled ones) and none of texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm.common import NOT_SPACE, let, materialize, pack, words

SYMBOLS = "#*$%&|<>"
ALPHA = 0.05
DELTA = 0.05

#: Cutoffs of each rule, lenient first. A document is rejected at a score of the cutoff or more.
LADDERS = {
    "symbols_per_word": [2.0, 1.5, 1.0, 0.75, 0.5, 0.3, 0.2],
    "dup_line_share": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4],
    "repeat_word_share": [0.45, 0.4, 0.35, 0.3, 0.25],
    "chars_per_word": [20.0, 15.0, 12.0, 10.0],
}


def repeated_words(w: Column) -> Column:
    """Words inside 3-word windows that occur at least twice in the text, first ones included."""
    size = F.size(w)
    windows = F.slice(
        F.arrays_zip(
            F.slice(w, F.lit(1), size),
            F.slice(w, F.lit(2), size),
            F.slice(w, F.lit(3), size),
            F.sequence(F.lit(0), size - 1),
        ),
        F.lit(1),
        size - 2,
    )

    def same(x: Column, y: Column) -> Column:
        return F.coalesce((x["0"] == y["0"]) & (x["1"] == y["1"]) & (x["2"] == y["2"]), F.lit(False))

    def covered(ordered: Column) -> Column:
        repeated = F.filter(
            ordered,
            lambda x, i: same(x, F.get(ordered, i - 1)) | same(x, F.get(ordered, i + 1)),
        )
        starts = F.sort_array(F.transform(repeated, lambda x: x["3"]))
        return F.aggregate(
            starts,
            F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
            lambda acc, p: F.struct(
                (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last")
            ),
            lambda acc: acc["n"],
        )

    return F.when(size < 4, F.lit(0)).otherwise(let(F.sort_array(windows), covered)).cast("long")


def text_stats(text: Column) -> Column:
    """Struct of counts over the whole text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    by_word = let(
        words(text),
        lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("repeated")),
    )
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(NOT_SPACE))
    by_line = let(
        lines,
        lambda rows: F.struct(
            F.size(rows).cast("long").alias("n"),
            (F.size(rows) - F.size(F.array_distinct(rows))).cast("long").alias("dup"),
        ),
    )
    n_chars = F.length(F.translate(text, " \t\n\x0b\x0c\r", ""))
    n_symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    return F.struct(
        by_word.alias("word"),
        by_line.alias("line"),
        n_chars.cast("long").alias("chars"),
        n_symbols.cast("long").alias("symbols"),
    )


def measure(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``row`` (all columns, or ``carry``), ``doc_id``, ``stratum``, counts and ``base_failed``."""
    rows = pack(
        docs,
        carry,
        doc_id=F.col("doc_id"),
        stratum=F.coalesce(F.col("lang"), F.lit("")),
        text_key=F.xxhash64(F.coalesce(F.col("text"), F.lit(""))),
        s=text_stats(F.col("text")),
    )
    return rows.select(
        "row",
        "doc_id",
        "stratum",
        "text_key",
        F.col("s.word.n").alias("n_words"),
        F.col("s.chars").alias("word_chars"),
        F.col("s.symbols").alias("n_symbols"),
        F.col("s.line.n").alias("n_lines"),
        F.col("s.line.dup").alias("n_dup_lines"),
        F.col("s.word.repeated").alias("n_repeat_words"),
        (
            (F.col("s.word.n") < 50) | (100 * F.col("s.word.repeated") > 50 * F.col("s.word.n"))
        ).alias("base_failed"),
    )


def _scores() -> dict[str, Column]:
    n_words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbols_per_word": F.col("n_symbols") / n_words,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_word_share": F.col("n_repeat_words") / n_words,
        "chars_per_word": F.col("word_chars") / n_words,
    }


def _log_factorial(x: Column) -> Column:
    """Stirling's series, shifted by ten so that it is exact to double precision from 0 on."""
    z = x + 11.0
    series = (
        (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z * z * z)
        + 1 / (1260 * z * z * z * z * z)
    )
    shift = sum((F.log(x + float(i)) for i in range(2, 11)), F.log(x + 1.0))
    return series - shift


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), exactly, for k up to n * p; 1 above that, where no test can pass.

    Terms fall from k downwards; those 12 standard deviations below cannot change the sum.
    """
    k, n = k.cast("double"), n.cast("double")
    top = F.exp(
        _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)
        + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    )
    steps = F.least(k, F.ceil(12 * F.sqrt(n * p * (1 - p))) + 50).cast("long")
    odds = (1 - p) / p
    falling = F.aggregate(
        F.sequence(F.lit(0).cast("long"), steps),
        F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("term")),
        lambda acc, j: F.struct(
            (acc["sum"] + acc["term"]).alias("sum"),
            (acc["term"] * (k - j) / (n - k + j + 1) * odds).alias("term"),
        ),
        lambda acc: acc["sum"],
    )
    return F.when((n > 0) & (k <= n * p), top * falling).otherwise(F.lit(1.0))


def certified_cutoffs(
    measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA
) -> DataFrame:
    """One row per stratum with the strictest certified cutoff of each rule (null: none).

    Trials are the good texts: those of labelled rows with ``quality`` 1 that pass the base rule, each
    text of a stratum once, however many rows or documents bear it, since copies are no independent
    evidence. A text with several labels counts as good if any of them says so, which only protects
    more.
    """
    truth = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    good = (
        measured.where(~F.col("base_failed"))
        .select("doc_id", "stratum", "text_key", *[v.alias(k) for k, v in _scores().items()])
        .join(truth.where(F.col("quality") == 1).select("doc_id"), "doc_id")
        .dropDuplicates(["stratum", "text_key"])  # the scores follow from the text
    )
    steps = [(rule, i, cut) for rule, cuts in LADDERS.items() for i, cut in enumerate(cuts)]
    counts = good.groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum((F.col(r) >= c).cast("long")).alias(f"k{j}") for j, (r, _, c) in enumerate(steps)],
    )
    counts = materialize(counts, "holdout-counts")
    n_strata = max(counts.count(), 1)
    tested = counts.select(
        "stratum",
        "n",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(r).alias("rule"),
                        F.lit(i).alias("step"),
                        F.lit(c).alias("cutoff"),
                        F.col(f"k{j}").alias("k"),
                    )
                    for j, (r, i, c) in enumerate(steps)
                ]
            )
        ),
    )
    level = delta / (n_strata * len(LADDERS))
    passed = binomial_tail(F.col("k"), F.col("n"), alpha / len(LADDERS)) <= level
    so_far = Window.partitionBy("stratum", "rule").orderBy("step")
    chosen = tested.withColumn("ok", F.min(passed.cast("int")).over(so_far)).where("ok = 1")
    return chosen.groupBy("stratum").agg(
        *[F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in LADDERS]
    )


def judge(
    docs: DataFrame,
    labels: DataFrame,
    carry: list[str] | None = None,
    alpha: float = ALPHA,
    delta: float = DELTA,
) -> DataFrame:
    """``measure`` plus ``kept``, one row per row of ``docs``.

    Nulls: text counts as empty (fails the base rule), language is a stratum of its own, a null
    doc_id has no label. Repeated rows are judged alike. Empty tables give empty results, and
    without labels only the base rule decides.
    """
    measured = materialize(measure(docs, carry), "quality-measured")
    cutoffs = materialize(certified_cutoffs(measured, labels, alpha, delta), "quality-cutoffs")
    rejected = F.lit(False)
    for rule, score in _scores().items():
        rejected = rejected | F.coalesce(score >= F.col(f"cut_{rule}"), F.lit(False))
    judged = measured.join(cutoffs, "stratum", "left")
    return judged.withColumn("kept", ~F.col("base_failed") & ~rejected)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns."""
    return judge(docs, labels).where("kept").select("row.*")
