"""Secret scans over a trigram inverted index.

From each rule's regular expression a Boolean trigram query is derived: a list of parts that must
all hold, each a choice of trigram sets. Postings (trigram, text) are kept for the trigrams that
any query names; joined with the queries and counted they give each rule's candidates, and only
those are searched with the expression. A rule without mandatory trigrams is searched everywhere.
Index and queries are in lower case, which can only add candidates.

Spans are code points, end exclusive: leftmost matches that do not overlap, per kind; a match whose
checked group is too short is dropped, after it has used up its text. Built-in expressions only.
"""

from __future__ import annotations

import re._constants as op
import re._parser as parser
from dataclasses import dataclass
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm.common import materialize, pack


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: ASCII letters in either case, spelled out: engines differ in what (?i) folds beyond ASCII.
_NAMES = "|".join(
    "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in name)
    for name in ("password", "passwd", "secret", "token", "api_?key")
)

BASE_RULES = [
    Rule("assign", f"({_NAMES})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    # whole runs are matched, so a minimum length inside the pattern drops the same matches
    Rule("access", "AKIA[A-Z0-9]{16,}"),
    Rule("hex", "[0-9a-f]{24,}"),
]

#: Further kinds of credentials, by their documented prefixes.
MORE_RULES = [
    Rule("github", "gh[pousr]_[A-Za-z0-9]{20,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{30,}"),
    Rule("stripe", "[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{8,}[.]eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}"),
    Rule("private_key", "-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("url_password", "://[A-Za-z0-9._-]{1,64}:[A-Za-z0-9._%+-]{6,64}@"),
]

#: All kinds, before what is added below.
RULES = BASE_RULES + MORE_RULES

_URL_PASSWORD = Rule("url_password", "://[A-Za-z0-9._-]{1,}:[A-Za-z0-9._%+-]{6,}@")

#: What is scanned by default: user and password of any length, and tokens by a longer prefix.
ALL_RULES = [
    *[_URL_PASSWORD if rule.kind == "url_password" else rule for rule in RULES],
    Rule("github_pat", "github_pat_[A-Za-z0-9_]{20,}"),
]

#: Exact strings followed at once while a query is derived.
MAX_STRINGS = 64

Part = frozenset[frozenset[str]]


def _required(strings: set[str]) -> list[Part]:
    """One of ``strings`` must occur: as a choice of trigram sets, or nothing if one is short."""
    if any(len(s) < 3 for s in strings):
        return []
    sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    return [frozenset(s for s in sets if not any(other < s for other in sets))]


def _class(items: list) -> set[str] | None:
    chars: set[str] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            chars.add(chr(value).lower())
        elif kind is op.RANGE and value[1] - value[0] < 8:
            chars.update(chr(c).lower() for c in range(value[0], value[1] + 1))
        else:
            return None
    return chars if len(chars) <= 8 else None


def _sequence(nodes) -> tuple[set[str] | None, list[Part]]:
    """The exact strings of a sequence (None: not a short list) and what it requires."""
    current, parts, exact = {""}, [], True

    def cut() -> None:
        nonlocal current, exact
        parts.extend(_required(current))
        current, exact = {""}, False

    def follow(strings: set[str]) -> None:
        nonlocal current
        if len(current) * len(strings) > MAX_STRINGS:
            cut()
        current = {a + b for a, b in product(current, strings)}

    for kind, value in nodes:
        if kind is op.LITERAL:
            follow({chr(value).lower()})
        elif kind is op.IN and (chars := _class(value)) is not None:
            follow(chars)
        elif kind is op.SUBPATTERN or kind is op.BRANCH:
            arms = [value[-1]] if kind is op.SUBPATTERN else value[1]
            found = [_sequence(arm) for arm in arms]
            strings = [s for s, _ in found]
            if all(s is not None for s in strings) and sum(map(len, strings)) <= MAX_STRINGS:
                follow(set().union(*strings))
            else:
                cut()
                if len(found) == 1:
                    parts.extend(found[0][1])
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            least, most, body = value
            strings, inner = _sequence(body)
            if strings is not None and (least, most) == (0, 1):
                follow(strings | {""})
            else:
                for _ in range(min(least, 3) if strings is not None else 0):
                    follow(strings)
                cut()
                if least and strings is None:
                    parts.extend(inner)
        elif kind is not op.AT:
            cut()
    return (current, parts) if exact else (None, parts + _required(current))


def trigram_query(pattern: str) -> list[Part]:
    """Parts that a lower-cased text must all satisfy to match; empty if nothing is mandatory."""
    strings, parts = _sequence(parser.parse(pattern))
    return parts if strings is None else parts + _required(strings)


def candidates(texts: DataFrame, rules: list[Rule]) -> DataFrame:
    """(doc_id, text_hash, rules): the numbers of the indexed rules that each text may match."""
    queries = {i: trigram_query(rule.pattern) for i, rule in enumerate(rules)}
    wanted = [
        (i, p, c, trigram, len(clause), len(parts))
        for i, parts in queries.items()
        for p, part in enumerate(parts)
        for c, clause in enumerate(sorted(part, key=sorted))
        for trigram in sorted(clause)
    ]
    names = "rule int, part int, clause int, trigram string, n_trigrams int, n_parts int"
    wanted_rows = texts.sparkSession.createDataFrame(wanted, names)
    vocabulary = F.array(*[F.lit(t) for t in sorted({w[3] for w in wanted})])
    low = F.lower("text")
    postings = texts.select("doc_id", "text_hash", low.alias("low")).select(
        "doc_id",
        "text_hash",
        F.explode(F.filter(vocabulary, lambda t: F.col("low").contains(t))).alias("trigram"),
    )
    postings = materialize(postings.distinct(), "secret-postings")
    text = ["doc_id", "text_hash"]
    # the rules are few and fixed, so their side is small whatever the input
    met = postings.join(F.broadcast(wanted_rows), "trigram").groupBy(
        *text, "rule", "part", "clause", "n_trigrams", "n_parts"
    ).count()
    clauses = met.where("count = n_trigrams").groupBy(*text, "rule", "n_parts").agg(
        F.count_distinct("part").alias("parts")
    )
    return clauses.where("parts = n_parts").groupBy(*text).agg(F.collect_set("rule").alias("rules"))


def scan(
    docs: DataFrame, rules: list[Rule] = ALL_RULES, carry: list[str] | None = None
) -> DataFrame:
    """``row`` (all columns, or ``carry``) and ``spans``: array of (start, rank, kind, end), sorted.

    One row per row of ``docs``; rank is the rule's place in ``rules``. Null texts are empty and
    have no spans. Repeated rows give repeated results, an empty table an empty one.
    """
    texts = docs.select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("text_hash")
    )
    found = materialize(candidates(texts, rules), "secret-candidates").withColumnsRenamed(
        {"doc_id": "at_id", "text_hash": "at_hash"}
    )
    rows = pack(
        docs,
        carry,
        doc_id=F.col("doc_id"),
        text=F.coalesce("text", F.lit("")),
        text_hash=F.xxhash64("text"),
    )
    same = F.col("doc_id").eqNullSafe(F.col("at_id")) & (F.col("text_hash") == F.col("at_hash"))
    rows = rows.join(found, same, "left")

    def lengths(rule: Rule):
        """Per match: length of the text before it, of itself and of the group to check."""
        pattern = F.lit(rule.pattern)
        size = lambda a: F.transform(a, lambda x: F.length(x))
        return F.arrays_zip(
            size(F.split("text", rule.pattern, -1)).alias("gap"),
            size(F.regexp_extract_all("text", pattern, F.lit(0))).alias("size"),
            size(F.regexp_extract_all("text", pattern, F.lit(rule.group))).alias("checked"),
        ).cast("array<struct<gap:int,size:int,checked:int>>")

    matched = [
        F.when(
            F.array_contains("rules", i) if trigram_query(rule.pattern) else F.col("text").rlike(rule.pattern),
            F.struct(F.lit(i).alias("rank"), F.lit(rule.kind).alias("kind"), lengths(rule).alias("m")),
        )
        for i, rule in enumerate(rules)
    ]
    some = rows.select(
        "row", F.monotonically_increasing_id().alias("rid"), F.array_compact(F.array(*matched)).alias("found")
    )
    some = materialize(some, "secret-matches")
    each = (
        some.where(F.size("found") > 0)
        .select("rid", F.inline("found"))
        .select("rid", "rank", "kind", F.posexplode("m").alias("pos", "m"))
        .where("m.size IS NOT NULL")
    )
    along = Window.partitionBy("rid", "rank").orderBy("pos")
    least = F.lit(1)
    for i, rule in enumerate(rules):
        least = F.when(F.col("rank") == i, rule.least).otherwise(least)
    spans = (
        each.withColumn("end", F.sum(F.expr("m.gap + m.size")).over(along))
        .where(F.col("m.checked") >= least)
        .groupBy("rid")
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        (F.col("end") - F.col("m.size")).alias("start"), "rank", "kind", "end"
                    )
                )
            ).alias("spans")
        )
    )
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
    return some.select("row", "rid").join(spans, "rid", "left").select(
        "row", F.coalesce("spans", none).alias("spans")
    )


def span_list(spans):
    """``kind:start:end`` joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
