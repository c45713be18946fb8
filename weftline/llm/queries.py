"""Registered queries of the training-data operators, and their SQL for DuckDB where it exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import (
    classifier,
    decontaminate,
    fill_middle,
    hard_negatives,
    jaccard_join,
    mixing,
    near_duplicates,
    quality_rules,
    secret_scan,
    token_counts,
    token_store,
    toxicity,
    url_filter,
)
from weftline.llm.common import table
from weftline.scratch import new_folder

BASE_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), carry=["doc_id"]
    )
    return judged.select("row.doc_id", *BASE_COUNTS, "base_failed", "kept")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return mixed.select("row.doc_id", "epoch")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = near_duplicates.classify(table(spark, sf_dir, "documents"), carry=["doc_id"])
    kept = F.col("root").isNull() | F.col("doc_id").eqNullSafe(F.col("class_id"))
    return classes.select("doc_id", "class_id", "class_size", kept.alias("kept"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"), carry=["doc_id"])
    base = len(secret_scan.BASE_RULES)

    def count(rule: secret_scan.Rule):
        mine = F.filter("spans", lambda s: s["kind"] == rule.kind)
        return F.size(mine).cast("long").alias(f"n_{rule.kind}")

    own = F.filter("spans", lambda s: s["rank"] < base)
    return found.select(
        "row.doc_id",
        *[count(rule) for rule in secret_scan.BASE_RULES],
        F.sha2(secret_scan.span_list(own), 256).alias("base_sha256"),
        secret_scan.span_list(F.col("spans")).alias("spans"),
    )


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(table(spark, sf_dir, "pages"), carry=["page_id"])
    return judged.select("row.page_id", "host", "path", "rule", "verdict")


def op5_url_filter_spam_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op5_url_filter`` with a block list of all marked hosts of the pages; the rules still win."""
    pages = table(spark, sf_dir, "pages")
    entries = url_filter.default_entries(spark).unionByName(url_filter.spam_hosts(pages))
    judged = url_filter.judge(pages, entries, carry=["page_id"])
    return judged.select("row.page_id", "host", "path", "rule", "verdict")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = classifier.score(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return scored.select("row.doc_id", "score", "kept")


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "token-store")
    docs = table(spark, sf_dir, "documents")
    return token_store.digests(spark, docs, folder, tokenizer_path())


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontaminate.judge(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry=["doc_id"]
    )
    listed = F.array_join(F.col("item_ids").cast("array<string>"), ",")
    return judged.select("row.doc_id", "contaminated", "n_items", listed.alias("item_ids"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.attribute(
        table(spark, sf_dir, "documents"), tokenizer_path(), carry=["doc_id"]
    )
    return counted.select(
        "row.doc_id",
        "n_tokens",
        F.size("section_tokens").cast("long").alias("n_sections"),
        "n_crossing",
        F.array_join(F.col("section_tokens").cast("array<string>"), ",").alias("section_tokens"),
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), carry=["doc_id"]
    )
    return scored.select("row.doc_id", "held_out", "score", "predicted")


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = jaccard_join.join(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return joined.select("doc_id", "n_shingles", "component_id")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hard_negatives.usable(table(spark, sf_dir, "embeddings"))
    seventh = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", seventh), F.col("vec_id") % 100 == 0)


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_middle.transform(table(spark, sf_dir, "documents"), carry=["doc_id"])
    whole = fill_middle.restored(F.col("output"), F.col("form"))
    return cut.select(
        "row.doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(whole, 256).alias("restored_sha256"),
    )


def _ladder_sql() -> str:
    score = {
        "symbols_per_word": "n_symbols / greatest(n_words, 1)",
        "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
        "repeat_word_share": "n_repeat_words / greatest(n_words, 1)",
        "chars_per_word": "word_chars / greatest(n_words, 1)",
    }
    return " UNION ALL ".join(
        f"SELECT doc_id, stratum, rid, '{rule}' AS rule, {i} AS step, {cut}::DOUBLE AS cutoff, "
        f"(CAST({score[rule]} AS DOUBLE) >= {cut})::BIGINT AS bad FROM measured"
        for rule, cuts in quality_rules.LADDERS.items()
        for i, cut in enumerate(cuts)
    )


#: Common tables of the quality rules; {source} is the relation judged.
QUALITY_CTES = r"""
words AS (
  SELECT rid, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM numbered),
windows AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
repeated AS (
  SELECT rid, i FROM windows JOIN (
    SELECT rid, k FROM windows GROUP BY ALL HAVING count(*) > 1) USING (rid, k)),
covered AS (
  SELECT rid, count(DISTINCT p) AS n FROM (
    SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM repeated) GROUP BY rid),
measured AS (
  SELECT n.*, len(w) AS n_words,
         len(t) - len(regexp_replace(t, '[^\x20\x09-\x0D]', '', 'g')) AS word_chars,
         len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(c.n, 0) AS n_repeat_words,
         len(w) < 50 OR 100 * coalesce(c.n, 0) > 50 * len(w) AS base_failed
  FROM numbered n JOIN words USING (rid) LEFT JOIN covered c USING (rid)),
ladder AS ({ladder}),
good AS (SELECT min(rid) AS rid FROM measured JOIN labels USING (doc_id)
         WHERE NOT base_failed GROUP BY stratum, t HAVING max(quality) = 1),
counts AS (
  SELECT stratum, rule, step, cutoff, count(*) AS n, sum(bad) AS k
  FROM ladder WHERE rid IN (SELECT rid FROM good) GROUP BY ALL),
tested AS (
  SELECT *, k <= n * {risk} AND list_sum(list_transform(range(0, k::BIGINT + 1), lambda i:
           exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)
               + i * ln({risk}) + (n - i) * ln(1 - {risk}))))
         <= {delta} / ((SELECT count(DISTINCT stratum) FROM counts) * {rules}) AS passed
  FROM counts),
cutoffs AS (
  SELECT stratum, rule, min(cutoff) AS cutoff FROM (
    SELECT *, bool_and(passed) OVER (PARTITION BY stratum, rule ORDER BY step) AS ok FROM tested)
  WHERE ok GROUP BY ALL),
rejected AS (
  SELECT DISTINCT rid FROM ladder JOIN cutoffs USING (stratum, rule, cutoff) WHERE bad = 1),
judged AS (
  SELECT *, NOT base_failed AND rid NOT IN (SELECT rid FROM rejected) AS kept FROM measured)
""".format(
    ladder=_ladder_sql(),
    risk=quality_rules.ALPHA / len(quality_rules.LADDERS),
    delta=quality_rules.DELTA,
    rules=len(quality_rules.LADDERS),
)

NUMBERED = """numbered AS (
  SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t,
         row_number() OVER () AS rid FROM documents)"""


def _mixing_sql() -> str:
    def weight(column: str, named: dict[str, int]) -> str:
        cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in named.items())
        return f"CASE {column} {cases} ELSE 1 END"

    named = [mixing.DOMAIN_WEIGHTS, mixing.LANGUAGE_WEIGHTS, mixing.SOURCE_WEIGHTS]
    steps, before = [], "(SELECT sum(tokens) * {} // {} AS budget FROM slim)".format(*mixing.KEEP)
    for depth, (level, weights) in enumerate(zip(mixing.LEVELS, named, strict=True)):
        path, parent = mixing.LEVELS[: depth + 1], mixing.LEVELS[:depth]
        family = f"PARTITION BY {', '.join(parent)}" if parent else ""
        joined = f"JOIN {before} USING ({', '.join(parent)})" if parent else f", {before}"
        steps.append(f"""
n{depth} AS (
  SELECT *, {weight(level, weights)}::HUGEINT AS weight FROM (
    SELECT {', '.join(path)}, sum(tokens)::HUGEINT * {mixing.EPOCHS} AS lim FROM slim GROUP BY ALL)
  {joined}),
r{depth} AS (
  SELECT *, budget - (sum(lim) OVER w - lim) AS rest,
         sum(weight) OVER ({family}) - (sum(weight) OVER w - weight) AS weights,
         row_number() OVER w AS rank
  FROM n{depth} WINDOW w AS ({family} ORDER BY lim::DOUBLE / weight, {level}
                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
f{depth} AS (
  SELECT {', '.join(parent) + ', ' if parent else ''}min(rank) AS short
  FROM r{depth} WHERE lim * weights > rest * weight {'GROUP BY ALL' if parent else ''}),
g{depth} AS (
  SELECT {', '.join('r.' + p for p in path)},
         CASE WHEN f.short IS NULL OR r.rank < f.short THEN r.lim
              ELSE least(r.lim, greatest(s.rest, 0) * r.weight // s.weights) END AS budget
  FROM r{depth} r LEFT JOIN f{depth} f ON {' AND '.join(f'f.{p} = r.{p}' for p in parent) or 'true'}
  LEFT JOIN r{depth} s ON s.rank = f.short {''.join(f' AND s.{p} = r.{p}' for p in parent)})""")
        before = f"g{depth}"
    return f"""WITH slim AS (
  SELECT doc_id, coalesce(lang, '') AS language, coalesce(source, '') AS source,
         CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) = '' THEN 'none'
              ELSE 'd' || (regexp_extract(source, '([0-9]{{1,9}})$', 1)::BIGINT % 3) END AS domain,
         len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'),
                         lambda w: w <> '')) AS tokens
  FROM documents),
{','.join(steps).lstrip()},
leaves AS (SELECT domain, language, source, sum(tokens) AS total FROM slim GROUP BY ALL),
plan AS (SELECT *, budget // greatest(total, 1) AS whole,
                budget - budget // greatest(total, 1) * total AS rest
         FROM leaves JOIN g2 USING (domain, language, source)),
ordered AS (
  SELECT s.*, whole, rest, sum(tokens) OVER (
    PARTITION BY domain, language, source
    ORDER BY md5('{mixing.SEED}:' || whole || ':' || coalesce(doc_id::VARCHAR, ''))
    RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM slim s JOIN plan USING (domain, language, source))
SELECT doc_id, unnest(range(1, whole::BIGINT + (upto <= rest AND rest > 0)::BIGINT + 1)) AS epoch
FROM ordered"""


def _secret_sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    found = " UNION ALL ".join(
        f"""
SELECT rid, {i} AS rank, '{rule.kind}' AS kind, {rule.least} AS least,
       list_transform(string_split_regex(t, {quoted(rule.pattern)}), lambda x: len(x)) AS gaps,
       list_transform(regexp_extract_all(t, {quoted(rule.pattern)}), lambda x: len(x)) AS sizes,
       list_transform(regexp_extract_all(t, {quoted(rule.pattern)}, {rule.group}),
                      lambda x: len(x)) AS checked
FROM numbered WHERE regexp_matches(t, {quoted(rule.pattern)})"""
        for i, rule in enumerate(secret_scan.ALL_RULES)
    )
    base = len(secret_scan.BASE_RULES)
    joined = "string_agg(kind || ':' || (upto - size) || ':' || upto, ',' ORDER BY upto - size, rank)"
    return f"""WITH numbered AS (
  SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents),
found AS ({found}),
each AS (SELECT rid, rank, kind, least, unnest(range(1, len(sizes) + 1)) AS i, gaps, sizes, checked
         FROM found),
spans AS (
  SELECT rid, rank, kind, sizes[i] AS size, checked[i] >= least AS fits,
         sum(gaps[i] + sizes[i]) OVER (PARTITION BY rid, rank ORDER BY i)::BIGINT AS upto
  FROM each),
lists AS (
  SELECT rid, {joined} AS spans, coalesce({joined} FILTER (rank < {base}), '') AS base_spans,
         count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access,
         count(*) FILTER (rank = 2) AS n_hex
  FROM spans WHERE fits GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
       coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base_spans, '')) AS base_sha256,
       coalesce(spans, '') AS spans
FROM numbered LEFT JOIN lists USING (rid)"""


def _url_sql() -> str:
    entries = [(e, v, True) for e, v in url_filter.RULES]
    entries += [(e, "block", False) for e in url_filter.BLOCKED]
    values = ", ".join(f"('{e}', '{v}', {str(r).upper()})" for e, v, r in entries)
    return f"""WITH entries(entry, verdict, is_rule) AS (VALUES {values}),
cut AS (
  SELECT page_id, row_number() OVER () AS rid,
         CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
parts AS (
  SELECT page_id, rid, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path
  FROM cut),
fitting AS (
  SELECT rid, entry, verdict, is_rule, row_number() OVER (
    PARTITION BY rid ORDER BY is_rule DESC, length(entry) DESC) AS place
  FROM parts JOIN entries
    ON ends_with('.' || host, '.' || split_part(entry, '/', 1))
   AND starts_with(path, substr(entry, strpos(entry, '/'))))
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path,
       CASE WHEN is_rule THEN entry END AS rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT * FROM fitting WHERE place = 1) USING (rid)"""


def _spam_host_sql() -> str:
    """Each host is judged by its own labels; no list is made."""
    return f"""WITH fixed AS ({_url_sql()})
SELECT page_id, host, path, rule,
       CASE WHEN rule IS NULL AND len(list_filter(string_split(host, '.')[:-2],
                 lambda l: regexp_matches(l, '{url_filter.SPAM_LABEL}'))) > 0
            THEN 'block' ELSE verdict END AS verdict
FROM fixed"""


def _leak_sql() -> str:
    def side(relation: str, key: str) -> str:
        masked = " UNION ALL ".join(
            f"SELECT {key}, p, {k} AS mask, [" + ", ".join(f"w[p + {i}]" for i, b in enumerate(m) if b == "1")
            + f"] AS seed FROM (SELECT {key}, w, unnest(range(1, len(w) - {len(m)} + 2)) AS p FROM {relation})"
            for k, m in enumerate(decontaminate.MASKS)
        )
        return masked

    split = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
    size = f"least(len(i.w), {decontaminate.WINDOW})"
    equal = "list_transform(range(lo, hi), lambda j: coalesce(j + shift >= 1 AND d.w[j + shift] = i.w[j], false)::INT)"
    return f"""WITH d AS (SELECT doc_id, row_number() OVER () AS rid, {split} AS w FROM documents),
i AS (SELECT item_id, row_number() OVER () AS item, {split} AS w FROM benchmark),
known AS ({side('i', 'item')}),
asked AS ({side('d', 'rid')}),
hits AS (SELECT DISTINCT rid, item, a.p - k.p AS shift, k.p AS p
         FROM asked a JOIN known k USING (mask, seed)),
laid AS (
  SELECT rid, item, item_id, size, {equal} AS e
  FROM (SELECT *, greatest(p - {size} + 1, 1) AS lo, least(p + {size}, len(i.w) + 1) AS hi,
               {size} AS size FROM hits JOIN i USING (item)) AS i JOIN d USING (rid)),
leaks AS (
  SELECT DISTINCT rid, item, item_id FROM laid
  WHERE list_max(list_transform(range(1, greatest(len(e) - size + 1, 1) + 1),
                 lambda s: list_sum(e[s:s + size - 1]))) >= size * {decontaminate.TOLERANCE}),
short AS (
  SELECT rid, item, item_id FROM d JOIN i ON len(i.w) BETWEEN 1 AND {decontaminate.SHORTEST - 1}
   AND list_contains(list_transform(range(1, len(d.w) - len(i.w) + 2),
                                    lambda p: d.w[p:p + len(i.w) - 1]), i.w)),
found AS (SELECT rid, count(*) AS n_items,
                 array_to_string(list_sort(list(DISTINCT item_id)), ',') AS item_ids
          FROM (SELECT * FROM leaks UNION SELECT * FROM short) GROUP BY rid)
SELECT doc_id, n_items IS NOT NULL AS contaminated, coalesce(n_items, 0) AS n_items,
       coalesce(item_ids, '') AS item_ids
FROM d LEFT JOIN found USING (rid)"""


def _jaccard_sql() -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""WITH RECURSIVE texts AS (
  SELECT doc_id, row_number() OVER () AS rid,
         regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'),
                            '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, rid, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {jaccard_join.SHINGLE} THEN [w]
    ELSE list_distinct(list_transform(range(1, len(w) - {jaccard_join.SHINGLE} + 2),
                                      lambda i: w[i:i + {jaccard_join.SHINGLE - 1}])) END AS s
  FROM texts),
nodes AS (SELECT list_sort(s) AS s, len(s) AS n, min(rid) AS node FROM sets WHERE len(s) > 0
          GROUP BY ALL),
grams AS (SELECT node, n, unnest(s) AS gram FROM nodes),
pairs AS (
  SELECT a.node AS a, b.node AS b FROM grams a JOIN grams b
    ON a.gram = b.gram AND a.node < b.node
   AND 100 * least(a.n, b.n) >= {jaccard_join.PERCENT} * greatest(a.n, b.n)
  GROUP BY a.node, b.node, a.n, b.n
  HAVING 100 * count(*) >= {jaccard_join.PERCENT} * (a.n + b.n - count(*))),
edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reached(node, other) AS (
  SELECT node, node FROM nodes
  UNION SELECT r.node, e.b FROM reached r JOIN edges e ON e.a = r.other),
of_rows AS (SELECT rid, doc_id, s, node FROM sets JOIN (SELECT s AS t, node FROM nodes) x
              ON list_sort(sets.s) = x.t),
lowest AS (SELECT r.node, min(o.doc_id) AS component_id
           FROM reached r JOIN of_rows o ON o.node = r.other GROUP BY r.node)
SELECT s.doc_id, len(s.s) AS n_shingles,
       CASE WHEN o.node IS NULL THEN s.doc_id ELSE l.component_id END AS component_id
FROM sets s LEFT JOIN of_rows o USING (rid) LEFT JOIN lowest l ON l.node = o.node"""


def _hard_negative_sql() -> str:
    return """WITH vectors AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
         list_inner_product(a.v, r.v)::BIGINT AS score
  FROM vectors a JOIN vectors r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
ranked AS (
  SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
         row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
  FROM positives JOIN scored USING (anchor_id)
  WHERE NOT same AND 100 * score BETWEEN 30 * positive_score AND 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score
FROM ranked WHERE rank <= 10"""


def _fill_middle_sql() -> str:
    numbers = ", ".join(
        f"('0x' || substr(h, {8 * i + 1}, 8))::BIGINT AS h{i + 1}" for i in range(4)
    )
    marks = [fill_middle.PREFIX, fill_middle.SUFFIX, fill_middle.MIDDLE]
    holds = " OR ".join(f"contains(t, '{mark}')" for mark in marks)
    p, s, m = marks
    return f"""WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
         sha256('{fill_middle.SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
drawn AS (SELECT doc_id, t, u, len(u) AS n, {numbers} FROM texts),
cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR {holds} OR h3 % 100 >= {fill_middle.CUT_SHARE} THEN 'plain'
              WHEN h4 % 100 < {fill_middle.SUFFIX_FIRST_SHARE} THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
parts AS (
  SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle,
         array_to_string(u[b + 1:n], '') AS suffix FROM cut)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t
                   WHEN 'psm' THEN '{p}' || prefix || '{s}' || suffix || '{m}' || middle
                   ELSE '{s}' || suffix || '{p}' || prefix || '{m}' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts"""


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_mixing": op2_mixing,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_secret_scan": op4_secret_scan,
    "op5_url_filter": op5_url_filter,
    "op5_url_filter_spam_hosts": op5_url_filter_spam_hosts,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_token_store": op7_token_store,
    "op8_decontamination": op8_decontamination,
    "op9_token_counts": op9_token_counts,
    "op10_toxicity": op10_toxicity,
    "op11_jaccard_join": op11_jaccard_join,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_fill_middle": op13_fill_middle,
}

ORACLE_SQL = {
    "op1_quality_rules": f"""WITH {NUMBERED}, {QUALITY_CTES}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept
FROM judged""",
    "op2_mixing": _mixing_sql(),
    "op4_secret_scan": _secret_sql(),
    "op5_url_filter": _url_sql(),
    "op5_url_filter_spam_hosts": _spam_host_sql(),
    "op8_decontamination": _leak_sql(),
    "op11_jaccard_join": _jaccard_sql(),
    "op12_hard_negatives": _hard_negative_sql(),
    "op13_fill_middle": _fill_middle_sql(),
}
