"""URL filters: a sorted array of digests, memory-mapped, searched by halves and confirmed.

An entry is a host and the beginning of a path, such as ``example.com/en/``; it fits the host and
all its subdomains where the url's path begins so. A url's candidates are its host suffixes, each
with those beginnings of its path that have the length of some entry's path. Their 64-bit xxhash
digests are looked up by binary search, a batch at a time, and a hit counts only if the stored
string equals the candidate. The longest fitting entry decides.

Spark sorts the entries and writes them to the shared folder; its file distribution brings the
index to each machine, where all Python workers map one copy. The size is checked: beyond
``MAX_BYTES`` the same candidates are joined with the entries by digest and string instead.
"""

from __future__ import annotations

import os
import string
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import materialize, pack, ship_package

#: Fixed rules: host and path, verdict.
RULES = [
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
]
#: Hosts blocked where no rule fits.
BLOCKED = ["spam-farm.example.org/"]

#: Marks of spam hosts, by the usual categories of block lists. A mark is a whole word of a label.
SPAM_WORDS = [
    *("adult", "sex", "xxx", "escort", "escorts", "webcams"),
    *("bet", "bets", "betting", "gambling", "poker", "slots", "lottery", "jackpot"),
    *("pills", "pharma", "pharmacy", "cialis", "steroids"),
    *("ads", "adserver", "popunder", "track", "tracker"),
    *("spam", "spammer", "phishing", "malware", "warez"),
]
#: Marks also inside of a word: they are part of no usual one.
SPAM_STEMS = ["casino", "porn", "viagra"]
SPAM_LABEL = f"(^|[^a-z0-9])({'|'.join(SPAM_WORDS)})([^a-z0-9]|$)|{'|'.join(SPAM_STEMS)}"

MAX_BYTES = 1 << 30
ENTRIES = "entry string, verdict string, is_rule boolean"


def default_entries(spark: SparkSession) -> DataFrame:
    listed = [(e, v, True) for e, v in RULES] + [(e, "block", False) for e in BLOCKED]
    return spark.createDataFrame(listed, ENTRIES)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z) and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    pick = lambda group: F.regexp_extract(F.coalesce(rest, F.lit("")), r"^([^/?#]*)([^?#]*)", group)
    return F.translate(pick(1), string.ascii_uppercase, string.ascii_lowercase), pick(2)


def spam_hosts(pages: DataFrame) -> DataFrame:
    """Block entries for the spam hosts among all ``pages``: one per marked name, distinct.

    An entry begins at the last marked label, so it fits all hosts below, whatever the path. The
    top-level label is never one: ``x.casino`` must not block all that ends in ``.casino``.
    """
    labels = F.split(host_and_path(F.col("url"))[0], "[.]", -1)
    marked = F.transform(
        labels, lambda label, i: F.when(label.rlike(SPAM_LABEL) & (i < F.size(labels) - 1), i + 1)
    )
    last = F.array_max(marked)
    entry = F.array_join(F.slice(labels, last, F.size(labels)), ".")
    found = pages.select(F.when(last.isNotNull(), entry).alias("entry")).where("entry IS NOT NULL")
    return found.distinct().select("entry", F.lit("block").alias("verdict"), F.lit(False).alias("is_rule"))


def candidates(host: Column, path: Column, path_lengths: list[int]) -> Column:
    labels = F.split(host, "[.]", -1)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    heads = F.array_compact(
        F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in path_lengths])
    )
    both = F.transform(suffixes, lambda s: F.transform(heads, lambda h: F.concat(s, h)))
    return F.flatten(both)


def clean_entries(entries: DataFrame) -> DataFrame:
    """One row per entry: rules win over listed hosts, then block over allow; null is no entry."""
    known = entries.where("entry IS NOT NULL").groupBy("entry").agg(
        F.max(F.struct("is_rule", "verdict")).alias("best")  # "block" > "allow"
    )
    return known.select("entry", "best.*", F.xxhash64("entry").alias("digest"))


class MappedIndex:
    """The index as Arrow arrays over one mapped file; made once per machine."""

    _open: dict[str, MappedIndex] = {}

    def __init__(self, name: str):
        source = SparkFiles.get(name)
        mapped = source + ".arrow"
        if not os.path.exists(mapped):
            own = f"{mapped}.{uuid.uuid4().hex}"
            table = pq.read_table(source)
            with pa.OSFile(own, "wb") as out, pa.ipc.new_file(out, table.schema) as writer:
                writer.write_table(table.combine_chunks())
            os.replace(own, mapped)
        table = pa.ipc.open_file(pa.memory_map(mapped)).read_all().combine_chunks()
        self.columns = {
            n: c.chunk(0) if c.num_chunks else pa.array([], c.type)
            for n, c in zip(table.column_names, table.columns, strict=True)
        }
        self.digests = self.columns["digest"].to_numpy()

    @classmethod
    def get(cls, name: str) -> MappedIndex:
        if name not in cls._open:
            cls._open[name] = cls(name)
        return cls._open[name]

    def search(self, digests: np.ndarray, wanted: pa.Array) -> np.ndarray:
        """The place of each wanted string, -1 where it is not an entry."""
        out = np.full(len(digests), -1)
        at = np.searchsorted(self.digests, digests)
        left = np.arange(len(digests))
        while len(left):  # entries that share a digest follow each other
            here = at[left]
            fits = here < len(self.digests)
            fits[fits] = self.digests[here[fits]] == digests[left[fits]]
            left = left[fits]
            stored = self.columns["entry"].take(pa.array(at[left]))
            equal = pc.equal(stored, wanted.take(pa.array(left)).cast(stored.type))
            equal = equal.to_numpy(zero_copy_only=False).astype(bool)
            out[left[equal]] = at[left[equal]]
            left = left[~equal]
            at[left] += 1
        return out


def _probe(name: str):
    def probe(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = MappedIndex.get(name)
        for part in parts:
            asked, digests = part.column("candidates"), part.column("digests").flatten().to_numpy()
            row = asked.value_parent_indices().to_numpy()
            place = index.search(digests, asked.flatten())
            hit = np.flatnonzero(place >= 0)
            row, place = row[hit], place[hit]
            rule = index.columns["is_rule"].take(pa.array(place)).to_numpy(zero_copy_only=False)
            size = pc.utf8_length(index.columns["entry"].take(pa.array(place))).to_numpy()
            order = np.lexsort((size, rule, row))  # the last of each row is the one that decides
            row, place = row[order], place[order]
            last = np.append(row[1:] != row[:-1], True) if len(row) else np.zeros(0, bool)
            best = np.full(len(part), -1)
            best[row[last]] = place[last]
            chosen = pa.array(best, mask=best < 0)
            columns = [index.columns[n].take(chosen) for n in ("entry", "verdict", "is_rule")]
            kept = [part.column(n) for n in ("row", "host", "path")]
            yield pa.RecordBatch.from_arrays(
                [*kept, *columns], ["row", "host", "path", "entry", "verdict", "is_rule"]
            )

    return probe


def _mapped(asked: DataFrame, entries: DataFrame) -> DataFrame:
    spark = asked.sparkSession
    ship_package(spark)
    one = materialize(entries.coalesce(1).sortWithinPartitions("digest", "entry"), "url-index")
    (path,) = one.inputFiles() or [None]
    spark.sparkContext.addFile(path)
    schema = asked.select("row", "host", "path").schema
    for field in ("entry string", "verdict string", "is_rule boolean"):
        schema = schema.add(*field.split())
    with_digests = asked.withColumn("digests", F.transform("candidates", lambda c: F.xxhash64(c)))
    return with_digests.mapInArrow(_probe(os.path.basename(path)), schema)


def _joined(asked: DataFrame, entries: DataFrame) -> DataFrame:
    """The same by a shuffle join on distinct candidates, whose repeats are merged beforehand."""
    numbered = materialize(
        asked.withColumn("id", F.monotonically_increasing_id()), "url-candidates"
    )
    each = numbered.select("id", F.explode("candidates").alias("candidate"))
    hits = each.groupBy("candidate").count().select("candidate").join(
        entries, (F.xxhash64("candidate") == F.col("digest")) & (F.col("candidate") == F.col("entry"))
    )
    best = each.join(hits, "candidate").groupBy("id").agg(
        F.max(F.struct("is_rule", F.length("entry").alias("n"), "entry", "verdict")).alias("best")
    )
    return numbered.join(best, "id", "left").select(
        "row", "host", "path", "best.entry", "best.verdict", "best.is_rule"
    )


def judge(
    pages: DataFrame,
    entries: DataFrame | None = None,
    carry: list[str] | None = None,
    max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """``row`` (all columns, or ``carry``), ``host``, ``path``, ``rule`` and ``verdict``.

    One row per row of ``pages``. ``rule`` is null unless a rule decided; listed hosts come next;
    what nothing fits is allowed, among it null urls and urls without a host. Entries that differ
    only in verdict: a rule wins over a listed host, ``block`` over ``allow``.
    """
    spark = pages.sparkSession
    known = materialize(
        clean_entries(default_entries(spark) if entries is None else entries), "url-entries"
    )
    slash = F.instr("entry", "/")
    heads = F.when(slash > 0, F.length("entry") - slash + 1).otherwise(0)
    stats = known.agg(
        F.coalesce(F.sum(F.octet_length("entry") + 32), F.lit(0)), F.collect_set(heads)
    ).first()
    host, path = host_and_path(F.col("url"))
    rows = pack(pages, carry, host=host, path=path)
    asked = rows.withColumn("candidates", candidates(F.col("host"), F.col("path"), sorted(stats[1])))
    found = _mapped(asked, known) if stats[0] <= max_bytes else _joined(asked, known)
    return found.select(
        "row",
        "host",
        "path",
        F.when(F.col("is_rule"), F.col("entry")).alias("rule"),
        F.coalesce("verdict", F.lit("allow")).alias("verdict"),
    )
