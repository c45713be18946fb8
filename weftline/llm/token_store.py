"""Token ids as raw binary shards, with a minimal perfect hash index for keyed access.

Files below one shared folder:

* ``shard-NNNNNN.ids``: token ids of whole documents, end id included, as little-endian unsigned
  16- or 32-bit integers without separators. Shards follow each other in ascending doc_id order
  (rows without one first), documents within a shard too.
* ``shards``: per shard its first global position and its length.
* ``index``: buckets of about ``BUCKET`` keys, ``FILE_BUCKETS`` to a folder. A key is a doc_id and the number of the row among
  those with this doc_id. Each bucket holds a minimal perfect hash (levels of bits: at each level
  a key that has a position for itself sets its bit, the others go on) that gives every key a slot
  of its own without storing keys, and in the slot a fingerprint, the shard, offset and length.

A look-up costs the same for any table size: one index file, in it one bucket, a few bits and one
slot, and one read of a shard. Foreign keys are told apart by the fingerprint, but for one in 2^32. Files are written
under a task's own name and then renamed, so a task that runs again leaves the same files.
"""

from __future__ import annotations

import contextlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm.bpe import encode_packed, forget, vocabulary_size
from weftline.llm.common import ship_package, small_batches
from weftline.llm.hashing import mix

END_ID = 2
#: Text that is encoded at once; also bounds how much the output of a step holds.
ENCODED_BYTES = 1 << 20
BUCKET = 1024
#: Buckets of one index file. A look-up reads the files that its keys fall in, and no others, unless
#: they fall in more than ``MANY_FILES``, when the index is read as a whole.
FILE_BUCKETS, MANY_FILES = 64, 1024
#: A level places more than half of its keys; so many levels are never needed for distinct ones.
MOST_LEVELS = 64
#: Rows whose payload is read at once.
READ_ROWS = 256

MANIFEST = "doc_id long, shard int, place long, same long, offset long, n_tokens long"
FOUND = "k1 long, k2 long, shard int, offset long, n_tokens long"


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (
        fs.LocalFileSystem(),
        folder,
    )


def _by_bytes(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of about ENCODED_BYTES of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(part.column("text")), 0).to_numpy(zero_copy_only=False)
    upto, begin = np.cumsum(sizes), 0
    while begin < len(part):
        before = upto[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(upto, before + ENCODED_BYTES, side="right")))
        yield part.slice(begin, stop - begin)
        begin = stop


def _writer(folder: str, tokenizer: str, end_id: int, dtype: str) -> Callable:
    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        shard = context.partitionId()
        store, root = _filesystem(folder)
        own = f"{root}/.shard-{shard:06d}-{context.taskAttemptId()}"
        out, place, offset, last, same = None, 0, 0, None, 0
        end = int(end_id).to_bytes(4, "little")
        for part in parts:
            for some in _by_bytes(part):
                texts = some.column("text").fill_null("").to_pylist()
                ids = [packed + end for packed in encode_packed(texts, tokenizer)]
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(own)
                rows = []
                for doc_id, one in zip(some.column("doc_id").to_pylist(), ids, strict=True):
                    same = same + 1 if place and doc_id == last else 0
                    rows.append((doc_id, shard, place, same, offset, len(one) // 4))
                    last, place, offset = doc_id, place + 1, offset + len(one) // 4
                out.write(np.frombuffer(b"".join(ids), "<u4").astype(dtype).tobytes())
                columns = [pa.array(c, kind) for c, kind in zip(zip(*rows), _KINDS, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, _NAMES)
        if out is not None:
            out.close()
            with contextlib.suppress(FileExistsError):  # another attempt's file is the same
                store.move(own, f"{root}/shard-{shard:06d}.ids")

    return write


_NAMES = ["doc_id", "shard", "place", "same", "offset", "n_tokens"]
_KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]


def _keys(doc_id: Column, same: Column) -> list[Column]:
    none = doc_id.isNull()
    return [
        F.coalesce(doc_id, F.lit(0).cast("long")).alias("k1"),
        (same * 2 + none.cast("long")).alias("k2"),
    ]


def _bucket(n_buckets: int) -> Column:
    return F.pmod(F.xxhash64("k1", "k2"), F.lit(n_buckets).cast("long")).alias("bucket")


def _file() -> Column:
    return F.floor(F.col("bucket") / FILE_BUCKETS).cast("long")


def _hash(k1: np.ndarray, k2: np.ndarray, level: int) -> np.ndarray:
    salt = np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)
    return mix(mix(k1.astype(np.uint64) ^ salt) + mix(k2.astype(np.uint64) + salt))


def _fingerprint(k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    return (_hash(k1, k2, 1000) >> np.uint64(32)).astype(np.uint32)


def build_levels(k1: np.ndarray, k2: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Sizes and bits of the levels. Equal keys are an error: no level tells them apart."""
    sizes, bits = [], []
    left = np.arange(len(k1))
    while len(left):
        if len(sizes) == MOST_LEVELS:
            raise ValueError(f"keys are not distinct, e.g. {(int(k1[left[0]]), int(k2[left[0]]))}")
        size = 2 * len(left)
        at = _hash(k1[left], k2[left], len(sizes)) % np.uint64(size)
        alone = np.bincount(at.astype(np.int64), minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        left = left[~alone[at.astype(np.int64)]]
    return sizes, np.concatenate(bits) if bits else np.zeros(0, bool)


def slots(sizes: list[int], bits: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    """The slot of each key, from 0; -1 for a key that surely was not there."""
    rank = np.cumsum(bits) - 1
    out = np.full(len(k1), -1)
    left, start = np.arange(len(k1)), 0
    for level, size in enumerate(sizes):
        at = start + (_hash(k1[left], k2[left], level) % np.uint64(size)).astype(np.int64)
        hit = bits[at]
        out[left[hit]] = rank[at[hit]]
        left, start = left[~hit], start + size
    return out


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    k1, k2 = rows["k1"].to_numpy(), rows["k2"].to_numpy()
    sizes, bits = build_levels(k1, k2)
    order = np.argsort(slots(sizes, bits, k1, k2))
    packed = {
        "sizes": np.array(sizes, dtype="<u4"),
        "bits": np.packbits(bits),
        "prints": _fingerprint(k1, k2)[order].astype("<u4"),
        "shards": rows["shard"].to_numpy()[order].astype("<u4"),
        "offsets": rows["offset"].to_numpy()[order].astype("<u8"),
        "lengths": rows["n_tokens"].to_numpy()[order].astype("<u8"),
    }
    return pd.DataFrame(
        {"bucket": [rows["bucket"].iloc[0]]} | {k: [v.tobytes()] for k, v in packed.items()}
    )


INDEX = (
    "bucket long, sizes binary, bits binary, prints binary, shards binary, offsets binary, "
    "lengths binary"
)


def _look_up(keys: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    k1, k2 = keys["k1"].to_numpy(), keys["k2"].to_numpy()
    empty = pd.DataFrame({name: [] for name in ["k1", "k2", "shard", "offset", "n_tokens"]})
    if not len(index) or not len(keys):
        return empty
    one = index.iloc[0]
    sizes = np.frombuffer(one["sizes"], "<u4").tolist()
    bits = np.unpackbits(np.frombuffer(one["bits"], np.uint8), count=sum(sizes)).astype(bool)
    slot = slots(sizes, bits, k1, k2)
    prints = np.frombuffer(one["prints"], "<u4")
    known = (slot >= 0) & (prints[slot] == _fingerprint(k1, k2))
    slot = slot[known]
    return pd.DataFrame(
        {
            "k1": k1[known],
            "k2": k2[known],
            "shard": np.frombuffer(one["shards"], "<u4")[slot].astype(np.int32),
            "offset": np.frombuffer(one["offsets"], "<u8")[slot].astype(np.int64),
            "n_tokens": np.frombuffer(one["lengths"], "<u8")[slot].astype(np.int64),
        }
    )


def write_store(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID
) -> DataFrame:
    """Write shards, shard table and index; returns the keys written (doc_id, k1, k2).

    Ids are stored with 16 bits if the vocabulary and the end id allow it, else with 32. Null texts are empty and consist of
    the end id. Rows without doc_id come first. Rows with one doc_id are told apart by number, in
    the order of a hash of their texts. An empty table makes an empty store.
    """
    spark = docs.sparkSession
    ship_package(spark)
    dtype = "<u2" if max(vocabulary_size(tokenizer), end_id + 1) <= 1 << 16 else "<u4"
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", "text_hash", "row"]
    texts = docs.select(
        "doc_id",
        "text",
        F.xxhash64("text").alias("text_hash"),
        F.monotonically_increasing_id().alias("row"),
    )
    parts = texts.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    encode = _writer(folder, tokenizer, end_id, dtype)
    written = parts.select("doc_id", "text").mapInArrow(encode, MANIFEST)
    with small_batches(spark):
        written.write.parquet(f"{folder}/manifest")
    manifest = spark.read.schema(written.schema).parquet(f"{folder}/manifest")

    # one row per shard from here: positions of shards, and doc_ids that go on from shard to shard
    ends = manifest.groupBy("shard").agg(
        F.sum("n_tokens").alias("n_tokens"),
        F.min_by("doc_id", "place").alias("first_id"),
        F.max_by("doc_id", "place").alias("last_id"),
        (F.max_by("same", "place") + 1).alias("last_run"),
    )
    up_to = Window.partitionBy(F.lit(0)).orderBy("shard")
    ends.select(
        "shard",
        "n_tokens",
        (F.sum("n_tokens").over(up_to) - F.col("n_tokens")).alias("base"),
        F.lit(dtype).alias("dtype"),
    ).write.parquet(f"{folder}/shards")
    runs = ends.select("shard", F.col("last_id").alias("id"), F.col("last_run").alias("run"))
    asks = ends.select("shard", F.col("first_id").alias("id"), F.lit(0).cast("long").alias("run"))
    earlier = Window.partitionBy("id").orderBy("shard").rangeBetween(Window.unboundedPreceding, -1)
    carried = (
        runs.withColumn("ask", F.lit(False))
        .union(asks.withColumn("ask", F.lit(True)))
        .withColumn("carry", F.sum("run").over(earlier))
        .where("ask AND carry > 0")
        .select(F.col("shard").alias("in_shard"), F.col("id").alias("run_id"), "carry")
    )
    carried.write.parquet(f"{folder}/carried")
    carried = spark.read.schema(carried.schema).parquet(f"{folder}/carried")
    goes_on = (F.col("shard") == F.col("in_shard")) & F.col("doc_id").eqNullSafe(F.col("run_id"))
    same = F.col("same") + F.coalesce("carry", F.lit(0).cast("long"))
    keys = manifest.join(carried, goes_on, "left").select(
        "doc_id", *_keys(F.col("doc_id"), same), "shard", "offset", "n_tokens"
    )
    n_buckets = max(1, -(-manifest.count() // BUCKET))
    index = (
        keys.select("k1", "k2", "shard", "offset", "n_tokens", _bucket(n_buckets))
        .withColumn("file", _file())
        .repartition("file")
        .groupBy("file", "bucket")
        .applyInPandas(_build, INDEX)
    )
    index.withColumn("n_buckets", F.lit(n_buckets)).withColumn("file", _file()).write.partitionBy(
        "file"
    ).parquet(f"{folder}/index")
    return keys.select("doc_id", "k1", "k2")


def look_up(spark: SparkSession, folder: str, keys: DataFrame) -> DataFrame:
    """Where the documents are: (k1, k2, shard, offset, n_tokens) for those keys that exist."""
    index = spark.read.schema(f"{INDEX}, n_buckets int, file long").parquet(f"{folder}/index")
    first = index.select("n_buckets").first()
    n_buckets = first[0] if first else 1
    asked = keys.select("k1", "k2", _bucket(n_buckets)).distinct()
    if n_buckets > FILE_BUCKETS:
        files = asked.select(_file().alias("file")).distinct().limit(MANY_FILES + 1).collect()
        if len(files) <= MANY_FILES:
            index = index.where(F.col("file").isin([r.file for r in files]))
    return (
        asked.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(_look_up, FOUND)
    )


def _reader(folder: str, use: Callable[[np.ndarray], object], kind: pa.DataType) -> Callable:
    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()  # this worker may have encoded texts before
        store, root = _filesystem(folder)
        for part in parts:
            for begin in range(0, len(part), READ_ROWS):
                some = part.slice(begin, READ_ROWS)
                columns = {n: some.column(n).to_numpy() for n in ("shard", "offset", "n_tokens")}
                width = np.dtype(some.column("dtype")[0].as_py()).itemsize
                values: list[object] = [None] * len(some)
                for shard in np.unique(columns["shard"]):
                    rows = np.flatnonzero(columns["shard"] == shard)
                    low = columns["offset"][rows]
                    high = low + columns["n_tokens"][rows]
                    with store.open_input_file(f"{root}/shard-{shard:06d}.ids") as file:
                        raw = file.read_at(int(high.max() - low.min()) * width, int(low.min()) * width)
                    ids = np.frombuffer(raw, f"<u{width}")
                    for row, a, b in zip(rows, low - low.min(), high - low.min(), strict=True):
                        values[row] = use(ids[a:b])
                result = [some.column(n) for n in ("k1", "k2", "start", "n_tokens")]
                yield pa.RecordBatch.from_arrays(
                    [*result, pa.array(values, kind)], ["k1", "k2", "start", "n_tokens", "value"]
                )

    return read


def _crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _list(ids: np.ndarray) -> list[int]:
    return ids.tolist()


def read_store(spark: SparkSession, folder: str, keys: DataFrame, ids: bool = False) -> DataFrame:
    """(k1, k2, start, n_tokens, value) of ``keys``, from the files alone.

    ``value`` is the CRC-32 of the ids as little-endian unsigned 32-bit integers, or with ``ids``
    the array of them. ``start`` counts the ids of all documents before.
    """
    found = look_up(spark, folder, keys)
    shards = spark.read.parquet(f"{folder}/shards").select("shard", "base", "dtype")
    placed = found.join(shards, "shard").withColumn("start", F.col("base") + F.col("offset"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    along = placed.repartitionByRange(n, "shard", "offset").sortWithinPartitions("shard", "offset")
    use, kind, name = (_list, pa.list_(pa.int64()), "array<long>") if ids else (_crc32, pa.int64(), "long")
    return along.mapInArrow(
        _reader(folder, use, kind), f"k1 long, k2 long, start long, n_tokens long, value {name}"
    )


def digests(spark: SparkSession, docs: DataFrame, folder: str, tokenizer: str) -> DataFrame:
    """Write ``docs`` and read every document back by key: doc_id, start, n_tokens, ids_crc32."""
    keys = write_store(docs, folder, tokenizer)
    read = read_store(spark, folder, keys)
    return read.select(
        F.when(F.col("k2") % 2 == 0, F.col("k1")).alias("doc_id"),
        "start",
        "n_tokens",
        F.col("value").alias("ids_crc32"),
    )
