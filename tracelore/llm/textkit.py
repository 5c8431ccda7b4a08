"""Byte-level text tools on Arrow batches, and small helpers that all operators share.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, which is what
``[^\\x20\\x09-\\x0D]+`` matches in UTF-8 text. Everything works on whole texts: a
chunk holds one or more complete documents, never part of one.
"""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Documents are taken together up to so many bytes; a longer one makes a chunk of its own.
CHUNK_BYTES = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_POWERS: dict[str, np.ndarray] = {}
_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def lean(run: Callable) -> Callable:
    """A task's function that gives the memory it has freed back to the system when it ends: workers live on between tasks."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                gc.collect()
                trim(0)

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; null keys count as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared checkpoint folder; sets one under the warehouse only where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, *, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """The rows written to the shared folder as Parquet and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.partitionBy(*partition_by).parquet(path) if partition_by else df.write.parquet(path)
    return spark.read.schema(spark.read.parquet(path).schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Delete the files of a frame that ``stored`` made and that nothing needs any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for top in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(top)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Slots that ``likely_in`` hashes keys to; bounds its broadcast to so many 8-byte rows.
SLOTS = 1 << 20


def _slot(rows: DataFrame, key: str) -> Column:
    """The slot of a key; whole numbers of all types have one as longs."""
    c = F.col(key)
    return F.pmod(F.xxhash64(c if rows.schema[key].dataType.typeName() == "binary" else c.cast("long")), F.lit(SLOTS))


def likely_in(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """``rows`` without most of those whose key is not in ``keys`` (one column of the key's type): what follows need not shuffle them.

    Keys are hashed to SLOTS slots and the slots in use are broadcast, so some other rows
    stay, more the more keys there are; the join that follows drops them.
    """
    used = keys.select(_slot(keys, keys.columns[0]).alias("_slot")).distinct()
    return rows.join(F.broadcast(used), _slot(rows, key) == F.col("_slot"), "left_semi")


def marked_in(rows: DataFrame, key: str, keys: DataFrame, name: str) -> DataFrame:
    """``rows`` with a boolean column ``name``: true where the key is in ``keys``, and in the same slots' other rows; nothing is shuffled but slots."""
    used = keys.select(_slot(keys, keys.columns[0]).alias("_slot")).distinct().withColumn("_in", F.lit(True))
    return rows.withColumn("_at", _slot(rows, key)).join(F.broadcast(used), F.col("_at") == F.col("_slot"), "left").withColumn(name, F.col("_in").isNotNull()).drop("_at", "_slot", "_in")


def left_by_key(rows: DataFrame, key: str, found: DataFrame, other: str) -> DataFrame:
    """``rows`` with the columns of ``found`` whose ``other`` equals ``key``, null where there is none.

    A left join that moves only rows whose key may be found; ``found`` has one row per key.
    """
    used = F.broadcast(found.select(_slot(found, other).alias("_slot")).distinct())
    marked = rows.withColumn("_at", F.coalesce(_slot(rows, key), F.lit(-1).cast("long")))
    names = [c for c in found.columns if c != other]
    alone = marked.join(used, F.col("_at") == F.col("_slot"), "left_anti").drop("_at").withColumns({c: F.lit(None).cast(found.schema[c].dataType) for c in names})
    likely = marked.join(used, F.col("_at") == F.col("_slot"), "left_semi").drop("_at")
    return alone.unionByName(likely.join(found.withColumnRenamed(other, "_other"), F.col(key) == F.col("_other"), "left").drop("_other"))


#: Rows of a key that make it large, and most large keys: the bound of a broadcast of one row each.
LARGE, MOST_LARGE = 1000, 10_000


def join_sizes(rows: DataFrame, facts: DataFrame, key: str, size: str, n_rows: int) -> DataFrame:
    """``rows`` inner-joined with ``facts``, one row per key, in which ``size`` is the number of rows of the key.

    The facts of large keys, of which there are MOST_LARGE at most, are broadcast, so that
    their rows stay where they are; only those of small keys are shuffled.
    """
    limit = max(LARGE, n_rows // MOST_LARGE)
    large = F.broadcast(facts.where(F.col(size) >= limit))
    return rows.join(large, key).unionByName(rows.join(large.select(key), key, "left_anti").join(facts.where(F.col(size) < limit), key))


def shuffle_width(spark: SparkSession) -> int:
    """Partitions that a shuffle gets in this session."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows; nulls are empty. Offsets start at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        end = min(end, n)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the number of words of each document."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets) - 1, np.int64)
    word = ~SPACE[data]
    first = np.empty(len(data), bool)
    first[0] = True
    first[1:] = ~word[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    first[inner] = True
    last = np.empty(len(data), bool)
    last[-1] = True
    last[:-1] = first[1:] & (~word[:-1] | ~word[1:])
    last[:-1] |= ~word[1:]
    tail = offsets[1:][offsets[1:] > 0] - 1
    last[tail] = True
    starts, ends = np.flatnonzero(word & first), np.flatnonzero(word & last) + 1
    per_doc = np.searchsorted(starts, offsets[1:]) - np.searchsorted(starts, offsets[:-1])
    return starts, ends, per_doc


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, CHUNK_BYTES + 1)
        up = np.full(size, _ODD, np.uint64)
        up[0] = 1
        down = np.full(size, np.uint64(pow(int(_ODD), -1, 1 << 64)), np.uint64)
        down[0] = 1
        tables = {"up": np.multiply.accumulate(up), "down": np.multiply.accumulate(down)}
        if n > 4 * CHUNK_BYTES:
            return tables["up"], tables["down"]
        _POWERS.update(tables)
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash of bytes or 64-bit letters, one longer than the data; for ``span_hash``."""
    up, _ = _powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_CODES[data] if data.dtype == np.uint8 else mix(data)) * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span's bytes, wherever it stands."""
    _, down = _powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _ODD)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every word."""
    return span_hash(prefix_hash(data), starts, ends)


def segment_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each run of ``counts`` consecutive values; empty runs give 0."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def ids_of(batch: pa.RecordBatch, name: str = "doc_id") -> pa.Array:
    """The id column as 64-bit integers, nulls kept."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.int64())
