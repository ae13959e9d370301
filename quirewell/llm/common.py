"""Shared helpers: work folders, bounded batches, word and shingle hashing."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import math
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Text that one Python batch holds at most, unless a single text is longer.
BATCH_BYTES = 512 << 10
#: Distinct ids that may be broadcast: 8 bytes each, 4 MB at most.
BROADCAST_IDS = 500_000
ASCII_SPACE = "[\\x20\\x09-\\x0D]"

_own: dict[str, str] = {}
_made: dict[str, SparkSession] = {}
_tables: dict[str, SparkSession] = {}


def work_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir`` for what an operator keeps between its stages.

    Where that is unset a temporary folder is used in local mode; on a cluster it
    is an error, as executors don't see each other's disks. The folder goes
    with ``clean`` or when the driver ends; results that are still to be read
    lie in it until then.

    From here on the session's Arrow batches hold BATCH_BYTES each, so that a
    Python worker's memory doesn't grow with the rows' sizes.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith(("local[", "local")) or spark.conf.get("spark.master", "").startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if "dir" not in _own:
            _own["dir"] = tempfile.mkdtemp(prefix="quirewell-")
            atexit.register(shutil.rmtree, _own["dir"], True)
        base = "file://" + _own["dir"]
    path = f"{base.rstrip('/')}/quirewell-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(clean)
    _made[path] = spark
    return path


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete folders that no result is read from any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def forget(spark: SparkSession, table: str) -> None:
    """A table that goes with the work folders."""
    _tables[table] = spark


def clean() -> None:
    """Delete the work folders and tables of this driver; results that are read from them end with them."""
    for table, spark in list(_tables.items()):
        del _tables[table]
        with contextlib.suppress(Exception):  # the session may have ended
            spark.sql(f"DROP TABLE IF EXISTS {table}")
    for path, spark in list(_made.items()):
        del _made[path]
        with contextlib.suppress(Exception):  # the session may have ended
            drop(spark, path)


def keep(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` below a shared folder and read it back: cuts the lineage and survives lost executors."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return what this worker has freed to the system: it stays alive for later stages, and their memory counts together."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def lean(run):
    """``run``, a function of batches, followed by ``give_back``."""

    def all_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return all_of


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def only_ids(df: DataFrame, ids: DataFrame, key: str, limit: int = BROADCAST_IDS) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in ``ids`` (a materialised table of distinct keys).

    Few ids go to every executor; beyond ``limit`` the two sides are shuffled.
    """
    small = ids.count() <= limit
    return df.join(F.broadcast(ids) if small else ids.hint("merge"), key, "left_semi")


#: Keys with more than this share of the rows are dealt out over as many parts.
HOT_SHARE, HOT_PARTS = 1 / 1000, 64


def salted_join(many: DataFrame, one: DataFrame, keys: list[str], spread: str) -> DataFrame:
    """``many`` joined with ``one`` (a row for each of the keys), without a task that gets all rows of a hot key.

    Keys with more than HOT_SHARE of the rows of ``many``, so at most 1000 of
    them, are found by a count first; their rows go to HOT_PARTS places by a hash
    of the column ``spread``, and their row of ``one`` to each of these.
    """
    h = F.xxhash64(*keys)
    most = max(1000, many.count() * HOT_SHARE)
    hot = [r["h"] for r in many.groupBy(h.alias("h")).count().where(F.col("count") > most).collect()]
    if not hot:
        return many.join(one, keys)
    part = F.when(h.isin(hot), F.pmod(F.xxhash64(spread), F.lit(HOT_PARTS)).cast("int")).otherwise(0)
    parts = F.when(h.isin(hot), F.sequence(F.lit(0), F.lit(HOT_PARTS - 1))).otherwise(F.array(F.lit(0)))
    return many.withColumn("__part", part).join(one.withColumn("__part", F.explode(parts)), [*keys, "__part"]).drop("__part")


def smallest(rows: DataFrame, group: str, n: int) -> DataFrame:
    """Of each group of ``rows`` (with a doc_id) the n rows with the smallest hashes, ties by all columns.

    A bound on the hash, from the group's number of rows, leaves little more
    than n of them to be ranked, so a group with most rows makes no large task.
    Fewer than n of a larger group stay with a chance of 1e-14. Groups are few
    (classes, languages): their counts are broadcast.
    """
    h, full = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)), 1 << 40
    most = F.least(F.lit(full), F.ceil(F.lit((n + 8 * math.sqrt(n) + 40) * full) / F.count(F.lit(1)))).cast("bigint")
    bound = rows.groupBy(group).agg(most.alias("__most"))
    order = Window.partitionBy(group).orderBy(h, *(F.col(c) for c in rows.columns))
    near = rows.join(F.broadcast(bound), group).where(h < F.col("__most"))
    return near.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= n).select(*rows.columns)


def pieces(batch: pa.RecordBatch, column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut an Arrow batch so that each piece has about ``most`` bytes of ``column``."""
    n = batch.num_rows
    if not n:
        return
    import pyarrow.compute as pc

    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column as uint8, and the n + 1 offsets into them; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_string(column.type):
        width = np.int32
    else:
        column, width = column.cast(pa.large_string()), np.int64
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        full = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        full[0] = 1
        have = _powers[name] = np.cumprod(full, dtype=np.uint64)
        if len(have) > 1 << 20:  # a long text: not kept
            del _powers[name]
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def words_of(data: np.ndarray, at: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words ``[^\\x20\\x09-\\x0D]+`` and, for each text, the place of its first one (n + 1 values)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    if lower:
        data = _LOWER[data]
    ink = ~_IS_SPACE[data]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    edge = at[(at > 0) & (at < n)]  # texts lie side by side without a gap
    first[edge] |= ink[edge]
    last = ink.copy()
    last[:-1] &= ~ink[1:]
    before = edge - 1
    last[before] |= ink[before]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * _power("base", _BASE, n), dtype=np.uint64, out=sums[1:])
    words = (sums[ends] - sums[starts]) * _power("inverse", _INVERSE, n)[starts]
    words = mix(words + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return words, np.searchsorted(starts, at).astype(np.int64)


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive words; runs across texts are to be left out by the caller."""
    m = len(words) - size + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, dtype=np.uint64)
    for i in range(size):
        out = out * np.uint64(0xFF51AFD7ED558CCD) + words[i : i + m]
    return mix(out)


def tail_share(k: int, threshold_pct: int) -> int:
    """Items that two bottom-k sketches share at least, save with a chance of about 1e-8, if Jaccard is at the threshold."""
    p = threshold_pct / 100
    return max(1, math.floor(k * p - 5.7 * math.sqrt(k * p * (1 - p))))


def by_group(df: DataFrame, keys: list[str], run, schema: str) -> DataFrame:
    """``run`` on each group of integer ``keys`` as one Arrow table; its tables side by side.

    Groups must be of bounded size. They are read from sorted partitions, many
    to a batch, which suits many small groups better than a batch for each.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last: tuple | None = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
            new = np.zeros(n, dtype=bool)
            for c in columns:
                new[1:] |= c[1:] != c[:-1]
            new[0] = last is not None and last != tuple(c[0] for c in columns)
            start = 0
            for edge in np.flatnonzero(new).tolist():
                if edge > start:
                    held.append(batch.slice(start, edge - start))
                yield from run(pa.Table.from_batches(held)).to_batches()
                held, start = [], edge
            held.append(batch.slice(start))
            last = tuple(c[-1] for c in columns)
        if held:
            yield from run(pa.Table.from_batches(held)).to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lean(each), schema)
