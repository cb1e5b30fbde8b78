"""What the operators share: shipped code, the shared folder, hashing and components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()
BATCH_ROWS = 1000
WORD_GAPS = np.zeros(256, bool)
WORD_GAPS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def ship(spark: SparkSession) -> None:
    """Give executors this package once a session, so that they need no copy of the repository.

    Arrow batches get BATCH_ROWS rows where the session has Spark's default: whole documents of
    10,000 rows would fill an executor's memory beside its heap.
    """
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    # the driver serves this file itself: executors never open the driver's folder
    folder = tempfile.mkdtemp(prefix="tessera-code-")
    path = os.path.join(folder, f"tessera_{uuid.uuid4().hex[:8]}.zip")
    Path(path).write_bytes(held.getvalue())
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one is set only where there is none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def open_store(uri: str):
    """File system and path of a folder that all executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class Stash:
    """Tables written to the shared folder: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark, self.root = spark, f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self.drop)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        self.sweep()
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def sweep(self) -> None:
        """Shuffle files go when the driver's collector finds that nothing refers to them.

        Listeners hold the last query that ended, so one without a shuffle ends first.
        """
        self.spark.range(1).collect()
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, name: str = "") -> None:
        """Delete one table, or all of them."""
        try:
            jvm = self.spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001  the session may have ended
            pass


def tidy() -> None:
    """Give freed memory back at the end of a task: idle Python workers keep what they have."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def small_or_plain(df: DataFrame, rows: int, limit: int = 1_000_000) -> DataFrame:
    """Broadcast a side of few-byte rows whose count was taken, up to a limit; else leave the join to shuffles."""
    return F.broadcast(df) if rows <= limit else df


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _tables() -> tuple[np.ndarray, int, int]:
    base = 0x9E3779B97F4A7C15 | 1
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D)), base, pow(base, -1, 1 << 64)


BYTE_CODE, BASE, BASE_INVERSE = _tables()
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; the longest table so far is kept."""
    held = _POWERS.get(base)
    if held is None or len(held) < n:
        held = np.full(max(n, 1 << 16), base, np.uint64)
        held[0] = 1
        np.multiply.accumulate(held, out=held)
        _POWERS[base] = held
    return held[:n]


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of `width` values."""
    n = len(values)
    if n < width:
        return values[:0]
    full = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    full[:n] = values
    blocks = full.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Running sums whose differences give the hash of any byte range in O(1)."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * powers(BASE, len(data)), out=out[1:])
    return out


def range_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte range [start, end), the same wherever the bytes stand."""
    return mix64((sums[end] - sums[start]) * powers(BASE_INVERSE, len(sums))[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n+1 offsets; null reads as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    big = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if big else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word of a batch (white space: x20, x09-x0D), and the n+1 offsets of each text's words."""
    solid = ~WORD_GAPS[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # a text's end closes a word
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1 : len(data)]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1 : len(data)]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, offsets)


def pieces(batch: pa.RecordBatch, max_bytes: int = 4 << 20, column: str = "text"):
    """Slices of a batch whose texts hold about max_bytes; a longer text comes alone and whole."""
    texts = batch.column(batch.schema.get_field_index(column))
    size = np.cumsum([0, *(x or 0 for x in pa.compute.binary_length(texts).to_pylist())])
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, size[at] + max_bytes, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def components(stash: Stash, links: DataFrame, name: str) -> DataFrame:
    """(node, component): the smallest node reachable over links (a, b).

    Every node keeps its smallest smaller neighbour and hands it to the others; then it jumps to that
    neighbour's own. All tables of a round are written to the shared folder, so joins on a hot
    neighbour have two shuffled sides that adaptive execution can split. Rounds grow with the
    logarithm of the longest chain.
    """
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    held = stash.keep(links, f"{name}-0")
    for k in range(1, 200):
        low = stash.keep(held.groupBy("a").agg(F.min("b").alias("m")), f"{name}-low-{k}")
        jump = low.alias("x").join(low.alias("y"), F.col("x.m") == F.col("y.a"), "left").select(F.col("x.a").alias("a"), F.coalesce("y.m", "x.m").alias("b"), F.col("y.m").isNotNull().alias("moved"))
        rest = held.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"), F.lit(True).alias("moved"))
        new = jump.unionAll(rest).groupBy("a", "b").agg(F.max("moved").alias("moved"))
        new = stash.keep(new, f"{name}-{k}")
        moved = new.where("moved").limit(1).count()
        stash.drop(f"{name}-{k - 1}")
        stash.drop(f"{name}-low-{k}")
        held = new.select("a", "b")
        if not moved:
            break
    else:
        raise RuntimeError("components did not settle")
    return held.select(F.col("a").alias("node"), F.col("b").alias("component"))
