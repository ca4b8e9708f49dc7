"""Pieces that several corpus operators share: scratch tables, text columns and vectorised hashing."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import hashlib
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from functools import wraps
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NULL_ID = (1 << 63) - 1  # stands for a null id in orders: after every other id, so no real id may have this value


_SHIPPED: set[str] = set()


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1000  # of texts that pass to a Python worker at once, where the session keeps Spark's default


def ship(spark: SparkSession) -> None:
    """Send this package to the session's Python workers, once: they need not find it on their own path.

    Arrow batches are kept small, too: ten thousand texts at a time would take tens of megabytes on both sides.
    """
    context = spark.sparkContext
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    if context.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parents[1]
        target = Path(tempfile.mkdtemp(prefix="meridia-")) / f"{root.name}.zip"  # the driver's own; executors fetch it
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        context.addPyFile(str(target))
        _SHIPPED.add(context.applicationId)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a folder of our own only in a local session that names none."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="meridia-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


_SETTLED: list = []


@atexit.register
def _clear_scratch() -> None:
    """Delete the session's scratch tables when the driver ends; results are the caller's to write before that."""
    for context, path in _SETTLED:
        with contextlib.suppress(Exception):  # the session may be gone
            target = context._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(context._jvm.org.apache.hadoop.conf.Configuration()).delete(target, True)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here and no executor's loss can undo it.

    The shuffle files behind it are deleted as soon as it is written. ``df`` itself should not be used again.
    ``batch_rows`` bounds the Arrow batches on the way, where rows are large.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/meridia-{name}-{uuid.uuid4().hex}"
    wanted = {_CLEANUP: "true"} | ({_BATCH: str(batch_rows)} if batch_rows else {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    _SETTLED.append((spark.sparkContext, path))
    return spark.read.schema(df.schema).parquet(path)


def drop_settled(df: DataFrame) -> None:
    """Delete a table that ``settle`` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has, whatever their case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def document_key(id_column: str, text_column: str) -> tuple[Column, Column]:
    """(id, tie) that name a document: rows that share an id but not a text are different documents, in the order of
    their texts' hashes; null ids come after all others. Rows that share both are one document."""
    return F.coalesce(F.col(id_column).cast("long"), F.lit(NULL_ID)), F.xxhash64(F.coalesce(F.col(text_column), F.lit("")))


def utf8(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, nulls kept."""
    if pa.types.is_large_string(column.type):
        return column.cast(pa.large_binary()).to_pylist()
    return column.cast(pa.binary()).to_pylist()


def text_slices(column: pa.Array, limit: int = 1_000_000) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first row, end row, UTF-8 texts) of about ``limit`` bytes, whole texts each, nulls as empty.

    A batch is turned into Python objects slice by slice, so what a worker holds besides the batch stays bounded.
    """
    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    start = 0
    while start < len(column):
        before = int(size[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(size, before + limit, side="right")))
        yield start, end, [t or b"" for t in utf8(column.slice(start, end - start))]
        start = end


def give_back() -> None:
    """Hand freed memory back to the system, so that a process that is done with large arrays is small again."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without malloc_trim
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable, owner: str | None = None) -> Callable:
    """A batch function after which the worker gives freed memory back, so that idle workers stay small.

    With ``owner`` it also drops what others than that owner keep in the worker, before it starts.
    """

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if owner is not None:
            worker_cache(owner)
        yield from run(batches)
        give_back()

    return wrapped


_OWNER: list[str] = [""]
_KEPT: dict = {}


def worker_cache(owner: str) -> dict:
    """What this Python worker keeps between tasks for one owner; another owner's is dropped first."""
    if _OWNER[0] != owner:
        _OWNER[0] = owner
        _KEPT.clear()
    return _KEPT


# --------------------------------------------------------------------------- hashing

_MASK = (1 << 64) - 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def lower_ascii(text: bytes) -> bytes:
    return text.translate(_LOWER)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which each input bit moves each output bit."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


_SEED = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_LEFT = (np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xA0761D6478BD642F))
_RIGHT = (np.uint64(0x165667B19E3779F9), np.uint64(0xE7037ED1A0B428DB))
_FIRST_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
_LONG_WORD = 64  # bytes; what a word has beyond them is hashed by BLAKE2


def word_hashes(texts: list[bytes], which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and how many words each text has.

    A word is a longest run of bytes other than 0x20 and 0x09 to 0x0D. ``which`` picks one of two independent
    hash functions. A word's length and its bytes, eight at a time, go through a mixing chain, all words at once.
    """
    joined = np.frombuffer(b" ".join(texts) + b" " * 9, dtype=np.uint8)
    edge = np.flatnonzero(np.diff(~_SPACE[joined], prepend=False))
    start, size = edge[0::2], edge[1::2] - edge[0::2]
    eight = np.ndarray(len(joined) - 7, dtype="<u8", buffer=joined, strides=(1,))  # the eight bytes from each place on
    hashes = mix64(size.astype(np.uint64) + _SEED[which])
    hashes = mix64(hashes ^ (eight[start] & _FIRST_BYTES[np.minimum(size, 8)]))
    done, more = 8, np.flatnonzero(size > 8)
    while len(more) and done < _LONG_WORD:
        block = eight[start[more] + done] & _FIRST_BYTES[np.minimum(size[more] - done, 8)]
        hashes[more] = mix64(hashes[more] ^ block)
        done += 8
        more = more[size[more] > done]
    for k in more:
        rest = hashlib.blake2b(joined[start[k] + done : start[k] + size[k]], digest_size=8, salt=bytes([which]))
        hashes[k] = mix64(hashes[k : k + 1] ^ np.frombuffer(rest.digest(), dtype="<u8"))[0]
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
    counts = np.diff(np.searchsorted(start, ends), prepend=0)
    return hashes, counts


def window_hashes(words: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """Hashes of all runs of n consecutive words of the whole array (runs across texts are for the caller to skip).

    Hashes of runs of 1, 2, 4, ... words come from two halves each; those of n words from the runs that n's binary
    digits name. Every join is mixed, so no regular pattern of words cancels out.
    """
    total = len(words) - n + 1
    if total < 1:
        return np.zeros(0, dtype=np.uint64)
    join = lambda a, b: mix64(a * _LEFT[which] + b * _RIGHT[which])
    run, width, out, taken = words, 1, None, 0
    while True:
        if n & width:
            piece = run[taken : taken + total]
            out = piece if out is None else join(out, piece)
            taken += width
        if taken == n:
            return mix64(out + np.uint64(n * int(_SEED[which]) & _MASK))
        run, width = join(run[:-width], run[width:]), 2 * width


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


# --------------------------------------------------------------------------- components


def components(edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b): rows (node, component), component = smallest node.

    Alternates the large-star and small-star steps: each hands every node's neighbours to its smallest one, so
    hubs are aggregated (and combined before the shuffle), never collected. Each round is written to the shared
    folder. The only values that reach the driver are a count and a checksum of the links.
    """
    links = (
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    )
    links = settle(links, name)
    before = None
    for _ in range(max_rounds):
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            break
        before = state
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        after = settle(small, name)
        drop_settled(links)
        links = after
    else:
        raise RuntimeError("components did not converge")
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
