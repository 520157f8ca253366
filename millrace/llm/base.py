"""What the operators of this subpackage share: shared storage, bounded Arrow batches, samples."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress
from functools import cache
from pathlib import Path
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import zstandard
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows and bytes of text that a Python step holds at once; a single longer text is a slice of its own.
SLICE_ROWS, SLICE_BYTES = 512, 2 << 20


def tune(spark: SparkSession) -> None:
    """Let workers import this package and keep the batches sent to them small, whatever the texts' lengths."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join(p for p in (root, *paths) if p)
    for name, most in (("maxRecordsPerBatch", 1000), ("maxBytesPerBatch", 4 << 20)):  # a caller's smaller batches stay
        now = int(re.sub(r"\D", "", spark.conf.get(f"spark.sql.execution.arrow.{name}")) or 0)
        if not 0 < now <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


@cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="millrace-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where that is unset, one of our own on a
    single machine, and an error on a cluster, whose executors would each write to a disk of their own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"file://{_own_dir()}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there and a lost executor costs no recomputation.

    All tables of an application are in one folder of its own. `discard` deletes a table once it is no longer needed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def discard(*tables: DataFrame) -> None:
    """Delete tables that `written` made and that nothing reads any more; others are left alone."""
    for t in tables:
        if path := _PATHS.pop(t, None):
            spark = t.sparkSession
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def trim(spark: SparkSession) -> None:
    """Give memory that the driver has freed back to the system.

    Each query's threads free native memory that the C library keeps for them, so a driver that has run many queries
    holds far more than it uses. Where a JVM or C library has no such call, nothing is given back.
    """
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
    context = spark.sparkContext
    lang = context._jvm.java.lang
    with suppress(Py4JError):  # by reflection, as the server's own class is not open to callers
        call = next(m for m in lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        given = context._gateway.new_array(lang.Object, 4)
        given[0], given[1] = context._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        call.invoke(lang.management.ManagementFactory.getPlatformMBeanServer(), given)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def crc_mod(key: str | Column, n: int) -> Column:
    """crc32 of the key as text, modulo n. A null key gives null."""
    c = F.col(key) if isinstance(key, str) else key
    return F.crc32(c.cast("string").cast("binary")) % n


def bounded_sample(df: DataFrame, key: str, size: int, seed: int) -> DataFrame:
    """About `size` rows, chosen by a hash of the key: the same rows on every run, at most 2 * size of them.

    All rows are taken where there are no more than `size`. Rows whose key is null are left out.
    """
    df = df.filter(F.col(key).isNotNull())
    total = df.count()
    if total <= size:
        return df
    cut = int(size / total * (1 << 30))
    return df.filter(F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), F.lit(1 << 30)) < cut).limit(2 * size)


def slices(batch: pa.RecordBatch, text_at: int) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of SLICE_ROWS rows and about SLICE_BYTES of text."""
    import pyarrow.compute as pc

    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and (held + n > SLICE_BYTES or i - start >= SLICE_ROWS):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    yield batch.slice(start)


def map_texts(docs: DataFrame, build: Callable[[], Callable[[list], list]], outputs: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, *outputs) computed from text, one per input row, in Arrow batches without a shuffle.

    build() runs once in each task and returns a function from a list of texts (None where null) to one
    array or list per output column. Only key and text are read, so other columns may have any name.
    """
    tune(docs.sparkSession)
    kind = dict(docs.dtypes)[key]
    schema = f"`{key}` {kind}, {outputs}"
    df = docs.select(key, text)
    arrow = to_arrow_schema(df.limit(0).mapInArrow(lambda it: it, schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = None
        for batch in batches:
            for part in slices(batch, 1):
                step = step or build()
                columns = step(part.column(1).to_pylist())
                arrays = [part.column(0).cast(arrow.field(0).type)]
                for field, c in zip(list(arrow)[1:], columns, strict=True):
                    arrays.append(c.cast(field.type) if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, type=field.type))
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, schema)


#: Bytes of a table that is broadcast at once, what a row takes besides its key, and how many such blocks there may be.
BROADCAST, ROW, MOST_BROADCASTS = 64 << 20, 64, 16


def broadcasts(table: DataFrame, key: str) -> list[DataFrame] | None:
    """The table in parts that can be broadcast, by their measured size; None where there would be more than MOST_BROADCASTS of them."""
    n, size = table.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.col(key).cast("string")))).first()
    parts = max(1, -(-(ROW * n + (size or 0)) // BROADCAST))
    if parts > MOST_BROADCASTS:
        return None
    return [F.broadcast(table.filter(F.pmod(F.xxhash64(*table.columns), F.lit(parts)) == k) if parts > 1 else table) for k in range(parts)]


class Sorted:
    """Distinct 64-bit keys in order, and a table of flags that spares most searches for others."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        self.mask = np.uint64((1 << max(10, (8 * len(keys)).bit_length())) - 1)
        self.flags = np.zeros(int(self.mask) + 1, dtype=bool)
        self.flags[keys & self.mask] = True

    def __reduce__(self):
        return Sorted, (self.keys,)

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the wanted keys there are, and their places."""
        maybe = np.flatnonzero(self.flags[wanted & self.mask])
        at = np.searchsorted(self.keys, wanted[maybe])
        at[at == len(self.keys)] = 0
        there = self.keys[at] == wanted[maybe] if len(self.keys) else np.zeros(0, bool)
        return maybe[there], at[there]


def packed(first: np.ndarray, *others: np.ndarray) -> bytes:
    """64-bit columns, the first in order: its differences and the others in planes of bytes, most of which are empty."""
    planes = [np.ascontiguousarray(x.view(np.uint8).reshape(len(first), -1).T).tobytes() for x in (np.diff(first, prepend=np.uint64(0)), *others)]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpacked(blob: bytes, columns: int) -> list[np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8).reshape(8 * columns, -1)
    first, *others = (np.ascontiguousarray(planes[8 * k : 8 * k + 8].T).reshape(-1).view(np.uint64) for k in range(columns))
    return [np.cumsum(first, dtype=np.uint64), *others]
