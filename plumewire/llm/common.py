"""Shared helpers: reading tables, stage tables in the shared folder, Arrow batch bounds."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handed to a Python worker at once; long texts make a row large, so this stays small.
BATCH_ROWS = 256
#: Bytes of such a batch, about; one longer text is a batch of its own.
BATCH_BYTES = 2 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once, so that their Python workers can import it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="plumewire-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


_caches: dict[str, Callable[[], None]] = {}


def only_cache(name: str = "", clear: Callable[[], None] | None = None) -> None:
    """Called as an operator's task starts: what other operators keep in this Python worker goes."""
    for other in [k for k in _caches if k != name]:
        _caches.pop(other)()
    if clear:
        _caches[name] = clear


def give_back() -> None:
    """Memory that this process has freed goes back to the machine: an idle worker shouldn't hold it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


_held_down = False


def hold_down() -> None:
    """Arrow's memory comes from the process's own allocator, and arrays of some megabytes are mapped on their own, so
    that what is freed goes back to the machine at once."""
    global _held_down
    if not _held_down:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            ctypes.CDLL(None).mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD
        except (AttributeError, OSError):  # another C library
            pass
        _held_down = True


def lean(run: Callable, name: str = "", clear: Callable[[], None] | None = None) -> Callable:
    """``run`` over a task's batches, with one operator's caches at a time and freed memory given back at the end.
    ``clear`` is a function of a module: a method of a cache would come to the worker with a copy of the cache."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_down()
        only_cache(name, clear)
        give_back()
        yield from run(batches)
        give_back()

    return task


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough that a batch of very long texts fits in a Python worker."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.  Only on one machine, where the session names none, a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="plumewire-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have ended
        pass


_staged: list[str] = []


def drop_stages(spark: SparkSession) -> None:
    """Remove the stage tables so far, whose results must have been read by now; a long session calls this between
    queries, and the driver's end does."""
    while _staged:
        remove(spark, _staged.pop())


def at_the_end(spark: SparkSession, path: str) -> None:
    """The table at ``path`` goes when stage tables go."""
    _staged.append(path)
    if len(_staged) == 1:
        atexit.register(drop_stages, spark)


@contextlib.contextmanager
def dropping_stages(spark: SparkSession) -> Iterator[None]:
    """The stage tables that are written inside go at the end; what was made from them must have been written by then."""
    before = len(_staged)
    yield
    while len(_staged) > before:
        remove(spark, _staged.pop())


def stage(df: DataFrame, name: str, out: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: the lineage ends there,
    so a lost executor costs a read and not a recomputation.  ``out`` is a folder of the caller's, who keeps it."""
    spark = df.sparkSession
    path = out or f"{shared_dir(spark)}/plumewire/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    if not out:
        at_the_end(spark, path)
    return spark.read.schema(schema).parquet(path)


def text_bytes(docs: DataFrame, *keep: str) -> DataFrame:
    """The id column and the UTF-8 bytes of the text; other columns of the input are left behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, F.col("text").cast("binary").alias("body"))


#: Ids that a join may broadcast (16 MB of them); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def by_ids(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """``rows`` with (left_semi) or without (left_anti) the doc_ids of ``ids``, a stage table with one column
    ``doc_id``.  The texts stay where they are while the ids are few, which is checked by their count."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    name = "__pw_id"
    while name in rows.columns:
        name += "_"
    ids = ids.withColumnRenamed("doc_id", name)
    return rows.join(F.broadcast(ids) if few else ids, rows["doc_id"] == F.col(name), how)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on unsigned 64-bit arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)
