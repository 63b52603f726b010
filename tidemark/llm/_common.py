"""What the operators share: the scratch folder, stored tables, Arrow functions and their memory, hold-out fold, samples."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of an Arrow batch to a Python worker; such batches are held in the executor and in the worker.
BATCH_BYTES = 8 << 20
_STORES: dict[tuple, Any] = {}


def released() -> None:
    """Gives memory that this process has freed back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def worker_store(name: tuple, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps for its next tasks: one store, so another one's name drops it."""
    if name not in _STORES:
        _only(None)
        _STORES[name] = make()
    return _STORES[name]


def _only(kind: str | None) -> None:
    """Drops a store of another kind."""
    if any(name[0] != kind for name in _STORES):
        _STORES.clear()
        released()


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType, store: str | None = None) -> DataFrame:
    """df.mapInArrow(run, schema) with small batches; a task that ends gives its memory back.

    Of what its worker has kept, a task leaves only the kind of store it uses. Batches are bounded by a setting of the
    session, as Spark has no other way; a smaller one is left as it is.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(name, "64m").removesuffix("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))

    def ending(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _only(store)
        yield from run(batches)
        released()

    # mapInArrow takes its input's columns by name, and a name with a dot for a field; run takes callers' columns by place.
    return df.toDF(*(f"column {i}" if "." in x or "`" in x else x for i, x in enumerate(df.columns))).mapInArrow(ending, schema)


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or (unset, in local mode as in tests) one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/tidemark-{uuid.uuid4().hex}/{name}"


def stored(df: DataFrame, name: str = "table", path: str | None = None) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts lineage and survives lost executors."""
    path = path or new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a stored table that nothing will read again."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fold(doc_id: Column | str, folds: int = 3) -> Column:
    """crc32 of the id's decimal text modulo folds; null for a null id."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def bounded(df: DataFrame, key: str, limit: int, rows: int | None = None, salt: int = 0) -> DataFrame:
    """About limit rows at most, chosen by a hash of key, so that a rerun chooses the same; all rows if fewer."""
    rows = df.count() if rows is None else rows
    if rows <= limit:
        return df
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit(salt)), F.lit(1 << 20)) < F.lit(int(limit / rows * (1 << 20))))


def small(df: DataFrame, limit: int = 1_000_000) -> DataFrame:
    """Broadcast hint if a count shows at most limit rows (of a few numbers each); else left to shuffle."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
