"""Shared plumbing of the training-data operators: Arrow batches, durable cuts, null-safe text.

Every operator takes a DataFrame and returns one; the helpers here keep three promises:

* a lineage cut is a reliable checkpoint in the folder that the session names
  (``spark.checkpoint.dir``), never a local one;
* Python kernels see small Arrow batches, so one very long text does not drag
  thousands of others into memory with it;
* scratch columns are named so that they cannot clash with a caller's columns.
"""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch handed to a Python kernel over whole texts.
BATCH_ROWS = 256
#: Bytes of text that a kernel turns into numpy arrays at once.
CHUNK_BYTES = 2 << 20


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the session names; a temporary one only where none is named (tests)."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    now = sc._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return now.get()
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="maskwright-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` durably and forget its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle and checkpoint files of frames that are gone: it does so when its driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound Arrow batches of this session; a smaller bound that is already set stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


#: What this worker remembers between tasks, by operator: a key and what was made for it.
_remembered: dict[str, tuple[object, object]] = {}


def remember(owner: str, key: object, make: Callable[[], object]):
    """What ``make`` gives, kept in this worker for ``owner`` until another key or another operator comes."""
    if owner not in _remembered or _remembered[owner][0] != key:
        _remembered.pop(owner, None)
        _remembered[owner] = (key, make())
    return _remembered[owner][1]


def forget(but: str | None = None) -> None:
    """Drop what other operators remember in this worker and give the memory back."""
    others = [owner for owner in _remembered if owner != but]
    if not others:
        return
    for owner in others:
        del _remembered[owner]
    gc.collect()
    give_back()


def give_back() -> None:
    """Return memory that is free inside this process to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc keeps freed memory otherwise
    if trim is not None:
        trim(0)


def map_batches(df: DataFrame, kernel: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str, owner: str | None = None) -> DataFrame:
    """``mapInArrow`` with bounded batches; a worker forgets what operators other than ``owner`` made it remember, and with no owner frees all it used."""
    small_batches(df.sparkSession)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(owner)
        yield from kernel(batches)
        if owner is None:
            give_back()

    return df.mapInArrow(alone, schema)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of an Arrow text column, null as the empty string."""
    return [x or "" for x in column.to_pylist()]


def bytes_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of an Arrow text column, null as no bytes."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def chunks(sizes: list[int], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of about ``limit`` bytes, one item at least in each."""
    lo, total = 0, 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > limit:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: str = "text"):
    """UTF-8 length of a text column, null as 0."""
    return F.coalesce(F.octet_length(F.col(column)), F.lit(0)).cast("long")


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file (a parameter everywhere; this is only the default)."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
