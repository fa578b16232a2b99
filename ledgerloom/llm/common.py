"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import os
import shutil
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import ledgerloom
from ledgerloom.session import staging_path

# Lists no longer than this may be broadcast; every use counts them first and
# has a join for longer ones.
BROADCAST_ROWS = 1 << 20


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def settled(df: DataFrame, label: str) -> DataFrame:
    """``df`` written below the shared folder and read again: later steps neither
    repeat its work nor lose it with an executor."""
    spark = df.sparkSession
    path = staging_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shipped(df: DataFrame) -> DataFrame:
    """``df``, already stored, marked for broadcast if it is counted to be short; a
    longer one joins by a shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


_SENT: set[str] = set()


def send_code(spark: SparkSession) -> None:
    """Give the executors this package as one archive, once for each application, so
    that they need no install of it. Modules are imported there as anywhere else."""
    context = spark.sparkContext
    if context.applicationId not in _SENT:
        root = os.path.dirname(os.path.abspath(ledgerloom.__file__))
        made = shutil.make_archive(os.path.join(context._temp_dir, "ledgerloom"), "zip",
                                   os.path.dirname(root), os.path.basename(root))
        context.addPyFile(made)
        _SENT.add(context.applicationId)


_MEMORY: dict = {}


def remembered(key, build: Callable):
    """What ``build`` makes, kept by this worker process for later tasks that name the same
    ``key``. A worker keeps one such memory: tasks of another step free it first."""
    if key not in _MEMORY:
        forget(None)
        _MEMORY[key] = build()
    return _MEMORY[key]


def forget(key) -> None:
    """Free what this worker process keeps under other keys, also to the system."""
    if any(k != key for k in _MEMORY):
        for other in [k for k in _MEMORY if k != key]:
            del _MEMORY[other]
        gc.collect()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library has no such call
            pass


def arrow_rows(df: DataFrame, step: Callable, schema, memory=None) -> DataFrame:
    """``df.mapInArrow`` with this package at hand on the executors; ``memory`` is the key of
    the memory that ``step`` uses, if any."""
    send_code(df.sparkSession)

    def run(batches):
        forget(memory)
        yield from step(batches)

    return df.mapInArrow(run, schema)


def fresh(name: str, taken) -> str:
    """A column name that no column of ``taken`` has, in any case of letters."""
    lower = {c.lower() for c in taken}
    return name if name.lower() not in lower else f"{name}_{uuid.uuid4().hex[:8]}"


def vocabulary_file(name: str) -> str:
    """Place of a public tokenizer file; ``LEDGERLOOM_TOKENIZERS`` overrides the folder."""
    folder = os.environ.get("LEDGERLOOM_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
