"""What the corpus operators share: reading tables, and cutting lineage in the cluster's shared folder."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.shared import shared_folder

#: Bytes of a column that a Python worker handles at once, if they are in more than one row.
SLICE_BYTES = 4 << 20
_made: dict[str, object] = {}
#: Rows of a few numbers each that may be broadcast; what has more is shuffled.
BROADCAST_ROWS = 400_000
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: later stages restart from there, not from df's plan."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")  # else what was shuffled stays on disk until the driver happens to collect its garbage
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Deletes the table behind a frame from cut(), once nothing will read it again."""
    jvm = df.sparkSession._jvm
    for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def free_name(name: str, taken: list[str]) -> str:
    """A column name like name that isn't taken; names differ in more than case."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name


def small(df: DataFrame) -> DataFrame:
    """df, a table of narrow rows, marked for broadcast if it has few enough of them; its rows are counted first."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def sliced(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each has at most so many bytes of a string column, or one row.

    What a worker no longer needs goes back to the system at the end: workers outlive their tasks.
    """
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(b):
            done = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
            yield b.slice(at, stop - at)
            at = stop
        b = ends = None
    release()


def release() -> None:
    """Gives a worker's free memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc: nothing to trim
        pass


def once(key: str, build: Callable[[], object]) -> object:
    """What build makes, kept by a worker for the query of that key, until another query wants something else."""
    if key not in _made:
        _made.clear()
        _made[key] = build()
    return _made[key]
