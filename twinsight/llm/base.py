"""What the operators of this subpackage share: inputs, staging, Arrow batches."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=1)
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="twinsight-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where the setting is absent and master is one machine (tests,
    notebooks) a local temporary folder stands in for it; on a cluster the
    setting is a must.
    """
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not top and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{top or _own_dir()}/{spark.sparkContext.applicationId}"


#: Paths given out, in order.
_given: list[str] = []


def new_path(spark: SparkSession, what: str) -> str:
    """A path of its own in the shared folder; the application's folder is deleted when the driver ends."""
    top = shared_dir(spark)
    if not any(path.startswith(top) for path in _given):
        at = spark._jvm.org.apache.hadoop.fs.Path(top)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(at)
        fs.deleteOnExit(at)
    _given.append(f"{top}/{what}-{uuid.uuid4().hex}")
    return _given[-1]


def mark() -> int:
    """Where the paths given out from now on begin."""
    return len(_given)


def stage(df: DataFrame, what: str = "stage") -> DataFrame:
    """Writes df to the shared folder and returns a scan of it.

    Cuts lineage with committed files, so that a lost executor costs only its
    running tasks and no upstream work is done twice.
    """
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path with all below it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def settle(df: DataFrame, what: str, since: int) -> DataFrame:
    """Stages df, and deletes what was staged since `since` to get there."""
    done = stage(df, what)
    for path in _given[since:-1]:
        remove(df.sparkSession, path)
    _given[since:] = _given[-1:]
    return done


def release(spark: SparkSession) -> None:
    """Deletes everything this application has staged; results that were not written yet go with it."""
    remove(spark, shared_dir(spark))


#: Bytes of a slice that a Python function works on at once; a larger single row is a slice of its own.
SLICE_BYTES = 8 << 20


def slices(batch: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about `most` bytes."""
    parts = max(1, -(-batch.get_total_buffer_size() // most))
    step = max(1, -(-batch.num_rows // parts))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Applies fn to slices of each Arrow batch, so that memory follows neither partitions nor batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, slice_bytes):
                if (out := fn(part)).num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def column_of(fn: Callable[..., pa.Array], slice_bytes: int = SLICE_BYTES, kind: str = "double") -> Callable:
    """A column from Arrow columns, worked out slice by slice; all other columns stay in the JVM."""

    def run(parts: Iterator) -> Iterator[pa.Array]:
        for part in parts:
            columns = part if isinstance(part, tuple) else (part,)
            whole = pa.RecordBatch.from_arrays(list(columns), [str(k) for k in range(len(columns))])
            done = [fn(*piece.columns) for piece in slices(whole, slice_bytes)] or [fn(*whole.columns)]
            yield pa.concat_arrays(done)

    def one(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return run(parts)

    def several(parts: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        return run(parts)

    return lambda *columns: F.arrow_udf(one if len(columns) == 1 else several, kind)(*columns)


def tokenizer_path(name: str) -> str:
    """Where this machine has a public vocabulary file; an absolute path stays as it is."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
