"""What the operators share: the shared folder, stored intermediates, task sizes, text batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: How to empty what a worker remembers between its tasks, by name.
MEMOS: dict[str, Callable[[], None]] = {}

#: Rows of an Arrow batch that are turned into Python objects at a time.
SLICE = 512


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors reach: spark.checkpoint.dir.

    Only a local session that has none gets a folder of its own.
    """
    key = "spark.checkpoint.dir"
    folder = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError(f"set {key} to a folder that all executors reach")
        folder = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set(key, folder)
    return folder.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and continue from the files."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    fields = [T.StructField(f.name, f.dataType) for f in df.schema]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def shuffle_tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def use_memo(name: str | None) -> None:
    """Empty all memos but `name`: a worker that goes over to other work gives their memory back."""
    for other, forget in MEMOS.items():
        if other != name:
            forget()


def slices(batches: Iterator[pa.RecordBatch], size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that few texts are Python objects at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            yield batch.slice(start, size)
    pa.default_memory_pool().release_unused()  # workers are used again


def texts(column: pa.Array) -> list[str]:
    """Python strings; null is the empty text."""
    return [t or "" for t in column.to_pylist()]
