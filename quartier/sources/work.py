"""Working folders that driver and executors share."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder of spark.checkpoint.dir; where that is unset and Spark runs on one machine, in /tmp."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file:///tmp/spark-shared-{spark.sparkContext.applicationId}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written to a new folder and read again, for what several jobs use."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def blocks(df: DataFrame, size: int, name: str) -> list[str]:
    """Writes the rows in files of about ``size`` rows to the shared folder, for tasks that read one after the other; the files' places.

    Every file is written by a task and appears whole; a repeated task writes one of its own, and only that is named.
    """
    at = folder(df.sparkSession, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        held = list(batches)
        if sum(b.num_rows for b in held):
            store, path = fs.FileSystem.from_uri(at)
            store.create_dir(path, recursive=True)
            mine = uuid.uuid4().hex
            with store.open_output_stream(f"{path}/.{mine}") as out, pa.ipc.new_file(out, held[0].schema) as file:
                for b in held:
                    file.write_batch(b)
            store.move(f"{path}/.{mine}", f"{path}/{mine}")
            yield pa.RecordBatch.from_arrays([pa.array([f"{at}/{mine}"])], names=["file"])

    number = max(1, -(-df.count() // size))
    return sorted(r.file for r in df.repartition(number).mapInArrow(run, "file string").collect())


@functools.lru_cache(maxsize=4)
def read_block(file: str) -> pa.Table:
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(file)
    with store.open_input_file(path) as source:
        return pa.ipc.open_file(source).read_all()
