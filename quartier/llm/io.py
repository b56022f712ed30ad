"""Tables of a data folder, the shared working folder, and small helpers the operators have in common."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a task works on at once, and that one Arrow batch brings it.
CHUNK = 1 << 22


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Where the setting is absent, a folder in /tmp stands for it if Spark runs on one machine, as in tests; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file:///tmp/spark-shared-{spark.sparkContext.applicationId}"
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The frame written as Parquet to the shared folder and read again, which cuts its lineage."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """The name, or with underscores after it, as no column of the frame is called."""
    while name in df.columns:
        name += "_"
    return name


def crc_mod(key: str | Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n."""
    return F.crc32((F.col(key) if isinstance(key, str) else key).cast("string").cast("binary")) % n


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, as ten thousand long texts in one batch are more than a worker should hold."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 * CHUNK))


def trim() -> None:
    """Gives freed memory back: workers are used again by other tasks, and hold what they once took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batch: pa.RecordBatch, text: str = "text", size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``size`` bytes of text each, one row at least."""
    length = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for at, n in enumerate(length.tolist()):
        if at > start and held + n > size:
            yield batch.slice(start, at - start)
            start, held = at, 0
        held += n
    if batch.num_rows > start:
        yield batch.slice(start)


def per_text(docs: DataFrame, run: Callable[..., dict], added: str, setup: Callable | None = None, size: int = CHUNK, keep_text: bool = False) -> DataFrame:
    """docs with the columns that run(texts) gives, and without ``text`` unless it is kept; all other columns pass through as Arrow has them,
    but for those that an added column replaces.

    Ids so never become floats. ``setup`` is called once in each task; what it returns goes to run as a second argument.
    """
    small_batches(docs.sparkSession)
    new = T.StructType.fromDDL(added).fields
    docs = docs.drop(*[f.name for f in new])
    kept = [c for c in docs.columns if c != "text" or keep_text]
    schema = T.StructType([*docs.select(*kept).schema.fields, *new])
    names = [f.name for f in schema.fields]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (setup(),) if setup else ()
        for batch in batches:
            for part in slices(batch, size=size):
                found = run(part.column("text").to_pylist(), *held)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [found[c] for c in names[len(kept) :]], names=names)
        del held
        trim()

    return docs.mapInArrow(apply, schema)
