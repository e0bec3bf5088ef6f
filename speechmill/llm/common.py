"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import workers_find_package

#: ASCII white space that separates words, and the same as a Java and RE2 class.
WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
WHITE_CLASS = r"[\x20\x09-\x0D]"

#: Lower-cases A-Z and leaves every other byte alone.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

UPPER_AZ, LOWER_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    workers_find_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Only a local session that names none gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir().rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back, which cuts its lineage."""
    return Scratch(df.sparkSession, name).keep(df, "whole")


class Scratch:
    """Tables of one run in the shared folder: written whole, read back without lineage, dropped when superseded.

    What a result still reads stays until the driver's JVM ends, which deletes the run's folder.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        store.mkdirs(at)
        store.deleteOnExit(at)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep_parts(self, parts: Iterable[DataFrame], name: str) -> DataFrame:
        """Writes the parts one after the other as one table; what led to one is released before the next."""
        path, schema = f"{self.path}/{name}", None
        for df in parts:
            df.write.mode("append").parquet(path)
            schema = df.schema
            del df
            self.release()
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes tables, and releases what they came from."""
        for name in names:
            _delete(self.spark, f"{self.path}/{name}")
        self.release()

    def release(self) -> None:
        """Lets Spark delete the shuffle files behind tables that are written, which it does when their plans are collected.

        The last job's plan outlives one collection, and with it the files of the table just written; so there are two.
        """
        for _ in range(2):
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()

    def drop_all(self) -> None:
        _delete(self.spark, self.path)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def lower_az(column):
    return F.translate(column, UPPER_AZ, LOWER_AZ)


def utf8_values(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def slices(batches, rows: int):
    """Arrow batches cut into pieces of at most ``rows`` rows, so that a task holds few texts at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def total_bytes(docs: DataFrame) -> tuple[int, int]:
    """Rows and UTF-8 bytes of all texts."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text_or_empty())).alias("b")).first()
    return row.n, row.b or 0


def finite_vectors(vectors: DataFrame, name: str = "embedding") -> DataFrame:
    """The rows whose vector is there and holds neither null nor a number that isn't finite."""
    good = F.forall(name, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(F.col(name).isNotNull() & good)


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths and without nulls as the rows of a float64 array."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
