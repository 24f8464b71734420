"""What the operators share: whole texts of a table, the shared folder, and broadcast bounds."""

from __future__ import annotations

import gc
import os
import re
import sys
import uuid

import numpy as np
from pyarrow import fs
from pyspark import SparkFiles
from pyspark.broadcast import Broadcast
from pyspark.cloudpickle import dumps, loads, register_pickle_by_value
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsentry.session import ensure_checkpoint_dir

register_pickle_by_value(sys.modules[__name__])

#: The characters of [\x20\x09-\x0D] and the ASCII letters.
SPACES = " \t\n\x0b\x0c\r"
#: Bytes of rows that are handed to Python at a time where Spark's own setting has not been changed.
BATCH_BYTES = 4 << 20
_BATCHES, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns `doc_id` and `text` only, whatever else the table holds; a null text counts as empty."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                     F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's address below the checkpoint folder, which all executors see."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def file_store(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's address, and its path there."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", folder))


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet in the shared folder and read back; cuts its lineage."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let the driver go of what earlier work has left: its shuffles, broadcasts, plans, and the memory they took."""
    gc.collect()
    spark._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """Batches of texts on their way to Python hold `BATCH_BYTES`, unless the session has set a size of its own."""
    if spark.conf.get(_BATCHES) == _BATCH_DEFAULT:
        spark.conf.set(_BATCHES, f"{BATCH_BYTES}b")


def text_bytes(texts: DataFrame) -> int:
    return texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0


class Shipped:
    """An object that travels to the executors once, with its class, so that they need no installation."""

    def __init__(self, spark: SparkSession, value):
        self.sent: Broadcast = spark.sparkContext.broadcast([dumps(value)])

    @property
    def value(self):
        """The object, made once in a worker; its packed form is let go."""
        held = self.sent.value
        if isinstance(held[0], bytes):
            held[0] = loads(held[0])
        return held[0]


class Mapped:
    """An array that travels as a file, once to each executor, where all workers map it: it is no worker's own memory."""

    def __init__(self, spark: SparkSession, array: np.ndarray):
        self.name = f"{uuid.uuid4().hex}.npy"
        path = os.path.join(os.path.realpath(SparkFiles.getRootDirectory()), self.name)  # Spark clears it away at the end
        np.save(path, array)
        spark.sparkContext.addFile(path)

    @property
    def array(self) -> np.ndarray:
        return np.asarray(np.load(SparkFiles.get(self.name), mmap_mode="r"))
