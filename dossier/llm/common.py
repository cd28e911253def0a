"""Shared helpers of the corpus operators: reading tables, durable intermediates, file access."""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    set_by_caller = spark.sparkContext.getCheckpointDir()
    if not set_by_caller:
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="dossier-"))
        set_by_caller = spark.sparkContext.getCheckpointDir()
    return set_by_caller.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/dossier-{uuid.uuid4().hex[:12]}/{label}"


def scratch(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as Parquet into the shared folder and reread it: the lineage ends there and lost executors lose nothing."""
    path = shared_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(column: str, modulus: int):
    """crc32 of a value's decimal text, modulo `modulus`."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def filesystem(uri: str):
    """(pyarrow file system, path) for a URI or plain path."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), urlparse(uri).path
    return fs.FileSystem.from_uri(uri)


def local_copy(uri: str) -> str:
    """A path that can be memory-mapped: the file itself if it is on a mounted file system, else a cached download."""
    store, path = filesystem(uri)
    if store.type_name == "local":
        return path
    cached = os.path.join(tempfile.gettempdir(), "dossier-" + uuid.uuid5(uuid.NAMESPACE_URL, uri).hex)
    if not os.path.exists(cached):
        part = f"{cached}.{os.getpid()}"
        with store.open_input_stream(path) as source, open(part, "wb") as sink:
            while block := source.read(1 << 22):
                sink.write(block)
        os.replace(part, cached)
    return cached
