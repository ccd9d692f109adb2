"""Stored result tables and fingerprints of source files."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    columns: Sequence[str] | None = None,
    equals: Mapping[str, Any] | None = None,
) -> DataFrame:
    """Read a Parquet table; equality filters and the column list reach the scan."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    table = reader.parquet(path)
    for column, value in (equals or {}).items():
        table = table.where(F.col(column) == F.lit(value))
    return table.select(*columns) if columns else table


_BLOCK_BYTES = 8 << 20


def _store_options(spark: SparkSession) -> dict[str, str]:
    """The settings of the object stores that Spark itself reads with, for the same access from within a task."""
    names = {
        "fs.s3a.access.key": "access_key",
        "fs.s3a.secret.key": "secret_key",
        "fs.s3a.session.token": "session_token",
        "fs.s3a.endpoint": "endpoint_override",
        "fs.s3a.endpoint.region": "region",
    }
    conf = spark._jsc.hadoopConfiguration()
    return {option: value for name, option in names.items() if (value := conf.get(name))}


def open_stream(uri: str, s3_options: Mapping[str, str]):
    """A file as a stream of bytes, by the address that Hadoop knows it under."""
    scheme, _, rest = uri.partition(":")
    if scheme in ("s3", "s3a", "s3n"):
        from pyarrow.fs import S3FileSystem

        return S3FileSystem(**s3_options).open_input_stream(rest.lstrip("/"))
    # Hadoop writes local files as file:/path, Arrow expects file:///path.
    system, location = FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))
    return system.open_input_stream(location)


def sha256_of(stream, block_bytes: int = _BLOCK_BYTES) -> str:
    """SHA-256 of a stream, read into one buffer again and again."""
    digest, buffer = hashlib.sha256(), bytearray(block_bytes)
    view = memoryview(buffer)
    while size := stream.readinto(buffer):
        digest.update(view[:size])
    return digest.hexdigest()


def source_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per source file: name, path, size, modification time and SHA-256 of its content.

    Files are hashed in parallel, each in one task, since the digest is sequential by definition. A file of any size goes
    the same way: its bytes pass through one buffer of a few megabytes. Spark lists the files, leaving out empty ones, and
    deals them out by size.
    """
    options = _store_options(spark)
    columns = ["name", "path", "size_bytes", "modified_at", "sha256"]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = []
            for uri in batch.column("path").to_pylist():
                with open_stream(uri, options) as stream:
                    digests.append(sha256_of(stream))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string())], names=columns)

    files = spark.read.format("binaryFile").load(path).select(
        F.element_at(F.split("path", "/"), -1).alias("name"),
        "path",
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified_at"),
    )
    return files.mapInArrow(hashed, T.StructType([*files.schema.fields, T.StructField("sha256", T.StringType())]))
