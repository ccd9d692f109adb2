"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: A word, wherever an operator counts words: a run without ASCII white space.
WORD_GAP = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see; a temporary one only for a local master."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="meterlens-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read again: later failures don't reach behind this point."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/meterlens-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def worker_state(df: DataFrame):
    """A broadcast empty dictionary. Each Python worker keeps its own copy across tasks, for models loaded once."""
    return df.sparkSession.sparkContext.broadcast({})


def id_field(df: DataFrame, name: str, alias: str | None = None) -> T.StructField:
    return T.StructField(alias or name, df.schema[name].dataType, True)


def text_slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that the texts of a slice have `limit` bytes at most, or the slice is a single row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(np.asarray(sizes, dtype=np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop
        pa.default_memory_pool().release_unused()


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts as Python strings, null as the empty one."""
    return pc.fill_null(batch.column(column), "").to_pylist()


def fresh(df: DataFrame, name: str) -> str:
    """`name`, lengthened until no column of `df` is called so."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name
