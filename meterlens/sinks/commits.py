"""A log of numbered entries below a folder, each number claimed by exactly one writer.

An entry is one JSON file, named by its number. It is written whole under another name first and then put into its place
only if that place is free: through a hard link on a local file system, elsewhere through the Hadoop rename that refuses
to overwrite. So readers see whole entries only, and two writers never share a number, whatever their clocks say.

The rename is atomic on HDFS and on stores with a hierarchical namespace. Stores that emulate renames by copying need a
single writer at a time.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

_DIGITS = 12


class CommitLog:
    """Appends entries below `folder` (any Hadoop path) and reads them as a table."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        files = jvm.org.apache.hadoop.fs
        self._path = files.Path
        self._system = files.Path(folder).getFileSystem(conf)
        self.folder = self._system.makeQualified(files.Path(folder)).toString().rstrip("/")
        self._local = self._system.getScheme() == "file"
        self._context = files.FileContext.getFileContext(files.Path(self.folder).toUri(), conf)
        self._refuse = spark.sparkContext._gateway.new_array(files.Options.Rename, 1)
        self._refuse[0] = files.Options.Rename.NONE

    def _numbers(self) -> list[int]:
        folder = self._path(self.folder)
        if not self._system.exists(folder):
            return []
        names = [status.getPath().getName() for status in self._system.listStatus(folder)]
        return sorted(int(n[:_DIGITS]) for n in names if n[:_DIGITS].isdigit() and n.endswith(".json"))

    def last(self) -> int:
        """The highest number in use; 0 for an empty log."""
        return max(self._numbers(), default=0)

    def _put_if_absent(self, written, number: int) -> bool:
        place = self._path(f"{self.folder}/{number:0{_DIGITS}d}.json")
        if self._local:
            try:
                os.link(written.toUri().getPath(), place.toUri().getPath())
            except FileExistsError:
                return False
            return True
        try:
            self._context.rename(written, place, self._refuse)
        except Exception as problem:  # the Java exception says why
            if "FileAlreadyExistsException" in str(getattr(problem, "java_exception", problem)):
                return False
            raise
        return True

    def append(self, entry: Mapping[str, Any]) -> int:
        """Store the entry under the next free number and return it; the number is part of what is stored."""
        number = self.last() + 1
        self._system.mkdirs(self._path(self.folder))
        while True:
            # Names that begin with an underscore are no data for Spark's readers.
            written = self._path(f"{self.folder}/_claim-{uuid.uuid4().hex}")
            with_number = json.dumps({"number": number, **entry}, default=str) + "\n"
            stream = self._system.create(written, False)
            try:
                stream.write(bytearray(with_number.encode()))
            finally:
                stream.close()
            try:
                if self._put_if_absent(written, number):
                    return number
            finally:
                self._system.delete(written, False)
            number += 1

    def read(self, schema: str) -> DataFrame | None:
        """All entries; None for an empty log."""
        if not self._numbers():
            return None
        return self.spark.read.schema(f"number long, {schema}").json(f"{self.folder}/*.json")
