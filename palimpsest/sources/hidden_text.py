"""Lines of text files that Spark's readers skip because their names begin with an underscore.

A Python data source with a listing of its own: files are cut into byte ranges, and each range is
read by one task, from the first line that begins in it to the last.
"""

from __future__ import annotations

import fnmatch
import io
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RANGE_BYTES = 64 << 20
ROWS = 4096  # of a batch


class Range(InputPartition):
    def __init__(self, path: str, begin: int, end: int):
        self.path, self.begin, self.end = path, begin, end


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class HiddenTextReader(DataSourceReader):
    def __init__(self, path: str, pattern: str, size: int):
        self.path, self.pattern, self.size = path, pattern, size

    def partitions(self) -> list[Range]:
        files, root = _opened(self.path)
        prefix = self.path[: len(self.path) - len(root)] if self.path.endswith(root) else ""
        own = files.get_file_info(root)
        out = []
        for info in [own] if own.is_file else files.get_file_info(fs.FileSelector(root, recursive=True)):
            if info.is_file and info.base_name.startswith("_") and fnmatch.fnmatch(info.base_name, self.pattern):
                out += [
                    Range(prefix + info.path, at, min(info.size, at + self.size)) for at in range(0, info.size, self.size)
                ]
        return out

    def read(self, part: Range | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # there are no files
            return
        files, path = _opened(part.path)
        found: list[tuple[str, int, int, str]] = []
        with files.open_input_file(path) as opened:
            raw = io.BufferedReader(opened, 1 << 20)
            at = part.begin
            if at:  # the line that runs into this range belongs to the one before
                raw.seek(at - 1)
                at += len(raw.readline()) - 1
            raw.seek(at)
            while at < part.end:
                line = raw.readline()
                if not line:
                    break
                text = line.decode("utf-8", "replace").rstrip("\n").removesuffix("\r").removeprefix("\ufeff")
                found.append((part.path, part.begin, at, text))
                at += len(line)
                if len(found) == ROWS:
                    yield self._batch(found)
                    found = []
        if found:
            yield self._batch(found)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
        columns = [pa.array(c, type=t) for c, t in zip(zip(*rows), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=["path", "block", "pos", "line"])


class HiddenText(DataSource):
    """Options: path, pattern (of names), size (bytes of a range)."""

    @classmethod
    def name(cls) -> str:
        return "hidden_text"

    def schema(self) -> str:
        return "path string, block bigint, pos bigint, line string"

    def reader(self, schema) -> HiddenTextReader:
        size = int(self.options.get("size", RANGE_BYTES))
        return HiddenTextReader(self.options["path"], self.options.get("pattern", "*.txt"), size)


def read_hidden_lines(spark: SparkSession, path: str, suffix: str = "*.txt", size: int = RANGE_BYTES) -> DataFrame:
    """(path, block, pos, line) of the files under ``path`` whose names begin with an underscore.

    Python opens local files, HDFS and the object stores that pyarrow knows; of other stores nothing
    is read, with a warning.
    """
    try:
        _opened(path)
    except (pa.ArrowInvalid, NotImplementedError) as error:
        warnings.warn(f"files with names like _chat.txt are not read: {error}", stacklevel=2)
        return spark.createDataFrame([], "path string, block bigint, pos bigint, line string")
    spark.dataSource.register(HiddenText)
    reader = spark.read.format("hidden_text").option("path", path).option("pattern", suffix)
    return reader.option("size", str(size)).load()
