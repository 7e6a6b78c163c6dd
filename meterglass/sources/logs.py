"""Logs that grow, as a stream of lines: a data source whose offsets are byte positions per file.

Spark's own file streams read a file once and never again. Here an offset says how long every file was,
and a batch has the lines that were finished between two offsets: those whose line end lies there. A line
that was half written when the files were listed comes with the batch that has its end, whole. So what a
batch holds follows from its two offsets alone, and a batch that is run again after a failure is the same.

What was appended is cut into blocks, each a task's work, which begins before the block where a line does.
Files are listed and read with Arrow's file systems, by URI or local path.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from meterglass.session import ship_package

SCHEMA = "path string, pos bigint, value string"
#: Bytes of a file that one task reads, and that are read at once.
BLOCK, PIECE = 32 << 20, 1 << 20


def opened(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the folder's path in it."""
    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


class Block(InputPartition):
    """Bytes of a file in which lines end."""

    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def line_start(file, at: int) -> int:
    """Where the line begins that the byte ``at`` belongs to."""
    while at > 0:
        lo = max(0, at - PIECE)
        file.seek(lo)
        found = file.read(at - lo).rfind(b"\n")
        if found >= 0:
            return lo + found + 1
        at = lo
    return 0


def finished_lines(file, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Place and bytes of every line whose end lies in [start, end), however long it is."""
    pos = line_start(file, start)
    file.seek(pos)
    at, held = pos, []
    while at < end:
        piece = file.read(min(PIECE, end - at))
        if not piece:
            return
        at += len(piece)
        lines = piece.split(b"\n")
        for line in lines[:-1]:
            whole = b"".join([*held, line])
            yield pos, whole
            pos, held = pos + len(whole) + 1, []
        if lines[-1]:
            held.append(lines[-1])


class LogReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root, self.pattern = options["path"], options.get("pattern", "*")
        self.block = int(options.get("block", BLOCK))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self, *_) -> dict:
        """Each file's length; a root that is missing has no files, one that can't be read is left out."""
        system, root = opened(self.root)
        folders, out = [root], {}
        while folders:
            try:
                found = system.get_file_info(fs.FileSelector(folders.pop(), allow_not_found=True))
            except OSError:
                continue
            for info in found:
                if info.type == fs.FileType.Directory:
                    folders.append(info.path)
                elif info.type == fs.FileType.File and fnmatch.fnmatch(info.base_name, self.pattern) and info.size:
                    out[info.path] = info.size
        return out

    def partitions(self, start: dict, end: dict) -> list[Block]:
        """Blocks of what was appended; a file that is shorter than before is another one, read from its beginning."""
        out = []
        for path, size in end.items():
            at = start.get(path, 0)
            at = 0 if size < at else at
            out += [Block(path, i, min(i + self.block, size)) for i in range(at, size, self.block)]
        return out

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        """Batches of about PIECE bytes; a file that has vanished meanwhile has no lines, bytes that are no UTF-8 are replaced."""
        system, _ = opened(self.root)
        try:
            file = system.open_input_file(partition.path)
        except OSError:
            return
        with file:
            places, lines, size = [], [], 0
            for pos, line in finished_lines(file, partition.start, partition.end):
                places.append(pos)
                lines.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
                size += len(line)
                if size >= PIECE:
                    yield self._batch(partition.path, places, lines)
                    places, lines, size = [], [], 0
            if places:
                yield self._batch(partition.path, places, lines)

    @staticmethod
    def _batch(path: str, places: list[int], lines: list[str]) -> pa.RecordBatch:
        columns = [pa.array([path] * len(places)), pa.array(places, pa.int64()), pa.array(lines)]
        return pa.RecordBatch.from_arrays(columns, ["path", "pos", "value"])


class GrowingLogs(DataSource):
    """path, pos (where the line begins, in bytes) and value of every finished line.

    Options: path, the root; pattern of the files' names; block, bytes of a task. Files in folders at any
    depth count, hidden ones too. An offset names each file with some 100 bytes: split a root of millions
    of logs over streams.
    """

    @classmethod
    def name(cls) -> str:
        return "growing_logs"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> LogReader:
        return LogReader(self.options)


def log_stream(spark: SparkSession, root: str, pattern: str = "*.jsonl", block: int = BLOCK) -> DataFrame:
    """The lines of all logs below ``root`` as they are finished, each once, also over restarts from a checkpoint."""
    ship_package(spark)
    spark.dataSource.register(GrowingLogs)
    return spark.readStream.format("growing_logs").option("pattern", pattern).option("block", str(block)).load(root)
