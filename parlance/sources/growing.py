"""Text files that grow, as a stream: what was appended since the last batch, in byte ranges.

Every file system that pyarrow reads will do. What a batch has is written to a log before it is read: one small file of
(file, from, to) a batch, so that an offset is a number, a batch can be read again after a failure, and a restart knows
how far each file was read. No text passes through the driver, which only looks for the last line end of a grown file.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from parlance.operators.turns import running_count

SCHEMA = "file_id string, at long, value string"
#: Bytes of a file that one task reads; lines that begin in them are its own.
RANGE_BYTES = 64 << 20
CHUNK_BYTES = 4 << 20
#: Bytes of a file whose lines are numbered in one go.
SEGMENT_BYTES = 16 << 20


@dataclass
class Range(InputPartition):
    """Lines of ``file`` that begin from ``low`` up to ``high``; nothing before ``first`` or from ``end`` on belongs to the batch."""

    file: str
    first: int
    low: int
    high: int
    end: int


class GrowingLines(DataSource):
    """Options: path, log (a folder of its own, kept with the checkpoint), suffix (.jsonl), rangeBytes, mostBytes (of a batch; 0: no bound)."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> GrowingReader:
        return GrowingReader(dict(self.options))


class GrowingReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.log, self.suffix = options["path"].rstrip("/"), options["log"].rstrip("/"), options.get("suffix", ".jsonl")
        self.range_bytes, self.most = int(options.get("rangebytes", options.get("rangeBytes", RANGE_BYTES))), int(options.get("mostbytes", options.get("mostBytes", 0)))
        self.read_to: dict[str, int] | None = None
        self.batch = 0

    def initialOffset(self) -> dict:
        return {"batch": 0}

    def known(self) -> dict[str, int]:
        """How far each file is in the log, which is read once."""
        if self.read_to is None:
            where, root = fs.FileSystem.from_uri(self.log)
            where.create_dir(root)
            self.read_to = {}
            found = [x for x in where.get_file_info(fs.FileSelector(root)) if x.base_name.endswith(".json")]
            for x in sorted(found, key=lambda x: x.base_name):
                self.batch = max(self.batch, int(x.base_name.removesuffix(".json")))
                self.read_to.update((e["file"], e["to"]) for e in self.entries(int(x.base_name.removesuffix(".json"))))
        return self.read_to

    def entries(self, batch: int) -> list[dict]:
        where, root = fs.FileSystem.from_uri(self.log)
        with where.open_input_stream(f"{root}/{batch:012d}.json") as f:
            return [json.loads(x) for x in f.read().decode().splitlines()]

    def latestOffset(self) -> dict:
        known = self.known()
        where, root = fs.FileSystem.from_uri(self.path)
        entries, total = [], 0
        for x in sorted(where.get_file_info(fs.FileSelector(root, recursive=True)), key=lambda x: x.path):
            file = x.path[len(root) :].lstrip("/")
            if not x.is_file or not file.endswith(self.suffix) or x.base_name.startswith("._") or x.size <= known.get(file, 0):
                continue
            to = last_line_end(where, x.path, known.get(file, 0), x.size)
            if to > known.get(file, 0):
                entries.append({"file": file, "from": known.get(file, 0), "to": to})
                total += to - known.get(file, 0)
            if self.most and total >= self.most:
                break
        if entries:
            self.batch += 1
            out, folder = fs.FileSystem.from_uri(self.log)
            with out.open_output_stream(f"{folder}/{self.batch:012d}.part") as f:
                f.write("\n".join(map(json.dumps, entries)).encode())
            out.move(f"{folder}/{self.batch:012d}.part", f"{folder}/{self.batch:012d}.json")
            known.update((e["file"], e["to"]) for e in entries)
        return {"batch": self.batch}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        told = [e for k in range(start["batch"] + 1, end["batch"] + 1) for e in self.entries(k)]
        return [Range(e["file"], e["from"], low, min(low + self.range_bytes, e["to"]), e["to"]) for e in told for low in range(e["from"], e["to"], self.range_bytes)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        where, root = fs.FileSystem.from_uri(self.path)
        with where.open_input_file(f"{root}/{partition.file}") as f:
            for starts, values in lines_from(f, partition):
                yield pa.RecordBatch.from_arrays([pa.array([partition.file] * len(values)), pa.array(starts, pa.int64()), pa.array(values, pa.string())], names=["file_id", "at", "value"])


def last_line_end(where: fs.FileSystem, path: str, start: int, size: int) -> int:
    """The place after the last line end from ``start`` on; ``start`` if there is none. A line without end is not done yet."""
    with where.open_input_file(path) as f:
        high = size
        while high > start:
            low = max(start, high - CHUNK_BYTES)
            f.seek(low)
            found = f.read(high - low).rfind(b"\n")
            if found >= 0:
                return low + found + 1
            high = low
    return start


def lines_from(f, r: Range) -> Iterator[tuple[list[int], list[str]]]:
    """(first bytes, texts) of the lines that begin in ``r``, a chunk at a time. Bytes that aren't UTF-8 are replaced."""
    at = r.low
    if r.low > r.first:  # a line that begins before is another task's
        at = r.low - 1
        f.seek(at)
        while at < r.end:
            chunk = f.read(min(CHUNK_BYTES, r.end - at))
            found = chunk.find(b"\n")
            if found >= 0:
                at += found + 1
                break
            at += len(chunk)
    f.seek(at)
    rest = b""
    place = at
    while at < r.high or rest:
        chunk = f.read(min(CHUNK_BYTES, r.end - place)) if place < r.end else b""
        place += len(chunk)
        *whole, rest = (rest + chunk).split(b"\n")
        starts, values = [], []
        for x in whole:
            if at >= r.high:
                break
            starts.append(at)
            values.append(x.removesuffix(b"\r").decode("utf-8", "replace"))
            at += len(x) + 1
        if starts:
            yield starts, values
        if at >= r.high or not chunk:
            return


def growing_lines(spark: SparkSession, root: str, log: str, range_bytes: int = RANGE_BYTES, most_bytes: int = 0) -> DataFrame:
    """(file_id, at, value): the lines of the transcripts under ``root`` as they are appended; ``at`` is a line's first byte.

    A file that grows gives its new lines alone; a line counts once it has its end. A file that shrinks is left alone.
    """
    spark.dataSource.register(GrowingLines)
    stream = spark.readStream.format("growing_lines").option("path", root).option("log", log)
    return stream.option("rangeBytes", range_bytes).option("mostBytes", most_bytes).load()


def numbered(lines: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """``lines`` (file_id, at, value) of a batch with line_no, from 1: after the ``lines`` that ``before`` (file_id, lines) tells of each file.

    Lines are counted by segments of a file, then over the segments' sums, so a large file is no single task.
    """
    told = running_count(lines, F.lit(True), "line_no", order="at", segment=SEGMENT_BYTES)
    if before is None:
        return told
    return told.join(before.select("file_id", F.col("lines").alias("_lines")), "file_id", "left").withColumn("line_no", F.col("line_no") + F.coalesce("_lines", F.lit(0))).drop("_lines")
