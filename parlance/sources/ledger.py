"""Tables written batch by batch, whose readers see whole batches alone, each once, whatever failed in between.

A table is a folder of runs, each in a folder of its own, and a manifest: one small file a run, named by its number, put there
when the run's rows are. Readers follow the manifest, so a run that broke off is never seen. A run that was told already
is not written again, so a batch replayed after a failure adds nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from parlance.sources.growing import growing_lines, numbered
from parlance.sources.transcripts import messages_of, read_files, read_messages


class Ledger:
    """A table in ``folder``, any that pyarrow's file systems and Spark both reach."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.where, self.root = fs.FileSystem.from_uri(self.folder)
        self.where.create_dir(f"{self.root}/manifest")

    def runs(self) -> dict[int, dict]:
        """What the manifest tells, by number."""
        found = [x for x in self.where.get_file_info(fs.FileSelector(f"{self.root}/manifest")) if x.base_name.endswith(".json")]
        out = {}
        for x in sorted(found, key=lambda x: x.base_name):
            with self.where.open_input_stream(x.path) as f:
                out[int(x.base_name.removesuffix(".json"))] = json.loads(f.read())
        return out

    def has(self, run: int) -> bool:
        return self.where.get_file_info(f"{self.root}/manifest/{run:012d}.json").is_file

    def put(self, rows: DataFrame, run: int, form: str = "parquet", **facts) -> bool:
        """Write ``rows`` as a run, unless it is there; whether it was written. ``facts`` are told in the manifest.

        Of two writers of one run the last one's rows count, whole; the other's are never read.
        """
        if self.has(run):
            return False
        place = f"runs/{run:012d}-{uuid.uuid4().hex}"
        rows.write.format(form).save(f"{self.folder}/{place}")
        with self.where.open_output_stream(f"{self.root}/manifest/{run:012d}.part") as f:
            f.write(json.dumps({"place": place, "form": form, "schema": rows.schema.json(), **facts}).encode())
        self.where.move(f"{self.root}/manifest/{run:012d}.part", f"{self.root}/manifest/{run:012d}.json")
        return True

    def read(self, schema: StructType | str | None = None, last: bool = False) -> DataFrame:
        """All runs' rows, or those of the ``last`` run alone. Without runs ``schema`` is needed."""
        runs = list(self.runs().values())
        if not runs:
            if schema is None:
                raise ValueError(f"no run in {self.folder}")
            return self.spark.createDataFrame([], schema)
        return self.union(runs[-1:] if last else runs, schema)

    def of(self, run: int) -> DataFrame:
        """One run's rows."""
        return self.union([self.runs()[run]])

    def union(self, kept: list[dict], schema: StructType | str | None = None) -> DataFrame:
        shape = schema or StructType.fromJson(json.loads(kept[-1]["schema"]))
        parts = {form: [f"{self.folder}/{r['place']}" for r in kept if r["form"] == form] for form in {r["form"] for r in kept}}
        out = None
        for form, places in sorted(parts.items()):
            part = self.spark.read.format(form).schema(shape).load(places)
            out = part if out is None else out.unionByName(part)
        return out


def write_rows(rows: DataFrame, folder: str) -> None:
    """A row dataset as JSON lines in UTF-8, which readers see whole or not at all."""
    ledger = Ledger(rows.sparkSession, folder)
    ledger.put(rows, max(ledger.runs(), default=0) + 1, "json")


def read_rows(spark: SparkSession, folder: str, schema: StructType | str | None = None) -> DataFrame:
    """The last row dataset of :func:`write_rows`."""
    return Ledger(spark, folder).read(schema, last=True)


def write_tables(spark: SparkSession, root: str, folder: str) -> None:
    """The tables files and messages of all transcripts under ``root``, as the next run of each; readers see the run before until both are there."""
    files, messages = Ledger(spark, f"{folder}/files"), Ledger(spark, f"{folder}/messages")
    run = max({**files.runs(), **messages.runs()}, default=0) + 1
    told = read_files(spark, root)
    messages.put(read_messages(spark, root), run)
    files.put(told, run)


def read_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(files, messages) of the last run of :func:`write_tables` that has both."""
    tables = [Ledger(spark, f"{folder}/{name}") for name in ("files", "messages")]
    both = set(tables[0].runs()) & set(tables[1].runs())
    if not both:
        raise ValueError(f"no run in {folder}")
    return tuple(t.of(max(both)) for t in tables)


def ingest(spark: SparkSession, root: str, folder: str, once: bool = True, transform: Callable[[DataFrame], DataFrame] = messages_of, **options) -> DataFrame:
    """Take in what was appended to the transcripts under ``root`` since the last call; all messages so far.

    A batch's lines are numbered after those its files had before, and written as one run of the tables ``messages`` and
    ``lines`` (file_id, lines so far) under its batch id, ``lines`` last. A batch that failed in between is done again: what is
    told already stays, the rest is computed from the same lines. With ``once`` what is there is taken in and the call
    returns; else it goes on until it is stopped.
    """
    messages, counts = Ledger(spark, f"{folder}/messages"), Ledger(spark, f"{folder}/lines")

    def batch(lines: DataFrame, run: int) -> None:
        if counts.has(run):
            return
        before = [counts.read(last=True)] if counts.runs() else []
        told = numbered(lines, *before)
        messages.put(transform(told.filter(F.trim("value") != "").select("file_id", "line_no", "value")), run)
        ends = told.groupBy("file_id").agg(F.max("line_no").alias("lines"))
        ends = before[0].unionByName(ends).groupBy("file_id").agg(F.max("lines").alias("lines")) if before else ends
        counts.put(ends, run)

    stream = growing_lines(spark, root, f"{folder}/log", **options)
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/checkpoint")
    (writer.trigger(availableNow=True) if once else writer).start().awaitTermination()
    return messages.read(schema=transform(spark.createDataFrame([], "file_id string, line_no long, value string")).schema)
