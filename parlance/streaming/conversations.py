"""Streaming twins that need one kind of state: messages as they arrive, first occurrences, turn numbers, the forward window as a join."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from parlance.sources.transcripts import messages_of, path_columns


def stream_messages(spark: SparkSession, root: str, files_at_once: int = 100) -> DataFrame:
    """messages of transcripts that land under ``root``, file by file; a file that grows must land as a further file."""
    lines = spark.readStream.option("wholetext", True).option("maxFilesPerTrigger", files_at_once).option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(root, wholetext=True)
    told = lines.select(path_columns(F.col("_metadata.file_path"), root)["relpath"].alias("file_id"), F.posexplode(F.split("value", "\n", -1)).alias("at", "value"))
    return messages_of(told.filter(F.trim("value") != "").select("file_id", (F.col("at") + 1).alias("line_no"), "value"))


def first_seen(messages: DataFrame, key: str = "fingerprint", event_time: str | None = None, delay: str = "30 days") -> DataFrame:
    """Each key once, over all batches; with an event time, keys are forgotten after ``delay``, else kept for good."""
    if event_time:
        return messages.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])
    return messages.dropDuplicates([key])


TURNS = "line_no long, side string, turn_id long, depth long, late boolean"
STATE = "last long, turn_id long, depth long"


def turn_numbers(messages: DataFrame) -> DataFrame:
    """(file_id, line_no, side, turn_id, depth, late) of each message, from a state of three numbers per file.

    file_id keeps its type. Lines of a batch are put in order, which holds one file's lines of a batch (line number and side)
    in a task; a line at or before the last one told is late and gets nulls. The state of a file is three numbers and stays.
    """

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, turn, depth = state.get if state.exists else (-1, 0, 0)
        rows = []
        for line, side in sorted((int(n), s) for b in batches for n, s in zip(b["line_no"], b["side"])):
            if line <= last:
                rows.append((key[0], line, side, None, None, True))
                continue
            last = line
            turn, depth = (turn + 1, 0) if side == "user" else (turn, depth + 1)
            rows.append((key[0], line, side, turn, depth, False))
        state.update((last, turn, depth))
        out = pd.DataFrame(rows, columns=["file_id", "line_no", "side", "turn_id", "depth", "late"])
        yield out.astype({"turn_id": "Int64", "depth": "Int64"})

    slim = messages.select("file_id", F.col("line_no").cast("long"), "side")
    return slim.groupBy("file_id").applyInPandasWithState(advance, f"file_id {dict(slim.dtypes)['file_id']}, {TURNS}", STATE, "append", GroupStateTimeout.NoTimeout)


def later_turns(promises: DataFrame, turns: DataFrame, days: int = 14, delay: str = "1 day") -> DataFrame:
    """Each promise (promise_id, project, at) with the turns (project, at and more) of its project within ``days`` whole days, as streams.

    Both streams have a watermark, so a promise is forgotten once its window is over and ``delay`` has passed.
    """
    p = promises.select("promise_id", F.col("project").alias("_project"), F.col("at").alias("promised")).withWatermark("promised", delay)
    t = turns.withWatermark("at", delay)
    ahead = (F.col("at") > F.col("promised")) & (F.col("at") < F.col("promised") + F.expr(f"interval {days + 1} days"))
    return p.join(t, (F.col("_project") == F.col("project")) & ahead).drop("_project")


def drained(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """What a stream gives of all that has landed so far, as a table in ``folder``; its checkpoint lies beside it."""
    spark = stream.sparkSession
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/table").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/table")
