"""What the corpus operators share: scratch tables, bounded batches, size-checked broadcasts, joins on hot keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from parlance.sources.scratch import discard, hinted, settled, shared_folder

__all__ = ["BATCH_ROWS", "discard", "fresh", "hinted", "join_by_share", "map_rows", "shared_folder", "slices", "stored", "texts_of", "whole_text", "with_small"]

#: Rows that are Python objects at once; documents can be long, so far fewer than the rows of an Arrow batch.
BATCH_ROWS = 256
#: Keys with at least one in HOT_KEYS of a table's rows count as hot; there are at most HOT_KEYS of them.
HOT_KEYS = 10_000

stored = settled


def whole_text(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores before it as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    prefix = "_"
    while any(f"{prefix}{n}".lower() in taken for n in names):
        prefix += "_"
    return [f"{prefix}{n}" for n in names]


def with_small(df: DataFrame, small: DataFrame, on: str, how: str = "left", row_bytes: int | Column = 64) -> DataFrame:
    """Join ``small``; it is broadcast if it was counted to be small, else both sides are shuffled."""
    return df.join(hinted(small, row_bytes), on, how)


def join_by_share(df: DataFrame, told: DataFrame, key: str) -> DataFrame:
    """``df``, which is read three times, left joined with ``told``, one row a key.

    Hot keys of ``df``, at most HOT_KEYS whether ``told`` has them or not, meet their rows by a broadcast; all others have
    too few rows each to fill a task.
    """
    rows = df.count()
    hot = stored(df.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n")).filter(F.col("_n") * HOT_KEYS >= rows).select("_key", F.lit(True).alias("_hot")), "hot-keys")
    marked = df.join(F.broadcast(hot), df[key].eqNullSafe(F.col("_key")), "left").drop("_key")
    few = told.join(F.broadcast(hot), told[key] == F.col("_key"), "left_semi")
    first = marked.filter("_hot").drop("_hot").join(F.broadcast(few), key, "left")
    return first.unionByName(marked.filter("_hot is null").drop("_hot").join(told, key, "left"))


def slices(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into pieces of at most ``rows`` rows, without a copy."""
    for batch in batches:
        yield from (batch.slice(i, rows) for i in range(0, max(1, batch.num_rows), rows))


def map_rows(df: DataFrame, scan: Callable[[Iterator[list[list]]], Iterator[list[tuple]]], schema: str) -> DataFrame:
    """``df`` through Python, BATCH_ROWS rows at a time: ``scan`` gets each piece as a list of columns and yields lists of rows.

    Values stay Python objects, so nullable 64-bit ids lose no digits.
    """
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in scan([c.to_pylist() for c in b.columns] for b in slices(batches)):
            columns = list(zip(*rows)) if rows else [()] * len(out)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)

    return df.mapInArrow(run, schema)


def texts_of(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """The columns doc_id and text (null: empty) alone."""
    return documents.select(F.col(id_column).cast("long").alias("doc_id"), whole_text(text_column).alias("text"))
