"""Small documents from finished tables; large results are written with Spark's own writers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

#: Rows a document may have; a longer table is an error, not a document.
MOST_ROWS = 100_000


def rows_of(df: DataFrame, most: int = MOST_ROWS) -> list[dict]:
    rows = [r.asDict(True) for r in df.limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"over {most} rows: write the table instead")
    return rows


def json_document(sections: dict[str, DataFrame]) -> str:
    """Sorted keys, one blank of indentation, no wall clock: equal tables give equal text."""
    return json.dumps({k: rows_of(df) for k, df in sections.items()}, indent=1, sort_keys=True, ensure_ascii=False, default=str)


def read_document(spark: SparkSession, path: str) -> dict:
    """A finished document (JSON), anywhere Spark reads; its size is bounded as that of a document is."""
    (text,) = [r[0] for r in spark.read.text(path, wholetext=True).limit(2).collect()]
    return json.loads(text)


def listed(names: list[str], most: int = 10) -> str:
    """The first names of a report, and how many more there are."""
    rest = f", and {len(names) - most} more" if len(names) > most else ""
    return ", ".join(names[:most]) + rest


def markdown_table(df: DataFrame) -> str:
    head = "| " + " | ".join(df.columns) + " |\n|" + " --- |" * len(df.columns)
    return "\n".join([head, *("| " + " | ".join(str(v) for v in r.values()) + " |" for r in rows_of(df))])


def script_document(name: str, sections: dict[str, DataFrame]) -> str:
    """``window.<name> = {...};`` for pages; closing tags are escaped."""
    return f"window.{name} = {json_document(sections)};".replace("</", "<\\/")


def write_partitioned(df: DataFrame, folder: str, machine: str, run_date: str) -> None:
    """A scan's aggregates below machine_id=<machine>/run_date=<date>: a run of the same day replaces its own part alone."""
    df.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/machine_id={machine}/run_date={run_date}")
