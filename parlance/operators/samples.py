"""Systematic samples for people to label, and estimates from their labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.stats import wilson
from parlance.sources.scratch import hinted, settled

SHARES = {"honored": 0.4, "not_honored": 0.4, "unobserved": 0.2}


def every_nth(df: DataFrame, by: list[str], order: list[str], k: Column) -> DataFrame:
    """At most k rows of each group, evenly spaced in order: every max(1, n // k)-th from the first.

    ``k`` may use the column ``_n``, the group's size. Rows are dealt and sorted by ranges of (group, order), so that a large
    group lies in many tasks; a row's rank is its place in its range plus the group's rows in the ranges before. Groups
    with a null in ``by`` are left out.
    """
    kept = df.dropna(subset=by) if by else df
    told = settled(kept.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("_row", F.monotonically_increasing_id()), "ranges")
    told = told.withColumn("_part", F.shiftright("_row", 33))
    parts = told.groupBy(*by, "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_rows"))
    over = Window.partitionBy(*(by or [F.lit(0)]))
    before = F.coalesce(F.sum("_rows").over(over.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumns({"_before": before, "_n": F.sum("_rows").over(over)}).drop("_rows")
    told = told.join(hinted(parts, 256), [*by, "_part"])
    told = told.withColumns({"_k": k, "_at": F.col("_row") - F.col("_first") + F.col("_before")}).drop("_row", "_part", "_first", "_before")
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / F.col("_k")))
    return told.filter((F.col("_k") > 0) & (F.col("_at") % step == 0) & (F.col("_at") < step * F.col("_k"))).drop("_n", "_k", "_at")


def stratified(df: DataFrame, stratum: str, order: list[str], total: int, shares: dict[str, float] | None = None) -> DataFrame:
    """A systematic sample of each stratum, min(n, max(1, round(total * share))) rows; empty strata give none."""
    share = F.lit(0.0)
    for name, part in (shares or SHARES).items():
        share = F.when(F.col(stratum) == name, part).otherwise(share)
    k = F.when(share > 0, F.least(F.col("_n"), F.greatest(F.lit(1), F.bround(F.lit(total) * share).cast("long")))).otherwise(0)
    return every_nth(df, [stratum], order, k)


def confusion(labels: DataFrame, truth: str, detector: str) -> DataFrame:
    return labels.groupBy(truth, detector).agg(F.count("*").alias("n"))


def predictive_value(labels: DataFrame, stratum: str, positive: Column, decided: Column) -> DataFrame:
    """Per stratum: decided labels n, positives k, and their share in percent with its interval."""
    got = labels.filter(decided).groupBy(stratum).agg(F.count("*").alias("n"), F.sum(positive.cast("long")).alias("k"))
    low, high = wilson(F.col("k"), F.col("n"))
    return got.withColumns({"share": F.round(100.0 * F.col("k") / F.col("n"), 4), "low": F.round(low, 4), "high": F.round(high, 4)})


def extrapolated(values: DataFrame, sizes: DataFrame, stratum: str) -> DataFrame:
    """One row: shares and bounds of all strata weighted by their sizes (stratum, size)."""
    mean = lambda c: F.round(F.sum(F.col(c) * F.col("size")) / F.sum("size"), 4).alias(c)
    return values.join(hinted(sizes, 256), stratum).agg(F.sum("size").alias("size"), mean("share"), mean("low"), mean("high"))


def accuracy(labels: DataFrame, right: Column, positive: Column) -> DataFrame:
    """One row: n, correct, accuracy, and the accuracy of always giving the more frequent truth."""
    got = labels.agg(F.count("*").alias("n"), F.sum(right.cast("long")).alias("correct"), F.sum(positive.cast("long")).alias("positives"))
    return got.select("n", "correct", F.round(F.col("correct") / F.col("n"), 6).alias("accuracy"), F.round(F.greatest("positives", F.col("n") - F.col("positives")) / F.col("n"), 6).alias("baseline"))
