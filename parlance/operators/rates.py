"""Counts, distinct messages, rates with intervals, leaderboards and controls over finished tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.stats import pct, wilson


def with_rate(df: DataFrame, k: str, n: str, digits: int = 4) -> DataFrame:
    """``df`` with rate, low and high in percent, rounded."""
    low, high = wilson(F.col(k), F.col(n))
    return df.withColumns({"rate": F.round(pct(F.col(k), F.col(n)), digits), "low": F.round(low, digits), "high": F.round(high, digits)})


def distinct_per(messages: DataFrame, *by: str, key: str = "fingerprint", out: str = "n") -> DataFrame:
    """Distinct messages of each group; null fingerprints don't count."""
    return messages.groupBy(*by).agg(F.countDistinct(key).alias(out))


def machine_sums(messages: DataFrame) -> DataFrame:
    """Per side: distinct messages of each machine, summed; a message on two machines counts twice."""
    return distinct_per(messages, "machine_id", "side").groupBy("side").agg(F.sum("n").alias("n"))


def rates(hits: DataFrame, denominators: DataFrame, by: list[str], least: int = 0, key: str = "msg_fingerprint") -> DataFrame:
    """hits and hit messages of each group of ``denominators`` (by, n) with n of at least ``least``, and their rate."""
    counted = hits.groupBy(*by).agg(F.count("*").alias("hits"), F.countDistinct(key).alias("messages"))
    told = denominators.filter(F.col("n") >= least).join(counted, by, "left").na.fill(0, ["hits", "messages"])
    return with_rate(told, "messages", "n")


def remainder(denominators: DataFrame, least: int) -> DataFrame:
    """The groups too small for a leaderboard."""
    return denominators.filter(F.col("n") < least)


def share(df: DataFrame, n: str = "n", out: str = "share", digits: int = 6) -> DataFrame:
    """Each row's part of the total, which is one row joined to all."""
    total = df.agg(F.sum(n).alias("_total"))
    return df.crossJoin(F.broadcast(total)).withColumn(out, F.round(F.col(n) / F.col("_total"), digits)).drop("_total")


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows in a total order: each task's first k, then theirs."""
    return df.orderBy(*order).limit(k)


def top_per(df: DataFrame, by: str, k: int, *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= k)


def top_two_control(denominators: DataFrame, group: str, model: str, least: int) -> DataFrame:
    """The group with the largest volume among those where both models of the largest total volume have at least ``least``.

    One row (group, volume, first, second, first_n, second_n), or none. ``denominators`` has (group, model, n).
    """
    lead = top(denominators.groupBy(model).agg(F.sum("n").alias("n")), 2, F.desc("n"), F.col(model)).agg(F.max_by(model, F.struct("n", model)).alias("first"), F.min_by(model, F.struct("n", model)).alias("second"))
    both = denominators.crossJoin(F.broadcast(lead)).filter((F.col(model) == F.col("first")) | (F.col(model) == F.col("second")))
    wide = both.groupBy(group, "first", "second").agg(F.sum(F.when(F.col(model) == F.col("first"), F.col("n")).otherwise(0)).alias("first_n"), F.sum(F.when(F.col(model) == F.col("second"), F.col("n")).otherwise(0)).alias("second_n"))
    wide = wide.filter((F.col("first_n") >= least) & (F.col("second_n") >= least)).withColumn("volume", F.col("first_n") + F.col("second_n"))
    return top(wide, 1, F.desc("volume"), F.col(group))


def head_to_head(denominators: DataFrame, period: str, least: int) -> DataFrame:
    """The rows of the period with the most qualifying groups, the latest of equal ones."""
    kept = denominators.filter(F.col("n") >= least)
    best = top(kept.groupBy(period).agg(F.count("*").alias("_groups")), 1, F.desc("_groups"), F.desc(period))
    return kept.join(F.broadcast(best.limit(1)), period).drop("_groups")


def pushback_per_message(turns: DataFrame) -> DataFrame:
    """By the bucket of the turn: assistant messages, those that concede, and the rate. Repeated messages count each.

    ``turns`` has side, turn_id, user_bucket and conceded; messages before any user message are left out.
    """
    told = turns.filter("side = 'assistant' and turn_id > 0").groupBy(F.col("user_bucket").alias("bucket"))
    return with_rate(told.agg(F.count("*").alias("n"), F.sum(F.col("conceded").cast("long")).alias("k")), "k", "n")


def pushback_per_turn(turns: DataFrame) -> DataFrame:
    """By bucket: turns, those with any concession before the next user message, and the rate; turns without a reply count."""
    folded = turns.filter("turn_id > 0").groupBy("file_id", "turn_id").agg(F.max(F.col("side").eqNullSafe("assistant") & F.col("conceded")).alias("folded"), F.max("user_bucket").alias("bucket"))
    return with_rate(folded.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.col("folded").cast("long")).alias("k")), "k", "n")


def histogram(df: DataFrame, value: Column, out: str) -> DataFrame:
    return df.groupBy(value.alias(out)).agg(F.count("*").alias("n"))
