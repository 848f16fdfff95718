"""Labels by hand against a detector's output."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.operators.followthrough import ELIGIBLE
from parlance.operators.turns import first_occurrence

KEY = "msg_fingerprint"
# What a label by hand says, as the detector's label.
TRUTH = {"yes": "honored", "no": "not_honored"}


def promises_of(matches: DataFrame, order: tuple[str, ...] = ("file_id", "line_no", "hit_no")) -> DataFrame:
    """The promises to follow through: of the assistant's rows of eligible constructs, each message's first in the dataset's order.

    promise_id is the message's fingerprint; the other columns are those :func:`followthrough.follow_through` reads, and
    model, category, phrase and turn_bucket. Rows without a fingerprint can't be told apart and are left out.
    """
    rows = matches.filter((F.col("side") == "assistant") & F.col("construct").isin(*ELIGIBLE) & F.col(KEY).isNotNull())
    once = first_occurrence(rows, KEY, order)
    return once.select(F.col(KEY).alias("promise_id"), "project", "session", F.col("timestamp").alias("ts"), F.col("message_text").alias("text"), F.col("counterpart_text").alias("trigger"), "model", "category", "phrase", "turn_bucket")


def with_output(labels: DataFrame, output: DataFrame) -> DataFrame:
    """Label rows (msg_fingerprint, did_it and more) with truth, and the detector's label now, null if it has none."""
    truth = F.lit(None).cast("string")
    for said, label in TRUTH.items():
        truth = F.when(F.col("did_it") == said, label).otherwise(truth)
    return labels.withColumn("truth", truth).join(output.select(KEY, F.col("label").alias("now")).dropDuplicates([KEY]), KEY, "left")


def unmatched(labels: DataFrame, output: DataFrame) -> DataFrame:
    """Labelled messages that the detector's output no longer has: its rules have changed since they were drawn."""
    return labels.join(output.select(KEY), KEY, "left_anti")


def decided(labels: DataFrame, column: str = "did_it") -> DataFrame:
    return labels.filter(F.col(column).isin(*TRUTH))


def hand_checked(coded: DataFrame, output: DataFrame, column: str = "followed_through") -> DataFrame:
    """Decided codes by hand beside the detector's label; those without output are left out."""
    return decided(coded, column).join(output.select(KEY, "label"), KEY)


def prefilled(sample: DataFrame, prior: DataFrame) -> DataFrame:
    """A sample with the decided labels of an earlier round; others stay open (null)."""
    known = decided(prior).groupBy(KEY).agg(F.min("did_it").alias("did_it"))
    return sample.drop("did_it").join(known, KEY, "left")


def label_mix(output: DataFrame) -> DataFrame:
    """(what, value, n): labels, and of promises not honored the evidence paths, how many crossed a session, and the median distance.

    The median is the upper one: the value at place n // 2 of the sorted distances, told by counts of each distance.
    """
    broken = output.filter("label = 'not_honored'")
    parts = [
        output.groupBy(F.lit("label").alias("what"), F.col("label").alias("value")).agg(F.count("*").alias("n")),
        broken.groupBy(F.lit("path").alias("what"), F.col("path").alias("value")).agg(F.count("*").alias("n")),
        broken.agg(F.coalesce(F.sum(F.col("cross_session").cast("long")), F.lit(0)).alias("n")).select(F.lit("cross_session").alias("what"), F.lit("true").alias("value"), "n"),
    ]
    counts = broken.filter("turns_later is not null").groupBy("turns_later").agg(F.count("*").alias("n"))  # as many rows as distances, 5,000 at most
    every = Window.partitionBy(F.lit(0))
    upto = counts.withColumns({"_to": F.sum("n").over(every.orderBy("turns_later")), "_all": F.sum("n").over(every)})
    median = upto.filter(F.col("_to") > F.floor(F.col("_all") / 2)).agg(F.min("turns_later").cast("long").alias("n")).filter("n is not null")
    parts.append(median.select(F.lit("median_turns_later").alias("what"), F.lit("").alias("value"), "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
