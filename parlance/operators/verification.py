"""Checks that finished artefacts still agree with the messages they came from. Each check is a row (name, holds, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.operators.checks import leaks


def check(df: DataFrame, name: str, holds: Column, detail: Column | None = None) -> DataFrame:
    """One row from an aggregated one; a check that can't be told doesn't hold."""
    return df.select(F.lit(name).alias("name"), F.coalesce(holds, F.lit(False)).alias("holds"), (F.lit("") if detail is None else detail.cast("string")).alias("detail"))


def equal_counts(name: str, a: DataFrame, b: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Whether two tables have as many rows of each group; the detail tells the groups that differ."""
    by = by or []
    count = lambda df, n: df.groupBy(*by).agg(F.count("*").alias(n)) if by else df.agg(F.count("*").alias(n))
    x, y = count(a, "_a"), count(b, "_b")
    met = x.join(y, by, "full") if by else x.crossJoin(F.broadcast(y))
    off = met.filter(F.coalesce("_a", F.lit(0)) != F.coalesce("_b", F.lit(0)))
    told = off.agg(F.count("*").alias("n"), F.sum(F.coalesce("_a", F.lit(0))).alias("a"), F.sum(F.coalesce("_b", F.lit(0))).alias("b"))
    return check(told, name, F.col("n") == 0, F.when(F.col("n") > 0, F.concat_ws(" ", F.col("n"), F.lit("groups differ:"), F.col("a"), F.lit("and"), F.col("b"))).otherwise(""))


def dataset_checks(matches: DataFrame, live: DataFrame, population: DataFrame, files: DataFrame, found: DataFrame, columns: list[str]) -> DataFrame:
    """The dataset against a live count, its schema and keys, files against those found, denominators and leaked markup.

    ``live`` has side, one row for each hit the current dictionary gives; ``found`` the files on disk (file_id).
    """
    missing = [c for c in columns if c not in matches.columns]
    sides = population.groupBy("side").agg(F.countDistinct("fingerprint").alias("n"))
    rows = [
        equal_counts("rows equal a live count, both sides", matches.select("side"), live.select("side"), ["side"]),
        check(matches.agg(F.count("*").alias("n")), "all columns are there", F.lit(not missing), F.lit(", ".join(missing))),
        check(matches.agg(F.sum((F.coalesce("msg_fingerprint", F.lit("")) == "").cast("long")).alias("n")), "every row has a fingerprint", F.coalesce("n", F.lit(0)) == 0, F.coalesce("n", F.lit(0))),
        equal_counts("files equal those found", files.select("file_id").distinct(), found.select("file_id").distinct()),
        check(sides.agg(F.sum((F.col("side").isin("user", "assistant") & (F.col("n") > 0)).cast("long")).alias("n")), "both sides have a denominator", F.col("n") == 2, F.col("n")),
        check(population.agg(F.sum(leaks(F.coalesce("text", F.lit(""))).cast("long")).alias("n")), "no injected markup is left", F.coalesce("n", F.lit(0)) == 0, F.coalesce("n", F.lit(0))),
    ]
    return reduce(DataFrame.unionByName, rows)


def freshness(tally: DataFrame, matches: DataFrame, stated: DataFrame, files: DataFrame, messages: DataFrame) -> DataFrame:
    """Whether derived artefacts are those of the current tables: a tally's total (n), and the stated counts (files, messages; one row)."""
    totals = tally.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("a")).crossJoin(F.broadcast(matches.agg(F.count("*").alias("b"))))
    counts = files.agg(F.count("*").alias("f")).crossJoin(F.broadcast(messages.agg(F.count("*").alias("m")))).crossJoin(F.broadcast(stated.select("files", "messages").limit(1)))
    same = (F.col("f") == F.col("files")) & (F.col("m") == F.col("messages"))
    return check(totals, "the tally's total is the dataset's", F.col("a") == F.col("b"), F.concat_ws(" and ", "a", "b")).unionByName(check(counts, "the stated counts are the tables'", same, F.concat_ws(" and ", "files", "f", "messages", "m")))


def claims(facts: DataFrame, predicates: dict[str, str]) -> DataFrame:
    """Each claim's name and whether its SQL predicate holds over ``facts``, a table of one row; a null doesn't hold."""
    one = facts.limit(1)
    return reduce(DataFrame.unionByName, [check(one, name, F.expr(p)) for name, p in predicates.items()])


# What the published prose claims, as predicates over the facts of :func:`published_facts`, in its order.
PROSE = {
    "swearing roughly doubles the fold rate": "hot_correction_odds between 1.6 and 2.6",
    "about one checkable promise in three broken": "broken_rate between 25 and 42",
    "hot and correction CIs do not overlap (per turn)": "hot_low > correction_high",
    "over half of matched language lands at depth 1": "depth_one_share > 50",
    "one busy machine can move any aggregate": "top_machine_share > 50",
    "top model clears the field with non-overlapping intervals": "lead_low > rest_high",
    "top model roughly 1.8x the rest of the field": "lead_rate / second_rate between 1.5 and 2.2",
    "the rest of the field is unresolved (CIs overlap)": "rest_overlaps",
    "the latest month is up sharply": "last_month_rate > month_before_rate",
    "the top model is itself rising month over month": "lead_last_rate > lead_before_rate",
    "top model dominates usage in the latest month": "lead_last_n = lead_most_n",
    "the within-project control still favors the top model": "control_lead and control_first_rate > control_second_rate",
    "Claude almost never says the famous sentence": "famous < 10",
}


def published_facts(leaderboard: DataFrame, per_turn: DataFrame, broken: DataFrame, depth: DataFrame, machines: DataFrame, monthly: DataFrame, lead_monthly: DataFrame, control: DataFrame, famous: DataFrame) -> DataFrame:
    """One row of facts that PROSE is told from; what a small table can't tell is null, and its claim doesn't hold.

    ``leaderboard``: model, rate, low, high; ``per_turn``: bucket, k, n, low, high; ``broken``: rate; ``depth``: depth, n; ``machines``:
    machine_id, n; ``monthly``: month, rate; ``lead_monthly``: month, rate, n of the leading model; ``control``: model, rate of the two
    models in their busiest project; ``famous``: occurrences. All are finished tables of some groups.
    """
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("rate"), "model")
    ranked = leaderboard.withColumn("place", F.row_number().over(order))
    at = lambda c, place: F.max(F.when(F.col("place") == place, F.col(c)))
    # the rest overlap each other if, in order of their lower ends, the least upper end isn't below the greatest lower end
    rest = F.col("place") > 1
    lead = ranked.agg(
        at("model", 1).alias("lead"), at("low", 1).alias("lead_low"), at("rate", 1).alias("lead_rate"), at("rate", 2).alias("second_rate"), F.max(F.when(rest, F.col("high"))).alias("rest_high"),
        (F.max(F.when(rest, F.col("low"))) <= F.min(F.when(rest, F.col("high")))).alias("rest_overlaps"),
    )
    of = lambda c, b: F.max(F.when(F.col("bucket") == b, F.col(c)))
    cells = [of("k", "hot"), of("n", "hot") - of("k", "hot"), of("k", "correction"), of("n", "correction") - of("k", "correction")]
    turns = per_turn.agg(of("low", "hot").alias("hot_low"), of("high", "correction").alias("correction_high"), (cells[0] * cells[3] / F.nullif(cells[1] * cells[2], F.lit(0))).alias("hot_correction_odds"))
    part = lambda df, name: df.agg((100 * F.max("n") / F.sum("n")).alias(name))
    first = depth.agg((100 * F.sum(F.when(F.col("depth") == 1, F.col("n"))) / F.sum("n")).alias("depth_one_share"))

    def lasts(df: DataFrame, *columns: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("month")))
        return df.withColumn("place", place).select("place", *columns)

    months = lasts(monthly, "rate").agg(at("rate", 1).alias("last_month_rate"), at("rate", 2).alias("month_before_rate"))
    leads = lasts(lead_monthly, "rate", "n").agg(at("rate", 1).alias("lead_last_rate"), at("rate", 2).alias("lead_before_rate"), at("n", 1).alias("lead_last_n"), F.max("n").alias("lead_most_n"))
    two = control.withColumn("place", F.row_number().over(order)).agg(at("model", 1).alias("control_model"), at("rate", 1).alias("control_first_rate"), at("rate", 2).alias("control_second_rate"), F.count("*").alias("control_n"))
    parts = [turns, broken.agg(F.max("rate").alias("broken_rate")), first, part(machines, "top_machine_share"), months, leads, two, famous.agg(F.max("occurrences").alias("famous"))]
    out = lead
    for p in parts:
        out = out.crossJoin(F.broadcast(p))  # one row each
    return out.withColumn("control_lead", (F.col("control_n") == 2) & (F.col("control_model") == F.col("lead")))


def intervals_overlap(rows: DataFrame, low: str = "low", high: str = "high") -> DataFrame:
    """One row (clear): whether no two intervals of a small table of groups overlap, told by its order, without pairs."""
    before = F.max(high).over(Window.partitionBy(F.lit(0)).orderBy(low).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_before", before).agg(F.coalesce(F.min((F.col("_before") < F.col(low)).cast("int")), F.lit(1)).cast("boolean").alias("clear"))
