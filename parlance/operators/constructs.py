"""Constructs over match rows: rates, leaderboards, user categories, exact phrases, and what the message stream makes of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions.text import hidden, month, normalize
from parlance.operators.audits import shouting
from parlance.operators.rates import top_per, with_rate
from parlance.operators.turns import first_occurrence, valid_model
from parlance.sources.scratch import hinted

#: The sides of a conversation.
SIDES = ("user", "assistant")
#: The one construct of the user side.
USER_CONSTRUCT = "frustration"
KEY = "msg_fingerprint"


def construct_rates(matches: DataFrame, population: DataFrame) -> DataFrame:
    """Per construct: side, hits, distinct messages, n (distinct messages of its side in ``population``) and the rate with its interval."""
    n = population.filter(F.col("side").isin(*SIDES)).groupBy("side").agg(F.countDistinct("fingerprint").alias("n"))
    told = matches.groupBy("construct").agg(F.count("*").alias("hits"), F.countDistinct(KEY).alias("messages"))
    told = told.withColumn("side", F.when(F.col("construct") == USER_CONSTRUCT, "user").otherwise("assistant"))
    return with_rate(told.join(F.broadcast(n), "side"), "messages", "n")


def model_constructs(matches: DataFrame, population: DataFrame, constructs: list[str], least: int) -> DataFrame:
    """Per model with at least ``least`` distinct assistant messages: n, and of each construct <name>_hits, <name>_messages, <name>_rate, <name>_low and <name>_high.

    Models without a name and made-up ones are left out.
    """
    n = population.filter((F.col("side") == "assistant") & valid_model(F.col("model"))).groupBy("model").agg(F.countDistinct("fingerprint").alias("n"))
    is_one = lambda c: F.col("construct") == c
    counts = [x for c in constructs for x in (F.sum(is_one(c).cast("long")).alias(f"{c}_hits"), F.countDistinct(F.when(is_one(c), F.col(KEY))).alias(f"{c}_messages"))]
    told = n.filter(F.col("n") >= least).join(matches.filter("side = 'assistant'").groupBy("model").agg(*counts), "model", "left")
    told = told.na.fill(0, [f"{c}_{x}" for c in constructs for x in ("hits", "messages")])
    for c in constructs:
        told = with_rate(told, f"{c}_messages", "n").withColumnsRenamed({x: f"{c}_{x}" for x in ("rate", "low", "high")})
    return told


def user_categories(matches: DataFrame, population: DataFrame) -> DataFrame:
    """Per category of the user side: hits, distinct messages, and their share of the user messages."""
    n = population.filter("side = 'user'").agg(F.countDistinct("fingerprint").alias("n"))
    told = matches.filter("side = 'user'").groupBy("category").agg(F.count("*").alias("hits"), F.countDistinct(KEY).alias("messages"))
    return with_rate(told.crossJoin(F.broadcast(n)), "messages", "n")


def phrase_occurrences(population: DataFrame, pattern: str) -> DataFrame:
    """One row: occurrences of a pattern in the normalised texts of each message once, the messages that have any, all messages, and the rate."""
    once = first_occurrence(population).select(F.regexp_count(normalize(F.coalesce("text", F.lit(""))), F.lit(pattern)).alias("k"))
    return with_rate(once.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("occurrences"), F.sum((F.col("k") > 0).cast("long")).alias("messages"), F.count("*").alias("n")), "messages", "n")


def with_conceded(turns: DataFrame, matches: DataFrame, construct: str = "concession") -> DataFrame:
    """``turns`` with ``conceded``: whether an assistant message, wherever it is repeated, has a match row of the construct."""
    fps = matches.filter((F.col("side") == "assistant") & (F.col("construct") == construct)).select(F.col(KEY).alias("_fp")).distinct()
    told = turns.join(hinted(fps, 64), F.col("fingerprint") == F.col("_fp"), "left")
    return told.withColumn("conceded", (F.col("side") == "assistant") & F.col("_fp").isNotNull()).drop("_fp")


def composition(matches: DataFrame, construct: str = "concession") -> DataFrame:
    """Per bucket of the preceding turn: n assistant hits, k of the construct, and the share; for the tests of stats_plans."""
    told = matches.filter("side = 'assistant' and turn_bucket is not null").groupBy(F.col("turn_bucket").alias("bucket"))
    return with_rate(told.agg(F.count("*").alias("n"), F.sum((F.col("construct") == construct).cast("long")).alias("k")), "k", "n")


def heat_counters(matches: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """dimension, value, hits and messages of the user side by category, word, month and session, and directed or not; one pass.

    With ``users`` (fingerprint, ts and text as written), also the messages in capitals, by month: of angry words, or
    short and mostly capitals; ``hits`` is how many such words they have. These never make a turn hot.
    """
    named = {"category": F.col("category"), "word": F.col("phrase"), "month": month(F.col("timestamp")), "session": F.col("session"), "aim": F.when(F.col("directed_at_claude"), "directed").otherwise("ambient")}
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), v.cast("string").alias("value")) for d, v in named.items()]))
    told = matches.filter("side = 'user'").select(each.alias("d"), KEY).groupBy("d").agg(F.count("*").alias("hits"), F.countDistinct(KEY).alias("messages")).select("d.*", "hits", "messages")
    if users is None:
        return told
    caps = users.select(month(F.col("ts")).alias("value"), "fingerprint", F.size(shouting(F.coalesce("text", F.lit("")))).cast("long").alias("n")).filter("n > 0")
    return told.unionByName(caps.groupBy(F.lit("capitals").alias("dimension"), "value").agg(F.sum("n").alias("hits"), F.countDistinct("fingerprint").alias("messages")))


def top_phrases(tally: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` most frequent phrases of each side, with their rank; ties by phrase. ``tally`` is that of :func:`export_tally`."""
    n = tally.groupBy("side", "phrase").agg(F.sum("n").alias("n"))
    return top_per(n, "side", k, F.desc("n"), F.col("phrase"))


def compared_months(series: DataFrame, value: str = "rate", period: str = "month") -> DataFrame:
    """A monthly series with the value before and whether it rose; the first month has neither."""
    before = F.lag(value).over(Window.partitionBy(F.lit(0)).orderBy(period))  # some dozens of months
    return series.withColumns({"before": before, "rose": F.col(value) > before})


# ---- what leaves the machine


def export_tally(matches: DataFrame) -> DataFrame:
    """Hits by side, category and phrase."""
    return matches.groupBy("side", "category", "phrase").agg(F.count("*").alias("n"))


def coarsened(df: DataFrame, times: list[str], dropped: list[str], names: list[str]) -> DataFrame:
    """``df`` fit to be published: times as months, names hashed, ``dropped`` columns gone."""
    told = df.withColumns({**{c: F.substring(F.col(c).cast("string"), 1, 7) for c in times}, **{c: hidden(F.col(c)) for c in names}})
    return told.drop(*dropped)
