"""Populations, first occurrences and the turns of conversations.

A conversation may hold a large share of all rows, so running counts go by segments of it: within segments first, then over
the segments' sums; what a turn carries is joined by (file_id, turn_id).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions import dictionary as D
from parlance.functions.lexicon import Lexicon, correction, markers, shouts
from parlance.functions.text import content_words, normalize, strip_code
from parlance.sources.scratch import settled

#: Lines of a file in one segment.
SEGMENT = 4096
#: Earlier messages that a message is compared with first.
LOOKED = 8


#: Flags of entries that nobody wrote.
SYNTHETIC = ("is_sidechain", "is_compact", "is_meta", "is_visible_only")


def synthetic(*flags: str) -> Column:
    """Whether an entry is one that nobody wrote; null flags count as unset."""
    return F.coalesce(F.greatest(*[F.coalesce(F.col(c), F.lit(False)) for c in flags or SYNTHETIC]), F.lit(False))


def valid_model(model: Column) -> Column:
    """Whether a model has a name, and not that of made-up entries."""
    return model.isNotNull() & ~model.isin("", "<synthetic>")


def population(messages: DataFrame, files: DataFrame, excluded: str | Iterable[str] | None = None) -> DataFrame:
    """Messages with prose that people or the assistant wrote, outside the ``excluded`` projects, with their file's columns.

    Files below no project have the project ''; they stay unless it is excluded.
    """
    told = messages.filter(F.col("has_text") & ~synthetic()).join(files.select("file_id", "machine_id", "root_slug", "project", "session"), "file_id")
    away = [excluded] if isinstance(excluded, str) else list(excluded or [])
    return told.filter(~F.coalesce(F.col("project").isin(away), F.lit(False))) if away else told


def files_of(files: DataFrame, population: DataFrame) -> DataFrame:
    """The files with at least one message of the population."""
    return files.join(population.select("file_id").distinct(), "file_id", "left_semi")


def first_occurrence(df: DataFrame, key: str = "fingerprint", order: tuple[str, ...] = ("file_id", "line_no")) -> DataFrame:
    """The first row of each key in order; rows without a key all stay. One aggregate with partial sums, no sort of a key's rows."""
    first = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*order)).alias("_first")).select(F.col(key).alias("_key"), *[F.col(f"_first.{c}").alias(f"_{c}") for c in order])
    at = F.col(key) == F.col("_key")
    for c in order:
        at = at & (F.col(c) == F.col(f"_{c}"))
    return df.join(first, at, "left").filter(F.col("_key").isNotNull() | F.col(key).isNull()).drop("_key", *[f"_{c}" for c in order])


def running_count(df: DataFrame, flag: Column, out: str, keys: tuple[str, ...] = ("file_id",), order: str = "line_no", segment: int | None = None) -> DataFrame:
    """``df`` with the count of flagged rows up to each row, in order within its keys; ``segment`` is how much of the order is sorted at once."""
    told = df.withColumns({"_seg": F.floor(F.col(order) / (segment or SEGMENT)), "_flag": F.when(flag, 1).otherwise(0).cast("long")})
    sums = told.groupBy(*keys, "_seg").agg(F.sum("_flag").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("_before", before).drop("_sum")
    inner = F.sum("_flag").over(Window.partitionBy(*keys, "_seg").orderBy(order))
    return told.withColumn("_inner", inner).join(sums, [*keys, "_seg"]).withColumn(out, F.col("_inner") + F.col("_before")).drop("_seg", "_flag", "_inner", "_before")


def with_turns(messages: DataFrame) -> DataFrame:
    """turn_id (user messages so far; 0 before the first) and depth (the assistant's messages of the turn so far; 0 for users)."""
    told = running_count(messages, F.col("side") == "user", "turn_id")
    depth = F.row_number().over(Window.partitionBy("file_id", "turn_id").orderBy(F.col("side") == "assistant", "line_no"))
    users = F.when(F.col("turn_id") > 0, 1).otherwise(0)
    return told.withColumn("depth", F.when(F.col("side") == "assistant", depth - users).otherwise(0).cast("int"))


def with_user_context(turns: DataFrame, columns: list[str]) -> DataFrame:
    """Every row with its turn's user message: ``columns`` of it, as user_<name>; null before the first user message."""
    user = turns.filter("side = 'user'").select("file_id", "turn_id", *[F.col(c).alias(f"user_{c}") for c in columns])
    return turns.join(user, ["file_id", "turn_id"], "left")


def next_reply_lines(turns: DataFrame) -> DataFrame:
    """(file_id, turn_id, line_no) of each user message's reply: the first later assistant message, whatever its turn; null if there is none.

    A window runs over one row of three numbers a turn.
    """
    first = turns.groupBy("file_id", "turn_id").agg(F.min(F.when(F.col("side") == "assistant", F.col("line_no"))).alias("line_no"))
    ahead = Window.partitionBy("file_id").orderBy("turn_id").rowsBetween(0, Window.unboundedFollowing)
    return first.select("file_id", "turn_id", F.first("line_no", ignorenulls=True).over(ahead).alias("line_no")).filter("turn_id > 0")


def next_reply(turns: DataFrame, text: str = "text") -> DataFrame:
    """(file_id, turn_id, reply) of each user message: the first later assistant message, if any, whatever its turn."""
    told = turns.filter("side = 'assistant'").select("file_id", "line_no", F.col(text).alias("reply"))
    return next_reply_lines(turns).join(told, ["file_id", "line_no"], "left").select("file_id", "turn_id", "reply")


def ordered_words(users: DataFrame, words: str = "words") -> DataFrame:
    """(file_id, line_no, n, words, before): distinct words, those of the fewest messages of the file first; the last earlier lines with one of the LOOKED rarest."""
    long = users.select("file_id", "line_no", F.explode(F.array_distinct(words)).alias("word"))
    holders = Window.partitionBy("file_id", "word")
    told = long.withColumns({"df": F.count("*").over(holders), "last": F.lag("line_no").over(holders.orderBy("line_no"))})
    rare = F.sort_array(F.collect_list(F.struct("df", "word", "last")))
    each = told.groupBy("file_id", "line_no").agg(rare.alias("w"))
    seen = F.slice(F.array_distinct(F.transform(F.filter("w", lambda x: x["last"].isNotNull()), lambda x: x["last"])), 1, LOOKED)
    return each.select("file_id", "line_no", F.size("w").alias("n"), F.transform("w", lambda x: x["word"]).alias("words"), seen.alias("before"))


def compared_words(pairs: DataFrame, told: DataFrame) -> DataFrame:
    """(file_id, line_no, before, similarity) of ``pairs`` (file_id, line_no, before): the Jaccard similarity of their words."""
    one = told.select("file_id", "line_no", "n", "words")
    other = told.select("file_id", F.col("line_no").alias("before"), F.col("n").alias("m"), F.col("words").alias("others"))
    k = F.size(F.array_intersect("words", "others"))
    return pairs.join(one, ["file_id", "line_no"]).join(other, ["file_id", "before"]).select("file_id", "line_no", "before", (k / (F.col("n") + F.col("m") - k)).alias("similarity"))


def more_alike(told: DataFrame, bounds: DataFrame) -> DataFrame:
    """Distinct pairs (file_id, line_no, before) that may be more alike than ``bounds`` (file_id, line_no, bound, above 0) tells.

    With more than bound x n of its n words in common, a message shares one of its n - floor(bound x n) rarest with the other's as
    many; sizes must be near enough, and from the place of a shared word on enough words must be left.
    """
    least = lambda size: F.floor(F.col("bound") * size - 1e-9)  # noqa: E731  a little less, for what division has rounded
    ahead = told.join(bounds, ["file_id", "line_no"]).select("file_id", "line_no", "n", "bound", F.posexplode(F.expr("slice(words, 1, cast(n - greatest(0, floor(bound * n - 1e-9)) as int))")).alias("i", "word"))
    index = told.select("file_id", F.col("line_no").alias("before"), F.col("n").alias("m"), F.posexplode("words").alias("j", "word"))
    left = F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j"))
    enough = left > F.col("bound") / (1 + F.col("bound")) * (F.col("n") + F.col("m")) - 1e-9
    near = (F.col("m") > F.col("bound") * F.col("n") - 1e-9) & (F.col("n") > F.col("bound") * F.col("m") - 1e-9)
    met = ahead.join(index, ["file_id", "word"]).filter((F.col("before") < F.col("line_no")) & (F.col("j") < F.col("m") - F.greatest(F.lit(0), least(F.col("m")))) & near & enough)
    return met.select("file_id", "line_no", "before").distinct()


def prior_similarity(users: DataFrame, words: str = "words") -> DataFrame:
    """(file_id, line_no, similarity): the highest Jaccard similarity of a user message's words to any earlier one's, 3 decimals.

    A bound first: each message is compared with the last ones that hold one of its rarest words, a handful at most. Then only
    with those that may be more alike, by prefixes of rare words, sizes and places (:func:`more_alike`). Frequent words, which
    most messages of a long file share, are met by messages that nothing else is like.
    """
    slim = users.select("file_id", "line_no", words)
    told = settled(ordered_words(slim, words), "ordered-words")
    first = settled(compared_words(told.select("file_id", "line_no", F.explode("before").alias("before")), told), "first-similarities")
    bounds = first.groupBy("file_id", "line_no").agg(F.max("similarity").alias("bound")).filter("bound > 0 and bound < 1")
    rest = more_alike(told, bounds).join(first, ["file_id", "line_no", "before"], "left_anti")
    best = first.drop("before").unionByName(compared_words(rest, told).drop("before")).groupBy("file_id", "line_no").agg(F.max("similarity").alias("best"))
    return slim.select("file_id", "line_no").join(best, ["file_id", "line_no"], "left").select("file_id", "line_no", F.round(F.coalesce("best", F.lit(0.0)), 3).alias("similarity"))


def classified(users: DataFrame, lexicon: Lexicon | None = None, by_sentence: bool = True) -> DataFrame:
    """User messages with bucket (hot, correction, neutral), triggers, directed, and the heat hits of the whole text.

    By sentence, guards see one sentence at a time, as rows want it; else the whole text, as rates want it.
    """
    lex = lexicon or Lexicon()
    told = users.withColumn("norm", normalize(F.col("text"))).withColumn("body", strip_code(F.col("text")))
    told = told.withColumns({"heat": lex.heat_hits("norm"), "shouts": shouts("body")})
    told = told.withColumn("by", lex.heat_by_sentence("norm") if by_sentence else F.struct(F.col("heat").alias("hits"), F.lit(False).alias("directed")))
    hot = (F.size("by.hits") > 0) | (F.size("shouts") > 0)
    none = F.array().cast("array<string>")
    phrases = lambda hits: F.transform(hits, lambda h: h["phrase"])
    return told.withColumns({
        "bucket": F.when(hot, "hot").when(correction(F.col("norm")), "correction").otherwise("neutral"),
        "triggers": F.when(hot, F.concat(phrases(F.col("by.hits")), phrases(F.col("shouts")))).otherwise(none), "directed": F.when(hot, F.col("by.directed")).otherwise(False),
        "repeat_markers": markers(F.col("norm"), D.REPEATED), "unauthorized_markers": markers(F.col("norm"), D.UNAUTHORIZED), "words": content_words(F.col("norm")),
    }).drop("by", "body")
