"""Promises followed through or raised again: vocabularies, the forward window and the four labels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions import dictionary as D
from parlance.functions.bloom import held_rows
from parlance.functions.lexicon import unicode
from parlance.functions.text import content_words, gap, normalize, parse_ts
from parlance.sources.scratch import hinted, settled

ELIGIBLE = ("concession", "acknowledgment")
LEAST_DOWNSTREAM, WINDOW_DAYS, WINDOW_TURNS, LEAST_TRIGGER = 20, 14, 5000, 4
AMBIENT, RARE = 0.30, 0.005
#: Seconds of a project's timeline that are sorted together, so that a busy project's day is many tasks.
PART_SECONDS = 900
#: Turns of a project among which the next marked one is found at once.
SEGMENT_TURNS = 4096


def commits(text: Column) -> Column:
    return text.rlike(f"(?i){D.COMMIT}")


def timeline(users: DataFrame) -> DataFrame:
    """project, session, file_id, line_no, ts, at (seconds), norm (first 1500 characters) and words of user messages with a time."""
    norm = normalize(F.coalesce("text", F.lit("")))
    told = users.filter("ts is not null").select("project", "session", "file_id", "line_no", "ts", F.unix_timestamp(parse_ts(F.col("ts"))).alias("at"), norm.alias("full"))
    return told.select("project", "session", "file_id", "line_no", "ts", "at", F.substring("full", 1, 1500).alias("norm"), content_words(F.col("full"), 2).alias("words"))


def vocabulary(docs: DataFrame, group: str = "project", words: str = "words", ambient: float = AMBIENT, rare: float = RARE, only: DataFrame | None = None) -> DataFrame:
    """group, word, df, n, is_ambient, is_rare: in how many of a group's n rows a word occurs. ``words`` has no repeats.

    With ``only`` (group, word) the words of its rows are told, and perhaps a few others; the rest are left out before they move.
    """
    n = docs.groupBy(group).agg(F.count("*").alias("n"))
    said = docs.select(group, F.explode(words).alias("word"))
    df = (said if only is None else held_rows(said, only, group, "word")).groupBy(group, "word").agg(F.count("*").alias("df"))
    told = df.join(n, group)
    return told.withColumns({"is_ambient": F.col("df") / F.col("n") > ambient, "is_rare": F.col("df") <= F.greatest(F.lit(2), F.floor(F.lit(rare) * F.col("n")))})


def forward(promises: DataFrame, turns: DataFrame, days: int = WINDOW_DAYS, most: int = WINDOW_TURNS) -> DataFrame:
    """Later turns of each promise's project within ``days`` whole days, with turns_later, at most ``most`` of them.

    ``promises`` has promise_id, project, ts and at, one row each; ``turns`` project, ts, at, file_id, line_no and more,
    (project, file_id, line_no) being unique. Turns are numbered once, and a promise meets exactly the numbers it is to
    have, by (project, place). Rows whose time doesn't parse meet nothing.
    """
    marked, line = placed(promises.select("promise_id", "project", "ts", "at"), turns, days, most)
    ahead = marked.filter("last > first").select("promise_id", "project", F.col("at").alias("from_at"), "first", F.explode(F.sequence(F.col("first") + 1, F.col("last"))).alias("place"))
    met = ahead.withColumn("turns_later", (F.col("place") - F.col("first")).cast("int")).alias("p").join(line.alias("t"), ["project", "place"])
    return met.select("p.promise_id", "p.from_at", *[F.col("project") if c == "project" else F.col(f"t.{c}") for c in turns.columns], "p.turns_later")


def first_marked(promises: DataFrame, turns: DataFrame, marked: str, days: int = WINDOW_DAYS, most: int = WINDOW_TURNS) -> DataFrame:
    """(promise_id, turns_later) of the first later turn within the window for which the condition ``marked`` holds, if any.

    Both as for :func:`forward`. No promise meets its turns: the next marked turn is found in segments of a project's
    timeline, then over the segments.
    """
    told, line = placed(promises.select("promise_id", "project", "ts", "at"), turns, days, most)
    hits = line.filter(marked).select("project", "place", F.col("place").alias("hit"), F.lit(False).alias("asks"))
    events = hits.unionByName(told.filter("last > first").select("project", F.col("first").alias("place"), "promise_id", "last", F.lit(True).alias("asks")), allowMissingColumns=True)
    events = events.withColumn("segment", F.floor(F.col("place") / SEGMENT_TURNS))
    here = F.min("hit").over(Window.partitionBy("project", "segment").orderBy(F.desc("place")).rangeBetween(Window.unboundedPreceding, -1))
    firsts = events.groupBy("project", "segment").agg(F.min("hit").alias("hit"))
    after = F.min("hit").over(Window.partitionBy("project").orderBy(F.desc("segment")).rowsBetween(Window.unboundedPreceding, -1))
    firsts = firsts.select("project", "segment", after.alias("after"))
    found = events.withColumn("here", here).filter("asks").join(firsts, ["project", "segment"]).withColumn("at", F.coalesce("here", "after"))
    return found.filter("at <= last").select("promise_id", (F.col("at") - F.col("place")).alias("turns_later"))


def without_quotes(turns: DataFrame) -> DataFrame:
    """Turns less those that quote the transcript."""
    return turns.filter(~F.col("norm").rlike(D.QUOTEBACK))


def placed(promises: DataFrame, turns: DataFrame, days: int = WINDOW_DAYS, most: int = WINDOW_TURNS) -> tuple[DataFrame, DataFrame]:
    """(promises with first and last, turns with place): real turns of a project are numbered in time, from 1.

    Those that follow a promise within the window of ``days`` whole days are first < place <= last, at most ``most``. Each promise adds two
    marks to the timeline, so that one running count by parts of a day, then over the parts' sums, gives all numbers: no promise
    meets its turns. ``turns`` are those that quote nothing; rows whose time doesn't parse have no place.
    """
    part = F.floor(F.col("at") / PART_SECONDS)
    slim = ["project", "at", "ts", "kind", "file_id", "line_no", "promise_id"]
    none = lambda kind: F.lit(None).cast(kind)
    file_type = dict(turns.dtypes)["file_id"]
    t = turns.filter("at is not null").withColumns({"kind": F.lit(0), "promise_id": none(dict(promises.dtypes)["promise_id"])}).select(slim)
    marks = promises.filter("at is not null").withColumns({"file_id": none(file_type), "line_no": none("long")})
    start = marks.withColumn("kind", F.lit(1)).select(slim)
    end = marks.withColumns({"kind": F.lit(-1), "at": F.col("at") + (days + 1) * 86_400, "ts": F.lit("")}).select(slim)
    events = t.unionByName(start).unionByName(end).withColumns({"_part": part, "_turn": (F.col("kind") == 0).cast("long")})
    sums = events.groupBy("project", "_part").agg(F.sum("_turn").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy("project").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("project", "_part", before.alias("_before"))
    inner = F.sum("_turn").over(Window.partitionBy("project", "_part").orderBy("at", "ts", "kind", "file_id", "line_no").rowsBetween(Window.unboundedPreceding, 0))
    told = events.withColumn("_inner", inner).join(sums, ["project", "_part"]).withColumn("place", F.col("_inner") + F.col("_before"))
    told = settled(told.select("project", "file_id", "line_no", "promise_id", "kind", "place"), "places")
    edges = told.filter("kind != 0").groupBy("promise_id").agg(F.max(F.when(F.col("kind") == 1, F.col("place"))).alias("first"), F.max(F.when(F.col("kind") == -1, F.col("place"))).alias("last"))
    edges = edges.withColumn("last", F.least("last", F.col("first") + most))
    at = told.filter("kind = 0").select("project", "file_id", "line_no", "place")
    return promises.join(edges, "promise_id", "left"), turns.join(at, ["project", "file_id", "line_no"])


@dataclass(frozen=True)
class Evidence:
    """What labels are told from, whatever the rules: promises with their place, their trigger words, the turns that meet them, all turns."""

    promises: DataFrame
    words: DataFrame
    met: DataFrame
    turns: DataFrame


def evidence(promises: DataFrame, users: DataFrame) -> Evidence:
    """``promises``: promise_id, project, session, ts, text, trigger (the user text answered), one row each; ``users`` as for
    :func:`timeline`, (project, file_id, line_no) being unique.

    A turn can only raise a promise again if it has a marker or shares rare words, so promises meet turns by joins on
    (project, word) with one of both given; nothing is gathered by project. Of all that was said only words that some promise
    waits for are counted, and only those that aren't ambient meet one: Bloom filters tell before anything is shuffled.
    """
    # the flags are settled with the text, as beside an explode they would be told anew for every word
    flags = {"again": F.col("norm").rlike(unicode(D.RERAISE)), "complains": F.col("norm").rlike(unicode(D.COMPLAINT)), "quotes": F.col("norm").rlike(D.QUOTEBACK)}
    quoted = F.substring("norm", 1, 160).alias("quote")
    turns = settled(timeline(users).withColumns(flags).select("project", "session", "file_id", "line_no", "ts", "at", *flags, "words", quoted), "timeline")
    told = promises.withColumns({"at": F.unix_timestamp(parse_ts(F.col("ts"))), "eligible": commits(F.coalesce("text", F.lit("")))})
    words = settled(told.filter("eligible").select("promise_id", "project", F.explode(content_words(normalize(F.coalesce("trigger", F.lit(""))), 2)).alias("word")), "said-words")
    vocab = vocabulary(turns, only=words).select("project", "word", "is_ambient", "is_rare")
    distinct = words.join(vocab, ["project", "word"], "left").filter("not coalesce(is_ambient, false)").withColumn("is_rare", F.coalesce("is_rare", F.lit(False)))
    distinct = settled(distinct.select("promise_id", "project", "word", "is_rare"), "trigger-words")
    real = turns.filter("not quotes")
    marked, line = placed(told, real.select("project", "file_id", "line_no", "ts", "at"))
    # trigger words are not ambient, so the words that a turn shares with them need no look at the vocabulary
    # turns with a marker meet all trigger words, other turns the rare ones alone
    scope = F.explode(F.when(F.col("is_rare"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))).alias("again")
    scoped = distinct.select("*", scope)
    trigger = scoped.join(marked.select("promise_id", "first", "last"), "promise_id")
    # words are filtered where the turns lie; those that are left look up their turn's place
    spoken = held_rows(real.select("project", "file_id", "line_no", "again", "complains", F.explode("words").alias("word")), scoped, "project", "word", "again")
    spoken = spoken.join(line.select("project", "file_id", "line_no", "place"), ["project", "file_id", "line_no"])
    met = trigger.join(spoken, ["project", "word", "again"]).filter((F.col("place") > F.col("first")) & (F.col("place") <= F.col("last")))
    carried = [F.first(c).alias(c) for c in ("again", "complains", "first", "file_id", "line_no")]
    met = met.groupBy("promise_id", "project", "place").agg(F.count("*").alias("n"), F.sum(F.col("is_rare").cast("long")).alias("few"), *carried)
    return Evidence(marked, distinct, settled(met.filter("again and n >= 2 or few >= 2"), "met"), turns)


def labels(found: Evidence, variant: str = "full") -> DataFrame:
    """Label and evidence of each promise by a variant of the rules: explicit (markers alone), no_strong, full.

    Labels: ineligible (no commitment), unobserved (under 20 later turns, or under 4 distinctive trigger words), not_honored
    (raised again), honored. Evidence is the first explicit turn, else the first of any path.
    """
    marked, distinct, met, turns = found.promises, found.words, found.met, found.turns
    path = F.when(F.col("again") & (F.col("n") >= 2), "explicit")
    if variant != "explicit":
        path = path.when((F.col("few") >= 2) & F.col("complains"), "complaint")
    path = path.when(F.col("few") >= 3, "strong") if variant == "full" else path
    hits = met.withColumn("path", path).filter("path is not null")
    best = hits.groupBy("promise_id", "project").agg(F.min_by(F.struct("path", "file_id", "line_no", (F.col("place") - F.col("first")).alias("turns_later")), F.struct(F.col("path") != "explicit", F.col("place"))).alias("e"))
    best = settled(best.select("promise_id", "project", "e.*"), "best")
    turns = turns.join(hinted(best.select("project", "file_id", "line_no").distinct(), 512), ["project", "file_id", "line_no"], "left_semi")
    own = distinct.join(best.select("promise_id"), "promise_id", "left_semi").groupBy("promise_id").agg(F.collect_set("word").alias("all"), F.collect_set(F.when(F.col("is_rare"), F.col("word"))).alias("rare"))
    shown = turns.select("project", "file_id", "line_no", F.col("session").alias("turn_session"), F.col("ts").alias("evidence_ts"), "words", "quote")
    said = best.join(shown, ["project", "file_id", "line_no"]).join(own, "promise_id")
    least = lambda xs: F.slice(F.array_sort(F.array_intersect(xs, "words")), 1, 8)
    said = said.select("promise_id", "path", "turns_later", "turn_session", "evidence_ts", least("all").alias("shared"), least("rare").alias("shared_rare"), "quote")
    known = distinct.groupBy("promise_id").agg(F.count("*").alias("known"))
    out = marked.join(known, "promise_id", "left").join(said, "promise_id", "left").withColumn("downstream", F.coalesce(F.col("last") - F.col("first"), F.lit(0)))
    thin = (F.col("downstream") < LEAST_DOWNSTREAM) | (F.coalesce("known", F.lit(0)) < LEAST_TRIGGER)
    label = F.when(~F.col("eligible"), "ineligible").when(thin, "unobserved").when(F.col("path").isNotNull(), "not_honored").otherwise("honored")
    shown = lambda c, name: F.when(F.col("label") == "not_honored", c).alias(name)
    told = [shown(F.col(c), c) for c in ("path", "turns_later", "evidence_ts", "shared", "shared_rare", "quote")]
    return out.withColumn("label", label).select("promise_id", "project", "session", "ts", "label", "downstream", *told, shown(F.col("turn_session") != F.col("session"), "cross_session"))


def follow_through(promises: DataFrame, users: DataFrame, variant: str = "full") -> DataFrame:
    """Label and evidence of each promise, see :func:`evidence` and :func:`labels`."""
    return labels(evidence(promises, users), variant)


def downstream_view(promises: DataFrame, users: DataFrame, k: int = 6) -> DataFrame:
    """The next k real turns of each promise: position among all later turns, gap and text.

    Turns are numbered twice, with and without those that quote the transcript; a promise meets k numbers, and no others.
    """
    asked = promises.withColumn("at", F.unix_timestamp(parse_ts(F.col("ts")))).select("promise_id", "project", "ts", "at")
    turns = settled(timeline(users).select("project", "file_id", "line_no", "ts", "at", "norm"), "timeline")
    slim = turns.select("project", "file_id", "line_no", "ts", "at", F.col("norm").rlike(D.QUOTEBACK).alias("quotes"))
    every, line = placed(asked, slim)
    real, real_line = placed(asked, slim.filter("not quotes"))
    wanted = real.filter("last > first").select("promise_id", "project", F.explode(F.sequence(F.col("first") + 1, F.least("last", F.col("first") + k))).alias("place"))
    met = wanted.join(real_line.select("project", "file_id", "line_no", "place"), ["project", "place"]).drop("place")
    met = met.join(line.select("project", "file_id", "line_no", "place"), ["project", "file_id", "line_no"])
    met = met.join(every.select("promise_id", F.col("at").alias("from_at"), "first", "last"), "promise_id").filter("place <= last")
    told = met.join(turns.select("project", "file_id", "line_no", "at", "norm"), ["project", "file_id", "line_no"])
    return told.select("promise_id", (F.col("place") - F.col("first")).cast("int").alias("pos"), gap(F.col("at") - F.col("from_at")).alias("gap"), F.substring("norm", 1, 260).alias("text"))
