"""Conversations as streams with state: turns as they close, what each message carries of its turn, promises as their window ends, months.

All take rows in any order within a bound of event time (see :mod:`parlance.streaming.ordered`) and give what the batch
operators give on the same rows. Streams are to be read by :func:`parlance.streaming.ordered.stateful_session`.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import timedelta
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from parlance.functions import dictionary as D
from parlance.functions.lexicon import unicode
from parlance.functions.text import content_words, normalize, parse_ts
from parlance.operators.followthrough import LEAST_DOWNSTREAM, LEAST_TRIGGER, WINDOW_DAYS, WINDOW_TURNS, commits, timeline
from parlance.streaming.ordered import InOrder, grouped, milliseconds


def file_type(rows: DataFrame, column: str) -> str:
    return rows.schema[column].dataType.simpleString()


# ---- turns as they close


class ClosedTurns(InOrder):
    """Memory: the last line taken, the turn's number, and of an open turn its bucket, replies, whether one conceded, and the time of its last row."""

    columns = ("turn_id", "bucket", "replies", "folded", "late_line")

    def __init__(self, quiet: int | None) -> None:
        self.quiet = quiet

    def order(self, at: int, row: dict[str, Any]) -> Any:
        return row["line_no"]

    def late(self, row: dict[str, Any]) -> Iterator[tuple]:
        yield (None, None, None, None, row["line_no"])

    def closed(self) -> Iterator[tuple]:
        m = self.memory
        if m.pop("open", False):
            yield (m["turn"], m.pop("bucket", None), m["replies"], m["folded"], None)

    def take(self, at: int, row: dict[str, Any]) -> Iterator[tuple]:
        m = self.memory
        if row["line_no"] <= m.get("last", -1):
            if row["line_no"] < m["last"]:  # the last line itself is a repeat
                yield from self.late(row)
            return
        m["last"] = row["line_no"]
        if row["side"] == "assistant":
            if m.get("open"):
                m["replies"], m["folded"] = m["replies"] + 1, m["folded"] or bool(row.get("conceded"))
                m["at"] = at
            return
        yield from self.closed()
        if row["side"] == "user":
            m.update(turn=m.get("turn", 0) + 1, bucket=row.get("bucket"), replies=0, folded=False, open=True, at=at)

    def passed(self, mark: int) -> Iterator[tuple]:
        if self.quiet is not None and self.memory.get("open") and self.memory["at"] + self.quiet < mark:
            yield from self.closed()

    def wake(self) -> int | None:
        return self.memory["at"] + self.quiet + 1 if self.quiet is not None and self.memory.get("open") else None


def closed_turns(messages: DataFrame, delay: str = "1 hour", quiet: timedelta | None = None) -> DataFrame:
    """(file_id, turn_id, bucket, replies, folded, late_line) of each turn, once it is over.

    A turn is over at the next user message, at a row with side 'end', or, if ``quiet`` is given, when its file has been
    silent for so long. ``messages`` has file_id, line_no, side, at (a timestamp), bucket (of user messages, may be null) and
    conceded. Lines may come in any order within ``delay``; a line delivered twice counts once. A later one changes nothing
    and gives a row of its own with late_line, all else null. Replies before any user message, or after a turn was
    closed for silence, belong to no turn. The state of a file is what waits and six values.
    """
    processor = ClosedTurns(None if quiet is None else milliseconds(quiet))
    columns = [F.col("line_no").cast("long").alias("line_no"), "side", F.col("bucket").cast("string").alias("bucket"), F.col("conceded").cast("boolean").alias("conceded")]
    schema = f"file_id {file_type(messages, 'file_id')}, turn_id long, bucket string, replies long, folded boolean, late_line long"
    return grouped(messages, "file_id", "at", delay, columns).transformWithStateInPandas(processor, schema, "append", "eventTime")


# ---- what messages carry of their turn

CONTEXT = ("bucket", "triggers", "directed", "repeat_markers", "unauthorized_markers")


class Carried(InOrder):
    """Memory: the last line taken, turn, depth and the user's context. Words of earlier user messages are an inverted index:
    a map from a word to the messages that hold it, and one from a message to how many words it has."""

    columns = ("line_no", "side", "turn_id", "depth", *(f"user_{c}" for c in CONTEXT), "best", "late")

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.holders = handle.getMapState("holders", "word string", "messages array<int>")
        self.sizes = handle.getMapState("sizes", "message int", "words int")

    def order(self, at: int, row: dict[str, Any]) -> Any:
        return row["line_no"]

    def late(self, row: dict[str, Any]) -> Iterator[tuple]:
        yield (row["line_no"], row["side"], *[None] * (len(self.columns) - 3), True)

    def most_alike(self, message: int, words: list[str]) -> float:
        """The highest Jaccard similarity of ``words`` to those of an earlier message; they join the index."""
        shared: dict[int, int] = {}
        for w in words:
            held = list(self.holders.getValue((w,))[0]) if self.holders.containsKey((w,)) else []
            for other in held:
                shared[other] = shared.get(other, 0) + 1
            self.holders.updateValue((w,), ([*held, message],))
        self.sizes.updateValue((message,), (len(words),))
        # fewer shared words mean less similarity at any size, unless the other message is small: ask for sizes by falling count
        best = 0.0
        for other, k in sorted(shared.items(), key=lambda x: -x[1]):
            if k / len(words) <= best:
                break
            best = max(best, k / (len(words) + self.sizes.getValue((other,))[0] - k))
        return best

    def take(self, at: int, row: dict[str, Any]) -> Iterator[tuple]:
        m = self.memory
        if row["line_no"] <= m.get("last", -1):
            if row["line_no"] < m["last"]:
                yield from self.late(row)
            return
        m["last"] = row["line_no"]
        if row["side"] == "user":
            m["turn"], m["depth"] = m.get("turn", 0) + 1, 0
            m["best"] = self.most_alike(m["turn"], row.get("words") or [])
            m["context"] = [row.get(c) for c in CONTEXT]
        else:
            m["depth"] = m.get("depth", 0) + 1
        yield (row["line_no"], row["side"], m.get("turn", 0), m["depth"], *(m.get("context") or [None] * len(CONTEXT)), m.get("best"), False)


def carried_context(messages: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Every message with its turn and what it carries of the turn's user message, as match rows have it.

    Columns: file_id, line_no, side, turn_id, depth, user_bucket, user_triggers, user_directed, user_repeat_markers,
    user_unauthorized_markers, user_similarity (the highest Jaccard similarity of the user's words to those of any earlier
    user message of the file, exact, 3 decimals) and late. ``messages`` has file_id, line_no, side, at, and of user messages
    the columns of :func:`parlance.operators.turns.classified`. Messages before any user message carry nulls. A late line is
    told with nulls and changes nothing; a line delivered twice counts once. A file's state grows with its distinct words.
    """
    schema = f"file_id {file_type(messages, 'file_id')}, line_no long, side string, turn_id long, depth int, user_bucket string, user_triggers array<string>, user_directed boolean, "
    schema += "user_repeat_markers array<string>, user_unauthorized_markers array<string>, best double, late boolean"
    columns = [F.col("line_no").cast("long").alias("line_no"), "side", *CONTEXT, F.array_distinct("words").alias("words")]
    told = grouped(messages, "file_id", "at", delay, columns).transformWithStateInPandas(Carried(), schema, "append", "eventTime")
    return told.withColumn("user_similarity", F.round("best", 3)).drop("best")


# ---- promises as their window ends


class Finalised(InOrder):
    """Memory: turns of the project so far. ``open`` maps promises to what is known of them, ``waits`` trigger words to the open promises that have them."""

    key = "project"
    columns = ("promise_id", "session", "ts", "label", "downstream", "path", "turns_later", "evidence_ts", "shared", "shared_rare", "quote", "cross_session")

    def __init__(self, variant: str, window: int) -> None:
        self.variant, self.window = variant, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = handle.getMapState("open", "promise string", "end long, first long, session string, ts string, eligible boolean, words array<string>, rare array<string>, evidence string")
        self.waits = handle.getMapState("waits", "word string", "promises array<string>")

    def order(self, at: int, row: dict[str, Any]) -> Any:
        return (at, row["ts"], row["kind"], str(row.get("file_id")), row.get("line_no") or 0)

    def late(self, row: dict[str, Any]) -> Iterator[tuple]:
        if row["kind"] == 1:  # a promise that can't be placed meets nothing
            yield self.final(row["promise_id"], row.get("session"), row["ts"], row["eligible"], 0, 0, None)

    def final(self, promise: str, session: str | None, ts: str, eligible: bool, known: int, downstream: int, evidence: dict | None) -> tuple:
        thin = downstream < LEAST_DOWNSTREAM or known < LEAST_TRIGGER
        label = "ineligible" if not eligible else "unobserved" if thin else "not_honored" if evidence else "honored"
        e = evidence if label == "not_honored" else {}
        across = None if not e or e.get("session") is None or session is None else e["session"] != session
        return (promise, session, ts, label, downstream, *(e.get(c) for c in self.columns[5:11]), across)

    def due(self, until: int) -> Iterator[tuple]:
        """Promises whose window ends by ``until`` become final, and are forgotten."""
        ends = self.memory.setdefault("ends", {})
        for promise in sorted((p for p, end in ends.items() if end <= until), key=lambda p: (ends[p], p)):
            del ends[promise]
            _, first, session, ts, eligible, words, _, evidence = self.open.getValue((promise,))
            self.open.removeKey((promise,))
            for w in words:
                left = [p for p in self.waits.getValue((w,))[0] if p != promise]
                if left:
                    self.waits.updateValue((w,), (left,))
                else:
                    self.waits.removeKey((w,))
            downstream = min(self.memory.get("turns", 0) - first, WINDOW_TURNS)
            yield self.final(promise, session, ts, eligible, len(words), downstream, json_of(evidence))

    def take(self, at: int, row: dict[str, Any]) -> Iterator[tuple]:
        yield from self.due(at)
        m = self.memory
        if row["kind"] == 0:
            m["turns"] = m.get("turns", 0) + 1
            self.meet(m["turns"], row)
            return
        promise = row["promise_id"]
        if row["kind"] == 1:
            m.setdefault("ends", {})[promise] = at + self.window
            self.open.updateValue((promise,), (at + self.window, m.get("turns", 0), row.get("session"), row["ts"], row["eligible"], [], [], ""))
        elif promise in m.get("ends", {}):
            end, first, session, ts, eligible, words, rare, evidence = self.open.getValue((promise,))
            rare = [*rare, row["word"]] if row["rare"] else list(rare)
            self.open.updateValue((promise,), (end, first, session, ts, eligible, [*words, row["word"]], rare, evidence))
            held = list(self.waits.getValue((row["word"],))[0]) if self.waits.containsKey((row["word"],)) else []
            self.waits.updateValue((row["word"],), ([*held, promise],))

    def meet(self, place: int, row: dict[str, Any]) -> None:
        """A turn meets the open promises that share words with it; no others are looked at."""
        shared: dict[str, list[str]] = {}
        for w in row.get("words") or []:
            if self.waits.containsKey((w,)):
                for p in self.waits.getValue((w,))[0]:
                    shared.setdefault(p, []).append(w)
        for promise, words in shared.items():
            end, first, session, ts, eligible, own, rare, evidence = self.open.getValue((promise,))
            few = sorted(set(words) & set(rare))
            path = "explicit" if row["again"] and len(words) >= 2 else None
            if not path and self.variant != "explicit" and len(few) >= 2 and row["complains"]:
                path = "complaint"
            if not path and self.variant == "full" and len(few) >= 3:
                path = "strong"
            before = json_of(evidence)
            if not path or place - first > WINDOW_TURNS or (before and (before["path"] == "explicit" or path != "explicit")):
                continue
            found = {"path": path, "turns_later": place - first, "evidence_ts": row["ts"], "shared": sorted(words)[:8], "shared_rare": few[:8], "quote": row.get("quote"), "session": row.get("session")}
            self.open.updateValue((promise,), (end, first, session, ts, eligible, list(own), list(rare), json.dumps(found)))

    def passed(self, mark: int) -> Iterator[tuple]:
        yield from self.due(mark)
        if not self.memory.get("ends"):
            self.memory.pop("ends", None)
            self.memory.pop("turns", None)  # counts start anew once nothing is open

    def wake(self) -> int | None:
        ends = self.memory.get("ends")
        return min(ends.values()) + 1 if ends else None


def json_of(text: str) -> dict | None:
    return json.loads(text) if text else None


def final_labels(promises: DataFrame, users: DataFrame, vocabulary: DataFrame, delay: str = "1 day", variant: str = "full") -> DataFrame:
    """Each promise once, when its window is over: the columns of :func:`parlance.operators.followthrough.follow_through`.

    ``promises`` (promise_id, project, session, ts, text, trigger) and ``users`` (as for ``timeline``) are streams; ``vocabulary``
    (project, word, is_ambient, is_rare) is a table, as ``followthrough.vocabulary`` gives it of what was said so far. Rows
    of both may come in any order within ``delay``. A promise becomes final when event time has passed its 15th day:
    ineligible, unobserved (too little was said), not_honored or honored. Its state goes then, so a project's state
    is its open promises and the words they wait for. promise_id is given back as a string. Late turns count nowhere; late
    promises, and those whose time doesn't parse, meet nothing. A promise delivered twice counts once.
    """
    flags = {"again": F.col("norm").rlike(unicode(D.RERAISE)), "complains": F.col("norm").rlike(unicode(D.COMPLAINT)), "quotes": F.col("norm").rlike(D.QUOTEBACK)}
    real = timeline(users).withColumns(flags).filter("not quotes and at is not null")
    turns = real.select("project", F.timestamp_seconds("at").alias("at"), F.lit(0).alias("kind"), "ts", F.col("file_id").cast("string").alias("file_id"), F.col("line_no").cast("long").alias("line_no"), "session", "again", "complains", "words", F.substring("norm", 1, 160).alias("quote"))
    made = promises.select("project", parse_ts(F.col("ts")).alias("at"), "ts", F.col("promise_id").cast("string").alias("promise_id"), "session", commits(F.coalesce("text", F.lit(""))).alias("eligible"), "trigger")
    heads = made.drop("trigger").withColumn("kind", F.lit(1))
    words = made.filter("eligible").select("project", "at", "ts", "promise_id", F.explode(content_words(normalize(F.coalesce("trigger", F.lit(""))), 2)).alias("word"))
    known = vocabulary.select(F.col("project").alias("_project"), F.col("word").alias("_word"), "is_ambient", "is_rare")
    words = words.join(known, (F.col("project") == F.col("_project")) & (F.col("word") == F.col("_word")), "left").filter("not coalesce(is_ambient, false)")
    words = words.select("project", "at", "ts", "promise_id", "word", F.coalesce("is_rare", F.lit(False)).alias("rare"), F.lit(2).alias("kind"))
    every = turns.unionByName(heads, allowMissingColumns=True).unionByName(words, allowMissingColumns=True)
    schema = "project string, promise_id string, session string, ts string, label string, downstream long, path string, turns_later long, evidence_ts string, shared array<string>, shared_rare array<string>, quote string, cross_session boolean"
    payload = [c for c in every.columns if c not in ("project", "at")]
    processor = Finalised(variant, milliseconds(timedelta(days=WINDOW_DAYS + 1)))
    return grouped(every, "project", "at", delay, payload).transformWithStateInPandas(processor, schema, "append", "eventTime")


# ---- calendar months


class Months(StatefulProcessor):
    """A month's counts by side, from the counts of its days. Days reach it once the watermark has passed them, so none is late for its month."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getMapState("sums", "side string", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for side, n, end in zip(batch["side"], batch["n"], batch["end"]):
                before = self.sums.getValue((side,))[0] if self.sums.containsKey((side,)) else 0
                self.sums.updateValue((side,), (before + int(n),))
                self.handle.registerTimer(int(end))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        found = [(key[0], side[0], n[0]) for side, n in self.sums.iterator()]
        self.sums.clear()
        if found:
            yield pd.DataFrame(found, columns=["month", "side", "n"], dtype=object)

    def close(self) -> None:
        pass


def monthly(messages: DataFrame, time: str, delay: str = "7 days") -> DataFrame:
    """(month, side, n): messages of each calendar month and side, once the month is over and ``delay`` has passed.

    Days are counted first, with partial sums, so a month is some thirty rows a side. Messages that come later than
    ``delay`` count nowhere, and neither do those without a time.
    """
    days = messages.withWatermark(time, delay).groupBy(F.window(time, "1 day").alias("day"), "side").agg(F.count("*").alias("n"))
    start = F.col("day.start")
    told = days.select(F.date_format(start, "yyyy-MM").alias("month"), "side", "n", F.unix_millis(F.to_timestamp(F.add_months(F.trunc(start, "month"), 1))).alias("end"))
    return told.groupBy("month").transformWithStateInPandas(Months(), "month string, side string, n long", "append", "eventTime")
