"""Match rows: every dictionary hit with its message, its turn and the other side's message, in 26 columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions.lexicon import Lexicon
from parlance.functions.text import normalize, snippet
from parlance.operators.turns import classified, first_occurrence, next_reply_lines, prior_similarity, with_turns
from parlance.sources.scratch import hinted, settled

#: Characters kept of a message, and of the other side's.
MOST_TEXT = 4000
BASE = ["machine_id", "root_slug", "project", "session", "timestamp", "model", "msg_fingerprint"]
COLUMNS = [
    *BASE, "side", "category", "construct", "phrase", "char_offset", "snippet", "message_text", "message_truncated", "counterpart_side",
    "counterpart_text", "turn_bucket", "trigger_words", "directed_at_claude", "depth_in_turn", "repeat_markers", "unauthorized_markers",
    "prior_turn_similarity", "user_repeated_prior_instruction", "user_says_action_unauthorized",
]
CONTEXT = ["text", "bucket", "triggers", "directed", "repeat_markers", "unauthorized_markers", "similarity"]


def match_rows(population: DataFrame, lexicon: Lexicon | None = None) -> DataFrame:
    """COLUMNS, then file_id, line_no and hit_no, which give the rows their order.

    ``population`` has the columns of messages and of their files, (file_id, line_no) being unique. The next reply is found
    before repeated fingerprints go; turns, context and similarity after. An assistant message before any user message has
    null turn columns. Messages are numbered by slim rows of four columns; texts are read where they lie, and move only of
    user messages, of assistant messages past the gate, and of replies to heated messages.
    """
    lex = lexicon or Lexicon()
    base = population.select("machine_id", "root_slug", "project", "session", F.coalesce("ts", F.lit("")).alias("timestamp"), F.coalesce("model", F.lit("")).alias("model"), F.col("fingerprint").alias("msg_fingerprint"), "file_id", "line_no", "side", F.coalesce("text", F.lit("")).alias("text"))
    slim = base.select("file_id", "line_no", "side", "msg_fingerprint")
    every = with_turns(slim)
    asked = every.filter("side = 'user'").select("file_id", "turn_id", "line_no")
    replies = next_reply_lines(every).withColumnRenamed("line_no", "reply_line").join(asked, ["file_id", "turn_id"]).select("file_id", "line_no", "reply_line")
    turns = settled(with_turns(first_occurrence(slim, "msg_fingerprint")).select("file_id", "line_no", "side", "turn_id", "depth"), "turns")
    placed = turns.select("file_id", "line_no", "turn_id", "depth")
    users = settled(classified(base.filter("side = 'user'").join(placed, ["file_id", "line_no"]), lex), "users")
    users = users.join(prior_similarity(users), ["file_id", "line_no"])
    context = users.select("file_id", "turn_id", *[F.col(c).alias(f"user_{c}") for c in CONTEXT])
    cut = lambda c: F.substring(c, 1, MOST_TEXT)
    human = F.lit(None).cast("boolean")

    def rows(df: DataFrame, hits, side: str) -> DataFrame:
        told = df.select("*", F.posexplode(hits).alias("hit_no", "hit"))
        user = side == "user"
        pick = lambda c, default=None: F.col(c if user else f"user_{c}") if default is None else F.coalesce(F.col(c if user else f"user_{c}"), default)
        none = F.array().cast("array<string>")
        category = F.col("hit.category")
        return told.select(
            *BASE, F.lit(side).alias("side"), category.alias("category"), (F.lit("frustration") if user else lex.construct(category)).alias("construct"),
            F.col("hit.phrase").alias("phrase"), F.col("hit.start").alias("char_offset"), snippet(F.col("text"), F.col("hit.start")).alias("snippet"), cut(F.col("text")).alias("message_text"),
            (F.length("text") > MOST_TEXT).alias("message_truncated"), F.lit("assistant" if user else "user").alias("counterpart_side"),
            cut(F.coalesce(F.col("reply" if user else "user_text"), F.lit(""))).alias("counterpart_text"), pick("bucket").alias("turn_bucket"),
            pick("triggers", none).alias("trigger_words"), pick("directed", F.lit(False)).alias("directed_at_claude"), F.col("depth").alias("depth_in_turn"),
            pick("repeat_markers", none).alias("repeat_markers"), pick("unauthorized_markers", none).alias("unauthorized_markers"),
            pick("similarity", F.lit(0.0)).alias("prior_turn_similarity"), human.alias("user_repeated_prior_instruction"), human.alias("user_says_action_unauthorized"),
            "file_id", "line_no", "hit_no",
        )

    spoken = base.filter("side = 'assistant'").withColumn("norm", normalize(F.col("text"))).filter(lex.gate("norm")).join(placed, ["file_id", "line_no"])
    spoken = spoken.join(context, ["file_id", "turn_id"], "left")
    heated = users.filter((F.size("heat") > 0) | (F.size("shouts") > 0)).join(replies, ["file_id", "line_no"], "left")
    wanted = settled(heated.select("file_id", F.col("reply_line").alias("line_no")).filter("line_no is not null").distinct(), "replies")
    said = base.filter("side = 'assistant'").join(hinted(wanted), ["file_id", "line_no"], "left_semi")
    heated = heated.join(said.select("file_id", F.col("line_no").alias("reply_line"), F.col("text").alias("reply")), ["file_id", "reply_line"], "left")
    return rows(heated, F.concat("heat", "shouts"), "user").unionByName(rows(spoken, lex.assistant_hits("norm"), "assistant"))


def tally(matches: DataFrame) -> DataFrame:
    """Hits and distinct messages by side, category and phrase, with subtotals (null: all)."""
    return matches.rollup("side", "category", "phrase").agg(F.count("*").alias("hits"), F.countDistinct("msg_fingerprint").alias("messages"))
