"""Streams with state against the batch operators, rows dealt over batches in any order within the bound."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from parlance.operators import followthrough, turns
from parlance.streaming import conversations, stateful
from parlance.streaming.ordered import stateful_session

START = datetime(2026, 3, 1)


@pytest.fixture(scope="module")
def session(spark):
    return stateful_session(spark)


def dealt(session, folder, batches, schema, run):
    """What ``run(stream)`` gives in all, a batch of rows at a time; the same checkpoint throughout."""
    folder.mkdir(exist_ok=True)
    landing = str(folder / "in")
    for k, rows in enumerate(batches):
        session.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(landing)
        stream = session.readStream.schema(schema).parquet(landing)
        out = conversations.drained(run(stream), str(folder / "out"))
    return out.collect()


def disordered(rows, at, r, bound, parts):
    """``rows`` in batches; each row comes at most ``bound`` of event time after a later one."""
    late = sorted(rows, key=lambda x: at(x) + timedelta(seconds=r.uniform(0, bound.total_seconds())))
    size = -(-len(late) // parts)
    return [late[i : i + size] for i in range(0, len(late), size)]


LINES = "file_id string, line_no long, side string, at timestamp, bucket string, conceded boolean"


def lines(r, files=4, n=40):
    out = []
    for f in range(files):
        for k in range(n):
            side = r.choice(["user", "assistant", "assistant"])
            out.append((f"f{f}", k, side, START + timedelta(minutes=3 * k + f), r.choice(["hot", "neutral", None]) if side == "user" else None, r.random() < 0.3))
    return out


def brute_turns(rows):
    out = []
    for f in sorted({r[0] for r in rows}):
        open_turn = None
        n = 0
        for _, _, side, _, bucket, conceded in sorted(r for r in rows if r[0] == f):
            if side == "assistant":
                if open_turn:
                    open_turn[3] += 1
                    open_turn[4] |= conceded
                continue
            if open_turn:
                out.append(tuple(open_turn))
            open_turn = None
            if side == "user":
                n += 1
                open_turn = [f, n, bucket, 0, False]
        if open_turn:
            out.append(tuple(open_turn))
    return sorted(out, key=str)


def test_closed_turns_in_any_order_within_the_bound(session, tmp_path):
    r = random.Random(1)
    rows = lines(r)
    ends = [(f"f{f}", 1000, "end", START + timedelta(days=1), None, False) for f in range(4)]
    batches = disordered(rows, lambda x: x[3], r, timedelta(minutes=30), 4)
    batches[2] = batches[2] + batches[1][:9]  # delivered again
    batches += [ends, [("beat", 1, "assistant", START + timedelta(days=3), None, False)], [("f0", 5, "user", START, "hot", True), ("f1", 7, "assistant", None, None, None)]]
    got = dealt(session, tmp_path / "t", batches, LINES, lambda s: stateful.closed_turns(s, "30 minutes"))
    told = [(x.file_id, x.turn_id, x.bucket, x.replies, x.folded) for x in got if x.late_line is None]
    assert sorted(told, key=str) == brute_turns(rows)
    late = {(x.file_id, x.late_line) for x in got if x.late_line is not None}
    assert {("f0", 5), ("f1", 7)} <= late <= {("f0", 5), ("f1", 7)} | {(x[0], x[1]) for x in batches[1][:9]}


def test_a_late_line_changes_nothing(session, tmp_path):
    """The case that a count of lines in arrival order gets wrong."""
    at = lambda k: START + timedelta(minutes=k)
    rows = [("f", 1, "user", at(1), "hot", False), ("f", 4, "user", at(4), "neutral", False), ("f", 2, "assistant", at(2), None, True), ("f", 9, "end", at(9), None, False)]
    beat = [("beat", 1, "user", at(900), None, False)]
    for name, batches, want in (("in", [rows[:2], rows[2:], beat], [(1, "hot", 1, True), (2, "neutral", 0, False)]), ("late", [rows[:2], beat, rows[2:], [("beat", 2, "end", at(2000), None, False)]], [(1, "hot", 0, False)])):
        got = dealt(session, tmp_path / name, batches, LINES, lambda s: stateful.closed_turns(s, "10 minutes"))
        assert sorted((x.turn_id, x.bucket, x.replies, x.folded) for x in got if x.late_line is None and x.file_id == "f") == want
        assert sorted(x.late_line for x in got if x.late_line is not None) == ([] if name == "in" else [2, 9])


def test_silence_closes_a_turn(session, tmp_path):
    at = lambda k: START + timedelta(minutes=k)
    batches = [[("f", 1, "user", at(1), "hot", False), ("f", 2, "assistant", at(2), None, True)], [("beat", 1, "assistant", at(600), None, False)], [("f", 3, "assistant", at(700), None, True), ("f", 4, "user", at(701), None, False)], [("beat", 2, "assistant", at(1500), None, False)]]
    got = dealt(session, tmp_path / "q", batches, LINES, lambda s: stateful.closed_turns(s, "5 minutes", timedelta(minutes=60)))
    assert sorted((x.file_id, x.turn_id, x.bucket, x.replies, x.folded) for x in got) == [("f", 1, "hot", 1, True), ("f", 2, None, 0, False)]


SAID = "file_id string, line_no long, side string, at timestamp, text string"


def test_carried_context_equals_batch(session, spark, tmp_path):
    r = random.Random(3)
    vocabulary = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)] + ["stupid", "actually", "that isnt it", "you", "again,", "i told you"]
    rows = []
    for f in range(3):
        for k in range(40):
            side = r.choice(["user", "assistant"])
            rows.append((f"f{f}", k, side, START + timedelta(minutes=2 * k), " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 9)))))
    rows.append(("g", 0, "assistant", START, "hello"))
    columns = ["file_id", "line_no", "side", "turn_id", "depth", "user_bucket", "user_triggers", "user_directed", "user_repeat_markers", "user_unauthorized_markers", "user_similarity"]
    batches = disordered(rows, lambda x: x[3], r, timedelta(minutes=15), 4) + [[("beat", 0, "user", START + timedelta(days=2), "x")], [("f0", 1, "user", START, "late")]]

    def run(stream):
        return stateful.carried_context(turns.classified(stream.withColumn("text", F.coalesce("text", F.lit("")))), "15 minutes")

    got = dealt(session, tmp_path / "c", batches, SAID, run)
    batch = turns.with_turns(spark.createDataFrame(rows, SAID))
    users = turns.classified(batch.filter("side = 'user'"))
    users = users.join(turns.prior_similarity(users), ["file_id", "line_no"])
    context = ["bucket", "triggers", "directed", "repeat_markers", "unauthorized_markers", "similarity"]
    told = batch.join(users.select("file_id", "turn_id", *[F.col(c).alias(f"user_{c}") for c in context]), ["file_id", "turn_id"], "left")
    assert sorted((tuple(x[c] for c in columns) for x in got if not x.late), key=str) == sorted((tuple(x[c] for c in columns) for x in told.collect()), key=str)
    assert [(x.file_id, x.line_no) for x in got if x.late] == [("f0", 1)]
    assert len({x.user_similarity for x in got}) > 10


USERS = "project string, session string, file_id string, line_no long, ts string, text string"
PROMISES = "promise_id long, project string, session string, ts string, text string, trigger string"


def test_final_labels_equal_batch(session, spark, tmp_path):
    r = random.Random(4)
    vocabulary = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(120)] + ["still", "broken", "again,", "i told you", "we just compacted"]
    text = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    at = lambda: (START + timedelta(minutes=r.randrange(60 * 24 * 40))).isoformat()
    users = [(r.choice("ab"), r.choice("st"), f"f{i % 3}", i, at(), text(r.randint(1, 14))) for i in range(200)]
    promises = [(i, r.choice("ab"), r.choice("st"), at(), r.choice(["I'll do it", "let me know", "Reverting."]), text(r.randint(2, 12))) for i in range(40)]
    promises += [(90, "a", "s", users[0][4], "I'll do it", text(9)), (91, "a", None, "no time", "I'll do it", text(9)), (92, "z", "s", at(), "on it", "")]
    u, p = spark.createDataFrame(users, USERS), spark.createDataFrame(promises, PROMISES)
    want = followthrough.follow_through(p, u).collect()
    vocab = followthrough.vocabulary(followthrough.timeline(u)).select("project", "word", "is_ambient", "is_rare")
    vocab.write.parquet(str(tmp_path / "vocab"))
    vocab = session.read.parquet(str(tmp_path / "vocab"))
    day = lambda rows, k: sorted((x for x in rows if x[k][:1] == "2"), key=lambda x: datetime.fromisoformat(x[k]) + timedelta(hours=r.uniform(0, 20)))
    sent_u, sent_p = day(users, 4), day(promises, 3) + [promises[41]]
    # both streams are dealt by time, so that neither runs ahead of the other by more than the bound
    cut = [START + timedelta(days=d) for d in (10, 22, 31, 41)]
    stage = lambda ts: next((k for k, c in enumerate(cut) if ts[:1] != "2" or datetime.fromisoformat(ts) < c), len(cut))
    out = None
    for k in range(len(cut)):
        session.createDataFrame([x for x in sent_u if stage(x[4]) == k], USERS).write.mode("append").parquet(str(tmp_path / "u"))
        session.createDataFrame([x for x in sent_p if stage(x[3]) == k], PROMISES).write.mode("append").parquet(str(tmp_path / "p"))
        su, sp = session.readStream.schema(USERS).parquet(str(tmp_path / "u")), session.readStream.schema(PROMISES).parquet(str(tmp_path / "p"))
        out = conversations.drained(stateful.final_labels(sp, su, vocab, "1 day"), str(tmp_path / "out"))
    early = {x.promise_id for x in out.collect()}
    assert 0 < len(early) < len(promises)  # some are final before the end, none twice
    session.createDataFrame([("beat", "s", "f", 0, (START + timedelta(days=90)).isoformat(), "x")], USERS).write.mode("append").parquet(str(tmp_path / "u"))
    out = conversations.drained(stateful.final_labels(sp, su, vocab, "1 day"), str(tmp_path / "out"))
    columns = ["project", "session", "ts", "label", "downstream", "path", "turns_later", "evidence_ts", "shared", "shared_rare", "quote", "cross_session"]
    told = lambda rows: sorted(((str(x.promise_id), *(x[c] for c in columns)) for x in rows), key=str)
    assert told(out.collect()) == told(want)
    assert len({x.label for x in want}) == 4
    # the state is gone: only the beat of another project may be left
    state = session.read.format("statestore").option("path", str(tmp_path / "out" / "checkpoint")).option("stateVarName", "open").load()
    assert state.count() == 0


def test_months_as_they_end(session, tmp_path):
    at = lambda *d: datetime(2024, *d)
    batches = [[(at(1, 31, 23, 59), "user"), (at(2, 1), "user"), (at(2, 1), "assistant")], [(at(1, 30), "user"), (at(3, 1), None)], [(at(3, 20), "user"), (at(1, 1), "user"), (None, "user")], [(at(5, 1), "user")]]
    got = dealt(session, tmp_path / "m", batches, "at timestamp, side string", lambda s: stateful.monthly(s, "at", "5 days"))
    assert len(got) == 5 and {(x.month, x.side, x.n) for x in got} == {("2024-01", "user", 2), ("2024-02", "assistant", 1), ("2024-02", "user", 1), ("2024-03", None, 1), ("2024-03", "user", 1)}
