"""The engine against hand-made corpora and independent plain-Python oracles."""

import json
import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from parlance.functions import stats
from parlance.functions.lexicon import Lexicon
from parlance.operators import audits, bundles, checks, followthrough, matches, rates, turns
from parlance.plans import stats_plans
from parlance.sources import transcripts

MESSAGES = "file_id long, line_no long, side string, text string, ts string, model string, fingerprint string, machine_id string, root_slug string, project string, session string"


def corpus(spark, rows):
    """rows: (file, line, side, text, fingerprint)."""
    at = lambda f, n: (datetime(2026, 2, 1) + timedelta(days=f, minutes=n)).isoformat()
    return spark.createDataFrame([(f, n, s, t, at(f, n), "m", fp, f"k{f % 2}", "r", "p", str(f)) for f, n, s, t, fp in rows], MESSAGES)


MINI = [
    (1, 1, "user", "actually that isnt it, look at the parser output", "u1"), (1, 2, "assistant", "You're right. I'll fix the parser.", "a1"),
    (1, 3, "user", "this is fucking stupid", "u2"), (1, 4, "assistant", "Let me look.", "a2"), (1, 5, "assistant", "I was wrong about it, my mistake", "a3"),
    (2, 1, "user", "actually that isnt it, look at the parser output", "u1"), (2, 2, "assistant", "You're right. I'll fix the parser.", "a1"),
    (3, 1, "assistant", "Good catch", "a4"), (3, 2, "user", "run the tests", None), (3, 3, "user", "run the parser tests", None),
]


def test_match_rows_of_a_small_corpus(spark):
    got = matches.match_rows(corpus(spark, MINI)).orderBy("file_id", "line_no", "hit_no").collect()
    told = [(r.file_id, r.line_no, r.side, r.construct, r.phrase, r.turn_bucket, r.depth_in_turn, r.counterpart_text[:8]) for r in got]
    assert told == [
        (1, 2, "assistant", "concession", "you're right", "correction", 1, "actually"), (1, 3, "user", "frustration", "fucking", "hot", 0, "Let me l"),
        (1, 3, "user", "frustration", "stupid", "hot", 0, "Let me l"), (1, 5, "assistant", "concession", "i was wrong", "hot", 2, "this is "),
        (1, 5, "assistant", "concession", "my mistake", "hot", 2, "this is "), (3, 1, "assistant", "concession", "good catch", None, 1, ""),
    ]
    assert set(matches.COLUMNS) <= set(got[0].asDict()) and len(matches.COLUMNS) == 26


def test_pushback_counts_repeats_and_turns(spark):
    t = turns.with_turns(corpus(spark, MINI)).withColumn("conceded", F.col("fingerprint").isin("a1", "a3"))
    users = turns.classified(t.filter("side = 'user'"), by_sentence=False).select("file_id", "turn_id", F.col("bucket").alias("user_bucket"))
    t = t.join(users, ["file_id", "turn_id"], "left")
    assert {r.bucket: (r.k, r.n) for r in rates.pushback_per_message(t).collect()} == {"correction": (2, 2), "hot": (1, 2)}
    assert {r.bucket: (r.k, r.n) for r in rates.pushback_per_turn(t).collect()} == {"correction": (2, 2), "hot": (1, 1), "neutral": (0, 2)}


def test_running_counts_across_segments(spark, monkeypatch):
    monkeypatch.setattr(turns, "SEGMENT", 7)
    r = random.Random(0)
    rows = [(f, n, r.choice(["user", "assistant"]), "x", None) for f in range(4) for n in r.sample(range(100), 60)]
    got = {(x.file_id, x.line_no): (x.turn_id, x.depth) for x in turns.with_turns(corpus(spark, rows)).collect()}
    replies = {(x.file_id, x.turn_id): x.reply for x in turns.next_reply(turns.with_turns(corpus(spark, [(f, n, s, f"{f}:{n}", None) for f, n, s, _, _ in rows]))).collect()}
    for f in range(4):
        turn = depth = 0
        mine = sorted((n, s) for g, n, s, _, _ in rows if g == f)
        for i, (n, s) in enumerate(mine):
            turn, depth = (turn + 1, 0) if s == "user" else (turn, depth + 1)
            assert got[f, n] == (turn, depth)
            if s == "user":
                assert replies[f, turn] == next((f"{f}:{m}" for m, x in mine[i:] if x == "assistant"), None)


def test_first_occurrence_keeps_rows_without_key(spark):
    df = spark.createDataFrame([("a", 2, 1), ("a", 1, 5), (None, 1, 1), (None, 1, 2), ("b", 1, 1)], "fingerprint string, file_id long, line_no long")
    assert sorted((r.fingerprint or "", r.file_id, r.line_no) for r in turns.first_occurrence(df).collect()) == [("", 1, 1), ("", 1, 2), ("a", 1, 5), ("b", 1, 1)]
    assert turns.first_occurrence(df.limit(0)).count() == 0


def brute_label(promise, users, variant="full"):
    """The four labels by plain loops."""
    from re import I, search

    from parlance.functions import dictionary as D
    from parlance.functions import text as T

    drop = set(T.STOP_WORDS + T.FURTHER_STOP_WORDS + T.TONE_WORDS)
    words = lambda t: {w for w in __import__("re").findall("[a-z]{4,}", t.lower()) if w not in drop}
    if not search(D.COMMIT, promise["text"], I):
        return "ineligible"
    line = sorted((u for u in users if u["project"] == promise["project"]), key=lambda u: (u["ts"], u["line_no"]))
    df = {}
    for u in line:
        for w in words(u["text"]):
            df[w] = df.get(w, 0) + 1
    n = max(len(line), 1)
    ambient = {w for w, c in df.items() if c / n > 0.3}
    rare = {w for w, c in df.items() if c <= max(2, int(0.005 * n))}
    ts = datetime.fromisoformat
    ahead = [u for u in line if u["ts"] > promise["ts"] and (ts(u["ts"]) - ts(promise["ts"])).days <= 14 and not search(D.QUOTEBACK, u["text"].lower())]
    trigger = words(promise["trigger"]) - ambient
    if len(ahead) < 20 or len(trigger) < 4:
        return "unobserved"
    for u in ahead:
        shared = trigger & words(u["text"])
        few = shared & rare
        norm = u["text"].lower()
        if search(D.RERAISE, norm) and len(shared) >= 2 or variant != "explicit" and len(few) >= 2 and search(D.COMPLAINT, norm) or variant == "full" and len(few) >= 3:
            return "not_honored"
    return "honored"


def test_follow_through_equals_brute_force(spark):
    r = random.Random(4)
    vocabulary = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)] + ["still", "broken", "again,", "i told you", "we just compacted"]
    text = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    at = lambda: (datetime(2026, 1, 1) + timedelta(minutes=r.randrange(60 * 24 * 40))).isoformat()
    users = [{"project": r.choice("ab"), "session": "s", "file_id": "f", "line_no": i, "ts": at(), "text": text(r.randint(1, 14))} for i in range(160)]
    promises = [{"promise_id": i, "project": r.choice("ab"), "session": "s", "ts": at(), "text": r.choice(["I'll do it", "let me know", "Reverting."]), "trigger": text(r.randint(2, 12))} for i in range(60)]
    u = spark.createDataFrame(users, "project string, session string, file_id string, line_no long, ts string, text string")
    p = spark.createDataFrame(promises, "promise_id long, project string, session string, ts string, text string, trigger string")
    for variant in ("explicit", "full"):
        got = {x.promise_id: x.label for x in followthrough.follow_through(p, u, variant).collect()}
        want = {x["promise_id"]: brute_label(x, users, variant) for x in promises}
        assert got == want
    assert len(set(want.values())) == 4
    assert followthrough.downstream_view(p, u).groupBy("promise_id").count().agg(F.max("count")).first()[0] <= 6


def test_whole_forward_window(spark, tmp_path):
    """The queries have all turns of 14 whole days, up to 5,000 of them."""
    from parlance.plans.queries import QUERIES

    r = random.Random(6)
    start = datetime(2026, 1, 1)
    kinds = ["purchase"] * 2 + ["view"] * 7
    events = [(i, r.choice([1, 1, 1, 2]), start + timedelta(seconds=r.randrange(60 * 86_400)), "error" if i % 150 == 0 else r.choice(kinds)) for i in range(1200)]
    events += [(2000, 9, start, "purchase"), (2001, 9, start, "error"), (2002, 9, start + timedelta(days=15, seconds=-1), "error"), (2003, 9, start + timedelta(days=15), "error")]
    events += [(3000 + i, 7, start + timedelta(minutes=i), "view") for i in range(9000)] + [(2999, 7, start - timedelta(minutes=1), "purchase"), (2998, 7, start + timedelta(minutes=4500), "purchase"), (20_000, 7, start + timedelta(minutes=9001), "error")]
    spark.createDataFrame(events, "event_id long, user_id long, ts timestamp, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    pairs = set()
    for p in (e for e in events if e[3] == "purchase"):
        later = sorted((e for e in events if e[1] == p[1] and e[3] != "purchase" and e[2] > p[2] and (e[2] - p[2]).days <= 14), key=lambda e: (e[2], e[0]))[:5000]
        pairs |= {(p[0], e[0], k) for k, e in enumerate(later, 1)}
    errors = {e[0] for e in events if e[3] == "error"}
    first = {}
    for p, e, k in sorted(pairs, key=lambda x: -x[2]):
        if e in errors:
            first[p] = k
    assert max(first.values()) > 4096 and 2999 not in first and first[2000] == 1
    assert sorted(map(tuple, QUERIES["first_reraise"](spark, str(tmp_path)).collect())) == sorted(first.items())
    assert sorted(map(tuple, QUERIES["forward_window_join"](spark, str(tmp_path)).collect())) == sorted(pairs)
    assert sorted((x.promise_id, x.pos) for x in QUERIES["downstream_k"](spark, str(tmp_path)).collect()) == sorted((p, k) for p, _, k in pairs if k <= 6)


def test_statistics_goldens(spark):
    df = spark.createDataFrame([(948, 27208), (0, 0)], "k long, n long")
    low, high = stats.wilson(F.col("k"), F.col("n"))
    got = df.select(low.alias("l"), high.alias("h")).collect()
    assert math.isclose(got[0].l, 3.272849853170752) and math.isclose(got[0].h, 3.7088224199766846) and tuple(got[1]) == (0, 0)
    t = spark.createDataFrame([("1hot", 102, 226), ("2correction", 73, 254), ("3neutral", 615, 4531)], "name string, k long, n long")
    pair = next(r for r in stats_plans.pairs(t, "name").collect() if r.second == "2correction")
    assert [round(x, 2) for x in (pair.phi, pair.odds_ratio, pair.low, pair.high, pair.risk_ratio, pair.h)] == [0.17, 2.04, 1.4, 2.97, 1.57, 0.34]
    assert f"{stats.survival(pair.chi2, 1):.1e}" == "2.0e-04"
    whole = stats_plans.omnibus(t).first()
    assert round(whole.chi2, 1) == 195.4 and whole.total == 5011 and round(whole.v, 3) == 0.197
    scored = t.withColumn("x", -F.substring("name", 1, 1).cast("int"))
    assert round(stats_plans.trend(scored, "x").first().z, 1) == 14.0
    rho, p = stats.spearman([4.35, 2.79, 3.11, 4.82])
    assert (round(rho, 2), round(p, 2)) == (0.4, 0.75)  # the documents say 0.60; all orders give 0.75
    assert stats.spearman([1, 1, 2]) == (0.75, 1 / 3) and stats.spearman(list(range(9))) == (1.0, 0.0)
    assert stats.spearman([1, 2]) is None and math.isclose(stats.survival(0, 3), 1)


ENTRY = {"type": "assistant", "uuid": "u-1", "timestamp": "2026-02-15T18:23:20.670Z", "message": {"model": "m", "content": [{"type": "text", "text": "You’re  right"}, {"type": "tool_use", "name": "x"}, {"type": "text", "text": "ok"}]}}
LINES = [
    json.dumps(ENTRY), "", "not json", "[1]", "3", json.dumps({"type": "summary"}), json.dumps({"type": "user", "message": {"content": "fix the build <task-notification>x</task-notification> now"}}),
    json.dumps({"type": "user", "message": {"content": "<system-reminder>be nice</system-reminder>"}, "isMeta": True}), json.dumps({"type": "user", "message": {"content": None}}), json.dumps({"type": "user", "message": "text"}),
]


def test_transcripts(spark, tmp_path):
    folder = tmp_path / "box" / "root" / "proj"
    (folder / "subagents").mkdir(parents=True)
    (folder / "one.jsonl").write_text("\n".join(LINES))
    (folder / "._one.jsonl").write_text("x")
    (folder / "subagents" / "two.jsonl").write_text(json.dumps(ENTRY))
    (tmp_path / "box" / "top.jsonl").write_text("\n")  # Spark skips files of no bytes
    files = transcripts.read_files(spark, str(tmp_path))
    got = {r.relpath: (r.machine_id, r.root_slug, r.project, r.session, r.is_subagent) for r in files.collect()}
    assert got == {"box/root/proj/one.jsonl": ("box", "root", "proj", "one", False), "box/root/proj/subagents/two.jsonl": ("box", "root", "proj", "two", True), "box/top.jsonl": ("box", "", "", "top", False)}
    read = transcripts.read_messages(spark, str(tmp_path), files)
    m = {(r.file_id.rpartition("/")[2], r.line_no): r for r in read.collect()}
    assert {k: r.text for k, r in m.items()} == {("one.jsonl", 1): "You’re right ok", ("one.jsonl", 7): "fix the build now", ("one.jsonl", 8): None, ("one.jsonl", 9): None, ("one.jsonl", 10): None, ("two.jsonl", 1): "You’re right ok"}
    assert m["one.jsonl", 8].is_meta and not m["one.jsonl", 8].has_text and m["one.jsonl", 1].model == "m" and len(m["one.jsonl", 1].fingerprint) == 16
    kept = turns.population(read, files, "other")
    assert turns.first_occurrence(kept).count() == 2  # one of the copies, and the user message without an id


def test_inventory_and_labels(spark, tmp_path):
    (tmp_path / "inv.txt").write_text("m|r|a|10\nbad\nm|r|b|x\nn|r|c|5")
    inv = transcripts.read_inventory(spark, str(tmp_path / "inv.txt"))
    assert sorted(r.relpath for r in inv.collect()) == ["a", "c"]
    (tmp_path / "labels.json").write_text(json.dumps({"instructions": "x", "records": [{"n": 1, "msg_fingerprint": "f", "detector": "honored", "did_it": None}]}))
    assert transcripts.read_labels(spark, str(tmp_path / "labels.json")).first().detector == "honored"
    held = spark.createDataFrame([("m", "a", 9), ("z", "q", 1), ("n", "w", 1)], "machine_id string, relpath string, bytes long")
    keys = ["machine_id", "relpath"]
    assert [(r.relpath, r.state) for r in checks.to_fetch(inv.select(*keys, "bytes"), held, keys).orderBy("relpath").collect()] == [("a", "grown"), ("c", "new")]
    assert [r.relpath for r in checks.archive_only(inv, held, keys, inv.select("machine_id")).collect()] == ["w"]
    assert checks.short_of(inv, held, keys).count() == 2


def test_guard_and_bundles(spark):
    lex = Lexicon()
    clean = {"side": "user", "category": "profanity", "phrase": "fucking", "n": 89}
    assert bundles.offenders(spark, clean, lex).count() == 0
    planted = [{"phrase": "this is a sentence of some thirteen words that nobody should ever see published"}, {"phrase": "-Users-alice-GitHub-SomeRepo"}, {"phrase": "a\nb"}]
    assert sum(bundles.offenders(spark, x, lex).count() for x in planted) == 3
    good = {"participant": "ann-1", "exported": "2026-08-01", "analysis": {}, "denominators": {}, "tally": [clean]}
    files = [("good", json.dumps(good)), ("prose", json.dumps(good | {"tally": planted[:1]})), ("bad", "{"), ("few", "{}"), ("when", json.dumps(good | {"exported": "2026-08-01T10:11"}))]
    got = bundles.intake(spark, spark.createDataFrame(files, "name string, value string"), lex).collect()
    assert {r.name for r in got} == {"prose", "bad", "few", "when"} and any("TEXT GUARD" in r.error for r in got if r.name == "prose")


@pytest.mark.parametrize(("raw", "want"), [("WHY NOT, the API", ["WHY"]), ("LOOK HERE NOW", ["LOOK", "HERE", "NOW"]), ("the JSON API is OK", []), ("", [])])
def test_shouting(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "raw string").select(audits.shouting(F.col("raw")).alias("x")).first().x == want


def test_audits(spark):
    m = corpus(spark, MINI).withColumn("norm", F.lower("text"))
    assert audits.near_misses(spark.createDataFrame([("I screwed the build. fine.",), (None,)], "text string")).first().sentence == "i screwed the build"
    found = audits.sweep(m, {"catch": r"\b(?:good|parser) \w+"}).collect()
    assert {(r.candidate, r.n) for r in found} >= {("parser output", 2)} and all(r.candidate != "good catch" for r in found)
    hits = m.filter("side = 'assistant'").select("*", F.explode(Lexicon().phrase_hits("norm")).alias("h")).select("*", "h.phrase", "h.start")
    assert audits.precision_audit(hits, "norm", 2).filter("phrase = 'good catch'").first().context == "good catch"
    counters = {(r.dimension, r["value"]): (r.messages, r.hits) for r in audits.scan_counters(m, hits, ("model", "machine_id")).collect()}
    assert counters["model", "m"] == (10, hits.count()) and {k for k, _ in counters} == {"model", "machine_id"}
    assert audits.examples(m, "side", "text", 2).groupBy("side").count().agg(F.max("count")).first()[0] == 2
    assert audits.user_control(corpus(spark, [(1, 1, "user", "my bad, fair point", "z")])).count() == 2


def test_streams_equal_batch(spark, tmp_path):
    from parlance.streaming import conversations as streaming

    folder = tmp_path / "in" / "box" / "root" / "proj"
    folder.mkdir(parents=True)
    (folder / "one.jsonl").write_text("\n".join(LINES))
    stream = streaming.stream_messages(spark, str(tmp_path / "in"))
    got = streaming.drained(streaming.first_seen(stream.filter("has_text")), str(tmp_path / "out"))
    want = transcripts.read_messages(spark, str(tmp_path / "in")).filter("has_text")
    assert sorted((r.line_no, r.text) for r in got.collect()) == sorted((r.line_no, r.text) for r in want.collect())
    (folder / "two.jsonl").write_text(json.dumps(ENTRY))
    again = streaming.drained(streaming.first_seen(streaming.stream_messages(spark, str(tmp_path / "in")).filter("has_text")), str(tmp_path / "out"))
    assert again.count() == got.count()  # the copy of a message seen before stays out


def test_turn_state_keeps_string_ids(spark, tmp_path):
    from parlance.streaming import conversations as streaming

    rows = [("box/a.jsonl", 1, "user"), ("box/a.jsonl", 2, "assistant"), ("box/b.jsonl", 1, "assistant"), ("box/a.jsonl", 3, "assistant")]
    spark.createDataFrame(rows, "file_id string, line_no long, side string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("file_id string, line_no long, side string").parquet(f"{tmp_path}/in")
    got = streaming.drained(streaming.turn_numbers(stream), str(tmp_path / "out"))
    assert sorted((r.file_id, r.line_no, r.turn_id, r.depth) for r in got.collect()) == [("box/a.jsonl", 1, 1, 0), ("box/a.jsonl", 2, 1, 1), ("box/a.jsonl", 3, 1, 2), ("box/b.jsonl", 1, 0, 1)]


def test_later_turns_as_streams(spark, tmp_path):
    from parlance.streaming import conversations as streaming

    day = datetime(2026, 1, 1)
    promises = [(1, "p", day), (2, "q", day + timedelta(days=3))]
    users = [("p", day, 0), ("p", day + timedelta(hours=1), 1), ("p", day + timedelta(days=15, seconds=-1), 2), ("p", day + timedelta(days=15), 3), ("q", day, 4), ("q", day + timedelta(days=4), 5)]
    spark.createDataFrame(promises, "promise_id long, project string, at timestamp").write.parquet(f"{tmp_path}/p")
    spark.createDataFrame(users, "project string, at timestamp, n int").write.parquet(f"{tmp_path}/u")
    streams = [spark.readStream.schema(spark.read.parquet(f"{tmp_path}/{x}").schema).parquet(f"{tmp_path}/{x}") for x in "pu"]
    got = streaming.drained(streaming.later_turns(*streams), str(tmp_path / "out"))
    assert sorted((r.promise_id, r.n) for r in got.collect()) == [(1, 1), (1, 2), (2, 5)]


def test_population_without_project(spark):
    flags = "is_sidechain boolean, is_compact boolean, is_meta boolean, is_visible_only boolean"
    m = spark.createDataFrame([(f, True, False, False, None, False) for f in "abc"] + [("a", True, False, False, True, False)], f"file_id string, has_text boolean, {flags}")
    files = spark.createDataFrame([("a", "m", "r", "", "s"), ("b", "m", "r", "own", "s"), ("c", "m", "r", None, "s")], "file_id string, machine_id string, root_slug string, project string, session string")
    told = lambda *away: sorted(r.file_id for r in turns.population(m, files, *away).collect())
    assert told() == ["a", "b", "c"] and told("own") == ["a", "c"] and told(["own", ""]) == ["c"]


def test_sweep_drops_spans_alone(spark):
    m = spark.createDataFrame([("good catch and a fair point about good tests",), ("good tests",), ("good tests",), ("a good tests run",)], "text string")
    got = {r.candidate: (r.n, r.samples) for r in audits.sweep(m, {"praise": r"\bgood \w+"}).collect()}
    assert got == {"good tests": (4, ["a good tests run", "good catch and a fair point about good tests"])}


def test_documents_of_tables(spark, tmp_path):
    from parlance.sources import sinks

    df = spark.createDataFrame([(1, "</script>")], "n int, s string")
    assert sinks.markdown_table(df) == "| n | s |\n| --- | --- |\n| 1 | </script> |"
    assert sinks.script_document("d", {"t": df}) == 'window.d = {\n "t": [\n  {\n   "n": 1,\n   "s": "<\\/script>"\n  }\n ]\n};'
    for day in ("2026-01-01", "2026-01-02", "2026-01-02"):
        sinks.write_partitioned(df, str(tmp_path), "box", day)
    assert spark.read.parquet(str(tmp_path)).count() == 2


def test_ranks_by_ranges_equal_a_sort(spark):
    from parlance.operators import samples

    r = random.Random(3)
    rows = [(r.choice("aaaab"), r.randrange(10**6), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, o long, i long")
    for by in (["g"], []):
        got = {x.i for x in samples.every_nth(df, by, ["o", "i"], F.lit(9)).collect()}
        want = set()
        for g in "ab" if by else [None]:
            mine = [i for h, o, i in sorted(rows, key=lambda x: x[1:]) if g in (None, h)]
            want |= set(mine[:: max(1, len(mine) // 9)][:9])
        assert got == want
