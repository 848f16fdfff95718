"""Counters in one pass, broad constructions, published claims, and labels from match rows on."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from parlance.functions.lexicon import Lexicon
from parlance.operators import audits, calibration, constructs, followthrough, matches, verification
from tests.engine.test_engine import MESSAGES, brute_label


def test_scan_counters_with_dimensions_of_hits(spark):
    m = spark.createDataFrame([("f1", "m1", "p", "2026-01-02", "abc"), ("f2", "m1", "q", "2026-02-02", "de"), ("f3", None, "p", None, "")], "fingerprint string, model string, project string, ts string, text string")
    hits = spark.createDataFrame([("f1", "m1", "p", "2026-01-02", "x"), ("f1", "m1", "p", "2026-01-02", "y"), ("f2", "m1", "q", "2026-02-02", "x")], "fingerprint string, model string, project string, ts string, phrase string")
    got = {(r.dimension, r["value"]): tuple(r)[2:] for r in audits.scan_counters(m, hits, ("model", "month", "phrase", "all")).collect()}
    assert got == {("model", "m1"): (2, 5, 3, 2), ("model", None): (1, 0, 0, 0), ("month", "2026-01"): (1, 3, 2, 1), ("month", "2026-02"): (1, 2, 1, 1), ("month", "unknown"): (1, 0, 0, 0), ("phrase", "x"): (None, None, 2, 2), ("phrase", "y"): (None, None, 1, 1), ("all", None): (3, 5, 3, 2)}


def test_heat_counters_tell_capitals_in_one_pass(spark):
    rows = [("user", "profanity", "damn", "2026-01-01T00", "s", True, "f1"), ("user", "insult", "lazy", "2026-02-01T00", "s", False, "f1"), ("assistant", "agreement", "x", "2026-01-01T00", "s", True, "f9")]
    told = spark.createDataFrame(rows, "side string, category string, phrase string, timestamp string, session string, directed_at_claude boolean, msg_fingerprint string")
    users = spark.createDataFrame([("f1", "2026-01-01T00", "STOP IT NOW"), ("f2", "2026-01-05T00", "please STOP"), ("f3", "2026-01-06T00", "the API and the JSON"), ("f4", None, None)], "fingerprint string, ts string, text string")
    got = {(r.dimension, r["value"]): (r.hits, r.messages) for r in constructs.heat_counters(told, users).collect()}
    assert got["session", "s"] == (2, 1) and got["aim", "directed"] == (1, 1) and got["month", "2026-02"] == (1, 1) and got["capitals", "2026-01"][1] == 2
    plan = constructs.heat_counters(told)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1  # one pass for five dimensions


def test_top_phrases_of_each_side(spark):
    tally = spark.createDataFrame([("user", "c", "a", 3), ("user", "d", "a", 1), ("user", "c", "b", 4), ("assistant", "c", "z", 9), ("user", "c", "c", 1)], "side string, category string, phrase string, n long")
    assert sorted((r.side, r.phrase, r.n, r["rank"]) for r in constructs.top_phrases(tally, 2).collect()) == [("assistant", "z", 9, 1), ("user", "a", 4, 1), ("user", "b", 4, 2)]


def test_broad_constructions(spark):
    said = ["Sharp eye on that", "it was smart to ask", "you were right", "I failed tests", "Fair - the build is broken", "exactly so", "otherwise the build", "swift: a file", "Good catch"]
    m = spark.createDataFrame([(x,) for x in said], "text string")
    got = {(r.kind, r.candidate) for r in audits.sweep(m).collect()}
    assert {("praise+noun", "sharp eye"), ("praise+to+verb", "smart to ask"), ("i+fault", "i failed tests"), ("opener", "fair -"), ("exactly+", "exactly so")} <= got
    assert not any("swift" in c or c.startswith("wise") or c == "good catch" for _, c in got)
    hits = spark.createDataFrame([("good catch", 0, 1, k, "good catch here") for k in range(9)] + [("i was wrong", 3, 2, 1, "so i was wrong")], "phrase string, start int, file_id int, line_no int, norm string")
    audit = audits.precision_audit(hits, "norm", 3, phrase="good catch").collect()
    assert len(audit) == 3 and {r.phrase for r in audit} == {"good catch"} and audit[0].context == "good catch here"


def facts(spark, **changes):
    given = {
        "leaderboard": ([("a", 5.5, 5.0, 6.1), ("b", 3.1, 2.5, 3.7), ("c", 3.0, 2.7, 3.3)], "model string, rate double, low double, high double"),
        "per_turn": ([("hot", 112, 241, 40.0, 52.0), ("correction", 75, 261, 23.0, 34.0), ("neutral", 636, 4737, 12.0, 14.0)], "bucket string, k long, n long, low double, high double"),
        "broken": ([(31.6,)], "rate double"), "depth": ([(1, 737), (2, 126), (3, 400)], "depth int, n long"), "machines": ([("m", 60), ("n", 40)], "machine_id string, n long"),
        "monthly": ([("2026-06", 2.8), ("2026-08", 4.8), ("2026-07", 3.1)], "month string, rate double"), "lead_monthly": ([("2026-07", 4.0, 10), ("2026-08", 6.0, 20)], "month string, rate double, n long"),
        "control": ([("b", 2.0), ("a", 4.0)], "model string, rate double"), "famous": ([(2,)], "occurrences long"),
    }
    given |= {k: (v, given[k][1]) for k, v in changes.items()}
    told = verification.published_facts(*[spark.createDataFrame(*v) for v in given.values()])
    return {r.name: r.holds for r in verification.claims(told, verification.PROSE).collect()}


def test_published_claims(spark):
    assert len(verification.PROSE) == 13 and all(facts(spark).values())
    off = lambda **c: {k for k, v in facts(spark, **c).items() if not v}
    assert off(machines=[("m", 50), ("n", 50)]) == {"one busy machine can move any aggregate"}
    assert off(monthly=[("2026-08", 4.8)]) == {"the latest month is up sharply"}
    assert off(control=[("a", 4.0)]) == {"the within-project control still favors the top model"}
    assert off(leaderboard=[("a", 5.5, 5.0, 6.1), ("b", 3.1, 2.9, 3.7), ("c", 2.0, 1.7, 2.3)]) == {"the rest of the field is unresolved (CIs overlap)"}
    assert off(per_turn=[("hot", 0, 0, 0.0, 0.0)]) == {"swearing roughly doubles the fold rate", "hot and correction CIs do not overlap (per turn)"}


def test_labels_from_match_rows_on(spark):
    """Messages to match rows to promises to labels to calibration, each step on what the one before gives; labels by plain loops."""
    r = random.Random(11)
    vocabulary = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(150)] + ["still", "broken", "again,", "i told you"]
    start = datetime(2026, 1, 1)
    rows = []
    for f in range(12):
        for k in range(40):
            at = (start + timedelta(hours=9 * k, minutes=f)).isoformat()
            if k % 2:
                text = r.choice(["You're right. I'll fix it", "I was wrong, reverting.", "You're right, let me know", "Good question. On it", "nothing here", "Understood - I'll do it"])
            else:
                text = " ".join(r.choice(vocabulary) for _ in range(r.randint(3, 14)))
            rows.append((f, k, "assistant" if k % 2 else "user", text, at, "m", f"fp{f % 11}:{k}", "box", "root", f"p{f % 2}", f"s{f}"))
    population = spark.createDataFrame(rows, MESSAGES)
    promises = calibration.promises_of(matches.match_rows(population, Lexicon()))
    users = population.filter("side = 'user'")
    output = followthrough.follow_through(promises, users).withColumnRenamed("promise_id", "msg_fingerprint")
    got = {x.msg_fingerprint: x for x in output.collect()}
    said = [{"project": p, "ts": t, "line_no": k, "text": x} for f, k, side, x, t, _, _, _, _, p, _ in rows if side == "user"]
    want, seen = {}, set()
    for f, k, side, x, t, _, fp, _, _, p, _ in sorted(rows, key=lambda z: (z[0], z[1])):
        fresh = fp not in seen
        seen.add(fp)
        if side == "assistant" and fresh and x.startswith(("You're right", "I was wrong", "Understood")):
            want[fp] = brute_label({"text": x, "project": p, "ts": t, "trigger": rows[f * 40 + k - 1][3]}, said)
    assert {k: v.label for k, v in got.items()} == want and len(set(want.values())) >= 3
    mix = {(x.what, x["value"]): x.n for x in calibration.label_mix(output).collect()}
    assert {v: n for (w, v), n in mix.items() if w == "label"} == Counter(want.values())
    some = sorted(want)[:9]
    labels = spark.createDataFrame([(fp, "yes") for fp in some] + [("gone", "no")], "msg_fingerprint string, did_it string")
    told = {x.msg_fingerprint: (x.truth, x.now) for x in calibration.with_output(labels, output).collect()}
    assert told == {fp: ("honored", want[fp]) for fp in some} | {"gone": ("not_honored", None)}
    assert [x.msg_fingerprint for x in calibration.unmatched(labels, output).collect()] == ["gone"]
