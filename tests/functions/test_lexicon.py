"""Matching against known answers and an independent fold in plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from parlance.functions import dictionary as D
from parlance.functions.lexicon import Lexicon, shouts
from parlance.functions.text import normalize, normalize_text, strip_code

ASSISTANT = [
    ("You're right — I broke the build.", True), ("Good question — let me be precise.", True), ("that page chrome looks exactly right", False),
    ("I introduced neither; both are pre-existing.", False), ("a real bug I introduced — line 456 passes didx", True),
    ("my error handling caught it cleanly, no crash", False), ("the migration requirement is mine to execute", False),
    ("that's a different repo, and I haven't checked it", False), ("Good news: the backend is already multi-site.", False),
    ("whenever you're ready — say the word", False), ("given that, i will", False), ('given that, "x"', True),
    ("Right - he's talking", True), ("from the top right - the badge", False), ("That is a valid objection.", True), ("", False),
]
USER = [
    ("you're being fucking lazy and not troubleshooting", True), ('no `loading="lazy"` on the card images', False),
    ("the unsynchronized lazy engine/session-factory", False), ("finishReason STOP — so drive() had nothing", False),
    ("NO. NOTHING WORKS. What don't you understand???", True), ("tools.ts has NO emit path today", False), ("hell yes", False),
    ("nothing in the workflow to stop it", False), ("a class, ass", True), ("a classy one, ass", False), ("", False),
]


def test_known_answers(spark):
    lex = Lexicon()
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(ASSISTANT)], "i int, text string").withColumn("norm", normalize(F.col("text")))
    rows = df.select("i", F.size(lex.assistant_hits()).alias("n"), lex.gate().alias("g")).orderBy("i").collect()
    assert [r.n > 0 for r in rows] == [want for _, want in ASSISTANT]
    assert all(r.g for r in rows if r.n)
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(USER)], "i int, text string").withColumn("norm", normalize(F.col("text"))).withColumn("body", strip_code(F.col("text")))
    rows = df.select("i", (F.size(lex.heat_hits()) + F.size(shouts("body"))).alias("n"), F.size(lex.heat_by_sentence()["hits"]).alias("s")).orderBy("i").collect()
    assert [r.n > 0 for r in rows] == [want for _, want in USER]


def fold(text):
    """Longest first, each only over free text."""
    phrases = sorted(((p, c) for c, ps in D.ASSISTANT.items() for p in ps), key=lambda x: -len(x[0]))
    claimed, out = [], []
    for p, _ in phrases:
        n = normalize_text(p)
        for m in re.finditer(r"(?<![a-z0-9])" + r"\s+".join(map(re.escape, n.split(" "))) + r"(?![a-z0-9'])", text):
            if all(m.end() <= a or b <= m.start() for a, b in claimed):
                claimed.append(m.span())
                out.append((p, m.start()))
    return out


def test_claims_equal_brute_force(spark):
    r = random.Random(1)
    words = [w for ps in D.ASSISTANT.values() for p in ps for w in p.split()] + ["é", "x1", ".", ",", "—", "’"]
    phrases = [p for ps in D.ASSISTANT.values() for p in ps]
    texts = [" ".join(r.choice(phrases) if r.random() < 0.4 else r.choice(words) for _ in range(r.randint(1, 25))) for _ in range(150)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").withColumn("norm", normalize(F.col("text")))
    for row in df.select("i", "norm", Lexicon().phrase_hits().alias("h")).collect():
        assert [(h.phrase, h.start) for h in row.h] == fold(row.norm), row.norm


@pytest.mark.parametrize(("raw", "want"), [("STOP. now", ["STOP"]), ("Please JUST STOP it", ["JUST STOP"]), ("`NO`.", []), ("exit code 1 DO NOT", []), (" *WHY*! ok", ["WHY"])])
def test_shouts(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "raw string").withColumn("body", strip_code(F.col("raw")))
    assert [h.phrase for h in df.select(shouts("body").alias("h")).first().h] == want


def test_dictionary_file(spark, tmp_path):
    path = tmp_path / "d.json"
    path.write_text('{"assistant": {"a": ["oh dear", "oh"], "_note": "x"}, "_constructs": {"c": ["a"]}}')
    lex = Lexicon.load(spark, str(path))
    df = spark.createDataFrame([("oh dear oh",)], "norm string").select(lex.assistant_hits().alias("h"), lex.construct(F.lit("a")).alias("c"))
    row = df.first()
    assert [(h.phrase, h.start) for h in row.h] == [("oh dear", 0), ("oh", 8)] and row.c == "c"


def random_texts(n, seed):
    """Texts of dictionary words, whole phrases, punctuation and odd characters."""
    import random

    r = random.Random(seed)
    phrases = [p for ps in D.ASSISTANT.values() for p in ps] + [w for ws in D.OPENERS.values() for w in ws] + [w for ws in D.GUARDS.values() for w in ws]
    words = [w for p in phrases for w in p.split()] + ["parser", "é", "x1", "my", "error", "clean", "crash"]
    marks = ["", "", "", ",", ". ", "! ", "-", "'s", "’", " ", "\n", " - "]
    return ["".join(r.choice((r.choice(phrases), r.choice(words))) + r.choice(marks) + r.choice([" ", " ", ""]) for _ in range(r.randint(0, 25))) for _ in range(n)]


def test_expressions_and_table_function_agree(spark):
    """Two implementations, on random texts; and the table function from SQL, beside its message."""
    from parlance.functions import table_function
    from parlance.functions.text import normalize, normalize_text

    texts = random_texts(1500, 9)
    matcher = table_function.Matcher(Lexicon())
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None), (-2, "")], "id int, text string").repartition(4)
    native = df.withColumn("norm", normalize(F.coalesce("text", F.lit("")))).select("id", F.explode(Lexicon().assistant_hits("norm")).alias("h")).select("id", "h.*")
    want = sorted((i, *h) for i, t in enumerate(texts) for h in matcher.hits(normalize_text(t)))
    assert sorted((r.id, r.phrase, r.category, r.start) for r in native.collect()) == want
    assert len(want) > 2000 and len({p for _, p, _, _ in want}) > 80
    table_function.register(spark)
    df.createOrReplaceTempView("said")
    told = spark.sql("select s.id, h.phrase, h.category, h.char_offset from said s, lateral match_rows(s.text) h")
    assert sorted(tuple(r) for r in told.collect()) == want
    assert spark.sql("select construct, snippet from match_rows('You''re right. I''ll fix it')").collect()[0][0] == "concession"


def test_pushback_openers(spark):
    said = {"no, thats wrong": True, "  “no” it isnt": True, "...no": True, "....no": False, "nobody": False, "no's": False, "yes": False, "": False}
    got = {r.norm: r.hit for r in spark.createDataFrame([(x,) for x in said], "norm string").select("norm", Lexicon(pushback_openers=["no", "wait what"]).pushes_back("norm").alias("hit")).collect()}
    assert got == said
