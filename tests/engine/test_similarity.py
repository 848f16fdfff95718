"""Similarity to all earlier messages: the same as by all pairs, with few of them compared."""

import random

from pyspark.sql import functions as F

from parlance.operators import turns


def brute(rows):
    out = {}
    for f, line, words in rows:
        best = 0.0
        for g, before, others in rows:
            if g == f and before < line and words and others:
                a, b = set(words), set(others)
                best = max(best, len(a & b) / len(a | b))
        out[f, line] = best
    return out


def pairs_that_share(rows):
    return sum(1 for f, i, a in rows for g, j, b in rows if f == g and j < i and set(a) & set(b))


def test_similarity_equals_all_pairs_with_few_candidates(spark):
    r = random.Random(5)
    common, rare = [f"common{i}" for i in range(12)], [f"rare{i}" for i in range(900)]
    rows = []
    for f in range(3):
        for line in range(0, 360, 3):
            words = [r.choice(common) for _ in range(r.randint(0, 8))] + [r.choice(rare) for _ in range(r.randint(0, 12))]
            if rows and r.random() < 0.3:  # an earlier message again, with changes
                words = [w for w in r.choice([x for x in rows if x[0] == f] or rows)[2] if r.random() < 0.9] + words[:2]
            rows.append((f, line, words))
    users = spark.createDataFrame(rows, "file_id int, line_no long, words array<string>")
    got = {(x.file_id, x.line_no): x.similarity for x in turns.prior_similarity(users).collect()}
    want = brute(rows)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 0.0005 + 1e-9 for k in want)
    assert len({round(v, 3) for v in want.values()}) > 30 and 1.0 in want.values() and 0.0 in want.values()
    told = turns.ordered_words(users)
    first = turns.compared_words(told.select("file_id", "line_no", F.explode("before").alias("before")), told)
    bounds = first.groupBy("file_id", "line_no").agg(F.max("similarity").alias("bound")).filter("bound > 0 and bound < 1")
    looked = first.count() + turns.more_alike(told, bounds).count()
    assert looked < pairs_that_share(rows) / 2.5


def test_similarity_of_little(spark):
    rows = [(1, 1, []), (1, 2, ["a"]), (1, 3, ["a", "a"]), (2, 1, ["a"]), (1, 4, ["b"])]
    users = spark.createDataFrame(rows, "file_id int, line_no long, words array<string>")
    assert sorted((x.file_id, x.line_no, x.similarity) for x in turns.prior_similarity(users).collect()) == [(1, 1, 0.0), (1, 2, 0.0), (1, 3, 1.0), (1, 4, 0.0), (2, 1, 0.0)]
    assert turns.prior_similarity(users.limit(0)).collect() == []


def test_bloom_filters_lose_nothing(spark):
    from parlance.functions import bloom

    keys = spark.range(3000).selectExpr("concat('p', id % 3) as project", "concat('w', id) as word")
    rows = spark.range(60_000).selectExpr("concat('p', id % 3) as project", "concat('w', id) as word", "id")
    for log_bits, most in ((16, 200), (8, 60_000)):  # one with room, one overfull
        got = [r.id for r in bloom.held_rows(rows, keys, "project", "word", log_bits=log_bits).collect()]
        assert set(range(3000)) <= set(got) and len(got) == len(set(got)) and len(got) <= 3000 + most
    assert bloom.held_rows(rows, keys.limit(0), "project", "word", log_bits=10).count() == 0
    assert bloom.bloom(keys, "project", "word", log_bits=12).count() == 1
