"""Tables compared by digests, tails of chi-squared, ranks, and the published statistics with their p."""

import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from parlance.functions import stats
from parlance.operators import checks
from parlance.plans import stats_plans

ROWS = "n long, t string, x double, xs array<string>"


def test_tables_compared_by_buckets(spark):
    r = random.Random(8)
    row = lambda: (r.choice([None, *range(40)]), r.choice([None, "a", "b", ""]), r.choice([None, 0.5, 1.5]), r.choice([None, [], ["a"], ["a", "b"]]))
    one = [row() for _ in range(3000)]
    two = one[5:] + [(1000 + i, "new", 0.0, None) for i in range(4)] + one[7:9]
    a, b = spark.createDataFrame(one, ROWS).repartition(3), spark.createDataFrame(r.sample(two, len(two)), ROWS).repartition(5)
    key = lambda x: (x.n, x.t, x.x, tuple(x.xs) if x.xs is not None else None)
    plain = lambda rows: Counter((n, t, x, tuple(xs) if xs is not None else None) for n, t, x, xs in rows)
    got = checks.differing(a, b, 64).collect()
    assert Counter(key(x) for x in got if x.only_in == "first") == plain(one) - plain(two)
    assert Counter(key(x) for x in got if x.only_in == "second") == plain(two) - plain(one)
    assert checks.differing(a, a.repartition(7)).collect() == []
    assert 0 < checks.differing_buckets(a, b).count() <= 16  # of 4096; the rest is never compared row by row
    swapped = spark.createDataFrame([(None, "a", None, None)], ROWS), spark.createDataFrame([(None, None, None, ["a"])], ROWS)
    assert checks.differing(*swapped).count() == 2 and checks.differing(a.limit(0), b.limit(0)).count() == 0


def even_tail(x, df):
    return math.exp(-x / 2) * sum((x / 2) ** j / math.factorial(j) for j in range(df // 2))


def odd_tail(x, df):
    out, term = math.erfc(math.sqrt(x / 2)), math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    for j in range(3, df + 1, 2):
        out, term = out + term, term * x / j
    return out


def test_tails_of_any_degrees(spark):
    cases = [(x, df) for x in (1e-6, 0.01, 0.5, 1.0, 3.84, 10.0, 40.0, 250.0, 700.0) for df in (1, 2, 3, 4, 5, 8, 11, 30, 101)]
    got = spark.createDataFrame(cases, "x double, df int").withColumn("p", stats.tail(F.col("x"), F.col("df"))).collect()
    for r in got:
        want = (odd_tail if r.df % 2 else even_tail)(r.x, r.df)
        assert r.p == pytest.approx(want, rel=1e-9 if want < 0.5 else 1e-12, abs=1e-300), r
    assert spark.range(1).select(stats.tail(F.lit(0.0), F.lit(3)).alias("p")).first().p == 1.0
    for df in (1, 2, 3):
        assert stats.survival(7.5, df) == pytest.approx((odd_tail if df % 2 else even_tail)(7.5, df), rel=1e-12)


def test_published_contrasts_with_p(spark):
    """Counts and p as published: hot, correction and neutral turns."""
    table = spark.createDataFrame([("hot", 102, 226, 2), ("correction", 73, 254, 1), ("neutral", 615, 4531, 0)], "bucket string, k long, n long, s int")
    p = {(r["first"], r["second"]): r["p"] for r in stats_plans.with_p(stats_plans.pairs(table, "bucket")).collect()}
    assert f"{p['correction', 'hot']:.1e}" == "2.0e-04" and f"{p['hot', 'neutral']:.1e}" == "2.6e-38"
    message = spark.createDataFrame([("hot", 133, 1149), ("correction", 84, 1418), ("neutral", 718, 24047)], "bucket string, k long, n long")
    p = {(r["first"], r["second"]): r["p"] for r in stats_plans.with_p(stats_plans.pairs(message, "bucket")).collect()}
    assert f"{p['correction', 'hot']:.1e}" == "3.1e-07" and f"{p['hot', 'neutral']:.1e}" == "7.4e-56" and f"{p['correction', 'neutral']:.1e}" == "7.5e-10"
    model = stats_plans.with_p(spark.createDataFrame([(81.5, 3)], "chi2 double, df int"), df="df").first()
    assert f"{model.p:.1e}" in ("1.4e-17", "1.5e-17")
    z = stats_plans.trend_with_p(stats_plans.trend(table, "s")).first()
    assert z.p == pytest.approx(math.erfc(abs(z.z) / math.sqrt(2)), rel=1e-9)


def test_ranks_by_definition():
    def brute(values):
        n = len(values)
        rank = [sum(w <= v for w in values) for v in values]
        of = lambda order: 1 - 6 * sum((x - i) ** 2 for i, x in enumerate(order, 1)) / (n**3 - n)
        every = [of(x) for x in itertools.permutations(range(1, n + 1))]
        return of(rank), sum(abs(x) > abs(of(rank)) - 1e-9 for x in every) / len(every)

    r = random.Random(1)
    for _ in range(40):
        values = [r.randint(0, 5) for _ in range(r.randint(3, 6))]
        assert stats.spearman(values) == pytest.approx(brute(values))
    assert sum(stats.orders_by_distance(6).values()) == 720
    assert stats.spearman([1, 2]) is None and stats.spearman(list(range(9))) == (1.0, 0.0)
    assert stats.spearman([1, 3, 2, 4, 5, 7, 6, 8])[1] == pytest.approx(math.erfc(0.9523809523809523 * math.sqrt(6 / (2 * (1 - 0.9523809523809523**2)))))
