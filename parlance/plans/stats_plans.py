"""Tests over k x 2 tables as single aggregations: chi-squared with Cramer's V, and the trend over ordered groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions.stats import chi2_2x2, cohens_h, odds_ratio, phi, risk_ratio, tail
from parlance.sources.scratch import hinted


def omnibus(table: DataFrame, k: str = "k", n: str = "n") -> DataFrame:
    """One row: chi2, df, total and Cramer's V of groups with k hits in n."""
    t = table.select(F.col(k).cast("double").alias("k"), F.col(n).cast("double").alias("n"))
    # chi2 of a k x 2 table is N (sum k^2 / n - K^2 / N) / (p q N) with p = K / N
    s = t.agg(F.sum("k").alias("K"), F.sum("n").alias("N"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("S"), F.count("*").alias("g"))
    p = F.col("K") / F.col("N")
    chi2 = (F.col("S") - F.col("K") * p) / (p * (1 - p))
    return s.select(F.round(chi2, 6).alias("chi2"), (F.col("g") - 1).alias("df"), F.col("N").cast("long").alias("total"), F.round(F.sqrt(chi2 / F.col("N")), 6).alias("v"))


def trend(table: DataFrame, score: str, k: str = "k", n: str = "n") -> DataFrame:
    """One row: z of Cochran and Armitage's test for a trend of k / n over the scores."""
    t = table.select(F.col(score).cast("double").alias("x"), F.col(k).cast("double").alias("k"), F.col(n).cast("double").alias("n"))
    s = t.agg(*[F.sum(c).alias(a) for a, c in {"K": F.col("k"), "N": F.col("n"), "kx": F.col("k") * F.col("x"), "nx": F.col("n") * F.col("x"), "nxx": F.col("n") * F.col("x") * F.col("x")}.items()])
    p = F.col("K") / F.col("N")
    spread = p * (1 - p) * (F.col("nxx") - F.col("nx") * F.col("nx") / F.col("N"))
    return s.select(F.round((F.col("kx") - p * F.col("nx")) / F.sqrt(spread), 6).alias("z"))


def pairs(table: DataFrame, name: str, k: str = "k", n: str = "n") -> DataFrame:
    """Every pair of groups (a few rows) with phi, odds ratio and interval, risk ratio, Cohen's h and chi2."""
    a = table.select(F.col(name).alias("first"), F.col(k).alias("a"), (F.col(n) - F.col(k)).alias("b"))
    c = table.select(F.col(name).alias("second"), F.col(k).alias("c"), (F.col(n) - F.col(k)).alias("d"))
    cells = [F.col(x) for x in "abcd"]
    ratio, low, high = odds_ratio(*cells)
    told = {"phi": phi(*cells), "odds_ratio": ratio, "low": low, "high": high, "risk_ratio": risk_ratio(*cells), "h": cohens_h(*cells), "chi2": chi2_2x2(*cells)}
    return a.join(hinted(c), F.col("first") < F.col("second")).select("first", "second", *[F.round(v, 6).alias(x) for x, v in told.items()])


def with_p(tests: DataFrame, chi2: str = "chi2", df: str | int = 1, name: str = "p") -> DataFrame:
    """``tests`` with the p of a chi-squared statistic, ``df`` being a column or a number."""
    return tests.withColumn(name, tail(F.col(chi2), F.col(df) if isinstance(df, str) else F.lit(df)))


def trend_with_p(told: DataFrame) -> DataFrame:
    """A trend with the two-sided p of its z."""
    return told.withColumn("p", tail(F.col("z") * F.col("z"), F.lit(1)))
