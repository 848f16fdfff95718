"""Inventories, privacy guards and integrity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.sources.scratch import settled

#: Words and characters a string of an aggregate may have.
MOST_WORDS, MOST_CHARS = 5, 48
# Fixed value: what a short label may be made of.
TOKEN = r"^[A-Za-z0-9][A-Za-z0-9 _.,:%+*()'!?-]*$"


def to_fetch(upstream: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """Upstream files that are new or have grown, with a state column."""
    told = upstream.join(held.select(*keys, F.col("bytes").alias("held")), keys, "left")
    return told.filter("held is null or bytes > held").withColumn("state", F.when(F.col("held").isNull(), "new").otherwise("grown"))


def archive_only(upstream: DataFrame, held: DataFrame, keys: list[str], reached: DataFrame) -> DataFrame:
    """Held files gone upstream, of the machines in ``reached`` alone: an unreachable machine's files are not gone."""
    return held.join(reached.select("machine_id").distinct(), "machine_id", "left_semi").join(upstream.select(*keys), keys, "left_anti")


def short_of(expected: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """Expected files that are missing or smaller than they should be."""
    return expected.join(held.select(*keys, F.col("bytes").alias("got")), keys, "left").filter(F.coalesce("got", F.lit(-1)) < F.col("bytes"))


def not_configured(found: DataFrame, configured: DataFrame, keys: tuple[str, ...] = ("machine_id", "root")) -> DataFrame:
    """Roots that were found but that no configuration names."""
    return found.select(*keys).distinct().join(configured.select(*keys), [*keys], "left_anti")


def leaks(text: Column) -> Column:
    """Whether injected markup survived in a text."""
    return text.contains("<task-notification>") | text.contains("<system-reminder>")


def refused(value: Column, allowed: Column) -> Column:
    """Why a string may not be published, or null. Hex digests and ``allowed`` ones pass; anything else must be a short label."""
    words = F.size(F.filter(F.split(value, " "), lambda w: w != ""))
    return (
        F.when(value.isNull() | value.rlike("^[0-9a-f]{8,64}$"), None)
        .when(value.contains("\n"), "line break")
        .when(value.rlike("[/\\\\@<>]") | value.rlike("^-[A-Za-z]"), "path, address or tag")
        .when(allowed, None)
        .when(F.length(value) > MOST_CHARS, "long")
        .when(words > MOST_WORDS, "prose")
        .when(~value.rlike(TOKEN), "no label")
    )


def guard(strings: DataFrame, vocabulary: DataFrame, value: str = "value") -> DataFrame:
    """The rows of ``strings`` that may not be published, with the reason; ``vocabulary`` has the allowed values."""
    known = vocabulary.select(F.col(value).alias("_known")).distinct()
    told = strings.join(known, F.col(value) == F.col("_known"), "left")
    return told.withColumn("reason", refused(F.col(value), F.col("_known").isNotNull())).filter("reason is not null").drop("_known")


#: Buckets that rows are compared in.
BUCKETS = 4096


def row_digest(df: DataFrame, seed: int = 0) -> Column:
    """A hash of a row's values, nulls told apart from one another by their places."""
    nulls = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in df.columns])
    return F.xxhash64(F.lit(seed), nulls, *df.columns)


def bucket_digests(df: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n, first, second): the rows of each bucket and two sums over their hashes, which no order changes and repeats count in."""
    part = lambda h: F.pmod(h, F.lit((1 << 31) - 1))
    h = row_digest(df)
    return df.select(F.pmod(h, F.lit(buckets)).alias("bucket"), part(h).alias("h"), part(row_digest(df, 1)).alias("g")).groupBy("bucket").agg(F.count("*").alias("n"), F.sum("h").alias("first"), F.sum("g").alias("second"))


def differing_buckets(a: DataFrame, b: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The buckets whose rows differ between two tables of the same columns: both are read once, and a few numbers a bucket are compared."""
    x, y = bucket_digests(a, buckets), bucket_digests(b.select(a.columns), buckets)
    names = ("n", "first", "second")
    met = x.withColumnsRenamed({c: f"{c}_a" for c in names}).join(y.withColumnsRenamed({c: f"{c}_b" for c in names}), "bucket", "full")
    same = F.lit(True)
    for c in names:
        same = same & F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b"))
    return met.filter(~same).select("bucket")


def differing(a: DataFrame, b: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Rows of one table that the other lacks, counting repeats, with the side they are on.

    Equal tables are told so without moving a row. Else only the rows of buckets that differ are compared with each other.
    Columns are those of ``a``, of types that can be compared.
    """
    b = b.select(a.columns)
    (mark,) = [next(m for m in ("_bucket", "__bucket", "___bucket") if m not in a.columns)]
    off = F.broadcast(settled(differing_buckets(a, b, buckets).withColumnRenamed("bucket", mark), "buckets"))
    few = lambda df: df.join(off, F.pmod(row_digest(df), F.lit(buckets)) == F.col(mark), "left_semi")
    x, y = few(a), few(b)
    return x.exceptAll(y).withColumn("only_in", F.lit("first")).unionByName(y.exceptAll(x).withColumn("only_in", F.lit("second")))
