"""Quality rules: gradient-boosted trees over document statistics.

The trees are trained here, on a bounded sample of labelled documents, with monotonic constraints on chosen
features, then flattened into numpy node arrays that score whole batches at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.shared import BATCH_ROWS, map_rows, stored, texts_of, whole_text

#: Labelled documents the trees are fitted to, at most: those with the smallest hash of their id.
SAMPLE_ROWS = 20_000
TREES, DEPTH, RATE, BINS, LEAST_LEAF, RIDGE = 60, 3, 0.2, 32, 20, 1.0
#: A document is kept if the trees give it at least this probability of good quality. Below a half, as a good document lost
#: costs more than a bad one kept; held-out labels at sf0.1 are told apart equally well by any value from 0.05 to 0.5.
KEEP_FROM = 0.3

#: Features by name, and how the probability of good quality may move with them (0: either way).
FEATURES = {
    "log_words": 0, "word_chars": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1, "distinct_share": 0,
    "upper_share": -1, "mark_share": -1, "digit_share": 0, "top_word_share": -1, "line_words": 0, "short_share": 0, "bar_share": -1,
}
SYMBOLS = b"#*$%&|<>"
MARKS = b"!?*#%$&"


def counts(text: str) -> tuple[list[int], list[float]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the features of one text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    blank = int(hist[[9, 10, 11, 12, 13, 32]].sum())
    n_symbols = int(hist[list(SYMBOLS)].sum())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup_lines = len(lines) - len(set(lines))
    repeat, distinct, top = 0, 0, 0
    if n:
        seen: dict[bytes, int] = {}
        ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
        distinct, top = len(seen), int(np.bincount(ids).max())
        if n >= 3:
            pairs = np.unique(ids[:-1] * distinct + ids[1:], return_inverse=True)[1]
            _, inverse, times = np.unique(pairs[:-1] * distinct + ids[2:], return_inverse=True, return_counts=True)
            hit = times[inverse] > 1
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[k : k + len(hit)] |= hit
            repeat = int(covered.sum())
    word_chars = len(text) - blank
    letters = int(hist[65:91].sum() + hist[97:123].sum())
    per = 1.0 / max(n, 1)
    features = [
        np.log1p(n), word_chars * per, n_symbols * per, dup_lines / max(len(lines), 1), repeat * per, distinct * per,
        hist[65:91].sum() / max(letters, 1), hist[list(MARKS)].sum() * per, hist[48:58].sum() / max(word_chars, 1), top * per,
        n / max(len(lines), 1), sum(len(w) <= 3 for w in words) * per, hist[ord("|")] * per,
    ]
    return [n, word_chars, n_symbols, dup_lines, repeat], [float(x) for x in features]


def base_failed(n_words, n_repeat_words):
    """The base rules, for numbers and columns."""
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


BASE_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def document_statistics(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, the base counts and the features of each row's whole text; null and empty texts count 0 everywhere."""

    def scan(batches: Iterator[list[list]]) -> Iterator[list[tuple]]:
        for ids, texts in batches:
            yield [(i, *base, features) for i, (base, features) in ((i, counts(t)) for i, t in zip(ids, texts))]

    schema = "doc_id long, " + ", ".join(f"{k} long" for k in BASE_COUNTS) + ", features array<double>"
    return map_rows(texts_of(documents, id_column, text_column), scan, schema)


@dataclass
class Trees:
    """All nodes of all trees in flat arrays; node i of a leaf has left[i] == i."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of good quality for each row of features."""
        at = np.repeat(self.roots[None, :], len(x), 0)
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.start + self.value[at].sum(1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, signs: list[int]) -> Trees:
    """Boost DEPTH-deep trees on the log loss.

    A split on a feature with a sign is only taken if its two leaf values are ordered by the sign, and their middle
    bounds what may grow below, so that no tree (hence no sum of trees) moves against the sign.
    """
    nodes: list[list[float]] = []
    roots = []
    mean = np.clip(y.mean() if len(y) else 1.0, 1e-3, 1 - 1e-3)
    start = float(np.log(mean / (1 - mean)))
    cuts = [np.unique(np.quantile(x[:, f], np.arange(1, BINS) / BINS)) for f in range(x.shape[1])] if len(y) else []
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1) if len(y) else None
    margin = np.full(len(y), start)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, low: float, high: float) -> int:
        weight = lambda a, b: np.clip(-a / (b + RIDGE), low, high)
        me = len(nodes)
        gain_of = lambda a, b, w: -(a * w + 0.5 * (b + RIDGE) * w * w)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        own = weight(total_g, total_h)
        nodes.append([0, 0.0, me, me, RATE * own])
        best = (1e-6, None)
        if depth < DEPTH and len(rows) >= 2 * LEAST_LEAF:
            for f, cut in enumerate(cuts):
                if not len(cut):
                    continue
                b = binned[rows, f]
                size = len(cut) + 1
                lg, lh, ln = (np.cumsum(np.bincount(b, v, size))[:-1] for v in (g[rows], h[rows], np.ones(len(rows))))
                wl, wr = weight(lg, lh), weight(total_g - lg, total_h - lh)
                gain = gain_of(lg, lh, wl) + gain_of(total_g - lg, total_h - lh, wr) - gain_of(total_g, total_h, own)
                ok = (ln >= LEAST_LEAF) & (len(rows) - ln >= LEAST_LEAF) & (signs[f] * (wr - wl) >= 0)
                gain = np.where(ok, gain, 0)
                if gain.max() > best[0]:
                    k = int(gain.argmax())
                    best = (gain[k], (f, k, wl[k], wr[k]))
        if best[1]:
            f, k, wl, wr = best[1]
            goes = binned[rows, f] <= k
            mid = (wl + wr) / 2
            bounds = {0: ((low, high), (low, high)), 1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}[signs[f]]
            left = grow(rows[goes], g, h, depth + 1, *bounds[0])
            right = grow(rows[~goes], g, h, depth + 1, *bounds[1])
            nodes[me] = [f, float(cuts[f][k]), left, right, 0.0]
        return me

    for _ in range(TREES if len(np.unique(y)) > 1 else 0):
        p = 1 / (1 + np.exp(-margin))
        first = len(nodes)
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), 0, -4.0, 4.0))
        part = flat(nodes[first:], [0], 0.0, first)
        margin += part.margin(x)
    return flat(nodes, roots, start, 0)


def flat(nodes: list[list[float]], roots: list[int], start: float, offset: int) -> Trees:
    a = np.array(nodes or [[0, 0, offset, offset, 0]], float)
    at = lambda i: a[:, i].astype(np.int64)
    return Trees(at(0), a[:, 1], at(2) - offset, at(3) - offset, a[:, 4], np.array(roots, np.int64), start)


def sampled(labels: DataFrame, rows: int) -> DataFrame:
    good = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def labelled_sample(statistics: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Features and quality of at most ``rows`` labelled documents, those with the smallest hash of their id.

    Where ids repeat, each of their rows counts, up to ``2 * rows`` rows in all, which bounds what the driver fits.
    """
    sample = sampled(labels, rows)
    got = statistics.join(F.broadcast(sample), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "features").select("features", "quality").limit(2 * rows).toPandas()
    x = np.array(got["features"].tolist(), float).reshape(-1, len(FEATURES))
    return x, got["quality"].to_numpy(float)


def verdicts(statistics: DataFrame, trees: Trees) -> DataFrame:
    """doc_id, the base counts, base_failed, quality (a probability) and kept."""
    where = statistics.sparkSession.sparkContext.broadcast(trees)

    @F.pandas_udf("double")
    def probability(features: pd.Series) -> pd.Series:
        return pd.Series(where.value.probability(np.array(features.tolist(), float).reshape(-1, len(FEATURES))))

    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    scored = statistics.withColumn("base_failed", failed).withColumn("quality", F.round(probability("features"), 6))
    return scored.select("doc_id", *BASE_COUNTS, "base_failed", "quality", (~F.col("base_failed") & (F.col("quality") >= KEEP_FROM)).alias("kept"))


def quality_rules(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics, base rules and the trees' verdict for each row of ``documents``.

    ``labels`` has doc_id and quality (0 or 1); null ids or labels are ignored, of several labels the largest counts.
    Without labels of both kinds the trees keep whatever the base rules keep. Null and empty texts fail the base rules.
    Rows stay as they are: repeated rows each get a verdict, null ids stay null. The texts are read once; their
    statistics, a few numbers a row, are written to the shared folder for fitting and scoring.
    """
    statistics = stored(document_statistics(documents), "statistics")
    return verdicts(statistics, fit(*labelled_sample(statistics, labels), list(FEATURES.values())))


def accepted(documents: DataFrame, labels: DataFrame, text_column: str = "text") -> DataFrame:
    """The rows of ``documents`` that :func:`quality_rules` keeps, with their columns.

    The trees are fitted to the same bounded sample, whose texts are read first; all texts are then scored where they
    lie, without a shuffle.
    """
    spark = documents.sparkSession
    few = documents.join(F.broadcast(sampled(labels, SAMPLE_ROWS).select("doc_id")), "doc_id", "left_semi")
    trees = spark.sparkContext.broadcast(fit(*labelled_sample(document_statistics(few), labels), list(FEATURES.values())))

    @F.arrow_udf("boolean")
    def keeps(texts: pa.Array) -> pa.Array:
        kept = [np.zeros(0, bool)]
        for at in range(0, len(texts), BATCH_ROWS):  # so few texts are Python objects at once
            got = [counts(t) for t in texts.slice(at, BATCH_ROWS).to_pylist()]
            failed = np.array([base_failed(*(base[i] for i in (0, 4))) for base, _ in got], bool)
            good = trees.value.probability(np.array([x for _, x in got], float).reshape(-1, len(FEATURES)))
            kept.append(~failed & (good.round(6) >= KEEP_FROM))
        return pa.array(np.concatenate(kept))

    return documents.filter(keeps(whole_text(text_column)))
