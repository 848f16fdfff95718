"""Whitening and vector codes against plain versions."""

import hashlib
import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from parlance.llm import codes, whitening
from parlance.llm.vectors import complete

SCHEMA = "vec_id long, embedding array<float>, label int, vector string, x long, code string, whitened int"
NAN, INF = float("nan"), float("inf")


def table(spark, rows):
    """An embeddings table with further columns whose names operators use inside."""
    return spark.createDataFrame([(i, v, y, "v", 7, "c", 1) for i, v, y in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    data = np.concatenate([rng.normal(k, 0.05 + 0.1 * k, (60, 16)) for k in range(4)]).astype(np.float32)
    good = [(i if i % 11 else 5, [float(v) for v in x], i % 3 if i % 7 else None) for i, x in enumerate(data)]
    good += [good[4], good[4], (None, good[9][1], 1), (2**60 + 1, good[10][1], None)]
    odd = [(900, None, 1), (901, [], 1), (902, [1.0] * 15 + [NAN], 1), (903, [1.0] * 15 + [INF], 1), (904, [1.0] * 15 + [-INF], 1), (905, [1.0] * 15 + [None], 1), (906, [1.0] * 3, 1)]
    return good, odd


def test_whitening_equals_the_eigenvectors(spark, rows):
    good, odd = rows
    found = whitening.whiten(table(spark, good + odd))
    got = pd.DataFrame([r.asDict() for r in found.collect()], dtype=object)
    x = np.floor(1024 * np.array([v for _, v, _ in good], np.float32).astype(float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    assert len(got) == 8 * n and set(got.n) == {n}
    centred = (n * x - s) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    want = centred @ vectors[:, :8] / np.sqrt(values[:8])
    key = lambda ids, deviations: sorted(zip([-1 if pd.isna(i) else i for i in ids], deviations))
    first = got[got.component == 1]
    assert key(first.vec_id, first.deviation) == key([i for i, _, _ in good], (((n * x - s) ** 2).sum(1)).tolist())
    for k in range(8):
        assert np.allclose(np.sort(np.abs(got[got.component == k + 1].whitened.astype(float))), np.sort(np.abs(want[:, k])), atol=1e-9)
        assert np.allclose(got[got.component == k + 1].explained.astype(float), values[k] / values.sum(), rtol=1e-9)
    assert got.identity_error.nunique() == 1 and 0 <= got.identity_error[0] < 1e-9


def test_merges_lose_nothing():
    rng = np.random.default_rng(0)
    x = (rng.normal(0, 300, (500, 12)) * np.logspace(0, -2, 12)).astype(np.int64) + 100_000
    whole = whitening.Summary.of(x)
    parts = [whitening.Summary.of(p) for p in np.split(x, [1, 2, 9, 40, 300])]
    left, tree = whitening.merged(parts), whitening.merged([whitening.merged(parts[:3]), whitening.merged(parts[3:])])
    scatter = lambda s: s.vectors.T @ (s.values[:, None] ** 2 * s.vectors)
    for s in (left, tree):
        assert (s.n, s.sums) == (whole.n, whole.sums) and np.allclose(scatter(s), scatter(whole), rtol=1e-9, atol=1e-3)


def test_whitening_of_little(spark):
    assert whitening.whiten(table(spark, [])).collect() == []
    assert whitening.whiten(table(spark, [(1, None, 1), (2, [NAN], 1)])).collect() == []
    assert whitening.whiten(table(spark, [(1, [0.5, 2.0], 1)] * 3)).collect() == []  # no variance, no component
    flat = whitening.whiten(table(spark, [(i, [float(i), 2.0 * i, 1.0], 1) for i in range(20)])).collect()
    assert {r["component"] for r in flat} == {1} and math.isclose(flat[0]["explained"], 1.0)
    huge = whitening.whiten(table(spark, [(1, [3e38, 0.0], 1), (2, [-3e38, 1.0], 1), (3, [1.0, 5.0], 1)])).collect()
    assert len(huge) == 6 and all(math.isfinite(r["whitened"]) for r in huge) and {r["deviation"] for r in huge if r["vec_id"] != 3} == {None}


def plain_codes(good):
    """Lloyd's rounds with every distance, in Python's whole numbers."""
    x = [[math.floor(4096 * float(np.float32(v))) for v in vector] for _, vector, _ in good]
    width = len(x[0]) // 8
    order = sorted(range(len(good)), key=lambda i: (good[i][0] is None, good[i][0] or 0, good[i][1]))[:16]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(x[i], p) for i in order] for p in range(8)]
    apart = lambda a, b: sum((u - v) ** 2 for u, v in zip(a, b))
    nearest = lambda v, p: min((apart(cut(v, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(6):
        own = [[nearest(v, p)[1] for p in range(8)] for v in x]
        for p in range(8):
            for k in range(len(order)):
                mine = [cut(v, p) for v, o in zip(x, own) if o[p] == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    last = [[nearest(v, p) for p in range(8)] for v in x]
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return [("".join(f"{k:02x}" for _, k in row), sum(d for d, _ in row)) for row in last], digest


def test_codes_equal_plain_lloyd(spark, rows):
    good, odd = rows
    ties = [(2000 + i, [float(i % 2), *[0.25 * (i % 3)] * 15], 2) for i in range(12)]  # many parts at equal distances
    for data in (good, good + ties, ties, good[:5]):
        want, digest = plain_codes(data)
        got = codes.compress(table(spark, data + odd)).collect()
        by_label = {y: sum(e for (_, e), (_, _, z) in zip(want, data) if z == y) for y in {y for _, _, y in data}}
        expected = sorted((i if i is not None else -1, c, e, by_label[y]) for (i, _, y), (c, e) in zip(data, want))
        assert sorted((-1 if r.vec_id is None else r.vec_id, r.code, r.error, r.label_error) for r in got) == expected
        assert {r.codebooks_sha256 for r in got} == {digest}


def test_bounds_save_distances_and_change_nothing():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(-50, 50, (400, 4)) + c for c in rng.integers(-2000, 2000, (16, 4))])
    book = codes.Codebook.of(x[:: len(x) // 16][:16])
    own, upper, lower = book.assigned(x)
    saved = 0
    for _ in range(6):
        total = codes.changes(x, None, own, 16)
        book = book.moved(total[:, 1:], total[:, 0])
        own, upper, lower, scanned = book.reassigned(x, own, upper, lower)
        assert (own == codes.distances(x, book.entries).argmin(1)).all()
        saved += scanned < x.shape[0] * 8
    assert saved >= 4


def test_codes_of_little(spark):
    assert codes.compress(table(spark, [])).collect() == [] and codes.compress(table(spark, [(1, None, 1)])).collect() == []
    odd = codes.compress(table(spark, [(i, [float(i)] * 11, None) for i in range(20)])).collect()  # 8 doesn't divide 11
    assert len(odd) == 20 and all(len(r["code"]) == 16 for r in odd)
    short = codes.compress(table(spark, [(1, [1.0], 1), (2, [2.0], 1)])).collect()
    assert {r["code"][:2] for r in short} == {"00", "01"} and {r["code"][2:] for r in short} == {"00" * 7}
    assert len(codes.compress(table(spark, [(1, [3e38] * 8, 1), (2, [-3e38] * 8, 1)])).collect()) == 2


def test_codes_equal_their_sql(spark):
    path = "/root/testdata/sf0.001/embeddings.parquet"
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{path}'")
    want = con.sql(codes.sql()).df().sort_values("vec_id").reset_index(drop=True)
    got = codes.compress(spark.read.parquet(path)).toPandas().sort_values("vec_id").reset_index(drop=True)
    assert got.equals(want[got.columns].astype(got.dtypes.to_dict()))


def test_dimension_is_the_most_frequent(spark):
    kept, d = complete(table(spark, [(1, [1.0], 1), (2, [1.0, 2.0], 1), (3, [1.0, 3.0], 1), (4, [2.0], 1)]), "vec_id", "embedding")
    assert d == 2 and {r["vec_id"] for r in kept.collect()} == {2, 3}
