"""Near duplicates and line dedup against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from parlance.llm import hashing, linededup, neardup


def shingles(text):
    w = text.split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute_classes(rows):
    sets = [shingles(t or "") for _, t in rows]
    label = {i: i for i, _ in rows}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, (i, s) in enumerate(rows):
        for b in range(a):
            both = sum((sets[a] & sets[b]).values())
            total = sum((sets[a] | sets[b]).values())
            if (s or "") == (rows[b][1] or "") or total and both / total >= 0.8:
                x, y = sorted((root(i), root(rows[b][0])))
                label[y] = x
    return {i: root(i) for i, _ in rows}


def edited(text, share, seed):
    r = random.Random(seed)
    return " ".join("edit%d" % r.randrange(9999) if r.random() < share else w for w in text.split())


def test_near_duplicates_equal_brute_force(spark, make, prose):
    rows = [(i, prose(random.Random(i).randint(1, 150), i)) for i in range(60)]
    rows += [(100 + i, edited(prose(120, 7), 0.004 * (i % 6), i)) for i in range(80)]
    rows += [(200 + i, prose(40, 900 + i) + " " + prose(60, 8)) for i in range(40)]  # one passage in many documents
    rows += [(300, None), (301, ""), (302, " "), (303, "one two"), (304, "one two"), (305, "one  two"), (306, "spam " * 400), (307, "spam " * 390)]
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(make(rows)).collect()}
    assert got == brute_classes(rows)


def test_awkward_rows(spark, make, awkward):
    got = neardup.near_duplicates(make(awkward)).collect()
    assert len(got) == len(awkward)
    big = 2**60 + 1
    assert {r.class_id for r in got if r.doc_id in (4, big)} == {4}
    assert {r.class_id for r in got if r.doc_id in (1, 2)} == {1}
    kept = neardup.one_of_each(make(awkward)).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id) == [1, 3, 4, 5, 6] and sum(r.doc_id is None for r in kept) == 1
    assert neardup.one_of_each(make(awkward)).columns == make([]).columns
    assert neardup.near_duplicates(make([])).count() == 0


def test_dart_agreement_is_weighted_jaccard():
    a, b = " ".join(f"w{i}" for i in range(500)), " ".join(f"w{i}" for i in range(100, 600))
    sketches = []
    for text in (a, b):
        (_, offsets, data), = hashing.chunks(pa.array([text]))
        e, rows = hashing.shingles(*hashing.words(offsets, data), 5, 1)
        sketches.append(neardup.darts(*hashing.counted(e, rows), 1, 4096)[0])
    assert abs(np.mean(sketches[0] == sketches[1]) - 396 / 596) < 0.03


def test_dart_agreement_with_any_weights():
    rng = np.random.default_rng(2)
    for k in range(6):
        e = rng.choice(2**62, 120, replace=False).astype(np.uint64)
        x = np.exp(rng.normal(0, 2, 120)) if k % 2 else rng.integers(1, 40, 120).astype(float)
        y = np.where(rng.random(120) < 0.6, x, x * rng.choice([0.25, 0.5, 3.0], 120))
        x[:10], y[10:20] = 0, 0
        own, other = x > 0, y > 0
        a = neardup.darts(e[own], x[own], np.zeros(own.sum(), np.int64), 1, 4096)[0]
        b = neardup.darts(e[other], y[other], np.zeros(other.sum(), np.int64), 1, 4096)[0]
        assert abs(np.mean(a == b) - np.minimum(x, y).sum() / np.maximum(x, y).sum()) < 0.04
    heavy = neardup.darts(e[:2], np.array([1e6, 3e5]), np.zeros(2, np.int64), 1, 64)  # no more work than with small weights
    assert (heavy != 0).all()


def test_counted_hashes():
    h, rows = np.array([5, 7, 5, 5, 7], np.uint64), np.array([0, 0, 0, 1, 1])
    assert sorted(zip(*(x.tolist() for x in hashing.counted(h, rows)))) == [(5, 1, 1), (5, 2, 0), (7, 1, 0), (7, 1, 1)]


def test_hashed_words_keep_rows_apart():
    (_, offsets, data), = hashing.chunks(pa.array(["ab cd", None, "", "ab", " cd  ab ", "abcd"]))
    h, rows = hashing.words(offsets, data)
    assert rows.tolist() == [0, 0, 3, 4, 4, 5]
    assert h[0] == h[2] == h[4] and h[1] == h[3] and len({int(h[0]), int(h[1]), int(h[5])}) == 3


def brute_lines(rows):
    """(doc_id, text before, text after) of each row, copies one after the other."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest()))
    first, wins = {}, []
    for at, (_, text) in enumerate(order):
        lines = [(k, x.strip(" \t\r\x0b\x0c")) for k, x in enumerate((text or "").split("\n"))]
        lines = [x for x in lines if x[1]]
        for k in range(len(lines) - 2):
            w = tuple(x[1] for x in lines[k : k + 3])
            wins.append((at, lines[k][0], lines[k + 2][0], w))
            first.setdefault(w, wins[-1])
    gone = {}
    for at, a, b, w in wins:
        if at != first[w][0] or a > first[w][2]:
            gone.setdefault(at, set()).update(range(a, b + 1))
    return [(i, t, t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone.get(at, ()))) for at, (i, t) in enumerate(order)]


def told(rows):
    return Counter((i, t) for i, t in rows)


def test_lines_equal_brute_force(spark, make, monkeypatch):
    r = random.Random(3)
    rows = [(i, "\n".join(r.choice(["a", "b", "c", "", " d ", "e\t"]) for _ in range(r.randint(0, 14)))) for i in range(60)]
    rows += [(90, None), (91, "a\na\na\na\na"), (92, "p\nq\nr\nq\np\nq\nr")]
    again = [(i % 7 if i % 3 else None, t) for i, t in rows] + rows[:9] * 2 + [(None, "x\ny\nz")] * 3 + [(1, "x\ny\nz\nmore"), (1, "\nx\n\ny\nz\n")]
    for data in (rows, again):
        for keys in (linededup.HOT_KEYS, 1):  # all windows are hot, or none
            monkeypatch.setattr(linededup, "HOT_KEYS", keys)
            got = linededup.dedup_lines(make(data)).collect()
            assert told((x.doc_id, x.text) for x in got) == told((i, after) for i, _, after in brute_lines(data))
            for x in got:
                assert x.n_lines - x.n_removed <= len((x.text or "").split("\n")) and (x.n_removed == 0 or x.text is not None)


def test_lines_equal_their_sql(spark, make):
    import duckdb

    w = "one line\ntwo line\nthree line"
    rows = [(1, w), (1, f"{w}\nmore"), (None, f"{w}\nothers"), (None, w), (None, w), (2, w), (2, w), (3, None), (4, ""), (4, f"\n{w}\n")]
    documents = make(rows).toPandas().astype({"doc_id": "Int64"})  # noqa: F841
    want = duckdb.sql(linededup.SQL).fetchall()
    got = linededup.dedup_lines(make(rows)).collect()
    assert Counter((x.doc_id, x.n_lines, x.n_removed, x.text) for x in got) == Counter((a, b, c, e) for a, b, c, _, e in want)
    assert sum(x.n_removed == 0 for x in got) == 3  # the first with the lines, the null and the empty text


def test_line_dedup_awkward(spark, make, awkward):
    got = linededup.dedup_lines(make(awkward)).collect()
    assert len(got) == len(awkward) and all(r.n_removed == 0 for r in got)
    lines = "one line\ntwo line\nthree line"
    got = linededup.dedup_lines(make([(None, lines), (5, lines), (5, lines), (3, lines)])).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 0), (3, 3), (5, 3), (5, 3)]
    assert linededup.dedup_lines(make([])).count() == 0


def test_any_column_name_is_kept(spark, prose):
    """Columns named like every internal one of the stages that keep the documents' columns."""
    lines = "one line\ntwo line\nthree line"
    text = prose(60, 4)
    names = ["id", "version", "gone_id", "gone_version", "covered", "copy", "rank", "least", "digest", "rep", "n", "contaminated", "key", "hot", "Covered"]
    rows = [(1, lines), (1, lines), (2, f"{lines}\nx"), (3, text), (4, f"{text} more"), (None, None), (1, f"{lines} {text}")]
    for prefix in ("_", "__", ""):
        extra = list(dict.fromkeys(f"{prefix}{x}".lower() for x in names))
        docs = spark.createDataFrame([(i, t, *range(len(extra))) for i, t in rows], ", ".join(["doc_id long", "text string", *(f"{x} int" for x in extra)]))
        for out, n in ((linededup.dedup_lines(docs), 7), (neardup.one_of_each(docs), 4)):
            got = out.collect()
            assert len(got) == n and all([r[x] for x in extra] == list(range(len(extra))) for r in got)


def test_families_around_the_threshold_in_many_turns(spark, make, prose, monkeypatch):
    """Copies between 0.3 and 0.96 alike, most linked through few others; small turns, so that many are needed."""
    monkeypatch.setattr(neardup, "SPREAD", 2)
    rows = [(i, edited(prose(150, 11 + i % 2), 0.001 * (1 + i % 60), i)) for i in range(110)]
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(make(rows)).collect()}
    want = brute_classes(rows)
    assert got == want and 2 < len(set(want.values())) < len(rows)


@pytest.mark.parametrize("task_edges", [100_000, 30])
def test_components_of_paths_and_hubs(spark, monkeypatch, task_edges):
    """A long path in shuffled numbers, a hub, a ring, pairs, an edge twice; few links lie in few files."""
    monkeypatch.setattr(neardup, "TASK_EDGES", task_edges, raising=False)
    r = random.Random(6)
    names = r.sample(range(10_000), 80)
    path, hub, ring = names[:8], names[8:50], names[50:60]
    edges = [*zip(path, path[1:]), *((hub[7], x) for x in hub if x != hub[7]), *zip(ring, ring[1:] + ring[:1]), *zip(names[60::2], names[61::2]), (path[0], path[1]), (path[1], path[0])]
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"  # as on a session that keeps all its partitions
    spark.conf.set(coalesce, "false")
    try:
        labels = neardup.components(spark.createDataFrame(edges, "a long, b long").repartition(4))
    finally:
        spark.conf.unset(coalesce)
    got = {x.node: x.label for x in labels.collect()}
    want = {x: min(g) for g in (path, hub, ring, *zip(names[60::2], names[61::2])) for x in g}
    assert got == want and labels.count() == len(want)
    assert task_edges == 30 or len(labels.inputFiles()) == 1


def test_ids_that_repeat_with_another_text(make, prose):
    """Each text has its own class; near copies without ids are linked as well."""
    a, b, c = prose(120, 31), prose(120, 32), prose(120, 33)
    rows = [(1, a), (1, b), (2, f"{a} two"), (3, f"{b} three"), (None, f"more {b}"), (None, c), (None, f"{c} more"), (9, c), (None, "alone here"), (None, "alone here")]
    got = sorted((r.doc_id or 0, r.class_id or 0) for r in neardup.near_duplicates(make(rows)).collect())
    assert got == [(0, 0), (0, 0), (0, 1), (0, 9), (0, 9), (1, 1), (1, 1), (2, 1), (3, 1), (9, 9)]
    kept = sorted((r.doc_id or 0, r.text) for r in neardup.one_of_each(make(rows)).collect())
    assert kept == sorted([(1, a), (1, b), (9, c), (0, "alone here")])


def test_hot_and_cold_keys_meet_alike(spark, monkeypatch):
    from parlance.llm import shared

    df = spark.range(5000).selectExpr("id", "case when id % 3 = 0 then 'hot' when id % 3 = 1 then 'hot too' when id % 7 = 0 then null else cast(id as string) end as k")
    told = df.filter("k is not null and k != 'hot too' and k != '5'").select("k").distinct().selectExpr("k", "upper(k) as v")
    for keys in (0, 4, 10_000):  # none, three or all of the keys are hot
        monkeypatch.setattr(shared, "HOT_KEYS", keys)
        got = [(r.id, r.k, r.v) for r in shared.join_by_share(df, told, "k").select("id", "k", "v").collect()]
        assert len(got) == len(set(got)) == 5000 and all(v == (None if k in (None, "hot too", "5") else k.upper()) for _, k, v in got)
