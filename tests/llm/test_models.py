"""Quality rules, language-model scores, packing, archives, decontamination and the pipeline."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from tokenizers import Tokenizer

from parlance.llm import decontam, lmscore, packing, quality, warc


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = defaultdict(list)
    for i in range(len(words) - 2):
        grams[tuple(words[i : i + 3])].append(i)
    covered = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)]


def test_counts_equal_brute_force():
    r = random.Random(2)
    texts = ["", " ", "a", "a b", "a b c a b c", "é\xa0ü x\ty\x0bz", "l\nl\n l\n\nl", "a a a a a"] + ["".join(r.choice("ab #\n|é ") for _ in range(200)) for _ in range(50)]
    for t in texts:
        assert quality.counts(t)[0] == brute_counts(t), t


def test_trees_are_monotonic_and_accurate():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] + 0.3 * np.sin(9 * x[:, 0]) < 0.6) & (x[:, 1] > 0.2)).astype(float)
    trees = quality.fit(x[:3000], y[:3000], [-1, 0, 0])
    assert ((trees.probability(x[3000:]) > 0.5) == y[3000:]).mean() > 0.93
    grid = np.repeat(rng.random((50, 3)), 101, 0)
    grid[:, 0] = np.tile(np.linspace(0, 1, 101), 50)
    assert (np.diff(trees.margin(grid).reshape(50, 101), axis=1) <= 1e-12).all()
    walked = []
    for row in x[:200]:
        total = trees.start
        for at in trees.roots:
            while trees.left[at] != at:
                at = trees.left[at] if row[trees.feature[at]] <= trees.threshold[at] else trees.right[at]
            total += trees.value[at]
        walked.append(total)
    assert np.allclose(walked, trees.margin(x[:200]))


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    train = labels.filter("doc_id % 2 = 0")
    got = quality.quality_rules(docs, train).select("doc_id", "kept", "base_failed").join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    good = [r for r in got if r.quality == 1 and not r.base_failed]
    bad = [r for r in got if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.97 * len(good) and sum(r.kept for r in bad) <= 0.1 * len(bad)


def test_quality_awkward(spark, make, awkward):
    labels = spark.createDataFrame([(1, 1), (None, 0), (4, None)], "doc_id long, quality int")
    got = quality.quality_rules(make(awkward), labels).collect()
    assert len(got) == len(awkward)
    assert {r.doc_id for r in got if r.kept} == {r.doc_id for r in got if not r.base_failed} == {2**60 + 1, 4, 5}
    assert quality.accepted(make(awkward), labels).count() == 4
    assert quality.quality_rules(make([]), labels).count() == 0


def brute_scores(rows, target):
    """(target loss, background loss) of each row, from the counts of the other rows."""
    texts = [["<s>", *(t or "").lower().split()] for _, t in rows]
    places = len({w for t in texts for w in t[1:]})
    out = []
    for side in (lambda i: i in target, lambda i: True):
        uni, bi, context = Counter(), Counter(), Counter()
        for (i, _), w in zip(rows, texts):
            if side(i) and len(w) > 1:
                uni.update(w[1:])
                bi.update(zip(w, w[1:]))
                context.update(w[:-1])
        total = sum(uni.values()) + lmscore.ALPHA * places
        losses = []
        for (i, _), w in zip(rows, texts):
            own = [Counter(x) if side(i) else Counter() for x in (w[1:], zip(w, w[1:]), w[:-1])]
            share = lambda v: (uni[v] - own[0][v] + lmscore.ALPHA) / total
            told = [-math.log((bi[u, v] - own[1][u, v] + lmscore.WEIGHT * share(v)) / (context[u] - own[2][u] + lmscore.WEIGHT)) for u, v in zip(w, w[1:])]
            losses.append(sum(told) / len(told) if told else None)
        out.append(losses)
    return list(zip(*out))


def check_scores(spark, make, rows, target):
    labels = spark.createDataFrame([(i, 1, 0) for i in target] + [(None, 1, 0), (-5, 1, 1), (-6, 0, 0), (-7, None, 0)], "doc_id long, quality int, toxic int")
    got = defaultdict(list)
    for x in lmscore.score_documents(make(rows).repartition(3), labels).collect():
        got[x.doc_id, x.n_tokens].append((x.ce_target, x.ce_background))
        assert x.ce_difference is None if x.ce_target is None else abs(x.ce_difference - x.ce_target + x.ce_background) < 1e-12
    assert sum(map(len, got.values())) == len(rows)
    want = defaultdict(list)
    for (i, t), pair in zip(rows, brute_scores(rows, target)):
        want[i, len((t or "").split())].append(pair)
    for key, pairs in want.items():
        if pairs[0][0] is None:
            assert got[key] == pairs, key
        else:
            assert np.allclose(sorted(got[key]), sorted(pairs), atol=1e-9, rtol=0), key


@pytest.mark.parametrize("bounds", [{}, {"FREQUENT_WORDS": 40, "FREQUENT_BIGRAMS": 300, "FLUSH_WORDS": 500, "FLUSH_ENTRIES": 400, "BUCKET_ENTRIES": 200}, {"FREQUENT_WORDS": 0}])
def test_scores_equal_brute_force(spark, make, prose, monkeypatch, bounds):
    """Whatever is frequent, and however the entries are packed."""
    for name, value in bounds.items():
        monkeypatch.setattr(lmscore, name, value)
    rows = [(i, prose(60, i % 25)) for i in range(40)] + [(90, None), (91, " "), (92, ""), (None, prose(10, 3)), (None, "New words"), (-6, "new words"), (-5, "words words words"), (50, "é Ü\n\tx"), (50, "É ü x")]
    check_scores(spark, make, rows, set(range(0, 40, 3)) | {50})


def test_scores_beyond_the_frequent_words(spark, make):
    r = random.Random(8)
    some = lambda: f"w{int(r.paretovariate(0.6)) % 5000}" if r.random() < 0.4 else f"x{r.randrange(80_000)}"
    rows = [(i, " ".join(some() for _ in range(r.randint(1, 8000)))) for i in range(60)] + [(70, "w1 w1 w1 w2999 w2999 w2999"), (71, "new words alone"), (71, "new words alone"), (None, "w1 new"), (72, "")]
    assert len({w for _, t in rows for w in t.split()}) > lmscore.FREQUENT_WORDS
    check_scores(spark, make, rows, {i for i, _ in rows[:60:4]})


def test_losses_of_a_bucket_take_little_memory():
    """At most 80 bytes an entry above what comes in, half of the entries rare words; a worker keeps its peak as long as it lives."""
    rng, n = np.random.default_rng(4), 1_200_000
    side = lmscore.Side(10**9, 10**6, 10**6, np.full(5, 10**6), np.zeros(5, np.int64), np.zeros(0, np.int64))
    models = SimpleNamespace(value=lmscore.Models(np.arange(5, dtype=np.uint64), np.zeros(0, np.uint64), side, side))
    rows = []
    for flush, kind in ((f, k) for f in range(4) for k in (lmscore.COMMON, lmscore.RARE)):
        key, rest = rng.integers(0, 2**63, n // 8, np.uint64), rng.integers(0, 5, n // 8, np.uint32)
        doc = np.sort(rng.integers(0, 5000, n // 8))
        rows.append((0, flush, kind, key.tobytes(), rest.tobytes(), lmscore.gaps(doc), np.full(n // 8, 5, np.uint32).tobytes(), np.full(n // 8, 2, np.uint32).tobytes()))
    table = pa.table([pa.array(c) for c in zip(*rows)], names=[c.split()[0] for c in lmscore.ENTRIES.split(", ")])
    losses = lmscore.bucket_losses(models)
    tracemalloc.start()
    try:
        got = losses(table)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 80 * n
    assert got.num_rows == 8 and sum(len(lmscore.places(x)) for x in got.column("doc").to_pylist()) <= 8 * 5000


def test_scores_without_targets_or_rows(spark, make):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in lmscore.score_documents(make([(1, "a b"), (2, "a b c")]), labels).collect()}
    assert abs(got[1].ce_target - math.log(3)) < 1e-12
    assert lmscore.score_documents(make([]), labels).count() == 0


def test_scores_tell_held_out_prose(spark):
    """Documents labelled good, but not shown as targets, score lower than those labelled bad."""
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    got = lmscore.score_documents(docs, labels.filter("doc_id % 2 = 0")).join(labels.filter("doc_id % 2 = 1"), "doc_id").filter("n_tokens >= 50").select("ce_difference", "quality", "toxic").toPandas()
    good = got[(got.quality == 1) & (got.toxic == 0)].ce_difference.to_numpy()
    bad = got[(got.quality == 0) | (got.toxic == 1)].ce_difference.to_numpy()
    auc = np.mean(good[:, None] < bad[None, :])
    print("held-out separation", len(good), len(bad), auc)
    assert auc > 0.6


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


ODD = ["", " ", "a", " a", "a ", "a  b", "a   b", "a \n b", "a\n b", "x\n\ny z\n", "tab\there", "<|endoftext|> it's we'll", "x<|endoftext|><|endoftext|>y <|endoftext",  "\xa0n b s", "é ü 😀 ß 12 345!!", "a\r\nb c", "\x1c x", "don't  stop", "naïve café́ x"]


def test_ids_equal_the_library(library, prose):
    ids = packing.Ids()
    assert np.frombuffer(ids("a <|endoftext|> b"), "<u4").tolist() == [64, 220, 50256, 275]
    r = random.Random(4)
    texts = ODD + ["".join(r.choice("ab \n é'1.\t") for _ in range(60)) for _ in range(200)] + [prose(300, 5)]
    for t in texts:
        assert np.frombuffer(ids(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_packing_round_trip(spark, make, prose, library, awkward):
    rows = [(i, prose(random.Random(i).choice([1, 5, 40, 200, 900, 3000]), i)) for i in range(120)] + [(200 + i, t) for i, t in enumerate(ODD)] + [(300, None), (2**60 + 1, "x")]
    pieces = packing.pack_documents(make(rows).repartition(3)).collect()
    want = {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in rows}
    at, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = want[p.doc_id]
        assert p.doc_tokens == len(ids) and p.length > 0
        assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
        at[p.doc_id].append((p.start, p.length))
        sequences[p.sequence_id].append((p.offset, p.length, p.step_group))
    for i, ids in want.items():
        place = 0
        for start, length in sorted(at[i]):
            assert start == place
            place += length
        assert place == len(ids)
    sizes = []
    for s in sequences.values():
        place = 0
        for offset, length, _ in sorted(s):
            assert offset == place
            place += length
        assert place <= 1024 and len({g for _, _, g in s}) == 1
        sizes.append(place)
    assert sum(n not in packing.TIERS for n in sizes) <= 3 and Counter(sizes)[1024] > len(sizes) / 2
    assert packing.pack_documents(make([])).count() == 0
    assert packing.pack_documents(make(awkward)).select("doc_id").count() >= len(awkward)


def test_step_groups_are_balanced(monkeypatch, prose):
    packer = packing.Packer(0)
    r = random.Random(1)
    for doc in range(3000):
        packer.add(doc, bytes(4 * r.choice([1, 30, 130, 300, 700, 1500, 1024])))
    packer.pack(True)
    load, seen = Counter(), {}
    for _, _, n, _, _, sequence, _, step in packer.taken():
        load[step] += n
        seen[sequence] = step
    full = [n for step, n in load.items() if step < max(load)]
    assert max(full) <= packing.STEP_TOKENS and sum(n == packing.STEP_TOKENS for n in full) >= len(full) - 4


def test_warc_round_trip(spark, tmp_path, awkward):
    html = {1: "<p>a</p>", 2: "<p>b</p>" * 4000, 3: "<p>a</p>", 4: None, 5: "", 6: "é\r\n\r\n😀", 7: "<p>a</p>", 0: "<p>b</p>" * 4000}
    rows = [(i, f"http://x/ü {i}\r\nX: y", h, 1) for i, h in html.items()] + [(3, "u", html[3], 1), (None, "v", html[3], 1), (None, None, "alone", 1), (2**60 + 1, None, "big", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, least int").repartition(3)
    folder = f"file://{tmp_path}/w"
    assert warc.write_archives(pages, folder) >= 1
    got = warc.read_archives(spark, folder).collect()
    assert not any(r.error for r in got)
    assert sum(r.record_type == "warcinfo" for r in got) == len({r.archive for r in got})
    got = [r for r in got if r.record_type != "warcinfo"]
    by_id = {r.record_id: r for r in got}
    for r in got:
        if r.record_type == "revisit":  # the standard fields name the response
            there = by_id[r.refers_to_id]
            assert (there.record_type, there.page_id, there.url, there.date) == ("response", r.refers_to, r.refers_to_url, r.refers_to_date)
    assert len(got) == len(rows)
    first = {}
    for i, _, h, _ in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    for r in got:
        if r.page_id is not None:
            data = (dict((x[0], x[2]) for x in rows)[r.page_id] or "").encode()
            rep = first[data.decode()]
            assert (r.payload_bytes, r.payload_digest) == (len(data), warc.sha1_base32(data))
            assert (r.record_type, r.refers_to) == (("response", None) if rep == r.page_id else ("revisit", rep))
            assert r.record_type == "revisit" or bytes(r.payload) == data
    assert warc.round_trip(spark.createDataFrame([], pages.schema)).count() == 0


def test_archive_dictionary_and_damage():
    records = [warc.record(i, "http://x", f"<html>{i} some shared boilerplate text</html>".encode() * 3, None) for i in range(300)]
    data = warc.archive_bytes(records)
    assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_MAGIC
    assert list(warc.frames(data)) == records
    with pytest.raises(Exception):
        list(warc.frames(data[:-5]))
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(warc.frames(data[:-1] + b"" + b"junkjunkjunk"))
    for broken in (records[0][:-1], records[0].replace(b"Content-Length", b"Content-Size", 1), records[0].replace(b"boilerplate", b"boilerplatE", 1), b"WARC/0.9" + records[0][8:]):
        with pytest.raises((ValueError, KeyError)):
            warc.parsed(broken)


def foreign(kind, block, *fields, version="WARC/1.0", newline="\r\n"):
    """A record as other writers make it."""
    head = newline.join([version, f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x:{kind}{len(block)}>", "warc-date: 2020-01-02T03:04:05Z", *fields, f"content-length: {len(block)}", "", ""])
    return head.encode() + block + b"\r\n\r\n"


def test_archives_of_other_writers(spark, tmp_path):
    """WARC/1.0 and 1.1, no block digest, no HTTP length, chunked bodies, other record types, no dictionary."""
    http, url = "Content-Type: application/http;msgtype=response", "WARC-Target-URI: <http://a.example/>"
    hexed = f"WARC-Payload-Digest: sha1:{hashlib.sha1(b'plain').hexdigest()}"
    data = [
        foreign("warcinfo", b"software: x\r\n"),
        foreign("request", b"GET / HTTP/1.1\r\n\r\n", "Content-Type: application/http;msgtype=request"),
        foreign("response", b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\nplain", http, url, hexed),
        foreign("response", b"HTTP/1.0 200 OK\r\n\r\n", http, "X-Long: one", " two", version="WARC/1.1"),
        foreign("response", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n4;x=1\r\nchun\r\n3\r\nked\r\n0\r\n\r\n", http),
        foreign("resource", b"%PDF", "Content-Type: application/pdf"),
        foreign("revisit", b"", "WARC-Refers-To-Target-URI: http://a.example/", "WARC-Refers-To-Date: 2020-01-01T00:00:00Z", hexed),
        foreign("response", b"HTTP/1.1 200 OK\r\nContent-Length: 99\r\n\r\nshort", http),
        foreign("response", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\nff\r\nx", http),
        foreign("response", b"HTTP/1.1 200 OK\r\n\r\nplaiN", http, hexed),
    ]
    packer = zstandard.ZstdCompressor(write_content_size=False)
    (tmp_path / "a.warc.zst").write_bytes(b"\x50\x2a\x4d\x18\x03\x00\x00\x00abc" + b"".join(map(packer.compress, data)))
    got = warc.read_archives(spark, f"file://{tmp_path}").collect()
    assert [r.error is not None for r in got] == [False] * 7 + [True] * 3
    assert [(r.record_type, r.payload and bytes(r.payload), r.payload_bytes) for r in got[:7]] == [
        ("warcinfo", None, None), ("request", None, None), ("response", b"plain", 5), ("response", b"", 0), ("response", b"chunked", 7), ("resource", b"%PDF", 4), ("revisit", None, None),
    ]
    assert got[2].payload_digest == warc.sha1_base32(b"plain") and got[2].url == "http://a.example/" and got[2].page_id is None
    assert got[6].refers_to_url == "http://a.example/" and got[6].refers_to_date == "2020-01-01T00:00:00Z"


def brute_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def test_myers_equals_dynamic_programming():
    r = random.Random(6)
    for _ in range(400):
        pattern = [r.choice("abc") for _ in range(r.randint(1, 90))]
        text = [r.choice("abc") for _ in range(r.randint(0, 120))]
        distance, end = decontam.myers(pattern, text)
        assert distance == brute_distance(pattern, text)
        assert distance == brute_distance(pattern[::-1], text[:end][::-1])


def test_leaks_equal_brute_force(spark, make, prose, awkward):
    r = random.Random(9)
    items = [(i, prose(n, 500 + i).capitalize() + ".") for i, n in enumerate([1, 3, 7, 16, 20, 35, 60, 60])] + [(50, None), (51, "!!"), (None, "x y")]
    rows = []
    for d in range(120):
        item = decontam.normal(items[d % 8][1]).split()
        for _ in range(d % 12):
            k = r.randrange(len(item))
            item[k : k + r.randint(0, 1)] = [r.choice(["new", "words"])] * r.randint(0, 2)
            item = item or ["z"]
        rows.append((d, prose(r.randint(0, 50), d) + " " + r.choice([" ", "!! "]).join(item).upper() + "\n" + prose(r.randint(0, 50), 200 + d)))
    rows += awkward[:5]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id, x.n_edits) for x in decontam.find_leaks(make(rows), benchmark).collect()}
    want = set()
    for d, t in rows:
        for i, text in items[:8]:
            p = decontam.normal(text).split()
            n = brute_distance(p, decontam.normal(t or "").split())
            if n <= decontam.budget(len(p)) and n < len(p):
                want.add((d, i, n))
    assert got == want and any(n > 2 for _, _, n in got)
    flagged = decontam.contaminated_flag(make(rows), benchmark).filter("contaminated").select("doc_id").collect()
    assert {x.doc_id for x in flagged} == {d for d, _, _ in want}
    assert decontam.find_leaks(make([]), benchmark).count() == 0
    assert decontam.find_leaks(make(rows), benchmark.limit(0)).count() == 0


def test_items_with_null_and_shared_ids(spark, make, prose):
    """Every distinct (item_id, text) is looked for."""
    texts = [prose(30, 900 + k) for k in range(4)]
    benchmark = spark.createDataFrame([(0, texts[0]), (0, texts[1]), (None, texts[2]), (None, texts[3]), (None, texts[3]), (1, None)], "item_id long, text string")
    docs = make([(k, f"before it {t} after it") for k, t in enumerate(texts)] + [(9, prose(30, 950))])
    assert sorted((r.doc_id, r.item_id or 0, r.item_id is None) for r in decontam.find_leaks(docs, benchmark).collect()) == [(0, 0, False), (1, 0, False), (2, 0, True), (3, 0, True)]
    assert {r.doc_id for r in decontam.contaminated_flag(docs, benchmark).filter("contaminated").collect()} == {0, 1, 2, 3}


def test_flag_over_several_blocks(spark, make, prose, monkeypatch):
    """A benchmark in many blocks flags what one block flags; rows, repeated ones too, and other columns stay."""
    items = [prose(40, 700 + k) for k in range(6)]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = [(i, f"before this {t} and after it") for i, t in enumerate(items[:4])] + [(4, "nothing to be found"), (4, "nothing to be found"), (5, None), (None, items[5])]
    docs = make(rows).selectExpr("*", "doc_id as contaminated")
    told = lambda: sorted(map(str, decontam.contaminated_flag(docs, benchmark).collect()))
    whole = told()
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 1)
    assert told() == whole
    assert len(whole) == len(rows) and sum("contaminated=True" in r for r in whole) == 5


def test_pipeline_stages(spark, make, prose):
    import corpus_pipeline as p

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in p.STAGES[:-1]:
        after = p.stored(stage(spark, docs, d), "test")
        assert after.columns == docs.columns, name
        kept = {r.doc_id for r in after.select("doc_id").collect()}
        assert kept <= ids and after.count() == len(kept)
        docs, ids = after, kept
    assert {r.doc_id for r in p.run(spark, d).select("doc_id").distinct().collect()} == ids
    assert not decontam.find_leaks(docs, spark.read.parquet(f"{d}/benchmark.parquet")).count()


def test_no_query_changes_the_session(spark):
    import __spark_entry__

    from parlance.llm import queries

    told = lambda: dict(spark.conf.getAll)
    before = told()
    for name in ("op1_pii", "op3_warc", "op6_secrets", "op8_quality_rules"):
        queries.QUERIES[name](spark, "/root/testdata/sf0.001").count()
        assert told() == before, name
    assert set(queries.QUERIES) <= set(__spark_entry__.queries())
