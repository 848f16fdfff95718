"""Files read in ranges, files that grow, and tables whose readers see whole runs."""

import json
import random

import pytest
from pyspark.sql import functions as F

from parlance.sources import transcripts
from parlance.sources.growing import GrowingReader, Range, lines_from
from parlance.sources.ledger import Ledger, ingest, read_rows, write_rows


def entry(text, side="user"):
    return json.dumps({"type": side, "uuid": text, "timestamp": "2026-01-01T00:00:00Z", "message": {"content": text}}, ensure_ascii=False)


def plain(folder):
    """(relpath, line_no, text) by plain Python."""
    out = set()
    for path in folder.rglob("*.jsonl"):
        if not path.name.startswith("._"):
            for n, x in enumerate(path.read_bytes().decode("utf-8", "replace").split("\n"), 1):
                if x.strip():
                    out.add((str(path.relative_to(folder)), n, x))
    return out


@pytest.fixture
def archive(tmp_path):
    r = random.Random(2)
    folder = tmp_path / "in" / "box" / "root" / "proj"
    folder.mkdir(parents=True)
    for k in range(4):
        lines = ["" if r.random() < 0.1 else entry("é" * r.randint(1, 200) + str(i)) for i in range(r.choice([0, 1, 700]))]
        (folder / f"s{k}.jsonl").write_text("\n".join(lines) + ("\n" if k % 2 else ""), encoding="utf-8")
    (folder / "big.jsonl").write_text("\n".join(entry(f"{'x' * r.randint(0, 400)}{i}") for i in range(3000)), encoding="utf-8")
    (folder / "._s1.jsonl").write_text("skip\n")
    return tmp_path / "in"


def test_lines_of_files_in_many_blocks(spark, archive):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
        lines = transcripts.read_lines(spark, str(archive))
        got = {(r.path.split("/in/")[1], r.line_no, r.value) for r in lines.filter("trim(value) != ''").collect()}
        assert lines.filter("path like '%big%'").select(F.spark_partition_id()).distinct().count() > 20
        assert transcripts.read_messages(spark, str(archive)).count() == len(got)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == plain(archive) and len(got) > 3000


def test_ranges_give_each_line_once(tmp_path):
    r = random.Random(3)
    for _ in range(60):
        data = b"".join(bytes(r.choice(b"ab\r\xff") for _ in range(r.randint(0, 9))) + b"\n" for _ in range(r.randint(1, 30)))
        path = tmp_path / "x"
        path.write_bytes(data)
        want = [(at, x) for at, x in zip([0, *(i + 1 for i, b in enumerate(data) if b == 10)], data.split(b"\n")[:-1])]
        first = r.choice([0, *(at for at, _ in want)])
        size = r.randint(1, 40)
        got = []
        for low in range(first, len(data), size):
            with path.open("rb") as f:
                got += [(at, v) for starts, values in lines_from(f, Range("x", first, low, min(low + size, len(data)), len(data))) for at, v in zip(starts, values)]
        assert got == [(at, x.removesuffix(b"\r").decode("utf-8", "replace")) for at, x in want if at >= first]


def test_a_grown_file_gives_its_new_lines_alone(spark, archive, tmp_path):
    folder = f"file://{tmp_path}/out"
    run = lambda: ingest(spark, f"file://{archive}", folder, range_bytes=9000)
    told = lambda df: {(r.file_id, r.line_no, r.text) for r in df.collect()}
    whole = lambda: told(transcripts.read_messages(spark, str(archive)))
    first = run()
    ended = {(f, n) for f, n, _ in whole()} - {(f, n) for f, n, _ in told(first)}
    assert len(ended) == sum(not p.read_bytes().endswith(b"\n") and bool(p.read_bytes()) for p in archive.rglob("*.jsonl"))  # lines without an end wait
    big, new = archive / "box/root/proj/big.jsonl", archive / "box/root/proj/new.jsonl"
    with big.open("a", encoding="utf-8") as f:
        f.write("\n\n" + entry("later") + "\n" + entry("not don")[:-3])
    new.write_text(entry("fresh") + "\n", encoding="utf-8")
    for p in archive.rglob("s*.jsonl"):
        if p.read_bytes() and not p.read_bytes().endswith(b"\n"):
            p.write_bytes(p.read_bytes() + b"\n")
    run()
    ledger = Ledger(spark, f"{folder}/messages")
    second = ledger.read(last=True)
    assert {r.text for r in second.collect()} >= {"later", "fresh"} and second.count() <= 8
    with big.open("a", encoding="utf-8") as f:
        f.write('e"}}\n')
    assert told(run()) == whole() and told(run()) == whole() and len(ledger.runs()) == 3


def test_a_batch_done_again_adds_nothing(spark, archive, tmp_path):
    folder = f"file://{tmp_path}/out"
    calls = []

    def broken(lines):
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("lost")
        return transcripts.messages_of(lines)

    with pytest.raises(Exception, match="lost"):
        ingest(spark, f"file://{archive}", folder, transform=broken)
    assert Ledger(spark, f"{folder}/messages").runs() == {}  # nothing half done is seen
    n = ingest(spark, f"file://{archive}", folder, transform=broken).count()
    counts = tmp_path / "out" / "lines" / "manifest"
    for p in counts.glob("*.json"):  # as if the driver had died between the two tables
        p.unlink()
    for p in (tmp_path / "out" / "checkpoint" / "commits").iterdir():
        p.unlink()
    assert ingest(spark, f"file://{archive}", folder).count() == n and len(list(counts.glob("*.json"))) == 1


def test_rows_are_seen_whole(spark, tmp_path):
    folder = f"file://{tmp_path}/rows"
    rows = spark.createDataFrame([(1, "é", ["a"]), (2, None, [])], "n long, t string, xs array<string>")
    with pytest.raises(ValueError):
        read_rows(spark, folder)
    write_rows(rows, folder)
    (tmp_path / "rows" / "runs" / "000000000009-broken").mkdir()
    (tmp_path / "rows" / "runs" / "000000000009-broken" / "part-0.json").write_text('{"n": 9}')
    assert sorted(read_rows(spark, folder).collect()) == sorted(rows.collect())
    write_rows(rows.filter("n = 1"), folder)
    assert [r.n for r in read_rows(spark, folder).collect()] == [1] and Ledger(spark, folder).read().count() == 3
    assert not Ledger(spark, folder).put(rows, 1, "json") and Ledger(spark, folder).read().count() == 3
    text = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "rows" / "runs").rglob("part*.json"))
    assert "é" in text


def test_offsets_survive_a_restart(archive, tmp_path):
    options = {"path": f"file://{archive}", "log": f"file://{tmp_path}/log", "rangeBytes": "5000"}
    one = GrowingReader(options)
    assert one.latestOffset() == one.latestOffset() == {"batch": 1}
    again = GrowingReader(options)
    assert again.latestOffset() == {"batch": 1} and [vars(p) for p in again.partitions({"batch": 0}, {"batch": 1})] == [vars(p) for p in one.partitions({"batch": 0}, {"batch": 1})]
    small = GrowingReader({**options, "log": f"file://{tmp_path}/log2", "mostBytes": "1"})
    offsets = [small.latestOffset()["batch"] for _ in range(8)]
    assert offsets == sorted(offsets) and 2 <= offsets[-1] <= 5


def test_strings_of_nested_documents(spark, tmp_path):
    r = random.Random(6)

    def made(depth):
        kind = r.choice("sonal" if depth else "oa")
        if kind == "s" or depth > 5:
            return r.choice(["plain", 'quote " and \\ back', "line\nend", "é ", "", "tab\t"])
        if kind == "o":
            return {r.choice(["a", "b c", 'k"q', "é", "a.b"]) + str(i): made(depth + 1) for i in range(r.randint(0, 4))}
        if kind == "a":
            return [made(depth + 1) for _ in range(r.randint(0, 4))]
        return r.choice([1, 2.5, None, True]) if kind == "n" else []

    documents = {f"d{i}.json": made(0) for i in range(25)}
    for name, doc in documents.items():
        (tmp_path / name).write_text(json.dumps(doc, ensure_ascii=i_ascii(name)), encoding="utf-8")
    (tmp_path / "broken.json").write_text('{"a": ')
    from parlance.operators.bundles import strings_of

    got = sorted((x.name, x.path, x.value) for x in transcripts.read_bundles(spark, str(tmp_path)).collect())
    assert got == sorted((name, p, v) for name, doc in documents.items() for p, v in strings_of(doc)) and len(got) > 100


def i_ascii(name):
    return name < "d2"


def test_tables_of_whole_runs(spark, archive, tmp_path):
    from parlance.sources.ledger import read_tables, write_tables

    folder = f"file://{tmp_path}/tables"
    with pytest.raises(ValueError):
        read_tables(spark, folder)
    write_tables(spark, str(archive), folder)
    files, messages = read_tables(spark, folder)
    n, held = messages.count(), sum(p.stat().st_size > 0 and not p.name.startswith("._") for p in archive.rglob("*.jsonl"))
    assert n == transcripts.read_messages(spark, str(archive)).count() and files.count() == held
    (archive / "box/root/proj/more.jsonl").write_text(entry("more"))
    assert messages.count() == n  # what was read stays as it was
    write_tables(spark, str(archive), folder)
    files, messages = read_tables(spark, folder)
    assert messages.count() == n + 1 and files.count() == held + 1
    for p in (tmp_path / "tables" / "files" / "manifest").glob("*2.json"):  # a run that lacks a table isn't seen
        p.unlink()
    assert [x.count() for x in read_tables(spark, folder)] == [held, n]


def test_held_files_documents_and_provenance(spark, archive, tmp_path):
    import hashlib
    import subprocess

    from parlance.operators.bundles import provenance
    from parlance.sources.sinks import listed, read_document

    held = {(r.machine_id, r.root_slug, r.relpath): r.bytes for r in transcripts.held_files(spark, str(archive)).collect()}
    assert held["box", "root", "proj/big.jsonl"] == (archive / "box/root/proj/big.jsonl").stat().st_size and len(held) == sum(p.stat().st_size > 0 and p.name[0] != "." for p in archive.rglob("*.jsonl"))
    (tmp_path / "d.json").write_text('{"a": [1, "é"]}', encoding="utf-8")
    assert read_document(spark, str(tmp_path / "d.json")) == {"a": [1, "é"]}
    assert listed(list("abc"), 2) == "a, b, and 1 more" and listed(["a"]) == "a"
    told = provenance(spark, str(tmp_path / "d.json"), str(tmp_path))
    assert told == {"dictionary_sha256": hashlib.sha256((tmp_path / "d.json").read_bytes()).hexdigest(), "commit": None, "dirty": None}
    repo = tmp_path / "repo"
    repo.mkdir()
    for words in (["init", "-q"], ["-c", "user.name=a", "-c", "user.email=b", "commit", "-q", "--allow-empty", "-m", "x"]):
        subprocess.run(["git", *words], cwd=repo, check=True)
    told = provenance(spark, str(tmp_path / "d.json"), str(repo))
    assert len(told["commit"]) == 12 and told["dirty"] is False
