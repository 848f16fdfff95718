"""WARC archives compressed with Zstandard: one frame per record, a dictionary in the leading skippable frame.

Records with equal payloads are stored once: that of the least page id is a response, the others are revisits that refer to it.
Archives are written by Spark tasks into a folder (any file system pyarrow opens). The reader takes archives of any writer, WARC
1.0 or 1.1, with or without a dictionary, as Spark's binary files: a task reads files of at most
``spark.sql.files.maxPartitionBytes`` together, or one larger file.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.shared import join_by_share, map_rows, shared_folder, stored

# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
VERSION, VERSIONS = "WARC/1.1", (b"WARC/1.0", b"WARC/1.1")
NEEDED = ("warc-type", "warc-record-id", "warc-date", "content-length")
DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An archive is closed once its records have this many bytes; it is read by one task at a time.
ARCHIVE_BYTES = 32 << 20
#: The dictionary is trained on an archive's first records, at most so many bytes of them.
DICTIONARY_BYTES, SAMPLE_BYTES = 16 << 10, 1 << 20
LEVEL = 3


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def target_uri(url: str | None) -> str:
    return "".join(f"%{b:02X}" if b < 33 or b > 126 else chr(b) for b in (url or "").encode("utf-8", "replace"))


def record_id(page_id: int | None, url: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{target_uri(url)}')}>"


def written(kind: str, identity: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record with the fields all records have, and further ones."""
    named = [("WARC-Type", kind), ("WARC-Record-ID", identity), ("WARC-Date", DATE), *fields, ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"), ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {v}\r\n" for k, v in named)
    return f"{VERSION}\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def warcinfo(name: str) -> bytes:
    """The first record of an archive."""
    block = b"software: parlance\r\nformat: WARC File Format 1.1\r\n"
    return written("warcinfo", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'archive:{name}')}>", [("WARC-Filename", name), ("Content-Type", "application/warc-fields")], block)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: tuple[int, str | None] | None) -> bytes:
    """A response record, or a revisit without the payload, which names the response (page id, url) it refers to.

    Page ids travel in extension fields; the standard fields of a revisit are there for other readers.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Target-URI", target_uri(url)), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"), ("X-Page-ID", "" if page_id is None else str(page_id))]
    if refers_to is None:
        return written("response", record_id(page_id, url), fields, http + payload)
    fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(*refers_to)), ("WARC-Refers-To-Target-URI", target_uri(refers_to[1])), ("WARC-Refers-To-Date", DATE), ("X-Refers-To-Page-ID", str(refers_to[0]))]
    return written("revisit", record_id(page_id, url), fields, http)


def archive_bytes(records: list[bytes], name: str | None = None) -> bytes:
    """The dictionary, itself compressed, in a skippable frame (none if there is too little to train on), then a frame a record."""
    sample, size = [], 0
    for r in records:
        if size >= SAMPLE_BYTES:
            break
        sample.append(r[: 16 << 10])
        size += len(sample[-1])
    out, trained = [], None
    try:
        trained = zstandard.train_dictionary(DICTIONARY_BYTES, sample)
    except zstandard.ZstdError:
        pass
    if trained is not None:
        packed = zstandard.ZstdCompressor(level=LEVEL).compress(trained.as_bytes())
        out.append(struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed)
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_checksum=True)
    out += [packer.compress(r) for r in ([warcinfo(name)] if name else []) + records]
    return b"".join(out)


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that begins at ``at`` ends, by its block headers."""
    p = zstandard.get_frame_parameters(bytes(data[at : at + 18]))
    end = at + zstandard.frame_header_size(bytes(data[at : at + 18]))
    last = False
    while not last:
        if end + 3 > len(data):
            raise ValueError("truncated frame")
        head = int.from_bytes(data[end : end + 3], "little")
        last = head & 1
        end += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
    end += 4 * p.has_checksum
    if end > len(data):
        raise ValueError("truncated frame")
    return end


def frames(data: bytes) -> Iterator[bytes]:
    """The records of an archive: the dictionary is loaded first, then each frame is decoded by itself."""
    view, at, dictionary = memoryview(data), 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_MAGIC:
        size = struct.unpack_from("<I", data, 4)[0]
        raw = bytes(view[8 : 8 + size])
        if len(raw) < size:
            raise ValueError("truncated dictionary")
        if raw[:4] == struct.pack("<I", FRAME_MAGIC):
            raw = zstandard.ZstdDecompressor().decompress(raw)
        dictionary, at = zstandard.ZstdCompressionDict(raw), 8 + size
    reader = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while at < len(data):
        magic = struct.unpack_from("<I", data, at)[0] if at + 8 <= len(data) else 0
        if 0x184D2A50 <= magic <= 0x184D2A5F:
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
            continue
        if magic != FRAME_MAGIC:
            raise ValueError(f"no frame at byte {at}")
        end = frame_end(view, at)
        yield reader.decompressobj().decompress(view[at:end])
        at = end


def fields_of(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name, the first of equal ones; a line that begins with white space continues the one before."""
    out: dict[str, str] = {}
    name = None
    for line in head.decode("utf-8", "replace").replace("\r\n", "\n").split("\n"):
        if line[:1] in (" ", "\t") and name:
            out[name] = f"{out[name]} {line.strip()}"
            continue
        name, colon, value = line.partition(":")
        if not colon or name != name.strip():
            raise ValueError(f"bad header line: {line[:80]!r}")
        name = name.lower()
        out.setdefault(name, value.strip())
    return out


def dechunked(body: bytes) -> bytes:
    """The payload of a body in HTTP's chunked transfer coding."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        if end + 2 + size > len(body):
            raise ValueError("a chunk breaks off")
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


def digest_agrees(told: str | None, data: bytes) -> bool:
    """Whether a digest field fits; digests by other algorithms, or none, aren't checked."""
    algorithm, _, value = (told or "").partition(":")
    if algorithm.lower() != "sha1":
        return True
    return value.upper() == sha1_base32(data) if len(value) == 32 else value.lower() == hashlib.sha1(data).hexdigest()


def http_payload(block: bytes) -> tuple[bytes, int]:
    """(payload, its length as the HTTP head says or as found) of an HTTP message."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        head, gap, body = block.partition(b"\n\n")
    if not head.startswith(b"HTTP/"):
        raise ValueError("not an HTTP response")
    lines = head.partition(b"\n")[2].strip()
    fields = fields_of(lines) if lines else {}
    if "chunked" in fields.get("transfer-encoding", "").lower():
        body = dechunked(body)
        return body, len(body)
    told = fields.get("content-length", "")
    return body, int(told) if told.isdigit() else len(body)


def parsed(data: bytes) -> dict:
    """A record's fields and payload, after checks of its version, headers, lengths and digests.

    Responses, resources and conversions have a payload; revisits have its digest, and its length if their HTTP head tells
    it; warcinfo, request and metadata records have neither.
    """
    head, gap, rest = data.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if version not in VERSIONS or not gap:
        raise ValueError("not a WARC record")
    f = fields_of(lines)
    if missing := [name for name in NEEDED if name not in f]:
        raise ValueError(f"no {missing[0]}")
    size = int(f["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("the block isn't as long as its header says")
    block, kind = rest[:size], f["warc-type"].lower()
    if not digest_agrees(f.get("warc-block-digest"), block):
        raise ValueError("the block's digest differs")
    digest, payload, length = f.get("warc-payload-digest"), None, None
    http = "application/http" in f.get("content-type", "").lower()
    if kind in ("response", "resource", "conversion"):
        payload, length = http_payload(block) if http and kind == "response" else (block, len(block))
        if len(payload) != length or not digest_agrees(digest, payload):
            raise ValueError("the payload's length or digest differs")
        digest = sha1_base32(payload)
    elif kind == "revisit":
        length = http_payload(block)[1] if http and block else None
        digest = digest.partition(":")[2] if digest else None
    number = lambda name: int(f[name]) if f.get(name, "").lstrip("-").isdigit() else None
    return {
        "page_id": number("x-page-id"), "payload_bytes": length, "payload_digest": digest if payload is not None or kind == "revisit" else None, "record_type": kind,
        "refers_to": number("x-refers-to-page-id"), "url": f.get("warc-target-uri", "").strip("<>"), "payload": payload, "record_id": f["warc-record-id"], "date": f["warc-date"],
        "refers_to_id": f.get("warc-refers-to"), "refers_to_url": f.get("warc-refers-to-target-uri"), "refers_to_date": f.get("warc-refers-to-date"),
    }


def write_archives(pages: DataFrame, folder: str) -> int:
    """Write a record for each row of ``pages`` (page_id, url, html) into archives in ``folder``; returns their number.

    Null html counts as empty, and empty payloads are compared like others. Of equal payloads all rows with the least
    page id are responses; a row with a null id is a revisit unless all ids of its payload are null. Repeated rows each
    have their record. Other columns are ignored. Digests alone are grouped; the html is shuffled once, by row. A task
    writes under a name of its own and then renames, so a task that runs again replaces its archives.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha1("html"))
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url")))
    least = rows.groupBy("digest").agg(F.count("*").alias("n"), first.alias("least")).filter("n > 1 and least is not null")
    ids = stored(rows.groupBy("page_id", "digest").agg(F.count("*").alias("rows")), "page-digests")
    told = join_by_share(ids, least, "digest").filter("not page_id <=> least.page_id").select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "least")
    marked = rows.join(told, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left").select("page_id", "url", "html", "least.page_id", "least.url")
    marked = marked.toDF("page_id", "url", "html", "least_id", "least_url")

    def write(batches: Iterator[list[list]]) -> Iterator[list[tuple]]:
        where, root = fs.FileSystem.from_uri(folder)
        where.create_dir(root, recursive=True)
        task = TaskContext.get()
        held: list[bytes] = []
        size = n = 0

        def close() -> None:
            nonlocal size, n
            name = f"{root}/part-{task.partitionId():06d}-{n:05d}.warc.zst"
            with where.open_output_stream(f"{name}.{task.taskAttemptId()}.tmp") as out:
                out.write(archive_bytes(held, name.rpartition("/")[2]))
            where.move(f"{name}.{task.taskAttemptId()}.tmp", name)
            held.clear()
            size, n = 0, n + 1

        for columns in batches:
            for page, url, html, *least in zip(*columns):
                held.append(record(page, url, html.encode("utf-8", "replace"), tuple(least) if least[0] is not None else None))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    close()
        if held:
            close()
        yield [(n,)]

    ordered = marked.sortWithinPartitions("page_id", "url")
    return int(map_rows(ordered, write, "n long").agg(F.sum("n")).first()[0] or 0)


RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary, record_id string, date string, refers_to_id string, refers_to_url string, refers_to_date string, archive string, error string"


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all ``*.warc.zst`` files of a folder, whoever wrote them; a frame may hold one record.

    payload_digest is the bare upper-case base32 SHA-1 of a payload that is there, else what the record says. page_id and
    refers_to are extension fields of this module's archives, null elsewhere; refers_to_id, _url and _date are the standard
    ones. A record that fails a check, or an archive that breaks off, gives a row with ``error`` and nulls.
    """
    names = [c.split()[0] for c in RECORD.split(", ")]

    def read(batches: Iterator[list[list]]) -> Iterator[list[tuple]]:
        for paths, contents in batches:
            for path, content in zip(paths, contents):
                rows, size = [], 0
                for row in records(content):
                    row["archive"] = path.rpartition("/")[2]
                    rows.append(tuple(row.get(c) for c in names))
                    size += len(row.get("payload") or b"")
                    if size > 4 << 20:
                        yield rows
                        rows, size = [], 0
                yield rows

    def records(data: bytes) -> Iterator[dict]:
        try:
            for raw in frames(data):
                try:
                    yield parsed(raw)
                except (ValueError, KeyError) as why:
                    yield {"error": str(why)}
        except (ValueError, zstandard.ZstdError, struct.error) as why:
            yield {"error": f"the archive breaks off: {why}"}

    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.warc.zst").load(folder)
    return map_rows(files.select("path", "content"), read, RECORD)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives into the shared folder and read the records back."""
    spark = pages.sparkSession
    folder = shared_folder(spark, "warc")
    if not write_archives(pages, folder):
        return spark.createDataFrame([], RECORD)
    return read_archives(spark, folder).filter("record_type is null or record_type != 'warcinfo'")
