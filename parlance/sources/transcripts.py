"""Transcripts: JSON lines under <machine>/<root>/<project>/<session>.jsonl, to the tables files and messages, and other files.

Null, blank, malformed and non-object lines give no message; entries other than user and assistant ones are left out, all
others are kept (filters belong to queries).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parlance.functions.text import collapse, fingerprint, strip_wrappers
from parlance.sources.scratch import hinted, settled

#: The last four parts of a path.
PARTS = ("machine_id", "root_slug", "project", "session")
INVENTORY = "machine_id string, root string, relpath string, bytes long"
LABELS = "instructions string, records array<struct<n:int,msg_fingerprint:string,detector:string,did_it:string>>"


def path_columns(path: Column, root: str) -> dict[str, Column]:
    """relpath and its parts under ``root``: root_slug only from three parts on, project only from four on."""
    rel = F.regexp_replace(path, r"^.*?" + "\\Q" + root.rstrip("/") + "\\E" + "/", "")
    parts = F.split(rel, "/")
    n = F.size(parts)
    return {
        "relpath": rel, "machine_id": parts[0], "root_slug": F.when(n > 2, F.get(parts, F.lit(1))).otherwise(""),
        "project": F.when(n > 3, F.get(parts, F.lit(2))).otherwise(""), "session": F.regexp_replace(F.element_at(parts, -1), r"\.jsonl$", ""),
        "is_subagent": F.array_contains(parts, "subagents"),
    }


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """files: file_id, the path's parts, bytes, sha256. AppleDouble files are skipped, and so are empty ones, which Spark doesn't read.

    file_id is the path below ``root``: it sorts as a rank of paths does and needs no numbering of all files.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").load(root)
    raw = raw.filter(~F.element_at(F.split("path", "/"), -1).startswith("._"))
    told = raw.select(F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), *[c.alias(k) for k, c in path_columns(F.col("path"), root).items()])
    return told.withColumn("file_id", F.col("relpath"))


def held_files(spark: SparkSession, root: str) -> DataFrame:
    """(machine_id, root_slug, relpath, bytes) of the transcripts held below <machine>/<root>/, relpath being what is below those; no content is read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").load(root).select("path", "length")
    parts = F.split(path_columns(F.col("path"), root)["relpath"], "/")
    told = raw.select(F.get(parts, F.lit(0)).alias("machine_id"), F.get(parts, F.lit(1)).alias("root_slug"), F.array_join(F.slice(parts, 3, F.size(parts)), "/").alias("relpath"), F.col("length").alias("bytes"))
    return told.filter("relpath != ''")


def content_text(entry: str = "v") -> Column:
    """The prose of a parsed entry: a string, or the text blocks of a list joined by line ends; wrappers are stripped."""
    blocks = F.expr(f"try_variant_get({entry}, '$.message.content', 'array<struct<type:string,text:string>>')")
    plain = F.expr(f"case when schema_of_variant(try_variant_get({entry}, '$.message.content', 'variant')) = 'STRING' then try_variant_get({entry}, '$.message.content', 'string') end")
    texts = F.filter(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), lambda t: t.isNotNull() & (t != ""))
    return strip_wrappers(F.coalesce(F.array_join(texts, "\n"), plain, F.lit("")))


def messages_of(lines: DataFrame) -> DataFrame:
    """messages from lines (file_id, line_no, value): typed columns; text is collapsed, null if the entry has no prose."""
    parsed = lines.withColumn("v", F.try_parse_json("value"))
    get = lambda path, kind="string": F.expr(f"try_variant_get(v, '$.{path}', '{kind}')")
    flag = lambda path: F.coalesce(get(path, "boolean"), F.lit(False))
    kept = parsed.filter(get("type").isin("user", "assistant"))
    text = collapse(content_text())
    told = kept.select(
        "file_id", "line_no", get("uuid").alias("uuid"), get("parentUuid").alias("parent_uuid"), fingerprint(get("uuid")).alias("fingerprint"),
        get("type").alias("side"), get("timestamp").alias("ts"), get("message.model").alias("model"), flag("isSidechain").alias("is_sidechain"),
        flag("isCompactSummary").alias("is_compact"), flag("isMeta").alias("is_meta"), flag("isVisibleInTranscriptOnly").alias("is_visible_only"), text.alias("text"),
    )
    return told.withColumns({"has_text": F.col("text") != "", "text_len": F.length("text"), "text": F.when(F.col("text") != "", F.col("text"))})


def read_lines(spark: SparkSession, root: str) -> DataFrame:
    """(path, line_no, value) of every line of the transcripts under ``root``, from 1, blank ones included. AppleDouble files are skipped.

    Files of any size: Spark reads them in blocks, of which each row tells the first byte; lines are counted within blocks,
    then over the blocks of a file, so that no file is read whole and nothing but a row for each block is shuffled.
    """
    raw = spark.read.text(root, recursiveFileLookup=True, pathGlobFilter="*.jsonl")
    lines = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    lines = lines.filter(~F.element_at(F.split("path", "/"), -1).startswith("._"))
    blocks = lines.groupBy("path", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = hinted(blocks.select("path", "block", "first", before.alias("before")), 512)
    return lines.join(placed, ["path", "block"]).select("path", (F.col("id") - F.col("first") + F.col("before") + 1).alias("line_no"), "value")


def read_messages(spark: SparkSession, root: str, files: DataFrame | None = None) -> DataFrame:
    """messages of all transcripts under ``root``, or of those in ``files`` alone. AppleDouble files are skipped.

    A file's id is its path. Files may have any size, see :func:`read_lines`.
    """
    lines = read_lines(spark, root)
    lines = lines.select(path_columns(F.col("path"), root)["relpath"].alias("file_id"), "line_no", "value").filter(F.trim("value") != "")
    if files is not None:
        lines = lines.join(hinted(files.select("file_id"), 512), "file_id", "left_semi")
    return messages_of(lines)


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Lines machine|root|relpath|bytes; others are dropped."""
    parts = F.split("value", r"\|", -1)
    told = spark.read.text(path).filter((F.size(parts) == 4) & F.get(parts, F.lit(3)).rlike("^[0-9]+$"))
    return told.select(*[F.get(parts, F.lit(i)).alias(c) for i, c in enumerate(("machine_id", "root", "relpath"))], F.get(parts, F.lit(3)).cast("long").alias("bytes"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """The records of label files: n, msg_fingerprint, detector, did_it."""
    return spark.read.schema(LABELS).json(path, multiLine=True).select(F.explode("records").alias("r")).select("r.*")


def nested_strings(documents: DataFrame, keep: Column | None = None) -> DataFrame:
    """(name, path, value) of every string of the variants ``documents`` (name, v), and of every key: keys have the path of what they name.

    Level by level: objects and lists are opened until none is left, so a job is as long as the deepest document is deep, and
    no document is walked on the driver. ``keep``, a condition on name and path, leaves out what is not to be opened.
    """
    spark = documents.sparkSession
    level = settled(documents.select("name", F.lit("$").alias("path"), F.to_json("v").alias("json")), "documents")
    out = None
    while True:
        parsed = level.withColumn("v", F.parse_json("json")).withColumn("kind", F.schema_of_variant("v"))
        told = parsed.filter("kind = 'STRING'").select("name", "path", F.expr("variant_get(v, '$', 'string')").alias("value"))
        opened = parsed.filter("kind like 'OBJECT%' or kind like 'ARRAY%'").select("name", "path", "v").lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
        place = F.when(F.col("key").isNull(), F.concat("path", F.lit("["), "pos", F.lit("]"))).otherwise(F.concat("path", F.lit("."), "key"))
        below = opened.select("name", place.alias("path"), "key", F.to_json("value").alias("json"))
        below = settled(below if keep is None else below.filter(keep), "documents")
        keys = below.filter("key is not null").select("name", "path", F.col("key").alias("value"))
        out = told.unionByName(keys) if out is None else out.unionByName(told).unionByName(keys)
        if not below.limit(1).count():
            return out
        level = below.select("name", "path", "json")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(name, value) of the files under ``path``, each a document of its own."""
    return spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("name"), "value")


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """(name, path, value) of every string and key of every bundle file, escapes decoded; files that aren't JSON have none."""
    raw = read_documents(spark, path).select("name", F.try_parse_json("value").alias("v"))
    return nested_strings(raw.filter("v is not null"))
