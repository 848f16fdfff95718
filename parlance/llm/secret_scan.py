"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every historical version of a path is content-addressed. A blob is scanned once by each version of a rule: the ledger holds
the pairs already scanned, only unseen pairs are scanned, and findings, kept by blob and rule version, are joined back to all
paths. Ledger and findings are Parquet tables in one folder; each run appends to both.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.shared import discard, hinted, join_by_share, shared_folder, stored, whole_text


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` (Java syntax, leftmost, non-overlapping) whose group ``group`` has ``least`` characters.

    ``gate`` matches some part of every text that has such a match.
    """

    kind: str
    version: int
    pattern: str
    gate: str
    group: int = 0
    least: int = 0


#: The base rules, then further ones. Runs of hexadecimal digits and access keys match whole, so their least length can stand in the pattern.
RULES = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"(?i:passw(?:or)?d|secret|token|api_?key)", 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}", r"AKIA[A-Z0-9]{14}"),
    Rule("hex", 1, r"[0-9a-f]{16,}", r"[0-9a-f]{16}"),
    Rule("private_key", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", r"PRIVATE KEY-----"),
    Rule("code_host", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("chat_token", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}", r"xox[abprs]-"),
    Rule("jwt", 1, r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8}"),
)
BASE = ("assign", "access", "hex")
SPAN = "struct<start:long,kind:int,end:long>"


def spans(text: Column, rule: Rule, kind: int) -> Column:
    """The rule's matches in a text as an array of SPAN, offsets in code points.

    The text split at the matches gives the gaps between them; lengths of gaps and matches, summed from the left, give places.
    """
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), 0)
    told = F.arrays_zip(
        F.transform(F.slice(F.split(text, rule.pattern, -1), 1, F.size(hits)), F.length).alias("gap"),
        F.transform(hits, F.length).alias("size"),
        F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), rule.group), F.length).alias("part"),
    )
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + x["size"]
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(x["part"] >= rule.least, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(told, start, step, lambda acc: acc["out"])


def address(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and blob (the SHA-256 of the whole text; null counts as empty) of each version."""
    return documents.select(F.col(id_column).cast("long").alias("doc_id"), F.sha2(whole_text(text_column), 256).alias("blob"))


def rule_key(rule: Rule) -> str:
    return f"{rule.kind}@{rule.version}"


LEDGER, FINDINGS = "blob string, rule string", f"blob string, rule string, spans array<{SPAN}>"


def book(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``ledger`` or ``findings`` of a folder; empty before the first run."""
    columns = LEDGER if name == "ledger" else FINDINGS
    try:
        return spark.read.schema(columns).parquet(f"{folder}/{name}")
    except AnalysisException as why:
        if why.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.range(0).select(F.from_json(F.lit("{}"), columns).alias("row")).select("row.*")


def unseen(documents: DataFrame, versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """blob, text and the array ``rules`` of rule versions that haven't scanned the blob, of each blob with any.

    ``versions`` is :func:`address` of the documents. Blobs meet the ledger by their address; of equal blobs one copy's
    text is read, that of the least id (of blobs with only null ids, each copy's).
    """
    every = F.array(*[F.lit(rule_key(r)) for r in rules])
    done = ledger.filter(F.col("rule").isin([rule_key(r) for r in rules])).groupBy("blob").agg(F.collect_set("rule").alias("done"))
    blobs = versions.groupBy("blob").agg(F.min("doc_id").alias("least"))
    todo = blobs.join(done, "blob", "left").withColumn("rules", F.coalesce(F.array_except(every, "done"), every)).filter(F.size("rules") > 0)
    here = documents.select(F.col(id_column).cast("long").alias("_id"), whole_text(text_column).alias("text"), F.sha2(whole_text(text_column), 256).alias("_blob"))
    same = F.col("_id").eqNullSafe(F.col("least")) & (F.col("_blob") == F.col("blob"))
    return here.join(hinted(todo.select("blob", "least", "rules"), 128 + 32 * len(rules)), same).select("blob", "rules", "text")


def scanned(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, rule and spans of each pair of :func:`unseen` with findings. Texts without any rule's gate are passed over."""
    none = F.array().cast(f"array<{SPAN}>")
    told = [F.struct(F.lit(rule_key(r)).alias("rule"), F.when(F.array_contains("rules", rule_key(r)) & F.col("text").rlike(r.gate), spans(F.col("text"), r, k)).otherwise(none).alias("spans")) for k, r in enumerate(rules)]
    gated = texts.filter(F.col("text").rlike("|".join(f"(?:{r.gate})" for r in rules)))
    return gated.select("blob", F.explode(F.array(*told)).alias("found")).select("blob", "found.*").filter(F.size("spans") > 0)


def scan_secrets(documents: DataFrame, folder: str | None = None, rules: tuple[Rule, ...] = RULES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and spans of each row, by its blob, of the rule versions in ``rules``.

    ``folder`` holds the tables ledger (blob, rule) and findings (blob, rule, spans) of earlier runs; this run scans the
    pairs that are not in the ledger, appends what it finds and then the pairs. A run that is lost in between scans its
    pairs again, which adds equal findings; they count once. Without a folder the books are new ones. Texts of unseen pairs
    are written out before any rule sees them, so that seen texts cost no more than their address.

    Null and empty texts have no spans. Repeated rows each have their row, and null ids stay null. Other columns of
    ``documents`` are ignored. A blob with very many paths meets its findings by a broadcast.
    """
    spark = documents.sparkSession
    folder = folder or shared_folder(spark, "secrets")
    versions = stored(address(documents, id_column, text_column), "versions")
    texts = stored(unseen(documents, versions, book(spark, folder, "ledger"), rules, id_column, text_column), "unseen")
    scanned(texts, rules).dropDuplicates(["blob", "rule"]).write.mode("append").parquet(f"{folder}/findings")
    texts.select("blob", F.explode("rules").alias("rule")).distinct().write.mode("append").parquet(f"{folder}/ledger")
    discard(texts)
    kinds = {rule_key(r): k for k, r in enumerate(rules)}
    found = book(spark, folder, "findings").filter(F.col("rule").isin(list(kinds)))
    by_blob = found.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))
    joined = join_by_share(versions, stored(by_blob, "by-blob"), "blob")
    return joined.select("doc_id", F.coalesce("spans", F.array().cast(f"array<{SPAN}>")).alias("spans"))


def secret_digest(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The counts and span digests of :func:`scan_secrets`'s rows; spans by start, then kind as listed."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    ordered = F.array_sort("spans")
    said = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", F.element_at(kinds, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = [k for k, r in enumerate(rules) if r.kind in BASE]
    # a lambda's second parameter, even one with a default, would be the place in the array
    of_kind = lambda k: F.filter("spans", lambda x: x["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{rules[k].kind}") for k in base]
    return found.select("doc_id", *counts, F.sha2(said(F.filter(ordered, lambda x: x["kind"].isin(base))), 256).alias("base_sha256"), said(ordered).alias("spans"))
