"""Bundles of aggregates that participants publish: assembly, provenance, and the checks at intake."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions.lexicon import Lexicon
from parlance.functions.text import normalize_text
from parlance.operators.checks import guard
from parlance.sources.sinks import rows_of
from parlance.sources.transcripts import nested_strings

# What a bundle must have, its participants' names and its dates.
SECTIONS = ("analysis", "denominators", "tally")
PARTICIPANT, DATE = r"^[a-z0-9][a-z0-9-]{1,30}$", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
SUB_DAY = r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}"


def vocabulary(spark: SparkSession, lexicon: Lexicon) -> DataFrame:
    """Every string and key of a dictionary, normalised, as rows (value)."""
    found: set[str] = set()

    def walk(x) -> None:
        if isinstance(x, str):
            found.update((x, normalize_text(x)))
        elif isinstance(x, dict):
            for k, v in x.items():
                walk(k)
                walk(v)
        elif isinstance(x, (list, tuple)):
            for v in x:
                walk(v)

    walk(vars(lexicon))
    return spark.createDataFrame([(v,) for v in sorted(found)], "value string")


def strings_of(document: dict) -> list[tuple[str, str]]:
    """(path, string) of every string and key of a document."""
    out = []

    def walk(path: str, x) -> None:
        if isinstance(x, str):
            out.append((path, x))
        elif isinstance(x, dict):
            for k, v in x.items():
                out.append((f"{path}.{k}", k))
                walk(f"{path}.{k}", v)
        elif isinstance(x, list):
            for i, v in enumerate(x):
                walk(f"{path}[{i}]", v)

    walk("$", document)
    return out


def offenders(spark: SparkSession, document: dict, lexicon: Lexicon) -> DataFrame:
    """The strings of a document that may not be published."""
    return guard(spark.createDataFrame(strings_of(document), "path string, value string"), vocabulary(spark, lexicon))


def provenance(spark: SparkSession, dictionary: str, checkout: str | None = None) -> dict:
    """Where a bundle comes from: the dictionary file's SHA-256, and the commit of a checkout and whether it has changes.

    Without a checkout, or without git, commit and dirty are None.
    """
    digest = spark.read.format("binaryFile").load(dictionary).select(F.sha2("content", 256)).first()[0]
    told = {"dictionary_sha256": digest, "commit": None, "dirty": None}
    if checkout:
        say = lambda *words: subprocess.run(["git", *words], cwd=checkout, capture_output=True, text=True, timeout=10, check=True).stdout.strip()
        try:
            told |= {"commit": say("rev-parse", "HEAD")[:12], "dirty": bool(say("status", "--porcelain"))}
        except (OSError, subprocess.SubprocessError):
            pass
    return told


def assemble(participant: str, exported: str, provenance: dict, sections: dict[str, DataFrame]) -> dict:
    """A bundle of finished tables; each is a document's size or an error."""
    return {"bundle": 1, "participant": participant, "exported": exported, "provenance": provenance} | {k: rows_of(df) for k, df in sections.items()}


def intake(spark: SparkSession, documents: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(name, error) of bundle files (name, value), one row for each thing that is wrong; without errors, no rows.

    Files are parsed and their strings told in tasks. A file must be a JSON object with all SECTIONS, a participant, a date
    and no time of day; every string and key outside participant, date and provenance must pass the guard.
    """
    told = documents.select("name", "value", F.try_parse_json("value").alias("v"))
    get = lambda path: F.expr(f"try_variant_get(v, '$.{path}', 'string')")
    shape = F.schema_of_variant("v")
    gone = F.array_compact(F.array(*[F.when(F.expr(f"try_variant_get(v, '$.{s}', 'variant') is null"), s) for s in SECTIONS]))
    whole = F.when(F.col("v").isNull(), "not JSON").when(~shape.startswith("OBJECT"), "no object").when(F.size(gone) > 0, F.concat(F.lit("missing: "), F.array_join(gone, ", ")))
    tests = [(~F.coalesce(get("participant"), F.lit("")).rlike(PARTICIPANT), "participant"), (~F.coalesce(get("exported"), F.lit("")).rlike(DATE), "date"), (F.col("value").rlike(SUB_DAY), "time of day")]
    errors = F.when(whole.isNotNull(), F.array(whole)).otherwise(F.array_compact(F.array(*[F.when(t, m) for t, m in tests])))
    plain = told.select("name", F.explode(errors).alias("error"))
    strings = nested_strings(told.filter(whole.isNull()).select("name", "v"), ~F.col("path").rlike(r"^\$\.(participant|exported|provenance)$"))
    refused = guard(strings.select("name", F.regexp_extract("path", r"^\$\.([^.\[]*)", 1).alias("section"), "value"), vocabulary(spark, lexicon))
    return plain.union(refused.select("name", F.concat(F.lit("TEXT GUARD "), F.col("section"), F.lit(": "), F.col("reason")))).distinct()
