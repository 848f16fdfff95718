"""Licence scans by canonical digest: whole texts are normalised, digested and hash-joined to known licences.

Normalising folds case, drops copyright lines and "all rights reserved", unifies equivalent spellings, and turns every run of
punctuation or white space into one blank. What is looked up is an entire text: of the document, and of each of its lines,
which catches licence notices of one line. Complete licences are files in ``licence_texts``, named by SPDX identifier.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.shared import hinted, stored, whole_text

# Lines to drop, and pairs of equivalent spellings (after case folding, as whole words, in this order).
# BARE_LINE is a copyright of names alone, in the line's own case; wrapped text such as "copyright notice" is none.
COPYRIGHT_LINE = r"^[^a-z0-9\n]*(copyright|\(c\)|©)[^\n]*([0-9]{4}|\(c\)|©|yyyy|<year>|\[year\])[^\n]*$"
RESERVED_LINE = r"^[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*$"
BARE_LINE = r"^[^A-Za-z0-9\n]*Copyright( [A-Z][^ .,;:\n]*){1,4}[^A-Za-z0-9\n]*$"
WITHIN = ("licenc", "licens")  # within any word, first of all
SPELLINGS = (
    ("sub license", "sublicense"),
    ("noncommercial", "non commercial"), ("merchantibility", "merchantability"), ("organisation", "organization"), ("favour", "favor"),
    ("honour", "honor"), ("whilst", "while"), ("acknowledgement", "acknowledgment"), ("programme", "program"), ("http", "https"),
)
#: Those that may lie across two lines.
ACROSS = tuple(pair for pair in SPELLINGS if " " in pair[0])

TEXTS = Path(__file__).with_name("licence_texts")
# Notices of one line, by SPDX identifier.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MIT", "SPDX-License-Identifier: MIT"),
)
# The titles under which a text is also published.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"), "ISC": ("ISC License", "The ISC License"), "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD"),
    "Zlib": ("zlib License", "The zlib/libpng License"), "BSD-2-Clause": ("BSD 2-Clause License",), "BSD-3-Clause": ("BSD 3-Clause License", "The BSD License"),
}


def known_texts() -> list[tuple[str, str]]:
    """(licence, text) of all files, with and without their titles, and of the notices."""
    out = []
    for path in sorted(TEXTS.glob("*.txt")):
        name, text = path.stem.partition("+")[0], path.read_text()
        out += [(name, text), *((name, f"{title}\n{text}") for title in TITLES.get(name, ()))]
    return out + list(NOTICES)


def flats(text: Column) -> Column:
    """The lines of a text, normalised: words two blanks apart, so that neighbouring words can both be replaced; empty if a line is dropped.

    What is used more than once is a field of a step's result, since nothing else is kept within a lambda.
    """
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.struct(x.alias("line"), F.lower(x).alias("low")))
    # few lines hold what the patterns look for
    dropped = lambda x: reduce(lambda a, b: a | b, [x["low"].contains(w) for w in ("copyright", "(c)", "©", "all rights reserved")]) & (x["low"].rlike(COPYRIGHT_LINE) | x["low"].rlike(RESERVED_LINE) | x["line"].rlike(BARE_LINE))
    words = F.transform(lines, lambda x: F.when(dropped(x), "").otherwise(F.replace(F.trim(F.regexp_replace(x["low"], r"[^\p{L}\p{N}]+", "  ")), *map(F.lit, WITHIN))))
    # all lines are respelt at once, the line ends standing as words between them
    told = respelt(F.concat(F.lit(" "), F.array_join(words, " \n "), F.lit(" ")), SPELLINGS)
    return F.transform(F.split(told, "\n", -1), lambda x: F.trim(x))


def respelt(text: Column, pairs) -> Column:
    return reduce(lambda t, pair: F.replace(t, F.lit(f" {pair[0].replace(' ', '  ')} "), F.lit(f" {pair[1].replace(' ', '  ')} ")), pairs, text)


def single(text: Column) -> Column:
    return F.replace(text, F.lit("  "), F.lit(" "))


def joined(flats: Column) -> Column:
    """The canonical text of normalised lines: words joined by single blanks."""
    body = F.array_join(F.filter(flats, lambda x: x != ""), "  ")
    return F.trim(single(respelt(F.concat(F.lit(" "), body, F.lit(" ")), ACROSS)))


def canonical(text: Column) -> Column:
    """The normalised text: words joined by single blanks."""
    return joined(flats(text))


def known_digests(spark: SparkSession, known: DataFrame | None = None) -> DataFrame:
    """digest, licence and length (of the canonical text) of the known texts (columns licence, text); equal digests keep the least name."""
    texts = known if known is not None else spark.createDataFrame(known_texts(), "licence string, text string")
    told = texts.filter("licence is not null and text is not null").select("licence", canonical(F.col("text")).alias("canonical")).filter("canonical != ''")
    return told.groupBy(F.sha2("canonical", 256).alias("digest")).agg(F.min("licence").alias("licence"), F.max(F.length("canonical")).alias("length"))


def scan_licences(documents: DataFrame, known: DataFrame | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: doc_id, digest (of the canonical whole text; null if that is empty), licence (of the whole
    text, or null) and notices (the sorted distinct licences that an entire line is, comma-joined; empty if none).

    Null texts count as empty. Repeated rows and null ids stay as they are; other columns are ignored. Each line is
    normalised once, and the whole text is made of its lines. Lines as long as some known text are digested. What is known
    is broadcast after a count, else joined by shuffling; texts aren't shuffled.
    """
    digests = stored(known_digests(documents.sparkSession, known), "known")
    lengths = [r.length for r in digests.select("length").distinct().limit(10_001).collect()]
    fits = (lambda x: F.length(x).isin(lengths)) if len(lengths) <= 10_000 else (lambda x: x != "")
    texts = documents.select(F.col(id_column).cast("long").alias("doc_id"), whole_text(text_column).alias("text"))
    split = texts.select("doc_id", F.md5("text").alias("version"), flats(F.col("text")).alias("lines"))
    split = split.withColumn("body", joined(F.col("lines")))
    lines = F.transform(F.filter(F.transform("lines", lambda x: F.trim(single(x))), fits), lambda x: F.sha2(x, 256))
    told = stored(split.select("doc_id", "version", F.when(F.col("body") != "", F.sha2("body", 256)).alias("digest"), F.array_distinct(lines).alias("lines")), "digests")
    small = hinted(digests.select("digest", "licence"), 256)
    whole = told.select("doc_id", "version", "digest").join(small, "digest", "left")
    hits = told.select("doc_id", "version", F.explode("lines").alias("digest")).join(small, "digest")
    notices = hits.groupBy("doc_id", "version").agg(F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("notices"))
    at = stored(notices.withColumnsRenamed({"doc_id": "_id", "version": "_version"}), "notices")
    met = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("version") == F.col("_version"))
    return whole.join(hinted(at, 128 + F.length("notices")), met, "left").select("doc_id", "digest", "licence", F.coalesce("notices", F.lit("")).alias("notices"))


def canonical_text(text: str) -> str:
    """:func:`canonical` of one text, in plain Python."""
    out = []
    for line in text.split("\n"):
        low = line.lower()
        if not (re.search(COPYRIGHT_LINE, low) or re.search(RESERVED_LINE, low) or re.search(BARE_LINE, line)):
            out += re.sub(r"[\W_]+", " ", low).split()
    told = f" {'  '.join(out)} ".replace(*WITHIN)
    for a, b in SPELLINGS:
        told = told.replace(f" {a.replace(' ', '  ')} ", f" {b.replace(' ', '  ')} ")
    return " ".join(told.split())


def sql() -> str:
    """DuckDB SQL for :func:`scan_licences`. Notices are normalised there; of complete licences it has the digests."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rx = lambda x, pattern, to: f"regexp_replace({x}, {quote(pattern)}, {quote(to)}, 'g')"

    def said(x: str) -> str:
        low = rx(rx(f"lower({rx(x, f'(?m){BARE_LINE}', ' ')})", f"(?m){COPYRIGHT_LINE}", " "), f"(?m){RESERVED_LINE}", " ")
        flat = f"replace(' ' || trim({rx(low, r'[^\p{L}\p{N}]+', '  ')}) || ' ', {quote(WITHIN[0])}, {quote(WITHIN[1])})"
        for a, b in SPELLINGS:
            flat = f"replace({flat}, ' {a.replace(' ', '  ')} ', ' {b.replace(' ', '  ')} ')"
        return f"trim(replace({flat}, '  ', ' '))"

    values = ", ".join(f"({quote(n)}, {quote(t)})" for n, t in NOTICES)
    files = ", ".join(f"({quote(n)}, {quote(hashlib.sha256(canonical_text(t).encode()).hexdigest())})" for n, t in known_texts() if (n, t) not in NOTICES)
    return f"""
with notice(licence, text) as (values {values}),
complete(licence, digest) as (values {files}),
digests as (select digest, min(licence) as licence from (select sha256({said("text")}) as digest, licence from notice union all select digest, licence from complete) group by 1),
texts as (select doc_id, coalesce(text, '') as text, md5(coalesce(text, '')) as version from documents),
body as (select doc_id, version, {said("text")} as body from texts),
line as (select doc_id, version, unnest(str_split(text, chr(10))) as line from (select distinct * from texts)),
hit as (select distinct doc_id, version, licence from (select doc_id, version, sha256({said("line")}) as digest from line) join digests using (digest)),
note as (select doc_id, version, string_agg(licence, ',' order by licence) as notices from hit group by all)
select b.doc_id, case when body <> '' then sha256(body) end as digest, d.licence, coalesce(n.notices, '') as notices
from body b left join digests d on d.digest = case when body <> '' then sha256(body) end
left join note n on n.doc_id is not distinct from b.doc_id and n.version = b.version
"""
