"""Line dedup over overlapping three-line windows.

Windows are runs of three consecutive lines that hold more than white space; blank lines in between don't count. A window
found more than once in the corpus stays where it comes first, in order of doc_id (null first), the text's digest and line;
its later occurrences are removed, overlapping ones together, blank lines between their lines included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.shared import HOT_KEYS, discard, fresh, hinted, stored, whole_text

WIDTH = 3
#: The white space trimmed off a line before it is hashed.
BLANKS = " \t\r\x0b\x0c"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def solid_lines(text: Column) -> Column:
    """The lines with more than white space, trimmed, and where they are."""
    lines = F.transform(lines_of(text), lambda x, i: F.struct(i.alias("at"), F.trim(x, F.lit(BLANKS)).alias("line")))
    return F.filter(lines, lambda x: x["line"] != "")


def windows(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """doc_id, version (a digest of the text), number within its text, first and last line (all from 0) and hash of each window."""
    text = whole_text(text_column)
    full = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.md5(text).alias("version"), solid_lines(text).alias("lines"))
    runs = F.transform(
        F.sequence(F.lit(1), F.size("lines") - (WIDTH - 1)),
        lambda i: F.struct(
            F.element_at("lines", i)["at"].alias("first"), F.element_at("lines", i + (WIDTH - 1))["at"].alias("last"),
            F.md5(F.array_join(F.transform(F.slice("lines", i, WIDTH), lambda x: x["line"]), "\n")).alias("hash"),
        ),
    )
    return full.filter(F.size("lines") >= WIDTH).select("doc_id", "version", F.posexplode(runs).alias("number", "w")).select("doc_id", "version", "number", "w.*")


def removals(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """(gone, twins): doc_id, version and the line ranges ``covered`` to remove of the first such document; doc_id and version that several rows have.

    Windows in a large share of all documents meet their first occurrence by a broadcast, so none of them is one task.
    """
    found = stored(windows(documents, id_column, text_column), "windows")
    counted = found.groupBy("hash").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "version", "first", "last")).alias("origin"))
    repeated = stored(counted.filter("n > 1"), "repeated")
    hot = F.col("n") * HOT_KEYS >= found.count()  # no more than HOT_KEYS windows have so large a share
    few = F.broadcast(repeated.filter(hot).select("hash", "origin"))
    met = found.join(few, "hash").unionByName(found.join(few, "hash", "left_anti").join(repeated.filter(~hot).select("hash", "origin"), "hash"))
    own = F.col("doc_id").eqNullSafe(F.col("origin.doc_id")) & (F.col("version") == F.col("origin.version"))
    later = met.filter(~own | (F.col("first") > F.col("origin.last")))
    gone = stored(later.groupBy("doc_id", "version").agg(F.collect_set(F.struct("first", "last")).alias("covered")), "removals")
    twins = stored(found.filter("number = 0").groupBy("doc_id", "version").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id", "version"), "twins")
    discard(found, repeated)
    return gone, twins


def dedup_lines(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``documents`` with each text less its removed lines, and the columns n_lines and n_removed.

    All rows and columns stay (columns named n_lines and n_removed are replaced); a text may become empty. Null texts stay
    null, with 0 lines. Texts with fewer than three non-blank lines have no window. An occurrence that overlaps the first
    one in the same document is no later one, so a line's last copy never goes. Rows are documents of their own, whatever
    their ids: of texts with one id, or without any, the one with the least digest comes first, and of rows equal in both
    one, no matter which. Texts move only if the ranges to remove are too many to broadcast, and those of rows equal in both.
    """
    text = whole_text(text_column)
    ids, version, gone_id, gone_version, covered, copy, rank, least = fresh(documents, "id", "version", "gone_id", "gone_version", "covered", "copy", "rank", "least")
    gone, twins = removals(documents, id_column, text_column)
    hit = F.col(id_column).cast("long").eqNullSafe(F.col(gone_id)) & (F.md5(text) == F.col(gone_version))
    if twins.limit(1).count():
        keys = hinted(twins.withColumnsRenamed({"doc_id": gone_id, "version": gone_version}), 64)
        same = stored(documents.join(keys, hit).withColumnsRenamed({gone_id: ids, gone_version: version}).withColumn(rank, F.monotonically_increasing_id()), "same-rows")
        first = same.groupBy(F.col(ids).alias(gone_id), F.col(version).alias(gone_version)).agg(F.min(rank).alias(least))
        told = same.join(hinted(first), F.col(ids).eqNullSafe(F.col(gone_id)) & (F.col(version) == F.col(gone_version)))
        told = told.withColumn(copy, F.col(rank) != F.col(least)).select(*documents.columns, copy)
        documents = documents.join(keys, hit, "left_anti").withColumn(copy, F.lit(False)).unionByName(told)
    else:
        documents = documents.withColumn(copy, F.lit(False))
    gone = gone.withColumnsRenamed({"doc_id": gone_id, "version": gone_version, "covered": covered})
    joined = documents.join(hinted(gone, 64 + 16 * F.size(covered)), hit, "left")
    n = F.when(F.col(text_column).isNull(), 0).otherwise(F.size(lines_of(F.col(text_column))))
    ranges = F.array_distinct(F.flatten(F.transform(covered, lambda x: F.sequence(x["first"], x["last"]))))
    # every window of a later row is a repeat, and they cover all from its first to its last full line
    solid = F.transform(solid_lines(text), lambda x: x["at"])
    places = F.when(F.col(copy), F.sequence(F.array_min(solid), F.array_max(solid))).otherwise(ranges)
    lines = lines_of(F.col(text_column))
    rest = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), places), lambda i: F.get(lines, i))
    cut = F.col(copy) | F.col(covered).isNotNull()
    told = {"n_lines": n.cast("long"), "n_removed": F.when(cut, F.size(places)).otherwise(0).cast("long"), text_column: F.when(cut, F.array_join(rest, "\n")).otherwise(F.col(text_column))}
    return joined.withColumns(told).drop(gone_id, gone_version, covered, copy)


SQL = r"""
with docs as (select doc_id, text, md5(coalesce(text, '')) as version, str_split(coalesce(text, ''), chr(10)) as lines from documents),
ranked as (select row_number() over (order by doc_id nulls first, version) as rid, doc_id, text, lines from docs),
line as (select rid, unnest(lines) as raw, generate_subscripts(lines, 1) - 1 as pos from ranked),
solid as (select rid, pos, ltrim(rtrim(raw, b), b) as line from line, (select chr(32) || chr(9) || chr(13) || chr(11) || chr(12) as b)),
win as (
  select rid, pos as first, lead(pos, 2) over w as last,
    line || chr(10) || lead(line, 1) over w || chr(10) || lead(line, 2) over w as body
  from solid where line <> '' window w as (partition by rid order by pos)),
wins as (select * from win where last is not null),
origin as (
  select body, count(*) as n, min(struct_pack(d := rid, f := first, l := last)) as o from wins group by body having count(*) > 1),
later as (select rid, first, last from wins join origin using (body) where rid <> o.d or first > o.l),
gone as (select distinct rid, unnest(generate_series(first, last)) as pos from later),
rest as (
  select l.rid, string_agg(raw, chr(10) order by l.pos) filter (where g.pos is null) as text, count(g.pos) as n_removed, count(*) as n_lines
  from line l left join gone g on l.rid = g.rid and l.pos = g.pos group by all)
select d.doc_id, case when d.text is null then 0 else n_lines end as n_lines, n_removed, md5(coalesce(r.text, '')) as text_md5, case when d.text is null then null else coalesce(r.text, '') end as text
from ranked d join rest r using (rid)
"""
