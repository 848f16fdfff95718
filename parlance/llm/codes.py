"""Vector code compression: product codes whose codebooks are found by Yinyang Lloyd.

A vector becomes whole numbers and is cut into parts; each part position has a codebook. In a round every part goes to its
nearest entry, then entries move to the floored mean of their parts. Entries are clustered into groups once, and a part
keeps an upper bound of its distance to its own entry and one lower bound for each group. When entries have moved, bounds
drift with them; only groups whose lower bound fails are scanned, with distances in whole numbers, so ties are told
exactly. Rows and bounds are a table of the shared folder, rewritten once a round; sums follow the parts that moved.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.shared import discard, hinted, join_by_share, slices, stored
from parlance.llm.vectors import complete, floors, lists, matrix

SCALE, PARTS, ENTRIES, ROUNDS, GROUPS = 4096, 8, 16, 6, 4
BLOCK_ROWS = 4096
#: Bounds are floating-point numbers; a group is passed over only if they are further apart than this.
SLACK, RELATIVE_SLACK = 1e-5, 1e-9


def cuts(d: int, parts: int = PARTS) -> list[tuple[int, int]]:
    """Start and end of each part; if the parts can't be equal, the first ones are longer by one."""
    sizes = [d // parts + (p < d % parts) for p in range(parts)]
    return [(sum(sizes[:p]), sum(sizes[: p + 1])) for p in range(parts)]


def bound_of(d: int) -> int:
    """Whole numbers saturate here, so that no squared distance of a part leaves 64 bits."""
    return math.isqrt(2**62 // max(1, -(-d // PARTS))) // 2


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances, (rows, entries)."""
    off = x[:, None, :] - entries[None]
    return np.einsum("mkw,mkw->mk", off, off)


def grouped(entries: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """The group of each entry: a few rounds of clustering from seeds far from each other."""
    e = entries.astype(np.float64)
    seeds = [0] if len(e) else []
    far = lambda at: ((e[:, None] - e[at][None]) ** 2).sum(-1)
    while len(seeds) < min(groups, len(e)):
        seeds.append(int(far(seeds).min(1).argmax()))
    centres, of = e[seeds], np.zeros(len(e), np.int64)
    for _ in range(5):
        of = ((e[:, None] - centres[None]) ** 2).sum(-1).argmin(1) if len(e) else of
        centres = np.array([e[of == g].mean(0) if (of == g).any() else centres[g] for g in range(len(centres))])
    return np.unique(of, return_inverse=True)[1]


@dataclass(frozen=True)
class Codebook:
    """The entries of a part position, their groups, and how far each entry has moved since the round before."""

    entries: np.ndarray
    groups: np.ndarray
    drift: np.ndarray

    @staticmethod
    def of(entries: np.ndarray) -> Codebook:
        return Codebook(entries, grouped(entries), np.zeros(len(entries)))

    @property
    def n_groups(self) -> int:
        return int(self.groups.max()) + 1

    def moved(self, sums: np.ndarray, counts: np.ndarray) -> Codebook:
        """With each entry at the floored mean of its parts; unused ones stay."""
        used = counts > 0
        entries = self.entries.copy()
        entries[used] = np.floor_divide(sums[used], counts[used, None])
        off = entries - self.entries
        return Codebook(entries, self.groups, np.sqrt((off * off).sum(1).astype(np.float64)))

    def assigned(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(entry, upper bound, lower bound by group) of each part, all entries scanned. Of equal distances the lower index wins."""
        squared = distances(x, self.entries)
        own = squared.argmin(1)
        upper = np.sqrt(squared[np.arange(len(x)), own].astype(np.float64))
        rest = np.sqrt(squared.astype(np.float64))
        rest[np.arange(len(x)), own] = np.inf
        lower = np.stack([rest[:, self.groups == g].min(1) for g in range(self.n_groups)], 1)
        return own, upper, lower

    def reassigned(self, x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """As :meth:`assigned`, from the bounds of the round before; and how many distances were computed."""
        widest = np.array([self.drift[self.groups == g].max() for g in range(self.n_groups)])
        own, upper, lower = own.copy(), upper + self.drift[own], np.maximum(lower - widest, 0.0)
        at = np.flatnonzero(lower.min(1) <= upper * (1 + RELATIVE_SLACK) + SLACK)
        off = x[at] - self.entries[own[at]]
        exact = (off * off).sum(1)
        upper[at] = np.sqrt(exact.astype(np.float64))
        scanned = len(at)
        fails = lower[at] <= (upper[at] * (1 + RELATIVE_SLACK) + SLACK)[:, None]
        best, entry = exact.copy(), own[at].copy()
        found = []
        for g in range(self.n_groups):
            rows = np.flatnonzero(fails[:, g])
            members = np.flatnonzero(self.groups == g)
            squared = distances(x[at[rows]], self.entries[members])
            scanned += squared.size
            first = squared.argmin(1) if len(rows) else np.zeros(0, np.int64)
            least, index = squared[np.arange(len(rows)), first], members[first]
            better = (least < best[rows]) | ((least == best[rows]) & (index < entry[rows]))
            best[rows[better]], entry[rows[better]] = least[better], index[better]
            rest = squared.astype(np.float64)
            rest[np.arange(len(rows)), first] = np.inf
            found.append((rows, least, index, rest.min(1) if len(rows) else np.zeros(0)))
        left = entry != own[at]
        # a group that was not scanned now holds the entry that a part has left
        was = self.groups[own[at[left]]]
        lower[at[left], was] = np.minimum(lower[at[left], was], np.sqrt(exact[left].astype(np.float64)))
        for g, (rows, least, index, second) in enumerate(found):
            lower[at[rows], g] = np.sqrt(np.where(index == entry[rows], second, least.astype(np.float64)))
        own[at], upper[at] = entry, np.sqrt(best.astype(np.float64))
        return own, upper, lower, scanned


def changes(x: np.ndarray, before: np.ndarray | None, own: np.ndarray, k: int) -> np.ndarray:
    """Per entry the change in count, then in sums, as (k, 1 + width)."""
    out = np.zeros((k, 1 + x.shape[1]), np.int64)
    ones = np.concatenate([np.ones((len(x), 1), np.int64), x], 1)
    moved = np.ones(len(x), bool) if before is None else own != before
    np.add.at(out, own[moved], ones[moved])
    if before is not None:
        np.subtract.at(out, before[moved], ones[moved])
    return out


def round_of(rows: DataFrame, books: list[Codebook], d: int, label_type: str, first: bool) -> DataFrame:
    """A round of assignments: rows with x, code, bounds and error, and for each task one row that only has ``change``.

    ``rows`` has vec_id, label and vector in the first round, else what the round before gave. ``change`` holds, by part and
    entry, the changes in count and sums, and last the number of distances computed.
    """
    places, bound = cuts(d), bound_of(d)
    n_groups = [b.n_groups for b in books]
    ends = np.cumsum([0, *n_groups])
    schema = f"vec_id long, label {label_type}, x array<long>, code array<tinyint>, upper array<double>, lower array<double>, error long, change array<long>"
    names = ["vec_id", "label", "x", "code", "upper", "lower", "error", "change"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((len(b.entries), 1 + e - s), np.int64) for b, (s, e) in zip(books, places)]
        work, kinds = 0, None
        for batch in slices(batches, BLOCK_ROWS):
            kinds = kinds or batch.column(1).type
            x = floors(matrix(batch.column(2), d), SCALE, bound) if first else np.asarray(batch.column(2).flatten(), np.int64).reshape(-1, d)
            m = len(x)
            code, upper, lower, error = np.zeros((m, PARTS), np.int64), np.zeros((m, PARTS)), np.zeros((m, ends[-1])), np.zeros(m, np.int64)
            if not first:
                was = np.asarray(batch.column(3).flatten(), np.int64).reshape(m, PARTS)
                old_upper, old_lower = matrix(batch.column(4), PARTS), matrix(batch.column(5), int(ends[-1]))
            for p, (book, (s, e)) in enumerate(zip(books, places)):
                part, low = x[:, s:e], slice(ends[p], ends[p + 1])
                if first:
                    code[:, p], upper[:, p], lower[:, low] = book.assigned(part)
                    work += m * len(book.entries)
                else:
                    code[:, p], upper[:, p], lower[:, low], n = book.reassigned(part, was[:, p], old_upper[:, p], old_lower[:, low])
                    work += n
                total[p] += changes(part, None if first else was[:, p], code[:, p], len(book.entries))
                off = part - book.entries[code[:, p]]
                error += (off * off).sum(1)
            told = [lists(x, pa.int64()), lists(code, pa.int8()), lists(upper, pa.float64()), lists(lower, pa.float64()), pa.array(error)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *told, pa.nulls(m, pa.list_(pa.int64()))], names=names)
        if kinds is not None:
            change = np.concatenate([*(t.ravel() for t in total), [work]])
            empty = [pa.nulls(1, k) for k in (pa.int64(), kinds, pa.list_(pa.int64()), pa.list_(pa.int8()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.int64())]
            yield pa.RecordBatch.from_arrays([*empty, pa.array([change.tolist()], pa.list_(pa.int64()))], names=names)

    columns = ["vec_id", "label", "vector"] if first else ["vec_id", "label", "x", "code", "upper", "lower"]
    return rows.select(*columns).mapInArrow(scan, schema)


def summed(state: DataFrame) -> np.ndarray:
    """The tasks' ``change`` added up; its length is a matter of the codebooks alone."""
    each = state.filter("change is not null").select(F.posexplode("change").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v"))
    return np.array([r["v"] for r in each.orderBy("at").collect()], np.int64)


def compressed(embeddings: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", rounds: int = ROUNDS) -> tuple[DataFrame, list[Codebook], list[int]]:
    """(vec_id, label, code array and error of each kept row; the final codebooks; distances computed in each round)."""
    rows, d = complete(embeddings, id_column, vector_column, label_column)
    label_type = rows.schema["label"].dataType.simpleString()
    seeds = rows.select("vec_id", "vector").orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(ENTRIES).collect()
    if not seeds:
        return rows.select("vec_id", "label", F.array().cast("array<tinyint>").alias("code"), F.lit(0).cast("long").alias("error")), [], []
    start = floors(np.array([r["vector"] for r in seeds], np.float64), SCALE, bound_of(d))
    books = [Codebook.of(start[:, s:e]) for s, e in cuts(d)]
    shapes = [(len(b.entries), 1 + b.entries.shape[1]) for b in books]
    totals, work, state = [np.zeros(s, np.int64) for s in shapes], [], rows
    for at in range(rounds + 1):
        step = stored(round_of(state, books, d, label_type, at == 0), "codes")
        if at:
            discard(state)
        change = summed(step)
        work.append(int(change[-1]))
        state = step.filter("change is null")
        state.settled_at = step.settled_at
        if at < rounds:
            split = np.split(change[:-1], np.cumsum([a * b for a, b in shapes])[:-1])
            totals = [t + c.reshape(s) for t, c, s in zip(totals, split, shapes)]
            books = [b.moved(t[:, 1:], t[:, 0]) for b, t in zip(books, totals)]
    return state.select("vec_id", "label", "code", "error"), books, work


def codebooks_digest(books: list[Codebook]) -> str:
    """SHA-256 of all entries in decimal, by part, entry and place."""
    return hashlib.sha256(",".join(str(int(v)) for b in books for v in b.entries.ravel()).encode()).hexdigest()


def compress(embeddings: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each kept row.

    Rows whose vector is null, empty or holds null or non-finite entries, and those of an odd length (see
    :func:`parlance.llm.vectors.complete`), are dropped and count nowhere. Codebooks start from the rows with the least ids;
    of rows with one id the least vector comes first, null ids come last, and with fewer rows there are fewer entries.
    Repeated rows each have their row. Null labels are one label. A length that PARTS doesn't divide makes the first parts
    longer by one. Other columns are ignored.
    """
    coded, books, _ = compressed(embeddings, id_column, vector_column, label_column)
    named = coded.withColumn("_label", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    by_label = named.groupBy("_label").agg(F.sum("error").alias("label_error"))
    code = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c.cast("long")), 2, "0"))), "")
    told = join_by_share(named.select("vec_id", code.alias("code"), "error", "_label"), hinted(by_label), "_label")
    return told.select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def sql(rounds: int = ROUNDS) -> str:
    """The same in SQL, every round by plain distances to all entries."""
    steps = [f"""
kept as materialized (
  select row_number() over () as rid, vec_id, label, list_transform(embedding, lambda c: cast(floor({SCALE} * cast(c as double)) as bigint)) as x
  from embeddings where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
comp as materialized (
  select rid, pos // w as part, pos % w as k, x from (
    select rid, len(x) // {PARTS} as w, unnest(x) as x, generate_subscripts(x, 1) - 1 as pos from kept)),
seeds as (select rid, row_number() over (order by vec_id, x) - 1 as entry from kept order by vec_id, x limit {ENTRIES}),
book0 as materialized (select part, entry, k, x from comp join seeds using (rid))"""]  # fmt: skip
    for r in range(rounds + 1):
        steps.append(f"""near{r} as materialized (
  select rid, part, min(struct_pack(d := d, e := entry)) as n from (
    select c.rid, c.part, b.entry, cast(sum((c.x - b.x) * (c.x - b.x)) as bigint) as d from comp c join book{r} b on c.part = b.part and c.k = b.k group by all)
  group by rid, part)""")
        if r < rounds:
            steps.append(f"""book{r + 1} as materialized (
  select b.part, b.entry, b.k, coalesce(m.x, b.x) as x from book{r} b left join (
    select part, entry, k, cast((s - ((s % n) + n) % n) // n as bigint) as x from (
      select c.part, a.n.e as entry, c.k, cast(sum(c.x) as bigint) as s, count(*) as n from comp c join near{r} a on c.rid = a.rid and c.part = a.part group by all)) m
  on b.part = m.part and b.entry = m.entry and b.k = m.k)""")
    steps.append(f"""coded as (
  select rid, string_agg(printf('%02x', n.e), '' order by part) as code, cast(sum(n.d) as bigint) as error from near{rounds} group by rid)""")
    return "with " + ",\n".join(steps) + f"""
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
  (select sha256(string_agg(cast(x as varchar), ',' order by part, entry, k)) from book{rounds}) as codebooks_sha256
from kept join coded using (rid)"""  # fmt: skip
