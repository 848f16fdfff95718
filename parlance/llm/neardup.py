"""Near duplicates by DartMinHash.

A document is a weighted set: its runs of five words, each weighing as often as it occurs. Every element owns regions of
(weight) x (rank), into which darts fall at unit density, their places given by hashes alone. A document receives the
darts under its weights; of those with a rank under a bound set by its total weight (enough darts for all coordinates) it
keeps the earliest per coordinate. Two documents agree in a coordinate with probability equal to
their weighted Jaccard similarity. Coordinates are joined in bands; what meets in a band is verified exactly.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm import hashing as H
from parlance.llm.shared import discard, fresh, hinted, join_by_share, slices, stored, whole_text, with_small

WIDTH = 5
LEAST_SIMILARITY = 0.8
#: Coordinates are BANDS x BAND_ROWS: a pair at the least similarity misses every band with probability 3e-6.
BANDS, BAND_ROWS = 24, 4
#: One-bit coordinates that pairs are filtered by before their texts are read. Texts at the least similarity differ in 102 of
#: 1024 on average; more than MOST_UNEQUAL are 4.5 standard deviations away, a probability of 5e-6.
FILTER_BITS, MOST_UNEQUAL = 1024, 146
#: Texts whose darts for FILTER_BITS coordinates are worked out at once, and pairs of texts that are Python objects at once.
FILTER_ROWS, PAIR_ROWS = 64, 64
FILTER = [f"w{i}" for i in range(FILTER_BITS // 64)]
#: Strips that a region of weight from one power of two to the next is cut into, at most.
STRIPS = 64
#: Shingles that a task remembers while it compares texts.
HELD_SHINGLES = 1_000_000
#: The band keys of a document in 32 bits, to tell in which band a pair meets first.
SHORT_KEYS = [f"k{i}" for i in range(BANDS)]
#: Links for each task that writes a table of :func:`components`.
TASK_EDGES = 100_000
#: In turn t the documents of the largest bucket are compared with about SPREAD ** t of them, so that few turns cover any size.
SPREAD = 8


def regions(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The regions of weight that elements reach into: (element, number of the region, low, width).

    Regions are [0, 1), then strips of [1, 2), [2, 4), [4, 8) and so on, at most STRIPS of each, so that an element has no
    more of them than some dozens of times the logarithm of its weight. Region 0 of all elements comes first, in their order.
    """
    n = len(weights)
    out = [(np.arange(n), np.zeros(n, np.int64), np.zeros(n), np.ones(n))]
    heavy, low, number = np.flatnonzero(weights > 1), 1.0, 1
    while len(heavy):
        strips = int(min(low, STRIPS))
        width = low / strips
        element, strip = np.repeat(heavy, strips), np.tile(np.arange(strips), len(heavy))
        reached = low + strip * width < weights[element]
        element, strip = element[reached], strip[reached]
        out.append((element, number + strip, low + strip * width, np.full(len(strip), width)))
        low, number = 2 * low, number + strips
        heavy = heavy[weights[heavy] > low]
    return tuple(np.concatenate(x) for x in zip(*out))


def darts(elements: np.ndarray, weights: np.ndarray, rows: np.ndarray, n_rows: int, k: int) -> np.ndarray:
    """The hash of the earliest dart for each row and coordinate; 0 throughout for rows without elements.

    ``elements[i]`` weighs ``weights[i]``, any number above 0, in ``rows[i]``. The darts of a region arrive at ranks that are sums
    of hashed exponential steps, as many in a unit of rank as the region is wide, and each lands at a hashed weight in it;
    those under the element's weight are the row's, so a heavier element receives all darts of a lighter one. A row has as
    many darts under its bound whatever its weights.
    """
    kept = np.zeros((n_rows, k), H.U)
    element, number, low, width = regions(weights)
    salts = elements[element]
    salts[len(elements) :] += number[len(elements) :].astype(H.U) * H.BASE
    salts = H.mix(H.mix(salts) + H.BASE)  # of the first dart of each region
    owner, first = rows[element], unit(salts)
    covered = (weights[element] - low) / width  # the share of the region under the element's weight, 1 or more: all of it
    partly, wide = covered < 1, bool((width != 1).any())
    parts = bool(partly.any())
    total = np.bincount(rows, weights, minlength=n_rows)
    bound = np.divide(k * (np.log(k) + 3.0), total, out=np.zeros(n_rows), where=total > 0)
    todo = total > 0
    while todo.any():
        # most regions have no dart under a low bound, which their first hash tells before its step is worked out
        limit = np.where(todo, bound, -1.0)[owner]
        here = np.flatnonzero(first < -np.expm1(-limit * width))
        salt, at, most, rank = salts[here], owner[here], limit[here], np.zeros(len(here))
        got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(here):
            step = np.log1p(-unit(salt))
            rank = rank - (step / width[here] if wide else step)
            near = rank < most
            here, at, salt, rank, most = here[near], at[near], salt[near], rank[near], most[near]
            got.append((at, salt, rank))
            if parts and len(some := np.flatnonzero(partly[here])):
                out = np.ones(len(here), bool)
                out[some] = unit(H.mix(salt[some] ^ H.BASE)) < covered[here[some]]
                got[-1] = (at[out], salt[out], rank[out])
            salt = H.mix(salt + H.BASE)
        at, salt, rank = (np.concatenate(x) for x in zip(*got)) if got else (np.zeros(0, np.int64), np.zeros(0, H.U), np.zeros(0))
        cell = at * k + (H.mix(salt ^ H.STEP) % H.U(k)).astype(np.int64)
        earliest = np.full(n_rows * k, np.inf)
        np.minimum.at(earliest, cell, rank)
        kept_here = rank == earliest[cell]
        sketch = np.zeros(n_rows * k, H.U)
        sketch[cell[kept_here]] = salt[kept_here] | H.U(1)
        sketch = sketch.reshape(n_rows, k)
        full = todo & (sketch != 0).all(1)
        kept[full] = sketch[full]
        todo &= ~full
        bound = bound * 2
    return kept


def unit(salt: np.ndarray) -> np.ndarray:
    """Hashes as numbers from 0 up to 1."""
    return (salt >> H.U(11)).astype(np.float64) * 2.0**-53


def band_keys(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """The keys of all bands, for each row of a chunk of texts; 0 for rows without words."""
    n = len(offsets) - 1
    elements, rows = H.shingles(*H.words(offsets, data), WIDTH, n)
    sketch = darts(*H.counted(elements, rows), n, BANDS * BAND_ROWS).reshape(n, BANDS, BAND_ROWS)
    out = np.zeros((n, BANDS), H.U)
    for j in range(BAND_ROWS):
        out = H.mix(out + sketch[:, :, j])
    return np.where(sketch[:, :, 0] == 0, H.U(0), out)


def with_digests(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """doc_id, text (null: empty) and its digest of 128 bits; texts with equal digests count as equal."""
    texts = documents.select(F.col(id_column).cast("long").alias("doc_id"), whole_text(text_column).alias("text"))
    return texts.withColumn("digest", F.unhex(F.md5("text")))


def sketches(texts: DataFrame) -> DataFrame:
    """doc_id, digest and the band keys (null for texts without words) of each row of :func:`with_digests`."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys = np.concatenate([band_keys(o, d) for _, o, d in H.chunks(batch.column(2))] or [np.zeros((0, BANDS), H.U)])
            lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel().view(np.int64)), BANDS).cast(pa.list_(pa.int64()))
            wordless = pa.array((keys == 0).all(1)) if len(keys) else pa.array([], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.compute.if_else(wordless, None, lists)], names=["doc_id", "digest", "bands"])

    return texts.select("doc_id", "digest", "text").mapInArrow(scan, "doc_id long, digest binary, bands array<long>")


def shingle_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    elements, _ = H.shingles(*H.words(np.array([0, len(data)]), data), WIDTH, 1)
    return np.unique(elements, return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sets of counted shingles; 0 if both are empty."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / max(int(a[1].sum() + b[1].sum()) - both, 1)


def with_filters(texts: DataFrame) -> DataFrame:
    """``texts`` (node, text) with their weight and the FILTER words of their one-bit coordinates."""
    k, names = FILTER_BITS, ["node", "text", "weight", *FILTER]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, FILTER_ROWS):
            weights, bits = [], []
            for _, offsets, data in H.chunks(batch.column(1)):
                elements, rows = H.shingles(*H.words(offsets, data), WIDTH, len(offsets) - 1)
                sketch = darts(*H.counted(elements, rows), len(offsets) - 1, k)
                weights.append(np.bincount(rows, minlength=len(offsets) - 1))
                bits.append(np.packbits((sketch >> H.U(40) & H.U(1)).astype(bool), axis=1).view(np.int64))
            if bits:
                words = np.concatenate(bits)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(weights)), *map(pa.array, words.T.copy())], names=names)

    return texts.mapInArrow(scan, "node long, text string, weight long, " + ", ".join(f"{w} long" for w in FILTER))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(to_a, to_b) of those of ``pairs`` (a, b, to_a, to_b) whose texts are at least LEAST_SIMILARITY alike."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        held = 0

        def of(doc: int, text: str) -> tuple[np.ndarray, np.ndarray]:
            nonlocal held
            if doc not in counted:
                if held > HELD_SHINGLES:
                    counted.clear()
                    held = 0
                counted[doc] = shingle_counts(text)
                held += len(counted[doc][0])
            return counted[doc]

        for batch in slices(batches, PAIR_ROWS):
            told = zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b")))
            kept = pa.array([similarity(of(a, x), of(b, y)) >= LEAST_SIMILARITY for a, b, x, y in told], pa.bool_())
            yield batch.select(["to_a", "to_b"]).filter(kept)

    a, b = (texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "to_a", "to_b", "text_a", "text_b").mapInArrow(scan, "to_a long, to_b long")


def proposed(entries: DataFrame, turn: int) -> DataFrame:
    """The pairs (a, b, to_a, to_b) that a turn compares: b is a centre of a bucket that holds a, their labels differ.

    In turn 0 a bucket's centre is the document with the most company in all its buckets, which is the original of many
    copies. In later turns all documents of that turn are centres; documents of earlier turns have been compared already.
    A pair is proposed in the first band where it meets, and left out, within the join, if its weights or FILTER words
    tell that it is less alike than LEAST_SIMILARITY. Which band is the first is told by 32 bits of the keys: a chance match
    in an earlier band, which hides the meeting, has a probability of 6e-9 a pair (the bands themselves miss 3e-6 at 0.8).
    """
    kept = ["node", "label", "weight", "turn", *FILTER, *SHORT_KEYS]
    if turn:
        centres = entries.filter(F.col("turn") == turn).select("band", "key", F.struct(*kept).alias("c"))
        once = F.expr("turn > c.turn or node > c.node")
    else:
        order = F.struct("company", (-F.col("node")).alias("first"))
        centres = entries.groupBy("band", "key").agg(F.max_by(F.struct(*kept), order).alias("c"))
        once = F.expr("node != c.node")
    unequal = " + ".join(f"bit_count({w} ^ c.{w})" for w in FILTER)
    alike = F.expr(f"least(weight, c.weight) >= {LEAST_SIMILARITY} * greatest(weight, c.weight) and {unequal} <= {MOST_UNEQUAL}")
    meets = F.expr("e.band = case " + " ".join(f"when {k} = c.{k} then {i}" for i, k in enumerate(SHORT_KEYS)) + " end")
    on = (F.col("e.band") == F.col("k.band")) & (F.col("e.key") == F.col("k.key")) & once & F.expr("label != c.label") & alike
    pairs = entries.alias("e").join(centres.alias("k"), on & meets if turn else on)
    pairs = pairs.select(F.col("node").alias("a"), F.col("c.node").alias("b"), F.col("label").alias("to_a"), F.col("c.label").alias("to_b"))
    return pairs if turn else pairs.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node that each node of ``edges`` (a, b) is connected with.

    Every round each node takes the least label among its own and its neighbours', then that label's own label; rounds
    are written to the shared folder and end when no label changes. Tables of few rows are written by few tasks, and meet
    by a broadcast, so that a round over some thousand links is no thousand tasks.
    """
    tasks = 1 + edges.count() // TASK_EDGES
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct().coalesce(tasks), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")).coalesce(tasks), "labels")
    while True:
        known = hinted(labels, 32)
        near = both.join(known, both["b"] == known["node"]).select(F.col("a").alias("node"), "label", F.lit(None).cast("long").alias("before"))
        own = labels.select("node", "label", F.col("label").alias("before"))
        lower = near.union(own).groupBy("node").agg(F.min("label").alias("low"), F.max("before").alias("before"))
        jump = known.select(F.col("node").alias("low"), "label")
        step = stored(lower.join(jump, "low").select("node", "label", "before").coalesce(tasks), "labels")
        discard(labels)
        labels = step.select("node", "label")
        labels.settled_at = step.settled_at
        if not step.filter("label < before").limit(1).count():
            discard(both)
            return labels


def links(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, label): of each text that is linked with one of a lesser node, the least node of its class.

    In each turn the texts of each bucket of each band are compared with that turn's texts in the bucket, as long as it holds
    several classes. Every text has its turn, by a hash of its node, and later turns have more of them. So every pair of a
    bucket is compared once unless its texts are in one class by then or their sketches rule it out, and pairs within a
    class are never listed. ``nodes`` has node, digest, rep and bands; ``texts`` is :func:`with_digests`.
    """
    entries = nodes.filter("bands is not null").select("node", F.posexplode("bands").alias("band", "key"))
    shared = entries.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1")
    buckets = stored(entries.join(shared, ["band", "key"]), "buckets")
    company = buckets.groupBy("node").agg(F.sum("n").alias("company"))
    found = nodes.join(company.select("node"), "node", "left_semi").select("node", F.col("digest").alias("_digest"), "rep")
    same = F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("digest") == F.col("_digest"))
    compared = stored(with_filters(texts.join(hinted(found), same).select("node", "text").dropDuplicates(["node"])), "compared")

    largest = buckets.agg(F.max("n")).first()[0] or 0
    turns = next(t for t in itertools.count(1) if SPREAD**t >= largest)
    place, turn_of = F.pmod(F.xxhash64("node"), F.lit(1 << 30)) * F.lit(largest), F.lit(turns)
    for t in range(turns - 1, 0, -1):
        turn_of = F.when(place < SPREAD**t << 30, t).otherwise(turn_of)
    short = [F.shiftright(F.col("bands")[i], 32).cast("int").alias(k) for i, k in enumerate(SHORT_KEYS)]
    known = company.join(compared.drop("text"), "node").join(nodes.select("node", *short), "node")
    entries = buckets.drop("n").join(known, "node").withColumns({"label": F.col("node"), "turn": turn_of})
    merges: list[DataFrame] = []
    before: list[DataFrame] = []
    for turn in range(turns + 1):
        entries = stored(entries, "open")
        discard(*before)
        before = [entries]
        if not entries.limit(1).count():
            break
        pairs = stored(verified(proposed(entries, turn), compared), "links")
        if pairs.limit(1).count():
            merges.append(components(pairs.toDF("a", "b")).select(F.col("node").alias("old"), F.col("label").alias("new")))
            entries = entries.join(merges[-1], F.col("label") == F.col("old"), "left").withColumn("label", F.coalesce("new", "label")).drop("old", "new")
        discard(pairs)
        entries = entries.filter(F.col("turn") > turn)
        several = entries.groupBy("band", "key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
        entries = entries.join(several.select("band", "key"), ["band", "key"], "left_semi")
    labels = company.select("node", F.col("node").alias("label"))
    for merge in merges:
        labels = labels.join(merge, F.col("label") == F.col("old"), "left").select("node", F.coalesce("new", "label").alias("label"))
    out = stored(labels.filter("label != node"), "linked")
    discard(buckets, compared, *before)
    return out


def classes(documents: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, DataFrame]:
    """(seen, told): doc_id and digest of each row; digest, class_id, and rep (its least id) and whether that row stands for the class.

    A distinct text is a node, whatever its ids; ids come in at the end, when a class gets the least id of its rows.
    """
    texts = with_digests(documents, id_column, text_column)
    seen = stored(sketches(texts), "sketches")
    least = seen.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    nodes = stored(least.withColumn("node", F.monotonically_increasing_id()), "nodes")
    linked = links(nodes, texts)
    named = nodes.select("node", "digest", "rep", F.struct(F.col("rep").isNull(), "rep", "digest").alias("first"))
    merged = linked.union(linked.select("label", "label").distinct())
    best = named.join(merged, "node").groupBy("label").agg(F.min("first").alias("best"))
    told = named.join(merged, "node", "left").join(hinted(best), "label", "left")
    told = told.select("digest", F.coalesce("best", "first").alias("best"), "first")
    told = stored(told.select("digest", F.col("best.rep").alias("class_id"), (F.col("best") == F.col("first")).alias("stands"), F.col("first.rep").alias("rep")), "classes")
    discard(nodes, linked)
    return seen, told


def near_duplicates(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and class_id of each row: the least id among the rows it is linked with, directly or by others.

    Links are equal texts and pairs of texts at least LEAST_SIMILARITY alike. A text with fewer than five words is one
    run of all its words; texts without words, null or empty ones included, are only linked if they are equal (null
    counts as empty). Repeated rows each have their row. An id that repeats with another text links nothing: each text has
    its own class, named by the least id of its rows. Texts whose rows all have null ids are compared like others; a class
    without any id has a null class_id. Other columns are ignored.
    """
    seen, told = classes(documents, id_column, text_column)
    return join_by_share(seen.select("doc_id", "digest"), told.select("digest", "class_id"), "digest").select("doc_id", "class_id")


def one_of_each(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``documents`` with one row of each class: that with the least id (null last), of its rows one.

    All rows have a class, those with null ids and repeated ids too; columns stay as they are.
    """
    seen, told = classes(documents, id_column, text_column)
    digest, rep, n = fresh(documents, "digest", "rep", "n")
    kept = told.filter("stands").select(F.col("digest").alias(digest), F.col("rep").alias(rep))
    chosen = F.col("doc_id").eqNullSafe(F.col(rep)) & (F.col("digest") == F.col(digest))
    kept = stored(seen.join(kept, chosen).groupBy(digest, rep).agg(F.count("*").alias(n)), "kept")
    here = F.col(id_column).cast("long").eqNullSafe(F.col(rep)) & (F.unhex(F.md5(whole_text(text_column))) == F.col(digest))
    single = documents.join(hinted(kept.filter(F.col(n) == 1)), here, "left_semi")
    several = documents.join(hinted(kept.filter(F.col(n) > 1)), here).dropDuplicates([digest, rep]).select(*documents.columns)
    return single.unionAll(several)
