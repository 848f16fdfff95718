"""Cross-entropy difference: every document's loss under a target model less its loss under a background model.

Both are matched bigram models: the same vocabulary (every word seen), places and smoothing, counted over all target
documents and over all documents. A document is scored by what the other documents hold: its own occurrences are taken off
every count of a word, a bigram or a context.

Words are told apart by 64-bit hashes (among 1e8 words some two are alike with a probability of 3e-4). The counts of the
FREQUENT_WORDS most frequent words and of bigrams with about one in FREQUENT_BIGRAMS occurrences are broadcast, and what they
say is added up where the document lies. All other bigrams of a document meet their counts in one shuffle: dealt by the word
if it isn't a frequent one, so that its own counts are sums of the same entries, else by the bigram. Entries travel as packed
arrays of a few thousand documents, and the sums come back to the documents the same way. No count is capped or left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm import hashing as H
from parlance.llm.shared import discard, hinted, slices, stored, texts_of

#: Bounds of what is broadcast: words, and bigrams (those with at least one in FREQUENT_BIGRAMS of all occurrences).
FREQUENT_WORDS, FREQUENT_BIGRAMS = 65_536, 262_144
#: Added to each word's count; weight of the words' shares in a context.
ALPHA, WEIGHT = 0.5, 200.0
#: Words counted, and entries packed, by a task before it hands them on; documents of a flush, whose places must fit 16 bits.
FLUSH_WORDS, FLUSH_ENTRIES, FLUSH_DOCUMENTS = 2_000_000, 1_000_000, 50_000
#: Entries that one bucket of the shuffle should hold, and keys that are counted at once within a flush or a bucket.
BUCKET_ENTRIES, PIECE_KEYS = 2_000_000, 131_072
START = H.U(0x9E3779B97F4A7C15)

WORD, BIGRAM = 0, 1
COUNTS = ("everywhere", "wanted", "everywhere_ends", "wanted_ends")


@dataclass
class Tokens:
    """The words of some documents, in order: hash, the hash before, the document's place, and whether they begin or end it."""

    word: np.ndarray
    before: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    last: np.ndarray

    @property
    def bigram(self) -> np.ndarray:
        return H.mix(self.before) * H.U(3) + self.word


def tokens(texts: pa.Array) -> Iterator[tuple[int, int, Tokens]]:
    """(first row, rows, words) of runs of texts; words are what stands between ASCII white space, in lower case."""
    for at, offsets, data in H.chunks(pc.utf8_lower(texts)):
        word, doc = H.words(offsets, data)
        edge = np.ones(len(word) + 1, bool)
        edge[1:-1] = doc[1:] != doc[:-1]
        first, last = edge[:-1], edge[1:]
        before = np.where(first, START, np.roll(word, 1)) if len(word) else word
        yield at, len(offsets) - 1, Tokens(word, before, doc, first, last)


def counted(keys: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct keys, how often each occurs, and its sums of the weights."""
    distinct, which, n = np.unique(keys, return_inverse=True, return_counts=True)
    return distinct, n, *[np.bincount(which, w, len(distinct)).astype(np.int64) for w in weights]


def pieces(keys: np.ndarray) -> Iterator[np.ndarray]:
    """The places of the keys in parts of about PIECE_KEYS, by their upper bits: equal keys are in one part, lesser ones in earlier parts.

    What is worked out for one part is freed before the next: a worker keeps the memory it had at its peak.
    """
    n = min(-(-len(keys) // PIECE_KEYS), 256)
    share = ((keys >> H.U(56)) * H.U(n) >> H.U(8)).astype(np.uint8)
    for i in range(n):
        yield np.flatnonzero(share == i)


def first_counts(flagged: DataFrame) -> DataFrame:
    """kind, key and COUNTS: of every word, and of bigrams that are frequent in the words a task counts at once."""
    names = ["kind", "key", *COUNTS]

    def told(words: list[np.ndarray], bigrams: list[np.ndarray], targets: list[np.ndarray], lasts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        target, last = np.concatenate(targets), np.concatenate(lasts)
        least = max(2, len(target) / FREQUENT_BIGRAMS)
        for kind, held in ((WORD, words), (BIGRAM, bigrams)):
            keys = np.concatenate(held)
            held.clear()
            for at in pieces(keys):
                t, z = target[at], last[at]
                if kind == WORD:
                    columns = counted(keys[at], t, z, z & t)
                else:
                    pair, many, few = counted(keys[at], t)
                    kept = many >= least
                    columns = (pair[kept], many[kept], few[kept], *np.zeros((2, int(kept.sum())), np.int64))
                columns = [np.full(len(columns[0]), kind, np.int8), *(c.view(np.int64) for c in columns)]
                for i in range(0, len(columns[0]), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 50_000]) for c in columns], names=names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = ([], [], [], []), 0
        for batch in slices(batches):
            flags = np.array(batch.column(2).to_pylist(), bool)
            for at, rows, t in tokens(batch.column(1)):
                for held, x in zip(parts, (t.word, t.bigram, flags[at : at + rows][t.doc], t.last)):
                    held.append(x)
                size += len(t.word)
            if size >= FLUSH_WORDS:
                yield from told(*parts)
                parts, size = ([], [], [], []), 0
        if parts[0]:
            yield from told(*parts)

    counts = flagged.select("doc_id", "text", "target").mapInArrow(scan, "kind byte, key long, " + ", ".join(f"{c} long" for c in COUNTS))
    return counts.groupBy("kind", "key").agg(*[F.sum(c).alias(c) for c in COUNTS])


def bigram_counts(flagged: DataFrame, wanted: Broadcast) -> DataFrame:
    """place, everywhere, wanted: the counts of the bigrams whose hashes, sorted, are broadcast."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = wanted.value
        totals = np.zeros((2, len(keys) + 1), np.int64)
        for batch in slices(batches):
            flags = np.array(batch.column(2).to_pylist(), bool)
            for at, rows, t in tokens(batch.column(1)):
                place = found(keys, t.bigram)
                totals[0] += np.bincount(place, minlength=len(keys) + 1)
                totals[1] += np.bincount(place[flags[at : at + rows][t.doc]], minlength=len(keys) + 1)
        seen = np.flatnonzero(totals[0, :-1])
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(totals[0, seen]), pa.array(totals[1, seen])], names=["place", "everywhere", "wanted"])

    counts = flagged.select("doc_id", "text", "target").mapInArrow(scan, "place long, everywhere long, wanted long")
    return counts.groupBy("place").agg(F.sum("everywhere").alias("everywhere"), F.sum("wanted").alias("wanted"))


def found(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted key among the sorted keys; their number where it is none of them."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, len(keys))


@dataclass
class Side:
    """One model: words, documents and vocabulary in all, and the counts of frequent words, their ends and frequent bigrams."""

    words: int
    starts: int
    places: int
    counts: np.ndarray
    ends: np.ndarray
    bigrams: np.ndarray

    def share(self, counts: np.ndarray) -> np.ndarray:
        """The smoothed frequency of words, from their counts. The total keeps the document's own words, a factor near 1."""
        return (counts + ALPHA) / (self.words + ALPHA * max(self.places, 1))

    def loss(self, n: np.ndarray, bigrams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Of n occurrences of a bigram, the context's part not counted."""
        return -n * np.log(bigrams + WEIGHT * self.share(counts))


@dataclass
class Models:
    words: np.ndarray
    bigrams: np.ndarray
    target: Side
    background: Side

    @property
    def sides(self) -> tuple[Side, Side]:
        return self.target, self.background


def fitted(flagged: DataFrame) -> Models:
    """The counts over all rows. The driver gets at most FREQUENT_WORDS words and FREQUENT_BIGRAMS bigrams."""
    spark = flagged.sparkSession
    first = stored(first_counts(flagged), "counts")
    words, pairs = first.filter(F.col("kind") == WORD), first.filter(F.col("kind") == BIGRAM)
    total = words.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS]).first()
    top = words.orderBy(F.desc("everywhere"), "key").limit(FREQUENT_WORDS).toPandas()
    # a bigram that is frequent over all is so in some task's words; there are at most FREQUENT_BIGRAMS of these
    keys = np.sort(pairs.filter(F.col("everywhere") * FREQUENT_BIGRAMS >= total["everywhere"]).select("key").toPandas()["key"].to_numpy(np.int64).view(H.U))
    counts = bigram_counts(flagged, spark.sparkContext.broadcast(keys)).toPandas()
    discard(first)
    order = np.argsort(top["key"].to_numpy(np.int64).view(H.U))
    pick = lambda c: top[c].to_numpy(np.int64)[order]
    sides = []
    for column in ("wanted", "everywhere"):
        bigrams = np.zeros(len(keys), np.int64)
        bigrams[counts["place"].to_numpy(np.int64)] = counts[column]
        sides.append(Side(total[column], total[f"{column}_ends"], total["n"], pick(column), pick(f"{column}_ends"), bigrams))
    return Models(pick("key").view(H.U), keys, *sides)


#: Entries of one bucket from one flush. Arrays of ``key`` (uint64) and ``rest`` (uint32): a bigram and its frequent word's place, or a
#: rare word and 32 bits of the word before it. ``doc`` (uint16) is how far the document's place is from that of the entry before;
#: ``n`` and ``own`` (uint32) are twice the occurrences of the bigram and of the word, plus 1 if these, or the word at all, end the
#: document; ``n`` is doubled again, plus 1 in a target document.
#: The row HEADS of a flush has its documents: ``key``: ids, ``rest``: words, ``doc`` and ``n``: their sums of what is known on the spot.
ENTRIES = "bucket int, flush long, kind byte, key binary, rest binary, doc binary, n binary, own binary"
COMMON, RARE, HEADS = 0, 1, 2


def entries(flagged: DataFrame, models: Broadcast, buckets: int) -> DataFrame:
    """ENTRIES of all documents. A flush is named by its task and its number there."""
    names = [c.split()[0] for c in ENTRIES.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, flush = models.value, TaskContext.get().partitionId() << 32
        heads: list[tuple] = []
        held: list[tuple] = []
        docs = size = 0
        for batch in slices(batches):
            ids, flags = batch.column(0), np.array(batch.column(2).to_pylist(), np.int64)
            for at, rows, t in tokens(batch.column(1)):
                flag = flags[at : at + rows]
                sums, part = of_documents(t, rows, flag, m, docs)
                heads.append((ids.slice(at, rows), np.bincount(t.doc, minlength=rows), *sums))
                held.append(part)
                docs, size = docs + rows, size + len(part[0])
            if size >= FLUSH_ENTRIES or docs >= FLUSH_DOCUMENTS:
                yield from packed(flush, heads, held)
                heads, held, docs, size, flush = [], [], 0, 0, flush + 1
        if heads:
            yield from packed(flush, heads, held)

    def packed(flush: int, heads: list[tuple], held: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids, n, a, b = zip(*heads)
        told = pa.concat_arrays([pa.concat_arrays(i.chunks) if isinstance(i, pa.ChunkedArray) else i for i in ids])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, pa.schema([("doc_id", pa.int64())])) as out:
            out.write_batch(pa.RecordBatch.from_arrays([told], names=["doc_id"]))
        raw = lambda xs: np.concatenate(xs).tobytes()
        rows = [(flush % buckets, flush, HEADS, sink.getvalue().to_pybytes(), raw([x.astype(np.int64) for x in n]), raw(a), raw(b), b"")]
        parts = list(zip(*held))
        held.clear()
        key, kind = np.concatenate(parts[0]), np.concatenate(parts[1])
        place = (key % H.U(buckets)).astype(np.int64) * 2 + kind
        order = np.argsort(place, kind="stable")  # so that documents stay in order
        key, place = key[order], place[order]
        cuts = np.flatnonzero(np.diff(place)) + 1
        bucket, kind = place[[0, *cuts]] // 2 if len(key) else place, kind[order]
        rest, doc, times, own = (np.concatenate(x)[order] for x in parts[2:])
        del parts, place, order
        for n, i, j in zip(bucket, [0, *cuts], [*cuts, len(key)] if len(key) else []):
            rows.append((int(n), flush, int(kind[i]), key[i:j].tobytes(), rest[i:j].tobytes(), gaps(doc[i:j]), times[i:j].tobytes(), own[i:j].tobytes()))
        types = (pa.int32(), pa.int64(), pa.int8(), *[pa.binary()] * 5)
        for i in range(0, len(rows), 1000):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 1000]), types)], names=names)

    return flagged.select("doc_id", "text", "target").mapInArrow(scan, ENTRIES)


def gaps(places: np.ndarray) -> bytes:
    """Ascending places as 16-bit steps."""
    return np.diff(places, prepend=0).astype(np.uint16).tobytes()


def places(steps: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(steps, np.uint16), dtype=np.int64)


def of_documents(t: Tokens, rows: int, flag: np.ndarray, m: Models, shift: int) -> tuple[list[np.ndarray], tuple[np.ndarray, ...]]:
    """The sums (target, background) of each document that are known on the spot, and the entries (key, kind, rest, doc, n, own) of the others."""
    salt = H.mix(t.doc.astype(H.U) + START)
    _, word_at, word_of, own = np.unique(t.word ^ salt, return_index=True, return_inverse=True, return_counts=True)
    ends_doc = np.bincount(word_of, t.last, len(word_at)).astype(np.int64)  # a word ends its document once at most
    pair = t.bigram
    _, at, of, n = np.unique(pair ^ salt, return_index=True, return_inverse=True, return_counts=True)
    ended = np.bincount(of, t.last, len(at)).astype(np.int64)
    order = np.argsort(t.doc[at], kind="stable")
    at, n, ended = at[order], n[order], ended[order]
    doc, place, pair = t.doc[at], found(m.words, t.word[at]), pair[at]
    known = place < len(m.words)
    hot = found(m.bigrams, pair)
    here = known & (hot < len(m.bigrams))
    mine, mine_ends = own[word_of[at]], ends_doc[word_of[at]]
    word_doc, word_place = t.doc[word_at], found(m.words, t.word[word_at])
    frequent = word_place < len(m.words)
    w_doc, w_place, w_own, w_ends = word_doc[frequent], word_place[frequent], own[frequent], ends_doc[frequent]
    filled = np.bincount(t.doc, minlength=rows) > 0
    sums = []
    for side, less in zip(m.sides, (flag, np.ones(rows, np.int64))):
        # what a model counted of the document itself is taken off
        told = side.loss(n[here], side.bigrams[hot[here]] - n[here] * less[doc[here]], side.counts[place[here]] - mine[here] * less[doc[here]])
        context = side.counts[w_place] - side.ends[w_place] - (w_own - w_ends) * less[w_doc]
        x = np.bincount(doc[here], told, rows) + np.bincount(w_doc, (w_own - w_ends) * np.log(context + WEIGHT), rows)
        sums.append(np.where(filled, x + np.log(np.maximum(side.starts - less, 0) + WEIGHT), 0.0))
    go = ~here
    rare = ~known[go]
    key = np.where(rare, t.word[at][go], H.mix(pair[go]))
    rest = np.where(rare, H.mix(t.before[at][go]) >> H.U(32), place[go].astype(H.U)).astype(np.uint32)
    numbers = (doc[go] + shift, n[go] * 4 + ended[go] * 2 + flag[doc[go]], mine[go] * 2 + mine_ends[go])
    return sums, (key, rare.astype(np.int8), rest, *(x.astype(np.uint32) for x in numbers))


def entry_losses(m: Models, kind: int, key: np.ndarray, rest: np.ndarray, n: np.ndarray, own: np.ndarray) -> list[np.ndarray]:
    """The loss of each entry under either model; all entries of a key are among them."""
    flag, ended, n, ends, own = n & 1, n >> 1 & 1, n >> 2, own & 1, own >> 1
    _, word = np.unique(key, return_inverse=True)
    if kind == RARE:
        _, pair = np.unique(H.mix(key) ^ H.mix(rest.astype(H.U)), return_inverse=True)
    else:
        pair = word
    sums = []
    for side, in_model in zip(m.sides, (flag, np.ones(len(n), np.int64))):
        less = in_model * n
        bigrams = np.bincount(pair, less)[pair] - less
        if kind == RARE:
            counts, contexts = np.bincount(word, less)[word] - in_model * own, np.bincount(word, in_model * (n - ended))[word] - in_model * (own - ends)
            sums.append(side.loss(n, bigrams, counts) + (n - ended) * np.log(contexts + WEIGHT))
        else:
            sums.append(side.loss(n, bigrams, side.counts[rest] - in_model * own))
    return sums


def bucket_losses(models: Broadcast):
    """For ``applyInArrow``: the entries of one bucket to the sums of its documents, a row for each flush."""
    schema = pa.schema([("flush", pa.int64()), ("kind", pa.int8()), ("key", pa.binary()), ("doc", pa.binary()), ("a", pa.binary()), ("b", pa.binary())])

    def losses(table: pa.Table) -> pa.Table:
        m = models.value
        flushes, kinds = (table.column(c).to_pylist() for c in ("flush", "kind"))
        rows = {c: [x.as_buffer() for x in table.column(c)] for c in ("key", "rest", "doc", "n", "own")}  # no copies
        out = [(f, HEADS, *(rows[c][i].to_pybytes() for c in ("key", "rest", "doc", "n"))) for i, (f, k) in enumerate(zip(flushes, kinds)) if k == HEADS]
        for kind in (COMMON, RARE):
            mine = [i for i, k in enumerate(kinds) if k == kind]
            if not mine:
                continue
            size = np.array([len(rows["key"][i]) // 8 for i in mine])
            flush = np.repeat(np.arange(len(mine), dtype=np.int32), size)
            key = np.frombuffer(b"".join(rows["key"][i] for i in mine), H.U)
            packed = [np.frombuffer(b"".join(rows[c][i] for i in mine), np.uint32) for c in ("rest", "n", "own")]
            doc = np.concatenate([places(rows["doc"][i]).astype(np.int32) for i in mine])
            a, b = np.empty((2, len(key)))
            for at in pieces(key):
                a[at], b[at] = entry_losses(m, kind, key[at], *(x[at].astype(np.int64) for x in packed))
            del key, packed
            # entries of a flush are in order of their documents
            new = np.flatnonzero(np.concatenate([[True], (np.diff(flush) != 0) | (np.diff(doc) != 0)]))
            a, b = (np.add.reduceat(s, new) for s in (a, b))
            bounds = np.searchsorted(flush[new], np.arange(len(mine) + 1))
            at = doc[new]
            for i, x, y in zip(mine, bounds[:-1], bounds[1:]):
                out.append((flushes[i], kind, None, gaps(at[x:y]), a[x:y].tobytes(), b[x:y].tobytes()))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return losses


SCHEMA = "doc_id long, n_tokens long, ce_target double, ce_background double, ce_difference double"


def flush_scores(table: pa.Table) -> pa.Table:
    """For ``applyInArrow``: the sums of one flush's documents to their rows."""
    rows = table.to_pylist()
    head = next(r for r in rows if r["kind"] == HEADS)
    ids = pa.ipc.open_stream(head["key"]).read_all().column(0).combine_chunks()
    n = np.frombuffer(head["doc"], np.int64)
    a, b = (np.frombuffer(head[c]).copy() for c in "ab")
    for r in rows:
        if r["kind"] != HEADS:
            at = places(r["doc"])
            a[at] += np.frombuffer(r["a"])
            b[at] += np.frombuffer(r["b"])
    filled = n > 0
    a, b = (np.divide(x, n, where=filled, out=np.zeros(len(n))) for x in (a, b))
    mean = lambda x: pa.array(x, mask=~filled)
    return pa.table([ids, pa.array(n), mean(a), mean(b), mean(a - b)], names=[c.split()[0] for c in SCHEMA.split(", ")])


def score_documents(documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, mean losses under either model and their difference (low: like the target).

    The target documents are those ``labels`` gives quality 1 and toxic 0 (doc_id null or a null label: not). Texts
    without words, null ones included, have 0 tokens and null losses. Repeated rows count and are scored each, every other
    row of an equal text staying in the counts; null ids stay null. Without any target document the target model is the
    smoothed uniform one. Other columns are ignored.
    """
    spark = documents.sparkSession
    good = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("target")).filter("target")
    flagged = texts_of(documents, id_column, text_column).join(hinted(good, 16), "doc_id", "left").select("doc_id", "text", F.coalesce("target", F.lit(False)).alias("target"))
    models = fitted(flagged)
    held = spark.sparkContext.broadcast(models)
    buckets = max(1, -(-models.background.words // BUCKET_ENTRIES))
    sums = entries(flagged, held, buckets).groupBy("bucket").applyInArrow(bucket_losses(held), "flush long, kind byte, key binary, doc binary, a binary, b binary")
    return sums.groupBy("flush").applyInArrow(flush_scores, SCHEMA)
