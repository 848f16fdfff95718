"""Benchmark decontamination by pigeonhole edit matching.

A test item of m words may be found with up to k = floor(ERROR_SHARE * m) word edits. It is split into k + 1 pieces: of
any occurrence within k edits at least one piece is exact. One automaton finds all exact pieces in a text; around each
hit Myers' bit-parallel algorithm measures the edit distance, one machine-word operation per word of text.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.shared import BATCH_ROWS, discard, map_rows, stored, texts_of, whole_text

#: Edits allowed for each word of an item.
ERROR_SHARE = 0.15
#: Text of test items handled (and broadcast) at once, in code points; more items are handled in further blocks.
BLOCK_CHARS = 8 << 20

# ASCII characters that separate words, and further ones that are first turned into a blank.
SEPARATORS = bytes(c for c in range(128) if not chr(c).isalnum())
FURTHER = " ‘’“”–—…¿¡«»"
TO_BLANK = bytes.maketrans(SEPARATORS, b" " * len(SEPARATORS))


def normal(text: str) -> str:
    """Lower-case words joined by single blanks, with a blank at either end."""
    for c in FURTHER:
        if c in text:
            text = text.replace(c, " ")
    return f" {b' '.join(text.lower().encode('utf-8', 'replace').translate(TO_BLANK).split()).decode()} "


def budget(n_words: int) -> int:
    return int(ERROR_SHARE * n_words + 1e-9)


def pieces(words: Sequence[str]) -> Iterator[tuple[int, str]]:
    """(first word, piece) of the k + 1 pieces of an item, of nearly equal length."""
    n = budget(len(words)) + 1
    for i in range(n):
        a, b = len(words) * i // n, len(words) * (i + 1) // n
        yield a, f" {' '.join(words[a:b])} "


def myers(pattern: Sequence[str], text: Sequence[str]) -> tuple[int, int]:
    """(least edit distance of the pattern to a run of the text, exclusive end of the first such run)."""
    m = len(pattern)
    at: dict[str, int] = defaultdict(int)
    for i, w in enumerate(pattern):
        at[w] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, end = full, 0, m, m, 0
    for j, w in enumerate(text, 1):
        eq = at.get(w, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        h_plus = minus | ~(diagonal | plus) & full
        h_minus = plus & diagonal
        score += bool(h_plus & top) - bool(h_minus & top)
        h_plus, h_minus = h_plus << 1 & full, h_minus << 1 & full
        plus = h_minus | ~((eq | minus) | h_plus) & full
        minus = h_plus & (eq | minus)
        if score < best:
            best, end = score, j
    return best, end


class Matcher:
    """The automaton of all pieces of some items, and the items' words, by the items' places in the sequence."""

    def __init__(self, items: Sequence[tuple[int | None, str]]) -> None:
        self.ids = [i for i, _ in items]
        self.items = {k: normal(t).split() for k, (_, t) in enumerate(items)}
        owners: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, words in self.items.items():
            for first, piece in pieces(words) if words else ():
                owners[piece].append((i, first))
        self.automaton = ahocorasick.Automaton()
        for piece, who in owners.items():
            self.automaton.add_word(piece, (piece.count(" ") - 1, who))
        self.automaton.make_automaton()

    def found(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item's place, distance, first word, end) of each item's best occurrence in the text, the first of equal ones."""
        norm = normal(text)
        windows: dict[int, set[int]] = defaultdict(set)
        at, place = 0, 0
        for end, (n, who) in self.automaton.iter(norm) if len(self.automaton) else ():
            place += norm.count(" ", at, end)
            at = end
            for item, first in who:
                windows[item].add(place - n - first)
        if not windows:
            return []
        words, out = norm.split(), []
        for item, shifts in sorted(windows.items()):
            pattern = self.items[item]
            k = budget(len(pattern))
            spans: list[list[int]] = []
            for s in sorted(shifts):
                a, b = max(0, s - k), min(len(words), s + len(pattern) + k)
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                else:
                    spans.append([a, b])
            best = min((distance, a + end, a, b) for a, b in spans for distance, end in [myers(pattern, words[a:b])])
            if best[0] <= k:
                distance, end, a, _ = best
                # matched backwards from its end, the run's length follows
                length = myers(pattern[::-1], words[a:end][::-1])[1]
                out.append((item, distance, end - length, end))
        return out


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """The distinct test items (id, text) in blocks of at most BLOCK_CHARS, read one partition at a time; null texts are left out."""
    block: list[tuple[int | None, str]] = []
    order = lambda item: (item[0] is None, item[0] or 0, item[1])
    chars = 0
    rows = benchmark.filter("text is not null").select(F.col("item_id").cast("long"), "text").distinct()
    for item, text in rows.toLocalIterator():
        if block and chars + len(text) > BLOCK_CHARS:
            yield sorted(block, key=order)
            block, chars = [], 0
        block.append((item, text))
        chars += len(text)
    if block:
        yield sorted(block, key=order)


SCHEMA = "doc_id long, item_id long, n_edits long, first_word long, end_word long, item_words long"


def find_leaks(documents: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document row and test item that occurs in it within the item's error budget.

    The row has the item's least distance n_edits and the place of its first best occurrence, in normalised words.
    Null and empty texts match nothing, nor do items without words; repeated document rows each have their rows, null
    ids stay null. Items are the distinct (item_id, text): those with a null id are looked for as well, and of items with
    the same id each that occurs has its row. Other columns are ignored. No shuffle:
    the items, a block at a time, go to the tasks; each task reads whole texts.
    """
    spark = documents.sparkSession
    texts = texts_of(documents, id_column, text_column)
    result = None
    for block in blocks(benchmark):
        items = spark.sparkContext.broadcast(block)

        def scan(batches: Iterator[list[list]], items=items) -> Iterator[list[tuple]]:
            matcher = Matcher(items.value)
            for ids, batch in batches:
                yield [(i, matcher.ids[hit[0]], *hit[1:], len(matcher.items[hit[0]])) for i, t in zip(ids, batch) for hit in matcher.found(t)]

        part = map_rows(texts, scan, SCHEMA)
        result = part if result is None else result.unionAll(part)
    return spark.createDataFrame([], SCHEMA) if result is None else result


def holds_any(items: Broadcast) -> Callable[[Column], Column]:
    """A column function: whether a text holds one of the broadcast items."""
    held: list[Matcher] = []

    @F.arrow_udf("boolean")
    def hit(texts: pa.Array) -> pa.Array:
        if not held:
            held.append(Matcher(items.value))
        pieces = (texts.slice(at, BATCH_ROWS).to_pylist() for at in range(0, len(texts), BATCH_ROWS))
        return pa.array([bool(held[0].found(t)) for piece in pieces for t in piece], pa.bool_())

    return hit


def contaminated_flag(documents: DataFrame, benchmark: DataFrame, text_column: str = "text", flag: str = "contaminated") -> DataFrame:
    """``documents`` with a boolean column ``flag``: whether any test item occurs in the row's text. No shuffle.

    A benchmark of several blocks takes one pass a block, the rows being written to the shared folder in between, so that a
    task holds one block's automaton whatever the benchmark's size. A column of the same name is replaced.
    """
    spark = documents.sparkSession
    out, earlier = None, []
    for block in blocks(benchmark):
        if out is not None:
            out = stored(out, "flagged")
            discard(*earlier)
            earlier = [out]
        holds = holds_any(spark.sparkContext.broadcast(block))(whole_text(text_column))
        out = documents.withColumn(flag, holds) if out is None else out.withColumn(flag, F.col(flag) | holds)
    return documents.withColumn(flag, F.lit(False)) if out is None else out
