"""Hierarchical multi-length packing of tokenised documents.

Windows come in tiers of 1024, 512, 256 and 128 tokens. Every document is routed: its whole 1024-token windows are cut off, and
the rest goes to the smallest tier that holds it. Each tier's windows take their own rests; the gaps of long windows are filled
from shorter tiers, cut to fit, so that windows are full. Step groups take windows from the longest tier down until they hold
STEP_TOKENS, so that all steps of a task do the same work.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from parlance.llm.shared import map_rows, texts_of

TIERS = (1024, 512, 256, 128)
END = 0
STEP_TOKENS = 16 * TIERS[0]
#: Rests held by a task before they are packed; a rest has fewer than 1024 tokens.
POOL = 8192
#: Words whose ids a task remembers.
CACHE_WORDS = 300_000
VOCABULARY = "byte_bpe_50k"

#: Texts with white space other than single blanks and line ends, or with special tokens, go to the tokenizers library whole; any
#: other text can be cut before each blank, since a blank between two other characters begins a token.
OTHER_SPACE = re.compile(r"[^\S \n]")


def unusual(text: str) -> bool:
    return "  " in text or "\n " in text or " \n" in text or text.startswith(" ") or OTHER_SPACE.search(text) is not None


class Words(dict):
    """The ids of words that follow a blank, encoded when first asked for; emptied when there are CACHE_WORDS of them."""

    def __init__(self, encode: Callable[[str], bytes]) -> None:
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        got = self[word] = self.encode(f" {word}")
        return got


class Ids:
    """Token ids of texts by the byte-level BPE vocabulary, as little-endian uint32 bytes.

    They are the tokenizers library's, by its defaults: strings of special tokens in a text are those tokens.
    The same vocabulary as ranks (the library's faster sibling, equal by test) is used word by word, with a cache.
    """

    def __init__(self, vocabulary: str = VOCABULARY) -> None:
        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.whole = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
        added = [re.escape(t.content) for t in self.whole.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(added)) if added else None
        self.after_blank = Words(self.word)

    def __call__(self, text: str) -> bytes:
        if unusual(text) or self.special and self.special.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        first, *rest = text.split(" ")
        return b"".join([self.word(first), *map(self.after_blank.__getitem__, rest)]) if rest else self.word(first)

    def word(self, word: str) -> bytes:
        return np.array(self.fast.encode_ordinary(word), "<u4").tobytes()


class Packer:
    """Packs the documents of one task; windows are numbered from ``first``."""

    def __init__(self, first: int) -> None:
        self.next, self.slots = first, first
        self.open = [(0, 0)] * len(TIERS)  # of each tier: the open slot of its windows, and the tokens it still holds
        self.rows: list[tuple] = []
        self.rests: list[deque] = [deque() for _ in TIERS]
        self.tokens = [0] * len(TIERS)

    def window(self, tier: int) -> tuple[int, int]:
        """(sequence, step group) of a new window. Windows of a tier share slots of 1024 tokens, slots make up step groups."""
        slot, room = self.open[tier]
        if room < TIERS[tier]:
            slot, room = self.slots, TIERS[0]
            self.slots += 1
        self.open[tier] = (slot, room - TIERS[tier])
        self.next += 1
        return self.next - 1, slot // (STEP_TOKENS // TIERS[0])

    def piece(self, doc: int, start: int, ids: bytes, total: int, where: tuple[int, int], offset: int) -> None:
        self.rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, where[0], offset, where[1]))

    def wait(self, rest: tuple) -> None:
        """Queue a rest in the shortest tier that holds it."""
        n = len(rest[2]) // 4
        tier = max(t for t, window in enumerate(TIERS) if window >= n)
        self.rests[tier].append(rest)
        self.tokens[tier] += n

    def add(self, doc: int, ids: bytes) -> None:
        total, size = len(ids) // 4, TIERS[0] * 4
        whole = len(ids) // size * size
        for at in range(0, whole, size):
            self.piece(doc, at // 4, ids[at : at + size], total, self.window(0), 0)
        if whole < len(ids):
            self.wait((doc, whole // 4, ids[whole:], total))
            if sum(map(len, self.rests)) >= POOL:
                self.pack()

    def choose(self, tier: int, room: int) -> int | None:
        """The tier whose next rest goes into a gap: a shorter one that fits whole, the shortest there is, or the window's own."""
        shorter = [t for t in range(tier + 1, len(TIERS)) if self.rests[t]]
        fits = [t for t in shorter if TIERS[t] <= room]
        return fits[0] if fits else shorter[-1] if shorter else tier if self.rests[tier] else None

    def fill(self, tier: int, size: int) -> int:
        """Make a window of ``size`` at most, its first piece from its own tier; what is cut off waits. Returns its tokens."""
        where, offset, source = self.window(tier), 0, tier if self.rests[tier] else self.choose(tier, size)
        while source is not None and offset < size:
            doc, start, ids, total = self.rests[source].popleft()
            self.tokens[source] -= len(ids) // 4
            take = ids[: (size - offset) * 4]
            self.piece(doc, start, take, total, where, offset)
            offset += len(take) // 4
            if len(take) < len(ids):
                self.wait((doc, start + len(take) // 4, ids[len(take) :], total))
            source = self.choose(tier, size - offset)
        return offset

    def pack(self, last: bool = False) -> None:
        """Fill windows tier by tier. What fills none, under 1024 tokens, waits for the next pool, or at last is cut into shorter ones."""
        for t, size in enumerate(TIERS):
            while self.rests[t] and sum(self.tokens[t:]) >= size:
                self.fill(t, size)
        if last and (left := sum(self.tokens)):
            pending = [x for q in self.rests for x in q]
            self.rests, self.tokens = [deque() for _ in TIERS], [0] * len(TIERS)
            for doc, start, ids, total in pending:  # as pieces of the shortest tier, which every window may take
                self.rests[-1].append((doc, start, ids, total))
                self.tokens[-1] += len(ids) // 4
            for t, size in [*enumerate(TIERS)][1:]:
                while left >= size:
                    left -= self.fill_from_last(t, size)
            if left:
                self.fill_from_last(0, TIERS[0])

    def fill_from_last(self, tier: int, size: int) -> int:
        """Make a window of what is left, in order."""
        where, offset = self.window(tier), 0
        while self.rests[-1] and offset < size:
            doc, start, ids, total = self.rests[-1].popleft()
            take = ids[: (size - offset) * 4]
            self.piece(doc, start, take, total, where, offset)
            offset += len(take) // 4
            if len(take) < len(ids):
                self.rests[-1].appendleft((doc, start + len(take) // 4, ids[len(take) :], total))
        return offset

    def taken(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, step_group long"


def pack_documents(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence, a checksum of its ids, and the step group.

    A document is its text's ids, then id 0; a null or empty text is id 0 alone. Sequences have at most 1024 tokens; all but
    one or so of a task are full windows of a tier, which need no padding. Each task packs the documents of its input split
    (no shuffle), holding at most POOL rests; sequence ids begin with the task's number, so a task that runs again gives the
    same rows. Rows with null ids and repeated rows are documents of their own; other columns are ignored.
    """

    def scan(batches: Iterator[list[list]]) -> Iterator[list[tuple]]:
        ids_of, packer = Ids(), Packer(TaskContext.get().partitionId() << 36)
        end = np.array([END], "<u4").tobytes()
        for ids, texts in batches:
            for doc, text in zip(ids, texts):
                packer.add(doc, ids_of(text) + end)
            yield packer.taken()
        packer.pack(True)
        yield packer.taken()

    return map_rows(texts_of(documents, id_column, text_column), scan, COLUMNS)
