"""Words and 64-bit hashes of whole Arrow batches, as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: ASCII white space; everything else belongs to a word.
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of text hashed at once, so that the arrays stay small; a longer text is hashed alone.
CHUNK_BYTES = 4 << 20

U = np.uint64
with np.errstate(over="ignore"):
    BASE = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (the finaliser of splitmix64)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


BYTE = mix(np.arange(1, 257, dtype=U) * BASE)
BYTE[WHITE] = 0
STEP = U(0xD1342543DE82EF95)


def powers(n: int) -> np.ndarray:
    out = np.full(n, STEP, U)
    out[:1] = 1
    return np.cumprod(out, dtype=U)


def chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets, bytes) of runs of rows with at most CHUNK_BYTES, or one row; null counts as empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1)
        yield first, offsets[first : last + 1] - offsets[first], data[offsets[first] : offsets[last]]
        first = last


def words(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of the rows, and the word's row."""
    n = len(data)
    if not n:
        return np.zeros(0, U), np.zeros(0, np.int64)
    inside = ~WHITE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | edge[1:-1]
    starts = np.flatnonzero(opens)
    if not len(starts):
        return np.zeros(0, U), np.zeros(0, np.int64)
    # a word's slice also holds the white space that follows it, whose bytes count 0
    spans = np.diff(np.append(starts, n))
    place = np.arange(starts[0], n) - np.repeat(starts, spans)
    hashes = np.add.reduceat(BYTE[data[starts[0] :]] * powers(int(spans.max()))[place], starts - starts[0])
    return mix(hashes), np.searchsorted(offsets, starts, "right") - 1


def shingles(hashes: np.ndarray, rows: np.ndarray, width: int, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each run of ``width`` words of a row, and its row; a shorter row with words has one run of all its words."""
    salts = mix(np.arange(1, width + 1, dtype=U))
    count = np.bincount(rows, minlength=n_rows)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    out = np.zeros(0, U)
    at = np.zeros(0, np.int64)
    if len(hashes) >= width:
        whole = np.zeros(len(hashes) - width + 1, U)
        for k in range(width):
            whole += hashes[k : k + len(whole)] * (salts[k] | U(1))
        same = rows[: len(whole)] == rows[width - 1 :]
        out, at = mix(whole[same]), rows[: len(whole)][same]
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        few = np.zeros(len(short), U)
        for k in range(width - 1):
            has = count[short] > k
            few[has] += hashes[first[short[has]] + k] * (salts[k] | U(1))
        out, at = np.concatenate([out, mix(few ^ count[short].astype(U))]), np.concatenate([at, short])
        order = np.argsort(at, kind="stable")
        out, at = out[order], at[order]
    return out, at


def counted(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each hash of a row once, how often it occurs there, and its row."""
    if not len(hashes):
        return hashes, np.zeros(0, np.int64), rows
    order = np.argsort(mix(hashes ^ mix(rows.astype(U) + BASE)), kind="stable")
    h, r = hashes[order], rows[order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])]))
    return h[new], np.diff(np.append(new, len(h))), r[new]
