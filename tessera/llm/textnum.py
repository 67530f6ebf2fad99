"""Words of UTF-8 text as 64-bit hashes, computed on whole Arrow buffers with numpy.

A word is a run of ASCII letters and digits and of bytes from 0x80 on; ASCII letters count in lower case.
Long buffers are worked through in blocks, cut between words, so that memory follows the number of words and not of bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes that are hashed at a time.
BLOCK = 1 << 20
#: Bytes of text that a function of this module is given at a time by ``slices``.
SLICE_BYTES = 2 << 20
_BASE = U(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[65:91] = IS_WORD[97:123] = IS_WORD[128:] = True

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, kept and grown as needed."""
    if len(_powers.get("up", ())) < n:
        n = max(n, BLOCK + 4096)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(n, base, U)
            p[0] = 1
            _powers[name] = np.cumprod(p)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the n + 1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most ``rows`` rows and about ``most`` bytes of text each (a longer text is a part of its own)."""
    _, at = buffers(batch.column(column))
    a = 0
    while a < batch.num_rows:
        b = min(a + rows, max(a + 1, int(np.searchsorted(at, at[a] + most, "right")) - 1))
        yield batch.slice(a, b - a)
        a = b


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and length of each word in order, and the n + 1 offsets of the rows in these."""
    hashes, lengths, begins = [], [], []
    cuts = set(at.tolist())
    edges = np.asarray(sorted(cuts), np.int64)
    a = 0
    while a < len(data):
        b = min(len(data), a + BLOCK)
        if b < len(data):  # back to the last byte that is in no word, or on to the next one
            inside = IS_WORD[data[a:b]]
            gaps = np.flatnonzero(~inside)
            if len(gaps):
                b = a + int(gaps[-1]) + 1
            else:
                while b < len(data) and IS_WORD[data[b]] and b not in cuts:
                    b += 1
        part = data[a:b]
        w = IS_WORD[part]
        first, last = w.copy(), w.copy()
        first[1:] &= ~w[:-1]
        last[:-1] &= ~w[1:]
        e = edges[np.searchsorted(edges, a) : np.searchsorted(edges, b)] - a
        first[e] = w[e]
        e = e[e > 0] - 1
        last[e] = w[e]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = powers(len(part) + 1)
        total = np.zeros(len(part) + 1, U)
        np.cumsum((FOLD[part].astype(U) + U(1)) * up[: len(part)], out=total[1:])
        hashes.append(mix((total[end] - total[start]) * down[start]))
        lengths.append(end - start)
        begins.append(start + a)
        a = b
    if not hashes:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    return np.concatenate(hashes), np.concatenate(lengths), np.searchsorted(np.concatenate(begins), at)


def shingles(hashes: np.ndarray, at: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of k words of each row, and the rows' offsets. A row of fewer words, but not none, has one shingle."""
    n = np.diff(at)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out_at = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(len(n)), count)
    place = np.arange(out_at[-1]) - out_at[row] + at[row]
    out = np.full(len(place), U(k))
    short = n[row] < k
    for j in range(k):
        there = place + j < at[row + 1] if short.any() else None
        x = hashes[np.minimum(place + j, max(len(hashes) - 1, 0))] if len(hashes) else np.zeros(0, U)
        x = x if there is None else np.where(there, x, U(j + 1))
        out = mix(out * _BASE + x)
    return out, out_at


def copies(keys: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (row, key) with how often each occurs: rows, keys, counts. Rows ascend."""
    if not len(keys):
        return row, keys, np.zeros(0, np.int64)
    order = np.lexsort((keys, row))
    keys, row = keys[order], row[order]
    new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])])
    first = np.flatnonzero(new)
    return row[first], keys[first], np.diff(np.append(first, len(keys)))


def by_key(batches: Iterator[pa.RecordBatch], keys: list[int]) -> Iterator[pa.Table]:
    """Rows that come in order of some columns, cut so that no value of these is in two tables."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        same = np.ones(rows.num_rows, bool)
        for k in keys:
            c = rows.column(k).to_numpy()
            same &= c == c[-1]
        cut = int(np.argmax(same))
        rest = rows.slice(cut)
        if cut:
            yield rows.slice(0, cut)
    if rest is not None:
        yield rest
