"""Rolling hashes over Arrow text: of words, word shingles and byte windows, whole batches at a time.

A string's hash is the sum of table[byte] * R^i modulo 2^64, which prefix sums give for any
substring; the table is random and the sum is mixed, so equal strings and only they (but for
chances of 2^-64 a pair) have equal hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_RNG = np.random.default_rng(20240611)
#: Two independent families of byte values and multipliers.
BYTE = [_RNG.integers(1, 2**63, 256, dtype=np.int64).astype(U) * U(2) + U(1) for _ in range(2)]
BASE = [0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93]
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit (multiply and shift)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int, family: int) -> tuple[np.ndarray, np.ndarray]:
    """R^i and R^-i modulo 2^64 for i < n."""
    if family not in _POWERS or len(_POWERS[family][0]) < n:
        r = BASE[family]
        out = []
        for b in (r, pow(r, -1, 2**64)):
            p = np.full(max(n, 1 << 16), b, dtype=U)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POWERS[family] = tuple(out)
    a, b = _POWERS[family]
    return a[:n], b[:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, one after another, and the offset of each row; null counts as empty."""
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if binary else "")
    column = column.cast(pa.large_binary() if binary else pa.large_string())
    off = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[off[0]:off[-1]] if data is not None and len(off) else np.empty(0, np.uint8)
    return raw, off - (off[0] if len(off) else 0)


def prefix_sums(raw: np.ndarray, family: int) -> np.ndarray:
    """P with P[j] - P[i] = sum of table[raw[t]] * R^t for i <= t < j."""
    p = np.empty(len(raw) + 1, dtype=U)
    p[0] = 0
    np.cumsum(BYTE[family][raw] * powers(len(raw), family)[0], out=p[1:])
    return p


def spans(p: np.ndarray, start: np.ndarray, end: np.ndarray, family: int) -> np.ndarray:
    """Hash of each span [start, end)."""
    inverse = powers(len(p), family)[1]
    return mix((p[end] - p[start]) * inverse[start] + (end - start).astype(U) * U(0xA24BAED4963EE407))


def word_spans(raw: np.ndarray, off: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word: a run of bytes that are no separators, within one row."""
    n = len(raw)
    if not n:
        e = np.empty(0, np.int64)
        return e, e, e
    word = ~separators[raw]
    edge = np.zeros(n + 1, dtype=bool)
    edge[off] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    last = word.copy()
    last[:-1] &= ~word[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(off, start, side="right") - 1


SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_hashes(column: pa.Array, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word, A-Z lower-cased, in text order."""
    raw, off = text_bytes(column)
    raw = LOWER[raw]
    start, end, row = word_spans(raw, off, separators)
    if not len(start):
        return np.empty(0, U), row
    return spans(prefix_sums(raw, 0), start, end, 0), row


def shingles(words: np.ndarray, row: np.ndarray, n_rows: int, k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and first word of every k-word shingle; a row of fewer words has all of them as one."""
    count = np.bincount(row, minlength=n_rows) if len(row) else np.zeros(n_rows, np.int64)
    first = np.cumsum(count) - count
    take = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    at_row = np.repeat(np.arange(n_rows), take)
    at = np.arange(len(at_row)) - np.repeat(np.cumsum(take) - take, take) + first[at_row]
    length = np.minimum(count[at_row], k)
    h = length.astype(U) * U(0x9FB21C651E98DF25)
    for j in range(k):
        inside = j < length
        w = words[np.where(inside, at + j, 0)] if len(words) else h
        h = np.where(inside, mix(h * U(0xD1342543DE82EF95) + w), h)
    return h, at_row, at - first[at_row]


def distinct(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash), ordered by row, then hash."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], row[new]


def signed(x: np.ndarray) -> pa.Array:
    """The same 64 bits as Spark's long."""
    return pa.array(np.ascontiguousarray(x).view(np.int64))
