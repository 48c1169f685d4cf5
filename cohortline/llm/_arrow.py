"""Arrow batches as byte buffers, and words found in them without a Python loop per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are handled at once. A single longer text is cut at a byte that is in no word.
SLICE_BYTES = 1 << 20
#: Odd multiplier of the polynomial word hash (64 bits, wrapping).
BASE = np.uint64(0x9E3779B97F4A7C15)


def _inverse(x: int) -> int:
    y = x
    for _ in range(6):
        y = (y * (2 - x * y)) & (2**64 - 1)
    return y


def _powers(x: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    have = 1
    step = x & (2**64 - 1)
    while have < n:
        more = min(have, n - have)
        np.multiply(out[:more], np.uint64(step), out=out[have : have + more])
        have += more
        step = step * step & (2**64 - 1)
    return out


_TABLES: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, at least n of each."""
    if len(_TABLES.get("up", ())) < n:
        n = max(n, SLICE_BYTES + 4096)
        _TABLES["up"], _TABLES["down"] = _powers(int(BASE), n), _powers(_inverse(int(BASE)), n)
    return _TABLES["up"], _TABLES["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    """Uniform numbers in (0, 1) of scrambled 64-bit numbers."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


def alnum_table() -> np.ndarray:
    """0 for bytes outside words, else the byte with A-Z lower-cased: words are [0-9a-z] and all that is not ASCII."""
    t = np.zeros(256, np.uint8)
    t[128:] = np.arange(128, 256)
    t[48:58] = np.arange(48, 58)
    t[97:123] = np.arange(97, 123)
    t[65:91] = np.arange(97, 123)
    return t


def graphic_table() -> np.ndarray:
    """0 for space and \\t to \\r, else the byte with A-Z lower-cased (byte 0 as the free 32)."""
    t = np.arange(256).astype(np.uint8)
    t[65:91] = np.arange(97, 123)
    t[[32, 9, 10, 11, 12, 13]] = 0
    t[0] = 32
    return t


ALNUM, GRAPHIC = alnum_table(), graphic_table()


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, n+1 offsets and validity of a string or binary column; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_string() if pa.types.is_string(column.type) else pa.large_binary())
    valid = np.ones(len(column), bool) if not column.null_count else column.is_valid().to_numpy(zero_copy_only=False)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if not valid.all() and (np.diff(off)[~valid] > 0).any():
        column = pa.compute.fill_null(column, "" if pa.types.is_large_string(column.type) else b"")
        return (*buffers(column)[:2], valid)
    return data, off, valid


def words(data: np.ndarray, off: np.ndarray, table: np.ndarray = ALNUM) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of whole texts as (first text, end text, text of each word, starts, ends, hashes); starts and ends are
    byte places in data. A text longer than SLICE_BYTES makes a slice by itself and is read in pieces."""
    n, i = len(off) - 1, 0
    while i < n:
        j = int(np.searchsorted(off, off[i] + SLICE_BYTES, "right")) - 1
        j = min(max(j, i + 1), n)
        parts, at = [], int(off[i])
        while at < off[j]:
            end = min(int(off[j]), at + 4 * SLICE_BYTES)
            if end < off[j]:  # only in a long text: cut where no word is
                cut = np.flatnonzero(table[data[at:end]] == 0)
                if len(cut):
                    end = at + int(cut[-1]) + 1
                else:
                    later, end = end, int(off[j])
                    for a in range(later, int(off[j]), SLICE_BYTES):
                        cut = np.flatnonzero(table[data[a : min(a + SLICE_BYTES, int(off[j]))]] == 0)
                        if len(cut):
                            end = a + int(cut[0]) + 1
                            break
            parts.append(_slice(data, at, end, off[i + 1 : j], table))
            at = end
        s, e, h = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
        yield i, j, np.searchsorted(off[i : j + 1], s, "right") - 1 + i, s, e, h
        i = j


def _slice(data: np.ndarray, at: int, end: int, cuts: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    b = table[data[at:end]]
    inside = b != 0
    edge = np.empty(len(b) + 1, bool)
    edge[0] = inside[0]
    edge[-1] = inside[-1]
    np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
    cuts = np.unique(cuts[(cuts > at) & (cuts < end)]) - at
    cuts = cuts[inside[cuts] & inside[cuts - 1]]
    if len(cuts):  # two texts that meet in the middle of words
        places = np.flatnonzero(edge)
        places = np.sort(np.concatenate([places, cuts, cuts]))
    else:
        places = np.flatnonzero(edge)
    s, e = places[::2], places[1::2]
    up, down = _tables(len(b) + 1)
    run = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(b.astype(np.uint64) * up[: len(b)], out=run[1:])
    h = (run[e] - run[s]) * down[s]
    return s + at, e + at, mix(h ^ ((e - s).astype(np.uint64) << np.uint64(56)))


def word_hash(word: str, table: np.ndarray = ALNUM) -> int:
    """The hash that words() gives a word."""
    raw = np.frombuffer(word.encode(), np.uint8)
    got = [h for *_, h in words(raw, np.array([0, len(raw)]), table)]
    return int(got[0][0])
