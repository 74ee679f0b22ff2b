"""Words, shingles and hashes of many texts at once, on their UTF-8 bytes with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: Bytes handled together; a longer text is a chunk of its own.
CHUNK = 1 << 20
BASE = 0x9E3779B97F4A7C15
FOLD = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[str, np.ndarray] = {}


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, and its n + 1 offsets into them. Nulls are empty."""
    width = "<i8" if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else "<i4"
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


def chunks(column: pa.Array, size: int = CHUNK, rows: int = 1 << 12) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of whole texts that together have about `size` bytes."""
    data, at = raw(column)
    i = 0
    while i < len(column):
        j = max(i + 1, min(int(np.searchsorted(at, at[i] + size, "right")) - 1, i + rows, len(column)))
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each `[^\\x20\\x09-\\x0D]+` word; words never cross texts."""
    black = ~SPACE[data]
    first, last = black.copy(), black.copy()
    first[1:] &= ~black[:-1]
    last[:-1] &= ~black[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first[inner] = black[inner]
    last[inner - 1] = black[inner - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse, modulo 2 ** 64, for i < n."""
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[name] = np.cumprod(table)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all output bits (a 64-bit finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, by differences of a running polynomial."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK, "right")))
        base, end = starts[i], ends[j - 1]
        up, down = powers(end - base)
        total = np.zeros(end - base + 1, np.uint64)
        np.cumsum((data[base:end].astype(np.uint64) + np.uint64(1)) * up[: end - base], out=total[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((total[e] - total[s]) * down[s])
        i = j
    return out


def fold(hashes: list[np.ndarray]) -> np.ndarray:
    """One hash of a sequence of hashes."""
    h = hashes[0]
    for x in hashes[1:]:
        h = h * FOLD + x
    return mix(h)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each run of `size` words; a shorter text with words has its whole sequence, in order of texts."""
    starts, ends, text = words(data, offsets)
    hashed = word_hashes(data, starts, ends)
    n = max(0, len(starts) - size + 1)
    whole = text[:n] == text[size - 1 : size - 1 + n]
    h = fold([hashed[k : k + n] for k in range(size)])[whole] if n else np.zeros(0, np.uint64)
    owner = text[:n][whole]
    count = np.bincount(text, minlength=len(offsets) - 1)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        first = np.searchsorted(text, short)
        more = np.array([fold([hashed[a + k : a + k + 1] for k in range(c)])[0] for a, c in zip(first, count[short], strict=True)], np.uint64)
        h, owner = np.concatenate([h, more]), np.concatenate([owner, short])
    return h, owner
