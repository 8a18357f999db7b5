"""Hashes of word shingles of whole texts, many texts at once in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)

#: Bytes between words: blank, tab, line feed, vertical tab, form feed, carriage return.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A-Z to a-z, all else as it is.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: close inputs give unrelated outputs."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


#: Powers of the base modulo 2**64; a word of more bytes than this begins them again, otherwise mixed.
_RUN = 1 << 16
_POW = powers(_RUN)


def word_places(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(all texts' bytes, each text's first byte with the end, first byte of each word, byte after it).

    Words are runs of bytes other than the six ASCII blanks, so of whole characters in UTF-8. Null texts have none.
    """
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    solid = ~_SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    firsts = offsets[:-1][offsets[:-1] < len(data)]
    begins[firsts] = solid[firsts]  # a text's first byte starts a word even right after another text's last
    starts = np.flatnonzero(begins)
    stops = np.append(np.flatnonzero(~solid), len(data))
    ends = np.minimum(np.append(starts[1:], len(data)), stops[np.searchsorted(stops, starts)]) if len(starts) else starts
    return data, offsets, starts, ends


def word_hashes(texts: pa.Array, lower: bool = True, places: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(first word of each text, with the total at the end; a 64-bit hash of each word's bytes)."""
    data, offsets, starts, ends = places or word_places(texts)
    if not len(starts):
        return np.zeros(len(offsets), np.int64), np.zeros(0, np.uint64)
    length = ends - starts
    place = np.zeros(len(data), np.int64)
    place[starts] = np.diff(starts, prepend=0)
    place = np.arange(len(data)) - np.cumsum(place)  # within its word; blanks count on but weigh nothing
    raw = _LOWER[data] if lower else data
    terms = (raw.astype(np.uint64) + np.uint64(1)) * _POW[place & (_RUN - 1)]
    terms[_SPACE[data]] = 0
    if length.max() > _RUN:
        far = place >= _RUN
        terms[far] *= mixed((place[far] // _RUN).astype(np.uint64)) | np.uint64(1)
    hashes = mixed(np.add.reduceat(terms, starts) ^ (length.astype(np.uint64) * _MIX))
    return np.searchsorted(starts, offsets), hashes


def shingle_hashes(texts: pa.Array, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(first shingle of each text, with the total at the end; a hash of each run of ``words`` words).

    A text with fewer words, but at least one, has one: its whole sequence. Repeats are kept.
    """
    first, hashes = word_hashes(texts)
    counts = np.diff(first)
    made = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    bounds = np.concatenate(([0], np.cumsum(made)))
    out = np.zeros(bounds[-1], np.uint64)
    at = np.repeat(first[:-1] - bounds[:-1], made) + np.arange(bounds[-1])  # first word of each shingle
    length = np.repeat(np.minimum(counts, words), made)
    for k in range(words):
        has = length > k
        word = hashes[np.minimum(at + k, max(len(hashes) - 1, 0))] if len(hashes) else hashes
        out = np.where(has, mixed(out * _BASE + word + np.uint64(k + 1)), out)
    return bounds, mixed(out ^ length.astype(np.uint64))


def distinct_in_runs(bounds: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each run's distinct values, ascending, and the new bounds."""
    parts = [np.unique(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.concatenate(([0], np.cumsum(sizes))), (np.concatenate(parts) if parts else values)
