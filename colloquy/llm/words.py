"""Vectorised word hashing over batches of texts, for use inside tasks."""

from __future__ import annotations

import numpy as np

# Texts are hashed in slices of about this many bytes, cut at separators, so
# that one very long text needs little memory beyond eight bytes a word.
SLICE = 1 << 22

_SPACES = b"\t\n\x0b\x0c\r "
_TO_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
# Byte translations: A-Z lower-cased, everything that parts words made a blank.
LOWER_SPLIT_AT_SPACE = bytes(32 if c in _SPACES else _TO_LOWER[c] for c in range(256))
SPLIT_AT_SPACE = bytes(32 if c in _SPACES else c for c in range(256))
LOWER_ALPHANUMERIC = bytes(
    _TO_LOWER[c] if c >= 128 or 48 <= c <= 57 or 97 <= _TO_LOWER[c] <= 122 else 32 for c in range(256)
)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def keys(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random odd 64-bit numbers."""
    counter = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(counter + np.uint64(seed)) | np.uint64(1)


_PLACES = keys(65521, 11)


def _hash_slice(data: bytes, table: bytes):
    """Hash, first byte and byte length of every word of the translated data."""
    buf = np.frombuffer(data.translate(table), dtype=np.uint8)
    inside = np.flatnonzero(buf != 32)
    if not len(inside):
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    first = np.flatnonzero(np.diff(inside, prepend=-2) != 1)
    lengths = np.diff(first, append=len(inside))
    place = np.arange(len(inside)) - np.repeat(first, lengths)
    if lengths.max() > len(_PLACES):
        place %= len(_PLACES)
    terms = (buf[inside].astype(np.uint64) + np.uint64(1)) * _PLACES[place]
    hashes = np.add.reduceat(terms, first)
    return mix(hashes + lengths.astype(np.uint64)), inside[first], lengths


def _pieces(data: bytes, table: bytes):
    """Cut data into slices that end at a separator."""
    start = 0
    while len(data) - start > SLICE:
        window = data[start : start + SLICE].translate(table)
        cut = window.rfind(b" ")
        end = start + SLICE
        if cut < 0:  # a word longer than a slice
            while cut < 0 and end < len(data):
                cut = data[end : end + SLICE].translate(table).find(b" ")
                end = min(len(data), end + SLICE) if cut < 0 else end + cut + 1
        else:
            end = start + cut + 1
        yield start, data[start:end]
        start = end
    yield start, data[start:]


def word_hashes(data: bytes, table: bytes):
    """Hash, first byte and byte length of every word of one text."""
    if len(data) <= SLICE:
        return _hash_slice(data, table)
    parts = [(h, s + at, n) for at, piece in _pieces(data, table) for h, s, n in [_hash_slice(piece, table)]]
    return tuple(np.concatenate(column) for column in zip(*parts))


def hashed_texts(texts, table: bytes):
    """For every text (bytes; None counts as empty), its word hashes, first bytes and lengths.

    Short texts are hashed together, as one numpy call for each would cost more
    than the work in it.
    """
    group, size = [], 0
    for text in texts:
        text = text or b""
        if group and size + len(text) > SLICE:
            yield from _hash_group(group, table)
            group, size = [], 0
        group.append(text)
        size += len(text) + 1
    if group:
        yield from _hash_group(group, table)


def _hash_group(group: list[bytes], table: bytes):
    if len(group) == 1:
        yield word_hashes(group[0], table)
        return
    begins = np.cumsum([0] + [len(t) + 1 for t in group])
    hashes, first, lengths = _hash_slice(b" ".join(group), table)
    cuts = np.searchsorted(first, begins)
    for i in range(len(group)):
        a, b = cuts[i], cuts[i + 1]
        yield hashes[a:b], first[a:b] - begins[i], lengths[a:b]


def windows(hashes: np.ndarray, width: int, seed: int = 5) -> np.ndarray:
    """Hash of every run of ``width`` consecutive words."""
    n = len(hashes) - width + 1
    total = np.zeros(max(n, 0), np.uint64)
    if n > 0:
        for k, key in enumerate(keys(width, seed)):
            total += hashes[k : k + n] * key
    return mix(total)


def text_bytes(column) -> list:
    """The values of an Arrow string column as UTF-8 bytes, None where null."""
    import pyarrow as pa

    return column.cast(pa.large_binary()).to_pylist()
