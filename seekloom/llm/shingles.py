"""Sets of hashed word shingles, computed with numpy over many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Texts are hashed in groups of about so many bytes, which bounds the memory of a task.
GROUP_BYTES = 500_000
PART_BYTES = 1_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[_SPACE] = 0
_LANE = _rng.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: The odd factor of mix64 and its inverse modulo 2**64.
_UNMIX = np.uint64(pow(0xD6E8FEB86659FD93, -1, 2**64))


def unmix64(x: np.ndarray) -> np.ndarray:
    """The value that mix64() made x of."""
    x = x ^ (x >> np.uint64(32))
    x = x * _UNMIX
    x = x ^ (x >> np.uint64(32))
    x = x * _UNMIX
    return x ^ (x >> np.uint64(32))


_POWERS = mix64(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        _POWERS = mix64(np.arange(1, 2 * n + 1, dtype=np.uint64)) | np.uint64(1)
    return _POWERS


def _hashes(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the words of a buffer that ends in a space."""
    space = _SPACE[buffer]
    start = ~space & np.concatenate([[True], space[:-1]])
    starts = np.flatnonzero(start)
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    position = np.arange(len(buffer), dtype=np.int32)
    position -= starts.astype(np.int32)[np.maximum(np.cumsum(start, dtype=np.int32) - 1, 0)]
    position[space] = 0
    value = _BYTE[buffer] * _powers(int(position.max()) + 1)[position]
    return starts, mix64(np.add.reduceat(value, starts))


def words(datas: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and the number of words of each text."""
    buffer = np.frombuffer(b" ".join(datas) + b" ", np.uint8)
    places, hashes, at = [], [], 0
    while at < len(buffer):  # long texts in parts that end with a space
        end = min(at + PART_BYTES, len(buffer))
        while end < len(buffer) and not _SPACE[buffer[end - 1]]:
            more = np.flatnonzero(_SPACE[buffer[end : end + PART_BYTES]])
            end = end + int(more[0]) + 1 if len(more) else min(end + PART_BYTES, len(buffer))
        found, value = _hashes(buffer[at:end])
        places.append(found + at)
        hashes.append(value)
        at = end
    ends = np.cumsum([len(d) + 1 for d in datas])
    counts = np.diff(np.concatenate([[0], np.searchsorted(np.concatenate(places), ends)]))
    return np.concatenate(hashes), counts


def shingle_sets(datas: list[bytes], width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a shorter text is one shingle."""
    hashes, counts = words(datas)
    at = 0
    total = hashes * _LANE[0]
    for k in range(1, width):
        total = total[: max(0, len(hashes) - k)] + hashes[k:] * _LANE[k]
    rolled = mix64(total)
    for n in counts.tolist():
        if n >= width:
            yield np.unique(rolled[at : at + n - width + 1])
        elif n:
            yield mix64(np.array([sum(int(h) * int(_LANE[k]) for k, h in enumerate(hashes[at : at + n])) + n * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF], np.uint64))
        else:
            yield np.empty(0, np.uint64)
        at += n


def sets_of(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """Shingle sets of texts in order, A-Z lower-cased, null as empty."""
    group: list[bytes] = []
    size = 0
    for text in texts:
        data = (text or "").encode().lower()
        group.append(data)
        size += len(data)
        if size >= GROUP_BYTES:
            yield from shingle_sets(group, width)
            group, size = [], 0
    if group:
        yield from shingle_sets(group, width)
