"""Word shingle sets of whole texts as 64-bit hashes, vectorised over a batch."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_RNG = np.random.default_rng(6_174)
_TABLE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = int(_RNG.integers(1 << 61, 1 << 62)) * 4 + 3
_POWERS: list[np.ndarray] = []
_GAP = re.compile(rb"[\t-\r ]")
#: Bytes that are hashed at once, up to the end of the word there.
PIECE = 300_000


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        _POWERS[:] = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _POWERS.append(np.cumprod(p))
    return _POWERS[0], _POWERS[1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(31))) * U(0x7FB5D329728EA185)
    h = (h ^ (h >> U(27))) * U(0x81DADEF4BC2DD44D)
    return h ^ (h >> U(33))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word (run without ASCII white space) of ``data``; long texts go in pieces, which bounds the memory beside the result."""
    hashes, starts, at = [], [], 0
    while at < len(data) or not hashes:
        gap = _GAP.search(data, at + PIECE)
        end = gap.end() if gap else len(data)
        h, s = _hashed(data[at:end])
        hashes.append(h)
        starts.append(s + at)
        at = end
    return np.concatenate(hashes), np.concatenate(starts)


def _hashed(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(data, np.uint8)
    gap = np.concatenate(([True], _SPACE[raw], [True]))
    starts = np.flatnonzero(gap[:-1] & ~gap[1:])
    ends = np.flatnonzero(~gap[:-1] & gap[1:])
    power, inverse = _powers(len(raw) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_TABLE[raw] * power[: len(raw)])))
    return _mix((total[ends] - total[starts]) * inverse[starts]), starts


def shingle_sets(texts: list[str | None], k: int, piece_bytes: int = PIECE) -> Iterator[np.ndarray]:
    """The sorted distinct ``k``-word shingles of each text, A-Z lower-cased; a shorter text's words are one shingle, none give an empty set."""
    at = 0
    while at < len(texts):
        part, size = [], 0
        while at < len(texts) and (not part or size < piece_bytes):
            part.append((texts[at] or "").encode("utf-8", "replace").lower())
            size += len(part[-1]) + 1
            at += 1
        words, starts = word_hashes(b"\n".join(part))
        edges = np.searchsorted(starts, np.cumsum([0] + [len(p) + 1 for p in part]))
        n = len(words) - k + 1
        if n > 0:
            mixed = np.zeros(n, np.uint64)
            for j in range(k):
                mixed = _mix(mixed + words[j : j + n])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if b - a >= k:
                yield np.unique(mixed[a : b - k + 1])
            elif b > a:
                h = np.array([b - a], np.uint64)  # the length first: no shingle of k words begins so
                for w in words[a:b]:
                    h = _mix(h + w)
                yield h
            else:
                yield np.empty(0, np.uint64)
