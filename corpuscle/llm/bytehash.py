"""Polynomial hashes of byte ranges, for many texts at once.

Texts lie one after another in a buffer; with prefix sums of ``byte * base^i`` (modulo 2^64) the hash of
any range takes a subtraction and a multiplication, and so whole columns of ranges are hashed in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        inverse = pow(base, -1, 1 << 64)
        made = []
        for b in (base, inverse):
            out = np.full(size, b, np.uint64)
            out[0] = 1
            made.append(np.multiply.accumulate(out))
        have = _POWERS[base] = (made[0], made[1])
    return have


class Ranges:
    """Hashes of ranges of one buffer under one base."""

    def __init__(self, data: np.ndarray, base: int = BASES[0]) -> None:
        n = len(data)
        up, self.down = _powers(base, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])

    def sliding(self, width: int) -> np.ndarray:
        """Of every range of ``width`` bytes."""
        n = len(self.sums) - width
        return mixed((self.sums[width:] - self.sums[:-width]) * self.down[:n]) if n > 0 else np.empty(0, np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Every bit made to depend on all; one to one."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def batches(texts: list[bytes], size: int = 1_000_000) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of texts of about ``size`` bytes (a longer text alone): first index, buffer, offsets."""
    start = 0
    while start < len(texts):
        end, held = start, 0
        while end < len(texts) and (end == start or held + len(texts[end]) <= size):
            held += len(texts[end])
            end += 1
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts[start:end]])]).astype(np.int64)
        yield start, np.frombuffer(b"".join(texts[start:end]), np.uint8), offsets
        start = end
