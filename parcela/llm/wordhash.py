"""Vectorised 64-bit hashes of the words of UTF-8 texts, with A-Z lower-cased."""

from __future__ import annotations

import numpy as np

_BYTE = np.arange(256, dtype=np.uint64) + np.uint64(1)
_BYTE[65:91] += np.uint64(32)
#: The ASCII white space of the contracts.
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
P = 0x9E3779B97F4A7C15
RUN = 1 << 17
_P_INVERSE = pow(P, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    with np.errstate(over="ignore"):
        step = 1
        while step < n:  # doubling
            m = min(step, n - step)
            out[step : step + m] = out[:m] * np.uint64(pow(base, step, 1 << 64))
            step *= 2
    return out


class WordHasher:
    """A word's hash is that of its bytes as a polynomial modulo 2^64, from prefix sums, mixed."""

    def __init__(self, separators: np.ndarray = SPACE):
        self.separators = separators
        self.up = self.down = np.ones(0, np.uint64)

    def bounds(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each word."""
        edge = np.diff(np.concatenate([[True], self.separators[data], [True]]).view(np.int8))
        return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)

    def hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of the words data[starts:ends], in runs of about RUN bytes, so that memory doesn't follow the text's length."""
        out, i = np.empty(len(starts), np.uint64), 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(starts, starts[i] + RUN)))
            low = starts[i]
            out[i:j] = self._run(data[low : ends[j - 1]], starts[i:j] - low, ends[i:j] - low)
            i = j
        return out

    def _run(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(data)
        if len(self.up) < n:
            self.up, self.down = _powers(P, max(n, 2 * RUN)), _powers(_P_INVERSE, max(n, 2 * RUN))
        with np.errstate(over="ignore"):
            total = np.empty(n + 1, np.uint64)
            total[0] = 0
            np.cumsum(_BYTE[data] * self.up[:n], out=total[1:])
            return mix((total[ends] - total[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))
