"""64-bit hashes of any span of a byte or code-point array, by prefix sums."""

from __future__ import annotations

import numpy as np
import xxhash

_RANDOM = np.random.default_rng(20240229)
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that its powers have inverses modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: A random value for each byte; single bytes would leave the low bits of a sum poor.
_OF_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        for k, b in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """n + 1 prefix sums of uint8 data, from which :func:`span_hashes` takes any span's hash."""
    up, _ = _power_tables(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_OF_BYTE[data] * up[: len(data)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray | slice, stop: np.ndarray | slice) -> np.ndarray:
    """Hashes of data[start:stop]; equal spans have equal hashes wherever they lie."""
    _, down = _power_tables(len(sums))
    return mix((sums[stop] - sums[start]) * down[start])


_LANES = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
_LONG = 512


def word_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of the words data[start:stop], eight bytes a step, each step scrambled.

    Unlike a polynomial modulo 2**64, which any odd base lets collide on words built
    for it, no two words are known to share a hash.
    """
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    left = stop - start
    out = mix(left.astype(np.uint64) + _BASE)
    open_ = np.flatnonzero(left <= _LONG)
    at, left = start[open_], left[open_]
    while len(open_):
        out[open_] = mix((out[open_] ^ (lanes[at] & _LANES[np.minimum(left, 8)])) * _BASE)
        more = left > 8
        open_, at, left = open_[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(stop - start > _LONG):
        out[k] = xxhash.xxh3_64_intdigest(data[start[k] : stop[k]].tobytes())
    return out
