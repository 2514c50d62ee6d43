"""Whole batches of texts as one array of code points, and hashes of all their windows."""

from __future__ import annotations

import numpy as np

_BASE = 1000003
#: The base of a second, independent hash.
SECOND_BASE = 6364136223846793005
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bit numbers whose results look random."""
    x = (x + _M1).astype(np.uint64)
    x ^= x >> _S30
    x *= _M2
    x ^= x >> _S27
    x *= _M3
    x ^= x >> _S31
    return x


_OF_CODE: list[np.ndarray] = []


def mixed_codes(codes: np.ndarray) -> np.ndarray:
    """mixed() of code points, from a table."""
    if not _OF_CODE:
        _OF_CODE.append(mixed(np.arange(0x110000, dtype=np.uint64)))
    return _OF_CODE[0][codes]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts one after another as uint32, and the n+1 places where each starts and the last ends."""
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), ends


class Powers:
    """Powers of a hash's base and of its inverse, grown on demand; kept for a process."""

    known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @classmethod
    def upto(cls, n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
        up, _ = cls.known.get(base, (np.ones(1, np.uint64),) * 2)
        if len(up) < n:
            size = max(n, 2 * len(up))
            cls.known[base] = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, x, np.uint64)]), dtype=np.uint64) for x in (base, pow(base, -1, 1 << 64)))
        return cls.known[base]


class WindowHashes:
    """Hashes of any stretch of an array of numbers, by prefix sums modulo 2**64. Hashes of different bases are independent."""

    def __init__(self, codes: np.ndarray, base: int = _BASE) -> None:
        up, self.down = Powers.upto(len(codes) + 1, base)
        self.sums = np.empty(len(codes) + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum(mixed_codes(codes) * up[: len(codes)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each [start, end)."""
        return mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def quick(self, width: int) -> np.ndarray:
        """A cheaper hash of each window of this width, by start; only its upper bits are good."""
        n = max(len(self.sums) - width, 0)
        x = (self.sums[width:] - self.sums[:n]) * self.down[:n]
        x ^= x >> _S31
        x *= _M2
        return x

    def quick_at(self, starts: np.ndarray, width: int) -> np.ndarray:
        """quick() of the windows that begin at some places."""
        x = (self.sums[starts + width] - self.sums[starts]) * self.down[starts]
        x ^= x >> _S31
        x *= _M2
        return x

    def all(self, width: int) -> np.ndarray:
        """Hash of each window of this width, by start."""
        n = max(len(self.sums) - width, 0)
        return mixed((self.sums[width:] - self.sums[:n]) * self.down[:n])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each window, by start, in log(width) passes."""
    if len(x) < width:
        return x[:0]
    have, m = 1, x
    while 2 * have <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    if have < width:
        d = width - have
        m = np.minimum(m[:-d], m[d:])
    return m
