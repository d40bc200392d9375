"""Vectorised word splitting and hashing shared by the text operators.

A *word* is a maximal run of bytes other than 0x20 and 0x09-0x0D, which in
UTF-8 is the same as a run of characters matching ``[^\\x20\\x09-\\x0D]+``.  All
functions work on a whole list of texts at once with numpy, so the cost per
word is a few nanoseconds and no Python object is made for a word.

Hashes are 64-bit and depend only on the content: a word is a polynomial over
its bytes modulo 2**64 with random byte values, finished with a bijective
mixer; a k-gram is a polynomial over its word hashes, finished the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_GRAM_BASES = (0xD1342543DE82EF95 | 1, 0xA0761D6478BD642F | 1)

#: Bytes of text that are taken together; hashing a longer text takes some 10 times its size, as its bytes are hashed in parts.
CHUNK_BYTES = 1 << 19

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE_VALUES = np.random.Generator(np.random.PCG64(20240607)).integers(
    1, 2**63, size=256, dtype=np.uint64
) * U64(2) + U64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n, kept and grown by doubling."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(10, (n - 1).bit_length())
        inverse = pow(base, -1, 2**64)

        def table(b: int) -> np.ndarray:
            out = np.empty(size, dtype=np.uint64)
            out[0] = 1
            done, step = 1, b
            while done < size:
                out[done : 2 * done] = out[:done] * U64(step)
                step = step * step % 2**64
                done *= 2
            return out

        have = _powers[base] = (table(base), table(inverse))
    return have[0][:n], have[1][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every input bit."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


class Words:
    """The words of a run of texts: where they lie, and their hashes.

    ``first[i]:first[i + 1]`` are the words of text i; ``starts`` and ``ends``
    are byte offsets into ``data``, in which ``text_at[i]`` is where text i
    starts.
    """

    def __init__(self, texts: list[str | bytes | None], lower: bool = False):
        raw = [
            t if isinstance(t, bytes) else (t or "").encode("utf-8", "surrogatepass") for t in texts
        ]
        self.data = b" ".join(raw) + b" "
        buf = np.frombuffer(self.data, dtype=np.uint8)
        sizes = np.fromiter((len(r) + 1 for r in raw), dtype=np.int64, count=len(raw))
        self.text_at = np.concatenate(([0], np.cumsum(sizes)))
        space = _SPACE[buf]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(buf) and not space[0]:
            edge = np.concatenate(([0], edge))
        self.starts, self.ends = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.starts, self.text_at)
        self._buf = _LOWER[buf] if lower else buf

    def hashes(self, limit: int = 1 << 20) -> np.ndarray:
        """A 64-bit hash of each word; the bytes of about ``limit`` are worked on at a time, or of one longer word."""
        out = np.empty(len(self.starts), dtype=np.uint64)
        a = 0
        while a < len(out):
            b = max(a + 1, int(np.searchsorted(self.ends, self.starts[a] + limit, side="right")))
            first, last = int(self.starts[a]), int(self.ends[b - 1])
            starts, ends, n = self.starts[a:b] - first, self.ends[a:b] - first, last - first
            power, inverse = _power_tables(_BASE, n + 1)
            total = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(_BYTE_VALUES[self._buf[first:last]] * power[:n], out=total[1:])
            own = (total[ends] - total[starts]) * inverse[starts]
            out[a:b] = mix64(own + (ends - starts).astype(np.uint64))
            a = b
        return out


def gram_hashes(words: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hash of words[i:i+k] for every i; ``which`` picks one of two independent families."""
    n = len(words)
    if n < k:
        return np.empty(0, dtype=np.uint64)
    source = words if which == 0 else mix64(words ^ U64(0x5851F42D4C957F2D))
    power, inverse = _power_tables(_GRAM_BASES[which], n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(source * power[:n], out=total[1:])
    return mix64((total[k:] - total[:-k]) * inverse[: n - k + 1])


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For each i, the position of the least of values[i:i+width], the leftmost if tied."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    at = np.arange(len(values), dtype=np.int64)
    have = 1
    while have < width:
        step = min(have, width - have)
        left, right = at[:-step], at[step:]
        at = np.where(values[right] < values[left], right, left)
        have += step
    return at[:n]


def chunks(texts: list[str | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs texts[a:b] of about ``limit`` bytes each; a longer text comes alone."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)
