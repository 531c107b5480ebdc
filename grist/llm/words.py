"""Vectorised word and shingle hashing over batches of whole texts.

Texts are handled as UTF-8 bytes; a word is a maximal run of bytes for which a
256-entry table is true, so a definition that keeps every non-ASCII character
(as all of this library's do) is exact on bytes.  Word hashes are 64-bit
polynomial hashes with a random value per byte, finished by a bit mixer, and
depend on the word alone.  A null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C13 | 3
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.int64).astype(U64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Words are runs of anything but space, tab, LF, VT, FF, CR.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Words are runs of 0-9, a-z and every non-ASCII character (after lower-casing).
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        inverse = pow(_BASE, -1, 1 << 64)
        _powers[:] = [np.multiply.accumulate(np.concatenate([[U64(1)], np.full(size - 1, b, dtype=U64)])) for b in (_BASE, inverse)]
    return _powers[0][:n], _powers[1][:n]


class Words:
    """Words of several texts: hashes, the text each belongs to and byte spans."""

    def __init__(self, texts: Sequence[str | None], kept: np.ndarray):
        raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
        self.buf = _LOWER[np.frombuffer(b" ".join([*raw, b""]) or b" ", dtype=np.uint8)]
        self.text_start = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])]).astype(np.int64)[: len(raw)]
        mask = np.concatenate([[False], kept[self.buf], [False]])
        edge = np.flatnonzero(mask[1:] != mask[:-1])
        self.start, self.end = edge[0::2], edge[1::2]
        power, inverse = _power_table(len(self.buf) + 1)
        total = np.concatenate([[U64(0)], np.cumsum(_BYTE[self.buf] * power[: len(self.buf)])])
        self.hash = mix((total[self.end] - total[self.start]) * inverse[self.start])
        self.first = np.searchsorted(self.start, np.concatenate([self.text_start, [len(self.buf) + 1]]))
        self.text = np.repeat(np.arange(len(raw)), np.diff(self.first))

    def count(self, i: int) -> int:
        return int(self.first[i + 1] - self.first[i])


def slices(sizes: Sequence[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows with a total size of at most ``most`` (one row at least)."""
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def shingle_sets(words: Words, k: int) -> list[np.ndarray]:
    """Per text its set of k-word shingles as sorted 64-bit hashes; with fewer words the whole sequence is the one shingle."""
    n = len(words.hash)
    h = np.zeros(max(n, 1), dtype=U64)[:n]
    rolled = np.zeros(max(0, n - k + 1), dtype=U64)
    for j in range(k):
        rolled = mix(rolled * U64(_BASE) + words.hash[j : n - k + 1 + j] + U64(j + 1)) if len(rolled) else rolled
    h[: len(rolled)] = rolled
    out = []
    for a, b in zip(words.first[:-1], words.first[1:]):
        if b - a >= k:
            out.append(np.unique(h[a : b - k + 1]))
        elif b > a:
            v = np.zeros(1, dtype=U64)
            for j in range(a, b):
                v = mix(v * U64(_BASE) + words.hash[j : j + 1] + U64(j - a + 1))
            out.append(mix(v + U64(b - a)))
        else:
            out.append(np.empty(0, dtype=U64))
    return out
