"""Vectorised words, lines and rolling hashes over the raw UTF-8 buffers of Arrow string columns.

Every operator that has to look inside long texts starts here: a batch is cut into runs of whole
documents of at most ``max_bytes`` (one longer document is a run of its own), and words, lines and their
64-bit hashes come out of a handful of numpy passes, without a Python object per word.

Null texts count as empty. Hashes are polynomials over random byte values modulo 2^64, finished with a
mixing function, so equal words have equal hashes wherever they are computed.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_RNG = np.random.default_rng(20240611)
#: a random value for each byte
BYTE = _RNG.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE_LOWER = BYTE[LOWER]
_BASE = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(int(_BASE), -1, 2**64))
#: odd multipliers for the positions of a window
STEPS = _RNG.integers(1, 2**63, 64, dtype=np.int64).astype(U64) * U64(2) + U64(1)

#: words `[^\x20\x09-\x0D]+`
PLAIN = np.ones(256, dtype=bool)
PLAIN[[0x20, *range(0x09, 0x0E)]] = False
#: words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased text
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x41:0x5B] = ALNUM[0x80:] = True

try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None

_powers = (np.ones(1, U64), np.ones(1, U64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2^64."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, _BASE), np.full(size, _INVERSE)
        up[0] = down[0] = 1
        _powers = (np.cumprod(up), np.cumprod(down))
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def release() -> None:
    """Give freed memory back to the system; a worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


class Run:
    """Whole documents lying one behind the other in one byte buffer."""

    __slots__ = ("data", "offs", "first", "n", "_sums")

    def __init__(self, data: np.ndarray, offs: np.ndarray, first: int = 0):
        self.data, self.offs, self.first, self.n = data, offs, first, len(offs) - 1
        self._sums: dict[bool, np.ndarray] = {}

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sum over each document of a value per byte."""
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[self.offs[1:]] - sums[self.offs[:-1]]

    def words(self, table: np.ndarray) -> Words:
        return Words(self, table)

    def prefix(self, lower: bool) -> np.ndarray:
        """Rolling prefix hash of the buffer."""
        if lower not in self._sums:
            v = (BYTE_LOWER if lower else BYTE)[self.data]
            v *= powers(len(v))[0]
            sums = np.zeros(len(v) + 1, U64)
            np.cumsum(v, out=sums[1:])
            self._sums[lower] = sums
        return self._sums[lower]

    def rest(self) -> Run:
        """The run without the prefix hashes that it has made."""
        self._sums.clear()
        return self

    def span_hash(self, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
        """64-bit hash of each byte span; the hash of an empty span is that of no bytes."""
        sums = self.prefix(lower)
        inverse = powers(len(sums))[1]
        h = (sums[ends] - sums[starts]) * inverse[starts]
        return mix(h + (ends - starts).astype(U64) * STEPS[63])

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r"""Starts, ends and documents of the \n-split lines of each document; an empty document has one."""
        breaks = np.flatnonzero(self.data == 10)
        starts = np.sort(np.concatenate([self.offs[:-1], breaks + 1]), kind="stable")
        ends = np.sort(np.concatenate([self.offs[1:], breaks]), kind="stable")
        per = 1 + np.searchsorted(breaks, self.offs[1:]) - np.searchsorted(breaks, self.offs[:-1])
        return starts, ends, np.repeat(np.arange(self.n), per)


class Words:
    """Maximal runs of word bytes, none of which crosses from one document to the next."""

    __slots__ = ("run", "starts", "ends", "offs", "is_word")

    def __init__(self, run: Run, table: np.ndarray):
        self.run = run
        flags = table[run.data]
        n = len(flags)
        before = np.empty(n, bool)
        if n:
            before[0] = False
            before[1:] = flags[:-1]
            edges = run.offs[:-1][run.offs[:-1] < n]
            before[edges] = False
            starts = np.flatnonzero(flags & ~before)
            after = np.empty(n, bool)
            after[-1] = False
            after[:-1] = flags[1:]
            edges = run.offs[1:][run.offs[1:] > 0] - 1
            after[edges] = False
            ends = np.flatnonzero(flags & ~after) + 1
        else:
            starts = ends = np.zeros(0, np.int64)
        self.is_word, self.starts, self.ends = flags, starts, ends
        self.offs = np.searchsorted(starts, run.offs)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offs)

    @property
    def docs(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(self.run.n), self.counts)

    def hashes(self, lower: bool) -> np.ndarray:
        return self.run.span_hash(self.starts, self.ends, lower)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive values; it's as long as h less k - 1."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, U64)
    out = h[:m] * STEPS[0]
    for j in range(1, k):
        out += h[j : j + m] * STEPS[j]
    return mix(out)


def inside(offs: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of the n - k + 1 windows of k words don't cross a document's end."""
    m = n - k + 1
    if m <= 0:
        return np.zeros(0, bool)
    good = np.ones(m, bool)
    for j in range(1, k):
        cut = offs[1:-1] - j
        cut = cut[(cut >= 0) & (cut < m)]
        good[cut] = False
    return good


def runs(texts: pa.Array | pa.ChunkedArray, max_bytes: int = 1 << 21) -> Iterator[Run]:
    """Cut a string column into runs; ``first`` is the row of a run's first document."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    n = len(texts)
    if not n:
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, at, body = texts.buffers()
    offs = np.frombuffer(at, np.int64 if wide else np.int32, n + 1, texts.offset * (8 if wide else 4)).astype(np.int64)
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + max_bytes, side="right")) - 1)
        j = min(j, n)
        yield Run(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], i)
        i = j


def as_text(t: pa.DataType) -> bool:
    return pa.types.is_string(t) or pa.types.is_large_string(t)
