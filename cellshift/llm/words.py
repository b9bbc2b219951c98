"""Words of many texts at once, as arrays, for use inside tasks.

All of it works on one piece of a partition at a time (`pieces`), so memory follows the
piece and the longest single text, not the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

_SPACES = set(b" \t\n\v\f\r")
# Bytes as they are, but A-Z in lower case.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
# The same with everything of ASCII that is neither letter nor digit made a space.
LETTERS = bytes(
    LOWER[c] if c > 127 or chr(LOWER[c]).isalnum() and c < 128 else 32 for c in range(256)
)


def pieces(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Runs of rows whose texts have about `limit` bytes together, one row at least."""
    texts = batch.column(column).cast(pa.binary()).to_pylist()
    first, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= limit:
            yield batch.slice(first, i + 1 - first), texts[first : i + 1]
            first, size = i + 1, 0
    if first < len(texts):
        yield batch.slice(first), texts[first:]


class Words:
    """The words of some texts, split at ASCII white space.

    `joined` holds all of them with one space between, `start` and `end` are places in
    it, `count` is the number of words of each text, `doc` the text of each word.
    """

    def __init__(self, texts: list[bytes], table: bytes | None = None):
        split = [(t.translate(table) if table else t).split() for t in texts]
        self.count = np.fromiter(map(len, split), np.int64, len(split))
        self.bytes = b" ".join([b" ".join(words) for words in split if words])
        self.joined = np.frombuffer(self.bytes, np.uint8)
        gaps = np.flatnonzero(self.joined == 32)
        self.total = int(self.count.sum())
        self.start = np.concatenate([[0], gaps + 1])[: self.total].astype(np.int64)
        self.end = np.concatenate([gaps, [len(self.joined)]])[: self.total].astype(np.int64)
        self.first = np.cumsum(self.count) - self.count
        self.doc = np.repeat(np.arange(len(texts)), self.count)

    def hashes(self, longest: int | None = None) -> np.ndarray:
        """64 bits for each word, or for its first `longest` bytes."""
        if not self.total:
            return np.zeros(0, U)
        sums = prefix_sums(self.joined.astype(U) + U(1))
        end = self.end if longest is None else np.minimum(self.end, self.start + longest)
        return mix(between(sums, self.start, end) ^ (end - self.start).astype(U))

    def whole(self, n: int) -> np.ndarray:
        """For each word: whether n words of its own text start there."""
        ok = np.zeros(self.total, bool)
        if n <= self.total:
            ok[: self.total - n + 1] = self.doc[: self.total - n + 1] == self.doc[n - 1 :]
        return ok


def powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[:1] = 1
    return np.multiply.accumulate(out)


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums of values[i] * base**i modulo 2**64, from which any stretch can be hashed."""
    sums = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(len(values), _BASE), out=sums[1:])
    return sums


def between(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Equal for equal stretches, wherever they lie."""
    back = powers(len(sums), _INVERSE)
    return (sums[end] - sums[start]) * back[start]


def mix(x: np.ndarray) -> np.ndarray:
    """All bits of x spread over all bits of the result; one to one."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """For each place a hash of the n word hashes from there on; the last n - 1 are void."""
    out = np.zeros(len(hashes), U)
    m = len(hashes) - n + 1
    if m > 0:
        for i in range(n):
            out[:m] = (out[:m] + hashes[i : m + i]) * U(_BASE)
    return mix(out)


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's LONG."""
    return x.astype(U, copy=False).view(np.int64)
