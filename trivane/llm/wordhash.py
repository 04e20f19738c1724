"""Words of many texts as numpy arrays of 64-bit hashes, for use inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Characters of text handled at once (a longer text is a chunk of its own), and rows made Python objects at once.
CHUNK, ROWS = 1 << 18, 128

_rng = np.random.default_rng(20240501)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_ZERO = np.arange(256, dtype=np.uint8)
_ZERO[48:58] = 48
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i < n."""
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK + 4096)
        up, down = np.full(size, _BASE), np.full(size, _INVERSE)
        up[0] = down[0] = 1
        up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size > 4 * CHUNK:  # not kept: one very long text
            return up[:n], down[:n]
        _powers.update(up=up, down=down)
    return _powers["up"][:n], _powers["down"][:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each data[start:end], equal for equal bytes."""
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up, out=sums[1:])
    at = np.minimum(starts, max(len(data) - 1, 0))
    return mix((sums[ends] - sums[starts]) * down[at] + (ends - starts).astype(np.uint64))


class Words:
    """Words (runs of ASCII letters, digits and non-ASCII characters, lower case) of a list of texts.

    hashes, starts, ends (bytes in the joined data) by word; first[i]:first[i + 1]
    are the words of text i, offset[i] is where its bytes begin.
    """

    def __init__(self, texts: list[str | None], digits_alike: bool = False):
        raw = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
        self.data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
        if digits_alike:
            self.data = _ZERO[self.data]
        lengths = np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw))
        self.offset = np.concatenate(([0], np.cumsum(lengths)))
        inside = np.concatenate(([False], _WORD[self.data], [False]))
        turn = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = turn[::2], turn[1::2]
        self.hashes = span_hashes(self.data, self.starts, self.ends) if len(self.starts) else np.zeros(0, np.uint64)
        self.first = np.searchsorted(self.starts, self.offset)
        self.counts = np.diff(self.first)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, first): hashes of all k-word shingles, those of text i at first[i]:first[i + 1].

        A text of 1 to k - 1 words has one shingle of all its words.
        """
        h, n = self.hashes, len(self.hashes)
        per = np.where(self.counts >= k, self.counts - k + 1, np.minimum(self.counts, 1))
        first = np.concatenate(([0], np.cumsum(per)))
        if not n:
            return np.zeros(0, np.uint64), first
        padded = np.concatenate((h, np.zeros(k, np.uint64)))
        text = np.repeat(np.arange(len(self.counts)), per)
        at = np.arange(first[-1]) - first[text] + self.first[text]
        left = self.counts[text]
        total = np.zeros(len(at), np.uint64)
        for j in range(k):
            part = padded[at + j] * np.uint64(pow(0xD6E8FEB86659FD93, j + 1, 1 << 64))
            total += part if j == 0 else np.where(left > j, part, np.uint64(0))
        return mix(total), first


def chunks(texts: list[str | None], size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` characters."""
    begin = total = 0
    for i, t in enumerate(texts):
        total += len(t or "") + 1
        if total >= size:
            yield begin, i + 1
            begin, total = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def text_chunks(column: pa.Array) -> Iterator[tuple[int, int, list[str | None]]]:
    """(first row, row after the last, texts) of a column, in chunks that keep a task's memory small."""
    for base in range(0, len(column), ROWS):
        texts = column.slice(base, ROWS).to_pylist()
        for lo, hi in chunks(texts):
            yield base + lo, base + hi, texts[lo:hi]


def by_group(batches: Iterator[pa.RecordBatch], keys: list[str], work: Callable[[pa.Table], Iterator[pa.RecordBatch] | None]) -> Iterator[pa.RecordBatch]:
    """Call ``work`` on the rows of each run of equal keys, in a partition sorted by them.

    The caller bounds the groups; only one is held besides the current batch.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
        rows = list(zip(*cols, strict=True))
        begin = 0
        for i in range(len(rows) + 1):
            now = rows[i] if i < len(rows) else None
            previous = rows[i - 1] if i else last
            if i < len(rows) and now == previous:
                continue
            if i < len(rows):
                if i > begin:
                    held.append(batch.slice(begin, i - begin))
                if held:
                    yield from work(pa.Table.from_batches(held)) or ()
                held, begin = [], i
        held.append(batch.slice(begin))
        last = rows[-1]
    if held:
        yield from work(pa.Table.from_batches(held)) or ()


def lists_of(column) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and offsets of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(lengths)))
