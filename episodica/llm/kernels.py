"""Array kernels over Arrow text columns: words, rolling hashes and minimisers without a loop over words.

Everything works on one buffer of UTF-8 bytes with document offsets. Batches are cut into pieces of a few megabytes, so
the arrays stay small whatever the batch holds; a long document is cut into pieces that overlap by what a window needs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
BLOCK_WORDS = 1 << 17

_random = np.random.Generator(np.random.Philox(20240229))
#: Two independent hash functions: random values of the 256 bytes and an odd multiplier (3 modulo 4) each.
_BYTE_VALUES = _random.integers(1, 2**63, size=(2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = [(int(x) << 2 | 3) & (2**64 - 1) for x in _random.integers(1, 2**61, size=2)]
_WORD_BASES = [(int(x) << 2 | 3) & (2**64 - 1) for x in _random.integers(1, 2**61, size=2)]
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: The six characters above are also what bytes.split() without arguments splits at.
LOWER_ASCII = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each; a null is an empty text."""
    column = column.cast(pa.large_binary()) if column.type != pa.large_binary() else column
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]] if len(offs) else raw[:0], offs - offs[0]


def row_pieces(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows with at most ``limit`` units each, or one row."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1)
        yield low, high
        low = high


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in batches that are small enough to hold whole texts a few times over."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a finaliser of multiply and shift steps)."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i < n."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        steps = np.full((2, size), 1, dtype=np.uint64)
        steps[0, 1:], steps[1, 1:] = np.uint64(base), np.uint64(pow(base, -1, 2**64))
        have = tuple(np.cumprod(steps, axis=1))
        if size <= 1 << 22:
            _POWERS[base] = have
    return have


class Rolling:
    """Hashes of any stretch of a sequence from one prefix sum."""

    def __init__(self, values: np.ndarray, base: int) -> None:
        power, self._inverse = _powers(base, len(values) + 1)
        self._sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * power[: len(values)], out=self._sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self._sums[ends] - self._sums[starts]) * self._inverse[starts])

    def all_of(self, length: int) -> np.ndarray:
        """The hashes of all stretches of one length."""
        n = len(self._sums) - length
        return mix((self._sums[length:] - self._sums[:n]) * self._inverse[:n]) if n > 0 else np.zeros(0, np.uint64)


def byte_hashes(data: np.ndarray, which: int = 0) -> Rolling:
    return Rolling(_BYTE_VALUES[which][data], _BASES[which])


def word_sequence_hashes(words: np.ndarray, which: int = 0) -> Rolling:
    return Rolling(words, _WORD_BASES[which])


class Words:
    """The words of some texts: spans in the buffer, word offsets of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data = data
        inside = ~IS_SPACE[data]
        starts = inside.copy()
        starts[1:] &= ~inside[:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(data))]
        starts[edges] |= inside[edges]
        ends[edges - 1] |= inside[edges - 1]
        self.starts = np.flatnonzero(starts)
        self.ends = np.flatnonzero(ends) + 1
        self.offsets = np.searchsorted(self.starts, offsets)

    def hashes(self, which: int = 0, fold_ascii: bool = False) -> np.ndarray:
        """Hash of every word; a block of words at a time, so that a very long text needs no long prefix sums."""
        out = np.empty(len(self.starts), dtype=np.uint64)
        for at in range(0, len(out), BLOCK_WORDS):
            starts, ends = self.starts[at : at + BLOCK_WORDS], self.ends[at : at + BLOCK_WORDS]
            data = self.data[starts[0] : ends[-1]]
            data = np.frombuffer(LOWER_ASCII, np.uint8)[data] if fold_ascii else data
            out[at : at + BLOCK_WORDS] = byte_hashes(data, which)(starts - starts[0], ends - starts[0])
        return out


def shingles(words: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word stretches that lie in one text, in order, with offsets by text.

    A text with fewer words gives its whole sequence as one; a text without words gives none.
    """
    counts = np.diff(offsets)
    rolling = word_sequence_hashes(words)
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    out = np.concatenate([[0], np.cumsum(n)])
    starts = np.arange(out[-1]) - np.repeat(out[:-1] - offsets[:-1], n)
    length = np.repeat(np.where(counts >= k, k, counts), n)
    return rolling(starts, starts + length), out


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` neighbouring values, by doubling."""
    span, low = 1, values
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = width - span
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


_PLACE_BITS = 24


def minimiser_runs(grams: np.ndarray, offsets: np.ndarray, window: int, gram: int):
    """Runs of consecutive windows of one text that share their minimiser.

    grams: hashes of the stretches of ``gram`` units that start at each unit. The minimiser of a window is the leftmost
    stretch in it with the smallest upper hash bits, which depends on the content of the window alone. Returns arrays
    (text, first window start, last window start + 1, place of the minimiser).
    """
    n = int(offsets[-1])
    empty = np.zeros(0, np.int64)
    if n < window or len(grams) < window - gram + 1:
        return empty, empty, empty, empty
    place = np.arange(len(grams), dtype=np.uint64)
    keys = (grams >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | place
    best = (sliding_minimum(keys, window - gram + 1) & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    lengths = np.diff(offsets)
    has = lengths >= window
    n_windows = np.where(has, lengths - window + 1, 0)
    total = int(n_windows.sum())
    if not total:
        return empty, empty, empty, empty
    text = np.repeat(np.arange(len(lengths)), n_windows)
    first = np.cumsum(n_windows) - n_windows
    starts = np.arange(total) - np.repeat(first - offsets[:-1], n_windows)
    at = best[starts]
    new = np.ones(total, dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], total)
    return text[begin], starts[begin], starts[end - 1] + 1, at[begin]


def spans_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges[::2], edges[1::2]


def mark(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """True where one of the spans covers a place below n."""
    depth = np.zeros(n + 1, dtype=np.int64)
    np.add.at(depth, np.asarray(starts, dtype=np.int64), 1)
    np.add.at(depth, np.asarray(ends, dtype=np.int64), -1)
    return np.cumsum(depth[:n]) > 0
