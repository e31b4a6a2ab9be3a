"""Words of whole texts in numpy: positions, hashes and window hashes over the bytes of an Arrow column.

A word is a maximal run of bytes other than the ASCII white space 0x09-0x0D and 0x20. Hashes are
polynomials modulo 2**64 over random byte values, taken from running sums, so that the hash of any
span costs two lookups. They are the same in every process.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

# Bytes of text that are looked at together; bounds the memory of a task. A longer text stands alone.
SLICE_BYTES = 1 << 20

BASE, WORD_BASE = 0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95
_rng = np.random.default_rng(20240611)
BYTE_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows whose texts together stay within ``limit`` bytes; one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = total[start - 1] if start else 0
            end = max(int(np.searchsorted(total, before + limit, "right")), start + 1)
            yield batch.slice(start, end - start)
            start = end


def positional(rows: DataFrame, *named: str) -> tuple[DataFrame, list[str]]:
    """``rows`` with columns _0, _1, ... that no other name clashes with, and what the ``named`` ones are called now."""
    now = {name: f"_{i}" for i, name in enumerate(rows.columns)}
    return rows.toDF(*now.values()), [now[n] for n in named]


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and where each row's begin (with the end as last entry); null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64, or those of its inverse."""
    kept = _POWERS.get((base, inverse))
    if kept is None or len(kept) < n:
        step = pow(base, -1, 2**64) if inverse else base
        kept = np.full(max(n, 1 << 16), step, np.uint64)
        kept[0] = 1
        kept = np.cumprod(kept, dtype=np.uint64)
        if len(kept) <= 2 * SLICE_BYTES:  # one very long text must not stay in memory
            _POWERS[base, inverse] = kept
    return kept[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """The bits of 64-bit integers well mixed (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def running_sums(values: np.ndarray, base: int) -> np.ndarray:
    """0, then the sums of values[i] * base**i; see ``span_hashes``."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A hash of values[start:end] that does not depend on where the span stands."""
    inverse = powers(base, len(sums), inverse=True)
    return mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


class Words:
    """The words of a text column: byte ``starts`` and ``ends``, the row ``doc`` of each, ``first`` word of each row.

    ``between`` tells the bytes that separate words, ``fold`` what each byte counts as.
    """

    def __init__(self, column: pa.Array, between: np.ndarray = WHITE, fold: np.ndarray | None = None):
        self.data, self.offsets = raw_bytes(column)
        if fold is not None:
            self.data = fold[self.data]
        solid = ~between[self.data]
        begins, finishes = solid.copy(), solid.copy()
        begins[1:] &= ~solid[:-1]
        finishes[:-1] &= ~solid[1:]
        edges = self.offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(self.data))]
        begins[edges] = solid[edges]
        finishes[edges - 1] = solid[edges - 1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)
        self.sums = running_sums(BYTE_VALUES[self.data], BASE)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.sums, self.starts, self.ends, BASE)

    def windows(self, hashes: np.ndarray, n: int, base: int = WORD_BASE) -> tuple[np.ndarray, np.ndarray]:
        """First words, and hashes, of all runs of n words inside one row."""
        starts = np.arange(max(len(hashes) - n + 1, 0))
        starts = starts[self.doc[starts] == self.doc[starts + n - 1]] if len(starts) else starts
        return starts, span_hashes(running_sums(hashes, base), starts, starts + n, base)

    def per_row(self, flags: np.ndarray) -> np.ndarray:
        """The sum of a value per word over each row."""
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return sums[self.first[1:]] - sums[self.first[:-1]]


def covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of ``size`` places lie in a run of n that begins at one of ``starts``."""
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + n, size), -1)
    return np.cumsum(steps[:-1]) > 0


def sums_between(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of values[start:end]."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[ends] - sums[starts]
