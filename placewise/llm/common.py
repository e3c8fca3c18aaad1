"""What the operators share: texts of an Arrow column as one byte buffer, chunks of bounded size, staged tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

CHUNK_BYTES = 4 << 20  # text handled at once inside a task; a longer text is a chunk of its own

WHITE = np.zeros(256, bool)
WHITE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def narrow(df: DataFrame, **cols: str | Column) -> DataFrame:
    """Only the columns an operator reads, under its own names: other columns cannot clash."""
    return df.select(*((df[c] if isinstance(c, str) else c).alias(name) for name, c in cols.items()))


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes per row; null is empty."""
    return pc.fill_null(column.cast(pa.large_binary()), b"").to_pylist()


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of the column end to end, and where each begins (one more than rows); null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[starts[0]:starts[-1]], starts - starts[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``size`` bytes of text, so that memory does not follow the batch size."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        slot = np.cumsum(lengths) // size
        cuts = [0, *(np.flatnonzero(np.diff(slot)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def per_chunk(df: DataFrame, schema: str, fn: Callable[[pa.RecordBatch], dict | None], text: str = "text",
              size: int = CHUNK_BYTES) -> DataFrame:
    """``fn`` turns each slice of rows into columns; the result has ``schema``."""
    names = [part.split()[0] for part in schema.split(",")]

    def run(batches):
        for batch in chunks(batches, text, size):
            out = fn(batch)
            if out is not None:
                yield pa.RecordBatch.from_arrays([_array(out[n]) for n in names], names)

    return df.mapInArrow(run, schema)


def keep_rows(df: DataFrame, text_col: str, keep: Callable[[pa.Array], np.ndarray], size: int = CHUNK_BYTES) -> DataFrame:
    """Rows whose text passes ``keep``, with all their columns."""
    def run(batches):
        for batch in chunks(batches, text_col, size):
            yield batch.filter(pa.array(keep(batch.column(text_col)), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def _array(values) -> pa.Array:
    return values if isinstance(values, pa.Array) else pa.array(values)


def ranges(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each length, end to end."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0, dtype=np.int64) - np.repeat(ends - lengths, lengths)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit over all output bits."""
    x = np.asarray(x, np.uint64).copy()
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class RangeHash:
    """64-bit polynomial hashes of byte ranges of one buffer, all ranges at once.

    The modulus is 2**64, where odd factors have inverses, so a range's hash comes from two prefix sums. Equal ranges
    have equal hashes; the reverse can fail for texts made to that end, so who needs equality compares the bytes behind
    equal hashes (``same_ranges``).
    """

    FACTOR = 0x9E3779B97F4A7C15 | 5
    _powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if len(RangeHash._powers[0]) < n:
            up = np.full(n, self.FACTOR, np.uint64)
            down = np.full(n, pow(self.FACTOR, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            RangeHash._powers = (np.cumprod(up), np.cumprod(down))
        self.sums = np.zeros(n, np.uint64)
        terms = self.sums[1:]
        np.add(data, np.uint64(1), out=terms, dtype=np.uint64)
        terms *= RangeHash._powers[0][:n - 1]
        np.cumsum(terms, out=terms)

    def windows(self, size: int) -> np.ndarray:
        """Hashes of all ranges of ``size`` bytes, by their start; the same values as ``of``."""
        n = max(len(self.sums) - size, 0)
        return mix((self.sums[size:] - self.sums[:n]) * RangeHash._powers[1][:n])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.empty(len(start), np.uint64)
        for at in range(0, len(start), 1 << 17):  # in parts: the steps between need no more room than one
            a, b = start[at:at + (1 << 17)], end[at:at + (1 << 17)]
            out[at:at + (1 << 17)] = mix((self.sums[b] - self.sums[a]) * RangeHash._powers[1][a])
        return out


def split_words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = WHITE) -> tuple[np.ndarray, ...]:
    """Start and end of every word (a run of bytes that are no separators) and the row it belongs to."""
    inside = ~separator[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.concatenate(([False], inside[:-1])) if len(data) else inside
    after = np.concatenate((inside[1:], [False])) if len(data) else inside
    start = np.flatnonzero(inside & (~before | first[:-1]))
    end = np.flatnonzero(inside & (~after | first[1:])) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def per_row(row: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Sum of ``weights`` (or a count) per row number."""
    if weights is None:
        return np.bincount(row, minlength=n).astype(np.int64)
    return np.rint(np.bincount(row, weights=weights, minlength=n)).astype(np.int64)


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether it occurs twice or more, and whether it is not the first of its kind."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    again, twice = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    again[order[1:][same]] = True
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice, again


def same_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray, keys: np.ndarray, at_once: int = 1 << 20) -> np.ndarray:
    """A number for each range of ``data``: two have the same number exactly if their values and their keys are equal.

    ``keys`` must be equal for equal ranges that may share a number. Each range is compared with the first one of its
    key, ``at_once`` values at a time; ranges that differ from it are told apart by their values themselves.
    """
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    head = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(keys) else np.empty(0, np.int64)
    group = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(keys))))
    number = np.empty(len(keys), np.int64)
    number[order] = group
    first = np.empty(len(keys), np.int64)
    first[order] = order[head][group]
    length = end - start
    other = length != length[first]
    todo = np.flatnonzero((first != np.arange(len(keys))) & ~other)
    total = np.concatenate(([0], np.cumsum(length[todo])))
    for low in range(0, int(total[-1]), at_once):  # a long range is compared in several parts
        high = min(low + at_once, int(total[-1]))
        a, b = np.searchsorted(total, low, side="right") - 1, np.searchsorted(total, high, side="left")
        which = todo[a:b]
        skip, stop = np.maximum(low - total[a:b], 0), np.minimum(high - total[a:b], length[which])
        inside = ranges(stop - skip) + np.repeat(skip, stop - skip)
        member = np.repeat(which, stop - skip)
        differ = data[start[member] + inside] != data[start[first[member]] + inside]
        other[member[differ]] = True
    if other.any():
        known: dict[tuple, int] = {}
        for i in np.flatnonzero(other).tolist():
            number[i] = known.setdefault((int(number[i]), data[start[i]:end[i]].tobytes()), len(head) + len(known))
    return number


def lookup_sorted(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the keys in an ascending array, and whether they are there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def crc_rest(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n
