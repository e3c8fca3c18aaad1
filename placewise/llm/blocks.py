"""Documents in blocks of bounded size: one row holds some megabytes of whole rows, compressed.

Operators that compare every text with all others read the texts several times. A block is written once and moved as one
row; what a block sends out and gets back (counts, positions) is keyed by its number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from placewise.llm import common as C
from placewise.session import stage


def pack(table: pa.Table | pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 9))) as out:
        out.write(table)
    return sink.getvalue().to_pybytes()


def unpack(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all().combine_chunks()


def planes(numbers: np.ndarray) -> bytes:
    """The first bytes of all 64-bit integers, then the second ones and so on: small numbers compress well."""
    return np.ascontiguousarray(numbers.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(raw: bytes | np.ndarray) -> np.ndarray:
    flat = np.frombuffer(raw, np.uint8)
    return np.ascontiguousarray(flat.reshape(8, len(flat) // 8).T).view(np.int64).ravel()


def squeeze(numbers: np.ndarray, ascend: bool = True) -> bytes:
    """64-bit integers, small if they ascend; with ``ascend`` off, if they are small themselves."""
    raw = planes(np.diff(numbers.astype(np.int64), prepend=np.int64(0)) if ascend else numbers)
    return len(numbers).to_bytes(8, "little") + pa.Codec("zstd").compress(raw, asbytes=True)


def expand(blob: bytes, ascend: bool = True) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    numbers = from_planes(pa.Codec("zstd").decompress(blob[8:], n * 8, asbytes=True))
    return np.cumsum(numbers) if ascend else numbers


def block_tables(batches: Iterator[pa.RecordBatch], text_col: str, size: int) -> Iterator[tuple[int, int, pa.Table]]:
    """Number, bytes of text and rows of each block that a task makes of its rows."""
    made, held, held_bytes = 0, [], 0

    def block():
        return TaskContext.get().partitionId() << 32 | made, held_bytes, pa.Table.from_batches(held).combine_chunks()

    for chunk in C.chunks(batches, text_col, max(size // 4, 1)):
        length = int(C.text_buffer(chunk.column(text_col))[1][-1])
        if held and held_bytes + length > size:
            yield block()
            made, held, held_bytes = made + 1, [], 0
        held.append(chunk)
        held_bytes += length
    if held:
        yield block()


def pack_blocks(df: DataFrame, text_col: str, size: int, sort_by: str | None = None) -> DataFrame:
    """(block, n_bytes, rows), written to the shared folder: every row of ``df`` is in one block of about ``size`` bytes
    of text (a longer text is a block of its own), in ascending order of ``sort_by``."""
    def run(batches: Iterator[pa.RecordBatch]):
        for number, held_bytes, table in block_tables(batches, text_col, size):
            if sort_by:
                table = table.sort_by(sort_by).combine_chunks()
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([held_bytes]), pa.array([pack(table)])],
                                             ["block", "n_bytes", "rows"])

    return stage(df.mapInArrow(run, "block long, n_bytes long, rows binary"), "blocks")


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Number and rows of each block."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column("block")[i].as_py(), unpack(batch.column("rows")[i].as_py())
