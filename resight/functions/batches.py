"""Rows of Arrow batches, a small piece at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa

# Bytes of a batch that are Python objects at a time; a row may be larger.
PIECE = 1 << 20


def by_rows(f: Callable[..., Iterable[tuple]], same: list[str], fields: list[tuple[str, pa.DataType]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow: the tuples of f(*row) for each row, as the columns `same`, of the type they come with, and the fields.

    Batches are turned to Python objects, and results to Arrow, by pieces, so memory doesn't follow the size of batches more than once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            schema = pa.schema([*(b.schema.field(c) for c in same), *fields])
            n = max(1, b.num_rows * PIECE // max(b.nbytes, 1))
            for i in range(0, b.num_rows, n):
                columns = (c.to_pylist() for c in b.slice(i, n).columns)
                if rows := [r for row in zip(*columns, strict=True) for r in f(*row)]:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return run
