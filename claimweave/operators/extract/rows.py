"""Rows of files: tuples that an extractor makes of each, given to Spark as Arrow."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from claimweave.operators.extract.limits import within

TYPES = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}


def batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Rows as Arrow; schema is of strings, ints and booleans."""
    fields = [pa.field(n, TYPES[t]) for n, t in (x.split() for x in schema.split(", "))]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, fields, strict=True)], schema=pa.schema(fields))


def mapped(files: DataFrame, of: Callable[[str, str], list[tuple]], schema: str, seconds: float, failed: Callable[[str, str], tuple] | None) -> DataFrame:
    """The rows that of gives for the path and text of each file. failed makes the one row, if any, of a file that takes longer than it may,
    from its path and the reason."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows, reason = within(seconds, lambda path=path, text=text: of(path, text or ""))
                out += rows if reason is None else [failed(path, reason)] if failed else []
            yield batch(out, schema)

    return files.mapInArrow(run, schema)
