"""Results as a stream of batches that can be taken up again."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from wideleaf.errors import InvalidArgument

#: Fixed value: what a batch holds, about.
BATCH_BYTES = 1 << 20


@dataclass(frozen=True)
class Batch:
    """Rows as an Arrow stream, the CRC-32 of these bytes, and the token of the place after them: how many rows came before it."""

    data: bytes
    checksum: int
    token: bytes

    def table(self) -> pa.Table:
        if zlib.crc32(self.data) != self.checksum:
            raise InvalidArgument("a batch was damaged")
        with pa.ipc.open_stream(self.data) as stream:
            return stream.read_all()

    def rows(self) -> list[dict]:
        return self.table().to_pylist()


def _packing(schema: pa.Schema, size: int):
    """Rows of a partition to Arrow streams of about ``size`` bytes: (rows, data).  Executors run it without this package."""

    def packed(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def widths(column):
            if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
                return pc.fill_null(pc.binary_length(column), 16).to_numpy(zero_copy_only=False).astype(np.int64)
            return max(16, column.nbytes // len(column))

        def made():
            table = pa.Table.from_batches(held)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, schema) as out:
                out.write_table(pa.Table.from_arrays([c if c.type == f.type else c.cast(f.type) for c, f in zip(table.columns, schema)], schema=schema))
            return pa.RecordBatch.from_arrays([pa.array([len(table)], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["n", "data"])

        held, width = [], 0
        for batch in batches:
            n, start, done = batch.num_rows, 0, 0
            ends = np.cumsum(sum((widths(c) for c in batch.columns), np.zeros(n, np.int64))) if n else []
            while start < n:
                last = int(np.searchsorted(ends, done + size - width))  # with this row the batch is full
                stop = min(last + 1, n)
                held.append(batch.slice(start, stop - start))
                width += int(ends[stop - 1]) - done
                start, done = stop, int(ends[stop - 1])
                if last < n:
                    yield made()
                    held, width = [], 0
        if held:
            yield made()

    return packed


def stream(result: DataFrame, token: bytes = b"", *, size: int = BATCH_BYTES) -> Iterator[Batch]:
    """The rows of a result in its order, from the place of ``token`` on; ``result`` must be ordered (as ``run`` returns it), or its
    places mean nothing.  Executors make the batches and the driver fetches those of one partition at a time.  A place is found by
    the partitions' numbers of rows: an offset in the plan would bring all rows to one task, in the order in which they arrive."""
    if token and not token.isdigit():
        raise InvalidArgument("not a token")
    place = int(token or 0)
    schema = to_arrow_schema(result.schema)
    spark = result.sparkSession.sparkContext
    # One RDD for all jobs below, so that they see the same partitions.
    parts = result.toDF(*[f"c{k}" for k in range(len(result.columns))]).mapInArrow(_packing(schema, size), "n long, data binary").rdd
    before = place
    for k, n in enumerate(parts.mapPartitions(lambda rows: [sum(r.n for r in rows)]).collect() if place else [None] * parts.getNumPartitions()):
        if n is not None and n <= before:
            before -= n
            continue
        for r in spark.runJob(parts, lambda rows: rows, [k]):
            data = bytes(r.data)
            if before >= r.n:
                before -= r.n
                continue
            if before:
                with pa.ipc.open_stream(data) as found:
                    rest = found.read_all().slice(before)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, schema) as out:
                    out.write_table(rest)
                data = sink.getvalue().to_pybytes()
            place += r.n - before
            before = 0
            yield Batch(data, zlib.crc32(data), b"%d" % place)
