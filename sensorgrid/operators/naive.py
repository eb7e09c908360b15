"""Range queries by a plain loop: what the engine's own predicate is tested against."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from sensorgrid.query import RangeQuery


def kept(captures: DataFrame, query: RangeQuery) -> DataFrame:
    """The captures that lie in all ranges, each looked at by itself."""
    ranges = [(column, r) for _, column, _, _, r in query.ranges()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(column).to_pylist() for column, _ in ranges]
            found = []
            for i, values in enumerate(zip(*columns, strict=True)):
                if all(v is not None and low <= v <= high for v, (_, (low, high)) in zip(values, ranges, strict=True)):
                    found.append(i)
            yield batch.take(pa.array(found, pa.int64()))

    return captures.mapInArrow(run, captures.schema)
