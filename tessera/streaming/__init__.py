"""Interval filters on unbounded collections.

The predicates are plain column expressions, so they hold for a stream as they do for a table; a stream
against a table of intervals is a join of each batch, which ``IntervalFrame.join`` plans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators.intervals import IntervalFrame


def overlapping(stream: DataFrame, start: int, end: int, plane=None, **columns) -> DataFrame:
    """The rows of a stream that overlap one interval."""
    return IntervalFrame(stream, **columns).overlapping(start, end, plane).df


def join_batches(stream: DataFrame, table: IntervalFrame, sink: Callable[[DataFrame, int], None], **columns):
    """A stream writer that joins each batch with a table and hands the pairs to ``sink``."""
    return stream.writeStream.foreachBatch(lambda df, k: sink(IntervalFrame(df, **columns).join(table), k))
