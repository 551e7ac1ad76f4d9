"""Folds over ordered rows of a key, for results that depend on the whole path before them.

Keys are dealt over tasks and sorted there; a task streams through its rows and holds one key's state, never one
key's rows. Null keys are a key of their own, and values arrive as Python's own, null as ``None``.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def arrow_type(kind: T.DataType) -> pa.DataType:
    """The Arrow type in which Spark takes values of a type, nested ones included."""
    plain = {
        T.ByteType: pa.int8(), T.ShortType: pa.int16(), T.IntegerType: pa.int32(), T.LongType: pa.int64(), T.FloatType: pa.float32(), T.DoubleType: pa.float64(),
        T.StringType: pa.string(), T.BinaryType: pa.binary(), T.BooleanType: pa.bool_(), T.DateType: pa.date32(), T.TimestampType: pa.timestamp("us", tz="UTC"), T.TimestampNTZType: pa.timestamp("us"),
    }
    if isinstance(kind, T.DecimalType):
        return pa.decimal128(kind.precision, kind.scale)
    if isinstance(kind, T.ArrayType):
        return pa.list_(arrow_type(kind.elementType))
    if isinstance(kind, T.MapType):
        return pa.map_(arrow_type(kind.keyType), arrow_type(kind.valueType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, arrow_type(f.dataType)) for f in kind.fields])
    return plain[type(kind)]


def _key(value: Any) -> Any:
    """A key's value so that one that is not a number equals itself."""
    return "NaN" if isinstance(value, float) and value != value else value


def folded(df: DataFrame, by: list[str], order: list[str], start: Callable[[], Any], step: Callable[[Any, Any], list[tuple]], schema: str, finish: Callable[[Any], list[tuple]] | None = None) -> DataFrame:
    """Rows that ``step(state, row)`` gives for the rows of each key in order; ``start()`` makes a key's first state.

    ``finish(state)`` gives the rows that follow a key's last one. ``schema`` is a DDL text.
    """
    fields = T.StructType.fromDDL(schema).fields
    names, kinds = [f.name for f in fields], [arrow_type(f.dataType) for f in fields]
    Row = namedtuple("Row", df.columns, rename=True)
    places = [df.columns.index(k) for k in by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names)

        for b in batches:
            out: list[tuple] = []
            for values in zip(*(c.to_pylist() for c in b.columns)):
                k = [_key(values[p]) for p in places]
                if k != key:
                    if key is not None and finish:
                        out += finish(state)
                    key, state = k, start()
                out += step(state, Row._make(values))
            yield batch(out)
        if key is not None and finish:
            yield batch(finish(state))

    return df.repartition(*(F.col(k) for k in by)).sortWithinPartitions(*by, *order).mapInArrow(run, schema)
