"""Moving rows between Spark and the pure-Python core in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..core.budgets import BudgetExceededError

#: Rows of output that one Arrow batch holds, about; so that long documents do not pile up in a worker.
OUT_ROWS = 10_000
#: Rows of a batch that are Python values at one time in a column function; the others are Arrow, many times smaller.
SLICE_ROWS = 64


def schema_of(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)


def spread(df: DataFrame) -> DataFrame:
    """Deal rows over all cores if the input has fewer partitions than cores; a large input is left as it is split."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def generate(df: DataFrame, inputs: list[Column], keys: list[str], ddl: str, rows_of: Callable[..., Iterable[tuple]]) -> DataFrame:
    """Map-only generator: for each row, the key columns with each tuple that ``rows_of(*inputs)`` gives.

    Tuples have the fields of ``ddl``; structs inside them are tuples, too. Rows whose first input is null give nothing.
    """
    made = schema_of(ddl)
    names = [f"_in{i}" for i in range(len(inputs))]
    picked = df.select(*keys, *[c.alias(n) for c, n in zip(inputs, names, strict=True)])
    schema = T.StructType([*picked.schema.fields[: len(keys)], *made.fields])
    arrow = [f.type for f in to_arrow_schema(made)]
    fields = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(len(keys) + i) for i in range(len(names))]
            rows: list[tuple] = []
            owner: list[int] = []

            def out():
                index = pa.array(np.array(owner, np.int64))
                kept = [batch.column(i).take(index) for i in range(len(keys))]  # noqa: B023
                made_columns = zip(*rows, strict=True) if rows else [[]] * len(arrow)  # noqa: B023
                return pa.RecordBatch.from_arrays([*kept, *(build(c, t) for c, t in zip(made_columns, arrow, strict=True))], names=fields)

            for i in range(batch.num_rows):
                values = [c[i].as_py() for c in columns]
                if values[0] is None:
                    continue
                before = len(rows)
                rows.extend(rows_of(*values))
                owner += [i] * (len(rows) - before)
                if len(rows) >= OUT_ROWS:
                    yield out()
                    rows, owner = [], []
            if rows:
                yield out()

    return picked.mapInArrow(run, schema)


def build(values, kind: pa.DataType) -> pa.Array:
    """An Arrow array of values in which structs are tuples, built column by column."""
    if pa.types.is_list(kind):
        offsets, flat, nulls = [0], [], []
        for v in values:
            nulls.append(v is None)
            if v:
                flat.extend(v)
            offsets.append(len(flat))
        mask = pa.array(nulls) if any(nulls) else None
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), build(flat, kind.value_type), type=kind, mask=mask)
    if pa.types.is_struct(kind):
        nulls = [v is None for v in values]
        blank = (None,) * kind.num_fields
        columns = zip(*[blank if v is None else v for v in values], strict=True) if len(nulls) else [[]] * kind.num_fields
        arrays = [build(c, kind.field(i).type) for i, c in enumerate(columns)]
        return pa.StructArray.from_arrays(arrays, fields=list(kind), mask=pa.array(nulls) if any(nulls) else None)
    try:
        return pa.array(values, kind)
    except UnicodeEncodeError:  # half of a surrogate pair
        return pa.array([v if v is None else v.encode("utf-16", "surrogatepass").decode("utf-16", "replace") for v in values], kind)


def scalar(ddl: str, function: Callable):
    """An Arrow UDF of a function of one row's values; a null in the first argument gives null.

    The result may be a tuple for a struct, a list for an array. A worker holds a few rows of a batch as Python values.
    """
    kind = schema_of(f"x {ddl}")
    arrow = to_arrow_schema(kind).field(0).type

    def part(columns: list[list]) -> pa.Array:
        return build([None if row[0] is None else function(*row) for row in zip(*columns, strict=True)], arrow)

    def run(*columns: pa.Array) -> pa.Array:
        parts = [part([c.slice(at, SLICE_ROWS).to_pylist() for c in columns]) for at in range(0, len(columns[0]), SLICE_ROWS)]
        return pa.concat_arrays(parts) if parts else build([], arrow)

    def one(a: pa.Array) -> pa.Array:
        return run(a)

    def two(a: pa.Array, b: pa.Array) -> pa.Array:
        return run(a, b)

    return F.arrow_udf(one, kind[0].dataType), F.arrow_udf(two, kind[0].dataType)


def budget_error(error: BudgetExceededError) -> tuple:
    p = error.payload
    return p["code"], p["budget"], p["limit"], p["actual"]
