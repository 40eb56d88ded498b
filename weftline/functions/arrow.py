"""Python functions over whole Arrow arrays as Spark columns."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def arrow_column(function: Callable[..., pa.Array], returns: T.DataType, *inputs: Column | str) -> Column:
    """`function` over the Arrow arrays of `inputs`, one batch at a time: no row-wise Python call crosses the border.

    Offsets of an Arrow batch fit in 32 bits, so `function` may return list and string arrays of its own making. Types
    that differ only in width (large strings) are cast by the caller.
    """
    if len(inputs) == 1:
        def run(a: pa.Array) -> pa.Array:
            return function(a)
    elif len(inputs) == 2:
        def run(a: pa.Array, b: pa.Array) -> pa.Array:
            return function(a, b)
    else:
        def run(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
            return function(a, b, c)
    return F.arrow_udf(run, returns)(*inputs)
