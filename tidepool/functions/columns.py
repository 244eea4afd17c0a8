"""Column-expression helpers (all JVM-side, codegen friendly)."""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# what runs in Python workers travels by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Machine epsilon of float64, used as the normaliser's denominator guard.
FLOAT64_EPS = 2.220446049250313e-16
# Largest finite float64, the clamp for +/-Inf in nan_to_zero.
FLOAT64_MAX = 1.7976931348623157e308


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_numeric_type(dt: T.DataType) -> bool:
    """Numeric class of the reference: ints and floats; bool and timestamps are not numeric."""
    return isinstance(dt, T.NumericType)


def is_string_type(dt: T.DataType) -> bool:
    return isinstance(dt, T.StringType)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric_type(f.dataType) and f.name not in exclude]


def string_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if is_string_type(f.dataType) and f.name not in exclude]


def nonfinite_to_null(c: str | Column) -> Column:
    x = col(c).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(None).cast("double")).otherwise(x)


def nan_to_null(c: str | Column) -> Column:
    x = col(c)
    return F.when(F.isnan(x), F.lit(None)).otherwise(x)


def list_matrix(column) -> np.ndarray:
    """The lists of an Arrow column, all of one length, as the rows of a matrix; a null element is NaN."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def known_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with NaN as null in those of ``columns`` that hold floats: NaN is a missing number, not a value."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    floats = {c for c in columns if isinstance(kinds.get(c), (T.DoubleType, T.FloatType))}
    return df.withColumns({c: nan_to_null(c) for c in floats}) if floats else df


def stack_columns(df: DataFrame, columns: Sequence[str], name_col: str = "column", value_col: str = "value",
                  keep: Sequence[str] = (), cast: str | None = "double") -> DataFrame:
    """Long form (keep..., column, value) of ``columns`` (the SQL ``UNPIVOT``), nulls kept."""
    if not columns:
        raise ValueError("no columns to stack")
    vals = [(col(c).cast(cast) if cast else col(c)) for c in columns]
    pairs = F.array(*[F.struct(F.lit(c).alias(name_col), v.alias(value_col)) for c, v in zip(columns, vals)])
    return df.select(*keep, F.inline(pairs))
