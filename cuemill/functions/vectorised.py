"""Python functions as columns: rows travel in Arrow batches, never one by one."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def vectorised(call: Callable, returns: str) -> Callable[..., Column]:
    """A column function out of a function over one row's values; arrays arrive as lists, nulls as None."""

    def plain(value):
        if value is None or value is pd.NA or isinstance(value, float) and value != value:
            return None
        return [plain(x) for x in value] if hasattr(value, "tolist") and getattr(value, "ndim", 0) else value

    def batch(*columns: pd.Series) -> pd.Series:
        return pd.Series([call(*map(plain, row)) for row in zip(*columns, strict=True)], dtype=object)

    def column(*columns: Column) -> Column:
        batch.__annotations__ = {"columns": pd.Series, "return": pd.Series}
        return F.pandas_udf(batch, returns)(*columns)

    return column
