"""Pandas UDFs made when they are first used, so that importing a module needs no session."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


class ArrowFunction:
    """A function over Arrow batches of columns that becomes a pandas UDF in the session that calls it."""

    def __init__(self, function: Callable, returns: str):
        self.function, self.returns, self.__doc__ = function, returns, function.__doc__

    def udf(self):
        return F.pandas_udf(self.function, self.returns)

    def __call__(self, *columns: Column | str) -> Column:
        return self.udf()(*columns)


def arrow_function(returns: str) -> Callable[[Callable], ArrowFunction]:
    return lambda function: ArrowFunction(function, returns)
