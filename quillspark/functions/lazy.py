"""Pandas UDFs that are made when first called: modules can be imported before there is a session."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


def lazy_udf(schema: str, once: bool = False) -> Callable:
    """once: the optimiser must not repeat the call in filters and other expressions that use its result."""

    def wrap(f: Callable) -> Callable[..., Column]:
        @wraps(f)
        def call(*columns: Column) -> Column:
            made = F.pandas_udf(f, schema)
            return (made.asNondeterministic() if once else made)(*columns)

        return call

    return wrap
