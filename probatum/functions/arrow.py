"""Arrow-batched UDFs that are declared at import and built when a session exists."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import functions as F


def arrow(ddl: str) -> Callable:
    """Decorator: a pandas UDF of the given DDL type, made at its first use."""

    def declare(f: Callable) -> Callable:
        @wraps(f)
        def call(*cols):
            return F.pandas_udf(f, ddl)(*cols)

        call.plain = f
        return call

    return declare
