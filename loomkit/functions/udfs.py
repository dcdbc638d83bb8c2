"""Arrow UDFs that are made when they are first used, so that modules import without a session, on executors too."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F


def arrow_udf(returns: str, deterministic: bool = True):
    """Decorates a function on pandas series; the result takes columns. `.made()` gives the UDF itself.

    A UDF that isn't deterministic to the optimizer is never computed twice for a filter on its result.
    """

    def wrap(function):
        def made():
            udf = F.pandas_udf(function, returns)
            return udf if deterministic else udf.asNondeterministic()

        @functools.wraps(function)
        def apply(*columns):
            return made()(*columns)

        apply.made = made
        return apply

    return wrap
