"""Vectorised helpers whose types are given as DDL, which Spark parses only once a session runs."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F


def vectorised(returns: str):
    def wrap(f):
        @functools.wraps(f)
        def call(*cols):
            return F.pandas_udf(f, returns)(*cols)

        return call

    return wrap
