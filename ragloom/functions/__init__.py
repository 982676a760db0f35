"""Column-expression builders (vectors, text, prompts)."""

from __future__ import annotations

import functools

_PLAIN = (str, int, float, bool, type(None))


def cached_column(fn):
    """Memoise a builder of column expressions whose arguments are plain values.

    A Column is an immutable, unresolved expression tree: the same object can
    be used in any number of DataFrames. Building a large one (nested lambdas)
    costs one driver-to-JVM call per node, about a second for the metric
    expressions, so each distinct call is built once per SparkContext.
    Calls with Column arguments are not cached.
    """
    cache: dict = {}
    owner: list = [None]          # the SparkContext the cached columns belong to

    @functools.wraps(fn)
    def wrapper(*args, **kw):
        from pyspark.sql import SparkSession
        if not all(isinstance(a, _PLAIN) for a in (*args, *kw.values())):
            return fn(*args, **kw)
        session = SparkSession.getActiveSession()
        if session is None:
            return fn(*args, **kw)
        sc = session.sparkContext
        if owner[0] is not sc:        # new application: columns of the old JVM are void
            cache.clear()
            owner[0] = sc
        key = (args, tuple(sorted(kw.items())))
        if key not in cache:
            cache[key] = fn(*args, **kw)
        out = cache[key]
        return list(out) if isinstance(out, list) else out

    return wrapper
