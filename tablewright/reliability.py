"""Driver-side wrappers around functions that build or read DataFrames. What runs in tasks is retried by Spark itself."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from functools import lru_cache, wraps
from typing import Any

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

log = logging.getLogger("tablewright")


def retried(times: int, on: type[Exception] | tuple = Exception, pause: float = 0.0):
    """Call again until it succeeds, `times` times at most; then the last error goes through."""
    if times < 1:
        raise ValueError("at least one call is needed")

    def wrap(f: Callable) -> Callable:
        @wraps(f)
        def call(*args, **named):
            for left in range(times - 1, -1, -1):
                try:
                    return f(*args, **named)
                except on as error:
                    if not left:
                        raise
                    log.warning("%s failed, %d calls left: %s", f.__name__, left, error)
                    time.sleep(pause)

        return call

    return wrap


def memoized(f: Callable) -> Callable:
    """One call for each set of arguments; `known` holds the results."""

    @wraps(f)
    def call(*args, **named):
        key = (args, tuple(sorted(named.items())))
        if key not in call.known:
            call.known[key] = f(*args, **named)
        return call.known[key]

    call.known = {}
    return call


def memoized_last(size: int):
    """As `memoized`, but only the `size` results that were used last are kept."""
    return lru_cache(maxsize=size)


def timed(f: Callable) -> Callable:
    """`seconds` holds the time that the last call took; of a lazy plan that is the building alone."""

    @wraps(f)
    def call(*args, **named):
        began = time.perf_counter()
        try:
            return f(*args, **named)
        finally:
            call.seconds = time.perf_counter() - began
            log.info("%s took %.3f s", f.__name__, call.seconds)

    call.seconds = None
    return call


def counted(f: Callable) -> Callable:
    """`calls` holds how often it was called."""

    @wraps(f)
    def call(*args, **named):
        call.calls += 1
        return f(*args, **named)

    call.calls = 0
    return call


def repeated(times: int):
    """Call so many times; the last result is returned, None without a call."""

    def wrap(f: Callable) -> Callable:
        @wraps(f)
        def call(*args, **named) -> Any:
            result = None
            for _ in range(times):
                result = f(*args, **named)
            return result

        return call

    return wrap


def with_context(message: str, on: type[Exception] | tuple = Exception, to: type[Exception] = RuntimeError):
    """Errors come out as `to` with `message`; the first error is their cause."""

    def wrap(f: Callable) -> Callable:
        @wraps(f)
        def call(*args, **named):
            try:
                return f(*args, **named)
            except on as error:
                raise to(f"{message}: {error}") from error

        return call

    return wrap


def observed(rows: DataFrame, name: str = "rows") -> tuple[DataFrame, Observation]:
    """`rows`, and an observation that holds how many passed once an action has run: no second pass, no cache."""
    watch = Observation(name)
    return rows.observe(watch, F.count(F.lit(1)).alias("n")), watch


def falling_back(defaults: dict[type[Exception], Any]):
    """An error of a listed type gives its default instead, the most special type first; others go through."""

    def wrap(f: Callable) -> Callable:
        @wraps(f)
        def call(*args, **named):
            try:
                return f(*args, **named)
            except tuple(defaults) as error:
                kind = next(x for x in type(error).__mro__ if x in defaults)
                default = defaults[kind]
                return default(error) if callable(default) else default

        return call

    return wrap
