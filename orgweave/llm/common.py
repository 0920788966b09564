"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX = "__llm_"


def without(df: DataFrame, results: Iterable[str]) -> DataFrame:
    """``df`` without the columns an operator is about to add.

    An input column that bears the name of a result is replaced by it, and names
    that begin with ``__llm_`` belong to the operators.
    """
    taken = {r.lower() for r in results}
    return df.drop(*[F.col(f"`{c}`") for c in df.columns if c.lower() in taken or c.lower().startswith(PREFIX)])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def worker_state(name: str, make: Callable[[], object]) -> object:
    """An object that lives as long as the Python worker, so that tasks after the first find its caches warm."""
    home = sys.modules.setdefault("_orgweave_worker", types.ModuleType("_orgweave_worker"))
    if not hasattr(home, name):
        setattr(home, name, make())
    return getattr(home, name)
