"""Steps that a user adds between asking, searching and answering.

A hook takes a DataFrame and returns one.  A hook that cannot be planned is
passed over and the frame before it goes on; one made of a Python function
is passed over row by row, where that function raises.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import squash

Hook = Callable[[DataFrame], DataFrame]
log = logging.getLogger(__name__)

#: The places at which hooks run.
PRE_QUERY, POST_SEARCH, POST_SYNTHESIS = "pre_query", "post_search", "post_synthesis"


def on_column(name: str, change: Callable[[Column], Column]) -> Hook:
    return lambda rows: rows.withColumn(name, change(F.col(name)))


def on_values(name: str, change: Callable[[str], str]) -> Hook:
    """A Python function over the values of a text column, in Arrow batches; where it raises the value stays."""

    def guarded(value: str | None) -> str | None:
        try:
            return change(value)
        except Exception:  # any failure of a user's function keeps what was there
            return value

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            yield values.map(guarded)

    return on_column(name, run)


def first_of_each_document(sources: Column) -> Column:
    """Sources without those whose doc_id an earlier one has; a null doc_id counts as an empty one."""
    ids = F.transform(sources, lambda s: F.coalesce(s["doc_id"].cast("string"), F.lit("")))
    return F.filter(sources, lambda s, i: F.array_position(ids, F.coalesce(s["doc_id"].cast("string"), F.lit(""))) == i + 1)


def without_tags(answer: Column) -> Column:
    return F.regexp_replace(answer, "<[^>]+>", "")


#: Hooks that are there by name: the place each runs at and what it changes.
BUILT_IN: dict[str, tuple[str, str, Callable[[Column], Column]]] = {
    "squash_query": (PRE_QUERY, "query", squash),
    "distinct_sources": (POST_SEARCH, "sources", first_of_each_document),
    "plain_answer": (POST_SYNTHESIS, "answer", without_tags),
}


class Hooks:
    """Hooks by place, run in the order in which they were added; none run if it is not ``enabled``."""

    def __init__(self, built_in: tuple[str, ...] = (), enabled: bool = True):
        self.enabled, self._at = enabled, {}
        for name in built_in:
            if name in BUILT_IN:
                place, column, change = BUILT_IN[name]
                self.add(place, on_column(column, change))
            else:
                log.warning("no hook is named %s", name)

    def add(self, place: str, hook: Hook) -> None:
        self._at.setdefault(place, []).append(hook)

    def clear(self, place: str | None = None) -> None:
        if place is None:
            self._at.clear()
        else:
            self._at.pop(place, None)

    def count(self, place: str) -> int:
        return len(self._at.get(place, []))

    def run(self, place: str, rows: DataFrame) -> DataFrame:
        for hook in self._at.get(place, []) if self.enabled else ():
            try:
                changed = hook(rows)
                changed.schema  # noqa: B018  a plan that cannot be resolved fails here
                rows = changed
            except (PySparkException, TypeError, ValueError, KeyError, AttributeError) as failure:
                log.warning("a hook at %s failed and was passed over: %s", place, failure)
        return rows
