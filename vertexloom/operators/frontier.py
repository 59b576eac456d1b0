"""Rounds of a loop that touch few keys.

Loops over a graph keep long tables that every round joins with what changed.  Late
rounds change few rows, and then neither a shuffle nor a pass over the long
table is called for: up to ``LISTED_KEYS`` changed rows are broadcast, and up to
``NAMED_KEYS`` of them also name their keys in a filter, by which Spark skips the
cached batches of a sorted table that hold none of them.  Larger changes are joined
by a shuffle as in any round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.operators.scratch import Scratch
from vertexloom.operators.skew import LISTED_KEYS

NAMED_KEYS = 1_000


def meet_few(rows: DataFrame, key: str, few: DataFrame, n_few: int, how: str = "inner") -> DataFrame:
    """Join cached ``rows`` with ``n_few`` rows that have the same key column, at most
    ``LISTED_KEYS``; ``how`` is inner or left_semi."""
    if n_few <= NAMED_KEYS:
        names = [row[0] for row in few.select(key).distinct().collect()]
        rows = rows.where(F.col(key).isin(names))
    return rows.join(F.broadcast(few), key, how)


class KeyedState:
    """One row per key, of which a round looks up and replaces some.

    Rows lie in a base, cached and sorted by key, and in the rows replaced since; once
    those are more than ``few`` the base is written anew.
    """

    def __init__(self, rows: DataFrame, key: str, scratch: Scratch, name: str, few: int = LISTED_KEYS):
        self.key, self.scratch, self.name, self.few = key, scratch, name, few
        self.recent: DataFrame | None = None
        self._rebase(rows)

    def _rebase(self, rows: DataFrame, **aggregates: Column) -> dict:
        saved, seen = self.scratch.save_observed(
            rows.sortWithinPartitions(self.key), self.name, n=F.count(F.lit(1)), **aggregates
        )
        self._saved, self.base, self.n_rows = saved, saved.persist(), seen["n"]
        return seen

    def few_of(self, n: int) -> bool:
        """Whether a round that starts from ``n`` rows is better done by looking them up
        than by writing all rows anew."""
        return n <= self.few and 4 * n <= self.n_rows

    def all(self) -> DataFrame:
        if self.recent is None:
            return self.base
        old = self.base.join(F.broadcast(self.recent.select(self.key)), self.key, "left_anti")
        return old.unionByName(self.recent)

    def at(self, keys: DataFrame, n_keys: int) -> DataFrame:
        """Rows of the given keys, with the columns of ``keys`` beside them."""
        if n_keys > self.few:
            return self.all().join(keys, self.key)
        found = meet_few(self.base, self.key, keys, n_keys)
        if self.recent is None:
            return found
        found = found.join(F.broadcast(self.recent.select(self.key)), self.key, "left_anti")
        return found.unionByName(self.recent.join(F.broadcast(keys), self.key))

    def put(self, rows: DataFrame, n_rows: int) -> None:
        """Replace the rows of the keys of ``rows``, a saved table."""
        if self.recent is not None and n_rows <= self.few:
            kept = self.recent.join(F.broadcast(rows.select(self.key)), self.key, "left_anti")
            rows, n_rows = self.scratch.save_counted(kept.unionByName(rows), f"{self.name}-recent")
        if n_rows <= self.few:
            self.recent = rows
            return
        if n_rows < self.n_rows:
            rows = self.all().join(rows.select(self.key), self.key, "left_anti").unionByName(rows)
        self.replace(rows)

    def replace(self, rows: DataFrame, **aggregates: Column) -> dict:
        """Put other rows in place of all; returns what the write observes of them."""
        saved, base = self._saved, self.base
        seen = self._rebase(rows, **aggregates)
        self.recent = None
        base.unpersist()
        self.scratch.drop(saved)
        return seen

    def release(self) -> None:
        self.base.unpersist()
