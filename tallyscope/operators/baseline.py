"""Unfiltered counts of a table, asked once and kept while its filters change."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame



class Baseline:
    """Counts by view and column, shared by the sessions that come from each other.

    A frame is computed with the first result that needs it and then read from
    the executors' storage; a lost block is recomputed from the table. Kept are
    bins, values seen more than once and one row for all others, never a row
    per row of the table.
    """

    def __init__(self) -> None:
        self._frames: list[DataFrame] = []
        self._found: dict[tuple[str, str], DataFrame] = {}

    def known(self, view: str, columns: Mapping[int, str]) -> dict[int, str]:
        return {p: c for p, c in columns.items() if (view, c) in self._found}

    def keep(self, view: str, columns: Mapping[int, str], frame: DataFrame) -> DataFrame:
        """``frame`` has a ``pos`` for each of ``columns``."""
        frame = frame.persist(StorageLevel.MEMORY_AND_DISK)
        self._frames.append(frame)
        for pos, name in columns.items():
            self._found[view, name] = frame.where(f"pos = {pos}")
        return frame

    def rows(self, view: str, columns: Mapping[int, str], *names: str) -> DataFrame:
        """The kept rows of ``columns``, with their positions of now."""
        parts = [self._found[view, c].selectExpr(f"{p} AS pos", *names) for p, c in columns.items()]
        return reduce(DataFrame.unionByName, parts)

    def total(self, make: Callable[[], DataFrame]) -> DataFrame:
        """One row that does not belong to a column."""
        if ("total", "") not in self._found:
            frame = make().persist(StorageLevel.MEMORY_AND_DISK)
            self._frames.append(frame)
            self._found["total", ""] = frame
        return self._found["total", ""]

    def close(self) -> None:
        """Give the storage back; what is asked later is counted anew."""
        for frame in self._frames:
            frame.unpersist()
        self._frames.clear()
        self._found.clear()


