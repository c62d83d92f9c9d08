"""State by key that grows with the log: runs of folded rows, merged by levels.

A batch folds its own rows and writes them as a run; nothing that is stored is read for it. When a level has
``FANOUT`` runs they are merged into one run of the next level, so after n batches there are at most FANOUT - 1
runs on each of log(n) levels, and a row is rewritten once for each level. Rows of keys that are gone stay as
tombstones until a merge takes in the oldest run: before that, an older run may still hold the key.

Which runs make up the state is written down after each batch, under its number. A job that starts again goes on
from its checkpoint: a batch that was written down is not applied again, one that was not overwrites its own runs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galena.sources.tables import delete_path, list_names

FANOUT = 4


@dataclass(frozen=True)
class KeyedState:
    """State in the folder ``at``.

    ``fold`` takes rows of any batches to the rows that stand for them: folding folded rows with others has to be the same as
    folding all at once (latest by key, sums, sets). ``gone`` tells folded rows of keys that are deleted. ``schema`` is that of the rows.
    """

    spark: SparkSession
    at: str
    schema: str
    fold: Callable[[DataFrame], DataFrame]
    gone: Column | None = None
    fanout: int = FANOUT

    def batches(self) -> list[int]:
        return sorted(int(n.split("=")[1]) for n in list_names(self.spark, f"{self.at}/known") if n.startswith("batch="))

    def runs(self, batch: int | None = None) -> list[tuple[int, str]]:
        """(level, name) of the runs that are live after a batch, the latest by default, oldest first."""
        done = [b for b in self.batches() if batch is None or b <= batch]
        if not done:
            return []
        rows = self.spark.read.schema("place int, level int, name string").parquet(f"{self.at}/known/batch={done[-1]}").orderBy("place").collect()
        return [(r.level, r.name) for r in rows]

    def _read(self, runs: list[tuple[int, str]]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.at}/runs/{name}" for _, name in runs])

    def rows(self) -> DataFrame:
        """The state: one fold over the live runs, without keys that are gone."""
        folded = self.fold(self._read(self.runs()))
        return folded if self.gone is None else folded.where(~F.coalesce(self.gone, F.lit(False)))

    def stored(self, keys: DataFrame, on: list[str]) -> DataFrame:
        """The state of some keys only (one row each in ``keys``)."""
        folded = self.fold(self._read(self.runs()).join(keys.select(*on), on, "left_semi"))
        return folded if self.gone is None else folded.where(~F.coalesce(self.gone, F.lit(False)))

    def apply(self, batch: DataFrame, number: int) -> None:
        if number in self.batches():
            return
        before = self.runs(number - 1)
        name = f"{number}-0"
        self.fold(batch).write.mode("overwrite").parquet(f"{self.at}/runs/{name}")
        runs, dropped, level = [*before, (0, name)], [], 0
        while sum(k == level for k, _ in runs) >= self.fanout:
            merged = [r for r in runs if r[0] == level]
            older = [r for r in runs if r[0] > level]
            rows = self.fold(self._read(merged))
            if not older and self.gone is not None:
                rows = rows.where(~F.coalesce(self.gone, F.lit(False)))
            name = f"{number}-{level + 1}"
            rows.write.mode("overwrite").parquet(f"{self.at}/runs/{name}")
            runs, dropped, level = [*older, (level + 1, name)], dropped + merged, level + 1
        self._write_down(runs, number)
        for _, old in dropped:
            delete_path(self.spark, f"{self.at}/runs/{old}")
        for b in self.batches()[:-2]:
            delete_path(self.spark, f"{self.at}/known/batch={b}")

    def _write_down(self, runs: list[tuple[int, str]], number: int) -> None:
        listed = [(i, level, name) for i, (level, name) in enumerate(runs)]
        self.spark.createDataFrame(listed, "place int, level int, name string").coalesce(1).write.mode("overwrite").parquet(f"{self.at}/known/batch={number}")
