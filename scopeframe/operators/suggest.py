"""Renamers: from the work list to a raw name for each symbol. Those that need no model are column expressions."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Renamer(ABC):
    """The same name back leaves a symbol alone."""

    @abstractmethod
    def suggest(self, worklist: DataFrame) -> DataFrame:
        """``worklist`` with raw_name."""


class ColumnRenamer(Renamer):
    def __init__(self, make: Callable[[], Column]):
        self.make = make

    def suggest(self, worklist: DataFrame) -> DataFrame:
        return worklist.withColumn("raw_name", self.make())


def identity() -> Renamer:
    return ColumnRenamer(lambda: F.col("name"))


def fixed(name: str) -> Renamer:
    return ColumnRenamer(lambda: F.lit(name))


def suffix(text: str) -> Renamer:
    return ColumnRenamer(lambda: F.concat("name", F.lit(text)))


def mapping(pairs: dict[str, str]) -> Renamer:
    """Looked up by name, else unchanged."""

    def make() -> Column:
        out = F.col("name")
        if pairs:
            table = F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))
            out = F.coalesce(F.try_element_at(table, F.col("name")), out)
        return out

    return ColumnRenamer(make)


def queue(names: list[str]) -> Renamer:
    """The n-th symbol gets the n-th name, and those after the last keep theirs."""
    return ColumnRenamer(lambda: F.coalesce(F.try_element_at(F.array(*map(F.lit, names)).cast("array<string>"), F.col("ord").cast("int")), F.col("name")))


class ModelRenamer(Renamer):
    """A language model behind a ladder of ways of asking. ``make_ladder`` runs once in each task.

    Prompts depend on name and surroundings alone, so all may be asked at once. dedupe: equal prompts are asked once.
    Calls cost money: write the result before it is used twice, and keep speculation off."""

    def __init__(self, make_ladder: Callable[[], object], dedupe: bool = True, parallel: int | None = None):
        self.make_ladder, self.dedupe, self.parallel = make_ladder, dedupe, parallel

    def ask(self, prompts: DataFrame) -> DataFrame:
        """name, surrounding, raw_name, strategy and error."""
        make_ladder = self.make_ladder

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from ..providers.naming import name_for

            ladder = make_ladder()
            for batch in batches:
                rows = [(*x, *name_for(ladder, *x)) for x in zip(batch.column("name").to_pylist(), batch.column("surrounding").to_pylist(), strict=True)]
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in columns], ["name", "surrounding", "raw_name", "strategy", "error"])

        rows = prompts.select("name", "surrounding")
        if self.dedupe:
            rows = rows.distinct()
        if self.parallel:
            rows = rows.repartition(self.parallel)
        return rows.mapInArrow(run, "name string, surrounding string, raw_name string, strategy string, error string")

    def suggest(self, worklist: DataFrame) -> DataFrame:
        asked = self.ask(worklist)
        return worklist.join(asked.dropDuplicates(["name", "surrounding"]), ["name", "surrounding"], "left")
