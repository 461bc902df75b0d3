"""The plan from sources to renamed sources, each step a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators import emit, parse, resolve, suggest, worklist


@dataclass
class Renaming:
    """parsed, worklist, suggestions, renames and output, all lazy."""

    parsed: DataFrame
    worklist: DataFrame
    suggestions: DataFrame
    renames: DataFrame
    output: DataFrame

    def log(self) -> DataFrame:
        """source_id, ord, total, name and new_name: what is told when a symbol is done."""
        rows = self.suggestions.select("source_id", "symbol_id", "ord", "total", "name")
        return rows.join(self.renames, ["source_id", "symbol_id"], "left").select("source_id", "ord", "total", "name", F.coalesce("new_name", "name").alias("new_name"))


def rename(sources: DataFrame, renamer: suggest.Renamer, context_size: int = worklist.DEFAULT_CONTEXT, work_path: str | None = None, by_family: bool = True, observation: Observation | None = None) -> Renaming:
    """``sources``: source_id, code.

    work_path: a shared folder where parses and suggestions are written once. Give it whenever parsing is long or a model is
    asked; without it a step that is read twice is computed twice."""

    def kept(df: DataFrame, name: str) -> DataFrame:
        if work_path is None:
            return df
        df.write.mode("overwrite").parquet(f"{work_path}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{work_path}/{name}")

    parsed = kept(parse.parse(sources), "parsed")
    listed = worklist.worklist(parsed, context_size)
    if observation is not None:
        listed = listed.observe(observation, F.count("*").alias("identifiers"))
    suggestions = kept(renamer.suggest(listed), "suggestions")
    renames = resolve.resolve(parsed, suggestions, by_family)
    return Renaming(parsed, listed, suggestions, renames, emit.rewrite(parsed, renames))
