"""Sources to scopes, symbols and references."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCOPE = "struct<scope_id:int,parent_id:int,kind:string,span_start:int,span_end:int,enter:int,exit:int>"
SYMBOL = "struct<symbol_id:int,name:string,scope_id:int,decl_start:int,decl_end:int,kind:string>"
REFERENCE = "struct<name:string,symbol_id:int,scope_id:int,span_start:int,span_end:int,form:string>"
_ARROW = {
    "int": pa.int32(),
    "string": pa.string(),
}


def _type(spec: str) -> pa.DataType:
    fields = [x.split(":") for x in spec[len("struct<") : -1].split(",")]
    return pa.list_(pa.struct([(name, _ARROW[kind]) for name, kind in fields]))


def _analysed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from ..jsparse import ParseError, analyse

    specs = (SCOPE, SYMBOL, REFERENCE)
    names = [[x.split(":")[0] for x in s[len("struct<") : -1].split(",")] for s in specs]
    for batch in batches:
        lists: list[list] = [[], [], []]
        errors = []
        for code in batch.column("code").to_pylist():
            try:
                found = analyse(code or "")
                parts = (found.scopes, found.symbols, found.references)
                errors.append(None)
            except ParseError as e:
                parts = ([], [], [])
                errors.append(str(e))
            for out, keys, rows in zip(lists, names, parts, strict=True):
                out.append([dict(zip(keys, x, strict=True)) for x in rows])
        arrays = [pa.array(x, _type(s)) for x, s in zip(lists, specs, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("source_id"), batch.column("code"), *arrays, pa.array(errors, pa.string())], ["source_id", "code", "scopes", "symbols", "refs", "parse_error"])


def parse(sources: DataFrame) -> DataFrame:
    """source_id, code, scopes, symbols, refs and parse_error of each source. A source that can't be parsed keeps its row, with
    its message. Python reads each source once, so filter and prune before, and write the result if it is used twice."""
    schema = f"source_id string, code string, scopes array<{SCOPE}>, symbols array<{SYMBOL}>, refs array<{REFERENCE}>, parse_error string"
    rows = sources.select(F.col("source_id").cast("string").alias("source_id"), F.coalesce("code", F.lit("")).alias("code"))
    return rows.mapInArrow(_analysed, schema)


def scopes(parsed: DataFrame) -> DataFrame:
    return parsed.select("source_id", F.inline("scopes"))


def symbols(parsed: DataFrame) -> DataFrame:
    return parsed.select("source_id", F.inline("symbols"))


def references(parsed: DataFrame) -> DataFrame:
    return parsed.select("source_id", F.inline("refs"))


def unresolved(parsed: DataFrame) -> DataFrame:
    """source_id, name and the enter indices of the scopes that use it."""
    return references(parsed).where("symbol_id is null").groupBy("source_id", "name").agg(F.array_sort(F.collect_set("scope_id")).alias("enters"))
