"""Renamed sources: each name's spans are spliced, everything else stays byte for byte."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bind import bind


def rewrite(parsed: DataFrame, renames: DataFrame) -> DataFrame:
    """source_id, output and parse_error for each source. A source that can't be parsed has no output.

    A short property ``{a}`` becomes ``{a: new}``, an import ``a as new``, an export ``new as a``. A source's renames are an
    array beside its row, in which a symbol's name is found by its number; pieces are cut once and joined, so the work is linear in
    the text, but for sorting the edits."""
    listed = renames.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("symbol_id", "new_name"))).alias("_listed"))

    def upto(x: Column, i: Column) -> Column:
        """The name of one symbol, after nulls for the symbols between it and the one before."""
        gap = x["symbol_id"] - F.coalesce(F.get("_listed", i - 1)["symbol_id"], F.lit(-1)) - 1
        gap = F.when(gap < 0, F.raise_error(F.lit("a symbol has two new names"))).otherwise(gap)
        return F.concat(F.array_repeat(F.lit(None).cast("string"), gap.cast("int")), F.array(x["new_name"]))

    names = listed.select("source_id", F.flatten(F.transform("_listed", upto)).alias("_names"))
    rows = parsed.select("source_id", "code", "refs", "parse_error").join(names, "source_id", "left")

    def text(r: Column, new: Column) -> Column:
        return (
            F.when(r["form"] == "short", F.concat(r["name"], F.lit(": "), new))
            .when(r["form"] == "import", F.concat(r["name"], F.lit(" as "), new))
            .when(r["form"] == "export", F.concat(new, F.lit(" as "), r["name"]))
            .otherwise(new)
        )

    def spliced(x: Column) -> Column:
        new = lambda r: F.get(x["names"], r["symbol_id"])
        named = F.filter(x["refs"], lambda r: new(r).isNotNull())
        edits = F.array_sort(F.transform(named, lambda r: F.struct(r["span_start"].alias("a"), r["span_end"].alias("b"), text(r, new(r)).alias("t"))))
        return bind(edits, lambda e: joined(x["code"], e))

    def joined(code: Column, edits: Column) -> Column:
        before = lambda i: F.coalesce(F.get(edits, i - 1)["b"], F.lit(0))
        pieces = F.transform(edits, lambda e, i: F.concat(F.substring(code, before(i) + 1, e["a"] - before(i)).cast("string"), e["t"]))
        last = before(F.size(edits))
        return F.concat(F.array_join(pieces, ""), F.substring(code, last + 1, F.octet_length(code) - last).cast("string"))

    source = F.struct(F.col("code").cast("binary").alias("code"), F.col("refs").alias("refs"), F.col("_names").alias("names"))
    output = F.when(F.col("parse_error").isNotNull(), F.lit(None)).when(F.col("_names").isNull(), F.col("code")).otherwise(bind(source, spliced))
    return rows.select("source_id", output.alias("output"), "parse_error")
