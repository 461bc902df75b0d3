"""One source in this process: the plan's steps on a one-row table, with the model asked in order and an observer told."""

from __future__ import annotations

from .jsparse import ParseError, analyse
from .observe import Observer
from .providers.naming import name_for

__all__ = ["ParseError", "rename_text"]


def rename_text(code: str, ladder, context_size: int, observer: Observer) -> str:
    """The renamed source. An empty source stays empty, and nothing is asked. Raises ParseError."""
    if not code:
        observer.found(0)
        return code
    analyse(code)
    from pyspark.sql import SparkSession

    from .operators import emit, parse, resolve, worklist

    spark = SparkSession.getActiveSession() or SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
    parsed = parse.parse(spark.createDataFrame([("input", code)], "source_id string, code string"))
    listed = [x.asDict() for x in worklist.worklist(parsed, context_size).orderBy("ord").collect()]
    observer.found(len(listed))
    if not listed:
        return code
    rows = []
    for i, x in enumerate(listed, 1):
        observer.started(i, len(listed), x["name"])
        raw, _, _ = name_for(ladder, x["name"], x["surrounding"])
        rows.append((x["source_id"], x["symbol_id"], x["name"], x["enter"], x["exit"], x["ord"], raw))
        observer.finished(i, len(listed), x["name"], raw)
    said = spark.createDataFrame(rows, "source_id string, symbol_id int, name string, enter int, exit int, ord int, raw_name string")
    return emit.rewrite(parsed, resolve.resolve(parsed, said)).first()["output"]
