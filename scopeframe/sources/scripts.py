"""Inline scripts of stored pages as sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCRIPT = r"(?is)<script\b[^>]*>(.*?)</script\s*>"


def inline_scripts(pages: DataFrame) -> DataFrame:
    """page_id, script_no (from 0), source_id and code. What a string in a script looks like tags stays as it is."""
    found = F.posexplode(F.regexp_extract_all(F.col("html"), F.lit(SCRIPT), F.lit(1))).alias("script_no", "code")
    rows = pages.select("page_id", found)
    return rows.select("page_id", "script_no", F.concat_ws(":", "page_id", "script_no").alias("source_id"), "code")
