"""The order in which symbols are named, and the code that is shown for each. Native expressions in each source's own row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bind import bind

DEFAULT_CONTEXT = 500


def _is_inner_byte(code: Column, at: Column) -> Column:
    """Whether the byte at an offset continues a character."""
    byte = F.conv(F.hex(F.substring(code, at + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(byte.bitwiseAND(F.lit(0xC0)) == 0x80, F.lit(False))


def floor_boundary(code: Column, at: Column) -> Column:
    """The nearest character boundary at or before ``at``, at most the length. ``code`` is binary."""
    n = F.octet_length(code)
    at = F.least(at, n)
    tries = F.array(at, at - 1, at - 2, at - 3)
    return F.element_at(F.filter(tries, lambda x: ~_is_inner_byte(code, x)), 1)


def ceil_boundary(code: Column, at: Column) -> Column:
    n = F.octet_length(code)
    at = F.least(at, n)
    tries = F.array(at, at + 1, at + 2, at + 3)
    return F.element_at(F.filter(tries, lambda x: (x >= n) | ~_is_inner_byte(code, x)), 1)


def window(code: Column, scope_start: Column, scope_end: Column, start: Column, end: Column, size: Column) -> Column:
    """The text that is shown for a symbol at [start, end) whose scope is at [scope_start, scope_end); bytes, not characters.

    A scope of up to ``size`` bytes is shown whole. Of a whole program more than that: the head if the symbol ends in the first
    half window, the tail if it starts in the last, else half a window to either side. Of any other scope: its head."""
    n = F.octet_length(code)
    a, b = floor_boundary(code, scope_start), ceil_boundary(code, scope_end)
    start, end = F.least(start, n), F.least(end, n)
    half = F.floor(size / 2).cast("int")
    cut = lambda x, y: F.struct(x.alias("a"), y.alias("b"))
    zero = F.lit(0)
    program = (
        F.when(end < half, cut(zero, ceil_boundary(code, size)))
        .when(start > n - half, cut(floor_boundary(code, F.greatest(n - size, zero)), n))
        .otherwise(cut(floor_boundary(code, F.greatest(start - half, zero)), ceil_boundary(code, end + half)))
    )
    inner = cut(a, F.least(ceil_boundary(code, a + size), b))
    chosen = F.when(b - a <= size, cut(a, b)).when((a == 0) & (b == n), program).otherwise(inner)
    return F.substring(code, chosen["a"] + 1, F.greatest(chosen["b"] - chosen["a"], zero)).cast("string")


def worklist(parsed: DataFrame, context_size: int | Column = DEFAULT_CONTEXT) -> DataFrame:
    """A row for each symbol: its scope's span (the whole source if that begins at byte 0), size, ord (from 1: larger scopes
    first, then by place), total and surrounding text. ``context_size`` in bytes, or an expression over ``parsed`` for a size by source.

    A source's symbols are sorted and their windows cut inside its own row, so nothing is shuffled, and the code is read once a
    source, not once a symbol. Scopes are numbered from 0 in their own order, so a scope is found by its place."""
    source = F.struct(F.col("code").cast("binary").alias("code"), F.col("scopes").alias("scopes"), F.col("symbols").alias("symbols"))

    def listed(x: Column) -> Column:
        n = F.octet_length(x["code"])

        def entry(s: Column) -> Column:
            scope = F.get(x["scopes"], s["scope_id"])
            whole = scope["span_start"] == 0
            a, b = F.when(whole, 0).otherwise(scope["span_start"]), F.when(whole, n).otherwise(scope["span_end"])
            size = F.greatest(b - a, F.lit(0))
            return F.struct((-size).alias("order"), s["decl_start"].alias("decl_start"), s["symbol_id"].alias("symbol_id"), size.alias("size"), s["name"].alias("name"), s["scope_id"].alias("scope_id"), s["decl_end"].alias("decl_end"), s["kind"].alias("kind"), a.alias("scope_start"), b.alias("scope_end"), scope["enter"].alias("enter"), scope["exit"].alias("exit"))

        def shown(s: Column) -> Column:
            return F.struct(s.alias("s"), window(x["code"], s["scope_start"], s["scope_end"], s["decl_start"], s["decl_end"], F.lit(context_size)).alias("surrounding"))

        return F.transform(F.array_sort(F.transform(x["symbols"], entry)), shown)

    # outer, as Spark would cut the windows once more to test that there are any
    rows = parsed.where("parse_error is null and size(symbols) > 0")
    out = rows.select("source_id", F.size("symbols").alias("total"), F.posexplode_outer(bind(source, listed)).alias("_pos", "w"))
    return out.select("source_id", *(F.col(f"w.s.{k}") for k in ("symbol_id", "name", "kind", "scope_id", "enter", "exit", "scope_start", "scope_end", "size", "decl_start", "decl_end")), (F.col("_pos") + 1).alias("ord"), "total", "w.surrounding")
