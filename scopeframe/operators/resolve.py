"""Names without capture: collision tests as relations, and the resolver.

A candidate collides for a symbol if (1) it is an unresolved name used in the symbol's scope or below, (2) the nearest binding
of it from the symbol's scope upwards is another symbol, or (3) it is bound strictly below. The resolver goes through the
symbols in order and gives each its base name or the first free number after it.

A decision depends only on names of the base's family (the name without trailing digits), on symbols that arrive in it and on
those that leave it; who leaves is known beforehand. So (source, family) groups are resolved apart, and a source of any size is
spread over many tasks.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import stem, to_identifier

MOST_U64 = (1 << 64) - 1


def split_suffix(name: str) -> tuple[str, int | None, bool]:
    """Stem, number, and whether there are digits; the number is None if there are none or it is over 64 bits."""
    stem_ = name.rstrip("0123456789")
    digits = name[len(stem_) :]
    if not stem_ or not digits:
        return name, None, False
    number = int(digits)
    return stem_, number if number <= MOST_U64 else None, True


class Spans:
    """Spans (enter, exit, symbol) in order, in blocks that know their greatest exit, so that a look back for a span around a place
    skips blocks instead of walking all spans before it."""

    BLOCK = 64

    def __init__(self):
        self.blocks: list[list[tuple[int, int, int]]] = []
        self.firsts: list[tuple[int, int, int]] = []
        self.most: list[int] = []

    def _block(self, span: tuple[int, int, int]) -> int:
        return max(bisect_right(self.firsts, span) - 1, 0)

    def _tell(self, k: int) -> None:
        self.firsts[k] = self.blocks[k][0]
        self.most[k] = max(x[1] for x in self.blocks[k])

    def add(self, span: tuple[int, int, int]) -> None:
        if not self.blocks:
            self.blocks, self.firsts, self.most = [[span]], [span], [span[1]]
            return
        k = self._block(span)
        insort(self.blocks[k], span)
        if len(self.blocks[k]) > 2 * self.BLOCK:
            self.blocks[k : k + 1] = [self.blocks[k][: self.BLOCK], self.blocks[k][self.BLOCK :]]
            self.firsts.insert(k, span)
            self.most.insert(k, 0)
            self._tell(k + 1)
        self._tell(k)

    def drop(self, span: tuple[int, int, int]) -> None:
        if not self.blocks:
            return
        k = self._block(span)
        at = bisect_left(self.blocks[k], span)
        if at == len(self.blocks[k]) or self.blocks[k][at] != span:
            return
        del self.blocks[k][at]
        if self.blocks[k]:
            self._tell(k)
        else:
            del self.blocks[k], self.firsts[k], self.most[k]

    def around(self, place: int) -> tuple[int, int, int] | None:
        """The last span that begins at or before a place and ends after it."""
        last = (place, 1 << 60, 1 << 60)
        for k in range(bisect_right(self.firsts, last) - 1, -1, -1):
            if self.most[k] > place:
                for x in reversed(self.blocks[k][: bisect_right(self.blocks[k], last)]):
                    if x[1] > place:
                        return x
        return None

    def begins_within(self, enter: int, exit_: int) -> bool:
        """Whether any span begins after enter and before exit_."""
        if not self.blocks:
            return False
        last = (enter, 1 << 60, 1 << 60)
        k = self._block(last)
        at = bisect_right(self.blocks[k], last)
        if at < len(self.blocks[k]):
            return self.blocks[k][at][0] < exit_
        return k + 1 < len(self.firsts) and self.firsts[k + 1][0] < exit_


class Family:
    """The names of one family in one source."""

    def __init__(self):
        self.bound: dict[str, Spans] = {}
        self.free: dict[str, list[int]] = {}  # unresolved name: sorted enters of its uses

    def add(self, name: str, enter: int, exit_: int, symbol: int) -> None:
        self.bound.setdefault(name, Spans()).add((enter, exit_, symbol))

    def drop(self, name: str, enter: int, exit_: int, symbol: int) -> None:
        if name in self.bound:
            self.bound[name].drop((enter, exit_, symbol))

    def collides(self, name: str, enter: int, exit_: int, symbol: int) -> bool:
        uses = self.free.get(name)
        if uses:
            at = bisect_left(uses, enter)
            if at < len(uses) and uses[at] < exit_:
                return True
        held = self.bound.get(name)
        if held is None:
            return False
        nearest = held.around(enter)
        return nearest is not None and nearest[2] != symbol or held.begins_within(enter, exit_)

    def resolve(self, base: str, enter: int, exit_: int, symbol: int) -> str:
        if not self.collides(base, enter, exit_, symbol):
            return base
        stem_, number, _ = split_suffix(base)
        n = 2 if number is None else min(number + 1, MOST_U64)
        while self.collides(f"{stem_}{n}", enter, exit_, symbol):
            n += 1
        return f"{stem_}{n}"


def _resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one (source, family) are neighbours: what is there from the start first, then the events by ord."""
    key, family, out = None, Family(), []
    for batch in batches:
        for x in batch.to_pylist():
            if (x["source_id"], x["family"]) != key:
                key, family = (x["source_id"], x["family"]), Family()
            if x["what"] == 0:
                insort(family.free.setdefault(x["name"], []), x["enter"])
            elif x["what"] == 1:
                family.add(x["name"], x["enter"], x["exit"], x["symbol_id"])
            else:
                place = (x["enter"], x["exit"], x["symbol_id"])
                new = None
                if x["base"] is not None:
                    new = family.resolve(x["base"], *place)
                if x["name"] is not None:
                    family.drop(x["name"], *place)
                if new is not None:
                    family.add(new, *place)
                    out.append((x["source_id"], x["symbol_id"], new))
        if out:
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string())], ["source_id", "symbol_id", "new_name"])
            out = []


def resolve(parsed: DataFrame, suggestions: DataFrame, by_family: bool = True) -> DataFrame:
    """source_id, symbol_id, new_name of the symbols that are renamed. ``suggestions``: a row for each symbol with source_id,
    symbol_id, name, enter, exit, ord and raw_name; the same raw name as the name leaves the symbol alone.

    by_family: False keeps a source's names together, for comparison."""
    group = (lambda c: stem(c)) if by_family else (lambda c: F.lit(""))
    blank = F.lit(None)
    free = parsed.select("source_id", F.inline("refs")).where("symbol_id is null").select(
        "source_id", group(F.col("name")).alias("family"), F.lit(0).alias("what"), F.lit(0).alias("ord"), blank.cast("int").alias("symbol_id"), "name", blank.cast("string").alias("base"), F.col("scope_id").alias("enter"), blank.cast("int").alias("exit"),
    ).distinct()
    known = suggestions.select("source_id", "symbol_id", "name", "enter", "exit", F.col("ord").cast("int").alias("ord"), F.when(F.col("raw_name") != F.col("name"), to_identifier(F.col("raw_name"))).alias("base"))
    seed = known.select("source_id", group(F.col("name")).alias("family"), F.lit(1).alias("what"), F.lit(0).alias("ord"), "symbol_id", "name", blank.cast("string").alias("base"), "enter", "exit")
    moved = known.where("base is not null").withColumns({"_from": group(F.col("name")), "_to": group(F.col("base"))})
    events = F.when(F.col("_from") == F.col("_to"), F.array(F.struct(F.col("_from").alias("family"), F.col("name").alias("n"), F.col("base").alias("b")))).otherwise(
        F.array(F.struct(F.col("_from").alias("family"), F.col("name").alias("n"), blank.cast("string").alias("b")), F.struct(F.col("_to").alias("family"), blank.cast("string").alias("n"), F.col("base").alias("b")))
    )
    moves = moved.select("source_id", "symbol_id", "enter", "exit", "ord", F.explode(events).alias("e")).select(
        "source_id", F.col("e.family").alias("family"), F.lit(2).alias("what"), "ord", "symbol_id", F.col("e.n").alias("name"), F.col("e.b").alias("base"), "enter", "exit"
    )
    rows = free.unionByName(seed).unionByName(moves)
    dealt = rows.repartition("source_id", "family").sortWithinPartitions("source_id", "family", "what", "ord")
    return dealt.mapInArrow(_resolved, "source_id string, symbol_id int, new_name string")


def nearest_binding(uses: DataFrame, bindings: DataFrame) -> DataFrame:
    """Of each use (source_id, use_id, name, enter): the innermost binding (source_id, symbol_id, name, enter, exit) of its name
    in its scope or above. An interval join with source and name as equal keys."""
    u, b = uses.alias("u"), bindings.alias("b")
    met = u.join(b, (F.col("u.source_id") == F.col("b.source_id")) & (F.col("u.name") == F.col("b.name")) & (F.col("b.enter") <= F.col("u.enter")) & (F.col("u.enter") < F.col("b.exit")))
    return met.groupBy("u.source_id", "u.use_id").agg(F.max_by("b.symbol_id", "b.enter").alias("symbol_id"))


def bound_below(symbols: DataFrame, bindings: DataFrame) -> DataFrame:
    """The symbols (source_id, symbol_id, name, enter, exit) whose name is bound strictly below their scope."""
    s, b = symbols.alias("s"), bindings.select("source_id", "name", "enter").alias("b")
    return s.join(b, (F.col("s.source_id") == F.col("b.source_id")) & (F.col("s.name") == F.col("b.name")) & (F.col("s.enter") < F.col("b.enter")) & (F.col("b.enter") < F.col("s.exit")), "left_semi")


def captures(symbols: DataFrame, uses: DataFrame) -> DataFrame:
    """The symbols whose name is an unresolved name (source_id, name, enter) used in their scope or below."""
    s, u = symbols.alias("s"), uses.select("source_id", "name", "enter").alias("u")
    return s.join(u, (F.col("s.source_id") == F.col("u.source_id")) & (F.col("s.name") == F.col("u.name")) & (F.col("s.enter") <= F.col("u.enter")) & (F.col("u.enter") < F.col("s.exit")), "left_semi")
