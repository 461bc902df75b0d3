"""The ladder: it finds a way of asking that the service knows, and keeps to it.

Locked on a strategy, its result or transient error is passed on. If it turns out not to be supported, it is dead, and the
others are tried from the first. Dead ones are never tried again. The only strategy of a ladder never dies: its refusal is
transient. ``trace`` gives the same automaton for logged outcomes, as a column expression.
"""

from __future__ import annotations

import threading
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .http import NotSupported, Transient
from .strategies import Strategy

MOST = 64


class Ladder:
    def __init__(self, strategies: Sequence[Strategy], pinned: bool = False):
        if not 1 <= len(strategies) <= MOST:
            raise ValueError(f"a ladder has 1 to {MOST} strategies")
        self.strategies = list(strategies)
        self.locked: int | None = 0 if pinned else None
        self.dead: set[int] = set()
        self._guard = threading.Lock()

    @property
    def locked_name(self) -> str | None:
        at = self.locked
        return None if at is None else self.strategies[at].name

    def call(self, system: str, user: str, schema: dict) -> Any:
        """Raises Transient only."""
        at = self.locked
        if at is not None:
            try:
                return self.strategies[at].call(system, user, schema)
            except NotSupported as e:
                if len(self.strategies) == 1:
                    raise Transient(f"{self.strategies[at].name} isn't supported: {e}") from None
                with self._guard:
                    self.dead.add(at)
                    if self.locked == at:
                        self.locked = None
        said = []
        for i, strategy in enumerate(self.strategies):
            if i in self.dead:
                said.append(f"{strategy.name}: found not to be supported before")
                continue
            try:
                out = strategy.call(system, user, schema)
            except NotSupported as e:
                with self._guard:
                    self.dead.add(i)
                said.append(f"{strategy.name}: {e}")
                continue
            with self._guard:
                self.locked = i
            return out
        raise Transient("no way of asking is supported: " + "; ".join(said))


def trace(calls: Column, strategies: int) -> Column:
    """States after each of a sequence of calls. ``calls``: an array, in order, of arrays that hold what each strategy would
    answer (ok, not_supported or transient). Gives structs of locked (from 0, or -1), dead (a mask) and result (the strategy
    that answered, -1: a transient error)."""
    state = lambda locked, dead, result: F.struct(locked.cast("int").alias("locked"), dead.cast("bigint").alias("dead"), result.cast("int").alias("result"))
    bit = [1 << i for i in range(strategies)]
    none = F.lit(-1)

    def probe(answers: Column, dead: Column) -> Column:
        # from the last to the first: what a probe does from strategy i on, for each possible mask it may have by then
        masks = [dead]
        alive = []
        for i in range(strategies):
            is_dead = masks[-1].bitwiseAND(F.lit(bit[i])) != 0
            alive.append(~is_dead)
            refused = ~is_dead & (F.get(answers, F.lit(i)) == "not_supported")
            masks.append(F.when(refused, masks[-1].bitwiseOR(F.lit(bit[i]))).otherwise(masks[-1]))
        out = state(none, masks[-1], none)
        for i in reversed(range(strategies)):
            said = F.get(answers, F.lit(i))
            out = F.when(alive[i] & (said == "ok"), state(F.lit(i), masks[i], F.lit(i))).when(alive[i] & (said == "transient"), state(none, masks[i], none)).otherwise(out)
        return out

    def step(acc: Column, answers: Column) -> Column:
        s = acc["now"]
        said = F.get(answers, s["locked"])
        if strategies == 1:
            kept = state(s["locked"], s["dead"], F.when(said == "ok", s["locked"]).otherwise(none))
            new = F.when(s["locked"] >= 0, kept).otherwise(probe(answers, s["dead"]))
        else:
            mask = s["dead"].bitwiseOR(F.element_at(F.array(*(F.lit(b).cast("bigint") for b in bit)), F.greatest(s["locked"], F.lit(0)) + 1))
            new = (
                F.when((s["locked"] >= 0) & (said == "ok"), state(s["locked"], s["dead"], s["locked"]))
                .when((s["locked"] >= 0) & (said == "transient"), state(s["locked"], s["dead"], none))
                .when(s["locked"] >= 0, probe(answers, mask))
                .otherwise(probe(answers, s["dead"]))
            )
        return F.struct(new.alias("now"), F.array_append(acc["all"], new).alias("all"))

    start = state(none, F.lit(0), none)
    empty = F.filter(F.array(start), lambda x: F.lit(False))
    return F.aggregate(calls, F.struct(start.alias("now"), empty.alias("all")), step, lambda a: a["all"])
