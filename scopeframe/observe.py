"""What is told while one source is renamed."""

from __future__ import annotations

import sys

from .functions.texts import CELLS, POINTS


def bar(done: int, total: int) -> str:
    done = min(done, total)
    filled = done * CELLS // total if total else CELLS
    cells = "=" * CELLS if done == total else "=" * filled + ">" + "-" * (CELLS - filled - 1)
    return f"[{cells}] {done}/{total} identifiers"


class Observer:
    """Lines for each identifier if verbose; a bar that is redrawn on a terminal, and logged now and then elsewhere."""

    def __init__(self, verbose: bool, progress: bool, ladder=None, stream=None):
        self.verbose, self.progress, self.ladder = verbose, progress, ladder
        self.stream = stream or sys.stderr
        self.terminal = self.stream.isatty()
        self.done = self.total = self.width = 0
        self.logged: int | None = None
        self.strategy: str | None = None

    def say(self, text: str) -> None:
        if self.progress and self.terminal and self.width:
            self.stream.write("\r" + " " * self.width + "\r")
            self.width = 0
        print(text, file=self.stream)

    def draw(self) -> None:
        if not self.progress:
            return
        line = bar(self.done, self.total)
        if self.terminal:
            self.stream.write("\r" + line)
            self.width = len(line)
            if self.done == self.total:
                self.stream.write("\n")
                self.width = 0
            self.stream.flush()
            return
        percent = self.done * 100 // self.total if self.total else 100
        if self.logged is None or self.done == self.total or percent >= self.logged + POINTS:
            print(line, file=self.stream)
            self.logged = percent

    def found(self, total: int) -> None:
        self.total = total
        if self.verbose:
            self.say(f"* found {total} identifiers")
        self.draw()

    def started(self, current: int, total: int, name: str) -> None:
        if self.verbose:
            self.say(f"* [{current}/{total}] renaming `{name}`")

    def finished(self, current: int, total: int, name: str, new: str) -> None:
        if self.verbose:
            now = self.ladder.locked_name if self.ladder is not None else None
            if now is not None and now != self.strategy:
                self.strategy = now
                self.say(f"* selected JSON strategy: {now}")
            self.say(f"* [{current}/{total}] `{name}` -> `{new}`")
        self.done, self.total = current, total
        self.draw()
