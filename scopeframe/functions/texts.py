"""Texts shown to people and to models."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cells of the progress bar, and points between two logged lines.
CELLS, POINTS = 30, 10
SYSTEM = (
    "You name variables in JavaScript whose own names were shortened. From the code around it, find what one identifier stands for, "
    "and answer with a single descriptive name, as JSON and nothing else."
)
RULES = (
    "Use camelCase, or PascalCase for a class or constructor.",
    "Use ASCII letters, digits and underscores, and no digit first.",
    "Use no reserved word.",
    "Give the present name back if it already says what the thing is.",
)
#: The schema of an answer.
SCHEMA = {
    "type": "object",
    "additionalProperties": False,
    "required": ["name"],
    "properties": {"name": {"type": "string", "minLength": 1, "maxLength": 64, "description": "The new name."}},
}


def prompt_text(name: str, surrounding: str) -> str:
    rules = "\n".join(f"- {x}" for x in RULES)
    return f"```javascript\n{surrounding}\n```\n\nGive a name for the identifier `{name}` in this code.\n{rules}"


def prompt(name: Column, surrounding: Column) -> Column:
    head, _, tail = prompt_text("\x00", "\x01").partition("\x01")
    middle, _, end = tail.partition("\x00")
    return F.concat(F.lit(head), surrounding, F.lit(middle), name, F.lit(end))


def progress(done: Column, total: Column) -> Column:
    """A bar with counts; done is at most total, and no identifiers at all is a full bar."""
    done = F.least(done, total)
    filled = F.when(total > 0, F.floor(done * CELLS / F.greatest(total, F.lit(1)))).otherwise(CELLS).cast("int")
    bar = F.when(done >= total, "=" * CELLS).otherwise(F.concat(F.repeat(F.lit("="), filled), F.lit(">"), F.repeat(F.lit("-"), CELLS - filled - 1)))
    return F.concat(F.lit("["), bar, F.lit("] "), done.cast("string"), F.lit("/"), total.cast("string"), F.lit(" identifiers"))


def logged_steps(total: Column) -> Column:
    """The array of done counts, from 0 to total, at which a log that isn't a terminal has a line: the first, the last, and
    each at least POINTS per cent after the line before."""
    percent = lambda k: F.when(total > 0, F.floor(k * 100 / F.greatest(total, F.lit(1)))).otherwise(100).cast("int")
    start = F.struct(F.lit(-1000).alias("last"), F.array().cast("array<bigint>").alias("out"))
    step = lambda a, k: F.when(
        (k == total) | (percent(k) >= a["last"] + POINTS), F.struct(percent(k).alias("last"), F.array_append(a["out"], k).alias("out"))
    ).otherwise(a)
    return F.aggregate(F.sequence(F.lit(0).cast("bigint"), total.cast("bigint")), start, step, lambda a: a["out"])
