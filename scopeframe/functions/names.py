"""Identifier names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..jsparse.parser import RESERVED

#: What XID_Continue holds beyond letters, marks, decimal digits, letter numbers and connectors, and what it lacks.
EXTRA = r"\x{B7}\x{387}\x{1369}-\x{1371}\x{19DA}\x{200C}\x{200D}\x{2118}\x{212E}\x{30FB}\x{FF65}"
LACKING = r"\x{37A}\x{2E2F}\x{FC5E}-\x{FC63}\x{FDFA}\x{FDFB}\x{FE70}\x{FE72}\x{FE74}\x{FE76}\x{FE78}\x{FE7A}\x{FE7C}\x{FE7E}"
CONTINUE = rf"[$[\p{{L}}\p{{Nl}}\p{{Mn}}\p{{Mc}}\p{{Nd}}\p{{Pc}}{EXTRA}]&&[^{LACKING}]]"


def is_reserved(name: Column) -> Column:
    """Words that can't be a binding in strict code, with let and static, without async."""
    return name.isin(*sorted(RESERVED))


def to_identifier(raw: Column) -> Column:
    """A valid identifier: runs of dots, spaces and hyphens capitalise what follows, other foreign characters go, and an
    underscore is put before a digit or a reserved word; nothing left gives an underscore."""
    clean = F.regexp_replace(raw, rf"(?s)(?![. \-]|{CONTINUE}).", "")
    clean = F.regexp_replace(clean, r"\A[. \-]+", "")
    parts = F.split(clean, r"[. \-]+")
    joined = F.array_join(F.transform(parts, lambda s, i: F.when(i == 0, s).otherwise(F.concat(F.upper(F.substring(s, 1, 1)), F.substr(s, F.lit(2))))), "")
    return F.when(joined == "", "_").when(joined.rlike(r"\A[0-9]") | is_reserved(joined), F.concat(F.lit("_"), joined)).otherwise(joined)


def stem(name: Column) -> Column:
    """The name without its trailing ASCII digits; a name of digits alone is its own stem."""
    return F.when(name.rlike(r"\A[0-9]*\z"), name).otherwise(F.regexp_replace(name, r"[0-9]+\z", ""))


def numeric_suffix(name: Column) -> Column:
    """The trailing number, up to 64 bits without sign; null if there is none, or it is larger."""
    digits = F.when(name.rlike(r"\A[0-9]*\z"), F.lit("")).otherwise(F.regexp_extract(name, r"([0-9]+)\z", 1))
    number = F.nullif(digits, F.lit("")).try_cast("decimal(38,0)")
    return F.when(number <= F.lit("18446744073709551615").cast("decimal(38,0)"), number.cast("decimal(20,0)"))


def next_free(base: Column, taken: Column) -> Column:
    """``base`` if it isn't in the array ``taken``; else its stem with the next number that isn't."""
    first = F.coalesce(numeric_suffix(base) + 1, F.lit(2).cast("decimal(20,0)")).cast("long")
    tries = F.transform(F.sequence(first, first + F.size(taken)), lambda n: F.concat(stem(base), n.cast("string")))
    return F.when(F.array_contains(taken, base), F.element_at(F.filter(tries, lambda x: ~F.array_contains(taken, x)), 1)).otherwise(base)
