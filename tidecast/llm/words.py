"""Column expressions shared by the operators: words between ASCII white space, and bindings inside expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the characters x20 and x09 to x0D separate words.
SPACE_CLASS = r"[ \t-\r]"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def ascii_words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts give an empty one."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(F.length(bare) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_CLASS + "+"))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]
