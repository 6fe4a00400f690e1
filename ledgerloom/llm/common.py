"""Small helpers that several of the text operators share."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
_LOWER_BYTES = bytes(_LOWER.get(c, c) for c in range(256))


def lower_ascii(text: str) -> str:
    """Lower-cases A-Z only; every other character stays."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER_BYTES).decode("utf-8", "surrogatepass")


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under fixed names; whatever else the table holds cannot clash."""
    return df.select(*[df[source].alias(name) for name, source in columns.items()])


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not use yet, in any case."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def or_empty(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))
