"""Column expressions for dirty keys and words. All stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_key(c: str | Column) -> Column:
    """Outer blanks cut, letters lowered; blanks only is no value (null)."""
    return F.nullif(F.lower(F.trim(col(c))), F.lit(""))


def clean_word(c: str | Column) -> Column:
    """As ``clean_key``; a blank or hyphen inside becomes an underscore."""
    return F.translate(clean_key(c), " -", "__")


def day_text(c: str | Column) -> Column:
    """A date as ``yyyy-MM-dd`` text (a plain cast, which needs no formatter)."""
    return col(c).cast("date").cast("string")


def month_text(c: str | Column) -> Column:
    """The month ``yyyy-MM`` of a date or timestamp."""
    return F.date_format(col(c), "yyyy-MM")
