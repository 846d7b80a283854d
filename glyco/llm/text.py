"""Column expressions that several text operators share."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def whole(text: Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(text, F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    t = whole(text)
    ascii_only = F.octet_length(t) == F.char_length(t)
    return F.when(ascii_only, F.lower(t)).otherwise(F.translate(t, string.ascii_uppercase, string.ascii_lowercase))
