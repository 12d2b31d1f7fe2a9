"""String column expressions. All of them stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character Python's str.strip() removes. Spark's one-argument trim removes U+0020 only.
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c: Column | str) -> Column:
    """Python's ``str.strip()``. A two-argument trim: linear, where an anchored regex is not."""
    return F.btrim(_col(c), F.lit(WHITESPACE))


def clean_target(c: Column | str, sigil: Column | str) -> Column:
    """Strip blanks, then remove one leading sigil. ``sigil`` is ``#`` or ``@``, or a column of them."""
    bare = strip_ws(c)
    mark = F.lit(sigil) if isinstance(sigil, str) else sigil
    return F.when(F.startswith(bare, mark), F.substring(bare, 2, 2**31 - 1)).otherwise(bare)


def file_target(c: Column | str, sigil: Column | str) -> Column:
    """Remove every leading and trailing sigil; blanks stay."""
    return F.btrim(_col(c), F.lit(sigil) if isinstance(sigil, str) else sigil)


def clean_handle(c: Column | str) -> Column:
    """Strip blanks, then remove every ``@``."""
    return F.replace(strip_ws(c), F.lit("@"), F.lit(""))


def parse_time(c: Column | str) -> Column:
    """The typed copy of a post's time string; NULL where the string is no timestamp (``3h``)."""
    return F.try_to_timestamp(_col(c))


def preview_text(c: Column | str, width: int = 50) -> Column:
    """The first ``width`` characters and three dots, always both."""
    return F.concat(F.substring(_col(c), 1, width), F.lit("..."))
