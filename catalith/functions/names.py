"""Names of catalog tables in one consistent form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Blanks and quote marks.
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0" + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
QUOTES = '"`[]'
#: Texts that say nothing.
EMPTY_PHRASES = ("", "-", "?", "n/a", "none", "null", "unknown", "tbd", "todo")

_UNQUOTE = str.maketrans("", "", QUOTES)


def table_key(*parts) -> str | None:
    """The parts that are not null or empty, joined with dots, then each step freed of quote marks and outer blanks, lower case; None if nothing is left."""
    joined = ".".join(str(p) for p in parts if p is not None and p != "")
    steps = [s.translate(_UNQUOTE).strip(BLANKS).lower() for s in joined.split(".")]
    return ".".join(steps) if any(steps) else None


def table_key_col(name: Column) -> Column:
    """table_key of one column, in the JVM."""
    steps = F.split(F.translate(name, QUOTES, ""), "\\.")
    key = F.array_join(F.transform(steps, lambda s: F.lower(F.btrim(s, F.lit(BLANKS)))), ".")
    return F.when(F.replace(key, F.lit("."), F.lit("")) != "", key)


def says_nothing(value) -> bool:
    return value is None or str(value).strip(BLANKS).lower() in EMPTY_PHRASES
