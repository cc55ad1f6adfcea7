"""Text expressions shared by operators, with their SQL twins for the oracle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space at the ends of a name; the same class for Java and RE2 expressions.
WS = r"[\s\x{85}\p{Z}\x{1c}-\x{1f}]"
STRIP = rf"^{WS}+|{WS}+$"


#: Names that are in TAG FORM as they stand; most are, and one match tells.
CANONICAL = r"^[a-z0-9()'\-]+(?:_[a-z0-9()'\-]+)*\z"


def tag_form(c: Column) -> Column:
    """Canonical tag: strip white space, strip commas, lower-case, blanks to ``_``,
    runs of ``_`` to one, strip ``_``. Null and empty stay null and empty."""
    t = F.regexp_replace(c, STRIP, "")
    t = F.lower(F.regexp_replace(t, r"^,+|,+$", ""))
    return F.when(c.rlike(CANONICAL), c).otherwise(F.regexp_replace(F.regexp_replace(t, r"[ _]+", "_"), r"^_|_$", ""))


def tag_form_sql(c: str) -> str:
    """:func:`tag_form` as DuckDB SQL."""
    return (
        f"regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace({c}, '{STRIP}', '', 'g'), "
        "'^,+|,+$', '', 'g')), '[ _]+', '_', 'g'), '^_|_$', '', 'g')"
    )


def stripped_lower(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, STRIP, ""))


def stripped_lower_sql(c: str) -> str:
    return f"lower(regexp_replace({c}, '{STRIP}', '', 'g'))"
