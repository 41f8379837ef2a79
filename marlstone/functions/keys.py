"""Keys and paths: the cleaning rules every table shares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, for trimming keys.
WS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def clean_key(c: Column | str) -> Column:
    """The key without surrounding white space; an empty key is null."""
    t = F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(WS))
    return F.when(t != "", t)


def clean_path(c: Column | str) -> Column:
    """Slashes for backslashes, no leading ``./``; otherwise the path as it stands."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.translate(c, "\\", "/"), r"^(\./)+", "")
