"""Scalar text functions as column expressions; Python only where no expression has the semantics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEP = "\u001f"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rendered(c: Column | str, kind: str = "string") -> Column:
    """A value as the identity contract spells it: None, True and False as words."""
    c = _c(c)
    if kind == "boolean":
        return F.when(c.isNull(), "None").when(c, "True").otherwise("False")
    return F.coalesce(c.cast("string"), F.lit("None"))


def stable_id(namespace: str, *parts: Column | str) -> Column:
    """namespace_ and the first 16 hex digits of the SHA-1 over namespace and parts, joined by the unit separator."""
    return F.concat(F.lit(namespace + "_"), F.substring(F.sha1(F.concat_ws(SEP, F.lit(namespace), *[rendered(p) for p in parts])), 1, 16))


def split_tokens(c: Column | str) -> Column:
    """Lower-case tokens: cut at camel case and at everything that is no letter or digit."""
    spaced = F.regexp_replace(_c(c), r"(?<=\p{Ll})(?=\p{Lu})", " ")
    return F.filter(F.split(F.lower(F.regexp_replace(spaced, r"[^\p{L}\p{N}]+", " ")), " "), lambda x: x != "")


def token_set(c: Column | str) -> Column:
    """Distinct tokens; digits before a capital also part words."""
    spaced = F.regexp_replace(_c(c), r"(?<=[a-z0-9])(?=[A-Z])", " ")
    return F.array_distinct(F.filter(F.split(F.lower(F.regexp_replace(spaced, r"[^\p{L}\p{N}]+", " ")), " "), lambda x: x != ""))


def compact_key(c: Column | str) -> Column:
    """Letters and digits only, lower case."""
    return F.regexp_replace(F.lower(_c(c)), r"[^\p{L}\p{N}]", "")


def estimated_tokens(byte_count: Column | str) -> Column:
    return F.ceil(_c(byte_count) / 4)


def source_lines(c: Column | str) -> Column:
    """Lines as str.splitlines() cuts them: every Unicode line end, none after the last."""
    ends = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"
    t = F.regexp_replace(_c(c), f"(?:{ends})\\z", "")
    return F.when(_c(c) == "", F.array().cast("array<string>")).otherwise(F.split(t, ends, -1))


def line_count(c: Column | str) -> Column:
    return F.size(source_lines(c))


def report_slug(c: Column | str) -> Column:
    """Lower-case words joined by hyphens, at most 80 characters."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(_c(c))), r"[^\p{L}\p{N}_-]+", "-"), r"^-+|-+$", "")
    return F.substring(F.when(s == "", "query").otherwise(s), 1, 80)


def diagram_label(c: Column | str) -> Column:
    """A label that cannot break out of a diagram node."""
    s = F.regexp_replace(_c(c), r"[\r\n]+", " ")
    for a, b in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;"), ("[", "("), ("]", ")"), ("{", "("), ("}", ")"), ("|", "/")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def ordered_distinct(c: Column | str) -> Column:
    """First occurrences in order, empty and null ones dropped."""
    return F.array_distinct(F.filter(_c(c), lambda x: x.isNotNull() & (x != "")))


def canonical_digest(*fields: Column | str) -> Column:
    """SHA-256 of the compact JSON of string and integer fields, in the order of their names."""
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


@F.pandas_udf(T.StringType())
def head_and_tail(text: pd.Series, budget: pd.Series) -> pd.Series:
    """A text within so many UTF-8 bytes: its head and its tail with a mark between, no character split."""

    def cut(t, n):
        if t is None:
            return None
        raw = t.encode("utf-8")
        if len(raw) <= n:
            return t
        mark = "\n...\n"
        room = max(0, n - len(mark))
        head, tail = raw[: room * 2 // 3], raw[len(raw) - (room - room * 2 // 3) :]
        return head.decode("utf-8", "ignore") + mark + tail.decode("utf-8", "ignore")

    return pd.Series([cut(t, n) for t, n in zip(text, budget)])


@F.pandas_udf(T.StringType())
def single_json_object(text: pd.Series) -> pd.Series:
    """The one JSON object a text holds, compact with sorted keys; null where it is none or has more behind it."""
    import json

    def one(t):
        try:
            v = json.loads(t)
        except (TypeError, ValueError):
            return None
        return json.dumps(v, ensure_ascii=False, sort_keys=True, separators=(",", ":")) if isinstance(v, dict) else None

    return pd.Series([one(t) for t in text])


@F.pandas_udf(T.StringType())
def casefolded(text: pd.Series) -> pd.Series:
    return text.str.casefold()
