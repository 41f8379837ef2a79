"""Redaction of credential-shaped text as chained regular expression replacements, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The token families and assignment names that are hidden, in their order of application.
OPAQUE = [
    r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    r"\bgh[pousr]_[A-Za-z0-9_]{20,}\b",
    r"(?i)\bgithub_pat_[A-Za-z0-9_]{20,}\b",
    r"(?i)\bglpat-[A-Za-z0-9_-]{12,}\b",
    r"(?i)\bxox[baprs]-[A-Za-z0-9_-]{12,}\b",
    r"(?i)\bsk-ant-[A-Za-z0-9_-]{12,}\b",
    r"\b(?:sk|rk)-(?:live|test|proj)-[A-Za-z0-9_-]{12,}\b",
    r"\bsk-[A-Za-z0-9_-]{20,}\b",
    r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b",
]
OPAQUE_NARROW = [OPAQUE[0], OPAQUE[1], OPAQUE[2], OPAQUE[6], OPAQUE[8]]
NAMES = (r"(?:[A-Za-z][A-Za-z0-9]*[_-])*(?:api[_-]?key|client[_-]?secret|secret(?:[_-]access)?[_-]?key|access[_-]?token|auth[_-]?token|refresh[_-]?token|token|"
         r"database[_-]?url|connection[_-]?string|password|passwd|private[_-]?key|credential)s?")
NAMES_NARROW = (r"(?:api[_-]?key|client[_-]?secret|access[_-]?token|auth[_-]?token|refresh[_-]?token|github[_-]?token|database[_-]?url|connection[_-]?string|"
                r"secret|password|passwd|private[_-]?key|credential)s?")
KEY = r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----[\s\S]*?-----END (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"
URL = r"(?i)\b([a-z][a-z0-9+.-]*://)([^\s/@:]+):([^\s/@]+)@"
BEARER = r"(?i)(\b(?:authorization\s*:\s*)?bearer\s+)[^\s,;]+"
FULL_FIELDS = {"description", "explanation", "license", "message", "notes", "purpose", "reason", "remote", "signature", "snippet", "summary", "text"}
HIDDEN = "[REDACTED]"


def _assignment(names: str) -> str:
    return rf"(?im)(\b{names}\b\s*[:=]\s*)(?<quote>[\"']?)(?<value>[^\r\n,;#\"']+)\k<quote>"


def _hide(c: Column, patterns: list[str]) -> Column:
    for p in patterns:
        c = F.regexp_replace(c, p, HIDDEN)
    return c


def _frame(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, KEY, "[REDACTED PRIVATE KEY]"), URL, "$1[REDACTED]@"), BEARER, "$1[REDACTED]")


def redact_opaque(c: Column | str) -> Column:
    """Private keys, credentials in URLs, bearer values and token families."""
    return _hide(_frame(F.col(c) if isinstance(c, str) else c), OPAQUE)


def redact_text(c: Column | str) -> Column:
    """As above, and values assigned to credential-like names."""
    return _hide(F.regexp_replace(redact_opaque(c), _assignment(NAMES), "$1[REDACTED]"), OPAQUE)


def redact_evidence(c: Column | str) -> Column:
    """The narrower set that evidence snippets pass through first."""
    c = _frame(F.col(c) if isinstance(c, str) else c)
    return _hide(F.regexp_replace(c, _assignment(NAMES_NARROW), "$1[REDACTED]"), OPAQUE_NARROW)


def redact_record(c: Column, kind: T.DataType, field: str | None = None) -> Column:
    """Every string leaf of a nested value: named text fields in full, all others for token families only."""
    if isinstance(kind, T.StringType):
        return redact_text(c) if (field or "").lower() in FULL_FIELDS else redact_opaque(c)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: redact_record(x, kind.elementType, field))
    if isinstance(kind, T.StructType):
        return F.when(c.isNull(), F.lit(None)).otherwise(F.struct(*[redact_record(c[f.name], f.dataType, f.name).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        return F.transform_values(c, lambda k, v: redact_record(v, kind.valueType, None))
    return c
