"""Stable identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_version(text: Column) -> Column:
    return F.sha2(text, 256)


def source_id(kind: str, value: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), value.cast("string"))


def source_kind(sid: Column) -> Column:
    return F.when(F.instr(sid, ":") > 0, F.substring_index(sid, ":", 1))


def source_value(sid: Column) -> Column:
    """All that follows the first colon."""
    return F.regexp_extract(sid, r"(?s)^[^:]*:(.*)$", 1)


def safe_source_id(sid: Column, limit: int = 200) -> Column:
    """An id fit for a file name. Beyond ``limit`` characters its end is replaced by a hash of
    the whole id, so that long ids stay apart."""
    safe = F.regexp_replace(sid, "[^a-zA-Z0-9._-]", "_")
    return F.when(F.length(safe) <= limit, safe).otherwise(F.concat(F.substring(safe, 1, limit - 65), F.lit("_"), F.sha2(sid, 256)))


def keyed_id(*parts: Column | str) -> Column:
    """SHA-256 over the parts joined by a hyphen."""
    columns = [F.lit(p) if isinstance(p, str) else p for p in parts]
    return F.sha2(F.concat_ws("-", *columns), 256)
