"""Shared common table expressions for the SQL side."""

from __future__ import annotations

# DuckDB spelling of the white-space class used on the Spark side.
WS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"

CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, body: str, *needs: str) -> None:
    CTES[name] = (list(needs), body)


def with_ctes(body: str, *names: str) -> str:
    """``body`` headed by the named CTEs and all they need, each once.

    A body may start with a comma and go on with CTEs of its own.
    """
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for need in CTES[name][0]:
            visit(need)
        order.append(name)

    for name in names:
        visit(name)
    head = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order)
    body = body.strip()
    return f"WITH RECURSIVE {head}\n{body}"


def norm(col: str) -> str:
    return f"trim(regexp_replace({col}, '{WS}', ' ', 'g'))"


def toks(col: str) -> str:
    return f"regexp_extract_all(lower({col}), '[a-z0-9_]+')"


def overlap(q: str, h: str) -> str:
    """Share of query tokens, duplicates kept, found in list ``h``."""
    return (
        f"CASE WHEN len({q}) = 0 OR len({h}) = 0 THEN 0.0 "
        f"ELSE len(list_filter({q}, lambda t: list_contains({h}, t))) / len({q})::DOUBLE END"
    )


cte(
    "docs",
    f"SELECT doc_id AS doc_num, 'file:' || source || '/' || doc_id AS doc_id, source, lang, text, "
    f"{norm('text')} AS norm FROM documents",
)
cte(
    "doc_words",
    "SELECT doc_num, doc_id, source, lang, string_split(norm, ' ') AS w FROM docs WHERE norm <> ''",
    "docs",
)
cte(
    "chunks",
    "SELECT doc_num, doc_id, source, lang, i + 1 AS chunk_index, 'chunk_' || (i + 1) AS segment_id, "
    "array_to_string(list_slice(w, i * 180 + 1, i * 180 + 200), ' ') AS text "
    "FROM (SELECT *, unnest(range(0, greatest(0, ceil((len(w) - 200) / 180.0))::BIGINT + 1)) AS i FROM doc_words)",
    "doc_words",
)
