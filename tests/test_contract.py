"""Registered queries next to their SQL on the smallest tables; KB_ALL_QUERIES=1 runs them all."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as contract
from kbspark.plans import catalog

SF_DIR = os.environ.get("KB_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
SAMPLE = [
    "chunk_documents", "readable_text", "pii_redact", "upsert_segments", "library_status", "chunk_transcripts",
    "memory_supersede", "session_handoff", "vector_topk", "ontology_validate", "dashboard_timeseries", "stream_sessions",
    "memory_longterm_search", "memory_revisions", "memory_touch", "retrieve_filtered", "delete_cascade", "stream_debounce", "stream_handoff",
    "stream_compaction", "stream_expiry", "pii_pseudonymize", "pii_policy", "transcript_context", "keyword_search", "plain_transcript",
]
NAMES = sorted(contract.oracle_sql()) if os.environ.get("KB_ALL_QUERIES") else SAMPLE


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def ordered(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def test_every_query_has_sql_or_a_reason():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
    assert set(contract.queries()) >= set(catalog.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    df = contract.queries()[name](spark, SF_DIR)
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF_DIR}/{table}.parquet')")
    cursor = con.execute(contract.oracle_sql()[name])
    want = ordered([d[0] for d in cursor.description], cursor.fetchall())
    assert ordered(df.columns, [tuple(r) for r in df.collect()]) == want
