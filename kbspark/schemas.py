"""Column layouts of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _fields(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


S, L, I, D, TS = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.TimestampNTZType()
LIST = T.ArrayType(S)

DOCUMENTS = _fields(
    doc_id=S, source_id=S, source_version=S, source_type=S, source_uri=S, title=S, language=S,
    summary_short=S, summary_long=S, metadata=S, created_at=TS,
)
KB_SEGMENTS = _fields(
    doc_id=S, segment_id=S, start_ms=L, end_ms=L, speaker=S, text=S, topics=LIST, entities=LIST,
    source_refs=S, updated_at=TS,
)
ENTITIES = _fields(entity_id=S, name=S, type=S, aliases=LIST, metadata=S, updated_at=TS)
RELATIONS = _fields(
    rel_id=S, subj_entity_id=S, predicate=S, obj_entity_id=S, doc_id=S, segment_id=S, confidence=D, created_at=TS
)
ONTOLOGY = _fields(predicate=S, domain_type=S, range_type=S, description=S, updated_at=TS)
CLAIMS = _fields(claim_id=S, claim_text=S, doc_id=S, segment_id=S, confidence=D, created_at=TS)
MEMORY = _fields(memory_id=S, category=S, text=S, topics=LIST, entities=LIST, source_refs=S, created_at=TS)
INITIATIVES = _fields(
    initiative_id=S, title=S, scores=S, overall_score=D, rationale=S, citations=S, updated_at=TS
)
INITIATIVE_REPORTS = _fields(report_id=S, report=S, created_at=TS)
EMBEDDINGS = _fields(
    doc_id=S, segment_id=S, source_id=S, source_version=S, text=S, text_hash=S, embedding=T.ArrayType(D),
    start_ms=L, end_ms=L, speaker=S, source_refs=S, updated_at=TS,
)
EVIDENCE = _fields(
    question_id=S, doc_id=S, segment_id=S, start_ms=L, end_ms=L, speaker=S, text_snippet=S, score=D,
    retrieval_source=S, source_refs=S, memory_type=S, memory_kind=S, memory_id=S, final_score=D,
    feedback_boost=D,
)
VOICEPRINTS = _fields(voiceprint_id=S, speaker_local_id=S, segment_count=L, source_id=S)
CHUNKS = _fields(doc_id=S, segment_id=S, text=S)

# Keys the stored tables are maintained by.
KEYS = {
    "documents": ["source_id", "source_version"],
    "kb_segments": ["doc_id", "segment_id"],
    "memory": ["memory_id"],
    "entities": ["entity_id"],
    "relations": ["rel_id"],
    "claims": ["claim_id"],
    "ontology": ["predicate", "domain_type", "range_type"],
    "initiatives": ["initiative_id"],
    "manifests": ["source_id", "source_version"],
    "embeddings": ["doc_id", "segment_id"],
}

# Shapes of model output, read from JSON text.
MODEL_OUTPUT = {
    "enrich_doc": T.StructType(
        [T.StructField("summary_short", S, False), T.StructField("summary_long", S, False),
         T.StructField("topics", LIST), T.StructField("entities", LIST)]
    ),
    "enrich_chunk": _fields(topics=LIST, entities=LIST),
    "analyze": _fields(claims=LIST, timeline=LIST, open_questions=LIST),
}
INITIATIVE_INPUT = _fields(
    initiative_id=S, title=S, problem_statement=S, users_affected=S, data_sources=LIST, feasibility=S,
    risk_compliance=S, expected_value=S, dependencies=LIST, time_to_value=S, strategic_alignment=S,
)
