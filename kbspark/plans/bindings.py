"""The driver's tables in the shapes the operators take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.functions import ids
from kbspark.functions import text as tx
from kbspark.operators import chunking
from kbspark.plans.registry import table
from kbspark.session import stored


def as_of() -> Column:
    """The fixed "now" of all queries."""
    return F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")


def source_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("doc_num"),
        F.concat(F.lit("file:"), F.col("source"), F.lit("/"), F.col("doc_id")).alias("doc_id"),
        "source",
        "lang",
        "text",
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = source_documents(spark, sf_dir)
    return chunking.chunk_documents(docs.withColumn("text", tx.normalize_space(F.col("text"))))


def stored_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk table as an ingest leaves it, for queries that read it more than once."""
    return stored(chunks(spark, sf_dir), "chunks")


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One version per document and a second one for English documents; later steps where
    labels or vectors exist."""
    docs = source_documents(spark, sf_dir).select("doc_num", "doc_id", "lang", "source", "text")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("doc_num"), "quality")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_num"), F.lit(True).alias("_vec"))
    step = lambda name, n: F.struct(
        F.lit(name).alias("key"), F.struct(F.lit("done").alias("status"), F.lit(n).alias("chunk_count")).alias("value")
    )
    steps = F.map_from_entries(
        F.filter(
            F.array(
                step("ingest_doc", None).cast(_STEP),
                F.when(F.col("quality").isNotNull(), step("chunk_text", 3).cast(_STEP)),
                F.when(F.col("_vec"), step("embed_chunks", None).cast(_STEP)),
            ),
            lambda x: x.isNotNull(),
        )
    )
    base = docs.join(labels, "doc_num", "left").join(vectors, "doc_num", "left")
    versions = F.when(F.col("lang") == "en", F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return base.select("*", F.explode(versions).alias("_v")).select(
        "doc_num",
        F.col("doc_id").alias("source_id"),
        F.concat(F.lit("v"), "_v", F.lit("-"), F.sha2("text", 256)).alias("source_version"),
        F.col("source").alias("source_type"),
        "lang",
        steps.alias("steps"),
        F.timestamp_add("MINUTE", (F.col("doc_num") + F.col("_v") * 7), F.lit("2024-01-01").cast("timestamp_ntz")).alias(
            "updated_at"
        ),
    )


_STEP = "struct<key:string,value:struct<status:string,chunk_count:int>>"


def stored_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector table with the source it belongs to."""
    docs = source_documents(spark, sf_dir).select(F.col("doc_num").alias("vec_id"), "doc_id")
    return table(spark, sf_dir, "embeddings").join(docs, "vec_id").select(
        "vec_id",
        "doc_id",
        F.col("doc_id").alias("source_id"),
        F.lit("chunk_1").alias("segment_id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        "label",
    )


JOB_STATUS = {"purchase": "done", "error": "failed", "click": "queued", "view": "running", "signup": "queued"}


def event_key(events: DataFrame) -> DataFrame:
    return events.withColumn("k", F.get_json_object("props", "$.k").cast("long"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = event_key(table(spark, sf_dir, "events"))
    status = F.create_map(*[F.lit(x) for pair in JOB_STATUS.items() for x in pair])
    return events.select(
        F.concat(F.lit("j"), "event_id").alias("job_id"),
        status[F.col("event_type")].alias("status"),
        F.when(F.col("event_type") == "signup", 1).otherwise(0).alias("attempts"),
        F.col("user_id").alias("doc_num"),
        F.col("ts").alias("created_at"),
        F.timestamp_add("MINUTE", F.col("k"), F.col("ts")).alias("updated_at"),
    )


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = event_key(table(spark, sf_dir, "events"))
    k = F.col("k")
    return events.select(
        F.concat(F.lit("r"), "event_id").alias("run_id"),
        F.col("ts").alias("created_at"),
        F.col("event_type").alias("component"),
        F.when(k % 5 == 4, F.lit("")).otherwise(F.concat(F.lit("model_"), (k % 5).cast("string"))).alias("model"),
        F.when(
            k % 2 == 0, F.to_json(F.struct((k * 3).alias("egress_policy_input_chars")))
        ).otherwise(
            F.to_json(F.struct(k.alias("question_len"), F.lit(10).alias("evidence_prompt_chars")))
        ).alias("input_json"),
        F.to_json(
            F.struct(
                F.concat(F.lit("answer "), "event_type").alias("answer_text"),
                F.array(F.lit("ab"), F.col("event_type")).alias("claims"),
            )
        ).alias("output_json"),
        F.when(F.col("event_type") == "error", F.lit("boom")).alias("error"),
    )


def transcript_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as transcript segments of nine seconds, one every ten."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"),
        F.col("turn").alias("seq"),
        F.concat(F.lit("seg_"), F.col("turn") + 1).alias("segment_id"),
        (F.col("turn") * 10000).alias("start_ms"),
        (F.col("turn") * 10000 + 9000).alias("end_ms"),
        F.when(F.col("role") == "user", "UNKNOWN").when(F.col("role") == "system", "host").alias("speaker_local_id"),
        "role",
        "text",
    )


def gallery_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return table(spark, sf_dir, "supplier").join(nations, "s_nationkey").select(
        F.concat(F.lit("vp_"), "s_suppkey").alias("voiceprint_id"),
        F.when(F.col("s_acctbal") > 2000, F.col("s_name")).alias("display_name"),
        F.lit("CEO").alias("title"),
        F.array(F.col("n_name"), F.lit(None).cast("string")).alias("organizations"),
        F.array(F.lit("supplier")).alias("tags"),
        F.create_map(F.lit("table"), F.lit("supplier")).alias("source_refs"),
    )


def gallery_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, sf_dir, "customer").join(nations, "c_nationkey").select(
        F.concat(F.lit("vp_"), "c_custkey").alias("voiceprint_id"),
        F.col("c_name").alias("display_name"),
        F.lit("Channel").alias("title"),
        F.array("n_name").alias("organizations"),
        F.array(F.lit("auto"), F.col("c_mktsegment")).alias("tags"),
        F.create_map(F.lit("table"), F.lit("customer"), F.lit("segment"), F.col("c_mktsegment")).alias("source_refs"),
    )


def raw_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One memory per event; its text follows one of six forms filled from the event."""
    events = event_key(table(spark, sf_dir, "events"))
    k, kind = F.col("k"), F.col("event_type")
    none = F.lit(None).cast("string")
    form = F.col("event_id") % 6
    text = (
        F.when(form == 0, F.concat(F.lit("My favorite editor is tool_"), k % 10))
        .when(form == 1, F.concat(F.lit("Step by step workflow: 1. run job_"), k, F.lit(" 2. check")))
        .when(form == 2, F.concat(F.lit("we talked about "), kind, F.lit(" yesterday")))
        .when(form == 3, F.concat(F.lit("todo: review "), kind, F.lit(" "), k))
        .when(form == 4, F.concat(F.lit("I prefer "), kind, F.lit(" "), k % 7, F.lit(".")))
        .otherwise(F.concat(F.lit("note on "), kind, F.lit(" value "), k))
    )
    hint = (
        F.when(kind == "view", "session").when(kind == "click", "working").when(kind == "purchase", "long_term")
        .when(kind == "error", " Working ").otherwise("other")
    )
    feedback = kind == "error"
    return events.select(
        F.concat(F.lit("m"), "event_id").alias("memory_id"),
        hint.alias("memory_type"),
        text.alias("text"),
        F.array(kind, F.when((kind == "signup") & (k % 5 == 0), F.lit(" To-Do")).otherwise(F.lit("topic "))).alias("topics"),
        F.array(F.concat(F.lit("user_"), "user_id")).alias("entities"),
        F.when(feedback, "retrieval_feedback").when(kind == "signup", "context_turn").alias("kind"),
        none.alias("memory_kind"),
        F.concat(F.lit("u"), "user_id").alias("user_id"),
        F.concat(F.lit("p"), k % 3).alias("project_id"),
        none.alias("session_id"),
        (F.col("value") / 50).alias("importance"),
        F.lit(None).cast("double").alias("confidence"),
        (k % 25).alias("access_count"),
        F.col("ts").alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("expires_at"),
        F.when(k % 10 == 0, F.timestamp_add("DAY", F.lit(60), F.col("ts"))).alias("pinned_until"),
        F.when(feedback & (k % 2 == 0), F.array(F.lit("cited"), F.when(k % 4 == 0, "cited").otherwise("missed"))).alias(
            "signals"
        ),
        F.when(feedback, F.lit(1)).alias("cited_count"),
        F.when(feedback, F.lit(2)).alias("missed_count"),
    )


def memory_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kbspark.operators import memory

    return memory.write_batch(raw_memories(spark, sf_dir))


def stored_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The memory table as a batch write leaves it, for queries that read it more than once."""
    return stored(memory_items(spark, sf_dir), "memories")


def recallable_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table with only the columns that recall reads, so the others are never worked out."""
    from kbspark.operators import memory

    return stored(memory_items(spark, sf_dir).select(*memory.RECALL_COLUMNS), "memories")


def recall_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user the type of the latest event, asked within the user's scope; per event type one
    question without a scope."""
    events = table(spark, sf_dir, "events")
    latest = events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"))
    none = F.lit(None).cast("string")
    columns = lambda qid, text, user: [
        qid.alias("query_id"), text.alias("query"), none.alias("want_type"), none.alias("want_kind"),
        user.alias("user_id"), none.alias("project_id"), none.alias("session_id"),
    ]
    kind = F.col("event_type")
    mine = latest.select(
        *columns(F.concat(F.lit("u"), "user_id"), F.concat(F.lit("Review "), kind), F.concat(F.lit("u"), "user_id"))
    )
    shared = events.select("event_type").distinct().select(
        *columns(F.concat(F.lit("t-"), kind), F.concat(F.lit("prefer "), kind), none)
    )
    return mine.unionByName(shared)


def as_turns(pairs: DataFrame) -> DataFrame:
    """Pairs ``(session_id, turn, question, answer)`` in stored form; a turn cites its own place."""
    from kbspark.operators import sessions

    start = F.lit("2024-01-01").cast("timestamp_ntz")
    return pairs.select(
        "session_id",
        F.timestamp_add("MINUTE", F.col("session_id") * 60 + F.col("turn"), start).alias("ts"),
        F.col("turn").alias("turn_no"),
        sessions.turn_text(F.col("question"), F.col("answer")).alias("text"),
        F.array(
            F.struct(
                F.concat(F.lit("d"), "session_id").alias("doc_id"), F.concat(F.lit("seg_"), "turn").alias("segment_id")
            )
        ).alias("citations"),
    )


def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the assistant's reply, in stored form."""
    rows = table(spark, sf_dir, "conversations")
    asked = rows.where("role = 'user'").select(F.col("conv_id").alias("session_id"), "turn", F.col("text").alias("question"))
    replies = rows.where("role = 'assistant'").select(
        F.col("conv_id").alias("session_id"), (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    return as_turns(asked.join(replies, ["session_id", "turn"]))


def event_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as turns of one long-running session per user."""
    events = event_key(table(spark, sf_dir, "events"))
    return events.select(
        F.col("user_id").alias("session_id"),
        "ts",
        F.col("event_id").alias("turn_no"),
        F.concat(F.lit("ask "), "event_type", F.lit(" "), F.col("k") % 4).alias("question"),
        F.concat(F.lit("answer "), "event_type", F.lit(" "), "k").alias("answer"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark texts, and two questions per event type that only memories can answer: one
    over all memories and one over those of a single user."""
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("item_id"), F.col("embedding").cast("array<double>").alias("embedding")
    )
    none = F.lit(None).cast("string")
    asked = table(spark, sf_dir, "benchmark").join(vectors, "item_id", "left").select(
        F.concat(F.lit("b"), "item_id").alias("question_id"),
        tx.user_text(F.col("text"), 2400).alias("query"),
        "embedding",
        F.col("item_id").alias("session_id_num"),
        none.alias("user_id"),
        F.concat(F.lit("p"), F.col("item_id") % 3).alias("project_id"),
        none.alias("memory_user_id"),
    )
    of_user = table(spark, sf_dir, "events").groupBy("event_type").agg(F.concat(F.lit("u"), F.min("user_id")).alias("own"))
    both = of_user.select("event_type", F.explode(F.array(F.struct(F.lit("m-").alias("p"), none.alias("own")), F.struct(F.lit("n-").alias("p"), "own"))).alias("w"))
    recalled = both.select(
        F.concat("w.p", "event_type").alias("question_id"),
        F.concat(F.lit("Review "), "event_type").alias("query"),
        F.lit(None).cast("array<double>").alias("embedding"),
        F.lit(None).cast("long").alias("session_id_num"),
        none.alias("user_id"),
        none.alias("project_id"),
        F.col("w.own").alias("memory_user_id"),
    )
    return asked.unionByName(recalled)


def evidence_vectors(spark: SparkSession, sf_dir: str, segments: DataFrame) -> DataFrame:
    """Stored vectors with the text of the chunk they stand for."""
    first = segments.where("chunk_index = 1").select("doc_id", "text")
    return stored_vectors(spark, sf_dir).join(first, "doc_id", "left").select(
        F.col("vec_id").alias("vector_id"), "embedding", "doc_id", "segment_id", "text"
    )


def feedback_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event on a question (``k``) as feedback on one of its five nearest vectors."""
    from kbspark.operators.vectors import top_vectors

    asked = questions(spark, sf_dir).where("embedding IS NOT NULL")
    vectors = stored_vectors(spark, sf_dir)
    near = top_vectors(asked, vectors.select(F.col("vec_id").alias("vector_id"), "embedding"), 5, "question_id", "vector_id")
    places = near.join(vectors.select(F.col("vec_id").alias("vector_id"), "doc_id", "segment_id"), "vector_id")
    # What belongs to a question is worked out once for it, not for each of its events, and stored, so that its size is known.
    told = asked.select("question_id", "project_id", F.slice(tx.tokens(F.col("query")), 1, 10).alias("query_tokens"))
    places = stored(places.select("question_id", "rank", "doc_id", "segment_id").join(told, "question_id"), "feedback-places")
    events = event_key(table(spark, sf_dir, "events")).select(
        "event_id", "ts", "event_type", "user_id",
        F.concat(F.lit("b"), "k").alias("question_id"), (F.col("event_id") % 5 + 1).cast("int").alias("rank"),
    )
    outcome = F.when(F.col("event_type").isin("purchase", "click"), "cited").otherwise("missed")
    return events.join(places, ["question_id", "rank"]).select(
        F.col("event_id").alias("feedback_id"),
        F.col("ts").alias("created_at"),
        F.concat(F.lit("u"), "user_id").alias("user_id"),
        "project_id",
        F.lit(None).cast("string").alias("session_id"),
        "query_tokens",
        F.array(F.struct("doc_id", "segment_id", outcome.alias("outcome"))).alias("signals"),
    )


def graph_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = (
        ("region", "R", "r_regionkey", "r_name", "region"),
        ("nation", "N", "n_nationkey", "n_name", "nation"),
        ("customer", "C", "c_custkey", "c_name", "PERSON"),
        ("supplier", "S", "s_suppkey", "s_name", "org"),
    )
    out = None
    for name, prefix, key, label, kind in parts:
        rows = table(spark, sf_dir, name).select(
            F.concat(F.lit(prefix), key).alias("entity_id"), F.col(label).alias("name"), F.lit(kind).alias("type")
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def graph_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of four sources; some of them break the rules in each possible way."""

    def rows(name, subj, predicate, obj, doc):
        return table(spark, sf_dir, name).select(
            F.lit(name).alias("source_id"), subj.alias("subj_entity_id"), predicate.alias("predicate"),
            obj.alias("obj_entity_id"), doc.alias("doc_id"),
        )

    key = lambda prefix, column: F.concat(F.lit(prefix), column)
    nation = rows("nation", key("N", "n_nationkey"), F.lit("Part of"), key("R", "n_regionkey"), F.lit("doc:nation"))
    supplier = rows(
        "supplier", key("S", "s_suppkey"), F.when(F.col("s_acctbal") < 500, "part-of").otherwise("located-in"),
        key("N", "s_nationkey"), F.lit("doc:supplier"),
    )
    segment = F.col("c_mktsegment")
    customer = rows(
        "customer", key("C", "c_custkey"),
        F.when(F.col("c_acctbal") < 0, "has_topic").when(segment == "BUILDING", " -- ").when(segment == "MACHINERY", "located in").otherwise("Related To"),
        key("N", "c_nationkey"), F.lit("doc:customer"),
    )
    orders = rows("orders", key("O", "o_orderkey"), F.lit("Mentions"), key("C", "o_custkey"), key("O", "o_orderkey"))
    return nation.unionByName(supplier).unionByName(customer).unionByName(orders).withColumn(
        "rel_id", F.concat_ws("-", "subj_entity_id", "predicate", "obj_entity_id")
    )


def graph_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules for two of the sources, read off their own tables; the others fall back."""
    nation = table(spark, sf_dir, "nation").select(
        F.lit("nation").alias("source_id"), F.lit("part_of").alias("predicate"), F.lit("Nation").alias("domain_type"),
        F.lit("Region").alias("range_type"),
    )
    supplier = table(spark, sf_dir, "supplier").select(
        F.lit("supplier").alias("source_id"), F.lit("Located In").alias("predicate"), F.lit("Organization").alias("domain_type"),
        F.lit("Nation").alias("range_type"),
    )
    return nation.unionByName(supplier).distinct().withColumn("description", F.lit("")).withColumn("position", F.lit(1))


def gallery_with_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gallery entries that carry a two-node JSON-LD graph each."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name", "n_regionkey")
    text = F.format_string(
        '{"@graph":[{"@id":"urn:s:%s","@type":"Org","ec:name":{"@value":"%s"},"ec:in":{"@id":"urn:n:%s"},'
        '"ec:refs":[{"@id":"urn:r:%s"},{"id":"urn:n:%s"},"plain"],"note":"x"},{"id":"urn:n:%s","type":"Nation","name":"%s"}]}',
        "s_suppkey", "s_name", "s_nationkey", "n_regionkey", "s_nationkey", "s_nationkey", "n_name",
    )
    return table(spark, sf_dir, "supplier").join(nations, "s_nationkey").select(
        F.concat(F.lit("vp_"), "s_suppkey").alias("voiceprint_id"),
        F.when(F.col("s_acctbal") > 2000, F.concat(F.lit("person_"), "s_suppkey")).alias("person_id"),
        F.when(F.col("s_acctbal") > 5000, F.col("s_name")).alias("display_name"),
        F.lit("CEO").alias("title"),
        F.array("n_name").alias("organizations"),
        text.alias("ebucore"),
    )


def dated_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of documents and turns of conversations as one table of segments with what they are filtered by."""
    none = F.lit(None)
    day = F.lit("2024-01-01").cast("timestamp_ntz")
    written = chunks(spark, sf_dir).select(
        "doc_id", "segment_id", "text", F.array("lang", "source").alias("topics"), F.array(F.upper("lang")).alias("entities"),
        F.col("source").alias("source_type"), F.timestamp_add("MINUTE", "doc_num", day).alias("created_at"),
        none.cast("long").alias("start_ms"), none.cast("long").alias("end_ms"), none.cast("string").alias("speaker"),
    )
    spoken = table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("conv:"), "conv_id").alias("doc_id"), F.concat(F.lit("seg_"), F.col("turn") + 1).alias("segment_id"), "text",
        F.array(F.lit("talk"), "role").alias("topics"), F.array().cast("array<string>").alias("entities"),
        F.lit("conversation").alias("source_type"), F.timestamp_add("MINUTE", "conv_id", day).alias("created_at"),
        (F.col("turn") * 10000).alias("start_ms"), (F.col("turn") * 10000 + 9000).alias("end_ms"), F.col("role").alias("speaker"),
    )
    return written.unionByName(spoken)


def filtered_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two words of every benchmark text, asked with six sets of filters."""
    words = F.split(tx.normalize_space(F.col("text")), " ")
    asked = table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.slice(words, 1, 2), " ").alias("query"))
    asked = asked.select("*", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("v"))
    v, time = F.col("v"), lambda text: F.lit(text).cast("timestamp_ntz")
    strings = lambda *values: F.array(*[F.lit(x) if isinstance(x, str) else x for x in values])
    own = F.concat(F.lit("src"), F.col("item_id") % 20)
    return asked.select(
        F.concat(F.lit("b"), "item_id", F.lit("-"), v).alias("question_id"), "query",
        F.when(v == 1, strings("en")).when(v == 2, strings("en", own)).when(v == 4, strings("talk", "assistant")).when(v == 5, strings("en", "unheard of")).alias("want_topics"),
        F.when(v == 2, strings("EN")).alias("want_entities"),
        F.when(v == 3, F.lit("conversation")).alias("want_source_type"),
        F.when(v == 4, time("2024-01-01 00:30:00")).alias("want_date_from"),
        F.when(v == 3, time("2024-01-01 01:40:00")).alias("want_date_to"),
        F.lit(None).cast("array<double>").alias("embedding"), F.lit(None).cast("string").alias("session_id"),
    )
