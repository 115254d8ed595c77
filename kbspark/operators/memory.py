"""Memory items: write, supersede, recall, touch, statistics, maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.functions import routing
from kbspark.functions import text as tx
from kbspark.operators.matching import contained_pairs
from kbspark.operators.model import clamp_float
from kbspark.operators.ordered import beyond_newest, newest, number_rows
from kbspark.session import stored

SCOPE = ["user_id", "project_id", "session_id"]
SUPERSEDE_REASON = "slot_value_conflict"  # fixed value


def parsed_refs(items: DataFrame) -> DataFrame:
    """``source_refs`` as a variant: JSON text is parsed once, where the rows are written; text that is no
    JSON gives null."""
    if dict(items.dtypes)["source_refs"] == "string":
        return items.withColumn("source_refs", F.try_parse_json("source_refs"))
    return items


def scope_value(name: str, refs: str = "source_refs") -> Column:
    """A scope field read at the top level of the references or else below ``scope``.

    Its characters were normalised when it was written, so reading it takes no Python.
    """
    top = F.try_variant_get(refs, f"$.{name}", "string")
    nested = F.try_variant_get(refs, f"$.scope.{name}", "string")
    return F.get(F.filter(F.transform(F.array(top, nested), tx.collapse_space), lambda v: v != ""), F.lit(0))


def with_scope(items: DataFrame) -> DataFrame:
    """Promote the scope fields of ``source_refs`` to columns."""
    return parsed_refs(items).select("*", *[scope_value(n).alias(n) for n in SCOPE])


def in_scope(wanted: str, item: str) -> Column:
    """True when every scope field the asking side names equals the item's."""
    out = F.lit(True)
    for name in SCOPE:
        asked = F.col(f"{wanted}.{name}")
        out = out & (asked.isNull() | (asked == F.col(f"{item}.{name}")))
    return out


def _merged_refs(given: Column, known: dict[str, Column], scope: dict[str, Column]) -> Column:
    """References as JSON text: what the caller gave, filled up with what is ``known`` of the item; a given scope
    is written on top and below ``scope``, over what the caller had there."""
    none = F.create_map().cast("map<string,variant>")
    as_map = lambda v: F.coalesce(v.try_cast("map<string,variant>"), none)
    refs = as_map(F.try_parse_json(given))

    def of(values: dict[str, Column]) -> Column:
        pairs = F.create_map(*[x for name, value in values.items() for x in (F.lit(name), value.cast("variant"))])
        return F.map_filter(pairs, lambda _, v: v.isNotNull())

    def over(low: Column, high: Column) -> Column:
        return F.map_concat(F.map_filter(low, lambda k, _: ~F.array_contains(F.map_keys(high), k)), high)

    own, fields = of(known), of(scope)
    whole = over(over(own, refs), fields)
    nested = over(as_map(F.try_element_at(refs, F.lit("scope"))), fields)
    with_scope = over(whole, F.create_map(F.lit("scope"), F.to_variant_object(nested)))
    return F.to_json(F.when(F.size(fields) > 0, with_scope).otherwise(whole))


def write_batch(raw: DataFrame) -> DataFrame:
    """Raw memories to stored items: normalised, routed, scoped, clamped, with an expiry.

    ``raw`` may give ``memory_slot`` and ``memory_value``, which go before those found in the text, and
    ``source_refs``, JSON text that is returned with what is known of the item filled in.
    """
    text = tx.strip(F.coalesce("text", F.lit("")))
    staged = raw.withColumn("memory_type", routing.memory_type(F.col("memory_type"))).withColumn("text", text)
    staged = staged.withColumn("_norm", tx.clean_space(F.col("text")))
    staged = staged.withColumn(
        "_route", routing.route(F.col("_norm"), F.col("memory_type"), F.col("memory_kind"))
    ).withColumn("_slot", routing.slot_and_value(F.col("_norm")))
    clean_list = lambda c: F.array_distinct(
        F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), tx.strip), lambda x: x != "")
    )

    def given(name: str, limit: int, found: Column) -> Column:
        own = tx.non_empty(tx.cut(tx.clean_space(F.col(name)), limit)) if name in raw.columns else F.lit(None).cast("string")
        return F.coalesce(own, tx.non_empty(F.substring(found, 1, limit)))

    for name in SCOPE:
        staged = staged.withColumn(f"_{name}", tx.clean_space(F.col(name)))
    staged = staged.withColumns(
        {
            "_slot_name": given("memory_slot", 64, F.col("_slot.slot")), "_value": given("memory_value", 280, F.col("_slot.value")),
            "_kind": routing.memory_kind(F.col("memory_kind"), F.col("_route.memory_kind")),
            **{f"_{n}": tx.non_empty(tx.cut(F.col(f"_{n}"), 120)) for n in SCOPE},
        }
    )
    refs = []
    if "source_refs" in raw.columns:
        known = {
            "memory_kind": F.col("_kind"), "memory_router_reason": F.col("_route.reason"), "memory_router_confidence": F.col("_route.confidence"),
            "memory_slot": F.col("_slot_name"), "memory_value": F.col("_value"),
        }
        refs = [_merged_refs(F.col("source_refs"), known, {n: F.col(f"_{n}") for n in SCOPE}).alias("source_refs")]
    return staged.select(
        "memory_id",
        "memory_type",
        "text",
        clean_list("topics").alias("topics"),
        clean_list("entities").alias("entities"),
        "kind",
        F.col("_kind").alias("memory_kind"),
        F.col("_route.reason").alias("router_reason"),
        F.col("_route.confidence").alias("router_confidence"),
        F.col("_slot_name").alias("memory_slot"),
        F.col("_value").alias("memory_value"),
        *[F.col(f"_{n}").alias(n) for n in SCOPE],
        clamp_float(F.col("importance"), 0.5).alias("importance"),
        clamp_float(F.col("confidence"), 0.7).alias("confidence"),
        F.coalesce("access_count", F.lit(0)).cast("long").alias("access_count"),
        "created_at",
        F.coalesce("expires_at", routing.default_expiry(F.col("memory_type"), F.col("created_at"))).alias("expires_at"),
        "pinned_until",
        *refs,
    )


SLOT = [*SCOPE, "memory_kind", "memory_slot"]


def slot_history(items: DataFrame, block: int = 4096) -> DataFrame:
    """``memory_id, memory_value, created_at`` of the slotted items with their slot, their ``position`` in its
    history, ``same`` (position among the items of the same value) and ``run``, the number of the stretch of
    equal values they are in.

    A history is cut into blocks. Changes are counted per block, and each block is told by a table of one
    row per block how the one before ended and how many changes there were until then.
    """
    slotted = items.where(F.col("memory_slot").isNotNull() & (F.coalesce("memory_value", F.lit("")) != ""))
    slim = slotted.select("memory_id", "memory_value", "created_at", *SLOT)
    for name in SCOPE:
        slim = slim.withColumn(name, F.coalesce(name, F.lit("")))
    placed = number_rows(slim, SLOT, "created_at", ["memory_id"])
    placed = number_rows(placed, [*SLOT, "memory_value"], "created_at", ["memory_id"], "same")
    cut = placed.withColumn("_block", F.floor((F.col("position") - 1) / block))
    inside = Window.partitionBy(*SLOT, "_block").orderBy("position")
    change = F.lag("memory_value").over(inside)
    cut = cut.withColumn("_change", F.coalesce((change != F.col("memory_value")).cast("long"), F.lit(0)))
    ends = cut.groupBy(*SLOT, "_block").agg(
        F.sum("_change").alias("_n"), F.min_by("memory_value", "position").alias("_first"), F.max_by("memory_value", "position").alias("_last")
    )
    blocks = Window.partitionBy(*SLOT).orderBy("_block")
    edge = F.coalesce((F.lag("_last").over(blocks) != F.col("_first")).cast("long"), F.lit(0))
    ends = ends.withColumn("_edge", edge)
    until = F.sum(F.col("_n") + F.col("_edge")).over(blocks.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    ends = ends.withColumn("_until", until).select(*SLOT, "_block", "_until")
    within = F.sum("_change").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return cut.withColumn("_within", within).join(ends, [*SLOT, "_block"]).select(
        "memory_id", "memory_value", "created_at", *SLOT, "position", "same", (F.col("_until") + F.col("_within")).alias("run")
    )


def replacements(history: DataFrame) -> DataFrame:
    """For each item of ``slot_history``, however far apart: the last item that holds another value after it
    (``superseded_by, superseded_at``), the nearest one before it (``replaced_id, replaced_value``) and after it
    (``replaced_by, replaced_at, new_value``), and how many there are (``n_supersedes, n_superseded``)."""
    row = F.struct("position", "memory_id", "memory_value", "created_at")
    runs = history.groupBy(*SLOT, "run").agg(F.min(row).alias("first"), F.max(row).alias("last"))
    slots = runs.groupBy(*[F.col(c).alias(f"_{c}") for c in SLOT]).agg(F.max("last").alias("newest"))
    same_slot = [F.col(c) == F.col(f"_{c}") for c in SLOT]
    # The newest item of another value than the slot's last one supersedes those that hold the last one's.
    other = runs.join(slots, same_slot).where(F.col("last.memory_value") != F.col("newest.memory_value"))
    other = other.groupBy(*[F.col(f"_{c}").alias(f"o_{c}") for c in SLOT]).agg(F.max("last").alias("other"))
    slots = slots.join(other, [F.col(f"_{c}") == F.col(f"o_{c}") for c in SLOT], "left").drop(*[f"o_{c}" for c in SLOT])
    of_value = history.groupBy(*[F.col(c).alias(f"_{c}") for c in [*SLOT, "memory_value"]]).agg(F.count(F.lit(1)).alias("n_same"))
    near = _run_neighbours(runs)
    out = history.join(near, [F.col(c) == F.col(f"_{c}") for c in SLOT] + [F.col("run") == F.col("_run")]).drop(*[f"_{c}" for c in SLOT], "_run")
    out = out.join(slots, same_slot).drop(*[f"_{c}" for c in SLOT])
    out = out.join(of_value, [*same_slot, F.col("memory_value") == F.col("_memory_value")]).drop(*[f"_{c}" for c in [*SLOT, "memory_value"]])
    by = F.when(F.col("memory_value") != F.col("newest.memory_value"), F.col("newest")).when(F.col("other.position") > F.col("position"), F.col("other"))
    return out.withColumn("_by", by).select(
        "memory_id", "memory_value", "memory_slot",
        F.col("_by.memory_id").alias("superseded_by"), F.col("_by.created_at").alias("superseded_at"),
        F.col("before.memory_id").alias("replaced_id"), F.col("before.memory_value").alias("replaced_value"),
        F.col("after.memory_id").alias("replaced_by"), F.col("after.created_at").alias("replaced_at"), F.col("after.memory_value").alias("new_value"),
        "created_at",
        (F.col("position") - F.col("same")).alias("n_supersedes"),
        (F.col("newest.position") - F.col("position") - F.col("n_same") + F.col("same")).alias("n_superseded"),
    )


def _run_neighbours(runs: DataFrame) -> DataFrame:
    """The last row of the run before and the first row of the run after each run, by equality of numbers."""
    own = runs.select(*[F.col(c).alias(f"_{c}") for c in SLOT], F.col("run").alias("_run"))
    before = runs.select(*[F.col(c).alias(f"b_{c}") for c in SLOT], (F.col("run") + 1).alias("b_run"), F.col("last").alias("before"))
    after = runs.select(*[F.col(c).alias(f"a_{c}") for c in SLOT], (F.col("run") - 1).alias("a_run"), F.col("first").alias("after"))
    keys = [*SLOT, "run"]
    out = own.join(before, [F.col(f"_{c}") == F.col(f"b_{c}") for c in keys], "left")
    out = out.join(after, [F.col(f"_{c}") == F.col(f"a_{c}") for c in keys], "left")
    return out.drop(*[f"{p}_{c}" for p in "ab" for c in keys])


def recent_others(history: DataFrame, trail: int, block: int = 4096) -> DataFrame:
    """``memory_id, supersedes``: the ids of those of the ``trail`` items before each item that hold another value,
    newest first. Each block also receives the few rows before its edge."""
    home = F.floor((F.col("position") - 1) / block)
    copies = F.array_distinct(F.array(home, F.floor((F.col("position") - 1 + trail) / block)))
    spread = history.withColumn("_home", home).withColumn("_block", F.explode(copies))
    order = Window.partitionBy(*SLOT, "_block").orderBy("position")
    earlier = F.collect_list(F.struct("memory_id", "memory_value")).over(order.rowsBetween(-trail, -1))
    own = spread.withColumn("_earlier", earlier).where("_home = _block")
    others = F.filter("_earlier", lambda o: o["memory_value"] != F.col("memory_value"))
    return own.select("memory_id", F.transform(F.reverse(others), lambda o: o["memory_id"]).alias("supersedes"))


def supersede(items: DataFrame, trail: int = 60, block: int = 4096) -> DataFrame:
    """Mark items whose slot a later item of the same scope and kind gave another value.

    Who superseded an item, what it replaced and how often both happened takes in the whole history of
    the slot; only ``supersedes``, a report of recent ids, is one of the ``trail`` items before.
    """
    history = stored(slot_history(items, block), "slot-history")
    marks = replacements(history).drop("memory_value", "memory_slot", "created_at")
    reason = F.when(F.col("superseded_by").isNotNull(), F.lit(SUPERSEDE_REASON)).alias("supersede_reason_code")
    joined = items.join(marks.select("*", reason), "memory_id", "left").join(recent_others(history, trail, block), "memory_id", "left")
    return joined.withColumn("expires_at", F.coalesce("superseded_at", "expires_at"))


def revision_events(items: DataFrame, block: int = 4096) -> DataFrame:
    """One row per revision and side: ``supersedes`` on the item that brought a new value, ``superseded`` on the one
    whose value it replaced; both with the previous and the new value."""
    found = replacements(stored(slot_history(items, block), "slot-history"))
    event = lambda name, at, other, old, new: F.struct(
        F.lit(name).alias("event"), F.col(at).alias("at"), F.lit(SUPERSEDE_REASON).alias("reason_code"), F.col(other).alias("counterpart_memory_id"),
        "memory_slot", F.col(old).alias("previous_value"), F.col(new).alias("new_value"),
    )
    both = F.array(
        F.when(F.col("replaced_id").isNotNull(), event("supersedes", "created_at", "replaced_id", "replaced_value", "memory_value")),
        F.when(F.col("replaced_by").isNotNull(), event("superseded", "replaced_at", "replaced_by", "memory_value", "new_value")),
    )
    return found.select("memory_id", F.explode(F.filter(both, lambda e: e.isNotNull())).alias("e")).select("memory_id", "e.*")


_POLICY = {"importance": 0.7, "confidence": 0.7, "access_count": 0}  # fixed values of long-term rows
# The columns of stored items that ``recall`` and ``long_term_table`` read.
RECALL_COLUMNS = (
    "memory_id", "memory_type", "memory_kind", "text", "topics", "entities", *SCOPE, "created_at", "expires_at", *_POLICY, "pinned_until",
)


def searchable(items: DataFrame, source: str) -> DataFrame:
    """Items of one source with the text a query is looked for in: the body, and for local
    items the topics and entities too."""
    text = F.concat_ws("\u0001", "text", F.to_json("topics"), F.to_json("entities")) if source == "local" else F.col("text")
    have = items.columns
    policy = [F.col(n) if n in have else F.lit(v) for n, v in _POLICY.items()]
    pin = F.col("pinned_until") if "pinned_until" in have else F.lit(None).cast("timestamp_ntz")
    return items.select(
        F.lit(source).alias("source"), "memory_id", "memory_type", "memory_kind", F.col("text").alias("body"),
        "topics", "entities", *SCOPE, "created_at", *[c.alias(n) for c, n in zip(policy, _POLICY)],
        pin.alias("pinned_until"), text.alias("text"),
    )


def recall(
    queries: DataFrame, items: DataFrame, as_of: Column, limit: int = 10, long_term: DataFrame | None = None
) -> DataFrame:
    """Ranked memories for ``queries(query_id, query, want_type, want_kind, scope...)``.

    Filters run before the limit. Local rows and, when given, long-term rows are ranked in one
    list of ``limit`` per query.
    """
    live = items.where(F.col("expires_at").isNull() | (F.col("expires_at") > as_of))
    texts = searchable(live, "local")
    if long_term is not None:
        texts = texts.unionByName(searchable(long_term, "long_term"))
    keep = tuple(c for c in texts.columns if c not in ("source", "memory_id", "text"))
    # Scope, type and kind are part of the match, so no pair of another scope is ever made.
    scope = {"want_type": "memory_type", "want_kind": "memory_kind", **{n: n for n in SCOPE}}
    pairs = contained_pairs(queries, texts, "query_id", ["source", "memory_id"], keep, scope=scope)
    q_tokens = queries.select("query_id", tx.tokens(F.col("query")).alias("_qt"))
    found = pairs.join(q_tokens, "query_id")
    text = tx.overlap_score(F.col("_qt"), tx.tokens(F.col("body")))
    topics = tx.overlap_score(F.col("_qt"), tx.tokens(F.array_join("topics", " ")))
    entities = tx.overlap_score(F.col("_qt"), tx.tokens(F.array_join("entities", " ")))
    recent = routing.recency(F.col("created_at"), as_of)
    weight = routing.type_weight(F.col("memory_type"))
    raw = (
        0.50 * text
        + 0.20 * F.greatest(topics, entities)
        + 0.15 * recent
        + 0.10 * F.col("importance")
        + 0.05 * F.col("confidence")
    )
    pinned = F.when(F.col("pinned_until") >= as_of, 0.05).otherwise(0.0)
    near = raw * weight + F.least(F.col("access_count"), F.lit(20)) / 200.0 + pinned
    far = (0.65 * text + 0.35 * recent) * weight
    score = F.when(F.col("source") == "local", near).otherwise(far)
    ranked = found.select(
        "query_id", "memory_id", "memory_type", "memory_kind", F.col("body").alias("text"), "created_at", "source",
        F.round(score, 6).alias("recall_score"),
    )
    return newest(
        ranked, ["query_id"], limit, F.col("recall_score").desc(), F.col("source"), F.col("memory_id")
    ).withColumnRenamed("_rank", "rank")


def long_term_table(items: DataFrame) -> DataFrame:
    """The published table: long-term rows whose policy fields are not kept."""
    return items.where("memory_type = 'long_term'").select(
        "memory_id", "memory_type", "memory_kind", "text", "topics", "entities", *SCOPE, "created_at"
    )


def touch(items: DataFrame, selected: DataFrame, as_of: Column) -> DataFrame:
    """Count one access per query for the items that it recalled from the local ones.

    ``selected(query_id, memory_id)`` is ``recall`` without long-term rows: these take no part in the
    limit of what is touched, and are not kept with an access count.
    """
    hits = selected.groupBy("memory_id").agg(F.count_distinct("query_id").alias("_hits"))
    return (
        items.join(hits, "memory_id", "left")
        .withColumn("access_count", F.col("access_count") + F.coalesce("_hits", F.lit(0)))
        .withColumn("last_accessed_at", F.when(F.col("_hits").isNotNull(), as_of))
        .drop("_hits")
    )


def expired(items: DataFrame, as_of: Column) -> Column:
    """Deletable by age: past its expiry and not pinned."""
    return (F.col("expires_at") <= as_of) & (F.col("pinned_until").isNull() | (F.col("pinned_until") < as_of))


def maintenance(
    items: DataFrame, as_of: Column, retention_days: int = 30, keep: int = 80, budget: int | None = 250
) -> DataFrame:
    """Ids to delete with their reason: expired, old feedback, feedback beyond the newest
    ``keep`` per scope; the first ``budget`` by reason and recency, all without a budget."""
    slim = items.select("memory_id", "kind", "created_at", "expires_at", "pinned_until", *SCOPE)
    slim = slim.withColumn("_gone", F.coalesce(expired(slim, as_of), F.lit(False)))
    due = slim.where("_gone").select("memory_id", "created_at", F.lit(1).alias("_order"), F.lit("expired").alias("reason"))
    feedback = slim.where("NOT _gone AND kind = 'retrieval_feedback'")
    cutoff = F.timestamp_add("DAY", F.lit(-retention_days), as_of)
    old = feedback.where(F.col("created_at") < cutoff).select(
        "memory_id", "created_at", F.lit(2).alias("_order"), F.lit("feedback_retention").alias("reason")
    )
    scoped = feedback
    for name in SCOPE:
        scoped = scoped.withColumn(name, F.coalesce(name, F.lit("")))
    over = (
        beyond_newest(scoped, SCOPE, keep, "created_at", "memory_id")
        .where(F.col("created_at") >= cutoff)
        .select("memory_id", "created_at", F.lit(3).alias("_order"), F.lit("feedback_overflow").alias("reason"))
    )
    doomed = due.unionByName(old).unionByName(over)
    if budget is not None:
        doomed = doomed.orderBy("_order", F.col("created_at").desc(), F.col("memory_id")).limit(budget)
    return doomed.select("memory_id", "reason")


def deletion_breakdown(doomed: DataFrame) -> DataFrame:
    return doomed.groupBy("reason").agg(F.count(F.lit(1)).alias("deleted"))


def statistics(items: DataFrame, as_of: Column, by: list[str]) -> DataFrame:
    """Counts per scope: activity, supersede links, feedback hit rate."""
    one = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    listed = F.array_distinct(F.filter(F.coalesce("supersedes", F.array().cast("array<string>")), lambda x: F.trim(x) != ""))
    links = F.coalesce("n_supersedes", F.size(listed)) if "n_supersedes" in items.columns else F.size(listed)
    feedback = F.col("kind") == "retrieval_feedback"
    count = lambda name: F.sum(F.when(feedback, F.coalesce(name, F.lit(0))).otherwise(0))
    with_list = F.when(F.col("signals").isNotNull(), F.size("signals")).otherwise(0)
    outcomes = lambda o: F.when(
        F.col("signals").isNotNull(), F.size(F.filter("signals", lambda s: F.lower(s) == o))
    ).otherwise(F.coalesce(f"{o}_count", F.lit(0)))
    rows = items.select(
        *by, "memory_type", "memory_kind", "expires_at", "superseded_by", "kind",
        links.alias("_links"), with_list.alias("_signals"),
        outcomes("cited").alias("_cited"), outcomes("missed").alias("_missed"),
    )
    active = F.col("expires_at").isNull() | (F.col("expires_at") > as_of)
    grouped = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("memory_items"),
        one(active).alias("active_items"),
        one(~active).alias("expired_items"),
        *[one(F.col("memory_type") == t).alias(f"type_{t}") for t in routing.TYPE_WEIGHT],
        *[one(F.col("memory_kind") == k).alias(f"kind_{k}") for k in routing.KINDS],
        one(F.col("superseded_by").isNotNull()).alias("superseded_items"),
        one(F.col("_links") > 0).alias("supersede_actions"),
        F.sum("_links").alias("supersede_links"),
        one(feedback).alias("feedback_items"),
        count("_signals").alias("signals_total"),
        count("_cited").alias("cited_signals"),
        count("_missed").alias("missed_signals"),
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6)).otherwise(0.0)
    return grouped.withColumn("supersede_rate", ratio("superseded_items", "memory_items")).withColumn(
        "hit_rate", ratio("cited_signals", "signals_total")
    )


def is_todo(text: Column, topics: Column, kind: Column) -> Column:
    """True for to-do notes, by their text, a topic or the kind of their references."""
    def token(value: Column, limit: int) -> Column:
        short = F.lower(tx.cut(tx.collapse_space(F.coalesce(value, F.lit(""))), limit))
        return F.regexp_replace(F.regexp_replace(short, r"[\s\-]+", "_"), "^_+|_+$", "")

    return (
        F.lower(tx.cut(tx.clean_space(text), 280)).startswith("todo:")
        | F.exists(tx.nfkc_list(topics), lambda t: token(t, 40) == "todo")
        | token(tx.nfkc(kind), 80).contains("todo")
    )
