"""Entities and relations: typing, ontology checks, publish gate, traversal, gallery graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.functions import text as tx
from kbspark.operators.matching import contained_pairs
from kbspark.operators.tables import first_per_key
from kbspark.session import reliable

# The rules used for a source that brings none (predicate, domain, range, text).
DEFAULT_RULES = (
    ("mentions", "Document", "Entity", "Doc mentions entity"),
    ("mentions", "Entity", "Entity", "Entity mention/link in conversational sources"),
    ("has_topic", "Document", "Topic", "Doc has topic"),
    ("related_to", "Entity", "Entity", "Entity related to"),
    ("describes", "Person", "Entity", "Person describes EBUCore node"),
    ("affiliated_with", "Person", "Organisation", "Person affiliation"),
)
# Spellings of entity types.
TYPE_ALIASES = {
    "document": "Document", "doc": "Document", "entity": "Entity", "topic": "Topic", "person": "Person",
    "org": "Organisation", "organization": "Organisation", "organisation": "Organisation",
}


def predicate_name(raw: Column) -> Column:
    out = F.regexp_replace(F.lower(tx.strip(F.coalesce(raw, F.lit("")))), r"[\s\-]+", "_")
    return F.regexp_replace(F.regexp_replace(out, "[^a-z0-9_]", ""), "^_+|_+$", "")


def entity_type(raw: Column) -> Column:
    aliases = F.create_map(*[F.lit(x) for pair in TYPE_ALIASES.items() for x in pair])

    def known(value: Column) -> Column:
        alias = F.try_element_at(aliases, F.regexp_replace(F.lower(value), "[^a-z0-9]", ""))
        capital = F.concat(F.upper(F.substring(value, 1, 1)), F.regexp_extract(value, "(?s)^.(.*)$", 1))
        return F.when(value == "", "Entity").otherwise(F.coalesce(alias, capital))

    return tx.let(tx.strip(F.coalesce(raw, F.lit(""))), known)


def canonical_rules(rules: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rules with normalised names, the first of equal ones by ``position`` kept."""
    clean = rules.select(
        *keys,
        predicate_name(F.col("predicate")).alias("predicate"),
        entity_type(F.col("domain_type")).alias("domain_type"),
        entity_type(F.col("range_type")).alias("range_type"),
        tx.strip(F.coalesce("description", F.lit(""))).alias("description"),
        "position",
    ).where("predicate <> ''")
    return first_per_key(clean, [*keys, "predicate", "domain_type", "range_type"], F.col("position"), F.col("description"))


def default_rules(spark) -> DataFrame:
    rows = [(*rule, i) for i, rule in enumerate(DEFAULT_RULES)]
    return spark.createDataFrame(rows, "predicate string, domain_type string, range_type string, description string, position int")


def rules_for(sources: DataFrame, rules: DataFrame) -> DataFrame:
    """The rules of every source; sources without any get the default set."""
    own = canonical_rules(rules, ("source_id",)).drop("position")
    bare = sources.select("source_id").distinct().join(own.select("source_id").distinct(), "source_id", "left_anti")
    names = ("predicate", "domain_type", "range_type", "description")
    rows = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, rule)]) for rule in DEFAULT_RULES]
    given = bare.select("source_id", F.inline(F.array(*rows)))
    return own.unionByName(given)


def type_map(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Type per entity id; an id that is also a document id is a Document."""
    named = entities.where(F.coalesce("entity_id", F.lit("")) != "").select(
        "entity_id", entity_type(F.col("type")).alias("type"), F.lit(2).alias("_p")
    )
    docs = relations.where(F.coalesce("doc_id", F.lit("")) != "").select(
        F.col("doc_id").alias("entity_id"), F.lit("Document").alias("type"), F.lit(1).alias("_p")
    )
    return first_per_key(named.unionByName(docs.distinct()), ["entity_id"], F.col("_p"), F.col("type")).drop("_p")


def validate(relations: DataFrame, types: DataFrame, rules: DataFrame) -> DataFrame:
    """Relations with normalised predicate, both types and the reason they break the rules.

    ``rules(source_id, predicate, domain_type, range_type)``: ``Entity`` in a rule accepts any
    type. The allowed pairs of a predicate are gathered per (source, predicate), so a relation
    stays one row.
    """
    allowed = rules.groupBy("source_id", "predicate").agg(
        F.collect_set(F.struct("domain_type", "range_type")).alias("_allowed")
    )
    subject = types.select(F.col("entity_id").alias("subj_entity_id"), F.col("type").alias("subj_type"))
    target = types.select(F.col("entity_id").alias("obj_entity_id"), F.col("type").alias("obj_type"))
    typed = (
        relations.withColumn("predicate", predicate_name(F.col("predicate")))
        .join(subject, "subj_entity_id", "left")
        .join(target, "obj_entity_id", "left")
        .withColumn("subj_type", F.coalesce("subj_type", F.lit("Entity")))
        .withColumn("obj_type", F.coalesce("obj_type", F.lit("Entity")))
        .join(allowed, ["source_id", "predicate"], "left")
    )
    fits = F.exists(
        "_allowed",
        lambda r: ((r["domain_type"] == "Entity") | (r["domain_type"] == F.col("subj_type")))
        & ((r["range_type"] == "Entity") | (r["range_type"] == F.col("obj_type"))),
    )
    error = (
        F.when(F.col("predicate") == "", "missing_predicate")
        .when(F.col("_allowed").isNull(), "predicate_not_in_ontology")
        .when(~fits, "domain_range_mismatch")
    )
    return typed.withColumn("validation_error", error).drop("_allowed")


def validation_summary(checked: DataFrame, rules: DataFrame) -> DataFrame:
    """Counts per source; ``publish`` is false as soon as one relation is invalid."""
    per = checked.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count("validation_error").alias("invalid"),
    )
    sizes = rules.groupBy("source_id").agg(F.count(F.lit(1)).alias("rules"))
    return per.join(sizes, "source_id", "left").select(
        "source_id", "total", (F.col("total") - F.col("invalid")).alias("valid"), "invalid",
        F.coalesce("rules", F.lit(0).cast("long")).alias("rules"), (F.col("invalid") == 0).alias("publish"),
    )


def publishable(checked: DataFrame) -> DataFrame:
    """Relations of sources in which every relation is valid."""
    blocked = checked.where("validation_error IS NOT NULL").select("source_id").distinct()
    return checked.join(blocked, "source_id", "left_anti")


def discover_rules(relations: DataFrame, types: DataFrame) -> DataFrame:
    """The default rules and one rule per (predicate, subject type, object type) seen."""
    subject = types.select(F.col("entity_id").alias("subj_entity_id"), F.col("type").alias("domain_type"))
    target = types.select(F.col("entity_id").alias("obj_entity_id"), F.col("type").alias("range_type"))
    seen = (
        relations.where(tx.strip(F.coalesce("predicate", F.lit(""))) != "")
        .join(subject, "subj_entity_id", "left")
        .join(target, "obj_entity_id", "left")
        .select(
            "predicate",
            F.coalesce("domain_type", F.lit("Entity")).alias("domain_type"),
            F.coalesce("range_type", F.lit("Entity")).alias("range_type"),
        )
        .distinct()
        .withColumn("description", F.lit("Auto-discovered from voice gallery graph extraction"))
        .withColumn("position", F.lit(len(DEFAULT_RULES)))
    )
    return canonical_rules(default_rules(relations.sparkSession).unionByName(seen)).drop("position")


def expand(
    queries: DataFrame, entities: DataFrame, relations: DataFrame, hops: int = 1, seeds: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Entities and relations within ``hops`` steps, subject to object, of the entities whose
    name contains the query ``(query_id, query)``.

    Every step is one equality join of the frontier with the relations; known ids are taken off
    before the next. Ids without an entity row are walked through but not returned.
    """
    if seeds is None:
        names = entities.select("entity_id", F.col("name").alias("text"))
        seeds = contained_pairs(queries, names, "query_id", ["entity_id"])
    seen = seeds.select("query_id", "entity_id", F.lit(0).alias("hop")).distinct()
    edges = relations.select("rel_id", F.col("subj_entity_id").alias("entity_id"), "obj_entity_id")
    frontier, walked = seen.drop("hop"), []
    for hop in range(1, hops + 1):
        step = frontier.join(edges, "entity_id")
        walked.append(step.select("query_id", "rel_id", F.lit(hop).alias("hop")).distinct())
        reached = step.where("obj_entity_id IS NOT NULL").select("query_id", F.col("obj_entity_id").alias("entity_id")).distinct()
        frontier = reached.join(seen.drop("hop"), ["query_id", "entity_id"], "left_anti")
        if hop % 3 == 0 and hop < hops:
            frontier, seen = reliable(frontier), reliable(seen)
        seen = seen.unionByName(frontier.withColumn("hop", F.lit(hop)))
    found = seen.join(entities.select("entity_id", "name", "type"), "entity_id")
    if not walked:
        return found, relations.select("rel_id").limit(0)
    return found, reduce(DataFrame.unionByName, walked)


def flatten_jsonld(entries: DataFrame, key: str = "voiceprint_id") -> tuple[DataFrame, DataFrame]:
    """The nodes and object references of the JSON-LD text in ``ebucore``.

    Nested values stay JSON text in a string map, so nodes of any shape share one schema.
    """
    nodes = entries.select(
        key, F.posexplode(F.from_json("ebucore", "`@graph` array<map<string,string>>")["@graph"]).alias("_pos", "_node")
    )
    get = lambda name: F.nullif(F.try_element_at("_node", F.lit(name)), F.lit(""))
    raw_name = F.coalesce(get("ec:name"), get("name"))
    inner = F.coalesce(F.get_json_object(raw_name, "$['@value']"), F.get_json_object(raw_name, "$.value"))
    staged = nodes.select(
        key, "_pos", "_node",
        F.coalesce(get("id"), get("@id"), F.sha2(F.to_json("_node"), 256)).alias("entity_id"),
        F.coalesce(get("type"), get("@type"), F.lit("Entity")).alias("type"),
        F.when(raw_name.startswith("{"), inner).otherwise(raw_name).alias("_name"),
    )
    entities = first_per_key(
        staged.select(key, "entity_id", F.coalesce("_name", "entity_id").alias("name"), "type", "_pos"),
        [key, "entity_id"], F.col("_pos"),
    ).drop("_pos")
    fixed = ("id", "@id", "type", "@type", "ec:name", "name")  # fixed values
    pairs = staged.select(key, "entity_id", F.explode("_node").alias("predicate", "_v")).where(~F.col("predicate").isin(*fixed))
    items = (
        F.when(F.col("_v").startswith("{"), F.array("_v"))
        .when(F.col("_v").startswith("["), F.from_json("_v", "array<string>"))
    )
    targets = pairs.select(key, "entity_id", "predicate", F.explode(items).alias("_item")).where(F.col("_item").startswith("{"))
    obj = F.coalesce(F.get_json_object("_item", "$['@id']"), F.get_json_object("_item", "$.id"))
    relations = targets.withColumn("obj_entity_id", obj).where("obj_entity_id IS NOT NULL").select(
        key,
        F.sha2(F.concat_ws("-", "entity_id", "predicate", "obj_entity_id"), 256).alias("rel_id"),
        F.col("entity_id").alias("subj_entity_id"),
        "predicate",
        "obj_entity_id",
        F.lit("voice_gallery").alias("doc_id"),
        F.col("entity_id").alias("segment_id"),
        F.lit(0.7).alias("confidence"),
    )
    return entities, relations


def gallery_graph(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Persons, organisations and described nodes of the gallery, with their links."""
    have = entries.columns
    first = lambda *names: F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names if n in have])
    people = entries.withColumn("_id", first("person_id", "voiceprint_id")).withColumn(
        "_name", first("display_name", "full_name", "title", "given_name", "family_name", "voiceprint_id")
    )
    persons = people.select(F.col("_id").alias("entity_id"), F.col("_name").alias("name"), F.lit("Person").alias("type"))
    member = people.select("_id", F.explode("organizations").alias("org")).where("org IS NOT NULL")
    member = member.withColumn("_org", F.sha2(F.concat(F.lit("org:"), "org"), 256))
    organisations = member.select(F.col("_org").alias("entity_id"), F.col("org").alias("name"), F.lit("Organisation").alias("type")).distinct()

    def link(df: DataFrame, predicate: str, target: str) -> DataFrame:
        return df.select(
            F.sha2(F.concat_ws("-", F.col("_id"), F.lit(predicate), F.col(target)), 256).alias("rel_id"),
            F.col("_id").alias("subj_entity_id"),
            F.lit(predicate).alias("predicate"),
            F.col(target).alias("obj_entity_id"),
            F.lit("voice_gallery").alias("doc_id"),
            F.col("_id").alias("segment_id"),
            F.lit(0.6).alias("confidence"),
        )

    entities, relations = persons.unionByName(organisations), link(member, "affiliated_with", "_org")
    if "ebucore" in have:
        nodes, refs = flatten_jsonld(entries)
        described = nodes.join(people.select("voiceprint_id", "_id"), "voiceprint_id")
        entities = entities.unionByName(nodes.select("entity_id", "name", "type"))
        relations = relations.unionByName(refs.drop("voiceprint_id")).unionByName(link(described, "describes", "entity_id"))
    return entities, relations
