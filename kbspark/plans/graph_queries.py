"""Graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kbspark import schemas
from kbspark.operators import graph, tables
from kbspark.plans import bindings as b
from kbspark.plans.registry import query, table
from kbspark.plans.sql import cte, with_ctes
from kbspark.session import stored

cte(
    "ents",
    """
    SELECT 'R' || r_regionkey AS id, r_name AS name, 'Region' AS type, 'region' AS raw FROM region UNION ALL SELECT 'N' || n_nationkey, n_name, 'Nation', 'nation' FROM nation
    UNION ALL SELECT 'C' || c_custkey, c_name, 'Person', 'PERSON' FROM customer UNION ALL SELECT 'S' || s_suppkey, s_name, 'Organisation', 'org' FROM supplier
    """,
)
cte(
    "rels",
    """
    SELECT s || '-' || raw || '-' || o AS rel_id, * FROM (
      SELECT 'nation' AS src, 'N' || n_nationkey AS s, 'Part of' AS raw, 'part_of' AS pred, 'R' || n_regionkey AS o, 'doc:nation' AS doc FROM nation
      UNION ALL SELECT 'supplier', 'S' || s_suppkey, CASE WHEN s_acctbal < 500 THEN 'part-of' ELSE 'located-in' END, CASE WHEN s_acctbal < 500 THEN 'part_of' ELSE 'located_in' END, 'N' || s_nationkey, 'doc:supplier' FROM supplier
      UNION ALL SELECT 'customer', 'C' || c_custkey, CASE WHEN c_acctbal < 0 THEN 'has_topic' WHEN c_mktsegment = 'BUILDING' THEN ' -- ' WHEN c_mktsegment = 'MACHINERY' THEN 'located in' ELSE 'Related To' END,
        CASE WHEN c_acctbal < 0 THEN 'has_topic' WHEN c_mktsegment = 'BUILDING' THEN '' WHEN c_mktsegment = 'MACHINERY' THEN 'located_in' ELSE 'related_to' END, 'N' || c_nationkey, 'doc:customer' FROM customer
      UNION ALL SELECT 'orders', 'O' || o_orderkey, 'Mentions', 'mentions', 'C' || o_custkey, 'O' || o_orderkey FROM orders)
    """,
)
cte(
    "rules",
    """
    SELECT * FROM (VALUES ('nation', 'part_of', 'Nation', 'Region'), ('supplier', 'located_in', 'Organisation', 'Nation'),
      ('customer', 'mentions', 'Document', 'Entity'), ('customer', 'mentions', 'Entity', 'Entity'), ('customer', 'has_topic', 'Document', 'Topic'),
      ('customer', 'related_to', 'Entity', 'Entity'), ('customer', 'describes', 'Person', 'Entity'), ('customer', 'affiliated_with', 'Person', 'Organisation'),
      ('orders', 'mentions', 'Document', 'Entity'), ('orders', 'mentions', 'Entity', 'Entity'), ('orders', 'has_topic', 'Document', 'Topic'),
      ('orders', 'related_to', 'Entity', 'Entity'), ('orders', 'describes', 'Person', 'Entity'), ('orders', 'affiliated_with', 'Person', 'Organisation')) t(src, pred, d, r)
    """,
)
cte(
    "checked",
    """
    SELECT x.*, CASE WHEN pred = '' THEN 'missing_predicate'
        WHEN NOT EXISTS (SELECT 1 FROM rules u WHERE u.src = x.src AND u.pred = x.pred) THEN 'predicate_not_in_ontology'
        WHEN NOT EXISTS (SELECT 1 FROM rules u WHERE u.src = x.src AND u.pred = x.pred AND u.d IN ('Entity', st) AND u.r IN ('Entity', ot)) THEN 'domain_range_mismatch' END AS err
    FROM (SELECT r.*, CASE WHEN r.s = r.doc THEN 'Document' ELSE coalesce(a.type, 'Entity') END AS st, coalesce(b.type, 'Entity') AS ot
          FROM rels r LEFT JOIN ents a ON a.id = r.s LEFT JOIN ents b ON b.id = r.o) x
    """,
    "rels",
    "ents",
    "rules",
)


def _checked(spark, sf_dir):
    relations = b.graph_relations(spark, sf_dir)
    # Every source is one table, so the list of sources is as long as the list of tables.
    rules = graph.rules_for(relations.select("source_id").distinct(), b.graph_rules(spark, sf_dir))
    types = graph.type_map(b.graph_entities(spark, sf_dir), relations)
    return graph.validate(relations, types, rules), rules


@query(
    "ontology_validate",
    with_ctes(
        "SELECT rel_id, src AS source_id, pred AS predicate, st AS subj_type, ot AS obj_type, err AS validation_error FROM checked",
        "checked",
    ),
)
def ontology_validate(spark, sf_dir):
    checked, _ = _checked(spark, sf_dir)
    return checked.select("rel_id", "source_id", "predicate", "subj_type", "obj_type", "validation_error")


@query(
    "graph_publish_gate",
    with_ctes(
        """
        SELECT src AS source_id, count(*)::BIGINT AS total, (count(*) - count(err))::BIGINT AS valid, count(err)::BIGINT AS invalid,
               (SELECT count(*) FROM rules u WHERE u.src = c.src)::BIGINT AS rules, count(err) = 0 AS publish,
               CASE WHEN count(err) = 0 THEN count(*) ELSE 0 END::BIGINT AS published FROM checked c GROUP BY src
        """,
        "checked",
    ),
)
def graph_publish_gate(spark, sf_dir):
    checked, rules = _checked(spark, sf_dir)
    checked = stored(checked, "checked")
    passed = graph.publishable(checked).groupBy("source_id").agg(F.count(F.lit(1)).alias("published"))
    return graph.validation_summary(checked, rules).join(passed, "source_id", "left").withColumn(
        "published", F.coalesce("published", F.lit(0).cast("long"))
    )


@query(
    "ontology_discover",
    with_ctes(
        """
        , seen AS (SELECT DISTINCT pred, CASE WHEN s = doc THEN 'Document' ELSE coalesce(a.type, 'Entity') END AS d, coalesce(b.type, 'Entity') AS r
                   FROM rels LEFT JOIN ents a ON a.id = s LEFT JOIN ents b ON b.id = o WHERE pred <> ''),
        def AS (SELECT * FROM (VALUES ('mentions', 'Document', 'Entity', 'Doc mentions entity'), ('mentions', 'Entity', 'Entity', 'Entity mention/link in conversational sources'),
          ('has_topic', 'Document', 'Topic', 'Doc has topic'), ('related_to', 'Entity', 'Entity', 'Entity related to'), ('describes', 'Person', 'Entity', 'Person describes EBUCore node'),
          ('affiliated_with', 'Person', 'Organisation', 'Person affiliation')) t(pred, d, r, t))
        SELECT pred AS predicate, d AS domain_type, r AS range_type, t AS description FROM def
        UNION ALL SELECT pred, d, r, 'Auto-discovered from voice gallery graph extraction' FROM seen s WHERE NOT EXISTS (SELECT 1 FROM def WHERE def.pred = s.pred AND def.d = s.d AND def.r = s.r)
        """,
        "rels",
        "ents",
    ),
)
def ontology_discover(spark, sf_dir):
    relations = b.graph_relations(spark, sf_dir)
    types = graph.type_map(b.graph_entities(spark, sf_dir), relations)
    return graph.discover_rules(relations, types)


@query(
    "graph_khop",
    with_ctes(
        """
        , q AS (SELECT 'n' || n_nationkey AS query_id, n_name AS query FROM nation UNION ALL SELECT 's' || s_suppkey, s_name FROM supplier),
        walk AS (SELECT q.query_id, e.id, 0 AS hop FROM q JOIN ents e ON contains(lower(e.name), lower(q.query))
                 UNION SELECT w.query_id, r.o, w.hop + 1 FROM walk w JOIN rels r ON r.s = w.id WHERE w.hop < 2),
        first AS (SELECT query_id, id, min(hop) AS hop FROM walk GROUP BY ALL)
        SELECT f.query_id, 'entity' AS kind, f.id, e.name, f.hop::INTEGER AS hop FROM first f JOIN ents e ON e.id = f.id
        UNION ALL SELECT DISTINCT f.query_id, 'relation', r.rel_id, NULL, f.hop + 1 FROM first f JOIN rels r ON r.s = f.id WHERE f.hop < 2
        """,
        "ents",
        "rels",
    ),
)
def graph_khop(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("n"), "n_nationkey").alias("query_id"), F.col("n_name").alias("query")
    )
    suppliers = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), "s_suppkey").alias("query_id"), F.col("s_name").alias("query")
    )
    entities, relations = graph.expand(
        nations.unionByName(suppliers), b.graph_entities(spark, sf_dir), b.graph_relations(spark, sf_dir), hops=2
    )
    return entities.select("query_id", F.lit("entity").alias("kind"), F.col("entity_id").alias("id"), "name", "hop").unionByName(
        relations.select(
            "query_id", F.lit("relation").alias("kind"), F.col("rel_id").alias("id"),
            F.lit(None).cast("string").alias("name"), "hop",
        )
    )


cte(
    "sup",
    """
    SELECT 'vp_' || s_suppkey AS vp, s_suppkey AS k, s_name, n_nationkey AS n, n_name, n_regionkey AS r, CASE WHEN s_acctbal > 2000 THEN 'person_' || s_suppkey ELSE 'vp_' || s_suppkey END AS pid,
           CASE WHEN s_acctbal > 5000 THEN s_name ELSE 'CEO' END AS pname FROM supplier JOIN nation ON s_nationkey = n_nationkey
    """,
)
cte(
    "ld_nodes",
    """
    SELECT vp, pid, 'urn:s:' || k AS id, s_name AS name, 'Org' AS type FROM sup UNION ALL SELECT vp, pid, 'urn:n:' || n, n_name, 'Nation' FROM sup
    """,
    "sup",
)
cte(
    "ld_refs",
    """
    SELECT vp, 'urn:s:' || k AS s, 'ec:in' AS p, 'urn:n:' || n AS o FROM sup UNION ALL SELECT vp, 'urn:s:' || k, 'ec:refs', 'urn:r:' || r FROM sup
    UNION ALL SELECT vp, 'urn:s:' || k, 'ec:refs', 'urn:n:' || n FROM sup
    """,
    "sup",
)


@query(
    "jsonld_flatten",
    with_ctes(
        """
        SELECT vp AS voiceprint_id, 'entity' AS kind, id, name AS a, type AS b FROM ld_nodes
        UNION ALL SELECT vp, 'relation', sha256(s || '-' || p || '-' || o), p, o FROM ld_refs
        """,
        "ld_nodes",
        "ld_refs",
    ),
)
def jsonld_flatten(spark, sf_dir):
    nodes, refs = graph.flatten_jsonld(b.gallery_with_nodes(spark, sf_dir))
    return nodes.select(
        "voiceprint_id", F.lit("entity").alias("kind"), F.col("entity_id").alias("id"), F.col("name").alias("a"), F.col("type").alias("b")
    ).unionByName(
        refs.select(
            "voiceprint_id", F.lit("relation").alias("kind"), F.col("rel_id").alias("id"), F.col("predicate").alias("a"),
            F.col("obj_entity_id").alias("b"),
        )
    )


@query(
    "gallery_graph",
    with_ctes(
        """
        SELECT 'entity' AS kind, pid AS id, pname AS a, 'Person' AS b, 0.0::DOUBLE AS confidence FROM sup
        UNION ALL SELECT DISTINCT 'entity', sha256('org:' || n_name), n_name, 'Organisation', 0.0 FROM sup
        UNION ALL SELECT 'entity', id, name, type, 0.0 FROM ld_nodes
        UNION ALL SELECT 'relation', sha256(pid || '-affiliated_with-' || sha256('org:' || n_name)), 'affiliated_with', sha256('org:' || n_name), 0.6 FROM sup
        UNION ALL SELECT 'relation', sha256(s || '-' || p || '-' || o), p, o, 0.7 FROM ld_refs
        UNION ALL SELECT 'relation', sha256(pid || '-describes-' || id), 'describes', id, 0.6 FROM ld_nodes
        """,
        "ld_nodes",
        "ld_refs",
    ),
)
def gallery_graph(spark, sf_dir):
    entities, relations = graph.gallery_graph(b.gallery_with_nodes(spark, sf_dir))
    return entities.select(
        F.lit("entity").alias("kind"), F.col("entity_id").alias("id"), F.col("name").alias("a"), F.col("type").alias("b"),
        F.lit(0.0).alias("confidence"),
    ).unionByName(
        relations.select(
            F.lit("relation").alias("kind"), F.col("rel_id").alias("id"), F.col("predicate").alias("a"),
            F.col("obj_entity_id").alias("b"), "confidence",
        )
    )


@query(
    "upsert_graph",
    with_ctes(
        """
        SELECT 'entity' AS kind, id, CASE WHEN id LIKE 'S%' THEN 'renamed ' || name ELSE name END AS value FROM ents
        UNION ALL SELECT DISTINCT 'entity', pid, pname FROM sup WHERE pid LIKE 'person%'
        UNION ALL SELECT 'relation', rel_id, pred FROM checked c WHERE NOT EXISTS (SELECT 1 FROM checked x WHERE x.src = c.src AND x.err IS NOT NULL)
        """,
        "checked",
        "ents",
        "sup",
    ),
)
def upsert_graph(spark, sf_dir):
    target = b.graph_entities(spark, sf_dir)
    renamed = target.where(F.col("entity_id").startswith("S")).withColumn("name", F.concat(F.lit("renamed "), "name"))
    people, _ = graph.gallery_graph(b.gallery_with_nodes(spark, sf_dir).drop("ebucore"))
    fresh = renamed.unionByName(people.where(F.col("entity_id").startswith("person")))
    entities = tables.upsert(target, fresh, schemas.KEYS["entities"], F.col("name"))
    checked, _ = _checked(spark, sf_dir)
    relations = graph.publishable(stored(checked, "checked"))
    empty = relations.limit(0)
    published = tables.upsert(empty, relations, schemas.KEYS["relations"], F.col("predicate"))
    return entities.select(F.lit("entity").alias("kind"), F.col("entity_id").alias("id"), F.col("name").alias("value")).unionByName(
        published.select(F.lit("relation").alias("kind"), F.col("rel_id").alias("id"), F.col("predicate").alias("value"))
    )
