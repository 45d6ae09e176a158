"""Queries over entities and relationships, stores and metrics, on the star-schema tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph as G, stores as S, validate as V, web as X
from ..sources.state import checkpointed
from .registered import query, table

EDGES_SQL = """
    e AS (SELECT 'n' || n_nationkey AS source, 'IN_REGION' AS relation, 'r' || n_regionkey AS target FROM nation
          UNION ALL SELECT 'c' || c_custkey, 'LIVES_IN', 'n' || c_nationkey FROM customer UNION ALL SELECT 's' || s_suppkey, 'SITS_IN', 'n' || s_nationkey FROM supplier)"""


def edges(spark, sf):
    named = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    parts = [("nation", "n", "n_nationkey", "IN_REGION", "r", "n_regionkey"), ("customer", "c", "c_custkey", "LIVES_IN", "n", "c_nationkey"), ("supplier", "s", "s_suppkey", "SITS_IN", "n", "s_nationkey")]
    out = None
    for name, p, k, relation, q, to in parts:
        rows = table(spark, sf, name).select(named(p, k).alias("source"), F.lit(relation).alias("relation"), named(q, to).alias("target"))
        out = rows if out is None else out.union(rows)
    return out


@query("gra01_entity_ids", "SELECT doc_id, sha256(doc_id || ':' || i || ':' || w || ':' || i || ':' || CASE WHEN i % 3 = 2 THEN 'None' ELSE (i + length(w))::VARCHAR END)[1:24] AS entity_id FROM (SELECT doc_id, unnest(ws) AS w, unnest(range(0, len(ws))) AS i FROM (SELECT doc_id, string_split(text, ' ') AS ws FROM documents))")
def gra01_entity_ids(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("i", "w"))
    return rows.select("doc_id", G.entity_id(F.col("doc_id"), F.col("i"), F.col("w"), F.col("i"), F.when(F.col("i") % 3 != 2, F.col("i") + F.length("w"))).alias("entity_id"))


@query("gra02_relationships", "SELECT o_orderkey, 'c' || o_custkey AS source, 'n' || (o_custkey % 30) AS target FROM orders WHERE o_custkey % 7 <> 0 AND o_custkey % 30 < 25")
def gra02_relationships(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 7 != 0, F.concat(F.lit("c"), F.col("o_custkey").cast("string"))).alias("source"), F.when(F.col("o_custkey") % 30 < 25, F.concat(F.lit("n"), (F.col("o_custkey") % 30).cast("string"))).alias("target"))
    return rows.dropna(subset=["source", "target"])


@query("gra03_list_entities", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey IN (1, 2, 3) ORDER BY c_custkey LIMIT 20")
def gra03_list_entities(spark, sf):
    from ..operators.retrieve import matches

    return table(spark, sf, "customer").where(matches({"c_mktsegment": "BUILDING", "c_nationkey": [1, 2, 3]})).orderBy("c_custkey").limit(20).select("c_custkey", "c_name")


@query("gra04_neighbors", f"WITH {EDGES_SQL} SELECT DISTINCT * FROM (SELECT source AS seed, relation, target AS neighbor FROM e WHERE source IN ('n3', 'r1', 'c5') UNION ALL SELECT target, relation, source FROM e WHERE target IN ('n3', 'r1', 'c5'))")
def gra04_neighbors(spark, sf):
    seeds = spark.createDataFrame([("n3",), ("r1",), ("c5",)], "seed string")
    return G.neighbors(edges(spark, sf), seeds)


@query("gra04_walk", f"""WITH RECURSIVE {EDGES_SQL}, b AS (SELECT source AS x, target AS y FROM e UNION SELECT target, source FROM e),
    f AS (SELECT s AS seed, s AS node, 0 AS depth FROM (VALUES ('r1'), ('c5')) v(s) UNION SELECT f.seed, b.y, f.depth + 1 FROM f JOIN b ON b.x = f.node WHERE f.depth < 3)
    SELECT seed, node, min(depth) AS depth FROM f GROUP BY 1, 2""")
def gra04_walk(spark, sf):
    checkpointed(spark)
    return G.walk(edges(spark, sf), spark.createDataFrame([("r1",), ("c5",)], "seed string"), 3)


@query("gra04_path_edges", f"""WITH {EDGES_SQL}, n AS (SELECT row_number() OVER () AS k, * FROM e),
    h AS (SELECT k, source AS x, target AS y, source, relation, target FROM n UNION ALL SELECT k, target, source, source, relation, target FROM n),
    a AS (SELECT x AS seed, * FROM h WHERE x IN ('r1', 'n3')), b AS (SELECT a.seed, a.k AS k1, h.k AS k2 FROM a JOIN h ON h.x = a.y AND h.k <> a.k)
    SELECT seed, source, relation, target, count(*) AS n FROM (SELECT seed, k FROM a UNION ALL SELECT seed, k1 FROM b UNION ALL SELECT seed, k2 FROM b) JOIN n USING (k) GROUP BY ALL""")
def gra04_path_edges(spark, sf):
    found = G.path_edges(edges(spark, sf), spark.createDataFrame([("r1",), ("n3",)], "seed string"), 2, None)
    return found.groupBy("seed", "source", "relation", "target").agg(F.count("*").alias("n"))


@query("gra05_user_levels", """
    WITH e AS (SELECT DISTINCT o_custkey % 300 AS u, o_orderkey % 300 AS f FROM orders), s AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY u ORDER BY f) <= 10),
    a AS (SELECT DISTINCT f AS u FROM s WHERE u IN (1, 2) AND f NOT IN (1, 2) ORDER BY f LIMIT 50),
    b AS (SELECT DISTINCT f AS u FROM s WHERE u IN (SELECT u FROM a) AND f NOT IN (1, 2) AND f NOT IN (SELECT u FROM a) ORDER BY f LIMIT 50)
    SELECT unnest([1, 2]) AS "user", 0 AS level UNION ALL SELECT u, 1 FROM a UNION ALL SELECT u, 2 FROM b""")
def gra05_user_levels(spark, sf):
    checkpointed(spark)
    follows = table(spark, sf, "orders").select((F.col("o_custkey") % 300).alias("user"), (F.col("o_orderkey") % 300).alias("follower")).distinct()
    return G.expand_users(follows, spark.createDataFrame([(1,), (2,)], "user long"), 2)


@query("jon08_resolved_labels", """
    WITH e AS (SELECT n_name AS label, 'n' || n_nationkey AS id FROM nation UNION ALL SELECT lower(n_name), 'low' || n_nationkey FROM nation WHERE n_nationkey < 5),
    t AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 3 = 0 THEN n_name WHEN n_nationkey % 3 = 1 THEN lower(n_name) ELSE 'x' || n_nationkey END AS subject FROM nation)
    SELECT k, subject, coalesce((SELECT max(id) FROM e WHERE label = subject), (SELECT min_by(id, length(id)) FROM e WHERE lower(label) = lower(subject)), subject) AS subject_id FROM t""")
def jon08_resolved_labels(spark, sf):
    n = table(spark, sf, "nation")
    key = F.col("n_nationkey").cast("string")
    ents = n.select(F.col("n_name").alias("label"), F.concat(F.lit("n"), key).alias("id"), F.lit(0).alias("seq")).union(n.where("n_nationkey < 5").select(F.lower("n_name"), F.concat(F.lit("low"), key), F.lit(1)))
    k = F.col("n_nationkey") % 3
    triples = n.select(F.col("n_nationkey").alias("k"), F.when(k == 0, F.col("n_name")).when(k == 1, F.lower("n_name")).otherwise(F.concat(F.lit("x"), key)).alias("subject"), F.lit("is").alias("predicate"), F.lit("y").alias("object"))
    return G.resolve_labels(triples, ents).select("k", "subject", "subject_id")


@query("jon09_post_authors", "SELECT o_orderkey, o_custkey, coalesce(c_name, 'unknown') AS username FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 2 = 0")
def jon09_post_authors(spark, sf):
    users = table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return G.with_authors(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), users, "o_custkey", "c_name").select("o_orderkey", "o_custkey", "username")


@query("jon10_verdicts", "SELECT d.doc_id, coalesce(l.quality = 1 AND l.toxic = 0, FALSE) AS passed, CASE WHEN l.doc_id IS NULL THEN 'no verdict returned' WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'quality' ELSE '' END AS reason FROM documents d LEFT JOIN labels l USING (doc_id)")
def jon10_verdicts(spark, sf):
    reason = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "quality").otherwise("")
    verdicts = table(spark, sf, "labels").select("doc_id", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("passed"), reason.alias("reason"))
    return G.with_verdicts(table(spark, sf, "documents").select("doc_id"), verdicts, ["doc_id"]).select("doc_id", "passed", "reason")


@query("agg14_rule_counts", "SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS n_fail, count(*) FILTER (o_orderstatus = 'P') AS n_unknown, count(*) FILTER (o_orderstatus = 'F') = 0 AS passed FROM orders GROUP BY 1")
def agg14_rule_counts(spark, sf):
    return G.rule_counts(table(spark, sf, "orders"), "o_custkey", "o_orderstatus", "F", "P")


@query("snk01_upsert", """
    WITH c AS (SELECT c_custkey % 500 AS k, max_by(c_name, c_custkey) AS v FROM customer GROUP BY 1)
    SELECT p_partkey AS k, p_name AS v FROM part WHERE p_partkey NOT IN (SELECT k FROM c) UNION ALL SELECT k, v FROM c""")
def snk01_upsert(spark, sf):
    changes = table(spark, sf, "customer").select((F.col("c_custkey") % 500).alias("k"), F.col("c_name").alias("v"), F.col("c_custkey").alias("seq"))
    return S.upsert(table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("v")), changes, ["k"], "v")


@query("snk04_delete", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def snk04_delete(spark, sf):
    gone = table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return S.delete(table(spark, sf, "part").select("p_partkey"), gone, ["p_partkey"])


@query("snk06_entity_merge", """
    WITH r AS (SELECT o_custkey AS id, o_orderkey AS seq, o_orderstatus AS st, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS pr FROM orders)
    SELECT id::VARCHAR AS id, max_by(st, seq) AS status, max_by(pr, seq) FILTER (pr IS NOT NULL) AS priority FROM r GROUP BY 1""")
def snk06_entity_merge(spark, sf):
    rows = table(spark, sf, "orders")
    attributes = F.map_filter(F.create_map(F.lit("status"), "o_orderstatus", F.lit("priority"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority"))), lambda k, v: v.isNotNull())
    out = G.upsert_entities(rows.select(F.lit("Customer").alias("label"), F.col("o_custkey").cast("string").alias("id"), attributes.alias("attributes"), F.col("o_orderkey").alias("seq")))
    return out.select("id", F.col("attributes")["status"].alias("status"), F.col("attributes")["priority"].alias("priority"))


@query("snk07_relationship_merge", "SELECT DISTINCT 'c' || o_custkey AS source, 'PLACED_' || o_orderstatus AS relation, 's' || (o_orderkey % 200) AS target FROM orders WHERE o_custkey % 10 <> 3 AND o_orderkey % 200 IN (SELECT s_suppkey FROM supplier) AND o_custkey IN (SELECT c_custkey FROM customer)")
def snk07_relationship_merge(spark, sf):
    c, s = table(spark, sf, "customer").where("c_custkey % 10 != 3"), table(spark, sf, "supplier")
    ids = c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id")).union(s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))))
    rows = table(spark, sf, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("source"), F.concat(F.lit("placed "), F.lower("o_orderstatus")).alias("relation"), F.concat(F.lit("s"), (F.col("o_orderkey") % 200).cast("string")).alias("target"))
    return G.upsert_relationships(rows, ids)


@query("jon11_ingest_cache", "SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM documents WHERE doc_id % 4 <> 0 AND doc_id % 9 <> 1")
def jon11_ingest_cache(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("/in/"), F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("hash"), F.col("n_chars").alias("mtime"))
    state = docs.where("doc_id % 4 != 0").withColumn("mtime", F.when(F.col("doc_id") % 9 == 1, -1).otherwise(F.col("mtime")))
    return S.to_process(docs, state).select("doc_id")


@query("agg05_batch_totals", """
    SELECT count(*) AS n_files, count(*) FILTER (length(text) > 200) AS n_successful, count(*) FILTER (length(text) <= 200) AS n_failed, sum(length(text) // 100) FILTER (length(text) > 200)::BIGINT AS n_chunks,
           sum(length(text) // 120) FILTER (length(text) > 200)::BIGINT AS n_stored, round(avg(length(text) / 1000.0) FILTER (length(text) > 200), 6) AS avg_seconds FROM documents""")
def agg05_batch_totals(spark, sf):
    n = F.length("text")
    rows = table(spark, sf, "documents").select("source", (n > 200).alias("success"), F.lit(None).cast("string").alias("error"), F.floor(n / 100).alias("n_chunks"), F.floor(n / 120).alias("n_stored"), (n / 1000.0).alias("seconds"))
    return S.batch_totals(rows).withColumn("avg_seconds", F.round("avg_seconds", 6))


@query("agg10_metrics", "SELECT event_type || '{user=' || (user_id % 4) || '}' AS key, count(*) AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def agg10_metrics(spark, sf):
    key = T.metric_key(F.col("event_type"), F.create_map(F.lit("user"), (F.col("user_id") % 4).cast("string")))
    return S.metrics(table(spark, sf, "events").withColumn("key", key)).withColumn("total", F.round("total", 4)).withColumn("mean", F.round("mean", 6))


@query("flt17_scope_attributes", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source END AS source_type, lang AS author_id FROM documents")
def flt17_scope_attributes(spark, sf):
    extra = F.create_map(F.lit("source_type"), F.when(F.col("doc_id") % 2 == 0, F.col("source")), F.lit("author_id"), "lang", F.lit("other"), F.lit("x"))
    scope = S.scoped(extra, ("source_type", "author_id"))
    return table(spark, sf, "documents").select("doc_id", scope.alias("m")).select("doc_id", F.col("m")["source_type"].alias("source_type"), F.col("m")["author_id"].alias("author_id"))


@query("fn20_state_vectors", "SELECT event_id, 'a' || event_id AS icao24, trim(event_type || ' ') AS callsign, CASE WHEN event_id % 2 = 0 THEN value END AS longitude FROM events")
def fn20_state_vectors(spark, sf):
    v = F.array(F.concat(F.lit("a"), F.col("event_id").cast("string")), F.concat("event_type", F.lit(" ")), F.lit("X"), F.lit(None).cast("string"), F.lit("1"))
    v = F.when(F.col("event_id") % 2 == 0, F.concat(v, F.array(F.col("value").cast("string")))).otherwise(v)
    s = T.state_struct(v)
    return table(spark, sf, "events").select("event_id", s["icao24"].alias("icao24"), s["callsign"].alias("callsign"), s["longitude"].alias("longitude"))


@query("fn17_post_urls", "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN event_id::VARCHAR END AS post_id, CASE WHEN event_id % 3 = 0 THEN 'user' || user_id END AS username FROM events")
def fn17_post_urls(spark, sf):
    k, i = F.col("event_id") % 3, F.col("event_id").cast("string")
    url = F.when(k == 0, F.concat(F.lit("https://x.com/user"), F.col("user_id").cast("string"), F.lit("/status/"), i)).when(k == 1, F.concat(F.lit("https://twitter.com/i/status/"), i, F.lit("?s=1"))).otherwise(F.concat(F.lit("https://x.com/user/"), i))
    return table(spark, sf, "events").select("event_id", T.status_post_id(url).alias("post_id"), T.status_user(url).alias("username"))


@query("set08_posters", "SELECT DISTINCT 'user' || user_id AS username FROM events WHERE event_type <> 'click'")
def set08_posters(spark, sf):
    url = F.concat(F.lit("https://x.com/user"), F.col("user_id").cast("string"), F.lit("/status/"), F.col("event_id").cast("string"))
    error = F.when(F.col("event_type") == "click", "failed")
    return X.expansion_posters(table(spark, sf, "events").select(url.alias("url"), error.alias("error")), failed="error")


@query("set10_concatenated", "SELECT r_regionkey AS k, r_name AS name FROM region UNION ALL SELECT n_nationkey, n_name FROM nation")
def set10_concatenated(spark, sf):
    return G.concatenated(table(spark, sf, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")), table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")))


@query("fn22_listing_lines", "SELECT p_partkey, '- ' || p_name || CASE WHEN p_size > 25 THEN ' — ' || p_brand ELSE '' END || ' — ' || p_type AS line FROM part")
def fn22_listing_lines(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.listing_line(F.col("p_name"), F.when(F.col("p_size") > 25, F.col("p_brand")), F.col("p_type")).alias("line"))


@query("fn21_safe_labels", r"SELECT p_partkey, regexp_replace(p_type, '[^A-Za-z0-9_]', '_', 'g') AS label FROM part")
def fn21_safe_labels(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.safe_label(F.col("p_type"), "Entity").alias("label"))
