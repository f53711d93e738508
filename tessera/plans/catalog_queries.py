"""Catalog life cycle over customers, suppliers, parts, events and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import catalog as C
from tessera.plans.registry import query, table

_SNAPSHOTS = """o AS (SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey % 10 <> 0),
n AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN c_name || '*' ELSE c_name END AS c_name, CASE WHEN c_custkey % 5 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 10 <> 1)"""


def _snapshots(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    new = c.where("c_custkey % 10 <> 1").select("c_custkey", F.expr("if(c_custkey % 7 = 0, concat(c_name, '*'), c_name)").alias("c_name"), F.expr("if(c_custkey % 5 = 0, 'NEW', c_mktsegment)").alias("c_mktsegment"))
    return c.where("c_custkey % 10 <> 0"), new


@query("J8 U2 P27", f"WITH {_SNAPSHOTS} SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, o.c_name AS old_name, n.c_name AS new_name, CASE WHEN o.c_custkey IS NULL THEN 'added' WHEN n.c_custkey IS NULL THEN 'removed' WHEN o.c_name <> n.c_name THEN 'renamed' WHEN o.c_mktsegment <> n.c_mktsegment THEN 'visual_changed' ELSE 'unchanged' END AS change FROM o FULL JOIN n ON o.c_custkey = n.c_custkey")
def catalog_diff(spark, d):
    return C.snapshot_diff(*_snapshots(spark, d), "c_custkey", "c_name", "c_mktsegment")


@query("X18", f"WITH {_SNAPSHOTS}, p AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey DESC) - 1 AS prev FROM o) SELECT n.c_custkey, prev AS previous_index, (row_number() OVER (ORDER BY prev IS NULL, prev, n.c_custkey) - 1)::INT AS index FROM n LEFT JOIN p ON n.c_custkey = p.c_custkey")
def catalog_class_map(spark, d):
    from pyspark.sql import Window

    old, new = _snapshots(spark, d)
    previous = old.select("c_custkey", (F.row_number().over(Window.orderBy(F.col("c_custkey").desc())) - 1).cast("long").alias("index"))
    return C.class_numbers(new, previous, "c_custkey")


@query("J5 J15", """WITH t AS (SELECT s_suppkey, 1 AS tier, c_custkey FROM supplier JOIN customer ON s_suppkey % 3 = 0 AND s_suppkey = c_custkey
  UNION ALL SELECT s_suppkey, 2, c_custkey FROM supplier JOIN customer ON replace(s_name, 'Supplier', 'Customer') = c_name AND s_suppkey % 3 = 1
  UNION ALL SELECT s_suppkey, 3, c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey AND s_nationkey < 3),
m AS (SELECT s_suppkey, min(tier) AS tier FROM t GROUP BY s_suppkey), x AS (SELECT t.s_suppkey, t.tier, count(DISTINCT c_custkey) AS k, min(c_custkey) AS c FROM t JOIN m ON t.s_suppkey = m.s_suppkey AND t.tier = m.tier GROUP BY ALL)
SELECT s.s_suppkey, tier, coalesce(k, 0)::INT AS n_matches, CASE WHEN k = 1 THEN c END AS matched_id, CASE WHEN tier IS NULL THEN 'new' WHEN k > 1 THEN 'ambiguous' ELSE 'matched' END AS status FROM supplier s LEFT JOIN x ON s.s_suppkey = x.s_suppkey""")
def catalog_tiered_match(spark, d):
    s, c = table(spark, d, "supplier"), table(spark, d, "customer")
    tiers = [
        (F.when(F.col("s_suppkey") % 3 == 0, F.col("s_suppkey")), F.col("c_custkey")),
        (F.when(F.col("s_suppkey") % 3 == 1, F.regexp_replace("s_name", "Supplier", "Customer")), F.col("c_name")),
        (F.when(F.col("s_nationkey") < 3, F.col("s_nationkey")), F.col("c_nationkey")),
    ]
    return C.tiered_match(s, c, "s_suppkey", tiers, "c_custkey")


@query("A39", "SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL HAVING count(*) > 1")
def catalog_ambiguous(spark, d):
    return C.ambiguous_identities(table(spark, d, "customer"), ["c_nationkey", "c_mktsegment"])


_LEDGER = "l AS (SELECT user_id AS entity, CASE WHEN event_id % 4 = 0 THEN NULL ELSE (event_id % 3) END AS visual, event_type AS action, ts, event_id FROM events)"


def _ledger(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("entity"), F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 3).alias("visual"), F.col("event_type").alias("action"), "ts", "event_id")


@query("X17 S15 T5", f"WITH {_LEDGER} SELECT entity, visual, action, event_id FROM (SELECT *, row_number() OVER (PARTITION BY entity, visual ORDER BY ts DESC, event_id DESC) AS rn FROM l) WHERE rn = 1")
def catalog_latest_action(spark, d):
    return C.latest(_ledger(spark, d), ["entity", "visual"], ["ts", "event_id"]).select("entity", "visual", "action", "event_id")


@query("J19", f"""WITH {_LEDGER}, w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity, visual ORDER BY ts DESC, event_id DESC) AS rn FROM l) WHERE rn = 1),
v AS (SELECT DISTINCT user_id AS entity, k AS visual FROM events, (SELECT unnest([0, 1, 2, 3])::BIGINT AS k))
SELECT v.entity, v.visual, coalesce(a.action, b.action) AS action FROM v LEFT JOIN w a ON a.entity = v.entity AND a.visual = v.visual LEFT JOIN w b ON b.entity = v.entity AND b.visual IS NULL""")
def catalog_review_apply(spark, d):
    v = table(spark, d, "events").select(F.col("user_id").alias("entity")).distinct().select("entity", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("visual"))
    return C.apply_review(v, _ledger(spark, d), "entity", "visual", ["ts", "event_id"]).select("entity", "visual", "action")


@query("J22", f"""WITH {_LEDGER} SELECT event_id, CASE WHEN entity % 10 = 0 THEN 'unknown_class' ELSE 'visual_of_other_class' END AS reason FROM l WHERE entity % 10 = 0 OR (visual IS NOT NULL AND visual > entity % 3)""")
def catalog_rejected_actions(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("entity")).distinct().where("entity % 10 <> 0")
    v = e.select("entity", F.explode(F.sequence(F.lit(0).cast("long"), F.col("entity") % 3)).alias("visual"))
    return C.rejected_actions(_ledger(spark, d), e, v, "entity", "visual").select("event_id", "reason")


_ISSUES = """i AS (SELECT 'mandatory' AS severity, 'unreviewed_class' AS code, d.doc_id::VARCHAR AS subject FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
UNION ALL SELECT 'mandatory', 'placeholder_record', doc_id::VARCHAR FROM documents WHERE length(text) < 20
UNION ALL SELECT 'warning', 'dimension_mismatch', doc_id::VARCHAR FROM documents WHERE n_chars <> length(text)
UNION ALL SELECT 'warning', 'exact_duplicate', sha256(text) FROM documents GROUP BY sha256(text) HAVING count(DISTINCT source) > 1)"""


def _issues(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    same = C.exact_duplicates(docs.withColumn("sha", F.sha2("text", 256)), "doc_id", "sha", "source")
    return C.audit(
        [
            ("unreviewed_class", "mandatory", docs.join(labels, "doc_id", "left_anti"), F.col("doc_id")),
            ("placeholder_record", "mandatory", docs.where(F.length("text") < 20), F.col("doc_id")),
            ("dimension_mismatch", "warning", docs.where(F.col("n_chars") != F.length("text")), F.col("doc_id")),
            ("exact_duplicate", "warning", same, F.col("sha")),
        ]
    )


@query("C6", f"WITH {_ISSUES} SELECT severity, code, subject FROM i")
def catalog_audit_rules(spark, d):
    return _issues(spark, d)


@query("A37 C7", f"WITH {_ISSUES} SELECT count(*) FILTER (severity = 'mandatory') AS mandatory, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'mandatory') = 0 AS promotion_ready FROM i")
def promotion_gate(spark, d):
    return C.promotion(_issues(spark, d))


@query("J9 U3", """WITH r AS (SELECT DISTINCT c_custkey AS id FROM customer WHERE c_mktsegment <> 'MACHINERY'), m AS (SELECT DISTINCT o_custkey AS id FROM orders), v AS (SELECT DISTINCT l_suppkey AS id FROM lineitem)
SELECT 'runtime_not_in_model' AS "check", count(*) AS n, count(*) = 0 AS compatible FROM (SELECT * FROM r EXCEPT SELECT * FROM m)
UNION ALL SELECT 'model_not_in_runtime', count(*), count(*) = 0 FROM (SELECT * FROM m EXCEPT SELECT * FROM r) UNION ALL SELECT 'visual_not_in_runtime', count(*), count(*) = 0 FROM (SELECT * FROM v EXCEPT SELECT * FROM r)""")
def catalog_compatibility(spark, d):
    r = table(spark, d, "customer").where("c_mktsegment <> 'MACHINERY'").select(F.col("c_custkey").alias("id"))
    return C.compatibility(r, table(spark, d, "orders").select(F.col("o_custkey").alias("id")), table(spark, d, "lineitem").select(F.col("l_suppkey").alias("id")), "id")


@query("J6 A38", "SELECT sha256(text) AS sha, count(*) AS members, count(DISTINCT source) AS classes, min(doc_id) AS first_member FROM documents GROUP BY sha256(text) HAVING count(DISTINCT source) > 1")
def dup_exact_groups(spark, d):
    return C.exact_duplicates(table(spark, d, "documents").withColumn("sha", F.sha2("text", 256)), "doc_id", "sha", "source")


_SIGNS = "h AS (SELECT vec_id, embedding AS v, list_sum(list_transform(range(64), lambda i: CASE WHEN embedding[i + 1] >= 0 THEN (1::UBIGINT << i::UBIGINT)::HUGEINT ELSE 0 END))::UBIGINT AS x FROM embeddings)"


@query("J7 F23", f"WITH {_SIGNS} SELECT a.vec_id AS left_id, b.vec_id AS right_id, bit_count(xor(a.x, b.x))::INT AS distance FROM h a JOIN h b ON a.vec_id < b.vec_id AND a.v <> b.v AND bit_count(xor(a.x, b.x)) <= 16")
def dup_near_pairs(spark, d):
    bits = F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda s, i: s.bitwiseOR(F.when(F.element_at("embedding", i + 1) >= 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))))
    sha = F.sha2(F.coalesce(F.col("embedding").cast("string"), F.lit("")), 256)
    return C.near_duplicates(table(spark, d, "embeddings").select("vec_id", bits.alias("x"), sha.alias("sha")), "vec_id", "x", 16, "sha").withColumn("distance", F.col("distance").cast("int"))


@query("P28 J14", """WITH o AS (SELECT c_custkey, sha256(c_name) AS sha FROM customer), f AS (SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN sha256('x' || c_name) ELSE sha256(c_name) END AS now FROM customer WHERE c_custkey % 11 <> 0)
SELECT o.c_custkey, CASE WHEN now IS NULL THEN 'missing' WHEN now <> sha THEN 'digest_changed' ELSE 'kept' END AS outcome FROM o LEFT JOIN f ON o.c_custkey = f.c_custkey""")
def catalog_carry_forward(spark, d):
    c = table(spark, d, "customer")
    files = c.where("c_custkey % 11 <> 0").select("c_custkey", F.sha2(F.expr("if(c_custkey % 9 = 0, concat('x', c_name), c_name)"), 256).alias("sha"))
    kept, lost = C.carry_forward(c.select("c_custkey", F.sha2("c_name", 256).alias("sha")), files, "c_custkey", "sha")
    return kept.select("c_custkey", F.lit("kept").alias("outcome")).unionByName(lost.select("c_custkey", F.col("reason").alias("outcome")))


@query("U6", """WITH u AS (SELECT sha256(text) AS sha, 0 AS parent, item_id AS ord, 'benchmark' AS label FROM benchmark UNION ALL SELECT sha256(text), 1, doc_id, source FROM documents)
SELECT sha, parent, ord, label FROM (SELECT *, row_number() OVER (PARTITION BY sha ORDER BY parent, ord) AS rn FROM u) WHERE rn = 1""")
def merge_first_wins(spark, d):
    b = table(spark, d, "benchmark").select(F.sha2("text", 256).alias("sha"), F.col("item_id").alias("ord"), F.lit("benchmark").alias("label"))
    x = table(spark, d, "documents").select(F.sha2("text", 256).alias("sha"), F.col("doc_id").alias("ord"), F.col("source").alias("label"))
    return C.merge_first_wins([b, x], "sha", "label", "ord")[0].select("sha", "parent", "ord", "label")


@query("U5", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand || '|' || p_type || '|old' ELSE p_brand || '|' || p_type END AS aliases FROM part")
def catalog_aliases(spark, d):
    merged = C.merged_aliases(F.array("p_brand", "p_type"), F.array("p_type", "p_brand"), F.lit("old"), F.col("p_partkey") % 2 == 0)
    return table(spark, d, "part").select("p_partkey", F.array_join(merged, "|").alias("aliases"))


@query("C12", "SELECT min(o_custkey) AS stops_after FROM (SELECT o_custkey, lead(o_custkey) OVER (ORDER BY o_custkey) AS nxt FROM (SELECT DISTINCT o_custkey FROM orders)) WHERE nxt - o_custkey > 3 OR nxt IS NULL")
def catalog_missing_island(spark, d):
    return C.missing_island(table(spark, d, "orders"), "o_custkey", 3)


_PARTS = """e AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'hero' ELSE 'item' END AS kind, CASE WHEN p_partkey % 50 = 0 THEN 'TODO!' WHEN p_partkey % 41 = 0 THEN 'Same ' || p_brand ELSE p_name || ' ' || p_partkey END AS nm, p_size > 5 AS ok FROM part),
v AS (SELECT p_partkey AS id, p_partkey AS c, p_size % 10 <> 0 AS ok, p_size % 8 <> 0 AS prov, 'a' || (p_partkey // 3) AS sha, xor((p_partkey // 4) * 2654435761, p_partkey % 4) AS ph, p_size + 16 AS w FROM part),
f AS (SELECT id, CASE WHEN id % 30 <> 0 THEN CASE WHEN id % 31 = 0 THEN 'other' ELSE sha END END AS sha, ph + CASE WHEN id % 37 = 0 THEN 1 ELSE 0 END AS ph, w + CASE WHEN id % 43 = 0 THEN 1 ELSE 0 END AS w, CASE WHEN id % 47 = 0 THEN 'image/gif' ELSE 'image/png' END AS mime FROM v WHERE id % 29 <> 0),
j AS (SELECT v.id, v.c, v.ok, v.prov, v.sha, v.ph, v.w, f.sha AS s2, f.ph AS p2, f.w AS w2, f.mime FROM v LEFT JOIN f ON f.id = v.id), g AS (SELECT * FROM j WHERE s2 IS NOT NULL)"""


@query("C6", f"""WITH {_PARTS}
SELECT 'mandatory' AS severity, 'placeholder_record' AS code, id::VARCHAR AS class_id, NULL::VARCHAR AS visual_id, NULL::VARCHAR AS related FROM e WHERE nm = 'TODO!' UNION ALL SELECT 'mandatory', 'unreviewed_class', id::VARCHAR, NULL, NULL FROM e WHERE NOT ok
UNION ALL SELECT 'mandatory', 'unreviewed_visual', c::VARCHAR, id::VARCHAR, NULL FROM j WHERE NOT ok UNION ALL SELECT 'mandatory', 'unverified_provenance', c::VARCHAR, id::VARCHAR, NULL FROM j WHERE NOT prov UNION ALL SELECT 'mandatory', 'missing_or_invalid_asset', c::VARCHAR, id::VARCHAR, NULL FROM j WHERE s2 IS NULL
UNION ALL SELECT 'mandatory', 'sha256_mismatch', c::VARCHAR, id::VARCHAR, NULL FROM g WHERE sha <> s2 UNION ALL SELECT 'mandatory', 'phash_mismatch', c::VARCHAR, id::VARCHAR, NULL FROM g WHERE ph <> p2 UNION ALL SELECT 'mandatory', 'dimension_mismatch', c::VARCHAR, id::VARCHAR, NULL FROM g WHERE w <> w2
UNION ALL SELECT 'mandatory', 'mime_mismatch', c::VARCHAR, id::VARCHAR, NULL FROM g WHERE mime <> 'image/png' UNION ALL SELECT 'warning', 'unexpected_aspect_ratio', c::VARCHAR, id::VARCHAR, NULL FROM g WHERE w2 / 32.0 < 0.5 OR w2 / 32.0 > 2.0
UNION ALL SELECT 'mandatory', 'conflicting_normalized_label', NULL, NULL, string_agg(id::VARCHAR, ',' ORDER BY id::VARCHAR) FROM e GROUP BY kind, trim(regexp_replace(lower(nm), '[^a-z0-9_]+', ' ', 'g')) HAVING count(*) > 1
UNION ALL SELECT 'mandatory', 'exact_duplicate', NULL, NULL, string_agg(id::VARCHAR, ',' ORDER BY id::VARCHAR) FROM g GROUP BY s2 HAVING count(DISTINCT c) > 1
UNION ALL SELECT 'warning', 'near_duplicate', NULL, NULL, least(a.id::VARCHAR, b.id::VARCHAR) || ',' || greatest(a.id::VARCHAR, b.id::VARCHAR) FROM g a, g b WHERE a.id < b.id AND a.s2 <> b.s2 AND a.c <> b.c AND bit_count(xor(a.p2, b.p2)) <= 4
UNION ALL SELECT 'mandatory', 'secret_pattern', NULL, NULL, NULL WHERE (SELECT bool_or(regexp_matches(text, '(?i)(authorization|cookie|api[_-]?key|access[_-]?token)\\s*[:=]\\s*[''"]?[A-Za-z0-9+/=_-]{{12,}}') OR regexp_matches(text, '(?i)bearer\\s+[A-Za-z0-9._~+/=-]{{12,}}')) FROM documents)""")
def catalog_audit_all(spark, d):
    p, k = table(spark, d, "part"), F.col("p_partkey")
    entities = p.select(k.alias("id"), F.when(k % 2 == 0, "hero").otherwise("item").alias("kind"), F.when(k % 50 == 0, "TODO!").when(k % 41 == 0, F.concat(F.lit("Same "), "p_brand")).otherwise(F.concat("p_name", F.lit(" "), k)).alias("canonical_name"), F.when(F.col("p_size") > 5, "approved").otherwise("pending").alias("review_status"))
    bits = (F.floor(k / 4) * F.lit(2654435761)).bitwiseXOR(k % 4)
    visuals = p.select(k.alias("id"), k.alias("entity_id"), k.alias("asset_path"), F.when(F.col("p_size") % 10 != 0, "approved").otherwise("pending").alias("review_status"), F.when(F.col("p_size") % 8 != 0, "verified").otherwise("claimed").alias("provenance_status"), F.concat(F.lit("a"), F.floor(k / 3)).alias("sha256"), bits.alias("phash"), (F.col("p_size") + 16).alias("width"), F.lit(32).alias("height"), F.lit("image/png").alias("mime_type"))
    i = F.col("id")
    assets = visuals.where("id % 29 <> 0").select("asset_path", F.when(i % 30 == 0, F.lit(None)).when(i % 31 == 0, "other").otherwise(F.col("sha256")).alias("sha256"), (F.col("phash") + (i % 37 == 0).cast("int")).alias("phash"), (F.col("width") + (i % 43 == 0).cast("int")).alias("width"), "height", F.when(i % 47 == 0, "image/gif").otherwise("image/png").alias("mime_type"))
    return C.audit_catalog(entities, visuals, assets, table(spark, d, "documents").select("text"))
