"""Small rules over the tables: policies, votes, identities, reports, plans of reading."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import rules as R
from tessera.plans.registry import query, table


@query("P10 P21", """SELECT p_partkey, CASE lower(k) WHEN 'hero' THEN 'hero' WHEN 'heroes' THEN 'hero' WHEN 'item' THEN 'item' WHEN 'items' THEN 'item' END AS kind FROM (SELECT p_partkey, p_size, ['Hero', 'HEROES', 'item', 'Items', 'tower'][(p_partkey % 5 + 1)::INT] AS k FROM part) WHERE p_size > 10""")
def enabled_kinds(spark, d):
    names = F.array(*[F.lit(x) for x in ("Hero", "HEROES", "item", "Items", "tower")])
    fields = table(spark, d, "part").withColumn("enabled", F.col("p_size") > 10)
    return R.enabled_fields(fields).select("p_partkey", R.kind_of(F.get(names, (F.col("p_partkey") % 5).cast("int"))).alias("kind"))


@query("P17", "SELECT ps.p_partkey, ps.p_brand FROM part ps WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48 AND l_partkey IS NOT NULL)")
def reference_exclusion(spark, d):
    return R.without_visuals(table(spark, d, "part").select("p_partkey", "p_brand"), table(spark, d, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("p_partkey")), "p_partkey")


@query("P18 P33", """WITH r AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN '  ' ELSE ['Auto', 'exact-cpu', 'nvidia-cuda', 'turbo', 'FAST-CPU'][(c_custkey % 5 + 1)::INT] END AS given, ['auto', 'fast-cpu'][(c_custkey % 2 + 1)::INT] AS env, c_custkey % 4 = 0 AS cuda FROM customer),
q AS (SELECT *, lower(coalesce(nullif(trim(given), ''), env)) AS n FROM r), s AS (SELECT *, CASE WHEN n = 'auto' THEN 'fast-cpu-vectorized' WHEN n IN ('exact-cpu', 'fast-cpu', 'fast-cpu-vectorized', 'nvidia-cuda') THEN n END AS selected FROM q)
SELECT c_custkey, selected, CASE WHEN selected = 'nvidia-cuda' THEN 'CUDAExecutionProvider' WHEN selected IS NOT NULL THEN 'CPUExecutionProvider' END AS provider, CASE WHEN selected LIKE 'fast-cpu%' THEN 1 END AS threads,
  CASE WHEN selected = 'fast-cpu-vectorized' THEN 'vectorized' WHEN selected IS NOT NULL THEN 'scalar' END AS backend, CASE WHEN selected IS NULL THEN 'unknown_profile' WHEN selected = 'nvidia-cuda' AND NOT cuda THEN 'provider_unavailable' WHEN selected = 'nvidia-cuda' THEN 'uncertified' ELSE 'ok' END AS status FROM s""")
def runtime_profiles(spark, d):
    k = F.col("c_custkey")
    pick = lambda names, m: F.get(F.array(*[F.lit(x) for x in names]), (k % m).cast("int"))
    given = F.when(k % 3 == 0, F.lit(None).cast("string")).when(k % 3 == 1, "  ").otherwise(pick(("Auto", "exact-cpu", "nvidia-cuda", "turbo", "FAST-CPU"), 5))
    return table(spark, d, "customer").select("c_custkey", R.runtime_profile(R.by_precedence(given, pick(("auto", "fast-cpu"), 2)), k % 4 == 0).alias("p")).select("c_custkey", "p.*")


@query("P22 P6", "SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag = 'A' OR l_linestatus <> 'F' AS required FROM lineitem WHERE l_returnflag IN ('A', 'N')")
def truth_requirement(spark, d):
    kind = F.when(F.col("l_returnflag") == "A", "hero").when(F.col("l_returnflag") == "N", "item").otherwise("metadata")
    scope = F.when(F.col("l_linestatus") == "F", "hero_plus_item_exceptions").otherwise("full_match")
    rows = R.only_kinds(table(spark, d, "lineitem").withColumn("kind", kind), ["hero", "item"])
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", R.truth_required(F.col("kind"), scope).alias("required"))


@query("P29 F46", """WITH f AS (SELECT p_partkey, ['game_result', 'game_duration', 'hero_level', 'total_gold', 'battle_id', 'match_id', 'kills', 'assists_total', 'skill_level', 'damage', 'rating'][(p_partkey % 11 + 1)::INT] AS f, ['text', 'integer', 'float', 'percentage', 'other'][(p_partkey % 5 + 1)::INT] AS k FROM part)
SELECT p_partkey, CASE f WHEN 'game_result' THEN 'result_vote' WHEN 'game_duration' THEN 'duration' WHEN 'hero_level' THEN 'level_vote' WHEN 'total_gold' THEN 'gold_vote' WHEN 'battle_id' THEN 'identifier_vote' WHEN 'match_id' THEN 'identifier_vote' ELSE CASE WHEN k IN ('integer', 'float', 'percentage') THEN k ELSE 'text' END END AS route,
  CASE WHEN k = 'integer' AND f IN ('kills', 'assists_total') THEN 99 WHEN k = 'integer' AND f = 'skill_level' THEN 20 END AS max_value FROM f""")
def field_routes(spark, d):
    pick = lambda names: F.get(F.array(*[F.lit(x) for x in names]), (F.col("p_partkey") % len(names)).cast("int"))
    field = pick(("game_result", "game_duration", "hero_level", "total_gold", "battle_id", "match_id", "kills", "assists_total", "skill_level", "damage", "rating"))
    return table(spark, d, "part").select("p_partkey", R.field_route(pick(("text", "integer", "float", "percentage", "other")), field).alias("r")).select("p_partkey", "r.*")


@query("P30", """SELECT event_id, CASE WHEN c > 0.3 THEN user_id END AS hero_id, CASE WHEN c > 0.3 THEN event_type END AS hero_name, CASE WHEN c > 0.3 THEN c ELSE 0.0 END AS confidence,
  CASE WHEN c > 0.3 THEN NULL ELSE 'No match found or confidence too low' END AS error, CASE WHEN event_type = 'view' THEN NULL WHEN event_type = 'click' THEN NULL ELSE event_type END AS item_name, CASE WHEN event_type IN ('view', 'click') THEN 0.0 ELSE c END AS item_confidence, event_type IN ('view', 'click') AS is_empty
  FROM (SELECT *, (event_id % 1000) / 1000.0::DOUBLE AS c FROM events)""")
def legacy_acceptance(spark, d):
    c = F.col("event_id") % 1000 / 1000.0
    item = F.when(F.col("event_type") == "click", "EMPTY").when(F.col("event_type") != "view", F.col("event_type"))
    rows = table(spark, d, "events").select("event_id", R.hero_accept(F.col("user_id"), F.col("event_type"), c).alias("h"), R.item_accept(item, c).alias("i"))
    return rows.select("event_id", "h.*", "i.item_name", F.col("i.confidence").alias("item_confidence"), "i.is_empty")


@query("P31", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority = '1-URGENT' AND o_custkey % 2 = 0")
def capture_selection(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderstatus") != "P").alias("complete"), F.col("o_orderpriority").alias("family"), (F.col("o_custkey") % 2).cast("string").alias("game"))
    return R.complete_captures(o, "1-URGENT", "0").select("o_orderkey", "o_custkey")


@query("P32", "SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity * 1.2::DOUBLE, 4) AS x, round(l_partkey * 1.2::DOUBLE, 4) AS y FROM lineitem")
def bootstrap_boxes(spark, d):
    box = R.bootstrap_box(F.array("l_quantity", F.col("l_partkey").cast("double")))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", box.alias("b")).select("l_orderkey", "l_linenumber", "l_partkey", F.col("b")[0].alias("x"), F.col("b")[1].alias("y"))


@query("F45", """SELECT p_partkey, CASE WHEN p_size % 2 = 0 AND p_partkey % 3 > 0 THEN 'v1-hero-' || lpad(p_partkey::VARCHAR, greatest(3, length(p_partkey::VARCHAR))::INT, '0') ELSE p_brand END AS hero_id, CASE WHEN p_size % 2 = 0 AND p_partkey % 5 > 0 THEN 'v1-item:' || p_name ELSE p_type END AS item_id FROM part""")
def truth_identities(spark, d):
    engine = F.when(F.col("p_size") % 2 == 0, "legacy-v1").otherwise("other")
    hero = R.truth_identity(engine, "hero", F.col("p_brand"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_partkey")))
    item = R.truth_identity(engine, "item", F.col("p_type"), F.when(F.col("p_partkey") % 5 > 0, F.col("p_name")))
    return table(spark, d, "part").select("p_partkey", hero.alias("hero_id"), item.alias("item_id"))


@query("P23", """WITH g AS (SELECT p_partkey, b, v, ['level', 'percentage', 'small_integer', 'datetime'][(p_partkey % 4 + 1)::INT] AS parser, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE 1 END AS has_parser, ['kills', 'jungle_gold', 'crowd_control', 'rating', 'jungle_gold_percent'][(p_partkey % 5 + 1)::INT] AS field, p_size % 2 = 0 AS fast
  FROM part, (SELECT unnest(['rapidocr-onnxruntime', 'tesseract']) AS b), (SELECT unnest(['native', 'cubic3x', 'clahe3x', 'right80-native', 'right80-cubic3x']) AS v)),
p AS (SELECT *, parser IN ('level', 'datetime') OR field IN ('jungle_gold', 'crowd_control', 'jungle_gold_percent') AS full_set FROM g WHERE has_parser = 1)
SELECT p_partkey, count(*) FILTER (b = 'rapidocr-onnxruntime' AND CASE WHEN v LIKE 'right80%' THEN parser = 'percentage' ELSE full_set OR v = 'native' END) AS fast_readings, count(*) FILTER (b = 'tesseract' AND NOT (fast AND NOT full_set) AND v IN ('cubic3x', 'clahe3x')) AS slow_readings FROM p GROUP BY p_partkey""")
def reading_plans(spark, d):
    k = F.col("p_partkey")
    pick = lambda names: F.get(F.array(*[F.lit(x) for x in names]), (k % len(names)).cast("int"))
    parser = F.when(k % 13 != 0, pick(("level", "percentage", "small_integer", "datetime")))
    views = F.explode(F.array(*[F.struct(F.lit(b).alias("b"), F.lit(v).alias("v")) for b in (R.FAST_BACKEND, R.SLOW_BACKEND) for v in ("native", *R.SLOW_VARIANTS, *R.RIGHT_EDGE_VARIANTS)]))
    rows = table(spark, d, "part").select("p_partkey", "p_size", parser.alias("parser"), pick(("kills", "jungle_gold", "crowd_control", "rating", "jungle_gold_percent")).alias("field"), views.alias("w"))
    planned = rows.where(R.reading_plan(F.col("w.b"), F.col("w.v"), F.col("field"), F.col("parser"), F.col("p_size") % 2 == 0))
    return planned.groupBy("p_partkey").agg(F.count_if(F.col("w.b") == R.FAST_BACKEND).alias("fast_readings"), F.count_if(F.col("w.b") == R.SLOW_BACKEND).alias("slow_readings"))


@query("J16", """WITH k AS (SELECT DISTINCT trim(regexp_replace(lower(p_name), '[^a-z0-9_\\s]', '', 'g')) AS k FROM part WHERE p_size > 25)
SELECT p_partkey, trim(regexp_replace(lower(n), '[^a-z0-9_\\s]', '', 'g')) IN (SELECT k FROM k) OR (n = 'Old widget!' AND 'cold widget' IN (SELECT k FROM k)) AS valid FROM (SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'Old widget!' WHEN p_partkey % 10 = 1 THEN 'No such' ELSE upper(p_name) || '.' END AS n FROM part)""")
def name_validation(spark, d):
    p = table(spark, d, "part")
    name = F.when(F.col("p_partkey") % 10 == 0, "Old widget!").when(F.col("p_partkey") % 10 == 1, "No such").otherwise(F.concat(F.upper("p_name"), F.lit(".")))
    return R.validated_names(p.select("p_partkey", name.alias("name")), "name", p.where("p_size > 25"), "p_name", {"Old widget!": "cold widget"}).select("p_partkey", "valid")


@query("J21", """WITH r AS (SELECT o_custkey AS c, o_orderkey % 3 AS s, o_orderkey % 6 AS r, o_orderkey % 10 = 0 AS drift FROM orders WHERE o_orderkey % 4 = 0),
o AS (SELECT DISTINCT o_custkey AS c, o_orderkey % 3 AS s, o_orderkey % 6 AS r FROM orders WHERE o_orderkey % 8 = 0)
SELECT 'invalid_row' AS code, count(*) AS n FROM r WHERE s = 2 OR r > 4 UNION ALL SELECT 'source_mismatch', count(*) FROM r WHERE drift UNION ALL SELECT 'duplicate_row', count(*) FROM (SELECT 1 FROM r GROUP BY c, s, r HAVING count(*) > 1) UNION ALL SELECT 'unused_row', count(*) FROM (SELECT DISTINCT c, s, r FROM r EXCEPT SELECT c, s, r FROM o)""")
def empty_row_faults(spark, d):
    k = F.col("o_orderkey")
    side = F.when(k % 3 == 0, "ally").when(k % 3 == 1, "enemy").otherwise("both")
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("screenshot"), side.alias("side"), (k % 6).alias("row"), k.alias("k"))
    sidecar = rows.where("k % 4 = 0").withColumn("source_sha256", F.when(F.col("k") % 10 != 0, F.sha2(F.col("screenshot").cast("string"), 256)).otherwise("old"))
    sources = table(spark, d, "customer").select(F.col("c_custkey").alias("screenshot"), F.sha2(F.col("c_custkey").cast("string"), 256).alias("sha256"))
    return R.empty_row_errors(sidecar, sources, rows.where("k % 8 = 0"), "x", "x").groupBy("code").agg(F.count("*").alias("n"))


@query("A31 A32", """WITH r AS (SELECT l_orderkey, l_partkey % 4 AS v, l_linenumber * 100000 + l_partkey AS ord, CASE l_partkey % 3 WHEN 0 THEN 'victory!' WHEN 1 THEN 'de Defeat' ELSE 'draw' END AS t FROM lineitem),
c AS (SELECT l_orderkey, v, count(*) AS n, min(ord) AS f FROM r GROUP BY ALL), g AS (SELECT l_orderkey, max(n) AS top, arg_max(v, (n, -f)) AS mode, max(v) AS greatest FROM c GROUP BY l_orderkey),
w AS (SELECT l_orderkey, CASE WHEN upper(t) LIKE '%DEFEAT%' THEN 'Defeat' WHEN upper(t) LIKE '%VICT%' THEN 'Victory' END AS x, count(*) AS n, min(ord) AS f FROM r GROUP BY ALL),
z AS (SELECT l_orderkey, arg_max(x, (n, -f)) AS result FROM w WHERE x IS NOT NULL GROUP BY l_orderkey)
SELECT g.l_orderkey, CASE WHEN top > 1 THEN mode ELSE greatest END AS gold, greatest, result FROM g LEFT JOIN z ON z.l_orderkey = g.l_orderkey""")
def legacy_votes(spark, d):
    k = F.col("l_partkey")
    text = F.when(k % 3 == 0, "victory!").when(k % 3 == 1, "de Defeat").otherwise("draw")
    rows = table(spark, d, "lineitem").select("l_orderkey", (k % 4).alias("v"), (F.col("l_linenumber") * 100000 + k).alias("ord"), text.alias("t"))
    return R.most_or_greatest(rows, ["l_orderkey"], "v").join(R.result_vote(rows, ["l_orderkey"], "t"), "l_orderkey", "left")


@query("A44", f"""WITH g AS (SELECT vec_id, list_transform(embedding, lambda x: greatest(0, least(255, round_even(128 + 400 * x::DOUBLE, 0)::INT))) AS v FROM embeddings),
e AS (SELECT vec_id, unnest(range(0, 64)) AS i, v FROM g), q AS (SELECT vec_id, count(*) FILTER (i % 8 < 7 AND v[i + 1] = v[i + 2]) / 56.0::DOUBLE AS ex, count(*) FILTER (i < 56 AND v[i + 1] = v[i + 9]) / 56.0::DOUBLE AS ey FROM e GROUP BY vec_id)
SELECT g.vec_id, round(list_avg(v), 6) AS mean, round(list_aggregate(v, 'stddev_pop'), 6) AS std, round(list_aggregate(list_transform(v, lambda x: x::DOUBLE), 'quantile_cont', 0.01), 6) AS p01, round(list_aggregate(list_transform(v, lambda x: x::DOUBLE), 'quantile_cont', 0.99), 6) AS p99,
  len(list_filter(v, lambda x: x <= 2 OR x >= 253)) / 64.0::DOUBLE AS clipped, ex AS equal_x, ey AS equal_y, ex > 0.42 AND ey > 0.42 AS rescaled FROM g JOIN q ON q.vec_id = g.vec_id""")
def grid_quality(spark, d):
    gray = F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.rint(128 + 400 * x.cast("double")).cast("int"))))
    rows = table(spark, d, "embeddings").select("vec_id", gray.alias("v")).select("vec_id", R.grid_statistics(F.col("v"), 8).alias("s")).select("vec_id", "s.*")
    return rows.select("vec_id", *[F.round(c, 6).alias(c) for c in ("mean", "std", "p01", "p99")], "clipped", "equal_x", "equal_y", "rescaled")


@query("A45", "SELECT 'ok' AS status, 1 AS max_parallel_jobs, count(*) FILTER (event_type = 'view') AS queued_jobs, count(*) FILTER (event_type = 'click') AS processing_jobs FROM events")
def job_health(spark, d):
    return R.job_health(table(spark, d, "events").select(F.when(F.col("event_type") == "view", "queued").when(F.col("event_type") == "click", "processing").otherwise("completed").alias("status")))


@query("T2", """WITH RECURSIVE j AS (SELECT o_custkey, o_orderkey, (o_orderkey * 7) AS a, (o_orderkey % 900) * 100 AS s, o_orderstatus = 'F' AS f, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
r AS (SELECT o_custkey, o_orderkey, a, s, f, k, a + s AS ended FROM j WHERE k = 1 UNION ALL SELECT j.o_custkey, j.o_orderkey, j.a, j.s, j.f, j.k, greatest(j.a, r.ended) + j.s FROM r JOIN j ON j.o_custkey = r.o_custkey AND j.k = r.k + 1)
SELECT o_custkey, o_orderkey, ended - s AS started, ended, CASE WHEN a > 50000 THEN NULL WHEN ended - s > 50000 THEN 'queued' WHEN ended > 50000 THEN 'processing' WHEN f THEN 'failed' ELSE 'completed' END AS status FROM r""")
def fifo_jobs(spark, d):
    k = F.col("o_orderkey")
    jobs = table(spark, d, "orders").select("o_custkey", "o_orderkey", (k * 7).alias("a"), (k % 900 * 100).alias("s"), (F.col("o_orderstatus") == "F").alias("failed"))
    return R.fifo_statuses(jobs, "a", "s", F.lit(50000), ["o_orderkey"], ["o_custkey"]).select("o_custkey", "o_orderkey", "started", "ended", "status")


@query("A47", """WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'O' THEN 'pending' ELSE 'skip' END AS dec, o_custkey % 20 AS place FROM orders)
SELECT o_custkey, place AS "at", count(*) AS total, count(*) FILTER (dec = 'pending') AS pending, count(*) FILTER (dec = 'accepted') AS accepted, 0::BIGINT AS edited, 0::BIGINT AS "unknown", count(*) FILTER (dec = 'skip') AS skip, max(o_orderkey) FILTER (i = place) AS current_record, place >= count(*) AS done FROM r GROUP BY o_custkey, place""")
def review_states(spark, d):
    from pyspark.sql import Window

    i = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    dec = F.when(F.col("o_orderstatus") == "F", "accepted").when(F.col("o_orderstatus") == "O", "pending").otherwise("skip")
    rows = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("record_id"), i.alias("i"), dec.alias("dec"), (F.col("o_custkey") % 20).alias("at"))
    return R.review_state(rows, ["o_custkey"], "i", "dec", "at")


@query("U1 U8", "SELECT kind, id, count(*) AS n FROM (SELECT 'hero' AS kind, c_nationkey AS id FROM customer UNION ALL SELECT 'item', s_nationkey FROM supplier) GROUP BY ALL HAVING count(*) > 1")
def record_union(spark, d):
    both = R.union_records(table(spark, d, "customer").select(F.col("c_nationkey").alias("id")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("id")))
    return R.repeated_ids(both, ["kind", "id"])


@query("A36", """WITH p AS (SELECT o_custkey::VARCHAR AS s, l_orderkey, l_linenumber, l_returnflag AS st, l_tax FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
r AS (SELECT s, l_orderkey, (count(*) = 7)::INT AS seven FROM p GROUP BY s, l_orderkey, l_linenumber % 2), w AS (SELECT DISTINCT o_custkey::VARCHAR AS s FROM orders WHERE o_orderkey % 9 = 0),
b AS (SELECT p.s, count(*) AS inferred, count(*) FILTER (l_tax > 0.06) AS queued FROM p GROUP BY p.s), v AS (SELECT s, sum(seven)::BIGINT AS seven FROM r GROUP BY s),
c AS (SELECT s, '{' || string_agg('"' || st || '":' || n, ',' ORDER BY st) || '}' AS j FROM (SELECT s, st, count(*) AS n FROM p GROUP BY s, st) GROUP BY s),
t AS (SELECT '{' || string_agg('"' || st || '":' || n, ',' ORDER BY st) || '}' AS j FROM (SELECT st, count(*) AS n FROM p GROUP BY st)),
a AS (SELECT b.s, inferred, queued, seven, (w.s IS NOT NULL)::BIGINT AS warned, j FROM b JOIN v ON v.s = b.s JOIN c ON c.s = b.s LEFT JOIN w ON w.s = b.s)
SELECT s AS screenshot, inferred, queued, seven AS seven_item_rows, warned AS screens_with_warnings, j AS status_counts FROM a UNION ALL SELECT NULL, sum(inferred)::BIGINT, sum(queued)::BIGINT, sum(seven)::BIGINT, sum(warned)::BIGINT, (SELECT j FROM t) FROM a""")
def item_audit(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("screenshot"))
    p = table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("screenshot", F.col("l_orderkey").alias("side"), (F.col("l_linenumber") % 2).alias("row"), F.col("l_returnflag").alias("status"), "l_tax")
    warned = o.select("screenshot", F.when(F.col("o_orderkey") % 9 == 0, "ally.row1.seven_item_build").otherwise("other").alias("text"))
    return R.item_audit(p, warned, p.where("l_tax > 0.06"))


@query("A41 C5", """WITH m AS (SELECT CASE WHEN s_suppkey % 5 = 0 THEN 'failed' WHEN s_nationkey < 5 THEN 'ambiguous' ELSE 'mapped' END AS status FROM supplier)
SELECT (SELECT count(*) FROM m WHERE status = 'mapped') AS mapped_files, (SELECT count(*) FROM m WHERE status = 'ambiguous') AS ambiguous_files, (SELECT count(*) FROM m WHERE status = 'failed') AS failed_files,
  (SELECT count(*) FROM customer WHERE c_custkey % 2 = 0) AS hero_candidates, (SELECT count(*) FROM customer WHERE c_custkey % 2 = 1) AS item_candidates,
  (SELECT count(*) FROM customer WHERE c_custkey % 11 = 0) AS added, (SELECT count(*) FROM customer WHERE c_custkey % 11 <> 0 AND c_custkey % 13 = 0) AS removed, (SELECT count(*) FROM customer WHERE c_custkey % 11 <> 0 AND c_custkey % 13 <> 0 AND c_custkey % 7 = 0) AS renamed, (SELECT count(*) FROM customer WHERE c_custkey % 11 <> 0 AND c_custkey % 13 <> 0 AND c_custkey % 7 <> 0 AND c_custkey % 5 = 0) AS visual_changed,
  (SELECT count(*) FROM supplier WHERE s_suppkey % 5 = 0) AS failed_downloads""")
def sync_report(spark, d):
    from tessera.operators.catalog import snapshot_diff

    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    k = F.col("c_custkey")
    old = c.where("c_custkey % 11 <> 0").select("c_custkey", "c_name", F.col("c_mktsegment").alias("visual"))
    new = c.where("c_custkey % 13 <> 0 or c_custkey % 11 = 0").select("c_custkey", F.when((k % 7 == 0), F.concat("c_name", F.lit("'"))).otherwise(F.col("c_name")).alias("c_name"), F.when(k % 5 == 0, "new").otherwise(F.col("c_mktsegment")).alias("visual"))
    status = F.when(F.col("s_suppkey") % 5 == 0, "failed").when(F.col("s_nationkey") < 5, "ambiguous").otherwise("mapped")
    return R.sync_report(s.select(status.alias("status")), c.select(F.when(k % 2 == 0, "hero").otherwise("item").alias("kind")), snapshot_diff(old, new, "c_custkey", "c_name", "visual"), s.where("s_suppkey % 5 = 0"))


@query("P20", """WITH p AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS place FROM orders), q AS (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 7 - 1 ELSE place END AS row FROM p),
i AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS place, l_linenumber, l_returnflag, l_partkey FROM lineitem)
SELECT o_custkey AS result_id, q.row, CASE WHEN l_partkey % 2 = 0 THEN l_linenumber - 1 ELSE i.place END AS slot, CASE WHEN l_returnflag = 'R' THEN 'empty' WHEN l_returnflag = 'A' THEN 'occupied' ELSE 'unknown' END AS occupancy, CASE WHEN l_returnflag = 'R' THEN 'empty' WHEN l_returnflag = 'A' THEN 'ok' ELSE 'unknown' END AS status, CASE WHEN l_returnflag = 'A' THEN 'v1-item:' || l_partkey END AS class_id
FROM q JOIN i ON i.l_orderkey = q.o_orderkey WHERE q.row BETWEEN 0 AND 4 AND CASE WHEN l_partkey % 2 = 0 THEN l_linenumber - 1 ELSE i.place END BETWEEN 0 AND 5""")
def wide_results(spark, d):
    """Results as nested as an engine writes them, flattened again to one row an item."""
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.when(F.col("l_partkey") % 2 == 0, F.col("l_linenumber").cast("long")).alias("slot"), (F.col("l_returnflag") == "R").alias("is_empty"), F.when(F.col("l_returnflag") == "A", F.col("l_partkey").cast("string")).alias("item_name"))
    items = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("items"))
    player = F.struct("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") % 7).alias("player_number"), F.coalesce("items", F.array().cast(items.schema["items"].dataType)).alias("items"))
    results = table(spark, d, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy(F.col("o_custkey").alias("result_id")).agg(F.array_sort(F.collect_list(player)).alias("allies"))
    return R.wide_items(R.wide_players(results, {"ally": "allies"})).select("result_id", F.col("row").cast("long").alias("row"), F.col("slot").cast("long").alias("slot"), "occupancy", "status", "class_id")


@query("X9", """WITH t AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_extendedprice) AS rank, l_quantity / 50 AS score, CASE WHEN l_partkey % 17 > 0 THEN 1 - l_tax END AS prototype, l_discount * 10 AS a, l_tax * 10 AS b, l_partkey % 10 / 10.0 AS c, l_suppkey % 10 / 10.0 AS e FROM lineitem),
p AS (SELECT x.*, y.score AS s2, y.prototype AS p2, (x.a > y.a)::INT + (x.b > y.b)::INT + (x.c > y.c)::INT + (x.e > y.e)::INT AS votes FROM t x LEFT JOIN t y ON y.l_orderkey = x.l_orderkey AND y.rank = 2 WHERE x.rank = 1)
SELECT l_orderkey, votes, coalesce(prototype IS NOT NULL AND p2 IS NOT NULL AND prototype >= 0.94 AND score - s2 >= 0.02 AND prototype - p2 >= 0.005 AND votes >= 2, false) AS accepted FROM p""")
def balanced_acceptance(spark, d):
    from tessera.operators.ranking import rank_by

    li = table(spark, d, "lineitem").select("*", (F.col("l_quantity") / 50).alias("score"), F.when(F.col("l_partkey") % 17 > 0, 1 - F.col("l_tax")).alias("prototype_similarity"), (F.col("l_discount") * 10).alias("aligned_gray_correlation"), (F.col("l_tax") * 10).alias("color_correlation"), (F.col("l_partkey") % 10 / 10.0).alias("histogram_correlation"), (F.col("l_suppkey") % 10 / 10.0).alias("edge_correlation"))
    ranked = rank_by(li, "l_orderkey", "score", ["l_linenumber", "l_partkey", "l_extendedprice"])
    return R.balanced_accept(ranked, "l_orderkey", {"prototype": 0.94, "rank_margin": 0.02, "prototype_margin": 0.005, "votes": 2}).select("l_orderkey", "votes", "accepted")


@query("J11", "SELECT c_custkey, r_regionkey AS profile_id FROM customer, region WHERE abs((1000 + c_custkey % 900) / 1000.0::DOUBLE - (10 + 2 * r_regionkey) / 10.0::DOUBLE) <= 0.05::DOUBLE * ((10 + 2 * r_regionkey) / 10.0::DOUBLE)")
def aspect_hypotheses(spark, d):
    v = table(spark, d, "customer").select("c_custkey", (1000 + F.col("c_custkey") % 900).alias("width"), F.lit(1000).alias("height"))
    return R.hypotheses(v, table(spark, d, "region").select(F.col("r_regionkey").alias("profile_id"), (10 + 2 * F.col("r_regionkey")).alias("width"), F.lit(10).alias("height")), 0.05).select("c_custkey", "profile_id")


@query("S10 S11", """SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'markup_body' WHEN page_id % 4 = 1 AND page_id % 3 = 0 THEN 'undecodable' WHEN page_id % 4 = 1 AND page_id % 3 = 1 THEN 'mime_mismatch' WHEN page_id % 40 < 16 THEN 'too_small' WHEN page_id % 7 = 0 THEN 'fully_transparent' WHEN page_id % 11 = 0 THEN 'flat_image' END AS fault,
  CASE WHEN url NOT LIKE 'https://%' THEN 'not_https' WHEN coalesce(nullif(lower(regexp_extract(url, '^https://([^/?#:@]*)(?:[:/?#]|$)', 1)), ''), '') <> 'thther.example.org' THEN 'host_not_allowed' WHEN page_id % 5 = 4 THEN 'too_many_redirects' WHEN page_id % 6 = 0 THEN 'too_large' WHEN page_id % 7 = 0 THEN 'not_an_image' END AS refused FROM pages""")
def asset_checks(spark, d):
    k = F.col("page_id")
    head = F.when(k % 4 == 0, F.substring("html", 1, 64)).otherwise("PNG")
    detected = F.when((k % 4 == 1) & (k % 3 == 0), F.lit(None).cast("string")).when((k % 4 == 1) & (k % 3 == 1), "image/gif").otherwise("image/png")
    fault = R.asset_faults(head, F.lit("image/png"), detected, k % 40, F.lit(64), (k % 7 != 0).cast("int"), F.when(k % 11 == 0, 0.0).otherwise(9.0))
    refused = R.redirect_faults(F.col("url"), ["thther.example.org"], k % 5, F.when(k % 6 == 0, 30 << 20).otherwise(100), F.when(k % 7 == 0, "text/html").otherwise("image/png"))
    return table(spark, d, "pages").select("page_id", fault.alias("fault"), refused.alias("refused"))
