"""A whole benchmark run over orders (samples) and line items (slots)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import benchmark as B
from tessera.operators import evaluation as E
from tessera.plans.registry import query, table


def _run(spark, d):
    o = table(spark, d, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    of = lambda letter, n: F.concat(F.lit(letter), n.cast("string"))
    place = [k.alias("sample_id"), F.lit("ally").alias("team"), F.lit(0).alias("row")]
    none = F.lit(None)
    truth = o.select(*place, of("h", c % 40).alias("stable_id"), none.cast("int").alias("legacy"), (k % 11 == 0).alias("unknown"), F.lit(True).alias("critical"), F.lit("new").alias("engine_id"), F.lit(3).alias("depth"))
    other = of("h", (c + 1) % 40)
    read = o.where("o_orderkey % 13 <> 0").select(*place, F.when(k % 7 == 0, other).otherwise(of("h", c % 40)).alias("class_id"), F.when(k % 17 == 0, "unknown").otherwise("ok").alias("status"), (k % 100 / 100.0).alias("confidence"), F.array(F.lit("x"), F.when(k % 5 == 0, "y").otherwise(of("h", c % 40)), other, of("h", c % 40)).alias("candidates"))
    heroes = B.hero_checks(truth, read, [F.col("confidence")])

    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("sample_id"), F.col("l_linenumber").alias("slot")).agg(F.min("l_partkey").alias("p"), F.min("l_returnflag").alias("f")).withColumn("team", F.lit("ally")).withColumn("row", F.lit(0))
    p, keys = F.col("p"), ["sample_id", "team", "row", "slot"]
    occupied = F.when(F.col("f") == "R", "empty").otherwise("occupied")
    truth = li.select(*keys, of("i", p % 60).alias("stable_id"), F.when(p % 2 == 0, p).alias("legacy"), (p % 23 == 0).alias("unknown"), F.lit(False).alias("critical"), F.lit("new").alias("engine_id"), F.lit(1).alias("depth"), occupied.alias("occupancy"))
    read = li.where("p % 9 <> 0").select(*keys, F.when(p % 8 == 0, "i").otherwise(of("i", p % 60)).alias("class_id"), F.when(p % 14 == 0, "unknown").otherwise("ok").alias("status"), (p % 50 / 50.0).alias("confidence"), F.array(of("i", p % 60)).alias("candidates"), F.when(p % 10 == 0, "empty").otherwise(occupied).alias("occupancy"))
    items = B.item_checks(truth, read, [F.col("confidence")])

    field = [k.alias("sample_id"), F.lit("gold").alias("field"), none.cast("string").alias("team"), none.cast("int").alias("row")]
    given = k % 6 != 0
    truth = o.select(*field, F.when(given, "int").otherwise("none").alias("value_type"), none.cast("string").alias("value_str"), F.when(given, (c % 5).cast("double")).alias("value_num"), none.cast("string").alias("raw"), F.when(given, "ok").otherwise("unknown").alias("status"), (k % 2 == 0).alias("critical"))
    number = F.when(k % 4 == 0, none).when(k % 8 == 1, F.lit(0)).otherwise(c % 5)
    read = o.where("o_orderkey % 10 <> 0").select(*field, F.when(number.isNull(), "none").otherwise("int").alias("value_type"), none.cast("string").alias("value_str"), number.cast("double").alias("value_num"), F.when(number.isNull(), "unknown").otherwise("ok").alias("status"), (c % 10 / 10.0).alias("confidence"))
    fields = B.field_checks(truth, read, [F.col("confidence")])

    rows = o.select(k.alias("sample_id"), F.lit(0).alias("row"), F.lit(10.0).alias("y_start"), (30.0 + c % 7).alias("y_end"), F.lit(100.0).alias("height"))
    found = rows.where("sample_id % 29 <> 0").withColumn("y_start", F.col("y_start") + F.col("sample_id") % 3)
    geometry = E.geometry_success(rows, found, "sample_id", ["sample_id", "row"], "y_start", "y_end", "height")
    samples = o.select(k.alias("sample_id"), F.when(k % 3 == 0, F.concat(F.lit('{"a":'), k, F.lit("}"))).alias("expected_json"), F.when(k % 5 == 0, "{}").otherwise(F.concat(F.lit('{"a":'), k, F.lit("}"))).alias("predicted_json"), F.col("o_totalprice").alias("latency_ms"), F.when(k % 4 != 0, F.col("o_totalprice") / 1000).alias("peak_memory_mib"), F.col("o_orderpriority"))
    return B.benchmark(geometry, heroes, items, fields, samples, {"screen_type": F.col("o_orderpriority"), "parity": F.col("sample_id") % 2})


def _rounded(df):
    return df.select("metric", "part", "status", *[F.round(c, 6).alias(c) for c in ("value", "numerator", "denominator")], "unit")


_RUN = """WITH h AS (SELECT o_orderkey AS s, 'h' || (o_custkey % 40) AS e, o_orderkey % 11 = 0 AS u, o_orderkey % 13 <> 0 AS m, CASE WHEN o_orderkey % 7 = 0 THEN 'h' || ((o_custkey + 1) % 40) ELSE 'h' || (o_custkey % 40) END AS cl, o_orderkey % 17 <> 0 AS ok, (o_orderkey % 100) / 100.0::DOUBLE AS cf, o_orderkey % 13 <> 0 AND (o_orderkey % 5 <> 0 OR 'h' || (o_custkey % 40) = 'h' || ((o_custkey + 1) % 40)) AS t3 FROM orders),
hc AS (SELECT s, e, u, m AND ok AS k, CASE WHEN u THEN NOT (m AND ok) ELSE m AND ok AND cl = e END AS y, t3, CASE WHEN m THEN cf END AS cf FROM h),
l AS (SELECT l_orderkey AS s, l_linenumber AS n, min(l_partkey) AS p, min(l_returnflag) AS f FROM lineitem GROUP BY ALL),
ic AS (SELECT s, 'i' || (p % 60) AS e, p % 23 = 0 AS u, f <> 'R' AS occ, p % 9 <> 0 AND p % 14 <> 0 AS k, CASE WHEN p % 9 = 0 THEN false WHEN p % 10 = 0 THEN f = 'R' ELSE true END AS same,
  CASE WHEN f = 'R' THEN CASE WHEN p % 9 = 0 THEN false ELSE true END WHEN p % 23 = 0 THEN NOT (p % 9 <> 0 AND p % 14 <> 0) ELSE p % 9 <> 0 AND p % 14 <> 0 AND p % 8 <> 0 END AS y, CASE WHEN p % 9 <> 0 THEN (p % 50) / 50.0::DOUBLE END AS cf FROM l),
g AS (SELECT o_orderkey AS s, o_orderkey % 2 = 0 AS crit, o_orderkey % 6 <> 0 AS r, o_custkey % 5 AS w, o_orderkey % 10 <> 0 AS m, CASE WHEN o_orderkey % 10 = 0 OR o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 8 = 1 THEN 0 ELSE o_custkey % 5 END AS v, (o_custkey % 10) / 10.0::DOUBLE AS cf FROM orders),
fc AS (SELECT s, crit, r, w, v, CASE WHEN r THEN v IS NOT NULL AND v = w ELSE v IS NULL END AS y, CASE WHEN v = w THEN 0 ELSE 1 END AS ed, CASE WHEN m THEN cf END AS cf FROM g),
j AS (SELECT s, true AS crit, y, cf FROM hc UNION ALL SELECT s, false, y, cf FROM ic UNION ALL SELECT s, crit, y, cf FROM fc),
cr AS (SELECT s, bool_and(y) AS c FROM j WHERE crit GROUP BY s),
sm AS (SELECT o_orderkey AS s, o_totalprice AS lat, CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice / 1000 END AS mem, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 5 <> 0 END AS js, cr.c, o_orderpriority AS pr FROM orders LEFT JOIN cr ON cr.s = o_orderkey),
b AS (SELECT least(floor(cf * 10 + 1e-9), 9) AS bin, cf, y::INT::DOUBLE AS y FROM j WHERE cf IS NOT NULL), bb AS (SELECT bin, count(*) AS n, avg(cf) AS a, avg(y) AS q, sum((cf - y) ** 2) AS e2 FROM b GROUP BY bin),
th AS (SELECT t, count(*) FILTER (cf >= t) AS acc, count(*) FILTER (cf >= t AND y = 1) AS good, count(*) AS tot FROM b, (SELECT unnest([0.0, 0.5, 0.7, 0.8, 0.9, 0.95, 0.99])::DOUBLE AS t) GROUP BY t),
o AS (SELECT *, coalesce(c, js) AS oc FROM sm WHERE coalesce(c, js) IS NOT NULL),
x AS (
  SELECT 'geometry_success' AS metric, NULL AS part, count(*) FILTER (o_orderkey % 29 <> 0)::DOUBLE AS n, count(*)::DOUBLE AS d, NULL::DOUBLE AS v, 'fraction' AS unit FROM orders
  UNION ALL SELECT 'normalized_coordinate_error', NULL, NULL, 2.0 * count(*), sum(o_orderkey % 3 / 100.0::DOUBLE) / (2.0 * count(*)), 'fraction_of_source_height' FROM orders WHERE o_orderkey % 29 <> 0
  UNION ALL SELECT 'hero_top1_accuracy', NULL, count(*) FILTER (y), count(*), NULL, 'fraction' FROM hc WHERE NOT u UNION ALL SELECT 'hero_top3_accuracy', NULL, count(*) FILTER (t3), count(*), NULL, 'fraction' FROM hc WHERE NOT u
  UNION ALL SELECT 'item_top1_accuracy', NULL, count(*) FILTER (y), count(*), NULL, 'fraction' FROM ic WHERE NOT u AND occ UNION ALL SELECT 'item_top3_accuracy', NULL, 0, 0, NULL, 'fraction'
  UNION ALL SELECT 'item_occupancy_accuracy', NULL, count(*) FILTER (same), count(*), NULL, 'fraction' FROM ic
  UNION ALL SELECT 'unknown_false_accept_rate', NULL, count(*) FILTER (k), count(*), NULL, 'fraction' FROM (SELECT k FROM hc WHERE u UNION ALL SELECT k FROM ic WHERE u AND occ)
  UNION ALL SELECT 'unknown_false_reject_rate', NULL, count(*) FILTER (NOT k), count(*), NULL, 'fraction' FROM (SELECT k FROM hc WHERE NOT u UNION ALL SELECT k FROM ic WHERE NOT u AND occ)
  UNION ALL SELECT 'hero_per_class_recall', e, count(*) FILTER (y), count(*), NULL, 'fraction' FROM hc WHERE NOT u GROUP BY ROLLUP (e) UNION ALL SELECT 'item_per_class_recall', e, count(*) FILTER (y), count(*), NULL, 'fraction' FROM ic WHERE NOT u AND occ GROUP BY ROLLUP (e)
  UNION ALL SELECT 'ocr_exact_sequence_accuracy', NULL, count(*) FILTER (y), count(*), NULL, 'fraction' FROM fc WHERE r UNION ALL SELECT 'ocr_character_error_rate', NULL, sum(ed), count(*), NULL, 'edits_per_character' FROM fc WHERE r
  UNION ALL SELECT 'numeric_exact_value_accuracy', NULL, count(*) FILTER (y), count(*), NULL, 'fraction' FROM fc WHERE r
  UNION ALL SELECT 'zero_missing_confusion', 'true_zero_predicted_missing', NULL, count(*) FILTER (r), count(*) FILTER (r AND w = 0 AND v IS NULL), 'count' FROM fc UNION ALL SELECT 'zero_missing_confusion', 'missing_predicted_zero', NULL, count(*) FILTER (r), count(*) FILTER (NOT r AND v = 0), 'count' FROM fc
  UNION ALL SELECT 'critical_field_exact_match', NULL, count(*) FILTER (c), count(c), NULL, 'fraction' FROM sm UNION ALL SELECT 'full_json_exact_match', NULL, count(*) FILTER (js), count(js), NULL, 'fraction' FROM sm
  UNION ALL SELECT 'latency', 'mean_ms', NULL, count(lat), avg(lat), 'milliseconds_per_screenshot' FROM sm UNION ALL SELECT 'latency', 'max_ms', NULL, count(lat), max(lat), 'milliseconds_per_screenshot' FROM sm
  UNION ALL SELECT 'memory', 'mean_peak_mib', NULL, count(mem), avg(mem), 'mebibytes_peak_rss' FROM sm UNION ALL SELECT 'memory', 'max_peak_mib', NULL, count(mem), max(mem), 'mebibytes_peak_rss' FROM sm
  UNION ALL SELECT 'confidence_calibration', 'ece', NULL, sum(n), sum(abs(q - a) * n) / sum(n), 'probability' FROM bb UNION ALL SELECT 'confidence_calibration', 'brier', NULL, sum(n), sum(e2) / sum(n), 'probability' FROM bb
  UNION ALL SELECT 'selective_accuracy', 'coverage@' || t, acc, tot, NULL, 'fraction' FROM th UNION ALL SELECT 'slices', 'screen_type=' || pr, count(*) FILTER (oc), count(*), NULL, 'accuracy_by_slice' FROM o GROUP BY pr UNION ALL SELECT 'slices', 'parity=' || (s % 2), count(*) FILTER (oc), count(*), NULL, 'accuracy_by_slice' FROM o GROUP BY s % 2),
y AS (SELECT metric, part, CASE WHEN d > 0 THEN 'available' ELSE 'unavailable' END AS status, coalesce(v, n / nullif(d, 0)) AS value, n AS numerator, d AS denominator, unit FROM x
  UNION ALL SELECT 'selective_accuracy', 'accuracy@' || t, 'available', coalesce(good / nullif(acc, 0)::DOUBLE, 0.0), good, acc, 'fraction' FROM th
  UNION ALL SELECT 'latency', 'p50_ms', 'available', (SELECT percentile_disc(0.5) WITHIN GROUP (ORDER BY lat) FROM sm), NULL, NULL, 'milliseconds_per_screenshot' UNION ALL SELECT 'latency', 'p95_ms', 'available', (SELECT percentile_disc(0.95) WITHIN GROUP (ORDER BY lat) FROM sm), NULL, NULL, 'milliseconds_per_screenshot'),
z AS (SELECT metric, part, status, round(value, 6) AS value, round(numerator::DOUBLE, 6) AS numerator, round(denominator::DOUBLE, 6) AS denominator, unit FROM y)"""


@query("C4 A1 A2 A3 A4 A5 A6 A7 A8 A9 A10 A11 A12 A13 A15 A16 A17 A18 A19 A20 A21 A22", f"{_RUN} SELECT * FROM z")
def benchmark_run(spark, d):
    return _rounded(_run(spark, d))


@query("A23", f"{_RUN} SELECT n.metric, count(z.metric) AS parts, CASE WHEN bool_or(z.status = 'available') THEN 'available' ELSE 'unavailable' END AS status, CASE WHEN bool_or(z.status = 'available') THEN NULL ELSE 'not measured by this run' END AS reason FROM (SELECT unnest({list(E.METRICS)}) AS metric) n LEFT JOIN z ON z.metric = n.metric GROUP BY n.metric")
def eval_all_metrics(spark, d):
    """Every metric of the run by name; what has no observation is unavailable."""
    found = _run(spark, d).groupBy("metric").agg(F.count("*").alias("parts"), F.when(F.bool_or(F.col("status") == "available"), "available").otherwise("unavailable").alias("status"))
    return E.all_metrics(found, "not measured by this run").select("metric", F.coalesce("parts", F.lit(0)).alias("parts"), "status", "reason")
