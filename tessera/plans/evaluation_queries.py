"""Evaluation over documents, labels, events, orders and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import evaluation as E
from tessera.operators.numbering import nearest_ranks
from tessera.operators.rules import stable_keys
from tessera.plans.registry import query, table


def _checks(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    return E.truth_checks(docs, table(spark, d, "labels").select("doc_id", "quality", "toxic"), ["doc_id"], [F.col("quality"), F.col("toxic")])


_CHECKS = """
checks AS (
  SELECT d.doc_id, d.lang, d.source, l.quality, l.toxic, l.doc_id IS NOT NULL AS matched
  FROM documents d LEFT JOIN (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY quality DESC NULLS LAST, toxic DESC NULLS LAST) AS rn FROM labels) WHERE rn = 1
  ) l ON d.doc_id = l.doc_id)"""


@query("J1", f"WITH {_CHECKS} SELECT * FROM checks")
def eval_left_join_checks(spark, d):
    return _checks(spark, d)


_TOP = """
SELECT metric, CASE WHEN d = 0 THEN 'unavailable' ELSE 'available' END AS status, n / nullif(d, 0) AS value, n AS numerator, d AS denominator, 'ratio' AS unit FROM (
  SELECT unnest(['hero_top1_accuracy', 'unknown_false_accept_rate', 'unknown_false_reject_rate', 'critical_field_exact_match', 'item_top3_accuracy']) AS metric,
         unnest([a, b, c, e, f]::DOUBLE[]) AS n, unnest([k, u, k, s, z]::DOUBLE[]) AS d FROM (
    SELECT count(*) FILTER (known AND quality = 1) AS a, count(*) FILTER (NOT known AND quality = 1) AS b, count(*) FILTER (known AND quality IS NULL) AS c,
           count(*) FILTER (matched AND toxic = 0) AS e, 0 AS f, count(*) FILTER (known) AS k, count(*) FILTER (NOT known) AS u, count(*) FILTER (matched) AS s, 0 AS z
    FROM (SELECT *, source NOT IN ('src0', 'src1') AS known FROM checks)))"""


def _topline(spark, d):
    c = _checks(spark, d).withColumn("known", ~F.col("source").isin("src0", "src1"))
    known, good, zero = F.col("known"), F.col("quality") == 1, F.lit(0)
    return E.metric_table(
        c,
        [
            E.metric_row("hero_top1_accuracy", F.count_if(known & good), F.count_if(known)),
            E.metric_row("unknown_false_accept_rate", F.count_if(~known & good), F.count_if(~known)),
            E.metric_row("unknown_false_reject_rate", F.count_if(known & F.col("quality").isNull()), F.count_if(known)),
            E.metric_row("critical_field_exact_match", F.count_if(F.col("matched") & (F.col("toxic") == 0)), F.count_if("matched")),
            E.metric_row("item_top3_accuracy", F.max(zero), F.max(zero)),
        ],
    )


@query("A1 A4 A5 A9", f"WITH {_CHECKS} {_TOP}")
def eval_topline_ratios(spark, d):
    return _topline(spark, d)


@query("A6", f"WITH {_CHECKS} SELECT source AS class, grouping(source) AS is_total, count(*) FILTER (quality = 1) AS numerator, count(*) AS denominator, count(*) FILTER (quality = 1) / count(*)::DOUBLE AS recall FROM checks GROUP BY ROLLUP (source)")
def eval_per_class_recall(spark, d):
    out = E.per_class_recall(_checks(spark, d), "source", F.coalesce(F.col("quality") == 1, F.lit(False)))
    return out.withColumn("is_total", F.col("is_total").cast("long"))


_CONF, _PURCHASE = "least(value / 400, 1.0)", "event_type = 'purchase'"
_BINS = "SELECT " + " + ".join(f"(c >= {i}/10.0::DOUBLE)::INT" for i in range(1, 10)) + f" AS bin, c, y FROM (SELECT {_CONF} AS c, ({_PURCHASE})::INT::DOUBLE AS y FROM events) WHERE c BETWEEN 0 AND 1"


def _events(spark, d):
    return table(spark, d, "events"), F.expr(_CONF), F.expr(_PURCHASE)


@query("A15", f"SELECT bin, count(*) AS n, round(avg(c), 6) AS mean_confidence, round(avg(y), 6) AS accuracy, round(sum((c - y) ** 2), 4) AS squared_error FROM ({_BINS}) GROUP BY bin")
def eval_calibration_bins(spark, d):
    out = E.calibration_bins(*_events(spark, d))
    return out.select("bin", "n", F.round("mean_confidence", 6).alias("mean_confidence"), F.round("accuracy", 6).alias("accuracy"), F.round("squared_error", 4).alias("squared_error"))


@query("A15", f"WITH b AS (SELECT bin, count(*) AS n, avg(c) AS m, avg(y) AS a, sum((c - y) ** 2) AS s FROM ({_BINS}) GROUP BY bin) SELECT sum(n)::BIGINT AS n, round(sum(abs(a - m) * n) / sum(n), 6) AS ece, round(sum(s) / sum(n), 6) AS brier FROM b")
def eval_ece_brier(spark, d):
    return E.calibration_summary(E.calibration_bins(*_events(spark, d))).select("n", F.round("ece", 6).alias("ece"), F.round("brier", 6).alias("brier"))


@query(
    "A16",
    f"""SELECT t AS threshold, count(*) FILTER (c >= t) AS accepted, count(*) FILTER (c >= t AND y) AS correct, count(*) AS total,
    count(*) FILTER (c >= t) / count(*)::DOUBLE AS coverage, coalesce(count(*) FILTER (c >= t AND y) / nullif(count(*) FILTER (c >= t), 0)::DOUBLE, 0.0) AS accuracy
    FROM (SELECT {_CONF} AS c, {_PURCHASE} AS y FROM events), (SELECT unnest([0.0, 0.5, 0.7, 0.8, 0.9, 0.95, 0.99])::DOUBLE AS t) GROUP BY t""",
)
def eval_selective_accuracy(spark, d):
    return E.selective_accuracy(*_events(spark, d))


@query("A10 A11 F18", "SELECT p_brand, sum(levenshtein(p_type, p_name))::BIGINT AS edits, sum(length(p_name))::BIGINT AS characters, round(sum(levenshtein(p_type, p_name)) / sum(length(p_name)), 6) AS cer, count(*) FILTER (p_type = p_name) AS exact FROM part GROUP BY p_brand")
def eval_cer(spark, d):
    edits, characters = E.character_error_rate(F.col("p_name"), F.col("p_type"))
    out = table(spark, d, "part").groupBy("p_brand").agg(edits.alias("edits"), characters.alias("characters"), F.count_if(F.col("p_type") == F.col("p_name")).alias("exact"))
    return out.withColumn("cer", F.round(F.col("edits") / F.col("characters"), 6))


@query("A19 A20", "SELECT event_type, round(avg(value), 6) AS mean, percentile_disc(0.5) WITHIN GROUP (ORDER BY value) AS p50, percentile_disc(0.95) WITHIN GROUP (ORDER BY value) AS p95, max(value) AS max FROM events GROUP BY event_type")
def eval_latency_percentiles(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("max")).join(nearest_ranks(e, ["event_type"], "value", {"p50": 0.5, "p95": 0.95}), "event_type")


_SLICE_ROWS = "SELECT o_orderstatus, o_orderpriority, year(o_orderdate)::VARCHAR AS y, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS segment, o_totalprice > 100000 AS ok FROM orders LEFT JOIN customer ON o_custkey = c_custkey"


@query(
    "A21 A22",
    f"""WITH r AS ({_SLICE_ROWS}), l AS (SELECT 'status' AS dimension, o_orderstatus AS value, ok FROM r UNION ALL SELECT 'priority', o_orderpriority, ok FROM r UNION ALL SELECT 'year', y, ok FROM r UNION ALL SELECT 'custom:segment', segment, ok FROM r)
    SELECT dimension, value, count(*) FILTER (ok) AS numerator, count(*) AS denominator, count(*) FILTER (ok) / count(*)::DOUBLE AS accuracy FROM l WHERE value IS NOT NULL GROUP BY ALL""",
)
def eval_slices(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    rows = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    segment = F.when(F.col("o_custkey") % 3 != 0, F.col("c_mktsegment"))
    return E.sliced(rows, {"status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority"), "year": F.year("o_orderdate"), "custom:segment": segment}, F.col("o_totalprice") > 100000)


@query("A18", "SELECT count(*) FILTER (ok) AS numerator, count(*) AS denominator, count(*) FILTER (ok) / count(*)::DOUBLE AS value FROM (SELECT l_orderkey, bool_and(l_returnflag <> 'R') AS ok FROM lineitem WHERE l_linenumber <= 3 GROUP BY l_orderkey)")
def eval_critical_all(spark, d):
    return E.all_critical(table(spark, d, "lineitem"), "l_orderkey", F.col("l_linenumber") <= 3, F.col("l_returnflag") != "R")


@query("A13", f"WITH {_CHECKS} SELECT count(*) FILTER (quality = 0 AND r IS NULL) AS zero_to_missing, count(*) FILTER (quality = 0) AS zeros, count(*) FILTER (quality IS NULL AND r = 0) AS missing_to_zero, count(*) FILTER (quality IS NULL) AS missing FROM (SELECT *, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN 0 ELSE quality END AS r FROM checks)")
def eval_zero_missing(spark, d):
    rows = _checks(spark, d).withColumn("r", F.when(F.col("doc_id") % 7 == 0, F.lit(None)).when(F.col("doc_id") % 5 == 0, F.lit(0)).otherwise(F.col("quality")))
    return E.zero_missing(rows, F.col("quality"), F.col("r"))


_GEO = "SELECT l_orderkey AS o, l_linenumber AS r, min(l_quantity) AS s, max(l_quantity) + 10 AS e, 100.0::DOUBLE AS h FROM lineitem WHERE l_linenumber <= 5 GROUP BY ALL"


@query(
    "A2 A3",
    f"""WITH t AS ({_GEO}), p AS (SELECT o, r, s + r AS s, e - 1 AS e FROM t WHERE r <> 4 OR o % 2 = 0), n AS (SELECT o, count(*) AS k FROM p GROUP BY o),
    b AS (SELECT t.o, bool_and(p.o IS NOT NULL) AS ok, count(*) AS c, sum((abs(p.s - t.s) + abs(p.e - t.e)) / t.h) AS err, 2 * count(p.o) AS edges FROM t LEFT JOIN p ON t.o = p.o AND t.r = p.r GROUP BY t.o)
    SELECT count(*) FILTER (ok AND coalesce(k, 0) = c) AS correct, count(*) AS samples, round(sum(err) / sum(edges), 6) AS mean_edge_error FROM b LEFT JOIN n ON b.o = n.o""",
)
def eval_geometry(spark, d):
    t = table(spark, d, "lineitem").where("l_linenumber <= 5").groupBy(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("r")).agg(F.min("l_quantity").alias("s"), (F.max("l_quantity") + 10).alias("e")).withColumn("h", F.lit(100.0))
    p = t.where("r <> 4 OR o % 2 = 0").select("o", "r", (F.col("s") + F.col("r")).alias("s"), (F.col("e") - 1).alias("e"))
    by = E.geometry_success(t, p, "o", ["o", "r"], "s", "e", "h")
    return by.agg(F.count_if("correct").alias("correct"), F.count("*").alias("samples"), F.round(F.sum("edge_error") / F.sum("edges"), 6).alias("mean_edge_error"))


@query("A5", "SELECT event_type, CASE WHEN bool_and(depth >= 3) THEN count(*) FILTER (value > 20) ELSE 0 END AS numerator, CASE WHEN bool_and(depth >= 3) THEN count(*) ELSE 0 END AS denominator FROM (SELECT *, CASE WHEN event_type = 'error' THEN 2 + user_id % 2 ELSE 3 END AS depth FROM events) GROUP BY event_type")
def eval_top3_guard(spark, d):
    depth = F.when(F.col("event_type") == "error", 2 + F.col("user_id") % 2).otherwise(3)
    n, m = E.supported_top_k(depth, 3, F.count_if(F.col("value") > 20), F.count("*"))
    return table(spark, d, "events").groupBy("event_type").agg(n.alias("numerator"), m.alias("denominator"))


@query("A17 F44 P19", """SELECT event_id, '{"a":"' || event_type || '","b":"' || user_id || '"}' AS canonical, event_id % 2 = 0 AS equal FROM events""")
def eval_canonical_json(spark, d):
    value = F.create_map(F.lit("b"), F.col("user_id").cast("string"), F.lit("a"), F.col("event_type"), F.lit("timestamp"), F.col("ts").cast("string"))
    stable = stable_keys(value)
    other = F.create_map(F.lit("a"), F.col("event_type"), F.lit("b"), (F.col("user_id") + F.col("event_id") % 2).cast("string"))
    return table(spark, d, "events").select("event_id", E.canonical_json(stable).alias("canonical"), (E.canonical_json(stable) == E.canonical_json(other)).alias("equal"))


@query("A12 A14", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 3 = 0 THEN false WHEN l_linenumber % 3 = 1 THEN l_quantity = floor(l_quantity) ELSE false END AS equal FROM lineitem")
def eval_typed_equality(spark, d):
    kind = F.when(F.col("l_linenumber") % 3 == 0, "bool").when(F.col("l_linenumber") % 3 == 1, "int").otherwise("str")
    eq = E.exact_value(kind, F.col("l_returnflag"), F.col("l_quantity"), F.lit("float"), F.col("l_returnflag"), F.floor("l_quantity").cast("double"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", eq.alias("equal"))


@query("P11 P12", "SELECT o_custkey, bool_and(o_orderstatus <> 'F') AS approved, coalesce(string_agg(o_orderkey::VARCHAR, ', ' ORDER BY o_orderkey::VARCHAR) FILTER (o_orderstatus = 'F'), '') AS offenders, CASE WHEN bool_and(o_orderstatus <> 'F') THEN 'completed' ELSE 'blocked' END AS status FROM orders GROUP BY o_custkey")
def eval_approval_gate(spark, d):
    s = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").cast("string").alias("sample_id"), F.when(F.col("o_orderstatus") == "F", "pending").otherwise("approved").alias("approval"))
    return E.approval_gate(s, ["o_custkey"]).withColumn("status", E.run_gate(F.lit(0), F.lit(1), F.when(F.col("approved"), 0).otherwise(1), F.lit(0), F.lit(0)))


@query("A21 F43", "SELECT p_partkey, (p_size * 16 // gcd(p_size * 16, 480)) || ':' || (480 // gcd(p_size * 16, 480)) AS aspect FROM part")
def eval_aspect(spark, d):
    return table(spark, d, "part").select("p_partkey", E.aspect_of(F.col("p_size") * 16, F.lit(480)).alias("aspect"))
