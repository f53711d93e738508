"""Review queues, geometry, streams and set comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import evaluation as E
from tessera.operators import geometry as G
from tessera.operators import review as V
from tessera.operators import rules as R
from tessera.plans.registry import query, table


@query("P16 P34", """WITH b AS (SELECT l_orderkey, l_linenumber, 'item unknown' AS reason FROM lineitem WHERE l_returnflag = 'N' UNION ALL SELECT l_orderkey, l_linenumber, 'seven items' FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 7)
UNION ALL SELECT l_orderkey, l_linenumber, 'semantic warning' FROM lineitem WHERE l_linestatus = 'F' AND l_tax > 0.05)
SELECT l_orderkey, l_linenumber, string_agg(DISTINCT reason, '; ' ORDER BY reason) AS reasons FROM b GROUP BY ALL""")
def review_exceptions(spark, d):
    li = table(spark, d, "lineitem")
    seven = li.join(li.where("l_linenumber = 7").select("l_orderkey").distinct(), "l_orderkey", "left_semi")
    return V.exceptions([(li.where("l_returnflag = 'N'"), F.lit("item unknown")), (seven, F.lit("seven items")), (li.where("l_linestatus = 'F' and l_tax > 0.05"), F.lit("semantic warning"))], ["l_orderkey", "l_linenumber"])


@query("J13", """WITH w AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'N' ELSE 'R' END AS side, CASE WHEN doc_id % 2 = 0 THEN doc_id % 7 + 1 END AS row FROM documents), r AS (SELECT DISTINCT l_returnflag AS side, l_linenumber AS row FROM lineitem)
SELECT doc_id, r.side, r.row FROM w JOIN r ON r.side = w.side AND (w.row IS NULL OR w.row = r.row)""")
def review_warning_rows(spark, d):
    side = F.when(F.col("doc_id") % 3 == 0, "N").otherwise("R")
    w = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat(side, F.lit(".row"), F.col("doc_id") % 7 + 1, F.lit(".x"))).otherwise(F.concat(side, F.lit(".x"))).alias("warning"))
    r = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("side"), F.col("l_linenumber").alias("row")).distinct()
    return V.warning_rows(w, r, "warning").select("doc_id", "side", "row")


@query("J18", """WITH r AS (SELECT conv_id, turn, role, (conv_id // 3) AS g, conv_id % 9 <> 0 AS same FROM conversations), t AS (SELECT *, CASE WHEN same THEN role ELSE 'other' END AS truth FROM r)
SELECT a.conv_id, a.turn, CASE WHEN count(DISTINCT b.truth) = 1 THEN min(b.truth) END AS repeated_truth FROM t a LEFT JOIN t b ON a.g = b.g AND a.turn = b.turn AND a.conv_id <> b.conv_id GROUP BY a.conv_id, a.turn""")
def review_repeated_truth(spark, d):
    r = table(spark, d, "conversations").select("conv_id", "turn", F.floor(F.col("conv_id") / 3).alias("g"), F.when(F.col("conv_id") % 9 != 0, F.col("role")).otherwise("other").alias("truth"))
    return V.repeated_truth(r, ["g", "turn"], "conv_id", "truth", "turn").select("conv_id", "turn", "repeated_truth")


@query("A34 A35", """WITH k AS (SELECT u.user_id, t.event_type FROM (SELECT DISTINCT user_id FROM events) u, (SELECT unnest(['click', 'error', 'purchase', 'signup', 'skip', 'view']) AS event_type) t)
SELECT k.user_id, k.event_type, count(e.event_id) AS n, 0::BIGINT AS is_total FROM k LEFT JOIN events e ON e.user_id = k.user_id AND e.event_type = k.event_type GROUP BY ALL
UNION ALL SELECT user_id, NULL, count(*), 1 FROM events GROUP BY user_id UNION ALL SELECT NULL, NULL, count(*), 3 FROM events""")
def review_counts_rollup(spark, d):
    e = table(spark, d, "events")
    rolled = e.rollup("user_id", "event_type").agg(F.count("*").alias("n"), F.grouping_id().alias("is_total"))
    kinds = F.explode(F.array(*[F.lit(x) for x in ("click", "error", "purchase", "signup", "skip", "view")]))
    grid = e.select("user_id").distinct().select("user_id", kinds.alias("event_type"))
    filled = grid.join(rolled.where("is_total = 0").drop("is_total"), ["user_id", "event_type"], "left").select("user_id", "event_type", F.coalesce("n", F.lit(0)).alias("n"), F.lit(0).cast("long").alias("is_total"))
    return filled.unionByName(rolled.where("is_total > 0").select("user_id", "event_type", "n", "is_total"))


@query("X19", """WITH a AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_linestatus ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS s FROM lineitem),
b AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY s > 5, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS pick FROM a)
SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, pick FROM b WHERE pick <= 10""")
def sample_balanced_cap(spark, d):
    out = V.balanced_sample(table(spark, d, "lineitem"), "l_suppkey", "l_linestatus", ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], 10)
    return out.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", F.col("pick").cast("long").alias("pick"))


@query("S17 C9", """WITH l AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS value, CASE WHEN o_orderkey % 5 = 0 THEN 'S_' || o_orderkey END AS h FROM orders),
f AS (SELECT *, last_value(h IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS section FROM l)
SELECT o_custkey, o_orderkey, section, 'status' AS "key", value FROM f WHERE h IS NULL""")
def sectioned_text_fill(spark, d):
    text = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("[S_"), "o_orderkey", F.lit("]"))).otherwise(F.concat(F.lit(" status : "), "o_orderstatus"))
    lines = table(spark, d, "orders").select("o_custkey", "o_orderkey", text.alias("text"))
    return V.section_fill(lines, "o_custkey", "o_orderkey", "text")


@query("X21 T6", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey < 700, o_orderkey LIMIT 1")
def wrap_next_unfinished(spark, d):
    return V.next_unfinished(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", F.col("o_orderstatus") == "P", 700)


@query("X20 T3", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 64")
def retain_last_64(spark, d):
    return V.retain_last(table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"])


@query("J20 K4 T7", """WITH a AS (SELECT c_custkey AS k, sha256(c_name) AS recorded FROM customer WHERE c_custkey % 13 <> 0), b AS (SELECT c_custkey AS k, sha256(CASE WHEN c_custkey % 17 = 0 THEN 'x' ELSE c_name END) AS present FROM customer WHERE c_custkey % 19 <> 0)
SELECT coalesce(a.k, b.k) AS c_custkey, recorded, present FROM a FULL JOIN b ON a.k = b.k WHERE recorded IS DISTINCT FROM present""")
def stale_sources(spark, d):
    c = table(spark, d, "customer")
    a = c.where("c_custkey % 13 <> 0").select("c_custkey", F.sha2("c_name", 256).alias("sha"))
    b = c.where("c_custkey % 19 <> 0").select("c_custkey", F.sha2(F.expr("if(c_custkey % 17 = 0, 'x', c_name)"), 256).alias("sha"))
    return V.stale_sources(a, b, "c_custkey", "sha")


@query("A40 J23", """WITH g AS (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL), m AS (SELECT l_orderkey, arg_max(l_returnflag, (n, l_returnflag)) AS f, arg_max(n, (n, l_returnflag)) AS support, sum(n)::BIGINT AS total, count(*) AS v FROM g GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN v = 1 OR (total = 5 AND support >= 4) THEN f END AS l_returnflag, support, total, CASE WHEN v = 1 OR (total = 5 AND support >= 4) THEN 'ok' ELSE 'conflict' END AS status FROM m""")
def truth_majority(spark, d):
    return V.truth_majority(table(spark, d, "lineitem"), ["l_orderkey"], "l_returnflag")


@query("J2 U7", """WITH a AS (SELECT DISTINCT l_orderkey, CASE WHEN l_linenumber > 5 THEN NULL ELSE l_linenumber END AS n FROM lineitem WHERE l_returnflag <> 'R'), b AS (SELECT DISTINCT l_orderkey, CASE WHEN l_linenumber > 5 THEN NULL ELSE l_linenumber END AS n FROM lineitem WHERE l_returnflag <> 'A')
SELECT *, 'right' AS missing_in FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'left' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def review_both_sides(spark, d):
    li = table(spark, d, "lineitem").withColumn("n", F.when(F.col("l_linenumber") <= 5, F.col("l_linenumber")))
    return V.both_sides_complete(li.where("l_returnflag <> 'R'"), li.where("l_returnflag <> 'A'"), ["l_orderkey", "n"])


@query("C2", """WITH r AS (SELECT o_orderstatus AS side, o_orderkey AS row, count(*) AS n, max((l_returnflag = 'R')::INT) AS has, any_value(o_orderpriority) AS hero FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT DISTINCT side || '.row' || row || '.seven_items_without_hero' AS warning FROM r WHERE n = 7 AND hero <> '1-URGENT' UNION SELECT side || '.row' || row || '.seven_items_without_item' FROM r WHERE n = 7 AND has = 0
UNION SELECT side || '.special_hero_rows_disagree' FROM r GROUP BY side HAVING count(*) FILTER (hero = '1-URGENT') > 0 AND count(*) FILTER (n = 7) <> 1""")
def semantic_warnings(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("row"), F.col("o_orderstatus").alias("side"), F.col("o_orderpriority").alias("hero_id"))
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_returnflag").alias("item_id")).join(o.select("row", "side"), "row")
    return V.semantic_warnings(li, o, "1-URGENT", "R")


@query("U4 K8", "WITH a AS (SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 10 <> 0), b AS (SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 10 <> 1) SELECT *, 'expected' AS only_in FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'actual' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)")
def inventory_differences(spark, d):
    from tessera.sources.documents import inventory_differences as differ

    c = table(spark, d, "customer")
    return differ(c.where("c_custkey % 10 <> 0"), c.where("c_custkey % 10 <> 1"), ["c_custkey", "c_mktsegment"])


_PARITY = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, max(l_tax) AS tax FROM lineitem GROUP BY ALL"


@query("K9", f"SELECT l_orderkey, l_linenumber, l_partkey FROM ({_PARITY}) WHERE l_suppkey % 7 = 0 OR l_linenumber = 7")
def ordered_parity(spark, d):
    """An export against one with changed values and one with missing rows."""
    from tessera.sources.documents import ordered_parity as parity

    place = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
    li = table(spark, d, "lineitem").groupBy(F.struct(*place).alias("ord")).agg(F.max("l_tax").alias("tax"))
    other = li.where("ord.l_linenumber <> 7").withColumn("tax", F.when(F.col("ord.l_suppkey") % 7 == 0, F.col("tax") + 1).otherwise(F.col("tax")))
    return parity(li, other, "ord", ["tax"]).select("ord.l_orderkey", "ord.l_linenumber", "ord.l_partkey")


# Geometry.
_DAILY = "d AS (SELECT event_type, date_diff('day', TIMESTAMP '2024-01-01', ts) AS day, count(*) AS n FROM events GROUP BY ALL)"


@query("X27", f"""WITH {_DAILY}, s AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5.0 AS sm FROM d), m AS (SELECT event_type, avg(sm) AS m FROM s GROUP BY event_type),
o AS (SELECT s.*, sm > m AS over, sum((NOT sm > m)::INT) OVER (PARTITION BY s.event_type ORDER BY day) AS k FROM s JOIN m ON s.event_type = m.event_type)
SELECT event_type, min(day) AS first, max(day) AS last, count(*) AS length FROM o WHERE over GROUP BY event_type, k HAVING count(*) BETWEEN 1 AND 20""")
def row_islands(spark, d):
    daily = table(spark, d, "events").groupBy("event_type", F.datediff("ts", F.lit("2024-01-01")).alias("day")).agg(F.count("*").alias("n"))
    return G.bands(daily, "event_type", "day", "n", 1, 20).select("event_type", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "length")


@query("P1 P2 P3 P4 P6", """WITH f AS (SELECT r_name AS field_id, n_name AS side, n_regionkey * 10 AS x1, n_nationkey * 3 AS y1, n_regionkey * 10 + 25 AS x2, n_nationkey * 3 + 9 AS y2 FROM nation JOIN region ON n_regionkey = r_regionkey),
g AS (SELECT *, row, slot, x1 + slot * 7 - 2 AS a1, y1 + row * 13 - 2 AS b1, x2 + slot * 7 + 2 AS a2, y2 + row * 13 + 2 AS b2 FROM f, (SELECT unnest(range(5))::INT AS row), (SELECT unnest(range(6))::INT AS slot)),
m AS (SELECT *, round_even(a1 * 1.25 + 0.5, 0)::INT AS u1, round_even(a2 * 1.25 + 0.5, 0)::INT AS u2, round_even(b1 * 1.25 - 1.5, 0)::INT AS v1, round_even(b2 * 1.25 - 1.5, 0)::INT AS v2 FROM g)
SELECT field_id, side, row, slot, greatest(0, least(u1, 60)) AS x1, greatest(0, least(v1, 80)) AS y1, greatest(0, least(u2, 60)) AS x2, greatest(0, least(v2, 80)) AS y2, u1 < 0 OR u2 > 60 OR v1 < 0 OR v2 > 80 OR u1 > 60 OR v1 > 80 AS changed
FROM m WHERE least(u2, 60) > greatest(0, u1) AND least(v2, 80) > greatest(0, v1)""")
def crop_generator(spark, d):
    n = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    k, m, z = F.col("n_regionkey") * 10, F.col("n_nationkey") * 3, F.lit(0)
    fields = n.select(F.col("r_name").alias("field_id"), F.lit("item").alias("kind"), F.array(F.lit("overall")).alias("screen_types"), F.col("n_name").alias("side"), F.lit(5).alias("n_rows"), F.lit(6).alias("n_slots"), k.alias("x1"), m.alias("y1"), (k + 25).alias("x2"), (m + 9).alias("y2"), z.alias("row_step_x"), F.lit(13).alias("row_step_y"), F.lit(7).alias("slot_step_x"), z.alias("slot_step_y"), F.lit(2).alias("padding"))
    t = table(spark, d, "nation").select(F.col("n_name").alias("side"), F.lit(1.25).cast("double").alias("scale"), F.lit(0.5).cast("double").alias("dx"), F.lit(-1.5).cast("double").alias("dy"))
    out = G.crops(fields, "overall", t, F.lit(60), F.lit(80)).where("clipped is not null")
    return out.select("field_id", "side", "row", "slot", "clipped.*")


@query("X11", "WITH b AS (SELECT user_id, (event_id % 11) AS box, max(value) AS value FROM events GROUP BY ALL) SELECT user_id, box, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, box) AS rank FROM b) WHERE rank <= 8")
def viewport_ranking(spark, d):
    e = table(spark, d, "events").select("user_id", (F.col("event_id") % 11).alias("box"), "value")
    return G.viewports(e, "user_id", "value", "box").select("user_id", "box", "value", F.col("rank").cast("long").alias("rank"))


@query("X12", "WITH b AS (SELECT user_id, event_type, max(least(value / 100, 1.0)) AS s FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER w AS k, s - coalesce(lead(s) OVER w, 0.0) AS m FROM b WINDOW w AS (PARTITION BY user_id ORDER BY s DESC, event_type)) SELECT user_id, event_type, round(s, 6) AS s, round(m, 6) AS margin, s >= 0.68 AND m >= 0.035 AS accepted FROM r WHERE k = 1")
def screen_classification(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", F.least(F.col("value") / 100, F.lit(1.0)).alias("s"))
    return G.classify_screen(e, "user_id", "event_type", "s").select("user_id", "event_type", F.round("s", 6).alias("s"), F.round("margin", 6).alias("margin"), "accepted")


@query("X13", "SELECT l_orderkey, round(max(0.30 * l_discount + 0.42 * l_tax + 0.28 * l_quantity / 50), 6) AS combined FROM lineitem GROUP BY l_orderkey")
def geometry_winner(spark, d):
    li = table(spark, d, "lineitem")
    return G.geometry_winner(li, "l_orderkey", "l_partkey", F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 50).select("l_orderkey", F.round("combined", 6).alias("combined"))


@query("A43", """WITH p AS (SELECT l_suppkey, l_quantity AS dx, l_extendedprice / 1000 AS dy FROM lineitem), m AS (SELECT l_suppkey, median(dx) AS x, median(dy) AS y FROM p GROUP BY ALL)
SELECT p.l_suppkey, round(x, 6) AS shift_x, round(y, 6) AS shift_y, round(median(sqrt((dx - x) ** 2 + (dy - y) ** 2)), 6) AS residual, count(*) AS anchors FROM p JOIN m ON p.l_suppkey = m.l_suppkey GROUP BY p.l_suppkey, x, y""")
def anchor_refinement(spark, d):
    p = table(spark, d, "lineitem").select("l_suppkey", F.col("l_quantity").alias("dx"), (F.col("l_extendedprice") / 1000).alias("dy"))
    out = G.anchor_refinement(p, ["l_suppkey"])
    return out.select("l_suppkey", F.round("shift_x", 6).alias("shift_x"), F.round("shift_y", 6).alias("shift_y"), F.round("residual", 6).alias("residual"), "anchors")


@query("P13 P14", """SELECT vec_id, CASE WHEN s >= 0.8 AND a <= 0.05 AND b <= 0.05 AND c <= 0.05 THEN 'empty' WHEN b >= 0.10 AND c >= 0.10 THEN 'occupied' ELSE 'unknown' END AS occupancy,
CASE WHEN s * 100 < 18 OR a > 0.75 OR b * 100 < 20 OR c < 0.003 OR s < 0.28 THEN 'low_quality' ELSE 'ok' END AS status FROM (SELECT vec_id, abs(embedding[1]::DOUBLE) * 8 AS s, abs(embedding[2]::DOUBLE) AS a, abs(embedding[3]::DOUBLE) AS b, abs(embedding[4]::DOUBLE) AS c FROM embeddings)""")
def occupancy_and_quality(spark, d):
    at = lambda i: F.abs(F.element_at("embedding", i).cast("double"))
    s, a, b, c = at(1) * 8, at(2), at(3), at(4)
    _, status = G.quality_reasons(s * 100, a, b * 100, c, F.lit(480), s)
    return table(spark, d, "embeddings").select("vec_id", G.occupancy(s, a, b, c).alias("occupancy"), status.alias("status"))


@query("P5 P7", """SELECT l_orderkey, l_partkey, l_linenumber, floor(1920 * l_discount)::INT AS x1, floor(1080 * l_tax)::INT AS y1, floor(1920 * (l_discount + 0.3))::INT AS x2, floor(1080 * (l_tax + 0.3))::INT AS y2,
CASE WHEN l_returnflag = 'R' THEN 7 ELSE 6 END AS slots, CASE WHEN l_returnflag = 'R' AND l_linestatus <> 'O' THEN -1 ELSE 0 END AS first_offset FROM lineitem""")
def slot_and_percentage_boxes(spark, d):
    li = table(spark, d, "lineitem")
    slots = G.seventh_slot(F.col("l_returnflag") == "R", F.when(F.col("l_linestatus") == "O", "ally").otherwise("enemy"))
    box = G.percentage_box(F.lit(1920), F.lit(1080), F.col("l_discount"), F.col("l_tax"), F.col("l_discount") + 0.3, F.col("l_tax") + 0.3)
    return li.select("l_orderkey", "l_partkey", "l_linenumber", box.alias("b"), F.size(slots).alias("slots"), slots[0]["offset"].alias("first_offset")).select("l_orderkey", "l_partkey", "l_linenumber", "b.*", "slots", "first_offset")


# Wide records to long, with positions and ranges checked.
@query("P20", """SELECT o_orderkey, f AS field, v AS value, CASE WHEN v IS NULL THEN 'unknown' ELSE 'ok' END AS status FROM (SELECT o_orderkey, unnest(['status', 'priority', 'late']) AS f, unnest([o_orderstatus, substr(o_orderpriority, 3), CASE WHEN o_totalprice > 250000 THEN 'y' END]) AS v FROM orders)""")
def wide_to_long(spark, d):
    return R.long_fields(table(spark, d, "orders"), ["o_orderkey"], {"status": F.col("o_orderstatus"), "priority": F.substring("o_orderpriority", 3, 100), "late": F.when(F.col("o_totalprice") > 250000, "y")})


@query("A33", "SELECT o_orderstatus, count(*) AS n, count(*) FILTER (o_totalprice > 200000) AS large, round_even(avg(o_totalprice), 3) AS mean FROM orders GROUP BY o_orderstatus")
def legacy_summary(spark, d):
    return R.summary(table(spark, d, "orders"), ["o_orderstatus"], {"large": F.col("o_totalprice") > 200000}, {"mean": F.col("o_totalprice")})


@query("A42 X28", "SELECT o_custkey, list_aggregate(list_sort(list_distinct(list(o_orderpriority))), 'string_agg', '|') AS warnings FROM orders GROUP BY o_custkey")
def sorted_warnings(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(R.sorted_set("o_orderpriority"), "|").alias("warnings"))


# Streams.
_JOBS = """e AS (SELECT user_id::VARCHAR AS content_key, event_id, ts, CASE WHEN event_type IN ('purchase', 'error') THEN 'end' ELSE 'submit' END AS event FROM events),
p AS (SELECT *, lag(event) OVER w AS prev FROM e WINDOW w AS (PARTITION BY content_key ORDER BY ts, event_id)),
o AS (SELECT *, CASE WHEN event = 'submit' THEN CASE WHEN coalesce(prev, 'end') = 'end' THEN 'new' ELSE 'shared' END WHEN prev = 'submit' THEN 'released' END AS outcome FROM p),
j AS (SELECT *, last_value(CASE WHEN outcome = 'new' THEN event_id END IGNORE NULLS) OVER (PARTITION BY content_key ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS job_id FROM o)
SELECT content_key, event_id, outcome, job_id FROM j WHERE outcome IS NOT NULL"""


def _jobs(events):
    return events.select(F.col("user_id").cast("string").alias("content_key"), "event_id", "ts", F.when(F.col("event_type").isin("purchase", "error"), "end").otherwise("submit").alias("event"))


@query("T1", f"WITH {_JOBS}")
def stream_active_dedup(spark, d):
    """The stream over the events' file, run to its end."""
    from tessera.streaming.jobs import active_jobs_stream, run_available

    schema = table(spark, d, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{d}/event[s].parquet")
    return run_available(spark, active_jobs_stream(_jobs(events)), "active-jobs")


@query("T1", f"WITH {_JOBS}")
def batch_active_dedup(spark, d):
    from tessera.streaming.jobs import active_jobs_batch

    return active_jobs_batch(_jobs(table(spark, d, "events")))


@query("T4", "SELECT event_id, sha256(event_type || ':' || user_id) AS result FROM events")
def memo_once_per_key(spark, d):
    from tessera.streaming.jobs import once_per_key

    e = table(spark, d, "events").select("event_id", "event_type", "user_id")
    work = lambda k: k.withColumn("result", F.sha2(F.concat_ws(":", "event_type", "user_id"), 256))
    return once_per_key(e, ["event_type", "user_id"], work).select("event_id", "result")


@query("T3 X20", "SELECT * FROM (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F') UNION ALL (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 64)")
def job_retention(spark, d):
    from tessera.streaming.jobs import retain_terminal

    return retain_terminal(table(spark, d, "orders"), F.col("o_orderstatus") == "F", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "o_orderstatus")


@query("J1 J12", "SELECT o.o_orderkey, l.l_partkey FROM orders o LEFT JOIN (SELECT l_orderkey, max(l_partkey) AS l_partkey FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey IS NOT DISTINCT FROM o.o_orderkey")
def last_wins_lookup(spark, d):
    pred = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    return E.truth_checks(table(spark, d, "orders").select("o_orderkey"), pred, ["o_orderkey"], [F.col("l_partkey")]).select("o_orderkey", "l_partkey")


@query("J11", "SELECT c_custkey, r_name FROM customer, region WHERE abs(c_acctbal / 2000 - r_regionkey) <= 0.5")
def profile_hypotheses(spark, d):
    """Every customer against the five regions: the dimension is fixed and small."""
    r = table(spark, d, "region")
    return table(spark, d, "customer").join(F.broadcast(r), F.abs(F.col("c_acctbal") / 2000 - F.col("r_regionkey")) <= 0.5).select("c_custkey", "r_name")


@query("X30", "SELECT doc_id, CASE WHEN toxic IS NULL THEN 'UNKNOWN' WHEN toxic = 0 THEN 'empty' ELSE doc_id || ' — ' || source END AS display FROM documents LEFT JOIN labels USING (doc_id)")
def entity_display(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    known = F.when(F.col("toxic").isNotNull(), F.col("doc_id"))
    return rows.select("doc_id", R.display(known, F.col("source"), F.when(F.col("toxic") == 0, "empty").otherwise("ok")).alias("display"))



@query("P9", "SELECT l_orderkey, l_partkey, l_linenumber, l_quantity BETWEEN 1 AND 45 AND l_returnflag IN ('A', 'N') AS valid FROM lineitem")
def rule_validation(spark, d):
    ok = R.valid_by_rules(F.col("l_quantity"), {"min": 1, "max": 45}) & R.valid_by_rules(F.col("l_returnflag"), {"min_length": 1, "allowed_values": ["A", "N"]}) & R.valid_by_rules(F.col("l_tax"), {})
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", ok.alias("valid"))
