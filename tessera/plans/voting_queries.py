"""Votes and consensus: a line's (order, line number) is the key, its return flag a reading."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import voting as V
from tessera.plans.registry import query, table

_ROWS = "r AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_discount * 10 AS conf, l_partkey, l_suppkey, l_extendedprice, l_quantity FROM lineitem)"
_KEY = ["l_orderkey", "l_linenumber"]
_ORD = ["l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]


def _rows(spark, d):
    return table(spark, d, "lineitem").select(*_KEY, "l_returnflag", (F.col("l_discount") * 10).alias("conf"), *_ORD)


_GROUPS = "g AS (SELECT l_orderkey, l_linenumber, l_returnflag, count(*) AS readings, max(conf) AS best FROM r GROUP BY ALL), v AS (SELECT *, greatest(0.0, least(1.0, best + 0.05 * (readings - 1))) AS vote FROM g)"


@query("A26 X15 X16", f"WITH {_ROWS}, {_GROUPS}, k AS (SELECT *, row_number() OVER w AS rn, vote - lead(vote) OVER w AS gap FROM v WINDOW w AS (PARTITION BY l_orderkey, l_linenumber ORDER BY vote DESC, l_returnflag)) SELECT l_orderkey, l_linenumber, l_returnflag, readings, round(vote, 6) AS vote, coalesce(l_linenumber = 1 AND gap < 0.025, false) AS conflict FROM k WHERE rn = 1")
def vote_ocr_groups(spark, d):
    out = V.reading_votes(_rows(spark, d), _KEY, "l_returnflag", "conf", _ORD)
    parser = F.when(F.col("l_linenumber") == 1, "player_name").otherwise("level")
    return out.select(*_KEY, "l_returnflag", "readings", F.round("vote", 6).alias("vote"), V.conflict(parser, F.col("gap")).alias("conflict"))


_CONSENSUS = "c AS (SELECT l_orderkey, l_linenumber, l_returnflag, support, round(bc, 6) AS best_confidence, total FROM (SELECT l_orderkey, l_linenumber, l_returnflag, count(*) AS support, max(conf) AS bc, sum(count(*)) OVER (PARTITION BY l_orderkey, l_linenumber)::BIGINT AS total, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY count(*) DESC, max(conf) DESC, l_returnflag) AS rn FROM r GROUP BY l_orderkey, l_linenumber, l_returnflag) WHERE rn = 1 AND support >= 2)"


def _agreed(spark, d):
    return V.consensus(_rows(spark, d).withColumn("ord", F.struct(*_ORD)), _KEY, ["l_returnflag"], "conf", "ord")


@query("A24", f"WITH {_ROWS}, {_CONSENSUS} SELECT * FROM c")
def consensus_reconcile(spark, d):
    return _agreed(spark, d).select(*_KEY, "l_returnflag", "support", F.round("best_confidence", 6).alias("best_confidence"), "total")


@query("A25 J17 C3", f"WITH {_ROWS}, {_CONSENSUS} SELECT r.l_orderkey, r.l_linenumber, r.l_partkey, r.l_returnflag, coalesce(c.l_returnflag, r.l_returnflag) AS final_value, CASE WHEN c.support IS NOT NULL THEN 'batch_consensus:' || c.support || '/' || c.total END AS message FROM r LEFT JOIN c ON r.l_orderkey = c.l_orderkey AND r.l_linenumber = c.l_linenumber")
def consensus_apply(spark, d):
    out = V.apply_consensus(_rows(spark, d), _agreed(spark, d), _KEY, "l_returnflag")
    return out.select(*_KEY, "l_partkey", "l_returnflag", "final_value", "message")


@query("A28", f"WITH {_ROWS}, g AS (SELECT l_orderkey, l_returnflag, count(*) AS votes, min((l_partkey, l_suppkey, l_extendedprice, l_quantity, l_linenumber)) AS f FROM r GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY votes DESC, f) AS rn, sum(votes) OVER (PARTITION BY l_orderkey)::BIGINT AS total FROM g) SELECT l_orderkey, l_returnflag, votes, total FROM k WHERE rn = 1")
def vote_majority_first_tie(spark, d):
    return V.majority_first(_rows(spark, d), ["l_orderkey"], "l_returnflag", [*_ORD, "l_linenumber"])


_ID = "rpad(l_partkey::VARCHAR, (15 + l_linenumber % 6)::INT, '7')"


@query("A29", f"""WITH r AS (SELECT *, {_ID} AS digits FROM lineitem),
e AS (SELECT l_orderkey, arg_min(digits, (-votes, f)) AS e FROM (SELECT l_orderkey, digits, count(*) AS votes, min((l_partkey, l_suppkey, l_extendedprice, l_quantity, l_linenumber)) AS f FROM r WHERE length(digits) = 18 GROUP BY ALL) GROUP BY l_orderkey),
n AS (SELECT l_orderkey, arg_min(digits, (l_partkey, l_suppkey, l_extendedprice, l_quantity, l_linenumber)) AS n FROM r WHERE length(digits) BETWEEN 15 AND 20 GROUP BY l_orderkey)
SELECT k.l_orderkey, coalesce(e, n[1:18]) AS digits FROM (SELECT DISTINCT l_orderkey FROM r) k LEFT JOIN e USING (l_orderkey) LEFT JOIN n USING (l_orderkey)""")
def vote_identifier(spark, d):
    rows = _rows(spark, d).withColumn("digits", F.rpad(F.col("l_partkey").cast("string"), (15 + F.col("l_linenumber") % 6).cast("int"), F.lit("7")))
    return V.identifier_vote(rows, ["l_orderkey"], "digits", [*_ORD, "l_linenumber"])


@query("A30", """WITH g AS (SELECT l_orderkey, (l_quantity % 16)::INT AS level, count(*) AS n FROM lineitem GROUP BY ALL),
a AS (SELECT l_orderkey, arg_min(level, (-n, level)) FILTER (level BETWEEN 6 AND 9 AND n >= 3) AS single, coalesce(sum(n) FILTER (level BETWEEN 0 AND 5), 0) AS low, coalesce(sum(n) FILTER (level >= 10), 0) AS dbl,
  arg_min(level, (-n, level)) FILTER (level >= 10) AS best_dbl, arg_min(level, (-n, level)) FILTER (n >= 3) AS agreed, max(level) AS top FROM g GROUP BY l_orderkey)
SELECT l_orderkey, coalesce(single, CASE WHEN dbl > 0 AND dbl >= 0.3 * low THEN best_dbl END, agreed, top) AS level FROM a""")
def vote_level(spark, d):
    return V.level_vote(table(spark, d, "lineitem").select("l_orderkey", (F.col("l_quantity") % 16).cast("int").alias("level")), ["l_orderkey"], "level")


@query("A31", "SELECT l_suppkey, arg_min(t, (-length(t), l_orderkey, l_linenumber, l_partkey)) AS t FROM (SELECT *, l_quantity::INT::VARCHAR AS t FROM lineitem) GROUP BY l_suppkey")
def vote_longest(spark, d):
    rows = table(spark, d, "lineitem").withColumn("t", F.col("l_quantity").cast("int").cast("string"))
    return V.longest_first(rows, ["l_suppkey"], "t", ["l_orderkey", "l_linenumber", "l_partkey"])


@query("X14", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_discount DESC, l_partkey, l_orderkey, l_linenumber, l_extendedprice) AS k FROM lineitem),
a AS (SELECT l_suppkey, min(k) FILTER (l_discount = 0.03) AS pos FROM r GROUP BY l_suppkey)
SELECT r.l_suppkey, r.l_orderkey, r.l_linenumber, r.l_partkey, least(k, 8) AS place FROM r JOIN a USING (l_suppkey) WHERE k < 8 OR (k = 8 AND (pos <= 8 OR pos IS NULL)) OR (k = pos AND pos > 8)""")
def vote_evidence(spark, d):
    out = V.evidence(table(spark, d, "lineitem"), ["l_suppkey"], "l_discount", ["l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice"], F.col("l_discount") == 0.03)
    return out.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", F.col("place").cast("long").alias("place"))


@query("A27 A46", "SELECT l_orderkey, round(sum(greatest(1, l_linenumber - 1) * l_discount) / sum(greatest(1, l_linenumber - 1)) + 1e-9, 6) AS confidence, round(avg(l_tax) FILTER (l_tax >= 0.02) / 100, 8) AS mean_confidence FROM lineitem GROUP BY l_orderkey")
def vote_joined_confidence(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(V.weighted_confidence(F.col("l_linenumber") - 1, F.col("l_discount")) + 1e-9, 6).alias("confidence"), F.round(F.avg(F.when(F.col("l_tax") >= 0.02, F.col("l_tax"))) / 100, 8).alias("mean_confidence"))


@query("P24", """WITH r AS (SELECT *, CASE WHEN l_linenumber > 4 THEN 'right80-x' ELSE 'native' END AS variant, l_discount > 0.02 AS ok FROM lineitem),
a AS (SELECT *, max(CASE WHEN variant LIKE 'right80-%' AND ok AND l_linestatus = 'O' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey, l_linestatus) AS routed FROM r)
SELECT l_orderkey, l_linenumber, l_partkey, variant FROM a WHERE routed = 0 OR (variant LIKE 'right80-%' AND ok AND l_linestatus = 'O')""")
def vote_right_edge(spark, d):
    r = table(spark, d, "lineitem").withColumn("variant", F.when(F.col("l_linenumber") > 4, "right80-x").otherwise("native"))
    return V.right_edge_only(r, ["l_orderkey", "l_linestatus"], F.col("l_linestatus"), F.col("variant"), F.col("l_discount") > 0.02, "O").select("l_orderkey", "l_linenumber", "l_partkey", "variant")


@query("P25", """SELECT l_orderkey, 'unknown' AS status, arg_min(l_returnflag, (l_linenumber, l_partkey, l_suppkey)) AS raw,
  CASE WHEN count(DISTINCT l_shipmode) = 0 THEN 'no_local_ocr_candidate' ELSE string_agg(DISTINCT l_shipmode, ',' ORDER BY l_shipmode) END AS messages
FROM (SELECT *, CASE WHEN l_tax > 0.04 THEN 'tax_' || l_linestatus END AS l_shipmode FROM lineitem) GROUP BY l_orderkey HAVING NOT bool_or(l_discount > 0.03)""")
def vote_unread(spark, d):
    r = table(spark, d, "lineitem").withColumn("m", F.when(F.col("l_tax") > 0.04, F.array(F.concat(F.lit("tax_"), "l_linestatus"))).otherwise(F.array().cast("array<string>"))).withColumn("ord", F.struct("l_linenumber", "l_partkey", "l_suppkey"))
    out = V.unread(r, ["l_orderkey"], F.col("l_discount") > 0.03, "l_returnflag", "ord", "m")
    return out.select("l_orderkey", "status", "raw", F.concat_ws(",", "messages").alias("messages"))
