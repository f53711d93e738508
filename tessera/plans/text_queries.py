"""Parsing, labels, addresses, ids and hashes over the tables' strings and numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import numbers as N
from tessera.functions import text as X
from tessera.plans.registry import query, table
from tessera.sources.documents import allowed_hosts

# One raw reading of each kind from an order: a valid one for most, an invalid one for some.
_RAW = {
    "percentage": "(o_orderkey % 120) || '%'",
    "large_integer": "' ' || (o_custkey * 977) || ',' || lpad((o_orderkey % 1000)::VARCHAR, 3, '0')",
    "duration": "(o_orderkey % 100) || ':' || lpad((o_custkey % 75)::VARCHAR, 2, '0')",
    "level": "'O' || (o_orderkey % 18)",
    "decimal": "(o_orderkey % 130) || ',' || (o_custkey % 10)",
    "battle_id_18": "'id 1' || lpad(o_orderkey::VARCHAR, 14, '0') || lpad((o_custkey % 1000)::VARCHAR, 2 + (o_custkey % 3)::INT, '0')",
    "result": "CASE o_orderstatus WHEN 'O' THEN 'Vic tory!' WHEN 'F' THEN 'de-feat' ELSE 'draw' END",
    "datetime": "year(o_orderdate) || '/' || (1 + o_orderkey % 14) || '/' || day(o_orderdate) || ' ' || (o_custkey % 24) || ':45'",
}
_SPARK_RAW = {k: v.replace("::VARCHAR", "").replace("::INT", "") for k, v in _RAW.items()}
_SPARK_RAW["large_integer"] = "concat(' ', o_custkey * 977, ',', lpad(cast(o_orderkey % 1000 as string), 3, '0'))"
_SPARK_RAW["duration"] = "concat(o_orderkey % 100, ':', lpad(cast(o_custkey % 75 as string), 2, '0'))"
_SPARK_RAW["battle_id_18"] = "concat('id 1', lpad(cast(o_orderkey as string), 14, '0'), lpad(cast(o_custkey % 1000 as string), cast(2 + o_custkey % 3 as int), '0'))"

_DIGITS = "regexp_replace(translate(replace(r, ',', ''), 'OoIlS', '00115'), '[^0-9]', '', 'g')"
_PARSE_SQL = (
    "WITH raw AS (" + " UNION ALL ".join(f"SELECT o_orderkey, '{k}' AS parser, trim({v}) AS r FROM orders" for k, v in _RAW.items()) + f"""),
n AS (SELECT *, {_DIGITS} AS g, regexp_replace(translate(replace(r, ',', '.'), 'OoIlS', '00115'), '[^0-9.]', '', 'g') AS f,
  regexp_replace(upper(r), '[^A-Z]', '', 'g') AS w FROM raw),
v AS (SELECT *, CASE parser
  WHEN 'percentage' THEN g::BIGINT BETWEEN 0 AND 100 WHEN 'large_integer' THEN g::HUGEINT <= 999999 WHEN 'level' THEN g::BIGINT BETWEEN 1 AND 15
  WHEN 'duration' THEN split_part(r, ':', 2) <= '59' WHEN 'decimal' THEN f::DOUBLE <= 100 WHEN 'battle_id_18' THEN length(g) = 18
  WHEN 'result' THEN w IN ('VICTORY', 'DEFEAT') ELSE try_strptime(r, '%Y/%m/%d %H:%M') IS NOT NULL END AS valid FROM n)
SELECT o_orderkey, parser, valid, CASE WHEN NOT valid THEN NULL
    WHEN parser IN ('percentage', 'large_integer', 'level') THEN g::HUGEINT::VARCHAR WHEN parser = 'duration' THEN lpad(split_part(r, ':', 1), 2, '0') || ':' || split_part(r, ':', 2)
    WHEN parser = 'decimal' THEN f WHEN parser = 'battle_id_18' THEN g WHEN parser = 'result' THEN w ELSE strftime(try_strptime(r, '%Y/%m/%d %H:%M'), '%Y-%m-%d %H:%M') END AS value_str,
  CASE WHEN valid THEN CASE WHEN parser IN ('percentage', 'large_integer', 'level') THEN g::DOUBLE WHEN parser = 'decimal' THEN f::DOUBLE END END AS value_num FROM v"""
)


@query("F2 F3 F25 F26", _PARSE_SQL)
def parse_semantic_fields(spark, d):
    pairs = F.array(*[F.struct(F.lit(k).alias("parser"), F.expr(v).cast("string").alias("raw")) for k, v in _SPARK_RAW.items()])
    rows = table(spark, d, "orders").select("o_orderkey", F.explode(pairs).alias("p")).select("o_orderkey", "p.parser", "p.raw")
    return X.parse_readings(rows, "raw", "parser").select("o_orderkey", "parser", "valid", "value_str", "value_num")


@query("F2", "SELECT c_custkey, regexp_replace(translate(replace(c_name || 'SIlO', ',', ''), 'OoIlS', '00115'), '[^0-9]', '', 'g') AS digits FROM customer")
def digit_repair(spark, d):
    return table(spark, d, "customer").select("c_custkey", X.numeric_text(F.concat("c_name", F.lit("SIlO"))).alias("digits"))


@query("F4 F5", "SELECT p_partkey, trim(regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9_]+', ' ', 'g')) AS label, trim(regexp_replace(lower(p_brand), '[^a-z0-9_\\s]', '', 'g')) AS name FROM part")
def label_normalize(spark, d):
    return table(spark, d, "part").select("p_partkey", X.normalize_label(F.concat("p_name", F.lit(" / "), "p_brand")).alias("label"), X.normalize_name(F.col("p_brand")).alias("name"))


@query("J3 J4", """
WITH l AS (SELECT p_partkey, lower(p_name) AS label FROM part UNION ALL SELECT p_partkey, trim(regexp_replace(lower(p_brand || ' ' || p_type), '[^a-z0-9_]+', ' ', 'g')) FROM part),
i AS (SELECT label, max(p_partkey) AS p_partkey, count(DISTINCT p_partkey) AS n_ids FROM l GROUP BY label)
SELECT i.label, i.n_ids, i.p_partkey, p.p_retailprice FROM i LEFT JOIN part p ON p.p_partkey = i.p_partkey""")
def label_lookup(spark, d):
    from tessera.operators.catalog import label_index

    p = table(spark, d, "part").withColumn("ord", F.col("p_partkey"))
    index = label_index(p, "p_partkey", F.col("p_name"), F.array(F.concat_ws(" ", "p_brand", "p_type")), X.normalize_label, "ord")
    return index.join(p.select("p_partkey", "p_retailprice"), "p_partkey", "left").select("label", "n_ids", "p_partkey", "p_retailprice")


_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1))"


@query("S9 F12", f"SELECT page_id, {_HOST} AS host, {_HOST} IN ('ththre.example.com', 'thther.example.org') AS allowed FROM pages")
def url_host_allowlist(spark, d):
    return allowed_hosts(table(spark, d, "pages"), "url", ["ththre.example.com", "thther.example.org"]).select("page_id", "host", "allowed")


@query("F12", "SELECT page_id, regexp_replace(split_part(split_part(url || CASE WHEN page_id % 3 = 0 THEN ';a=1/b;c' WHEN page_id % 3 = 1 THEN ';x?y;z/w' ELSE '' END, '#', 1), '?', 1), ';[^/]*$', '') AS redacted FROM pages")
def url_redact(spark, d):
    more = F.when(F.col("page_id") % 3 == 0, ";a=1/b;c").when(F.col("page_id") % 3 == 1, ";x?y;z/w").otherwise("")
    return table(spark, d, "pages").select("page_id", X.redact_url(F.concat("url", more)).alias("redacted"))


@query("F13", "SELECT p_partkey, 'https://wiki.example/api.php?action=query&format=json&titles=' || url_encode('File:' || p_name || ' é' || chr(39) || p_brand || '.png') AS address FROM part")
def page_titles(spark, d):
    title = F.concat(F.lit("File:"), "p_name", F.lit(" é'"), "p_brand", F.lit(".png"))
    return table(spark, d, "part").select("p_partkey", F.concat(F.lit("https://wiki.example/api.php?action=query&format=json&titles="), X.url_title(title)).alias("address"))


@query("F16", "SELECT p_partkey, translate(p_brand || ' ' || p_type || 'lI', 'OolISsBZ', '00115582') AS corrected FROM part")
def digit_corrections(spark, d):
    return table(spark, d, "part").select("p_partkey", X.corrected_digits(F.concat("p_brand", F.lit(" "), "p_type", F.lit("lI"))).alias("corrected"))


_SECRET = " OR ".join("regexp_matches(text, '" + p.replace("'", "''") + "')" for p in X.SECRET_PATTERNS)


@query("F14", f"SELECT source, count(*) AS documents, count(*) FILTER ({_SECRET}) AS with_secret FROM documents GROUP BY source")
def secret_scan(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("documents"), F.count_if(X.holds_secret(F.col("text"))).alias("with_secret"))


@query("F19 F21 S5", """SELECT conv_id, turn, sha256(text) AS digest, CASE WHEN text <> '' THEN sha256(strlen(role)::VARCHAR || ':' || role || strlen(text)::VARCHAR || ':' || text) END AS content_key,
  CASE WHEN text <> '' THEN sha256(encode('roles') || unhex('00') || unhex('0004') || encode('role') || unhex(lpad(hex(strlen(role)), 16, '0')) || unhex(sha256(role)) || unhex('0004') || encode('text') || unhex(lpad(hex(strlen(text)), 16, '0')) || unhex(sha256(text))) END AS framed_key FROM conversations""")
def hash_content_key(spark, d):
    role, text = F.col("role"), F.col("text")
    return table(spark, d, "conversations").select("conv_id", "turn", F.sha2("text", 256).alias("digest"), X.content_key(role, text).alias("content_key"), X.framed_key("roles", role=role, text=text).alias("framed_key"))


@query("F17", "SELECT l_orderkey, l_partkey, l_linenumber, 'line:' || l_returnflag || ':' || CASE WHEN l_linenumber = 1 THEN '' ELSE l_linenumber::VARCHAR END AS record_id, 'part_' || lpad(l_partkey::VARCHAR, greatest(4, length(l_partkey::VARCHAR))::INT, '0') AS numbered_id FROM lineitem")
def record_ids(spark, d):
    line = F.when(F.col("l_linenumber") != 1, F.col("l_linenumber"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", X.record_id(F.lit("line"), F.col("l_returnflag"), line).alias("record_id"), X.numbered_id("part", F.col("l_partkey")).alias("numbered_id"))


@query("F20", """WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'hero' ELSE 'item' END AS kind, c_mktsegment AS adapter, CASE WHEN c_custkey % 3 = 0 THEN 'id:' || (c_custkey // 4) ELSE 'x-' || (c_custkey // 5) END AS identity, CASE WHEN c_custkey % 7 = 0 THEN ' Empty slot' ELSE c_name END AS name FROM customer),
b AS (SELECT *, CASE WHEN kind = 'hero' AND c_custkey % 3 = 0 THEN 'hero_' || lpad((c_custkey // 4)::VARCHAR, greatest(4, length((c_custkey // 4)::VARCHAR))::INT, '0') WHEN kind = 'item' AND c_custkey % 7 = 0 THEN 'item_empty_slot'
  ELSE kind || '_' || substr(sha1(unhex('d8141574300b48fd9676a18202f8cd68') || encode(kind || ':' || adapter || ':' || identity)), 1, 12) END AS base FROM c),
n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY c_custkey) AS k FROM b) SELECT c_custkey, base || CASE WHEN k > 1 THEN '_' || k ELSE '' END AS stable_id FROM n""")
def stable_ids(spark, d):
    from tessera.operators.catalog import assign_ids

    key = F.col("c_custkey")
    c = table(spark, d, "customer").select("c_custkey", F.when(key % 2 == 0, "hero").otherwise("item").alias("kind"), F.col("c_mktsegment").alias("adapter"), F.when(key % 3 == 0, F.concat(F.lit("id:"), F.floor(key / 4))).otherwise(F.concat(F.lit("x-"), F.floor(key / 5))).alias("identity"), F.when(key % 7 == 0, " Empty slot").otherwise(F.col("c_name")).alias("name"))
    return assign_ids(c, ["c_custkey"]).select("c_custkey", "stable_id")


@query("F6", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'x' WHEN 1 THEN p_type WHEN 2 THEN p_brand ELSE p_name END AS value FROM part")
def reviewed_values(spark, d):
    """The first kind of correction wins over the second, whichever comes last."""
    k = F.col("p_partkey") % 4
    said = F.when(k == 0, F.concat("p_name", F.lit(" (its y) (human proof: its x) (should be "), "p_brand", F.lit(")"))).when(k == 1, F.concat("p_type", F.lit(" [sic]"))).when(k == 2, F.concat("p_name", F.lit(" (should be "), "p_brand", F.lit(".)"))).otherwise(F.concat("p_name", F.lit(" (unsure)")))
    return table(spark, d, "part").select("p_partkey", X.reviewed_value(said).alias("value"))


@query("F7", """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'total_gold' WHEN 1 THEN 'total_gold_percent' WHEN 2 THEN 'rating' WHEN 3 THEN 'player_name' ELSE 'kills' END AS field, CASE o_orderkey % 5 WHEN 2 THEN 'float' WHEN 3 THEN 'str' WHEN 4 THEN CASE WHEN o_custkey % 2 = 0 THEN 'int' ELSE 'invalid' END ELSE 'int' END AS value_type,
  CASE WHEN o_orderkey % 5 = 3 THEN o_orderpriority END AS value_str, CASE o_orderkey % 5 WHEN 0 THEN (o_custkey || '000')::DOUBLE WHEN 1 THEN (o_custkey % 101)::DOUBLE WHEN 2 THEN (o_custkey % 160) / 10.0 WHEN 4 THEN CASE WHEN o_custkey % 2 = 0 THEN (o_custkey % 30)::DOUBLE END END AS value_num FROM orders""")
def typed_fields(spark, d):
    k, c = F.col("o_orderkey") % 5, F.col("o_custkey")
    field = F.when(k == 0, "gold").when(k == 1, "total_gold_percent").when(k == 2, "rating").when(k == 3, "name").otherwise("kills")
    text = F.when(k == 0, F.concat(c, F.lit(" 000"))).when(k == 1, F.concat(c % 101, F.lit("% "))).when(k == 2, (c % 160 / 10).cast("string")).when(k == 3, F.col("o_orderpriority")).otherwise(F.concat(c % 30, F.when(c % 2 == 0, "").otherwise("?")))
    return table(spark, d, "orders").select("o_orderkey", X.typed_field(field, text).alias("v")).select("o_orderkey", "v.*")


@query("F9", "SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 4 WHEN 0 THEN CASE WHEN l_returnflag = 'R' THEN 'true' ELSE 'false' END WHEN 1 THEN l_partkey::VARCHAR WHEN 2 THEN l_returnflag ELSE '<UNKNOWN_OR_EMPTY>' END AS written FROM lineitem")
def export_values(spark, d):
    k = F.col("l_linenumber") % 4
    kind = F.when(k == 0, "bool").when(k == 1, "int").when(k == 2, "str").otherwise("none")
    number = F.when(k == 0, (F.col("l_returnflag") == "R").cast("double")).otherwise(F.col("l_partkey").cast("double"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", X.export_text(kind, F.col("l_returnflag"), number).alias("written"))


_SIX = "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'level' ELSE 'other' END AS parser, CASE WHEN c_custkey % 2 = 0 THEN (c_custkey % 20)::VARCHAR ELSE '-' END AS r FROM customer"


@query("P26", f"""SELECT c_custkey, CASE WHEN parser IS NULL THEN 'unsupported' WHEN parser = 'other' OR (r <> '-' AND r::INT BETWEEN 1 AND 15) THEN 'ok' ELSE 'unknown' END AS status, CASE WHEN parser IS NULL THEN 'semantic field has no OCR parser' WHEN parser = 'other' OR (r <> '-' AND r::INT BETWEEN 1 AND 15) THEN '' WHEN r = '-' THEN 'integer_invalid' ELSE 'integer_out_of_range' END AS messages FROM ({_SIX})""")
def unsupported_fields(spark, d):
    from tessera.operators.voting import reading_status

    key = F.col("c_custkey")
    rows = table(spark, d, "customer").select("c_custkey", F.when(key % 3 == 1, "level").when(key % 3 == 2, "other").alias("parser"), F.when(key % 2 == 0, (key % 20).cast("string")).otherwise("-").alias("raw"))
    parsed = X.parse_readings(rows, "raw", "parser")
    return parsed.select("c_custkey", reading_status(F.col("parser"), F.col("valid")).alias("status"), F.array_join("messages", ",").alias("messages"))


@query("X29", """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 AND o_custkey % 3 < 2 THEN (CASE o_custkey % 3 WHEN 0 THEN o_custkey % 15 + 1 ELSE o_custkey % 9 + 1 END)::VARCHAR END AS suggested_value FROM orders""")
def suggested_values(spark, d):
    """Of readings without a value, the first candidate that its parser takes: the raw text, then the evidence."""
    from tessera.operators.voting import suggested

    c = F.col("o_custkey")
    raw = F.when(c % 3 == 0, (c % 15 + 1).cast("string")).otherwise("x")
    others = F.when(c % 3 == 1, F.array(F.lit("99"), F.lit(None).cast("string"), (c % 9 + 1).cast("string"), F.lit("7"))).otherwise(F.array(F.lit("0"), F.lit("-")))
    rows = table(spark, d, "orders").select("o_orderkey", F.lit("level").alias("parser"), F.when(F.col("o_orderkey") % 2 == 1, "5").alias("value"), raw.alias("raw"), others.alias("candidates"))
    return suggested(rows, ["o_orderkey"], "value", "raw", "candidates", "parser").select("o_orderkey", "suggested_value")


@query("F8", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN 'none' ELSE 'float' END AS value_type, NULL::VARCHAR AS value_str, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE o_totalprice END AS value_num FROM orders")
def typed_edits(spark, d):
    raw = F.when(F.col("o_orderkey") % 4 == 3, "None").otherwise(F.concat(F.lit(" "), F.format_string("%.2f", "o_totalprice")))
    return table(spark, d, "orders").select("o_orderkey", X.typed_edit(raw, F.lit("float")).alias("v")).select("o_orderkey", "v.*")


@query("F10 F11", """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'hero' WHEN 1 THEN 'item' END AS kind, CASE WHEN p_partkey % 3 = 0 THEN p_partkey::INT END AS number,
  CASE p_partkey % 3 WHEN 0 THEN upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] || ' ' || upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] WHEN 1 THEN p_name END AS title, replace(p_name, ' ', '_') || '-o' AS file FROM part""")
def file_identities(spark, d):
    k = F.col("p_partkey") % 3
    hero = F.concat(F.lit("hero_"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"), F.lit("_"), F.translate("p_name", " ", "_"), F.lit(".png"))
    name = F.when(k == 0, hero).when(k == 1, F.concat(F.lit("item_"), "p_name", F.lit(".png"))).otherwise(F.concat("p_name", F.lit(".png")))
    return table(spark, d, "part").select("p_partkey", X.filename_identity(name).alias("i"), X.safe_filename(F.concat(F.upper("p_name"), F.lit("-'<o>"))).alias("file")).select("p_partkey", "i.*", "file")


@query("F15 A30", "SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN q BETWEEN 41 AND 45 THEN q - 30 ELSE q END AS level, CASE WHEN r < 10 THEN r WHEN r / 10 <= 20 THEN r / 10 END AS rating FROM (SELECT *, l_quantity::INT AS q, round(l_quantity * 3)::DOUBLE AS r FROM lineitem)")
def legacy_repairs(spark, d):
    q = F.col("l_quantity").cast("int")
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", X.level_repair(q.cast("string")).alias("level"), X.rating_repair(F.round(F.col("l_quantity") * 3).cast("long").cast("string")).alias("rating"))


@query("F27 F28 F23", """
WITH h AS (SELECT vec_id, list_transform(embedding[1:32], lambda x: x::DOUBLE) AS a, list_transform(embedding[33:64], lambda x: x::DOUBLE) AS b FROM embeddings),
c AS (SELECT vec_id, list_transform(a, lambda x: x - list_avg(a)) AS a, list_transform(b, lambda x: x - list_avg(b)) AS b FROM h)
SELECT vec_id, round((list_inner_product(a, b) / sqrt(list_inner_product(a, a) * list_inner_product(b, b)) + 1) / 2, 6) AS correlation, round(sqrt(list_inner_product(a, a)), 6) AS spread, bit_count(xor(vec_id, 2863311530))::INTEGER AS bits FROM c""")
def vector_correlation(spark, d):
    a, b = F.slice("embedding", 1, 32), F.slice("embedding", 33, 32)
    ca = F.transform(a, lambda x: x.cast("double"))
    mean = F.aggregate(ca, F.lit(0.0), lambda s, x: s + x) / 32
    flat = N.standardized(a)
    spread = N.dot(F.transform(ca, lambda x: x - mean), flat)  # the norm that standardising divides by
    return table(spark, d, "embeddings").select("vec_id", F.round(N.mapped_correlation(a, b), 6).alias("correlation"), F.round(spread, 6).alias("spread"), N.hamming64(F.col("vec_id"), F.lit(2863311530)).cast("int").alias("bits"))
