"""The registered queries of the corpus operators: thin views over ``tessera.llm``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table
from tessera.llm.decontaminate import contamination
from tessera.llm.exact_dedup import exact_groups
from tessera.llm.html_extract import extract_text
from tessera.llm.langid import identify
from tessera.llm.packing import pack_documents
from tessera.llm.quality import score_quality
from tessera.llm.sharding import feistel_shards, round_keys
from tessera.llm.simhash import near_groups
from tessera.llm.sstable import encode_to_shards
from tessera.llm.toxicity import toxicity


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0..7 by the law `rows`."""
    out = feistel_shards(table(spark, sf_dir, "documents"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages")).drop("n_restored")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op10_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_to_shards(table(spark, sf_dir, "documents"))


QUERIES = (op1_simhash_near_dedup, op2_language_id, op3_decontamination, op4_sharding, op5_html_extraction, op6_exact_dedup, op7_quality, op8_toxicity, op9_best_fit_packing, op10_token_shards)

#: Equal texts by normalised text. DuckDB's regular expressions spell the same class.
_OP6 = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g USING (t)"""

#: Windows as lists of words, joined by equality; hit words as distinct places.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_OP3 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, w[s:s + 12] AS p FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(p) AS n FROM bw),
dw AS (SELECT doc_id, s, n, w[s:s + n - 1] AS p FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, s, n, item_id FROM dw JOIN bw USING (p)),
marks AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + n)) FROM hit) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN marks ON marks.doc_id = d.doc_id LEFT JOIN found ON found.doc_id = d.doc_id"""



def _feistel_sql(source: str, seed: int = 20) -> str:
    """One pass of the permutation over rows (r, n, b, x) of source, 128-bit products cut to 64 bits."""
    two = "18446744073709551616::UHUGEINT"
    sql = f"SELECT r, n, b, x >> b AS l, x & ((1::UBIGINT << b) - 1) AS q FROM {source}"
    for key in round_keys(seed):
        mixed = f"(((q::UHUGEINT + {key}::UHUGEINT) % {two}) * 18397679294719823053::UHUGEINT % {two})::UBIGINT"
        sql = f"SELECT r, n, b, l, q, {mixed} AS m FROM ({sql})"
        sql = f"SELECT r, n, b, l, q, (xor(m, m >> 33)::UHUGEINT * 14181476777654086739::UHUGEINT % {two})::UBIGINT AS m FROM ({sql})"
        sql = f"SELECT r, n, b, q AS l, xor(l, xor(m, m >> 29)) & ((1::UBIGINT << b) - 1) AS q FROM ({sql})"
    return f"SELECT r, n, b, (l << b) | q AS x FROM ({sql})"


#: Rows numbered by doc_id, size and checksum (CRC-32 bit by bit), walked through the
#: permutation until they fall inside, and dealt by arithmetic.
_OP4 = f"""
WITH RECURSIVE t AS (SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents),
c AS (SELECT doc_id, octet_length(raw) + 1 AS size, xor(list_reduce(list_transform(range(1, octet_length(raw) + 1), lambda i: ('0x' || hex(raw[i:i]))::UBIGINT),
  lambda a, y: xor(a >> 8, list_reduce(range(0, 8), lambda p, k: xor(p >> 1, 3988292384::UBIGINT * (p & 1)), xor(a, y) & 255)), 4294967295::UBIGINT), 4294967295::UBIGINT)::BIGINT AS text_crc32 FROM t),
o AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS r FROM c),
z AS (SELECT count(*) AS n, (SELECT min(k) FROM range(1, 32) g(k) WHERE 4::HUGEINT ** k >= (SELECT count(*) FROM documents)) AS b FROM documents),
h AS (SELECT r, n, b::UBIGINT AS b, r::UBIGINT AS x FROM o, z),
w AS ({_feistel_sql("h")} UNION ALL {_feistel_sql("(SELECT * FROM w WHERE x >= n)")})
SELECT doc_id, size, text_crc32, 'rows' AS law, (x % 8)::INT AS shard, (x // 8)::BIGINT AS slot, NULL::INT AS grown_shard FROM o JOIN w ON w.r = o.r AND w.x < w.n"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op3_decontamination": _OP3, "op4_sharding": _OP4, "op6_exact_dedup": _OP6}
