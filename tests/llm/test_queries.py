"""The registered queries: contract columns, one row each, agreement with SQL where there is any."""

import glob
import os

import pytest

from tessera.llm import queries as Q

COLUMNS = {
    "op1_simhash_near_dedup": "doc_id bigint, fingerprint string, component_id bigint",
    "op2_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op3_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op4_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op5_html_extraction": "page_id bigint, url string, text string, n_chars bigint",
    "op6_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op7_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op8_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op9_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op10_token_shards": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract(spark, sf_small, name):
    df = Q.queries()[name](spark, sf_small)
    assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == COLUMNS[name]
    source = "pages" if name.startswith("op5") else "documents"
    rows = spark.read.parquet(f"{sf_small}/{source}.parquet").count()
    key = "page_id" if source == "pages" else "doc_id"
    assert df.select(key).distinct().count() == rows
    if not name.startswith("op9"):
        assert df.count() == rows


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_matches_sql(spark, sf_small, name):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{sf_small}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    result = con.execute(Q.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    got = Q.queries()[name](spark, sf_small).select(*columns).collect()
    assert sorted(tuple(r) for r in got) == sorted(result.fetchall())
