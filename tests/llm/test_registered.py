"""The registered queries: against DuckDB where SQL can express them, and the columns that they must return."""

import pytest
from conftest import DATA

from lamina.llm.oracles import ORACLE_SQL
from lamina.llm.queries import QUERIES

COLUMNS = {
    "op2_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op3_language": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op4_quality": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op5_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op6_secrets": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op7_ogg": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op8_tokens": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op9_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op10_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_same_rows(spark, same_as_duckdb, name, sf):
    same_as_duckdb(QUERIES[name](spark, f"{DATA}/{sf}"), ORACLE_SQL[name], f"{DATA}/{sf}")


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name):
    df = QUERIES[name](spark, f"{DATA}/sf0.001")
    assert ", ".join(" ".join(c) for c in df.dtypes).startswith(COLUMNS[name])
    assert df.count() == spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").count()
