"""Queries run on the smallest table with the columns of their contracts; SQL agrees where there is some."""

import duckdb
import pytest

from reviewlake.llm import catalog, oracle

SF = "/root/testdata/sf0.001"
CONTRACT = {
    "op1": ["vec_id", "n_links", "component_id", "kept"], "op2": ["doc_id", "size", "source_size", "target", "taken"],
    "op3": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op4": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op5": ["doc_id", "held_out", "lang_pred", "score"], "op6": ["doc_id", "held_out", "score", "predicted"],
    "op7": ["page_id", "url", "text", "n_chars"], "op8": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op9": ["doc_id", "digest", "license_id", "notices"], "op10": ["doc_id", "fingerprint", "component_id"],
    "op11": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op12": ["word", "form", "root", "n", "n_near", "form_n"],
    "op13": ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
}


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, name):
    found = catalog.queries()[name](spark, SF)
    columns = CONTRACT[name.split("_")[0]]
    assert found.columns[: len(columns)] == columns
    rows = found.collect()
    assert rows
    if sql := oracle.oracle_sql().get(name):
        with duckdb.connect() as db:
            db.sql(f"create view documents as select * from '{SF}/documents.parquet'")
            expected = db.sql(sql).fetchall()
        assert sorted(map(tuple, rows)) == sorted(expected) or {tuple(map(str, r)) for r in rows} == {tuple(map(str, r)) for r in expected}
