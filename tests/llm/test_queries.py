"""Every query of the subpackage through the driver's entry, on the smallest tables."""

import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_token_output": {"doc_id", "start", "n_tokens", "ids_crc32"},
    "op2_packing": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
    "op3_bpe_codec": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op4_media_webp": {"doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"},
    "op5_ngram_jaccard": {"doc_id", "n_shingles", "component_id"},
    "op6_toxicity": {"doc_id", "severity", "grade"},
    "op8_personal_data": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
    "op10_language_id": {"doc_id", "held_out", "lang_pred", "score"},
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_covers_all_documents(spark, name):
    docs = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    got = __spark_entry__.queries()[name](spark, SF)
    assert COLUMNS[name] <= set(got.columns)
    assert {r.doc_id for r in got.select("doc_id").collect()} == docs
