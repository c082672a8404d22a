"""Each query over the smallest tables against its SQL or its contract's columns."""

import pathlib

import pytest
from primeweft.llm import queries as q

DIR = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_shards": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
    "op2_quality": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op3_jaccard": {"doc_id", "n_shingles", "component_id"},
    "op4_substrings": {"doc_id", "n_words", "n_removed", "kept_sha256"},
    "op5_warc": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"},
    "op6_packing": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
    "op7_brown": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op8_byte_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op9_chunks": {"doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"},
    "op10_url_templates": {"page_id", "host", "path", "rule", "verdict"},
    "op11_winnowing": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
    "op12_collocations": {"lang", "rank", "phrase", "a", "l", "r", "n", "score"},
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name):
    got = q.queries()[name](spark, DIR)
    assert COLUMNS[name] <= set(got.columns)
    table = "pages" if name in ("op5_warc", "op10_url_templates") else "documents"
    n = spark.read.parquet(f"{DIR}/{table}.parquet").count()
    assert got.count() >= n if name == "op6_packing" else got.count() > 0 if name == "op12_collocations" else got.count() == n


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_against_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for p in pathlib.Path(DIR).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = q.queries()[name](spark, DIR)
    want = c.execute(f"SELECT {', '.join(got.columns)} FROM ({q.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.collect())
