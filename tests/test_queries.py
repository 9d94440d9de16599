"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from ledgerspark.queries import views
from tests.oracle import compare, tables

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return tables(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, con, name):
    assert compare(QUERIES[name](spark, sf), con, SQL[name]) == []


RECORD_QUERIES = [
    "scan_ndjson", "load_ndjson", "expand_txns", "min_history", "sequence_meta", "time_delta_user", "last_n_txns", "delta_hours", "last_amount",
    "position_ids", "encode_txn", "pad_history", "frequency_encode", "tok_timedelta", "preprocess_ndjson", "ndjson_tokens", "to_corpus_with_meta",
    "generate_corpus_ndjson", "sft_samples", "stream_tokens", "sink_sidecar", "lookup_user_label",
]


@pytest.mark.parametrize("name", RECORD_QUERIES)
def test_histories_in_parts_give_the_same_result(spark, sf, con, monkeypatch, name):
    monkeypatch.setattr(views, "RECORD_TXNS", 30)
    assert compare(QUERIES[name](spark, sf), con, SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_returns_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 3
