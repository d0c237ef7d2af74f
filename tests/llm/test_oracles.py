"""The corpus queries that SQL can express, against DuckDB; and what every query's contract says about its columns."""

import pytest
from conftest import SMALL, same_as_duckdb

from tessera.llm import registry

COLUMNS = {
    "op1_": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op3_": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op5_": {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string", "formatted_chars": "bigint"},
    "op6_": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op8_": {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"},
    "op9_": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    "op10_": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_duckdb(spark, duck, name):
    same_as_duckdb(registry.queries()[name](spark, SMALL), duck, registry.oracle_sql()[name])


@pytest.mark.parametrize("start", sorted(COLUMNS))
def test_columns(spark, start):
    name = next(q for q in registry.queries() if q.startswith(start))
    assert COLUMNS[start].items() <= dict(registry.queries()[name](spark, SMALL).dtypes).items()


def test_ten_queries():
    assert sorted(int(q[2:].split("_")[0]) for q in registry.queries()) == list(range(1, 11))
