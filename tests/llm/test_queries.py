"""The registered queries on small tables: contract columns, oracle SQL, reruns."""

import pytest

from tests.conftest import SF_SMALL
from tools.oracle_check import compare, duck
from wattline.llm.oracle import ORACLE
from wattline.llm.queries import QUERIES

COLUMNS = {
    "op1_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op2_warc_archive": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"},
    "op3_weighted_mix": {"doc_id", "size", "source_size", "target", "taken"},
    "op4_html_layout": {"page_id", "text"},
    "op5_srs_neighbours": {"query_id", "rank", "vec_id", "score"},
    "op6_setsketch_dedup": {"doc_id", "n_shingles", "component_id", "kept"},
    "op7_vector_packing": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
    "op8_pii_surrogates": {"doc_id", "text"},
    "op9_language_id": {"doc_id", "held_out", "lang_pred", "score"},
    "op12_periodic_runs": {"doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"},
    "op13_secret_scan": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
    "op11_filter_audit": {"part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"},
    "op10_lcp_fingerprints": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
}


def test_one_query_for_each_operator():
    assert set(QUERIES) == set(COLUMNS)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    assert COLUMNS[name] <= set(df.columns)
    n = df.count()
    whole = {"op2": "pages", "op4": "pages", "op5": None, "op7": None, "op11": None}.get(name.split("_")[0], "documents")
    if whole:
        assert n == spark.read.parquet(f"{SF_SMALL}/{whole}.parquet").count()
    assert n > 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, name):
    assert compare(QUERIES[name](spark, SF_SMALL).toPandas(), duck(SF_SMALL).execute(ORACLE[name]).df()) == []
