"""Registered queries against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from quillfold import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ("clean_text", "tag_register", "incremental_split", "sentence_stats", "majority_vote", "retrieve_facts", "screen_eligibility", "emit_top", "outlinks", "fold_applications", "adjudicate", "resolve_checkpoints")


def test_every_oracle_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
    assert len(catalog.queries()) > 120


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_against_duckdb(spark, name):
    import check_oracle

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = catalog.queries()[name](spark, SF)
    rel = con.sql(catalog.oracle_sql()[name])
    assert check_oracle.rows_of(df.columns, df.collect()) == check_oracle.rows_of(rel.columns, rel.fetchall())
