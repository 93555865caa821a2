"""Registered queries against their SQL on the smallest data set (all of them with ORACLE=all)."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = """
daily_usage session_listing usage_report effective_tier running_costs bm25_page tfidf_top_k hybrid_recall global_summaries
topic_summaries entity_merge conflict_groups gap_report snapshot_diff history_walk cooccurrence_edges budget_selection
openai_packs export_tree exchange_rows answer_agreement delivery_health
""".split()
NAMES = list(entry.oracle_sql()) if os.environ.get("ORACLE") == "all" else SAMPLE


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, con, sf, name):
    df = entry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(map(str, r)) for r in df.select(*columns).collect())
    cursor = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    at = [names.index(c) for c in columns]
    want = sorted(tuple(str(r[i]) for i in at) for r in cursor.fetchall())
    assert sorted(names) == columns and got == want


def test_every_query_is_registered_with_blueprint_ids():
    from threadloom.plans.registry import REGISTRY

    entry.queries()
    assert all(e.ids for e in REGISTRY.values())
    assert set(entry.oracle_sql()) <= set(entry.queries())
