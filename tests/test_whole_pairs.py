"""Predicates, gates and scores look at every pair of a query and a listing, not at the delivered ones."""

import __spark_entry__ as entry
import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from check_oracle import compare

TABLES = {
    "region": {"r_regionkey": [0], "r_name": ["ASIA"]},
    "nation": {"n_nationkey": [0, 1], "n_name": ["INDIA", "CHINA"], "n_regionkey": [0, 0]},
    "supplier": {"s_suppkey": list(range(12)), "s_nationkey": [i % 2 for i in range(12)]},
    "part": {
        "p_partkey": list(range(15)),
        "p_name": [["green ledger", "blue data", "red ledger"][i % 3] for i in range(15)],
        "p_brand": [f"Brand#{i % 4}" for i in range(15)],
        "p_type": [["PROMO", "SMALL", "ECONOMY", "LARGE"][i % 4] for i in range(15)],
        "p_size": [1 + 7 * i % 50 for i in range(15)],
    },
    "documents": {"doc_id": [0, 1, 2], "text": ["We ship data every day.", "", None]},
    "lineitem": {"l_suppkey": [1], "l_partkey": [1]},  # a single pair was delivered
}
QUERIES = [
    "pred_remote",
    "pred_location",
    "pred_salary_overlap",
    "pred_experience_overlap",
    "pred_employment_type",
    "topic_gate_skills",
    "topic_gate_keywords",
    "skill_score",
    "experience_fit",
    "location_fit",
    "remote_fit",
    "salary_fit",
    "weighted_score",
    "match_label",
    "match_explanations",
    "rank_results",
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    for name, columns in TABLES.items():
        pq.write_table(pa.table(columns), f"{at}/{name}.parquet")
    return str(at)


@pytest.mark.parametrize("name", QUERIES)
def test_all_pairs_are_seen(spark, folder, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    sql = entry.oracle_sql()[name]
    ok, info = compare(spark, con, name, entry.queries()[name], sql, folder)
    assert ok, info
    assert "delivered" not in sql
    assert con.execute(f"select count(*) from ({sql})").fetchone()[0] > 10
