"""Findings of round 4: whole jobs, and joins whose copies stay few."""

import collections

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from check_oracle import compare
from pyspark.sql import functions as F
from test_whole_pairs import TABLES

import __spark_entry__ as entry
from hybridq.operators import scoring as S
from hybridq.operators.filters import _listing_cells, listing_words
from hybridq.operators.understanding import criteria_struct
from hybridq.plans.joins import hot_products, spread_join
from hybridq.plans.matching import Filters


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    for name, columns in TABLES.items():
        pq.write_table(pa.table(columns), f"{at}/{name}.parquet")
    return str(at)


# F32
def test_all_chunks_of_all_listings_are_ranked(spark, folder):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    name = "retrieve_within"
    ok, info = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], folder)
    assert ok, info
    rows = entry.queries()[name](spark, folder).collect()
    assert {r.query_id for r in rows} == set(TABLES["part"]["p_partkey"])
    assert all(sum(r.query_id == i for r in rows) > 1 for i in range(15))


# F1, F2, F3, F20, F21
def test_hot_keys_are_cut_on_both_sides(spark):
    large = spark.range(600).select(F.when(F.col("id") < 500, "hot").otherwise("cold").alias("key"), (F.col("id") % 250).alias("a"))
    small = spark.range(400).select(F.when(F.col("id") < 300, "hot").when(F.col("id") < 390, "none").otherwise("cold").alias("key"), F.col("id").alias("b"))
    cuts = {r.key: r for r in hot_products(large, small, ["key"], 1500).collect()}
    assert set(cuts) == {"hot"} and cuts["hot"].across * cuts["hot"].down >= 100
    # every row once a piece of the other side would make 100 copies of each of the 300 rows
    assert 500 * cuts["hot"].down + 300 * cuts["hot"].across < 300 * 100 / 3
    want = collections.Counter((r.key, r.a, r.b) for r in large.join(small, "key").collect())
    for tasks in (None, 3):
        for extra in (None, F.col("b") % 3 == F.col("a") % 3):
            met = spread_join(large, small, ["key"], ["a"], target_rows=1500, extra=extra, tasks=tasks)
            got = collections.Counter((r.key, r.a, r.b) for r in met.collect())
            assert got == (want if extra is None else collections.Counter({k: n for k, n in want.items() if k[1] % 3 == k[2] % 3}))


# F1, F20
def test_no_listing_cells_are_made_that_no_query_looks_into(spark):
    listing = spark.createDataFrame([(1, "Pune", True, "FULL_TIME", 2, 9, 5, 9)], "id long, location string, remote boolean, employment_type string, experience_min int, experience_max int, salary_min long, salary_max long")
    asked = spark.createDataFrame([([(False, -2, -2)],)], "_asked_cells array<struct<here:boolean,_remote:int,_years:int>>")
    assert [(r._place, r._remote, r._years) for r in _listing_cells(listing, asked).collect()] == [("", -2, -2)]


# F14
def test_explanations_take_texts_that_are_kept(spark):
    pair = spark.createDataFrame(
        [(["Java", "x"], "Pune, India", True, "FULL_TIME", 2, 5, 900_000, 1_500_000, "INR")],
        "skills array<string>, location string, remote boolean, employment_type string, experience_min int, experience_max int, salary_min long, salary_max long, currency string",
    )
    asks = dict(
        skills=F.array(F.lit("JAVA"), F.lit("go")), location=F.lit("pune"), remote=F.lit(False), experience_min=F.lit(6), experience_max=F.lit(9),
        salary_min=F.lit(1_000_000), salary_max=F.lit(2_000_000), employment_type=F.lit("FULL_TIME"),
    )
    rows = pair.withColumn("criteria", criteria_struct(**asks))
    k, none = F.col("criteria"), (F.lit(None).cast("double"), F.lit(None).cast("array<string>"))
    plain = rows.select(*S.match_explanations(k, *none)).head()
    made = {**S.offered_texts(), **S.asked_texts(k), **{n: make(k) for n, make in S.PAIR_FACTS.items()}}
    kept = rows.withColumns({f"_{n}": value for n, value in made.items()})
    assert tuple(kept.select(*S.match_explanations(k, *none, texts={n: F.col(f"_{n}") for n in made})).head()) == tuple(plain)
    assert len(plain[0]) == 4 and len(plain[1]) == 3
    assert kept.select(S.skill_score(k, F.array(F.lit("go"), F.lit("java")))).head()[0] == 1.0


# F6
def test_words_of_a_listing_come_from_its_text_once(spark):
    rows = [(1, "Data data"), (1, "cloud"), (2, ""), (None, "data")]
    none = F.array().cast("array<string>")
    catalogue = spark.createDataFrame(rows, "id long, title string").select("id", "title", none.alias("skills"), F.lit(None).cast("string").alias("description"), none.alias("requirements"), none.alias("responsibilities"))
    words = listing_words(catalogue)
    assert "MapInArrow" in words._jdf.queryExecution().executedPlan().toString()
    assert sorted((str(r.id), str(r.word)) for r in words.collect()) == [("1", "cloud"), ("1", "data"), ("2", "None"), ("None", "data")]


# F7, F29
def test_a_scan_compares_each_asked_value_once():
    def table(**columns):
        kinds = {"employment_type": pa.string(), "place": pa.string(), "asked": pa.list_(pa.string())}
        return pa.table({n: pa.array(v, kinds.get(n, pa.float64())) for n, v in columns.items()})

    n = 8
    q = table(
        salary_min=[None, 5, 5, None, 5, 5, None, 9], salary_max=[None, None, None, 7, None, None, None, 9], experience_min=[1, 1, None, None, 1, 1, 3, 3],
        experience_max=[None, 2, 2, None, 2, 2, 3, 3], remote=[1, 0, None, None, 0, 1, 0, None], employment_type=["a", None, "a", "b", None, "c", None, "a"],
        place=["p", "p", None, "x", "p", "x", None, "p"],
    )
    x = table(
        salary_min=[1, 6, None, 8], salary_max=[4, 7, 9, None], experience_min=[0, 2, None, 3], experience_max=[1, 4, 2, 3], remote=[1, 0, None, 0],
        employment_type=["a", "b", None, "a"], asked=[["p", "x"], ["x"], None, ["p"]],
    )
    filters = Filters()
    state = filters.prepare(q)
    assert len(state["pay"][0][0]) == 4 and len(state["home"][0][0]) == 3 and state["type"].by.n_rows == 3 and state["where"].by.n_rows == 2
    asked, offered = q.to_pylist(), x.to_pylist()
    ok = lambda a, holds: a is None or bool(holds)
    least = lambda a, b: a is not None and b is not None and a <= b

    def level(a, o):
        fails = [
            not (ok(a["salary_min"], least(a["salary_min"], o["salary_max"])) and ok(a["salary_max"], least(o["salary_min"], a["salary_max"]))),
            not (ok(a["experience_max"], least(o["experience_min"], a["experience_max"])) and ok(a["experience_min"], least(a["experience_min"], o["experience_max"]))),
            not (a["remote"] == 1 or ok(a["place"], a["place"] in (o["asked"] or []))),
            not ok(a["employment_type"], a["employment_type"] == o["employment_type"]),
            not ok(a["remote"], a["remote"] == o["remote"]),
        ]
        return max((i for i, failed in enumerate(fails, 1) if failed), default=0)

    assert filters.levels(state, x).tolist() == [[level(a, o) for o in offered] for a in asked]
    rows, cols = np.divmod(np.arange(n * 4), 4)
    assert filters.fits_place(state, x, rows, cols).tolist() == [a["place"] is not None and a["place"] in (o["asked"] or []) for a in asked for o in offered]
