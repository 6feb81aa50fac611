"""Limits as options, unknown facts, odd model output, hot conversations and index versions."""

import pytest
from pyspark.sql import functions as F

from hybridq.functions.strings import first_n
from hybridq.operators.catalog import page_listings, resolve_compare_ids
from hybridq.operators.conversations import positions, recent_history
from hybridq.operators.filters import passes_all, required_level
from hybridq.operators.grounding import answer_search
from hybridq.operators.traces import recent_traces
from hybridq.operators.understanding import criteria_struct, extract_keywords, parse_model_json
from hybridq.plans.joins import hot_products, spread_join
from hybridq.session import checkpoint_root
from hybridq.sources.index_store import index_read, index_write


def test_first_n(spark):
    row = spark.range(1).select(first_n(F.array(F.lit(1), F.lit(2)), None).alias("a"), first_n(F.array(F.lit(1), F.lit(2)), 1).alias("b")).head()
    assert row.a == [1, 2] and row.b == [1]


def test_keywords_beyond_the_eighth(spark):
    text = " ".join(f"topic{chr(97 + i)}x" for i in range(12))
    none = F.array().cast("array<string>")
    df = spark.createDataFrame([(text,)], "t string")
    words = lambda n: df.select(extract_keywords(F.col("t"), none, F.lit(None).cast("string"), n).alias("k")).head().k
    assert len(words(None)) == 12 and len(words(8)) == 8


def test_traces_and_pages(spark):
    traces = spark.range(120).select(F.col("id").alias("trace_id"), F.col("id").alias("at"))
    assert recent_traces(traces, 80).count() == 80
    assert recent_traces(traces, 80, capacity=50).count() == 50
    listings = spark.range(150).select("id", F.lit(None).cast("date").alias("posted_date"))
    assert page_listings(listings, 0, 140).count() == 140
    assert page_listings(listings, 0, 140, most=100).count() == 100


def test_compare_ids(spark):
    listings = spark.range(10)
    turns = spark.createDataFrame([(1, [1, 2, 3, 4, 5, 6], [], [], [7, 8])], "query_id long, job_ids array<long>, ordinals array<int>, selected_ids array<long>, shown_ids array<long>")
    assert len(resolve_compare_ids(turns, listings).head().ids) == 6
    assert len(resolve_compare_ids(turns, listings, most=4).head().ids) == 4


def test_model_output_with_lists_and_objects(spark):
    raws = [
        '{"location":["Lyon"],"standaloneQuery":["q"]}', '{"location":{"a":1},"standaloneQuery":{"q":1}}',
        '{"location":"Lyon","standaloneQuery":"q"}', '{"skills":[' + ",".join(f'"s{i}"' for i in range(30)) + "]}",
    ]
    df = spark.createDataFrame([(i, r, "said") for i, r in enumerate(raws)], "query_id long, raw string, text string")
    rows = {r.query_id: r for r in parse_model_json(df).collect()}
    assert [rows[i].criteria.location for i in range(3)] == [None, None, "Lyon"]
    assert [rows[i].standalone_query for i in range(3)] == ["said", "said", "q"]
    assert len(rows[3].criteria.keywords) == 30
    cut = parse_model_json(df, list_limit=20).where("query_id = 3").head()
    assert cut.error is None and len(cut.criteria.keywords) == 20


def test_unknown_facts_fail_what_is_asked(spark):
    facts = "remote boolean, location string, employment_type string, experience_min int, experience_max int, salary_min long, salary_max long"
    rows = spark.createDataFrame([(None,) * 7], facts)
    asks = {"remote": F.lit(True), "location": F.lit("x"), "employment_type": F.lit("FULL_TIME"), "experience_min": F.lit(1), "salary_max": F.lit(5).cast("long")}
    levels = {"remote": 5, "employment_type": 4, "location": 3, "experience_min": 2, "salary_max": 1}
    for name, value in asks.items():
        c = criteria_struct(**{name: value})
        row = rows.select(c.alias("criteria"), "*").select(passes_all(F.col("criteria")).alias("ok"), required_level(F.col("criteria")).alias("level")).head()
        assert row.ok is False and row.level == levels[name], name
    nothing = rows.select(criteria_struct().alias("criteria"), "*").select(passes_all(F.col("criteria")).alias("ok")).head()
    assert nothing.ok is True


def test_a_conversation_with_most_messages(spark):
    """Ids grow over all conversations; one holds nine tenths of the messages."""
    rows = spark.range(400).select(
        F.col("id").alias("message_id"), F.when(F.col("id") % 10 == 3, F.col("id") % 7 + 1).otherwise(0).alias("conv_id"),
        F.lit("USER").alias("role"), F.col("id").cast("string").alias("text"),
    )
    want, by = {}, {}
    for r in rows.orderBy("message_id").collect():
        by.setdefault(r.conv_id, []).append(r.message_id)
        want[r.message_id] = (len(by[r.conv_id]), [str(i) for i in by[r.conv_id][:-1][-5:]])
    for bucket in (4, 16, 1024):
        got = {r.message_id: r.position for r in positions(rows, bucket=bucket).collect()}
        assert got == {k: v[0] for k, v in want.items()}
        said = {r.message_id: [h.content for h in r.history] for r in recent_history(rows, 5, bucket=bucket).collect()}
        assert said == {k: v[1] for k, v in want.items()}


def test_both_sides_hot(spark):
    large = spark.range(300).select(F.lit("k").alias("key"), F.col("id").alias("a"))
    small = spark.range(40).select(F.lit("k").alias("key"), F.col("id").alias("b"))
    assert hot_products(large, small, ["key"], 1000).head().pieces == 12
    assert spread_join(large, small, ["key"], ["a"], target_rows=1000).distinct().count() == 12_000


def test_queries_without_result_are_answered(spark):
    queries = spark.range(1).select(F.col("id").alias("query_id"), criteria_struct(location=F.lit("Lyon")).alias("criteria"))
    facts = (
        "query_id long, rank int, id long, title string, company string, location string, remote boolean, salary_min long, salary_max long, currency string, "
        "experience_min int, experience_max int, reasons array<string>, total_matches long, dropped array<string>"
    )
    none = spark.createDataFrame([], facts).withColumn("criteria", criteria_struct())
    rows = answer_search(none, queries).collect()
    assert len(rows) == 1 and "couldn't find" in rows[0].answer


def test_a_written_version_stays(spark):
    path = f"{checkpoint_root(spark)}/versions-{spark.sparkContext.startTime}"
    index = spark.range(3).select(F.col("id").alias("document_id"), F.lit("A").alias("section"))
    manifest = spark.range(1).select(F.lit("local").alias("provider"))
    index_write(index, manifest, path, 1)
    with pytest.raises(ValueError):
        index_write(index, manifest, path, 1)
    index_write(index.limit(2), manifest, path, 2)
    assert index_read(spark, path)[0].count() == 2


def test_a_cluster_must_name_a_shared_folder(spark):
    class Conf:
        get = staticmethod(lambda key, default=None: default)

    class Context:
        master, applicationId = "spark://host:7077", "none"

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_root(Session)


def test_keyword_search_within_ids(spark, sf):
    """A list of all ids changes nothing; a list of some ids gives those only."""
    from hybridq.plans.search import hybrid_search
    from hybridq.workload.tables import listing_index, listings, query_log

    rows, index, queries = listings(spark, sf), listing_index(spark, sf), query_log(spark, sf)
    ids = [r.id for r in rows.select("id").collect()]
    found = {}
    for name, limit in (("none", None), ("all", ids), ("some", ids[::3])):
        asked = queries if limit is None else queries.withColumn("restrict_ids", F.array(*[F.lit(i).cast("long") for i in limit]))
        out = hybrid_search(asked, rows, index, n=None, pool=None, retrieval="keyword")
        found[name] = sorted((r.query_id, r.id, r["rank"], round(r.score, 9), r["mode"]) for r in out.collect())
    assert found["all"] == found["none"] and any(r[4] == "keyword" for r in found["all"])
    assert found["some"] and all(r[1] in ids[::3] for r in found["some"])
