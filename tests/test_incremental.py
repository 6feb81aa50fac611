"""Stored catalogues, indexes and pages that change: only what changed is written, and the result is that of a full build."""

import pytest
from pyspark.sql import functions as F

from hybridq.operators.catalog import page_listings
from hybridq.operators.embedding import index_build, index_status
from hybridq.plans.refresh import refresh_index
from hybridq.plans.stages import stage_path
from hybridq.sources.catalogue_store import catalogue_read, catalogue_sync, catalogue_write
from hybridq.sources.index_store import index_compact, index_documents, index_manifests, index_read, index_versions
from hybridq.sources.page_store import page_read, pages_write
from hybridq.streaming.streams import run_available, stream_feedback
from hybridq.workload.tables import listings


def files(df):
    return sorted(df.inputFiles())


def content(df):
    return sorted(repr(r) for r in df.collect())


def entries(index):
    return sorted((r.document_id, r.section, r.text, tuple(r.idx), tuple(r.val)) for r in index.select("document_id", "section", "text", "idx", "val").collect())


@pytest.fixture(scope="module")
def rows(spark, sf):
    return listings(spark, sf)


def test_sync_writes_changed_partitions_only(spark, rows):
    path = stage_path(spark, "catalogue")
    catalogue_write(rows, path, parts=16)
    before = files(catalogue_read(spark, path))
    assert catalogue_sync(rows, path).isEmpty()
    assert files(catalogue_read(spark, path)) == before
    first = rows.agg(F.min("id")).first()[0]
    changed = rows.withColumn("title", F.when(F.col("id") == first, "other").otherwise(F.col("title")))
    report = catalogue_sync(changed, path).collect()
    assert [(r.change_type, r.id) for r in report] == [("update", first)]
    after = files(catalogue_read(spark, path))
    folder = lambda fs: {f.rpartition("/")[0] for f in fs}
    assert len(folder(set(after) - set(before))) == 1 and len(folder(set(before) - set(after))) == 1
    assert content(catalogue_read(spark, path)) == content(changed.select(*catalogue_read(spark, path).columns))


def test_sync_empties_and_fills_partitions(spark, rows):
    path = stage_path(spark, "catalogue")
    catalogue_write(rows, path, parts=8)
    few = rows.orderBy("id").limit(2)
    report = {(r.change_type, r["count"]) for r in catalogue_sync(few, path).groupBy("change_type").count().collect()}
    assert report == {("delete", rows.count() - 2)}
    assert content(catalogue_read(spark, path)) == content(few)
    none = rows.limit(0)
    assert catalogue_sync(none, path).count() == 2 and catalogue_read(spark, path).isEmpty()
    assert catalogue_sync(rows, path).where("change_type = 'insert'").count() == rows.count()
    assert content(catalogue_read(spark, path)) == content(rows)
    with pytest.raises(ValueError):
        catalogue_write(rows, path)


def test_refresh_embeds_what_changed(spark, rows):
    path, built = stage_path(spark, "index"), []

    def build(df):
        built.append(df.count())
        return index_build(df)

    n = rows.count()
    step = lambda df, provider="local": refresh_index(df, path, provider, "m", "2024-03-25", build)
    assert step(rows) == {"keep": 0, "rebuild": n, "drop": 0}
    assert step(rows) == {"keep": n, "rebuild": 0, "drop": 0} and index_versions(spark, path) == [1]
    ids = sorted(r.id for r in rows.select("id").collect())
    few = max(1, n // 100)
    later = rows.where(~F.col("id").isin(ids[-2:])).withColumn(
        "description", F.when(F.col("id").isin(ids[:few]), "A shorter text.").otherwise(F.col("description"))
    )
    assert step(later) == {"keep": n - 2 - few, "rebuild": few, "drop": 2}
    assert built == [n, few] and index_versions(spark, path) == [2, 1]
    assert entries(index_read(spark, path)[0]) == entries(index_build(later))
    # a dropped listing comes back, a changed one changes again
    assert step(rows) == {"keep": n - 2 - few, "rebuild": 2 + few, "drop": 0}
    index, manifest = index_read(spark, path)
    assert entries(index) == entries(index_build(rows)) and index_versions(spark, path) == [3, 2, 1]
    status = index_status(index, manifest).first()
    assert status.indexed and status.job_count == n and manifest.first().chunk_count == index.count()
    assert index_documents(spark, path).count() == n
    assert index_compact(spark, path) == 4 and index_versions(spark, path) == [4]
    assert entries(index_read(spark, path)[0]) == entries(index_build(rows))
    assert index_compact(spark, path) == 4
    assert step(rows, "remote")["rebuild"] == n
    assert step(rows.limit(0), "remote")["drop"] == n and index_read(spark, path)[0].isEmpty()
    assert index_manifests(spark, path).count() == 6


def test_refresh_of_an_empty_catalogue(spark, rows):
    path = stage_path(spark, "index")
    assert refresh_index(rows.limit(0), path, "local", "m", "2024-03-25") == {"keep": 0, "rebuild": 0, "drop": 0}
    assert refresh_index(rows, path, "local", "m", "2024-03-25")["rebuild"] == rows.count()
    assert entries(index_read(spark, path)[0]) == entries(index_build(rows))


def test_a_deep_page_reads_one_range(spark):
    n, size = 60_000, 7
    rows = spark.range(n).select(
        F.when(F.col("id") % 10 != 3, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 5).cast("int"))).alias("posted_date"),
        (F.col("id") * 7919 % n).alias("id"), F.col("id").cast("string").alias("title"),
    )
    path = stage_path(spark, "pages")
    pages_write(rows, path, range_rows=2000)
    assert spark.read.parquet(f"{path}/directory").count() > 20
    for page in (0, 1000, -(-n // size) - 1):
        got = page_read(spark, path, page, size)
        assert [r.asDict() for r in got.orderBy(F.col("posted_date").desc_nulls_last(), "id").collect()] == [
            r.asDict() for r in page_listings(rows, page, size).orderBy(F.col("posted_date").desc_nulls_last(), "id").collect()
        ]
    assert len({f.rpartition("/")[0] for f in page_read(spark, path, 1000, size).inputFiles()}) <= 2
    assert page_read(spark, path, 10**6, size).isEmpty() and page_read(spark, path, 0, 500, most=50).count() == 50


def test_pages_of_an_empty_catalogue(spark, rows):
    path = stage_path(spark, "pages")
    pages_write(rows.limit(0), path)
    assert page_read(spark, path, 0, 10).isEmpty()


def replayed(spark, path, schema, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).withColumn("_b", F.lit(i)).coalesce(1).write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema(f"{schema}, _b int").option("maxFilesPerTrigger", 1).parquet(f"{path}/in").drop("_b")


def test_late_rows_are_counted(spark):
    import datetime as dt

    at = lambda minute: dt.datetime(2024, 1, 1, 12, 0) + dt.timedelta(minutes=minute)
    path = stage_path(spark, "late")
    # a watermark takes effect on late rows one batch after it was reached
    rows = [
        [(1, 10, at(0), "up")], [(2, 10, at(90), "down")], [(5, 13, at(91), "up")], [(3, 11, at(1), "up"), (4, 12, at(92), "up")],
    ]
    stream = replayed(spark, path, "event_id long, message_id long, ts timestamp, rating string", rows)
    report = run_available(stream_feedback(stream, "10 minutes"), lambda df, i: df.count(), f"{path}/check", "update")
    assert report.complete and report.rows == 5 and report.late_rows == 1
    again = run_available(stream_feedback(stream, "10 minutes"), lambda df, i: df.count(), f"{path}/check", "update")
    assert again.complete and again.rows == 0 and again.late_rows == 0
