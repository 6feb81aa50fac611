"""A stored catalogue in hash partitions; a sync rewrites only the partitions that changed."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructType

from hybridq.plans.stages import delete_folder, materialise
from hybridq.sources.listings import row_fingerprints, sync_listings

PARTS = 256


def _part(parts: int):
    return F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")


def _write_parts(rows: DataFrame, path: str, parts: int) -> None:
    """Replace the partitions that have rows here, and only those."""
    rows.withColumn("part", _part(parts)).repartition("part").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("part").parquet(f"{path}/rows")


def _layout(spark: SparkSession, path: str):
    try:
        return spark.read.parquet(f"{path}/layout").head()
    except AnalysisException:
        return None


def catalogue_write(listings: DataFrame, path: str, parts: int = PARTS) -> None:
    """Store a catalogue under a new path: its rows by hash of id, then how they lie."""
    spark = listings.sparkSession
    if _layout(spark, path) is not None:
        raise ValueError(f"{path} holds a catalogue; use catalogue_sync")
    _write_parts(listings, path, parts)
    layout = spark.range(1).select(F.lit(parts).alias("parts"), F.lit(listings.schema.json()).alias("columns"))
    layout.coalesce(1).write.mode("overwrite").parquet(f"{path}/layout")


def _stored(spark: SparkSession, path: str, layout) -> DataFrame:
    schema = StructType.fromJson(json.loads(layout["columns"])).add("part", IntegerType())
    return spark.read.schema(schema).parquet(f"{path}/rows")


def catalogue_read(spark: SparkSession, path: str) -> DataFrame:
    layout = _layout(spark, path)
    if layout is None:
        raise ValueError(f"{path} holds no catalogue")
    return _stored(spark, path, layout).drop("part")


def part_fingerprints(listings: DataFrame, parts: int) -> DataFrame:
    """(part, n_rows, sums): a hash of each partition's multiset of rows.  One row a partition is shuffled by a task."""
    words = [
        F.sum(F.conv(F.substring("row_hash", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).cast("string")
        for i in range(4)
    ]
    hashed = row_fingerprints(listings).withColumn("part", _part(parts))
    return hashed.groupBy("part").agg(F.count("*").alias("n_rows"), F.concat_ws(":", *words).alias("sums"))


def catalogue_sync(incoming: DataFrame, path: str) -> DataFrame:
    """Make the stored catalogue equal `incoming`; returns (change_type, id) of inserted, updated and deleted listings.

    Partitions are compared by hash first: equal ones are neither joined nor written, so a sync without a
    change writes no file of the catalogue.  Of the others the rows are compared and the partitions replaced; a partition
    that lost all rows is deleted.  The number of partitions bounds what the driver sees.  `incoming` has
    the columns of the catalogue and unique ids, and lies elsewhere; it is read more than once.  A job that failed half-way
    has replaced whole partitions only, and the same sync again replaces the rest."""
    spark = incoming.sparkSession
    layout = _layout(spark, path)
    if layout is None:
        raise ValueError(f"{path} holds no catalogue")
    stored = _stored(spark, path, layout)
    incoming = incoming.select(*[c for c in stored.columns if c != "part"])
    parts = layout["parts"]
    now = part_fingerprints(stored.drop("part"), parts)
    new = part_fingerprints(incoming, parts)
    both = now.select("part", F.struct("n_rows", "sums").alias("a")).join(
        new.select("part", F.struct("n_rows", "sums").alias("b")), "part", "full_outer"
    )
    changed = both.where(~F.equal_null("a", "b")).select("part", F.col("b").isNull().alias("emptied")).collect()
    touched = [r.part for r in changed]
    fresh = incoming.where(_part(parts).isin(touched))
    report = sync_listings(stored.where(F.col("part").isin(touched)).drop("part"), fresh)
    # a stage, because the rows it compares with are about to be replaced
    report = materialise(report.where(F.col("change_type") != "unchanged").select("change_type", "id"), "changes")
    if any(not r.emptied for r in changed):
        _write_parts(fresh, path, parts)
    for r in changed:
        if r.emptied:
            delete_folder(spark, f"{path}/rows/part={r.part}")
    return report
