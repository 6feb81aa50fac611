"""A page directory: listings in ranges of their order, with counts before each, so that any page reads its own ranges only."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

RANGE_ROWS = 100_000


def pages_write(listings: DataFrame, path: str, range_rows: int = RANGE_ROWS) -> None:
    """Store listings newest first, then by id, in ranges of about `range_rows` rows; the directory is written last.

    One shuffle by range.  The directory has one row a range; its running count is the only step in one task.
    Rows equal in date and id stay in one range.  `listings` is read three times (counted, sampled, written)."""
    spark = listings.sparkSession
    order = [F.col("posted_date").desc_nulls_last(), F.col("id")]
    ranges = max(1, -(-listings.count() // range_rows))
    (
        listings.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id())
        .sortWithinPartitions("range", *order)
        .write.mode("overwrite").partitionBy("range").parquet(f"{path}/rows")
    )
    written = StructType([*listings.schema.fields, StructField("range", IntegerType())])
    counts = spark.read.schema(written).parquet(f"{path}/rows").groupBy("range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spark.range(1).select(F.lit(listings.schema.json()).alias("columns")).coalesce(1).write.mode("overwrite").parquet(
        f"{path}/columns"
    )
    counts.select("range", "n", before.alias("before")).write.mode("overwrite").parquet(f"{path}/directory")


def page_read(spark: SparkSession, path: str, page: int, size: int, most: int | None = None) -> DataFrame:
    """One page with the total number of rows and pages, like `page_listings`, from the ranges it touches.

    `most` bounds the page size, if given.  A page after the last one, or of an empty catalogue, has no rows."""
    size = max(size, 1) if most is None else min(max(size, 1), most)
    low = max(page, 0) * size
    directory = spark.read.parquet(f"{path}/directory")
    total = directory.agg(F.sum("n")).first()[0] or 0
    touched = directory.where((F.col("before") < low + size) & (F.col("before") + F.col("n") > low)).orderBy("range").collect()
    schema = StructType.fromJson(json.loads(spark.read.parquet(f"{path}/columns").first().columns))
    if touched:
        folders = [f"{path}/rows/range={r.range}" for r in touched]
        rows = spark.read.schema(schema).parquet(*folders)
        rows = rows.orderBy(F.col("posted_date").desc_nulls_last(), "id").offset(low - touched[0].before).limit(size)
    else:
        rows = spark.createDataFrame([], schema)
    return rows.withColumns(
        {"total_rows": F.lit(total).cast("bigint"), "total_pages": F.lit(-(-total // size)).cast("bigint")}
    )
