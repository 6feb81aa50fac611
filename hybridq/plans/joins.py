"""Equi-joins that survive hot keys.

`spread_join` counts the keys of both sides once (map-side combined), finds those whose
product is above `target_rows`, and cuts each of them into a grid: the rows of one side into
`across` parts, those of the other into `down` parts, so that every part of one meets every part of
the other.  With sides in proportion, n pieces cost about sqrt(n) copies of a row, not n.  Cold keys are left
alone.  The hot-key table has a row for each hot key; Spark broadcasts it if it measures small enough.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, MapType, StructType, VariantType

TARGET_ROWS = 1_000_000
#: Where tasks are asked for: pieces a task, and rows of a piece at least.
PIECES = 2
LEAST_ROWS = 100_000


def hot_keys(large: DataFrame, keys: list[str], target_rows: int = TARGET_ROWS) -> DataFrame:
    """keys + `pieces` for every key holding more than `target_rows` rows."""
    return (
        large.groupBy(*keys)
        .count()
        .where(F.col("count") > target_rows)
        .select(*keys, F.ceil(F.col("count") / F.lit(target_rows)).cast("int").alias("pieces"))
    )


def hot_products(large: DataFrame, small: DataFrame, keys: list[str], target_rows: int = TARGET_ROWS, tasks: int | None = None) -> DataFrame:
    """keys + `pieces` for every key whose rows, or joined rows, exceed `target_rows`: either side may be the hot one.

    `pieces` cuts the large side only; `across` and `down` cut both sides into as many products, with the fewest copies.
    Where the joined rows of all keys are few for so many `tasks`, less than `target_rows` counts as hot."""
    ours = large.groupBy(*keys).agg(F.count("*").alias("_large"))
    theirs = small.groupBy(*keys).agg(F.count("*").alias("_small"))
    rows, others = F.col("_large"), F.greatest(F.coalesce("_small", F.lit(1)), F.lit(1))
    made = rows * others
    counted, target = ours.join(theirs, keys, "left"), F.lit(target_rows)
    if tasks:
        all_made = counted.where(F.col("_small").isNotNull()).agg(F.coalesce(F.sum(made), F.lit(0)).alias("_made"))
        share = F.floor(F.col("_made") / F.lit(PIECES * tasks)).cast("long")
        target = F.least(target, F.greatest(F.lit(min(LEAST_ROWS, target_rows)), share))
        counted = counted.join(F.broadcast(all_made))  # one row
    wanted = F.ceil(made / target)
    hot = (
        counted.where(made > target)
        .withColumn("across", F.least(F.greatest(F.round(F.sqrt(wanted * rows / others)), F.lit(1.0)), rows).cast("int"))
    )
    return hot.select(
        *keys, F.least(wanted, rows).cast("int").alias("pieces"), "across", F.least(F.ceil(wanted / F.col("across")), others).cast("int").alias("down")
    )


def all_tasks(df: DataFrame) -> int:
    """Three times as many tasks as a shuffle has, so that a few heavy pieces don't hold up the rest."""
    return 3 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _atomic(df: DataFrame, but: list[str]) -> list[str]:
    """Columns with one plain value a row."""
    return [f.name for f in df.schema if f.name not in but and not isinstance(f.dataType, (ArrayType, MapType, StructType, VariantType))]


def spread_join(
    large: DataFrame,
    small: DataFrame,
    keys: list[str],
    spread_by: list[str],
    how: str = "inner",
    target_rows: int = TARGET_ROWS,
    extra=None,
    tasks: int | None = None,
) -> DataFrame:
    """large JOIN small ON keys (AND extra), hot keys cut: `large` by hash of `spread_by`, `small` by hash of its plain columns.

    `how` is seen from `large`: inner, left, left_semi or left_anti; only an inner join cuts `small`, too, as the others
    need all matches of a row in one place.  `extra` is an additional Column condition over the two sides.  `tasks` is for joins
    that make far more rows than they read: it deals them to so many tasks, which Spark would else choose by the bytes read."""
    hot = hot_products(large, small, keys, target_rows, tasks)
    plain = _atomic(small, keys)
    both = how == "inner" and bool(plain)
    across = F.coalesce(F.col("across" if both else "pieces"), F.lit(1))
    down = F.coalesce(F.col("down"), F.lit(1)) if both else F.lit(1)
    helpers = ["pieces", "across", "down"]
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    part = lambda names, n: F.pmod(F.xxhash64(*names), n).cast("int")
    cut = large.join(hot, keys, "left").withColumn("_piece", part(spread_by, across))
    copies = small.join(hot, keys, "left").withColumn("_piece", each(across))
    if both:
        cut, copies = cut.withColumn("_part", each(down)), copies.withColumn("_part", part(plain, down))
    cut, copies = cut.drop(*helpers), copies.drop(*helpers)
    on = [*keys, "_piece", *(["_part"] if both else [])]
    if tasks:
        cut, copies = cut.repartition(tasks, *on), copies.repartition(tasks, *on)
    if extra is None:
        return cut.join(copies, on, how).drop("_piece", "_part")
    right = copies
    for name in on:
        right = right.withColumnRenamed(name, f"_r_{name}")
    condition = extra
    for name in on:
        condition = (F.col(name) == F.col(f"_r_{name}")) & condition
    joined = cut.join(right, condition, how).drop("_piece", "_part")
    return joined.drop(*[f"_r_{n}" for n in on])
