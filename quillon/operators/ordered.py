"""Order-dependent columns over groups of any size.

A window function sorts a whole group in one task. Where a group is too large for that, rows are range-partitioned
by (group, order), so that a group is spread over parts; lags and running counts are taken within a part and
carried over from the parts before, of which a group has few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.session import settle_table, shuffle_width

#: Rows of a group up to which one task sorts it; rows in a part beyond.
GROUP_ROWS = 1_000_000


def largest_group(rows: DataFrame, group: list[str]) -> int:
    """The size of the largest group; counted with a partial aggregate."""
    return rows.groupBy(*group).agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]


def in_parts(rows: DataFrame, group: list[str], order: list[str], part_rows: int | None = None) -> DataFrame:
    """The rows in range partitions of (group, order), with their part in ``__part``. The order must be total within
    a group for stable results."""
    part_rows = part_rows or GROUP_ROWS
    parts = max(shuffle_width(rows.sparkSession), -(-rows.count() // part_rows))
    return settle_table(rows.repartitionByRange(parts, *group, *order).withColumn("__part", F.spark_partition_id()), "parts")


def with_lags(parts: DataFrame, group: list[str], order: list[str], columns: dict[str, str]) -> DataFrame:
    """Adds, for each new name, the value that the column has in the row before within the group. The row before
    the first of a part is the last of the group's part before."""
    local = Window.partitionBy("__part", *group).orderBy(*order)
    last = parts.groupBy("__part", *group).agg(F.max_by(F.struct(*columns.values()), F.struct(*order)).alias("__last"))
    before = last.select("__part", *group, F.lag("__last").over(Window.partitionBy(*group).orderBy("__part")).alias("__before"))
    marked = parts.withColumn("__first", F.row_number().over(local) == 1)
    for name, c in columns.items():
        marked = marked.withColumn(name, F.lag(c).over(local))
    joined = marked.join(before, ["__part", *group])
    for name, c in columns.items():
        joined = joined.withColumn(name, F.when(F.col("__first"), F.col(f"__before.{c}")).otherwise(F.col(name)))
    return joined.drop("__first", "__before")


def with_running_sum(parts: DataFrame, group: list[str], order: list[str], value: Column, to: str) -> DataFrame:
    """Adds the sum of ``value`` over the rows of the group up to this one."""
    local = Window.partitionBy("__part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    valued = parts.withColumn("__value", value)
    along = Window.partitionBy(*group).orderBy("__part")
    sums = valued.groupBy("__part", *group).agg(F.sum("__value").alias("__sum"))
    before = sums.select("__part", *group, (F.sum("__sum").over(along) - F.col("__sum")).alias("__carried"))
    summed = valued.withColumn(to, F.sum("__value").over(local)).join(before, ["__part", *group])
    return summed.withColumn(to, F.col(to) + F.col("__carried")).drop("__value", "__carried")


def with_rank(rows: DataFrame, group: list[str], order: list[str], to: str) -> DataFrame:
    """Adds the row's place in its group from 1, in ascending order, nulls first. A group too large for one task is
    spread over several."""
    if largest_group(rows, group) <= GROUP_ROWS:
        return rows.withColumn(to, F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long"))
    return with_running_sum(in_parts(rows, group, order), group, order, F.lit(1), to).drop("__part").withColumn(to, F.col(to).cast("long"))


def with_neighbours(rows: DataFrame, group: list[str], order: list[str], left: Column, right: Column, before: str, after: str) -> DataFrame:
    """Adds the greatest ``left`` among the rows of the group up to this one and the least ``right`` among those from it
    on, nulls left out; with values that rise along the order these are the nearest ones. A group of any size is
    handled in parts; the parts' own extremes are carried over."""
    parts = in_parts(rows, group, order).withColumn("__lv", left).withColumn("__rv", right)
    local = Window.partitionBy("__part", *group).orderBy(*order)
    along = Window.partitionBy(*group).orderBy("__part")  # a group has few parts
    ends = parts.groupBy("__part", *group).agg(F.max("__lv").alias("__max"), F.min("__rv").alias("__min"))
    carried = ends.select("__part", *group, F.max("__max").over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("__left"), F.min("__min").over(along.rowsBetween(1, Window.unboundedFollowing)).alias("__right"))
    # A frame that runs to the end is gone through anew for every row; the rows backwards have a growing one.
    back = Window.partitionBy("__part", *group).orderBy(F.desc("__at"))
    near = parts.withColumn("__own_max", F.max("__lv").over(local.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__at", F.row_number().over(local))
    near = near.withColumn("__own_min", F.min("__rv").over(back.rowsBetween(Window.unboundedPreceding, 0))).join(carried, ["__part", *group])
    near = near.withColumn(before, F.coalesce("__own_max", "__left")).withColumn(after, F.coalesce("__own_min", "__right"))
    return near.drop("__part", "__lv", "__rv", "__own_max", "__own_min", "__at", "__left", "__right")


def with_number(rows: DataFrame, order: list[str], to: str, part_rows: int | None = None) -> DataFrame:
    """Adds consecutive numbers from 1 in the given order, without sorting all rows in one task."""
    parts = in_parts(rows, [], order, part_rows)
    counts = sorted((r["__part"], r["n"]) for r in parts.groupBy("__part").agg(F.count("*").alias("n")).collect())  # one row per part
    total, offsets = 0, []
    for part, n in counts:
        offsets.append((part, total))
        total += n
    before = F.broadcast(rows.sparkSession.createDataFrame(offsets, "__part int, __carried long"))  # one row per part
    numbered = parts.withColumn(to, F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    return numbered.join(before, "__part").withColumn(to, F.col(to) + F.col("__carried")).drop("__part", "__carried")
