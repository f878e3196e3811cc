"""Running totals over a whole table in the order of its columns, without one task that sees every row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from taxloom.session import settle


def with_running_totals(rows: DataFrame, order: list[str], **totals: Column) -> DataFrame:
    """Adds, per name, the sum of its expression (a whole number, null counts 0) over all rows before this one in ``order``,
    which should tell the rows apart.

    Rows are cut into ranges of the order and stored with their range, because ranges are drawn anew each time they are computed.
    Each range adds up its own rows; the sums of the ranges, one row per shuffle partition, are added up as one array.
    """
    spark = rows.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    valued = rows.withColumns({f"_value_{name}": F.coalesce(value.cast("bigint"), F.lit(0).cast("bigint")) for name, value in totals.items()})
    cut = settle(valued.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = F.struct("_range", *[f"_value_{name}" for name in totals])
    whole = cut.groupBy("_range").agg(*[F.sum(f"_value_{name}").alias(f"_value_{name}") for name in totals]).agg(
        F.array_sort(F.collect_list(sums)).alias("all"))
    before = lambda name, i: F.aggregate(F.slice("all", F.lit(1), i), F.lit(0).cast("bigint"), lambda n, r: n + r[f"_value_{name}"])
    starts = whole.select(F.inline(F.transform("all", lambda r, i: F.struct(
        r["_range"].alias("_range"), *[before(name, i).alias(f"_start_{name}") for name in totals]))))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return cut.join(F.broadcast(starts), "_range").select(  # one row per shuffle partition
        *rows.columns, *[(F.col(f"_start_{name}") + F.coalesce(F.sum(f"_value_{name}").over(inside), F.lit(0))).alias(name) for name in totals])
