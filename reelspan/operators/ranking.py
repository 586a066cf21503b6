"""Numbers over a whole table's order, without one task for all of it."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import scratch


def numbered(rows: DataFrame, order: list[str], name: str, first: int = 1) -> DataFrame:
    """rows with their number in the order of some columns, which must tell them apart.

    Rows are dealt by ranges of the order and numbered within each; what a range begins with is a sum of the counts
    before it, one number a partition.
    """
    dealt = scratch.written(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dict(sorted((r["_range"], r["count"]) for r in dealt.groupBy("_range").count().collect()))
    before = dict(zip(counts, accumulate(counts.values(), initial=first - 1), strict=False))
    offset = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("_range")) if before else F.lit(0)
    here = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn(name, (offset + here).cast("long")).drop("_range")
