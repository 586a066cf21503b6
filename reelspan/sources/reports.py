"""Markdown reports of selections: counts by group, running time, and the best and the first excluded rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOP = 10


def _table(df: DataFrame) -> list[str]:
    """A small table, whole: df is an aggregate or a top list."""
    rows = [[str(v) if v is not None else "" for v in r] for r in df.collect()]
    return ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *("| " + " | ".join(r).replace("\n", " ") + " |" for r in rows)]


def selection_report(rows: DataFrame, title: str, groups: list[str], status: str = "", most: int = 100) -> str:
    """rows: key, score, seconds, selected, reason and the group columns. Of a column of very many values the `most` largest groups are listed, and the others are one line with
    their number, so all rows are accounted for.

    Only aggregates and lists of ten rows reach the driver.
    """
    chosen = rows.where("selected")
    total = rows.agg(F.count("*").alias("candidates"), F.count_if("selected").alias("selected"), F.round(F.sum(F.when(F.col("selected"), F.col("seconds"))), 1).alias("seconds"))
    out = [f"# {title}", "", *([status, ""] if status else []), *_table(total)]
    for g in groups:
        counted = chosen.groupBy(g).agg(F.count("*").alias("rows"), F.round(F.sum("seconds"), 1).alias("seconds")).orderBy(F.desc("rows"), g)
        out += ["", f"## By {g}", "", *_table(counted.limit(most))]
        named = counted.limit(most).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.round(F.coalesce(F.sum("seconds"), F.lit(0.0)), 1).alias("seconds")).first()
        every = counted.agg(F.count("*").alias("groups"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.round(F.coalesce(F.sum("seconds"), F.lit(0.0)), 1).alias("seconds")).first()
        if every.groups > most:
            out.append(f"| {every.groups - most} more | {every.rows - named.rows} | {round(every.seconds - named.seconds, 1)} |")
    for name, part in (("Selected", chosen), ("Excluded", rows.where("not selected"))):
        out += ["", f"## {name}: the {TOP} best", "", *_table(part.orderBy(F.desc("score"), "key").select("key", F.round("score", 2).alias("score"), "reason").limit(TOP))]
    return "\n".join(out) + "\n"


def write_text(spark, text: str, path: str) -> None:
    """A text as one file, in any store that Spark writes to."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
