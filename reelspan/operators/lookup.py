"""Lookups of files by what a row says of them: by path, then by a name that only one file has."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    """The last part of a path, in lower case."""
    return F.lower(F.substring_index(path, "/", -1))


def name_index(files: DataFrame, path: str, order: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """name, files (how many have it), path of the first, and of each payload column the first value that is not null, in an order of the files."""
    first = F.struct(*order, path)
    some = [F.min_by(p, F.when(F.col(p).isNotNull(), first)).alias(p) for p in payload]
    return files.where(F.col(path).isNotNull()).groupBy(base_name(F.col(path)).alias("name")).agg(F.count("*").alias("files"), F.min_by(path, first).alias("path"), *some)


def looked_up(rows: DataFrame, said: str, files: DataFrame, path: str, payload: Sequence[str]) -> DataFrame:
    """rows with found_path, found_by (path, name, or ambiguous and missing, without a path) and the payload of the file.

    files: one row a path. A path is taken as it is written; where no file has it, its name is looked up whatever its case, and counts if just one file has it. Null and empty paths are missing.
    """
    there = files.where(F.col(path).isNotNull()).select(F.col(path).alias("_path"), *[F.col(p).alias(f"_p_{p}") for p in payload])
    names = files.where(F.col(path).isNotNull()).groupBy(base_name(F.col(path)).alias("_name")).agg(F.count("*").alias("_n"), F.min(path).alias("_only"), *[F.min_by(p, path).alias(f"_n_{p}") for p in payload])
    asked = rows.withColumn("_said", F.when(F.col(said) != "", F.col(said)))
    named = asked.join(there, F.col("_said") == F.col("_path"), "left").join(names, base_name(F.col("_said")) == F.col("_name"), "left")
    by_path, by_name = F.col("_path").isNotNull(), F.col("_n") == 1
    how = F.when(by_path, "path").when(by_name, "name").when(F.col("_n") > 1, "ambiguous").otherwise("missing")
    values = [F.when(by_path, F.col(f"_p_{p}")).when(by_name, F.col(f"_n_{p}")).alias(p) for p in payload]
    return named.select(*rows.columns, F.when(by_path, F.col("_path")).when(by_name, F.col("_only")).alias("found_path"), how.alias("found_by"), *values)
