"""Media sets of the settings: their dimension table, inventory jobs, scoped files, and caches of audits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch
from .manifests import dotted

SCHEMA = "media_set string, activity string, profile string, enabled boolean, position int"


@dataclass(frozen=True)
class Job:
    """What one inventory run reads and writes."""

    media_set: str
    folder: str
    manifest: str


def media_sets(config: dict, include_disabled: bool = False) -> list[tuple[str, str, str, bool, int]]:
    """(media_set, activity, profile, enabled, position) as declared under media_sets; a set without a name for its activity has its own."""
    out = []
    for position, (name, settings) in enumerate((dotted(config, "media_sets", {}) or {}).items()):
        settings = settings if isinstance(settings, dict) else {}
        enabled = settings.get("enabled", True) is not False
        if enabled or include_disabled:
            out.append((name, str(settings.get("activity", name)), str(settings.get("profile", "default")), enabled, position))
    return out


def dimension(spark: SparkSession, config: dict, include_disabled: bool = False) -> DataFrame:
    """media_sets() as a table, as small as the settings."""
    return spark.createDataFrame(media_sets(config, include_disabled), SCHEMA)


def inventory_jobs(config: dict, root: str, only: list[str] | None = None) -> list[Job]:
    """One job for each enabled set, or for those asked for; a name that is not declared is an error."""
    known = {m[0]: m for m in media_sets(config, include_disabled=True)}
    if missing := sorted(set(only or ()) - set(known)):
        raise ValueError(f"unknown media sets: {', '.join(missing)}")
    settings = dotted(config, "media_sets", {}) or {}
    names = only or [name for name, m in known.items() if m[3]]
    return [Job(n, f"{root}/{(settings[n] or {}).get('folder', n) if isinstance(settings[n], dict) else n}", f"{root}/inventory/{n}_inventory.csv") for n in names]


def scoped_path(spark: SparkSession, path: str, media_set: str) -> str:
    """The file of a media set beside a common one, folder/set/file, where there is one; else the common one."""
    folder, _, name = path.rpartition("/")
    own = f"{folder}/{media_set}/{name}"
    return own if scratch.path_exists(spark, own) else path


def require(spark: SparkSession, path: str, phase: str) -> str:
    """The path, or an error that says which phase makes it."""
    if not scratch.path_exists(spark, path):
        raise FileNotFoundError(f"{path} is missing: run {phase} first")
    return path


def read_cache(spark: SparkSession, path: str, version: int, schema: str) -> DataFrame:
    """key and value columns of a cache's entries of this version; a missing cache is empty. Of several entries of a key the greatest counts."""
    names = [f.split()[0] for f in schema.split(", ")]
    if not scratch.path_exists(spark, path):
        return spark.createDataFrame([], f"key string, {schema}")
    found = spark.read.schema(f"key string, version int, {schema}").parquet(path).where(F.col("version") == version)
    return found.groupBy("key").agg(F.max(F.struct(*names)).alias("v")).select("key", *[F.col(f"v.{n}").alias(n) for n in names])


def through_cache(rows: DataFrame, identity: list[str], path: str, version: int, schema: str, compute) -> DataFrame:
    """rows with the value columns of schema: from the cache where a digest of the identity columns is there, else
    computed (compute: frame of distinct identities and key, to key and values) and added to it."""
    spark = rows.sparkSession
    keyed = rows.withColumn("key", F.sha2(F.to_json(F.struct(*identity), {"ignoreNullFields": "false"}), 256))
    known = read_cache(spark, path, version, schema)
    misses = keyed.select("key", *identity).join(known.select("key"), "key", "left_anti").dropDuplicates(["key"])
    names = [f.split()[0] for f in schema.split(", ")]
    compute(misses).select("key", F.lit(version).cast("int").alias("version"), *names).write.mode("append").parquet(path)
    return keyed.join(read_cache(spark, path, version, schema), "key", "left").drop("key")
