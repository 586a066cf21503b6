"""Manifests: CSV tables with fixed columns as the contract between phases, JSON documents, and configuration."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_manifest(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A CSV manifest in the columns of a schema: missing ones are null, unknown ones dropped, bad cells null."""
    wanted = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    raw = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    have = {c.strip().lower(): c for c in raw.columns}
    columns = []
    for f in wanted:
        cell = F.col(f"`{have[f.name.lower()]}`") if f.name.lower() in have else F.lit(None).cast("string")
        cell = F.when(F.trim(cell) != "", cell)
        whole = f.dataType.simpleString() in ("int", "bigint", "smallint")
        columns.append((cell.try_cast("double") if whole else cell).try_cast(f.dataType).alias(f.name))
    return raw.select(*columns)


def write_manifest(df: DataFrame, path: str, by: str | None = None) -> None:
    """A CSV manifest with a header; by: one folder for each value, such as the media set."""
    writer = df.write.mode("overwrite").option("header", "true").option("escape", '"')
    (writer.partitionBy(by) if by else writer).csv(path)


def write_documents(df: DataFrame, path: str) -> None:
    """One JSON document a row."""
    df.write.mode("overwrite").json(path)


def dotted(config: dict, key: str, default=None):
    """The value under a dotted key of nested settings."""
    now = config
    for part in key.split("."):
        if not isinstance(now, dict) or part not in now:
            return default
        now = now[part]
    return default if now is None else now


def read_config(text: str) -> dict:
    """Settings from YAML where its library is there, else from plain nested key: value lines."""
    try:
        import yaml
    except ImportError:
        return _plain(text)
    return yaml.safe_load(text) or {}


def _plain(text: str) -> dict:
    """Nested key: value lines and lists, of scalars or of such lines; a key without a value is an empty dict."""
    lines = []
    for line in text.splitlines():
        body = line.split(" #")[0].rstrip()
        if body.strip() and not body.lstrip().startswith("#") and body.strip() != "---":
            lines.append((len(body) - len(body.lstrip()), body.strip()))
    root: dict = {}
    at = 0
    while at < len(lines):
        found, at = _block(lines, at)
        root |= found if isinstance(found, dict) else {}
    return root


def _is_item(body: str) -> bool:
    return body == "-" or body.startswith("- ")


def _block(lines: list[tuple[int, str]], at: int) -> tuple[dict | list, int]:
    """The list or dict that begins at a line, and the line behind it. lines: depths and bodies."""
    depth = lines[at][0]
    if _is_item(lines[at][1]):
        items: list = []
        while at < len(lines) and lines[at][0] == depth and _is_item(lines[at][1]):
            item = lines[at][1][1:].strip()
            if re.match(r"[^\s\"'\[]\S*:(\s|$)", item):  # a dict whose first key stands beside the dash
                lines[at] = (depth + 2, item)
                value, at = _block(lines, at)
            elif item or at + 1 == len(lines) or lines[at + 1][0] <= depth:
                value, at = _scalar(item), at + 1
            else:
                value, at = _block(lines, at + 1)
            items.append(value)
        return items, at
    found: dict = {}
    while at < len(lines) and lines[at][0] == depth and not _is_item(lines[at][1]):
        key, colon, value = lines[at][1].partition(":")
        key, value, at = key.strip().strip("\"'"), value.strip(), at + 1
        below = at < len(lines) and (lines[at][0] > depth or lines[at][0] == depth and _is_item(lines[at][1]))
        if value:
            found[key] = _scalar(value)
        elif colon:
            found[key], at = _block(lines, at) if below else ({}, at)
    return found, at


def _scalar(text: str):
    if text.startswith("[") and text.endswith("]"):
        return [_scalar(x.strip()) for x in text[1:-1].split(",") if x.strip()]
    low = text.strip("\"'").lower()
    if low in ("true", "yes", "on"):
        return True
    if low in ("false", "no", "off"):
        return False
    for cast in (int, float):
        try:
            return cast(text)
        except ValueError:
            pass
    return text.strip("\"'")
