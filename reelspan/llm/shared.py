"""Helpers that the training-data operators share: shared storage, Arrow batches, bounded memos."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import new_path, path_exists, shared_dir, written

__all__ = ["Memo", "arrow_map", "byte_texts", "fresh", "key_groups", "new_path", "path_exists", "shared_dir", "text_of", "with_keys", "written"]


def text_of(column: str = "text") -> Column:
    """The text, a null one as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def arrow_map(df: DataFrame, work: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch] | pa.RecordBatch], schema: str, rows: int = 1000) -> DataFrame:
    """mapInArrow of a function from one batch to one batch (or several); it gets `rows` rows at most at a time, which bounds a worker's objects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = work(batch.slice(at, rows))
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out

    return df.mapInArrow(run, schema)


def byte_texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column, null as empty, without decoding."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


class Memo(dict):
    """A dict filled by a function of many keys. It keeps its first `bound` entries, the common ones
    of any large input among them; further values live for one call only."""

    def __init__(self, fill: Callable[[list], Iterable], bound: int) -> None:
        super().__init__()
        self.fill, self.bound = fill, bound

    def resolved(self, lists: list[list]) -> list[list]:
        """The values of lists of keys; what is not there yet is filled in one call."""
        out = [list(map(self.get, keys)) for keys in lists]
        holes = [(keys, values, [i for i, v in enumerate(values) if v is None]) for keys, values in zip(lists, out, strict=True) if None in values]
        new = list({keys[i] for keys, _, at in holes for i in at})
        if new:
            found = dict(zip(new, self.fill(new), strict=True))
            for keys, values, at in holes:
                for i in at:
                    values[i] = found[keys[i]]
            room = self.bound - len(self)
            if room >= len(new):
                self.update(found)
            elif room > 0:
                self.update((k, found[k]) for k in new[:room])
        return out


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have yet, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def with_keys(df: DataFrame, *more: str) -> tuple[DataFrame, list[str]]:
    """df with two columns that tell its rows apart (without nulls), and their names.

    The first is a digest of the text and of the columns in more, the second the doc_id (a null one as
    the greatest long). Rows
    that agree in all of these share their keys.
    """
    a, b = fresh(df, "row_digest"), fresh(df, "row_doc")
    parts = [F.col(c) for c in ("text", *more)] + [F.col(c).isNull() for c in ("text", "doc_id", *more)]
    return df.withColumns({a: F.xxhash64(*parts), b: F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))}), [a, b]


def key_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of each key, of batches that are sorted by it. Keys hold no nulls."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        columns = [now.column(k).to_numpy(zero_copy_only=False) for k in keys]
        starts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        edges = [0, *starts.tolist()]
        for a, b in zip(edges, edges[1:], strict=False):
            yield now.slice(a, b - a)
        held = now.slice(edges[-1])
    if held is not None:
        yield held
