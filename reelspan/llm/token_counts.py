"""Token counts by a digest cache.

Texts (null: empty) are joined by a digest of their content, and by a digest of the
tokenizer's file and library version, to counts stored before. Only the distinct texts that the
cache lacks are encoded; their counts are appended to the cache, a Parquet table in shared
storage, and the documents then take all their counts from the cache.

The normal form of a content is its UTF-8 bytes, null as empty: any further folding could join
texts of different counts. Within one task, counts of white-space separated chunks are memoised,
as a chunk's ids do not depend on its surroundings where it starts after "non-space, one blank"
and begins with a non-space; all other texts go to the library whole.

Defined results: null text counts as the empty text (0 bytes, 0 tokens); repeated rows give
repeated results, of one cache entry; a null doc_id stays null; further columns of the input are ignored,
whatever their names; an empty table gives an empty result. Texts are counted whole, however long; one of
exactly `limit` tokens is not over it.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

CACHE_SCHEMA = "content_digest binary, tokenizer_digest string, n_tokens long"
SPECIAL_MARK = "<|"


def tokenizer_digest(path: str) -> str:
    """A digest of the tokenizer's file and of the library's version."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


class ChunkCounter:
    """Counts of whole texts by a byte-level BPE tokenizer, memoised by chunk and by word.

    A cut at a single blank between two non-spaces is safe for the byte-level pattern: the blank
    always opens the next pre-token; so is the place between letters and a punctuation mark. Many new
    words are encoded in one call; as each is a pre-token that opens with a blank, its ids begin
    where a token with a leading blank stands. Chunks that begin or end with white space (or are
    empty) make a text be encoded whole, and so does "<|", which may open a special token.
    """

    SIMPLE = re.compile(r"([^\W\d_]+)([.,!?;:]?)")

    def __init__(self, path: str, memo_entries: int = 100_000) -> None:
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.memo = shared.Memo(self._chunks, memo_entries)
        self.words = shared.Memo(self._words, 2 * memo_entries)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True  # how byte-level tokens write a blank

    def _whole(self, texts: list[str]) -> list[int]:
        return [len(x.ids) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> Iterator[int]:
        """Of words of letters, each after a blank; a punctuation mark stands for itself."""
        for i in range(0, len(words), 2000):
            part = words[i : i + 2000]
            ids = self.tokenizer.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)[0].ids
            starts = np.flatnonzero(self.opens[ids])
            if len(starts) == len(part) and starts[0] == 0:
                yield from np.diff(starts, append=len(ids)).tolist()
            else:
                yield from self._whole([" " + w for w in part])

    def _chunks(self, chunks: list[str]) -> list[float]:
        """A chunk's count after a blank; an unsafe chunk's is not a number, as is then the sum."""
        out: list[float] = [float("nan")] * len(chunks)
        simple, rest = [], []
        for i, c in enumerate(chunks):
            m = self.SIMPLE.fullmatch(c)
            if m and m[1].isalpha():
                simple.append((i, m[1], m[2]))
            elif c and not c[0].isspace() and not c[-1].isspace():
                rest.append(i)
        for (i, _, mark), n in zip(simple, self.words.resolved([[w for _, w, _ in simple]])[0], strict=True):
            out[i] = n + (1 if mark else 0)  # an ASCII mark is one byte, hence one token
        for i, n in zip(rest, self._whole([" " + chunks[i] for i in rest]), strict=True):
            out[i] = n
        return out

    def counts(self, texts: list[str]) -> list[int]:
        """The count of each text; new chunks of all of them are looked up together."""
        out, whole, at, cut = [0] * len(texts), [], [], []
        for i, text in enumerate(texts):
            if not text:
                continue
            if SPECIAL_MARK in text or text[0].isspace() or text[-1].isspace():
                whole.append(i)
            else:
                at.append(i)
                cut.append(text.split(" "))
        firsts = self._whole([chunks[0] for chunks in cut])
        for i, counts, first in zip(at, self.memo.resolved(cut), firsts, strict=True):
            n = sum(counts)
            if n == n:
                out[i] = int(n - counts[0] + first)
            else:
                whole.append(i)
        for i, n in zip(whole, self._whole([texts[i] for i in whole]), strict=True):
            out[i] = n
        return out


@lru_cache(maxsize=1)
def counter_of(path: str, memo_entries: int) -> ChunkCounter:
    """One counter, and its memo, for all tasks of a Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return ChunkCounter(path, memo_entries)


def _encoder(path: str, digest: str, memo_entries: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(path, memo_entries)
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                b = batch.slice(i, 128)
                n = counter.counts(b.column("content").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [b.column("content_digest").cast(pa.binary()), pa.array(list(repeat(digest, len(n))), pa.string()), pa.array(n, pa.int64())],
                    names=["content_digest", "tokenizer_digest", "n_tokens"],
                )

    return run


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, limit: int = 1024, memo_entries: int = 100_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of docs (doc_id, text).

    cache_path: a cache that lives on; by default a new one in the shared folder. One writer at a
    time keeps it without double entries; entries that two writers added both are folded on reading.
    """
    spark = docs.sparkSession
    digest = tokenizer_digest(tokenizer_path)
    content = docs.select("doc_id", shared.text_of().alias("content"))
    keyed = content.withColumn("content_digest", F.unhex(F.sha2("content", 256)))

    known = None
    if cache_path and shared.path_exists(spark, cache_path):
        known = _entries(spark, cache_path, digest).groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))
    misses = keyed if known is None else keyed.join(known, "content_digest", "left_anti")
    cache_path = cache_path or shared.new_path(spark, "token-cache")
    distinct = misses.select("content_digest", "content").dropDuplicates(["content_digest"])
    distinct.mapInArrow(_encoder(tokenizer_path, digest, memo_entries), CACHE_SCHEMA).write.mode("append").parquet(cache_path)

    counts = _entries(spark, cache_path, digest)
    if known is not None:
        counts = counts.groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))
    return (
        keyed.select("doc_id", F.octet_length("content").cast("long").alias("n_bytes"), "content_digest")
        .join(counts, "content_digest")
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )


def _entries(spark, path: str, digest: str) -> DataFrame:
    return spark.read.schema(CACHE_SCHEMA).parquet(path).where(F.col("tokenizer_digest") == digest).select("content_digest", "n_tokens")
