"""Packing of token sequences by order-preserving dynamic programming.

Documents keep their order within an input partition; their ids (each document's followed by an
end id) form one stream, cut into windows of at most `window` ids. Cuts may fall at document
ends (free), sentence ends (`sentence_cost`) and, where neither comes for long, at fixed steps
(`forced_cost`). A window costs its padding (none at a power of two) plus its cut's penalty. As
the padding is linear in the window's length, the best predecessor is a sliding-window minimum,
which a monotone queue keeps in constant time for each cut; unpadded powers of two are further
transitions. The stream is worked off in blocks of bounded length whose last window is carried
over into the next block.

It needs no shuffle: each task packs the rows of its own input partition, and sequence ids carry
the partition's number, so a repeated task makes the same sequences again.

Defined results: a null text packs as the empty text, which has the end id only; repeated rows
are packed as often as they come; a null doc_id stays null; further columns are ignored, whatever their names; an
empty table gives an empty result. Texts are packed whole: a long one is cut over several sequences. Of cuts of the same
cost the earliest found is taken, so the result depends on the input's partitions only.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import shared

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
PARTITION_SHIFT = 40


@dataclass(frozen=True)
class PackingConfig:
    window: int = 2048
    end_id: int = 1
    sentence_cost: int = 8
    forced_cost: int = 64
    forced_step: int = 128
    window_cost: int = 4  # of any window, against needless short ones
    block_ids: int = 262_144
    memo_entries: int = 300_000


class ChunkEncoder:
    """Ids of whole texts as little-endian uint32 bytes, memoised by chunk between blanks, and by word.

    For a tokenizer that lower-cases and drops white space, a blank is a safe cut everywhere, and so is
    the place between letters, a digit and other signs. Many new words are encoded in one call; as each
    is one pre-token, its ids end with the first one that ends a word. A text with "<|", which may
    open a special token, is encoded whole.
    """

    PIECES = re.compile(r"[^\W\d_]+|\d|(?:[^\w\s]|_)+|\s+")
    ODD = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]|[^\w\s\x21-\x7e]|[^\W\d_a-zA-Z\u00c0-\u024f]")  # controls, and signs and letters beyond Latin

    def __init__(self, path: str, memo_entries: int) -> None:
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.memo = shared.Memo(self._chunks, memo_entries)
        self.words = shared.Memo(self._words, 2 * memo_entries)
        self.ends_word = self._which(lambda token: token.endswith("</w>"))
        self.ends_sentence = self._which(lambda token: token.removesuffix("</w>").endswith((".", "!", "?")))

    def _which(self, test: Callable[[str], bool]) -> np.ndarray:
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        out = np.zeros(max(vocabulary.values()) + 1, bool)
        out[[i for token, i in vocabulary.items() if test(token)]] = True
        return out

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> Iterator[bytes]:
        """Of words that are one pre-token each: letters, or one punctuation mark."""
        for i in range(0, len(words), 2000):
            part = words[i : i + 2000]
            ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * np.flatnonzero(self.ends_word[ids]) + 4).tolist()
            if len(ends) != len(part):
                yield from self._whole(part)
                continue
            packed = ids.tobytes()
            yield from (packed[a:b] for a, b in zip([0, *ends], ends, strict=False))

    def _pieces(self, c: str) -> list[str] | None:
        """The pre-tokens of a chunk in lower case, or None if it is left to the library."""
        body, mark = (c[:-1], c[-1]) if c and c[-1] in ".,!?;:" else (c, "")
        if body.isascii():
            if body.isalpha():
                return [body.lower(), mark] if mark else [body.lower()]
            if "'" in c or not c.isprintable():  # what may be a contraction, or holds controls
                return None if "'" in c or self.ODD.search(c) else self._cut(c)
            return self._cut(c)
        if "'" in c or "\u0130" in c or "\u03a3" in c or self.ODD.search(c):  # letters of more than one lower form
            return None
        return self._cut(c)

    def _cut(self, c: str) -> list[str]:
        return [p for p in self.PIECES.findall(c.lower()) if not p.isspace()]

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        cut = list(map(self._pieces, chunks))
        known = dict.fromkeys(p for pieces in cut if pieces for p in pieces)
        known = dict(zip(known, self.words.resolved([list(known)])[0], strict=True))
        rest = iter(self._whole([c for c, pieces in zip(chunks, cut, strict=True) if pieces is None]))
        return [next(rest) if pieces is None else known[pieces[0]] if len(pieces) == 1 else b"".join([known[p] for p in pieces]) for pieces in cut]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; new chunks of all of them are looked up together."""
        cut = [[] if "<|" in t else t.split(" ") for t in texts]
        return [b"".join(ids) if chunks else self._whole([t])[0] for t, chunks, ids in zip(texts, cut, self.memo.resolved(cut), strict=True)]


@lru_cache(maxsize=1)
def encoder_of(path: str, memo_entries: int) -> ChunkEncoder:
    """One encoder, and its memo, for all tasks of a Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return ChunkEncoder(path, memo_entries)


def best_cuts(positions: list[int], penalties: list[int], window: int, window_cost: int = 0) -> list[int]:
    """The indices of the chosen cuts, the first and the last position among them.

    positions: increasing from 0, no gap over window. The cost of a window of n ids is
    window_cost + (0 if n is a power of two else window - n) + the penalty of its right end.
    """
    powers = [p for p in (1 << k for k in range(7, 40)) if p < window]
    n = len(positions)
    cost, back = [0] * n, [0] * n
    index = {p: i for i, p in enumerate(positions)}
    queue: deque[tuple[int, int, int]] = deque()  # increasing cost + position
    for j in range(1, n):
        at, before = positions[j], positions[j - 1]
        key = cost[j - 1] + before
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, before, j - 1))
        while at - queue[0][1] > window:
            queue.popleft()
        least, i = queue[0][0] + window - at, queue[0][2]
        for p in powers:
            k = index.get(at - p)
            if k is not None and cost[k] < least:
                least, i = cost[k], k
        cost[j], back[j] = least + penalties[j] + window_cost, i
    chosen = [n - 1]
    while chosen[-1]:
        chosen.append(back[chosen[-1]])
    return chosen[::-1]


def candidates(ids: np.ndarray, doc_ends: np.ndarray, ends_sentence: np.ndarray, config: PackingConfig) -> tuple[list[int], list[int]]:
    """Positions where the stream may be cut, and their penalties."""
    at = np.flatnonzero(ends_sentence[ids]) + 1
    penalty = np.full(len(ids) + 1, -1, np.int64)
    penalty[at] = config.sentence_cost
    penalty[[0, len(ids)]] = 0
    penalty[doc_ends] = 0
    known = np.flatnonzero(penalty >= 0)
    for i in np.flatnonzero(np.diff(known) > 4 * config.forced_step):
        more = np.arange(known[i] + config.forced_step, known[i + 1], config.forced_step)
        penalty[more] = config.forced_cost
    found = np.flatnonzero(penalty >= 0)
    return found.tolist(), penalty[found].tolist()


class Packer:
    """Takes documents in order and gives rows of SCHEMA."""

    def __init__(self, ends_sentence: np.ndarray, config: PackingConfig, first_sequence: int) -> None:
        self.ends, self.config, self.sequence = ends_sentence, config, first_sequence
        self.held: list[tuple[int | None, int, int, np.ndarray]] = []  # doc_id, start, doc_tokens, ids
        self.n_held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        self.held.append((doc_id, 0, len(ids), ids))
        self.n_held += len(ids)
        if self.n_held >= self.config.block_ids:
            yield from self._pack(last=False)

    def finish(self) -> Iterator[tuple]:
        if self.held:
            yield from self._pack(last=True)

    def _pack(self, last: bool) -> Iterator[tuple]:
        stream = np.concatenate([x[3] for x in self.held])
        ends = np.cumsum([len(x[3]) for x in self.held])
        positions, penalties = candidates(stream, ends, self.ends, self.config)
        cuts = [positions[i] for i in best_cuts(positions, penalties, self.config.window, self.config.window_cost)]
        if not last:
            cuts.pop()
        doc, left = 0, []
        for first, b in zip(cuts, cuts[1:], strict=False):
            a = first
            while a < b:
                doc_id, start, total, ids = self.held[doc]
                begin = ends[doc] - len(ids)
                stop = min(b, int(ends[doc]))
                piece = stream[a:stop]
                yield doc_id, start + int(a - begin), stop - a, zlib.crc32(piece.tobytes()), total, self.sequence, a - first
                a = stop
                if stop == ends[doc]:
                    doc += 1
            self.sequence += 1
        if not last:
            at = cuts[-1]
            for k in range(doc, len(self.held)):
                doc_id, start, total, ids = self.held[k]
                skip = max(0, at - int(ends[k] - len(ids)))
                left.append((doc_id, start + skip, total, ids[skip:]))
        self.held, self.n_held = left, sum(len(x[3]) for x in left)


def pack(docs: DataFrame, tokenizer_path: str, config: PackingConfig = PackingConfig()) -> DataFrame:
    """One row of SCHEMA for each piece of a document of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_path, config.memo_entries)
        packer = Packer(encoder.ends_sentence, config, TaskContext.get().partitionId() << PARTITION_SHIFT)
        end = np.asarray([config.end_id], "<u4").tobytes()

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                rows: list[tuple] = []
                encoded = encoder.encode([t or "" for t in part.column("text").to_pylist()])
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoded, strict=True):
                    rows.extend(packer.add(doc_id, np.frombuffer(ids + end, "<u4")))
                if rows:
                    yield batch_of(rows)
        if rows := list(packer.finish()):
            yield batch_of(rows)

    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(run, SCHEMA)
